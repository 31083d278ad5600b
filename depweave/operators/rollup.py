"""Weighted edges rolled up to projects and documents, and what follows from them.

Weights are decimals, so that sums do not depend on their order.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.operators.edges import observed
from depweave.operators.pairs import counted, places

#: What a kind of edge counts for in each roll-up.
PROJECT = {"project-reference": "8", "document-reference": "4.2", "symbol-call": "3.2", "symbol-inheritance": "3", "symbol-implementation": "3", "symbol-creation": "2.4", "symbol-reference": "2.1"}
DOCUMENT = {"document-reference": "3.4", "symbol-call": "2.8", "symbol-inheritance": "2.6", "symbol-implementation": "2.6", "symbol-creation": "2.2", "symbol-reference": "1.9"}
SYMBOL = {"symbol-call": "2.6", "symbol-inheritance": "2.4", "symbol-implementation": "2.4", "symbol-creation": "2", "symbol-reference": "1.6"}


def coefficient(kind: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("decimal(4,1)")
    for name, value in table.items():
        found = F.when(kind == name, F.lit(value).cast("decimal(4,1)")).otherwise(found)
    return found


def rolled_up(edges: DataFrame, owners: DataFrame, table: dict[str, str]) -> DataFrame:
    """``a, b, weight``: edges between different owners (``node, owner``), by kind, added up; other kinds and unowned ends drop out."""
    return _owned(edges, owners, table).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _owned(edges: DataFrame, owners: DataFrame, table: dict[str, str]) -> DataFrame:
    """``a, b, weight`` of each edge between different owners."""
    own = lambda end, name: owners.select(F.col("node").alias(end), F.col("owner").alias(name))
    rows = edges.withColumn("c", coefficient(F.col("kind"), table)).where("c is not null and weight > 0")
    joined = rows.join(own("source", "a"), "source").join(own("target", "b"), "target").where("a <> b")
    return joined.select("a", "b", (F.col("weight") * F.col("c")).alias("weight"))


def _of_tenths(n: Column) -> Column:
    return n * F.lit("0.1").cast("decimal(2,1)")


def rolled_up_documents(observations: DataFrame, declarations: DataFrame, edges: DataFrame, owners: DataFrame, table: dict[str, str]) -> DataFrame:
    """``a, b, weight``: what edges roll up to between documents, and what document edges count for, all made at once.

    ``edges`` between symbols with their documents as ``owners``; all that observe or declare are documents.
    """
    more = _owned(edges, owners, table).select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("weight") * 10).cast("long").alias("n"))
    said = observed(observations).withColumn("n", F.col("n") * int(Decimal(table["document-reference"]) * 10))
    found = counted(said, places(declarations), more=more).where("source <> target")
    return found.select(F.col("source").alias("a"), F.col("target").alias("b"), _of_tenths(F.col("reference_count")).alias("weight"))


def importance_of_documents(observations: DataFrame, declarations: DataFrame, edges: DataFrame, owners: DataFrame, table: dict[str, str]) -> DataFrame:
    """``node, importance``: of what ``rolled_up_documents`` gives all weight out of and into a document, without making pairs.

    Of a key with N observations and M documents that declare it, a document with n of those
    observations has n * M edges out and, if it declares the key itself, N in; less its own n both times.
    """
    said = observations.select(F.col("target_symbol_key").alias("key"), F.col("source_document_id").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("d"))
    known = declarations.select(F.col("symbol_key").alias("key"), F.col("document_id").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("d"))
    rows = said.unionByName(known).where("key is not null and node is not null").repartition("key").groupBy("key", "node").agg(F.sum("n").alias("n"), F.max("d").alias("d"))
    w = Window.partitionBy("key")
    each = rows.withColumns({"all": F.sum("n").over(w), "m": F.sum("d").over(w)}).select("node", (F.col("n") * (F.col("m") - F.col("d")) + F.col("d") * (F.col("all") - F.col("n"))).alias("n"))
    tenths = int(Decimal(table["document-reference"]) * 10)
    of_pairs = each.where("n > 0").groupBy("node").agg((F.sum("n") * tenths).alias("n")).select("node", _of_tenths(F.col("n")).cast("decimal(38,1)").alias("weight"))
    owned = _owned(edges, owners, table)
    both = owned.select(F.explode(F.array("a", "b")).alias("node"), F.col("weight").cast("decimal(38,1)").alias("weight"))
    return of_pairs.unionByName(both).groupBy("node").agg(F.sum("weight").alias("importance"))


def rolled_up_references(observations: DataFrame, declarations: DataFrame, owners: DataFrame, table: dict[str, str]) -> DataFrame:
    """``a, b, weight``: what document edges add up to between different owners, without making the edges.

    Both sides are counted by target and owner before they meet, so a pair of documents is never a
    row. Edges of a document to itself have one owner and so count nowhere.
    """
    own = lambda doc, name: owners.select(F.col("node").alias(doc), F.col("owner").alias(name))
    said = observations.groupBy("source_document_id", "target_symbol_key").agg(F.count("*").alias("n")).join(own("source_document_id", "a"), "source_document_id")
    said = said.groupBy("a", "target_symbol_key").agg(F.sum("n").alias("n"))
    places = declarations.select(F.col("symbol_key").alias("target_symbol_key"), "document_id").distinct().join(own("document_id", "b"), "document_id")
    places = places.groupBy("b", "target_symbol_key").agg(F.count("*").alias("m"))
    both = said.join(places, "target_symbol_key").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return both.select("a", "b", (F.col("n") * F.lit(table["document-reference"]).cast("decimal(4,1)")).alias("weight"))


def added(*weights: DataFrame) -> DataFrame:
    """``a, b, weight`` of several roll-ups as one."""
    return reduce(DataFrame.unionByName, (w.select("a", "b", F.col("weight").cast("decimal(38,1)").alias("weight")) for w in weights)).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def symbol_adjacency(edges: DataFrame) -> DataFrame:
    """``a, b, weight`` of references between symbols; a symbol's references to itself are kept."""
    rows = edges.withColumn("c", coefficient(F.col("kind"), SYMBOL)).where("c is not null and weight > 0")
    return rows.groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.sum(F.col("weight") * F.col("c")).alias("weight"))


def importance(weights: DataFrame) -> DataFrame:
    """``node, importance``: all weight out of and into a node."""
    both = weights.select(F.col("a").alias("node"), "weight").unionByName(weights.select(F.col("b").alias("node"), "weight"))
    return both.groupBy("node").agg(F.sum("weight").alias("importance"))


def document_importance(weights: DataFrame, symbols: DataFrame) -> DataFrame:
    """Importance of documents, and 0.35 for each of their visible symbols (``document_id``)."""
    return with_symbols(importance(weights), symbols)


def with_symbols(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``node, importance`` with 0.35 more for each visible symbol of a document."""
    more = symbols.groupBy(F.col("document_id").alias("node")).agg((F.count("*") * F.lit("0.35").cast("decimal(4,2)")).alias("more"))
    zero = F.lit(0).cast("decimal(1,0)")
    return found.join(more, "node", "full").select("node", (F.coalesce("importance", zero) + F.coalesce("more", zero)).alias("importance"))


def flow_bias(weights: DataFrame, layers: DataFrame) -> DataFrame:
    """``node, bias``: weighted mean of how many layers the neighbours are further on, within -1 and 1; 0 without neighbours."""
    both = weights.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(weights.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    l = layers.select("node", "layer")  # noqa: E741
    step = both.join(l, "node").join(l.withColumnsRenamed({"node": "other", "layer": "far"}), "other")
    mean = step.groupBy("node").agg((F.sum(F.col("weight") * (F.col("far") - F.col("layer"))).cast("double") / F.sum("weight").cast("double")).alias("m"))
    return l.join(mean, "node", "left").select("node", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("m", F.lit(0.0)))).alias("bias"))


def in_out_weights(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, incoming, outgoing``: weight of dependency edges into and out of a seed's nodes, each edge once and 1 at least."""
    w = F.sum(F.greatest(F.lit(1), "weight")).cast("long")
    into = edges.join(seeds, F.col("target") == F.col("node")).groupBy("seed").agg(w.alias("incoming"))
    out = edges.join(seeds, F.col("source") == F.col("node")).groupBy("seed").agg(w.alias("outgoing"))
    zero = F.lit(0).cast("long")
    return seeds.select("seed").distinct().join(into, "seed", "left").join(out, "seed", "left").select("seed", F.coalesce("incoming", zero).alias("incoming"), F.coalesce("outgoing", zero).alias("outgoing"))
