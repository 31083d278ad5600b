"""Nodes and edges of the graph, as they are handed to a viewer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.ids import edge_id, node_id
from depweave.operators.edges import first_by
from depweave.plans.beside import beside
from depweave.plans.staging import stage

#: Node ids up to which they are broadcast to the edges (some 50 MB).
BROADCAST_NODES = 500_000
EDGE_IDENTITY = ["source", "target", "kind", "reference_kind", "confidence"]


def nodes(*sources: DataFrame) -> DataFrame:
    """Rows ``id, label, group, symbol_kind`` of all sources, the first of each id; sources come in the order given.

    Each source has ``ordinal``; ids repeat only within a group of sources, so ``ordinal`` decides.
    """
    every = sources[0].withColumn("_s", F.lit(0))
    for k, more in enumerate(sources[1:], 1):
        every = every.unionByName(more.withColumn("_s", F.lit(k)))
    return first_by(every.withColumn("ordinal", F.struct("_s", "ordinal")).drop("_s"), ["id"]).drop("ordinal")


def node_rows(rows: DataFrame, id_: Column, label: str, group: str, ordinal: str, symbol_kind: Column | None = None) -> DataFrame:
    return rows.select(id_.alias("id"), F.col(label).alias("label"), F.lit(group).alias("group"), (F.lit(None).cast("string") if symbol_kind is None else symbol_kind).alias("symbol_kind"), F.col(ordinal).cast("string").alias("ordinal"))


def edge_rows(rows: DataFrame, source: Column, target: Column, kind: Column | str, weight: Column | int = 1, reference_kind: str | None = None, confidence: str | None = None, ordinal: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(weight) if isinstance(weight, int) else weight).cast("long").alias("weight"),
        (F.col(reference_kind) if reference_kind else none).alias("reference_kind"), (F.col(confidence) if confidence else none).alias("confidence"),
        (F.col(ordinal).cast("string") if ordinal else F.lit("")).alias("ordinal"),
    )


def edges(*sources: DataFrame, unique: list[DataFrame] | None = None) -> DataFrame:
    """Edges of all sources, the first of each identity; the weights of the others are dropped, not added.

    ``unique``: sources of kinds of their own in which no identity repeats; they are added as they are.
    """
    parts = [first_by(reduce(DataFrame.unionByName, sources), EDGE_IDENTITY).drop("ordinal")] if sources else []
    found = reduce(DataFrame.unionByName, parts + [more.drop("ordinal") for more in unique or []])
    return found.withColumn("id", edge_id("kind", "source", "target", "reference_kind", "confidence"))


def between(edges: DataFrame, visible: DataFrame, node: str = "id") -> DataFrame:
    """Edges of which both ends are among the nodes.

    The ids are staged and counted: up to BROADCAST_NODES they are broadcast, so the edges stay where they are.
    """
    ids = stage(visible.select(F.col(node).alias("_id")).distinct(), "visible")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")


def among(rows: DataFrame, column: str, ids: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """Rows whose column is one of the ids (a table of one column).

    Many rows stay where they are: the ids are broadcast or, if they are more than ``most``, what the
    rows have besides, which is often little; only if both are many, rows are dealt.
    """
    ids = stage(ids.toDF("_id").distinct(), "ids")
    if ids.count() <= most:
        return rows.join(F.broadcast(ids), F.col(column) == F.col("_id"), "left_semi")
    others = stage(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_other")).distinct().join(ids, F.col("_other") == F.col("_id"), "left_anti"), "others")
    if others.count() <= most:
        return rows.where(F.col(column).isNotNull()).join(F.broadcast(others), F.col(column) == F.col("_other"), "left_anti")
    return rows.join(ids, F.col(column) == F.col("_id"), "left_semi")


def capped_symbols(rows: DataFrame, cap: int = 3000) -> DataFrame:
    """The first ``cap`` rows in the order of ``ordinal``, with ``rank``; a repeated id uses up a place as well.

    Each task keeps its first ``cap`` rows, so what meets at the end is bounded.
    """
    return rows.orderBy("ordinal").limit(max(0, cap)).withColumn("rank", F.row_number().over(Window.orderBy("ordinal")))  # at most cap rows


def referenced_projects(references: DataFrame, projects: DataFrame) -> DataFrame:
    """``source, target, label, node, is_phantom``: references by key whatever the case; a key that no project has makes a node of its own."""
    known = projects.groupBy(F.upper("project_key").alias("u")).agg(F.min("project_key").alias("known"))
    joined = references.join(known, F.upper("target") == F.col("u"), "left")
    return joined.select("source", "target", "label", node_id("project", F.coalesce("known", "target")).alias("node"), F.col("known").isNull().alias("is_phantom"))


def stats(projects: DataFrame, documents: DataFrame, symbols: DataFrame, native: DataFrame, document_edges: DataFrame, symbol_edges: DataFrame, cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of ten counts; documents and symbols count whether shown or not, edges after duplicates went. ``edges``: all but those between documents."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    kind = lambda k: F.count_if(F.lower("graph_kind") == k).alias(f"{k}_cycle_count")
    parts = [
        count(projects, "project_count"), count(documents, "document_count"), count(symbols, "symbol_count"), count(native, "native_dependency_count"),
        count(document_edges, "document_dependency_count"), count(symbol_edges, "symbol_dependency_count"),
        cycles.agg(kind("project"), kind("document"), kind("symbol")), count(edges, "edge_count"),
    ]
    return beside(*parts).withColumn("edge_count", F.col("edge_count") + F.col("document_dependency_count"))


def as_json(nodes: DataFrame, edges: DataFrame, ordinal: str = "id") -> DataFrame:
    """Rows ``part, json``: each node and each edge as a JSON line, for a viewer that reads them one by one."""
    pack = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return pack(nodes, "node").unionByName(pack(edges, "edge"))
