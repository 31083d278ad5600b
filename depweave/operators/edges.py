"""Observations joined to declarations, counted as edges, each with the first sample that was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.columns import blank_to_null, ci
from depweave.functions.ids import confidence, reference_kind
from depweave.operators.pairs import counted, places
from depweave.plans.staging import stage

#: Keys with several symbols up to which they are broadcast.
BROADCAST_KEYS = 500_000
DOCUMENT_EDGE, SYMBOL_EDGE = ("source", "target"), ("source", "target", "reference_kind", "confidence")


def first_sample(ordinal: str = "ordinal") -> list[Column]:
    """Aggregates ``sample_file, sample_line, sample_snippet``: of the first row by ordinal that has any of them.

    Blank texts and lines below 1 are nothing. Rows of one ordinal go by their samples.
    """
    file, line, text = blank_to_null(F.col("file")), F.when(F.col("line") > 0, F.col("line")), blank_to_null(F.col("snippet"))
    some = F.coalesce(file, line.cast("string"), text).isNotNull()
    found = F.min_by(F.struct(file.alias("file"), line.alias("line"), text.alias("snippet")), F.when(some, F.struct(F.col(ordinal), text.alias("t"), file.alias("f"), line.alias("l"))))
    return [found["file"].alias("sample_file"), found["line"].alias("sample_line"), found["snippet"].alias("sample_snippet")]


def first_declarations(declarations: DataFrame) -> DataFrame:
    """``symbol_key, symbol_id, document_id`` of the first declaration of each symbol."""
    first = F.min_by(F.struct("symbol_id", "document_id"), F.struct("ordinal", "symbol_id", "document_id"))
    return declarations.groupBy("symbol_key").agg(first.alias("d")).select("symbol_key", "d.symbol_id", "d.document_id")


def document_edges(observations: DataFrame, declarations: DataFrame, origin: Column | None = None, samples: bool = True) -> DataFrame:
    """``source, target, reference_count`` and, unless ``samples`` is off, the sample: an observation counts once for each other document that declares its target.

    Observations are folded by document and target first, so a target that very many documents
    declare is met once by each observing document. ``origin``: a column of observations; samples
    of the lowest one go before, as if edges of each origin had been merged in that order.
    """
    if not samples:
        return counted(observed(observations), places(declarations)).where("source <> target")
    ordinal = F.struct((F.lit(0) if origin is None else origin).alias("origin"), F.col("ordinal").alias("at"))
    rows = observations.where("source_document_id is not null and target_symbol_key is not null").withColumn("ordinal", ordinal).repartition("target_symbol_key")
    folded = rows.groupBy(F.col("source_document_id").alias("source"), "target_symbol_key").agg(F.count("*").alias("n"), *first_sample(), _first_place().alias("ordinal"))
    folded = folded.withColumnsRenamed({"sample_file": "file", "sample_line": "line", "sample_snippet": "snippet"})
    pairs = counted(folded, places(declarations), samples=True).where("source <> target")
    return pairs.withColumnsRenamed({"file": "sample_file", "line": "sample_line", "snippet": "sample_snippet"})


def observed(observations: DataFrame, *more: str) -> DataFrame:
    """``source, target_symbol_key, n`` and more columns of observations: how often a document observes a key."""
    rows = observations.where("source_document_id is not null and target_symbol_key is not null").repartition("target_symbol_key")
    return rows.groupBy(F.col("source_document_id").alias("source"), "target_symbol_key", *more).agg(F.count("*").alias("n"))


def dominant_kinds(observations: DataFrame, declarations: DataFrame) -> DataFrame:
    """``source, target, reference_kind, reference_count``: for each pair of documents the most frequent kind, see ``dominant_kind``, and the count of all kinds."""
    rows = observations.where("target_symbol_key is not null").repartition("target_symbol_key")
    folded = rows.groupBy(F.col("source_document_id").alias("source"), "target_symbol_key", "reference_kind").agg(F.count("*").alias("n"))
    return counted(folded, places(declarations), "reference_kind")


def _first_place() -> Column:
    """The ordinal of the row that gives the first sample."""
    some = F.coalesce(blank_to_null(F.col("file")), F.when(F.col("line") > 0, F.col("line")).cast("string"), blank_to_null(F.col("snippet"))).isNotNull()
    return F.min(F.when(some, F.col("ordinal")))


def symbol_edges(observations: DataFrame, declarations: DataFrame) -> DataFrame:
    """``source, target, reference_kind, confidence, reference_count`` and sample.

    The target is the first declaration of the target's key; the source is the declaration of the
    source's key in the observing document, else its first. Observations without a source, with an
    end that is declared nowhere, or of a symbol by itself, drop out.
    Observations are folded by keys where they meet the first declarations of their sources. Keys with several symbols are
    looked for first: without any, and with a symbol of its own for each key, what is folded are the edges.
    """
    ids = F.col("symbol_id")
    firsts = declarations.groupBy("symbol_key").agg(
        F.min(F.struct("ordinal", "symbol_id"))["symbol_id"].alias("symbol_id"), (F.min(ids).eqNullSafe(F.max(ids)) & (F.count(ids) == F.count("*"))).alias("one"),
    )
    firsts = stage(firsts, "firsts")
    several = firsts.where("not one").select("symbol_key")
    found = firsts.agg(F.count_if(~F.col("one")).alias("several"), F.count("*").alias("n"), F.count_distinct("symbol_id").alias("different")).first()
    sample = ["file", "line", "snippet"]
    rows = observations.where("source_symbol_key is not null and target_symbol_key is not null").repartition("source_symbol_key")
    rows = rows.withColumns({"reference_kind": reference_kind("reference_kind"), "confidence": confidence("confidence")})
    keys = ["source_symbol_key", "target_symbol_key", "reference_kind", "confidence", *(["source_document_id"] if found["several"] else [])]
    folded = rows.groupBy(*keys).agg(F.count("*").alias("n"), *first_sample(), _first_place().alias("ordinal")).withColumnsRenamed({f"sample_{c}": c for c in sample})
    of = lambda end, name: firsts.select(F.col("symbol_key").alias(end), F.col("symbol_id").alias(name))
    joined = folded.join(of("source_symbol_key", "source"), "source_symbol_key")
    if found["several"]:
        few = F.broadcast(several) if found["several"] <= BROADCAST_KEYS else several
        here = declarations.join(few, "symbol_key", "left_semi").groupBy("symbol_key", "document_id").agg(F.min_by("symbol_id", "ordinal").alias("here"))
        here = here.select(F.col("symbol_key").alias("source_symbol_key"), F.col("document_id").alias("source_document_id"), "here")
        joined = joined.join(here, ["source_symbol_key", "source_document_id"], "left").withColumn("source", F.coalesce("here", "source"))
    joined = joined.join(of("target_symbol_key", "target"), "target_symbol_key").where("source <> target")
    if not found["several"] and found["n"] == found["different"]:  # keys are symbols, so all is folded
        return joined.select(*SYMBOL_EDGE, F.col("n").alias("reference_count"), *(F.col(c).alias(f"sample_{c}") for c in sample))
    return joined.groupBy(*SYMBOL_EDGE).agg(F.sum("n").alias("reference_count"), *first_sample())


def ordered(edges: DataFrame) -> DataFrame:
    """Edges by count from the top, then by their ends."""
    return edges.orderBy(F.desc("reference_count"), "source", "target", *[c for c in ("reference_kind", "confidence") if c in edges.columns])


def merge_edges(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = DOCUMENT_EDGE) -> DataFrame:
    """Edges of two origins as one: counts are added, the first origin's sample goes before; counts below 1 are ignored."""
    rows = first.withColumn("ordinal", F.lit(0)).unionByName(second.withColumn("ordinal", F.lit(1))).where("reference_count > 0")
    rows = rows.withColumnsRenamed({"sample_file": "file", "sample_line": "line", "sample_snippet": "snippet"})
    return rows.groupBy(*keys).agg(F.sum("reference_count").alias("reference_count"), *first_sample())


def include_edges(includes: DataFrame) -> DataFrame:
    """``source, target, reference_count``: each pair of an including and an included document counts 1."""
    return includes.select("source", "target").where("source <> target").distinct().withColumn("reference_count", F.lit(1).cast("long"))


def dominant_kind(kinds: DataFrame, keys: tuple[str, ...] = DOCUMENT_EDGE, kind: str = "reference_kind") -> DataFrame:
    """For each pair the most frequent kind, ties by the kind that sorts first, and the count of all kinds. A column ``n`` of kinds, if any, is what a row counts for."""
    # Dealt by pair once, for both aggregates.
    counts = kinds.repartition(*keys).groupBy(*keys, kind).agg(F.sum("n").alias("n") if "n" in kinds.columns else F.count("*").alias("n"))
    best = F.min_by(F.col(kind), F.struct((-F.col("n")).alias("n"), ci(kind).alias("ci"), F.col(kind).alias("raw")))
    return counts.groupBy(*keys).agg(best.alias(kind), F.sum("n").alias("reference_count"))


def native_rollup(rows: DataFrame) -> DataFrame:
    """``library, import_kind, confidence, imports`` by their lower case: the spelling seen first, and all imports, distinct whatever the case.

    ``rows``: those three, ``name`` (an imported symbol, or null) and ``ordinal``.
    """
    keys = [F.lower(c).alias(f"k_{c}") for c in ("library", "import_kind", "confidence")]
    first = F.min_by(F.struct("library", "import_kind", "confidence"), "ordinal").alias("first")
    spelled = rows.where(F.trim("name") != "").groupBy(*keys, ci(F.trim("name")).alias("upper")).agg(F.min_by(F.trim("name"), "ordinal").alias("name"))
    names = spelled.groupBy("k_library", "k_import_kind", "k_confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("upper", "name"))), lambda x: x["name"]).alias("imports"))
    return (
        rows.groupBy(*keys).agg(first).join(names, ["k_library", "k_import_kind", "k_confidence"], "left")
        .select("first.*", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))
    )


def first_by(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The first row by ordinal of each key; the rest of it is kept, nothing is added up."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("row")).select(*keys, "row.*")


def distinct_names(rows: DataFrame, keys: list[str], name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Names of a key, distinct whatever the case, in the spelling that was first, sorted as upper case."""
    return rows.groupBy(*keys, ci(name).alias("upper")).agg(F.min_by(name, ordinal).alias(name)).orderBy(*keys, "upper").drop("upper")


def labelled_references(rows: DataFrame) -> DataFrame:
    """``source, target, label``: for each target, whatever its case, the label that sorts first as upper case."""
    return rows.groupBy("source", ci("target").alias("upper")).agg(
        F.min_by(F.struct("target", "label"), F.struct(ci("label").alias("ci"), "label", "target")).alias("r")
    ).select("source", "r.target", "r.label")


def without_taken(rows: DataFrame, taken: DataFrame, path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """Rows whose path, whatever the case, no row of taken has; of rows with one path the first."""
    rest = rows.join(taken.select(ci(path).alias("ci")).distinct(), ci(path) == F.col("ci"), "left_anti")
    first = Window.partitionBy(ci(path)).orderBy(ordinal)
    return rest.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
