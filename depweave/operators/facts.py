"""Row rules and dedupes over extracted facts: candidates, native imports, labels, view state, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.columns import blank_to_null, ci
from depweave.functions.ids import symbol_key
from depweave.plans.numbering import numbered
from depweave.plans.staging import stage, unstage

#: Kinds of symbols that a dependency may lead to.
CANDIDATES = ("type", "method", "property", "field", "event")

#: Attributes that import a native function, and how each imports it.
NATIVE_ATTRIBUTES = {
    "System.Runtime.InteropServices.DllImportAttribute": "DllImport",
    "System.Runtime.InteropServices.LibraryImportAttribute": "LibraryImport",
}

#: English names of kinds of symbols.
KIND_LABELS = {
    "ClassDeclaration": "Class", "StructDeclaration": "Struct", "InterfaceDeclaration": "Interface", "EnumDeclaration": "Enum", "UnionDeclaration": "Union",
    "RecordDeclaration": "Record", "MethodDeclaration": "Method", "FunctionDeclaration": "Function", "ConstructorDeclaration": "Constructor",
    "PropertyDeclaration": "Property", "IndexerDeclaration": "Indexer", "FieldDeclaration": "Field", "EventDeclaration": "Event", "DelegateDeclaration": "Delegate",
    "TypeAliasDeclaration": "Type Alias", "MacroDefinition": "Macro", "MacroDefinitions": "Macro",
}


def candidates(symbols: DataFrame) -> DataFrame:
    """Symbols (``kind, is_implicit``) that a dependency may lead to: written out, and a type or a member of one."""
    return symbols.where(~F.coalesce(F.col("is_implicit"), F.lit(False)) & F.col("kind").isin(*CANDIDATES))


def kind_label(kind: Column, labels: dict[str, str] | None = None) -> Column:
    """The label of a kind; a kind without one is its own label."""
    table = F.create_map(*(F.lit(x) for pair in (labels or KIND_LABELS).items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), kind)


def messages(asked: DataFrame, texts: DataFrame, locale: str, fallback: str = "ja") -> DataFrame:
    """asked (``key, args``) with ``message``: the text of the key in the locale, else in the fallback, else the key.

    ``texts``: ``locale, key, text``, one row for each. ``{0}`` stands for the first argument;
    without arguments a text is left as it is, and a place without its argument too.
    """
    of = lambda name, out: texts.where(F.col("locale") == name).select("key", F.col("text").alias(out))
    found = asked.join(of(locale, "_t"), "key", "left").join(of(fallback, "_f"), "key", "left").withColumn("_m", F.coalesce("_t", "_f", "key"))
    place = lambda x: F.try_to_number(F.regexp_extract(x, r"^\{(\d{1,9})\}$", 1), F.lit("999999999")).cast("int")
    tokens = F.regexp_extract_all("_m", F.lit(r"(\{\d+\}|[^{]+|\{)"), F.lit(1))
    filled = F.array_join(F.transform(tokens, lambda x: F.coalesce(F.get("args", place(x)), x)), "")
    return found.withColumn("message", F.when(F.coalesce(F.size("args"), F.lit(0)) > 0, filled).otherwise(F.col("_m"))).drop("_t", "_f", "_m")


def native_imports(attributes: DataFrame, declared: DataFrame) -> DataFrame:
    """``document_id, library, import_kind, symbol_id, imported``: what attributes import, with the symbol that carries them where it is declared there.

    ``attributes``: ``document_id, attribute, library, symbol_key, symbol_name, entry_point``; ``declared``:
    ``document_id, symbol_key, symbol_id``, one row for a key of a document. Other attributes and blank libraries drop out.
    """
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in NATIVE_ATTRIBUTES.items() for x in pair)), F.col("attribute"))
    rows = attributes.withColumns({"import_kind": kind, "library": F.trim("library")}).where("import_kind is not null and library <> ''")
    imported = F.coalesce(blank_to_null(F.col("entry_point")), F.col("symbol_name")).alias("imported")
    return rows.join(declared, ["document_id", "symbol_key"], "left").select("document_id", "library", "import_kind", "symbol_id", imported)


def _first(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key; in keys a null is an empty text."""
    named = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    return rows.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*rows.columns), ordinal).alias("r")).select("r.*")


def distinct_references(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """References of a document (``source_usr, target_usr, target, line, kind``), the first of those that are equal in all."""
    return _first(rows, ["document_id", "source_usr", "target_usr", "target", "line", "kind"], ordinal)


def distinct_symbols(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Declared symbols of a document, the first of those with one ``line, kind, display_name, usr``."""
    return _first(rows, ["document_id", "line", "kind", "display_name", "usr"], ordinal)


def pinned(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Pinned nodes (``node_id, x, y``) of each key: ids trimmed, blank ids and places that are not finite dropped, the last of an id kept."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.withColumn("node_id", F.trim("node_id")).where((F.col("node_id") != "") & finite("x") & finite("y"))
    return good.groupBy(*keys, "node_id").agg(F.max_by(F.struct("x", "y"), ordinal).alias("p")).select(*keys, "node_id", "p.x", "p.y")


def hidden(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Hidden nodes (``node_id, label, group``) of each key: trimmed, blank ids dropped, a blank label is the id, a blank group is empty, the last of an id kept."""
    good = rows.withColumn("node_id", F.trim("node_id")).where("node_id <> ''").withColumns(
        {"label": F.coalesce(F.trim(blank_to_null(F.col("label"))), F.col("node_id")), "group": F.coalesce(F.trim(blank_to_null(F.col("group"))), F.lit(""))}
    )
    return good.groupBy(*keys, "node_id").agg(F.max_by(F.struct("label", "group"), ordinal).alias("p")).select(*keys, "node_id", "p.label", "p.group")


def cpp_symbol_key(project: Column, path: Column, line: Column, kind: Column, display: Column) -> Column:
    return symbol_key(F.lit("cpp"), project, path, line, kind, display)


def managed_symbol_key(assembly: Column, kind: Column, display: Column) -> Column:
    return symbol_key(assembly, kind, display)


def discovered(seeds: DataFrame, includes: DataFrame, files: DataFrame, cap: int = 50_000) -> DataFrame:
    """``path, round, over``: documents to parse, the seeds first, then round by round what those before include.

    ``includes``: ``source, target`` paths. Of the targets those go on that ``files`` (``path``: C++
    files below the root) has. The first ``cap`` by round and path are parsed; ``over`` tells whether there are more.
    Two paths are one whatever their case. Each round is a join of the new front with the includes.
    """
    known = stage(files.groupBy(ci("path").alias("k")).agg(F.min("path").alias("path")), "files")
    links = stage(
        includes.select(ci("source").alias("a"), ci("target").alias("b")).where("a <> b").distinct().join(known.select(F.col("k").alias("b")), "b", "left_semi"), "links"
    )
    seen = stage(seeds.select(ci("path").alias("k")).distinct().join(known, "k", "left_semi").withColumn("round", F.lit(0)), "seen")
    front, n = seen, 0
    while front.limit(1).count():
        n += 1
        new = front.select(F.col("k").alias("a")).join(links, "a").select(F.col("b").alias("k")).distinct().join(seen.select("k"), "k", "left_anti")
        front = stage(new.withColumn("round", F.lit(n)), "front")
        seen = seen.unionByName(front)
        if n % 8 == 0:
            seen = stage(seen, "seen")  # one table again, so that a round does not read one for each round before
    placed = numbered(seen.join(known, "k"), ["round", "k"], "_n")
    over = placed.where(F.col("_n") > cap).limit(1).count() > 0
    unstage(links)
    return placed.where(F.col("_n") <= cap).select("path", "round", F.lit(over).alias("over"))
