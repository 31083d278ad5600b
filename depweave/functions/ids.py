"""Identities and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depweave.functions.columns import ColumnOrName, blank_to_null, ci, col

#: Names of directories that are never walked.
IGNORED = (
    ".git", ".nuget", ".vs", "arm64", "bin", "debug", "external", "externals", "node_modules", "obj", "packages", "release",
    "third-party", "third_party", "vendor", "vendors", "x64", "x86",
)


def hash_token(x: ColumnOrName) -> Column:
    """The first 8 hexadecimal digits of the SHA-256 of the text."""
    return F.substring(F.sha2(col(x), 256), 1, 8)


def _clean(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "_"))


def normalize(x: ColumnOrName) -> Column:
    """Letters and digits in lower case, all else ``_``, with the hash; blank or null is ``empty_00000000``."""
    x = col(x)
    return F.when(blank_to_null(x).isNull(), F.lit("empty_00000000")).otherwise(F.concat(_clean(x), F.lit("_"), hash_token(x)))


def identifier_fragment(x: ColumnOrName) -> Column:
    """Letters and digits in lower case, ``_`` and ``.`` as ``_``, the rest dropped; nothing left is ``symbol``."""
    kept = F.regexp_replace(F.regexp_replace(col(x), r"[._]", "_"), r"[^\p{L}\p{Nd}_]", "")
    return F.coalesce(F.nullif(F.lower(kept), F.lit("")), F.lit("symbol"))


def document_id(project: ColumnOrName, file_path: ColumnOrName, name: ColumnOrName) -> Column:
    path = blank_to_null(col(file_path))
    return F.concat(F.lit("document:"), normalize(F.when(path.isNotNull(), F.concat(col(project), F.lit("|"), path)).otherwise(F.concat(col(project), F.lit("/"), col(name)))))


def symbol_id(name: ColumnOrName, key: ColumnOrName) -> Column:
    return F.concat(F.lit("symbol:"), identifier_fragment(name), F.lit("_"), hash_token(key))


def node_id(prefix: str, identity: ColumnOrName) -> Column:
    """``prefix:norm_hash`` of the untrimmed text; blank is ``empty`` with its real hash."""
    x = F.coalesce(col(identity), F.lit(""))
    return F.concat(F.lit(f"{prefix}:"), _identity(x), F.lit("_"), hash_token(x))


def _identity(x: Column) -> Column:
    return F.when(F.trim(x) == "", F.lit("empty")).otherwise(_clean(x))


def edge_id(kind: ColumnOrName, source: ColumnOrName, target: ColumnOrName, reference_kind: ColumnOrName, confidence: ColumnOrName) -> Column:
    """``edge:kind:s->t``; where kind of reference or confidence is not blank, both stand before the ends, null as ``none``."""
    r, c = col(reference_kind), col(confidence)
    ends = F.concat(col(source), F.lit("->"), col(target))
    plain = blank_to_null(r).isNull() & blank_to_null(c).isNull()
    part = lambda x: _identity(F.coalesce(x, F.lit("none")))
    return F.when(plain, F.concat(F.lit("edge:"), col(kind), F.lit(":"), ends)).otherwise(F.concat(F.lit("edge:"), col(kind), F.lit(":"), part(r), F.lit(":"), part(c), F.lit(":"), ends))


def project_key(path: ColumnOrName, fallback: ColumnOrName, name: ColumnOrName, windows: bool = False) -> Column:
    """The path without a trailing separator, else ``id:`` and the fallback, else ``name:`` and the name, else ``name:project``."""
    p = F.regexp_replace(blank_to_null(col(path)), r"(?<=.)[/\\]+$", "")
    p = F.upper(p) if windows else p
    return F.coalesce(p, F.concat(F.lit("id:"), F.trim(blank_to_null(col(fallback)))), F.concat(F.lit("name:"), F.trim(blank_to_null(col(name)))), F.lit("name:project"))


def symbol_key(*parts: ColumnOrName) -> Column:
    """The parts of a symbol's identity joined by ``|``."""
    return F.concat_ws("|", *(col(p).cast("string") for p in parts))


def ignored_directory(name: ColumnOrName) -> Column:
    """Whether a directory of that name is never walked; blank is not."""
    x = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    return x.isin(*IGNORED) | F.startswith(x, F.lit("cmake-build"))


def snippet(x: ColumnOrName, longest: int = 180) -> Column:
    """Trimmed text; blank is null; more than ``longest`` characters end in three dots."""
    t = blank_to_null(F.regexp_replace(col(x), r"^\s+|\s+$", ""))
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def line_snippet(text: ColumnOrName, line: ColumnOrName) -> Column:
    """The snippet of a line, numbered from 1; null outside the text."""
    lines = F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n")
    n = col(line).cast("int")
    return F.when((n >= 1) & (n <= F.size(lines)), snippet(F.try_element_at(lines, F.greatest(n, F.lit(1)))))


def normalized_path(x: ColumnOrName, windows: bool = False) -> Column:
    """Trimmed, without trailing separators unless it is the root; blank is empty."""
    p = F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), r"(?<=.)[/\\]+$", "")
    return F.upper(p) if windows else p


def display_file_name(path: ColumnOrName, label: ColumnOrName) -> Column:
    """The last part of a path, else the label."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(col(path), F.lit("")), r"([^/\\]+)$", 1), F.lit("")), col(label))


def reference_kind(x: ColumnOrName) -> Column:
    return F.coalesce(F.lower(blank_to_null(F.trim(col(x)))), F.lit("reference"))


def confidence(x: ColumnOrName) -> Column:
    return F.coalesce(F.lower(blank_to_null(F.trim(col(x)))), F.lit("high"))


def symbol_edge_kind(kind: ColumnOrName) -> Column:
    """The kind of edge of a reference: one for each of four kinds, ``symbol-reference`` for the rest."""
    k = col(kind)
    return F.when(k.isin("call", "inheritance", "implementation", "creation"), F.concat(F.lit("symbol-"), k)).otherwise(F.lit("symbol-reference"))


def import_list(names: ColumnOrName) -> Column:
    """Distinct names whatever the case, the first spelling, sorted as upper case."""
    keyed = F.transform(F.filter(col(names), lambda x: F.trim(x) != ""), lambda x, i: F.struct(ci(F.trim(x)).alias("k"), i.alias("i"), F.trim(x).alias("name")))
    ordered = F.array_sort(keyed)
    return F.transform(F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["k"] != x["k"])), lambda x: x["name"])


def parse_imports(text: ColumnOrName) -> Column:
    """Names from a text with commas between them."""
    return import_list(F.split(F.coalesce(col(text), F.lit("")), ","))


def native_label(library: ColumnOrName, import_kind: ColumnOrName, imports: ColumnOrName, shown: int = 2) -> Column:
    """The library, and in brackets how it is loaded, its first imports and how many more there are."""
    names = col(imports)
    more = F.size(names) - shown
    listed = F.array_join(F.slice(names, 1, shown), ", ")
    tail = F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(F.size(names) > 0, F.concat(col(library), F.lit(" ["), col(import_kind), F.lit(": "), listed, tail, F.lit("]"))).otherwise(col(library))


def reference_label(key: ColumnOrName, stored: ColumnOrName) -> Column:
    """The stored name, else the key without its prefix, else the stem of the file that the key is."""
    k = col(key)
    stem = F.regexp_replace(F.regexp_extract(k, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(
        blank_to_null(col(stored)), F.when(F.rlike(k, F.lit("^(name|id):")), F.regexp_replace(k, "^(name|id):", "")), F.nullif(stem, F.lit("")), k
    )


def simple_name(qualified: ColumnOrName) -> Column:
    """What follows the last ``::``."""
    return F.substring_index(col(qualified), "::", -1)


def containing_scope(qualified: ColumnOrName) -> Column:
    """What stands before the last ``::``; empty if there is none."""
    return F.regexp_extract(col(qualified), r"(?s)^(.*)::", 1)


def qualify(scope: ColumnOrName, name: ColumnOrName) -> Column:
    """The name within its scope, which is not put in front twice."""
    s, n = F.coalesce(col(scope), F.lit("")), col(name)
    return F.when((s == "") | F.startswith(n, F.concat(s, F.lit("::"))), n).otherwise(F.concat(s, F.lit("::"), n))


def lookup_names(scope: ColumnOrName, name: ColumnOrName) -> Column:
    """The name in each scope from the innermost out, then bare."""
    parts = F.filter(F.split(F.coalesce(col(scope), F.lit("")), "::"), lambda x: x != "")
    depths = F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(depths, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "::"), F.lit("::"), col(name)))
    return F.concat(prefixes, F.array(col(name)))
