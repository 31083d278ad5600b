"""Queries over texts: snippets, tokens, C++ facts, project files, conditions, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.catalog.sql import facts
from depweave.functions import ids
from depweave.operators import resolve as S
from depweave.plans.staging import stage
from depweave.sources import cpp as C
from depweave.sources import projects as J
from depweave.sources.workspace import Workspace


def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Workspace(spark, sf_dir).table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return d.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), ids.snippet("raw").alias("snippet")).where("snippet is not null")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a page links to, distinct whatever the case, the first spelling."""
    p = Workspace(spark, sf_dir).table("pages").select("page_id", ids.import_list(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("names"))
    return p.select("page_id", F.size("names").cast("long").alias("n"), F.array_join("names", " ").alias("names"))


def reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by token of a document, in its prose as it stands."""
    d = Workspace(spark, sf_dir).table("documents")
    return C.facts(d, "references", "doc_id").groupBy("doc_id", "token", "reference_kind").agg(F.count("*").alias("n"))


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.stripped(Workspace(spark, sf_dir).table("documents"))
    return d.select("doc_id", F.length("code").cast("long").alias("n_code"), F.sha2("code", 256).alias("code_sha256"))


def sources(w: Workspace) -> DataFrame:
    """A C++ source for each supplier: a class whose methods stand for the parts that it delivers and call each other."""
    parts = w.table("lineitem").select("l_suppkey", "l_partkey").distinct()
    k, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    after = F.lead("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_partkey")).cast("string")
    call = F.when(after.isNotNull(), F.concat(F.lit("    a = m"), after, F.lit("(1) + 1; // next"))).otherwise(F.lit("    /* the last */ auto x = new S(2);"))
    method = F.concat(F.lit("  int m"), k, F.lit("(int a) {\n"), call, F.lit("\n  }"))
    rows = parts.select(s.alias("s"), "l_partkey", method.alias("method"))
    body = rows.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "method"))), lambda x: x["method"]), "\n").alias("body"))
    head = F.concat(F.lit('#include "base.h"\n#include <vector>\n#define S'), F.col("s"), F.lit(' 1\nh = LoadLibraryA("s'), F.col("s"), F.lit('.dll");\nGetProcAddress(h, "run");\nclass S : public Base\n{\n'))
    made = body.select(F.concat(F.lit("s"), "s").alias("document_id"), F.concat(head, "body", F.lit("\n};\n")).alias("text"))
    return made.repartition(2 * w.spark.sparkContext.defaultParallelism)  # small texts that take long to read


def stripped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stripped(sources(Workspace(spark, sf_dir))).select("document_id", "code")


def method_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the bodies of methods in the derived sources."""
    return C.facts(sources(Workspace(spark, sf_dir)), "ranges").drop("namespace_scope")


def cpp_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facts(sources(Workspace(spark, sf_dir)), "declarations").drop("namespace_scope")


def heads(w: Workspace) -> DataFrame:
    """C++ sources whose heads go over lines: a class for each supplier, derived from its nation and the parts that it delivers, a base on a line; and the parts, by brand, in a namespace."""
    parts = w.table("lineitem").select("l_suppkey", "l_partkey").distinct().join(w.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    k, s = F.col("l_partkey").cast("string"), F.col("s_suppkey").cast("string")
    bases = parts.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", F.concat(F.lit("  public "), brand, F.lit("::P"), k).alias("base")))).alias("bases"))
    nation = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    listed = F.array_join(F.transform("bases", lambda x: x["base"]), ",\n\n")
    lines = ["struct ", nation, " {};\nnamespace vendors {\n// derived\nclass S", s, "\n : public ", nation, ",\n", listed, "\n{\n  ", nation, " make(Other* other,", nation, "& more);\n};\n}\n"]
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    classes = w.table("supplier").join(bases, F.col("s_suppkey") == F.col("l_suppkey")).select(F.concat(F.lit("s"), s).alias("document_id"), text.alias("text"))
    each = w.table("part").select(brand.alias("brand"), "p_partkey", F.concat(F.lit("union P"), F.col("p_partkey").cast("string"), F.lit(" : Other {};")).alias("line"))
    body = each.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    brands = body.select(F.concat(F.lit("b"), "brand").alias("document_id"), F.concat(F.lit("class Other;\nnamespace "), "brand", F.lit("\n{\n"), "body", F.lit("\n}\n")).alias("text"))
    return classes.unionByName(brands)


def declaration_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heads of declarations refer to, resolved by scope: bases behind a colon, on whichever line of the head, are inheritance."""
    code = stage(C.marked(C.lines(heads(Workspace(spark, sf_dir)))), "lines")
    declared = C.declarations(code, "document_id").withColumn("key", F.concat_ws("|", "document_id", "qualified_name"))
    refs = C.declaration_references(code, "document_id").select(
        F.concat_ws(":", "document_id", "line", "qualified_name", "token").alias("ref_id"), "token", ids.containing_scope("qualified_name").alias("scope"), "namespace_scope", F.col("document_id").alias("ref_document"),
        F.col("line").alias("ref_line"), F.concat_ws("|", "document_id", "qualified_name").alias("ref_key"), "reference_kind",
    )
    found = S.resolve_scoped(refs.drop("reference_kind").distinct(), declared.select("key", "qualified_name", "document_id", "line", "is_definition"))
    both = refs.join(found.select("ref_id", F.col("key").alias("target")), "ref_id").where("ref_key <> target")
    return both.groupBy(F.col("ref_key").alias("source"), "target", "reference_kind").agg(F.count("*").alias("reference_count"))


def include_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facts(sources(Workspace(spark, sf_dir)), "includes").select("document_id", F.col("line").cast("long").alias("line"), "target", "quoted", "snippet")


def cpp_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that methods of the derived sources refer to: tokens, put in the range around them, resolved by scope."""
    code = stage(C.marked(C.lines(sources(Workspace(spark, sf_dir)))), "lines")
    declared = C.declarations(code, "document_id").withColumn("key", F.concat_ws("|", "document_id", "qualified_name"))
    refs = C.references(code, "document_id").withColumn("ref_id", F.concat_ws(":", "document_id", "line", "token"))
    ranges = C.ranges(code, "document_id").withColumnRenamed("qualified_name", "symbol_id")
    inside = S.enclosing_ranges(refs.select("ref_id", "document_id", "line").distinct(), ranges)
    spaces = declared.select(F.col("document_id").alias("d"), F.col("qualified_name").alias("q"), "namespace_scope").distinct()
    inside = inside.join(spaces, (F.col("document_id") == F.col("d")) & (F.col("symbol_id") == F.col("q")))
    named = refs.select("ref_id", "token", "reference_kind").distinct().join(inside, "ref_id").select(
        "ref_id", "token", ids.containing_scope("symbol_id").alias("scope"), "namespace_scope", F.col("document_id").alias("ref_document"), F.col("line").alias("ref_line"), F.concat_ws("|", "document_id", "symbol_id").alias("ref_key"), "reference_kind",
    )
    found = S.resolve_scoped(named, declared.select("key", "qualified_name", "document_id", "line", "is_definition"))
    return named.join(found.select("ref_id", F.col("key").alias("target")), "ref_id").groupBy(F.col("ref_key").alias("source"), "target", "reference_kind").agg(F.count("*").alias("reference_count"))


def native_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that the derived sources ask for, with the library that their handle was set to."""
    found = C.facts(sources(Workspace(spark, sf_dir)), "native")
    calls = found.where("api = 'GetProcAddress'").withColumn("call_id", F.concat_ws(":", "document_id", "line", "name"))
    loads = found.where("api = 'LoadLibrary' and handle is not null").withColumnRenamed("name", "library")
    return S.handle_libraries(calls.select("call_id", "document_id", "line", "handle"), loads.select("document_id", "handle", "line", "library")).select("call_id", "document_id", "library")


def package_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package references of a project file for each supplier's nation, as the packages of the workspace make it."""
    w = Workspace(spark, sf_dir)
    line = F.concat(F.lit('<PackageReference Include="'), "name", F.lit('" Version="'), F.length("name").cast("string"), F.lit('" />'))
    files = w.packages.groupBy("project_key").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return J.package_references(files, "project_key")


def msbuild_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose properties meet a condition."""
    c = Workspace(spark, sf_dir).table("customer")
    rows = c.select("c_custkey", F.create_map(F.lit("Segment"), F.col("c_mktsegment"), F.lit("Nation"), F.col("c_nationkey").cast("string")).alias("properties"), F.lit("'$(segment)' == 'building' And ($(Nation) >= 10 Or '$(Missing)' != '')").alias("condition"))
    return J.conditions(rows).select("c_custkey", "active")


def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that a project reaches through its references, as files that import files."""
    w = Workspace(spark, sf_dir)
    return J.import_closure(w.projects.select(F.col("name").alias("project"), F.col("project_key").alias("file")), w.project_references.select(F.col("source").alias("file"), "target")).select("project", "file", F.col("hops").cast("long").alias("hops"))


QUERIES = {f.__name__: f for f in (
    line_snippets, page_links, reference_tokens, strip_comments, stripped_sources, method_ranges, cpp_declarations, declaration_references, include_directives, cpp_references, native_libraries, package_refs, msbuild_conditions, import_closure,
)}

_TRIM = "trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"

#: The derived sources in SQL: the methods of each with their place, and the one after.
_METHODS = """
WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem),
m AS (SELECT 's' || s AS document_id, s, k, row_number() OVER (PARTITION BY s ORDER BY k) AS i, lead(k) OVER (PARTITION BY s ORDER BY k) AS after FROM p),
h AS (SELECT DISTINCT document_id, s FROM m)"""

ORACLES = {
    "stripped_sources": _METHODS + """,
        b AS (SELECT document_id, string_agg('  int m' || k || '(int a) {' || chr(10) || CASE WHEN after IS NULL THEN '     auto x = new S(2);' ELSE '    a = m' || after || '(1) + 1; ' END || chr(10) || '  }', chr(10) ORDER BY k) AS body FROM m GROUP BY document_id)
        SELECT document_id, '#include ' || repeat(' ', 8) || chr(10) || '#include <vector>' || chr(10) || '#define S' || s || ' 1' || chr(10) || 'h = LoadLibraryA(' || repeat(' ', 7 + length(CAST(s AS VARCHAR))) || ');' || chr(10)
               || 'GetProcAddress(h, ' || repeat(' ', 5) || ');' || chr(10) || 'class S : public Base' || chr(10) || '{' || chr(10) || body || chr(10) || '};' || chr(10) AS code FROM h JOIN b USING (document_id)""",
    "method_ranges": _METHODS + """
        SELECT document_id, 'S::m' || k AS qualified_name, CAST(5 + 3 * i AS INTEGER) AS start, CAST(7 + 3 * i AS INTEGER) AS end, CAST(i - 1 AS INTEGER) AS idx FROM m""",
    "cpp_declarations": _METHODS + """
        SELECT document_id, 'MacroDefinition' AS kind, 'S' || s AS name, 'S' || s AS qualified_name, 3 AS line, false AS is_definition FROM h
        UNION ALL SELECT document_id, 'FunctionDeclaration', 'GetProcAddress', 'GetProcAddress', 5, false FROM h
        UNION ALL SELECT document_id, 'ClassDeclaration', 'S', 'S', 6, false FROM h
        UNION ALL SELECT document_id, 'MethodDeclaration', 'm' || k, 'S::m' || k, CAST(5 + 3 * i AS INTEGER), true FROM m""",
    "cpp_references": _METHODS + """
        SELECT document_id || '|S::m' || k AS source, document_id || CASE WHEN after IS NULL THEN '|S' ELSE '|S::m' || after END AS target,
               CASE WHEN after IS NULL THEN 'creation' ELSE 'call' END AS reference_kind, CAST(1 AS BIGINT) AS reference_count FROM m""",
    "declaration_references": """
        WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem), b AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY k) AS i FROM d),
        v AS (SELECT 's' || s_suppkey || '|vendors::S' || s_suppkey AS me, 's' || s_suppkey || '|N' || s_nationkey AS base, s_suppkey AS s FROM supplier WHERE s_suppkey IN (SELECT s FROM d)),
        o AS (SELECT min('b' || replace(p_brand, '#', '_')) AS first FROM part)
        SELECT me AS source, base AS target, 'inheritance' AS reference_kind, CAST(1 AS BIGINT) AS reference_count FROM v
        -- The head's lines: S, its nation, then a base on every other line.
        UNION ALL SELECT me, 'b' || replace(p_brand, '#', '_') || '|' || replace(p_brand, '#', '_') || '::P' || k, 'inheritance', 1 FROM b JOIN v USING (s) JOIN part ON p_partkey = k WHERE 2 * i <= 7
        UNION ALL SELECT me || '::make', base, 'reference', 2 FROM v
        UNION ALL SELECT me || '::make', first || '|Other', 'reference', 1 FROM v, o
        UNION ALL SELECT 'b' || replace(p_brand, '#', '_') || '|' || replace(p_brand, '#', '_') || '::P' || p_partkey, 'b' || replace(p_brand, '#', '_') || '|Other', 'reference', 1 FROM part""",
    "line_snippets": f"""
        SELECT doc_id, line, CASE WHEN length({_TRIM}) > 180 THEN substr({_TRIM}, 1, 177) || '...' ELSE {_TRIM} END AS snippet
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) WHERE {_TRIM} <> ''""",
    "page_links": """
        WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS i FROM pages),
        d AS (SELECT page_id, upper(trim(name)) AS u, arg_min(trim(name), i) AS name FROM a WHERE trim(name) <> '' GROUP BY ALL)
        SELECT p.page_id, count(d.u) AS n, coalesce(string_agg(name, ' ' ORDER BY u), '') AS names FROM pages p LEFT JOIN d USING (page_id) GROUP BY p.page_id""",
    "include_directives": """
        SELECT 's' || k AS document_id, line, target, quoted, snippet FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem)
        CROSS JOIN (VALUES (CAST(1 AS BIGINT), 'base.h', true, '#include "base.h"'), (2, 'vector', false, '#include <vector>')) v(line, target, quoted, snippet)""",
    "native_libraries": "SELECT 's' || k || ':5:run' AS call_id, 's' || k AS document_id, 's' || k || '.dll' AS library FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem)",
    "package_refs": facts("SELECT DISTINCT project_key, brand || ' (' || length(brand) || ')' AS package FROM ext"),
    "msbuild_conditions": "SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey >= 10 AS active FROM customer",
    "import_closure": facts("""
        , r AS (SELECT name AS project, project_key AS file, 0 AS hops FROM projects UNION SELECT r.project, refs.target, hops + 1 FROM r JOIN refs ON refs.source = r.file WHERE hops < 30)
        SELECT project, file, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY ALL""", recursive=True),
}
