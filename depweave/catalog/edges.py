"""Queries over observations, edges and the payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.catalog.sql import CYCLES, GRAPH, facts, node
from depweave.functions import ids
from depweave.operators import edges as E
from depweave.operators import graph as G
from depweave.operators import payload as P
from depweave.plans.staging import stage
from depweave.sources.workspace import Workspace


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return E.ordered(E.symbol_edges(w.observations, w.declared))


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return E.document_edges(w.observations, w.declared, samples=False)


def edge_first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return E.document_edges(w.observations, w.declared).select("source", "target", "sample_file", "sample_line", "sample_snippet")


def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    odd = F.substring("source_symbol_key", 2, 30).cast("long") % 2
    return E.document_edges(w.observations, w.declared, origin=1 - odd)


def dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return E.dominant_kinds(w.observations, w.declared)


def _native(w: Workspace) -> DataFrame:
    odd = F.col("p_partkey") % 2 == 1
    return w.table("part").select(
        F.when(odd, F.col("p_brand")).otherwise(F.lower("p_brand")).alias("library"), F.when(F.col("p_size") % 3 == 0, "LoadLibrary").otherwise("DllImport").alias("import_kind"),
        F.lit("high").alias("confidence"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("ordinal"),
    )


def native_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.native_rollup(_native(Workspace(spark, sf_dir)))
    return rows.select("library", "import_kind", "confidence", F.size("imports").cast("long").alias("n_imports"), F.array_join("imports", ", ").alias("imports"))


def payload_nodes(w: Workspace) -> DataFrame:
    """Nodes of projects, documents, symbols, packages and assemblies."""
    pk = ids.node_id("project", "project_key")
    return P.nodes(
        P.node_rows(w.projects, pk, "name", "project", "name"),
        P.node_rows(w.documents, F.col("document_id"), "name", "document", "document_id"),
        P.node_rows(w.symbols, F.col("symbol_id"), "name", "symbol", "symbol_id", F.col("kind")),
        P.node_rows(w.packages, ids.node_id("package", "name"), "name", "package", "project_key"),
        P.node_rows(w.assemblies, ids.node_id("assembly", "name"), "name", "assembly", "project_key"),
    )


def other_edges(w: Workspace) -> DataFrame:
    """Edges of the payload but those between documents."""
    pk = ids.node_id("project", "project_key")
    syms = E.symbol_edges(w.observations, w.declared)
    return P.edges(
        P.edge_rows(w.documents, pk, F.col("document_id"), "contains-document"),
        P.edge_rows(w.symbols, F.col("document_id"), F.col("symbol_id"), "contains-symbol"),
        P.edge_rows(w.packages, pk, ids.node_id("package", "name"), "project-package"),
        P.edge_rows(w.assemblies, pk, ids.node_id("assembly", "name"), "project-assembly"),
        P.edge_rows(w.project_references, ids.node_id("project", "source"), ids.node_id("project", "target"), "project-reference"),
        unique=[P.edge_rows(syms, F.col("source"), F.col("target"), ids.symbol_edge_kind("reference_kind"), F.col("reference_count"), "reference_kind", "confidence")],
    )


def of_documents(edges: DataFrame) -> DataFrame:
    """Edges between documents as edges of the payload; in them no identity repeats."""
    return P.edges(unique=[P.edge_rows(edges, F.col("source"), F.col("target"), "document-reference", F.col("reference_count"))])


def payload_edges(w: Workspace) -> DataFrame:
    return other_edges(w).unionByName(of_documents(E.document_edges(w.observations, w.declared, samples=False)))


def project_members(w: Workspace) -> DataFrame:
    """Members of project cycles, by the ids of their nodes."""
    found = G.components_of_cycles(w.project_references)
    return found.select(ids.node_id("project", "node").alias("node"), ids.node_id("project", "component").alias("component"))


def node_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    flag = project_members(w).select(F.col("node").alias("id")).distinct().withColumn("is_in_cycle", F.lit(True))
    rows = payload_nodes(w).join(flag, "id", "left")
    return rows.select("id", "label", F.col("group").alias("node_group"), "symbol_kind", F.coalesce("is_in_cycle", F.lit(False)).alias("is_in_cycle"))


def edge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    known = w.documents.select("document_id")
    docs = E.document_edges(P.among(w.observations, "source_document_id", known), P.among(w.declared, "document_id", known), samples=False)
    rows = P.between(other_edges(w), payload_nodes(w)).unionByName(of_documents(docs))
    return G.flag_cycles(rows, project_members(w)).select("id", "source", "target", "kind", "weight", "reference_kind", "confidence", "is_cycle_edge")


def payload_symbol_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    rows = w.symbols.join(w.documents.select("document_id", "project_key"), "document_id").withColumn("ordinal", F.struct("project_key", "document_id", "line", "symbol_id"))
    return P.capped_symbols(rows.select("symbol_id", "ordinal")).select("symbol_id", F.col("rank").cast("long").alias("rank"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    # Only documents that observe and declare are in cycles, so only edges between these are written down.
    ends = P.among(w.observations, "source_document_id", w.declared.select("document_id")), P.among(w.declared, "document_id", w.observations.select("source_document_id"))
    docs = stage(E.document_edges(*ends, samples=False).select("source", "target"), "documents")
    syms = stage(E.symbol_edges(w.observations, w.declared).select("source", "target"), "symbols")
    found = [G.cycles(edges, G.components_of_cycles(edges), kind) for kind, edges in (("project", w.project_references), ("document", docs), ("symbol", syms))]
    cycles = found[0].unionByName(found[1]).unionByName(found[2])
    every = E.document_edges(w.observations, w.declared, samples=False)
    return P.stats(w.projects, w.documents, w.symbols, E.native_rollup(_native(w)), every, syms, cycles, other_edges(w))


def phantom_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    regions = w.table("nation").join(w.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("name:"), "n_name").alias("source"), F.concat(F.lit("NAME:"), "r_name").alias("target"), F.col("r_name").alias("label"))
    others = w.project_references.select("source", F.lower("target").alias("target"), F.col("target").alias("label"))
    return P.referenced_projects(regions.unionByName(others), w.projects).select("source", "target", "node", "is_phantom")


def ids_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, sf_dir).table("part").select("p_partkey", ids.hash_token("p_name").alias("token"), ids.symbol_id("p_name", F.concat_ws("|", "p_brand", "p_type", "p_name")).alias("symbol_id"))


def ids_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, sf_dir).table("part").select(
        "p_partkey", ids.normalize(F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.col("p_type"))).alias("normalized"), ids.identifier_fragment(F.concat(F.lit("a.b_"), "p_name")).alias("fragment"),
        ids.document_id("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), "p_type").alias("document_id"), ids.node_id("package", "p_brand").alias("package"),
    )


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, sf_dir).table("benchmark").select("item_id", ids.snippet("text").alias("snippet"), ids.line_snippet("text", F.lit(2)).alias("second"), ids.line_snippet("text", F.lit(0)).alias("none"))


def project_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/src/"), "s_name", F.lit("/")))
    return Workspace(spark, sf_dir).table("supplier").select(k, ids.project_key(path, F.when(k % 3 == 1, F.col("s_name")), F.when(k % 2 == 0, F.col("s_name"))).alias("project_key"))


def qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat_ws("::", "p_brand", "p_type", "p_name")
    return Workspace(spark, sf_dir).table("part").select(
        "p_partkey", ids.simple_name(q).alias("simple"), ids.containing_scope(q).alias("scope"), ids.qualify("p_brand", q).alias("again"), ids.qualify("p_type", F.col("p_name")).alias("qualified"),
        F.array_join(ids.lookup_names(ids.containing_scope(q), F.lit("f")), ",").alias("probes"),
    )


_SAMPLED = "source, target, reference_count, sample_file, sample_line, sample_snippet"
_EDGE_SQL = """
deduped AS (SELECT source, target, kind, rk, cf, min(weight) AS weight FROM kind_edges WHERE source IN (SELECT id FROM all_nodes) AND target IN (SELECT id FROM all_nodes) GROUP BY ALL)
"""
_CYCLE_NODES = f"cyc AS (SELECT {node('project', 'node')} AS node, component FROM members)"

QUERIES = {f.__name__: f for f in (
    symbol_edges, document_edges, edge_first_sample, merge_edges, dominant_kind, native_rollup, node_payload, edge_payload, payload_symbol_cap, graph_stats, phantom_projects,
    ids_hash, ids_normalize, snippet, project_key, qualified_name,
)}

_NORM = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '_', 'g')) || '_' || substr(sha256({0}), 1, 8)"

ORACLES = {
    "symbol_edges": facts("SELECT source, target, reference_kind, confidence, reference_count, sample_file, sample_line, sample_snippet FROM sym_edges"),
    "document_edges": facts("SELECT source, target, reference_count FROM doc_edges"),
    "edge_first_sample": facts("SELECT source, target, sample_file, sample_line, sample_snippet FROM doc_edges"),
    "merge_edges": facts("""
        SELECT sdoc AS source, tdoc AS target, count(*) AS reference_count,
               coalesce(arg_min(file, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL AND CAST(substr(skey, 2) AS BIGINT) % 2 = 1), arg_min(file, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL)) AS sample_file,
               coalesce(arg_min(line, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL AND CAST(substr(skey, 2) AS BIGINT) % 2 = 1), arg_min(line, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL)) AS sample_line,
               coalesce(arg_min(snippet, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL AND CAST(substr(skey, 2) AS BIGINT) % 2 = 1), arg_min(snippet, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL)) AS sample_snippet
        FROM doc_pairs GROUP BY sdoc, tdoc"""),
    "dominant_kind": facts("""
        SELECT source, target, reference_kind, CAST(total AS BIGINT) AS reference_count FROM (
          SELECT sdoc AS source, document_id AS target, kind AS reference_kind, row_number() OVER (PARTITION BY sdoc, document_id ORDER BY count(*) DESC, upper(kind)) AS n, sum(count(*)) OVER (PARTITION BY sdoc, document_id) AS total
          FROM obs JOIN (SELECT DISTINCT symbol_key, document_id FROM decl) d ON symbol_key = tkey GROUP BY sdoc, document_id, kind) WHERE n = 1"""),
    "native_rollup": """
        WITH rows AS (
          SELECT CASE WHEN p_partkey % 2 = 1 THEN p_brand ELSE lower(p_brand) END AS library, CASE WHEN p_size % 3 = 0 THEN 'LoadLibrary' ELSE 'DllImport' END AS import_kind,
                 CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS o FROM part),
        names AS (SELECT lower(library) AS l, lower(import_kind) AS k, upper(trim(name)) AS u, arg_min(trim(name), o) AS name FROM rows WHERE trim(name) <> '' GROUP BY ALL),
        lists AS (SELECT l, k, count(*) AS n, string_agg(name, ', ' ORDER BY u) AS imports FROM names GROUP BY ALL),
        firsts AS (SELECT lower(library) AS l, lower(import_kind) AS k, arg_min(library, o) AS library, arg_min(import_kind, o) AS import_kind FROM rows GROUP BY ALL)
        SELECT library, import_kind, 'high' AS confidence, n AS n_imports, imports FROM firsts JOIN lists USING (l, k)""",
    "node_payload": facts("SELECT id, label, grp AS node_group, symbol_kind, id IN (SELECT node FROM cyc) AS is_in_cycle FROM all_nodes", GRAPH, CYCLES, _CYCLE_NODES, recursive=True),
    "edge_payload": facts("""
        SELECT CASE WHEN rk IS NULL THEN 'edge:' || kind || ':' || source || '->' || target ELSE 'edge:' || kind || ':' || rk || ':' || cf || ':' || source || '->' || target END AS id,
               source, target, kind, CAST(weight AS BIGINT) AS weight, rk AS reference_kind, cf AS confidence,
               EXISTS (SELECT 1 FROM cyc a JOIN cyc b USING (component) WHERE a.node = source AND b.node = target) AS is_cycle_edge
        FROM deduped""", GRAPH, CYCLES, _CYCLE_NODES, _EDGE_SQL, recursive=True),
    "payload_symbol_cap": facts("SELECT symbol_id, row_number() OVER (ORDER BY project_key, document_id, line, symbol_id) AS rank FROM syms JOIN docs USING (document_id) ORDER BY 2 LIMIT 3000"),
    "graph_stats": facts("""
        SELECT (SELECT count(*) FROM projects) AS project_count, (SELECT count(*) FROM docs) AS document_count, (SELECT count(*) FROM syms) AS symbol_count,
               (SELECT count(DISTINCT (lower(p_brand), p_size % 3 = 0)) FROM part) AS native_dependency_count, (SELECT count(*) FROM doc_edges) AS document_dependency_count,
               (SELECT count(*) FROM sym_edges) AS symbol_dependency_count, (SELECT count(DISTINCT component) FROM members) AS project_cycle_count,
               (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM doc_reach WHERE (b, a) IN (SELECT a, b FROM doc_reach) GROUP BY a)) AS document_cycle_count,
               (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM sym_reach WHERE (b, a) IN (SELECT a, b FROM sym_reach) GROUP BY a)) AS symbol_cycle_count,
               (SELECT count(*) FROM (SELECT DISTINCT source, target, kind, rk, cf FROM kind_edges)) AS edge_count""", GRAPH, CYCLES, *(f"""
        {k}_core AS (SELECT DISTINCT source AS a, target AS b FROM {k}_edges WHERE source IN (SELECT target FROM {k}_edges) AND target IN (SELECT source FROM {k}_edges)),
        {k}_reach AS (SELECT a, b FROM {k}_core UNION SELECT r.a, e.b FROM {k}_reach r JOIN {k}_core e ON r.b = e.a)""" for k in ("doc", "sym")), recursive=True),
    "phantom_projects": facts(f"""
        , given AS (SELECT 'name:' || n_name AS source, 'NAME:' || r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT source, lower(target) FROM refs)
        SELECT g.source, g.target, {node('project', 'coalesce(p.project_key, g.target)')} AS node, p.project_key IS NULL AS is_phantom FROM given g LEFT JOIN projects p ON upper(p.project_key) = upper(g.target)"""),
    "ids_hash": "SELECT p_partkey, substr(sha256(p_name), 1, 8) AS token, 'symbol:' || coalesce(nullif(lower(regexp_replace(regexp_replace(p_name, '[._]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')), ''), 'symbol') || '_' || substr(sha256(p_brand || '|' || p_type || '|' || p_name), 1, 8) AS symbol_id FROM part",
    "ids_normalize": f"""
        SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'empty_00000000' ELSE {_NORM.format('p_type')} END AS normalized,
               lower(regexp_replace(regexp_replace('a.b_' || p_name, '[._]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) AS fragment,
               'document:' || CASE WHEN p_partkey % 2 = 0 THEN {_NORM.format("(p_brand || '|' || p_name)")} ELSE {_NORM.format("(p_brand || '/' || p_type)")} END AS document_id,
               'package:' || {_NORM.format('p_brand')} AS package FROM part""",
    "snippet": """
        SELECT item_id, CASE WHEN length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) > 180 THEN substr(trim(text, chr(9) || chr(10) || chr(13) || ' '), 1, 177) || '...' ELSE nullif(trim(text, chr(9) || chr(10) || chr(13) || ' '), '') END AS snippet,
               CASE WHEN length(trim(string_split(text, chr(10))[2])) > 180 THEN substr(trim(string_split(text, chr(10))[2]), 1, 177) || '...' ELSE nullif(trim(string_split(text, chr(10))[2]), '') END AS second, CAST(NULL AS VARCHAR) AS none FROM benchmark""",
    "project_key": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '/src/' || s_name WHEN s_suppkey % 3 = 1 THEN 'id:' || s_name WHEN s_suppkey % 2 = 0 THEN 'name:' || s_name ELSE 'name:project' END AS project_key FROM supplier",
    "qualified_name": "SELECT p_partkey, p_name AS simple, p_brand || '::' || p_type AS scope, p_brand || '::' || p_type || '::' || p_name AS again, p_type || '::' || p_name AS qualified, p_brand || '::' || p_type || '::f,' || p_brand || '::f,f' AS probes FROM part",
}
