"""Queries of views, windows, resolution joins and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.catalog.edges import of_documents, other_edges, payload_nodes, project_members
from depweave.catalog.graphs import upper_graph
from depweave.catalog.sql import CYCLES, GRAPH, facts, node
from depweave.functions import ids
from depweave.operators import layout as L
from depweave.operators import ranked as K
from depweave.operators import resolve as S
from depweave.operators import view as V
from depweave.operators.components import connected_components
from depweave.plans.staging import stage
from depweave.sources.workspace import Workspace

_VIEW = V.View(symbols=True, assemblies=False, hidden_kinds=frozenset({"1-URGENT"}))


def _shown(w: Workspace) -> DataFrame:
    hidden = w.documents.where(F.col("document_id").endswith("7")).select(F.col("document_id").alias("id"))
    return V.visible_nodes(payload_nodes(w), _VIEW, hidden)


def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(Workspace(spark, sf_dir)).select("id", "label", F.col("group").alias("node_group"))


def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    shown = stage(_shown(w).select("id", "group"), "shown")
    docs = V.visible_document_edges(w.observations, w.declared, shown.where("group = 'document'").select("id"), _VIEW)
    return V.visible_edges(other_edges(w), shown.select("id"), _VIEW).unionByName(of_documents(docs)).select("source", "target", "kind", "reference_kind", "confidence", "weight")


def cycles_only_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    flag = project_members(w).select(F.col("node").alias("id")).distinct().withColumn("is_in_cycle", F.lit(True))
    rows = payload_nodes(w).join(flag, "id", "left").withColumn("is_in_cycle", F.coalesce("is_in_cycle", F.lit(False)))
    return V.visible_nodes(rows, V.View(cycles_only=True)).select("id", "label")


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    docs = w.documents.select("document_id", F.col("name").alias("document_name"), F.col("project_key").alias("project_name"))
    rows = w.symbols.join(docs, "document_id").withColumns({"display_name": F.concat("name", F.lit("()")), "kind_label": F.col("kind")})
    return V.symbol_search(rows, " nation_1 ").select("symbol_id", "name", "project_name")


def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    items = w.documents.select("project_key", F.lit("files").alias("section"), F.col("name").alias("label")).unionByName(w.packages.select("project_key", F.lit("packages").alias("section"), F.col("name").alias("label")))
    return V.tree_filter(items, w.projects.withColumn("language", F.lit("C#")), "nation_2")


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.graph_search(payload_nodes(Workspace(spark, sf_dir)), " Order1 ").select("id", "label")


def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.symbol_kinds(payload_nodes(Workspace(spark, sf_dir)))


def _snapshots(w: Workspace) -> DataFrame:
    return w.table("events").select(F.col("user_id").alias("workspace"), F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("kind"))


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latest(_snapshots(Workspace(spark, sf_dir)))


def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.retained(_snapshots(Workspace(spark, sf_dir)))


def snapshot_header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    docs = w.documents.groupBy("project_key").agg(F.count("*").alias("document_count"))
    syms = w.symbols.join(w.documents.select("document_id", "project_key"), "document_id").groupBy("project_key").agg(F.count("*").alias("symbol_count"))
    return docs.join(syms, "project_key", "left").select("project_key", "document_count", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"))


def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.without_repeats(Workspace(spark, sf_dir).table("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.without_repeats(Workspace(spark, sf_dir).table("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return K.last_states(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def section_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.capped_sections(Workspace(spark, sf_dir).assemblies, ["project_key"], ["name"]).select("project_key", "name", F.col("omitted").cast("long").alias("omitted"))


def top_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Workspace(spark, sf_dir).table("lineitem")  # noqa: E741
    rows = l.groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.count("*").alias("weight"))
    rows = rows.select("l_suppkey", F.col("l_partkey").alias("peer"), F.struct("ordinal", "l_partkey").alias("ordinal"), F.concat(F.lit("p"), "l_partkey").alias("label"), "weight")
    return K.top_peers(rows, ["l_suppkey"]).select("l_suppkey", "peer", F.col("rank").cast("long").alias("rank"), "text")


def last_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.last_rows(Workspace(spark, sf_dir).table("events").select("event_id", "event_type"), "event_id")


def recent_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Workspace(spark, sf_dir).table("events")
    spelled = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/Home/u"), "user_id")).otherwise(F.concat(F.lit("/home/u"), "user_id"))
    return K.recents(e.select(spelled.alias("path"), F.struct("ts", "event_id").alias("at"))).select("path", F.col("at.event_id").alias("event_id"))


def enclosing_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    first = w.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("document_id"))
    ranges = w.table("part").join(first, F.col("p_partkey") == F.col("l_partkey")).select("document_id", F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 500).alias("start"), (F.col("p_partkey") % 500 + F.col("p_size")).alias("end"), F.col("p_partkey").alias("idx"))
    refs = w.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("l_suppkey").alias("document_id"), (F.col("l_orderkey") % 550).alias("line"))
    return S.enclosing_ranges(refs, ranges)


def asof_handle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Workspace(spark, sf_dir).table("lineitem")  # noqa: E741
    handle = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("h")).otherwise(F.lit("H")), (F.col("l_partkey") % 5).cast("string"))
    loads = l.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("document_id"), F.upper(handle).alias("handle"), F.col("l_orderkey").alias("line")).agg(F.max("l_partkey").alias("library"))
    calls = l.where("l_returnflag = 'A'").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("call_id"), F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("line"), handle.alias("handle"))
    return S.handle_libraries(calls, loads)


def _named(w: Workspace) -> DataFrame:
    first = w.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    return w.table("part").join(first, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("key"), F.concat_ws("::", "p_brand", "p_type", F.concat(F.lit("f"), F.col("p_partkey") % 97)).alias("qualified_name"),
        F.concat(F.lit("s"), "s").alias("document_id"), (F.col("p_partkey") % 500).alias("line"), (F.col("p_partkey") % 2 == 1).alias("is_definition"), "p_brand", "p_type",
    )


def scoped_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(Workspace(spark, sf_dir))
    token = F.concat(F.lit("f"), F.col("key") % 89)
    refs = named.select(
        F.col("key").alias("ref_id"), F.when(F.col("key") % 3 == 0, F.concat_ws("::", F.col("p_type"), token)).otherwise(token).alias("token"), F.concat_ws("::", "p_brand", "p_type").alias("scope"), F.col("p_brand").alias("namespace_scope"),
        F.col("document_id").alias("ref_document"), F.lit(250).cast("long").alias("ref_line"), F.col("key").alias("ref_key"),
    )
    return S.resolve_scoped(refs, named.select("key", "qualified_name", "document_id", "line", "is_definition")).select("ref_id", F.col("probe").cast("long").alias("probe"), "key")


def preferred_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    o = w.table("orders").select("o_orderkey", F.concat(F.lit("s"), F.col("o_custkey") % 100).alias("ref_document"), (F.col("o_orderkey") % 300).alias("ref_line"), (F.col("o_orderkey") % 2000).alias("ref_key"))
    c = w.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("key"), F.concat(F.lit("s"), "l_suppkey").alias("document_id"), (F.col("l_partkey") % 500).alias("line"), (F.col("l_linenumber") % 2 == 1).alias("is_definition"))
    return S.preferred(c.join(o, F.col("l_orderkey") == F.col("o_orderkey")), ["o_orderkey"]).select("o_orderkey", F.col("tier").cast("long").alias("tier"), "key", "document_id", "line")


def include_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("f"), (k % 50).cast("string"), F.lit(".h"))
    includes = w.table("orders").select(k.alias("include_id"), text("p", c % 10).alias("project"), text("/d", c % 40).alias("own_directory"), F.when(k % 11 == 0, F.concat(F.lit("/d1/"), name)).otherwise(name).alias("target"), (k % 2 == 0).alias("quoted"))
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    directories = w.table("supplier").select(text("p", s % 10).alias("project"), text("/d", s % 37).alias("directory"), s.alias("ordinal"))
    files = w.table("part").select(F.concat(text("/d", p % 40), text("/f", p % 150), F.lit(".h")).alias("path"))
    return S.first_match(includes, directories, files)


def structured_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    docs = w.documents.select(F.col("document_id").alias("id"), F.col("project_key").alias("owner"), F.col("document_id").alias("ordinal"))
    packs = w.packages.groupBy(F.concat(F.lit("package:"), "name").alias("id")).agg(F.min("project_key").alias("owner")).withColumn("ordinal", F.col("id"))
    syms = w.symbols.select(F.col("symbol_id").alias("id"), F.col("document_id").alias("owner"), F.col("symbol_id").alias("ordinal"))
    return L.structured(w.projects.select(F.col("project_key").alias("id"), F.col("name").alias("ordinal")), docs, packs, syms)


def collision_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Workspace(spark, sf_dir).table("part")
    return L.spread(p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10 + 0.25).alias("x"), (F.col("p_partkey") % 20 * 7.0).alias("y")), ["id"])


def bucket_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Workspace(spark, sf_dir).table("part")
    k = F.col("p_partkey")
    return L.relaxed(p.select(k.alias("id"), (k * 37 % 4001 * 1.5).cast("double").alias("x"), (k * 91 % 3989 * 1.5).cast("double").alias("y"), F.lit(120.0).alias("w"), F.lit(48.0).alias("h")))


def force_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    refs = stage(w.project_references, "refs")
    parts = connected_components(refs, "source", "target")
    seats = w.projects.select(F.col("project_key").alias("id"), (F.col("n_nationkey") % 5 * 100.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 100.0).alias("y"))
    nodes = seats.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    edges = refs.join(parts.withColumnRenamed("node", "source"), "source")
    return L.forces(nodes, edges)


QUERIES = {f.__name__: f for f in (
    visible_nodes, visible_edges, cycles_only_nodes, symbol_search, tree_filter, graph_search, symbol_kinds, snapshot_latest, snapshot_retention, snapshot_header_counts, history_dedupe, history_cap, section_cap,
    top_peers, last_diagnostics, recent_workspaces, enclosing_range_join, asof_handle_join, scoped_name_resolution, preferred_candidate, include_first_match, structured_layout, collision_spread, bucket_relaxation, force_layout,
)}

_SHOWN = "shown AS (SELECT id, label, grp FROM all_nodes WHERE grp <> 'assembly' AND NOT (grp = 'symbol' AND symbol_kind = '1-URGENT') AND NOT (grp = 'document' AND id LIKE '%7'))"
_CYC = f"cyc AS (SELECT {node('project', 'node')} AS node FROM members)"
_NAMED = """
WITH named AS (SELECT p_partkey AS key, p_brand || '::' || p_type || '::f' || (p_partkey % 97) AS q, 'f' || (p_partkey % 97) AS simple, 's' || s AS doc, p_partkey % 500 AS line, p_partkey % 2 = 1 AS def, p_brand, p_type
               FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)
"""
_PICK = """
CASE WHEN doc = rdoc AND def AND line <= rline THEN 1 WHEN doc = rdoc THEN 2 WHEN def THEN 3 ELSE 4 END"""

ORACLES = {
    "visible_nodes": facts("SELECT id, label, grp AS node_group FROM shown", GRAPH, _SHOWN),
    "visible_edges": facts("SELECT source, target, kind, rk AS reference_kind, cf AS confidence, CAST(min(weight) AS BIGINT) AS weight FROM kind_edges WHERE kind <> 'project-assembly' AND source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) GROUP BY ALL", GRAPH, _SHOWN),
    "cycles_only_nodes": facts("SELECT id, label FROM all_nodes WHERE id IN (SELECT node FROM cyc)", GRAPH, CYCLES, _CYC, recursive=True),
    "symbol_search": facts("""
        SELECT symbol_id, s.name, project_key AS project_name FROM syms s JOIN docs d USING (document_id)
        WHERE contains(upper(s.name || '()'), 'NATION_1') OR contains(upper(project_key), 'NATION_1') OR contains(upper(d.name), 'NATION_1') OR contains(upper(kind), 'NATION_1')"""),
    "tree_filter": facts("""
        , items AS (SELECT project_key, 'files' AS section, name AS label FROM docs UNION ALL SELECT DISTINCT project_key, 'packages', brand FROM ext)
        SELECT i.* FROM items i LEFT JOIN projects p USING (project_key) WHERE contains(upper(p.name), 'NATION_2') OR contains(upper(label), 'NATION_2')"""),
    "graph_search": facts("SELECT id, label FROM all_nodes WHERE grp IN ('document', 'symbol') AND contains(lower(label), 'order1')", GRAPH),
    "symbol_kinds": facts("SELECT DISTINCT kind AS symbol_kind FROM syms"),
    "snapshot_latest": "SELECT user_id AS workspace, max(event_id) AS snapshot_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id",
    "snapshot_retention": "SELECT user_id AS workspace, event_id AS snapshot_id, event_type AS kind FROM events e WHERE (SELECT count(*) FROM events n WHERE n.user_id = e.user_id AND n.event_id > e.event_id) < 20",
    "snapshot_header_counts": facts("SELECT project_key, count(DISTINCT d.document_id) AS document_count, count(symbol_id) AS symbol_count FROM docs d LEFT JOIN syms USING (document_id) GROUP BY project_key"),
    "history_dedupe": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type OR b IS NULL",
    "history_cap": """
        WITH d AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type OR b IS NULL)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM d) WHERE n <= 80""",
    "section_cap": facts("SELECT project_key, name, greatest(0, n - 96) AS omitted FROM (SELECT project_key, type AS name, row_number() OVER (PARTITION BY project_key ORDER BY type) AS r, count(*) OVER (PARTITION BY project_key) AS n FROM (SELECT DISTINCT project_key, type FROM ext)) WHERE r <= 96"),
    "top_peers": """
        SELECT l_suppkey, l_partkey AS peer, r AS rank, 'p' || l_partkey || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY l_suppkey, l_partkey)) WHERE r <= 12""",
    "last_diagnostics": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 2000",
    "recent_workspaces": """
        SELECT CASE WHEN event_id % 2 = 0 THEN '/Home/u' ELSE '/home/u' END || user_id AS path, event_id
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "enclosing_range_join": """
        WITH r AS (SELECT s AS document_id, p_partkey AS symbol_id, p_partkey % 500 AS a, p_partkey % 500 + p_size AS b FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
        f AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS ref_id, l_suppkey AS document_id, l_orderkey % 550 AS line FROM lineitem)
        SELECT ref_id, document_id, line, arg_max(symbol_id, {'a': a, 's': symbol_id}) AS symbol_id FROM f JOIN r USING (document_id) WHERE line BETWEEN a AND b GROUP BY ref_id, document_id, line""",
    "asof_handle_join": """
        WITH l AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'H' END || (l_partkey % 5) AS handle FROM lineitem),
        loads AS (SELECT l_suppkey, upper(handle) AS u, l_orderkey, max(l_partkey) AS library FROM l WHERE l_returnflag = 'R' GROUP BY ALL)
        SELECT c.l_orderkey || '-' || c.l_linenumber || '-' || c.l_partkey AS call_id, c.l_suppkey AS document_id, c.l_orderkey AS line, c.handle, library
        FROM l c ASOF JOIN loads o ON c.l_suppkey = o.l_suppkey AND upper(c.handle) = o.u AND c.l_orderkey >= o.l_orderkey WHERE c.l_returnflag = 'A'""",
    "scoped_name_resolution": _NAMED + f"""
        , r AS (SELECT key AS ref_id, CASE WHEN key % 3 = 0 THEN p_type || '::f' || (key % 89) ELSE 'f' || (key % 89) END AS token, p_brand, p_type, doc AS rdoc, 250 AS rline FROM named),
        probes AS (SELECT *, 0 AS probe, p_brand || '::' || p_type || '::' || token AS q FROM r WHERE ref_id % 3 <> 0
                   UNION ALL SELECT *, CASE WHEN ref_id % 3 = 0 THEN 0 ELSE 1 END, p_brand || '::' || token FROM r UNION ALL SELECT *, CASE WHEN ref_id % 3 = 0 THEN 1 ELSE 2 END, token FROM r),
        cand AS (SELECT ref_id, probe, rdoc, rline, n.key, n.doc, n.line, n.def FROM probes JOIN named n USING (q) WHERE n.key <> ref_id
                 UNION ALL SELECT ref_id, 1048576, rdoc, rline, n.key, n.doc, n.line, n.def FROM r JOIN named n ON n.simple = 'f' || (r.ref_id % 89) WHERE n.key <> ref_id),
        best AS (SELECT *, {_PICK} AS tier FROM cand),
        o AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY probe, tier, CASE tier WHEN 1 THEN -line WHEN 2 THEN line ELSE 0 END, doc, line, key) AS n FROM best)
        SELECT ref_id, CAST(probe AS BIGINT) AS probe, key FROM o WHERE n = 1""",
    "preferred_candidate": f"""
        WITH cand AS (SELECT o_orderkey, 's' || (o_custkey % 100) AS rdoc, o_orderkey % 300 AS rline, l_partkey AS key, 's' || l_suppkey AS doc, l_partkey % 500 AS line, l_linenumber % 2 = 1 AS def
                      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey <> o_orderkey % 2000),
        best AS (SELECT *, {_PICK} AS tier FROM cand),
        o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY tier, CASE tier WHEN 1 THEN -line WHEN 2 THEN line ELSE 0 END, doc, line, key) AS n FROM best)
        SELECT o_orderkey, CAST(tier AS BIGINT) AS tier, key, doc AS document_id, line FROM o WHERE n = 1""",
    "include_first_match": """
        WITH i AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 10) AS project, '/d' || (o_custkey % 40) AS own, 'f' || (o_orderkey % 50) || '.h' AS name, o_orderkey % 2 = 0 AS quoted, o_orderkey % 11 = 0 AS rooted FROM orders),
        d AS (SELECT 'p' || (s_suppkey % 10) AS project, '/d' || (s_suppkey % 37) AS dir, s_suppkey AS o FROM supplier),
        f AS (SELECT DISTINCT '/d' || (p_partkey % 40) || '/f' || (p_partkey % 150) || '.h' AS path FROM part),
        probes AS (SELECT id, '/d1/' || name AS path, -2 AS o FROM i WHERE rooted UNION ALL SELECT id, own || '/' || name, -1 FROM i WHERE NOT rooted AND quoted
                   UNION ALL SELECT id, dir || '/' || name, o FROM i JOIN d USING (project) WHERE NOT rooted)
        SELECT id AS include_id, arg_min(path, o) AS path FROM probes JOIN f USING (path) GROUP BY id""",
    "structured_layout": facts("""
        , p AS (SELECT project_key AS id, (row_number() OVER (ORDER BY name) - 1) * 320.0 - ((SELECT count(*) FROM projects) - 1) * 160.0 AS x, -360.0 AS y FROM projects),
        di AS (SELECT document_id AS id, project_key AS owner, row_number() OVER (PARTITION BY project_key ORDER BY document_id) - 1 AS i, count(*) OVER (PARTITION BY project_key) AS n FROM docs),
        d AS (SELECT di.id, p.x - (least(least(6, n), n - i // least(6, n) * least(6, n)) - 1) * 156.0 / 2 + i % least(6, n) * 156.0 AS x, -120.0 + i // least(6, n) * 116.0 AS y FROM di JOIN p ON p.id = owner),
        ei AS (SELECT id, owner, row_number() OVER (PARTITION BY owner ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY owner) AS n FROM (SELECT 'package:' || brand AS id, min(project_key) AS owner FROM ext GROUP BY brand)),
        e AS (SELECT ei.id, p.x - (least(least(5, n), n - i // least(5, n) * least(5, n)) - 1) * 176.0 / 2 + i % least(5, n) * 176.0 AS x, 360.0 + i // least(5, n) * 84.0 AS y FROM ei JOIN p ON p.id = owner),
        si AS (SELECT *, least(n, CASE WHEN n >= 160 THEN 12 WHEN n >= 64 THEN 10 ELSE 8 END) AS c FROM (SELECT symbol_id AS id, document_id AS owner, row_number() OVER (PARTITION BY document_id ORDER BY symbol_id) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM syms)),
        s AS (SELECT si.id, d.x - (least(c, n - i // c * c) - 1) * 72.0 / 2 + i % c * 72.0 AS x, d.y + 88.0 + i // c * 44.0 AS y FROM si JOIN d ON d.id = owner)
        SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM s)"""),
    "collision_spread": """
        WITH n AS (SELECT p_partkey AS id, p_size * 10 + 0.25 AS x, p_partkey % 20 * 7.0 AS y FROM part),
        k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY x, y) AS c FROM n WINDOW w AS (PARTITION BY x, y ORDER BY id))
        SELECT id, CAST(CASE WHEN c = 1 THEN x ELSE x + (i % 3 - (least(3, c - i // 3 * 3) - 1) / 2.0) * 172.0 END AS DOUBLE) AS x, CAST(CASE WHEN c = 1 THEN y ELSE y + (i // 3 - (ceil(c / 3.0) - 1) / 2.0) * 70.0 END AS DOUBLE) AS y FROM k""",
}
