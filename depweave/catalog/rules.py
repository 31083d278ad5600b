"""Queries of row rules, dedupes and orders over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.catalog import edges as CE
from depweave.catalog import graphs as CG
from depweave.catalog.edges import other_edges, payload_nodes
from depweave.catalog.graphs import upper_graph
from depweave.catalog.sql import GRAPH, facts, node
from depweave.functions import ids
from depweave.operators import arrange as A
from depweave.operators import edges as E
from depweave.operators import facts as X
from depweave.operators import graph as G
from depweave.operators import payload as P
from depweave.operators import ranked as K
from depweave.operators import resolve as S
from depweave.operators import view as V
from depweave.plans.staging import stage
from depweave.sources.projects import capped_files as first_files
from depweave.sources.workspace import Workspace

_KINDS = ("type", "method", "property", "field", "event", "parameter", "local")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _numbered_lines(w: Workspace) -> DataFrame:
    return w.table("lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(Workspace(spark, sf_dir))


def _first_suppliers(w: Workspace) -> DataFrame:
    first = w.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    return w.table("part").join(first, F.col("p_partkey") == F.col("l_partkey"))


def dependency_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber") - 1)
    return X.candidates(_lines(spark, sf_dir).select("at", kind.alias("kind"), (F.col("l_linestatus") == "O").alias("is_implicit"))).select("at", "kind")


def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "ClassDeclaration").when(F.col("o_orderstatus") == "O", "TypeAliasDeclaration").otherwise(F.col("o_orderstatus"))
    return Workspace(spark, sf_dir).table("orders").select("o_orderkey", X.kind_label(kind).alias("label"))


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Workspace(spark, sf_dir).table("events")
    kinds = e.select("event_type").distinct()
    texts = kinds.where("event_type <= 'error'").select(F.lit("en").alias("locale"), F.col("event_type").alias("key"), _text(F.col("event_type"), " by {0}: {1}").alias("text"))
    texts = texts.unionByName(kinds.where("event_type <> 'purchase'").select(F.lit("ja").alias("locale"), F.col("event_type").alias("key"), _text("ja ", F.col("event_type"), " {0} {7}").alias("text")))
    asked = e.select("event_id", F.col("event_type").alias("key"), F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("args"))
    return X.messages(asked, texts, "en").select("event_id", "message")


def native_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)  # noqa: E741
    attribute = F.when(F.col("l_returnflag") == "A", "System.Runtime.InteropServices.DllImportAttribute").when(F.col("l_returnflag") == "R", "System.Runtime.InteropServices.LibraryImportAttribute").otherwise("System.ObsoleteAttribute")
    rows = l.select(
        F.col("l_orderkey").alias("document_id"), attribute.alias("attribute"), _text(" lib", F.col("l_suppkey"), " ").alias("library"), _text("m", F.col("l_linenumber")).alias("symbol_key"),
        _text("F", F.col("l_partkey")).alias("symbol_name"), F.when(F.col("l_quantity") >= 25, _text("E", F.col("l_partkey"))).alias("entry_point"),
    )
    declared = l.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("document_id"), _text("m", F.col("l_linenumber")).alias("symbol_key")).agg(F.min("l_partkey").alias("symbol_id"))
    return X.native_imports(rows, declared)


def reference_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(
        F.col("l_suppkey").alias("document_id"), F.when(F.col("l_quantity") >= 10, _text("u", F.col("l_linenumber"))).alias("source_usr"), F.lit(None).cast("string").alias("target_usr"),
        _text("p", F.col("l_partkey")).alias("target"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"), F.col("at").alias("ordinal"),
    )
    return X.distinct_references(rows).select("document_id", "source_usr", "target", "line", "kind", "ordinal")


def symbol_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"), _text("p", F.col("l_partkey")).alias("display_name"), F.lit(None).cast("string").alias("usr"), F.col("at").alias("ordinal"))
    return X.distinct_symbols(rows).select("document_id", "line", "kind", "display_name", "ordinal")


def pinned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.when(F.col("value") < 1, " ").otherwise(_text(" ", F.col("event_type"), " "))
    x = F.when(F.col("value") > 20, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = Workspace(spark, sf_dir).table("events").select("user_id", node.alias("node_id"), x.alias("x"), F.col("event_id").cast("double").alias("y"), F.col("event_id").alias("ordinal"))
    return X.pinned(rows, ["user_id"])


def hidden_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Workspace(spark, sf_dir).table("events").select(
        "user_id", _text(" ", F.col("event_type"), " ").alias("node_id"), F.when(F.col("value") < 10, " ").otherwise(_text(" ", F.col("props"))).alias("label"),
        F.when(F.col("value") < 20, " document ").alias("group"), F.col("event_id").alias("ordinal"),
    )
    return X.hidden(rows, ["user_id"]).withColumnRenamed("group", "node_group")


def include_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    path = lambda k: _text("/src/p", k, ".h")
    l, p = w.table("lineitem"), w.table("part")  # noqa: E741
    includes = l.select(path(F.col("l_partkey")).alias("source"), _text("/SRC/p", F.col("l_partkey") + F.col("l_linenumber"), ".h").alias("target"))
    return X.discovered(p.where("p_size = 1").select(path(F.col("p_partkey")).alias("path")), includes, p.where("p_type <> 'PROMO'").select(path(F.col("p_partkey")).alias("path"))).select("path", F.col("round").cast("long").alias("round"), "over")


def placement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    nodes = stage(nodes, "nodes")
    seeds = nodes.where("group = 'project'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return A.placement_order(G.neighbours(G.dependency_map(seeds, edges, "both"), seeds), nodes).select("seed", "peer", F.col("place").cast("long").alias("place"))


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CG.placement_clusters(spark, sf_dir).withColumn("lane", F.when(F.startswith("context", F.lit("external:")), 1).otherwise(0))
    return A.cluster_order(rows).select("seed", "direction", "context", F.col("place").cast("long").alias("place"))


def edge_springs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    sizes = payload_nodes(w).select("id", "group", (20.0 + F.length("label") * 3.5).alias("half_width"), F.when(F.col("group") == "project", 24.0).otherwise(12.0).alias("padding"))
    docs = A.document_springs(w.observations, w.declared, sizes.where("group = 'document'"))
    return A.springs(other_edges(w), sizes).unionByName(docs).select("source", "target", "kind", "length", F.round("stiffness", 6).alias("stiffness"))


def structured_massive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.massive(stage(payload_nodes(Workspace(spark, sf_dir)).select("id", "group", "label", "symbol_kind"), "nodes"))


def step_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Workspace(spark, sf_dir).table("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("widest"))
    n = F.col("n")
    found = {
        "section_rows": A.ladder(n, A.SECTION_ROWS, own_below=6), "symbol_columns": A.ladder(n, A.SYMBOL_COLUMNS), "seed_columns": A.ladder(n, A.SEED_COLUMNS, own_below=4),
        "external_columns": A.ladder(n, A.EXTERNAL_COLUMNS, own_below=4), "document_columns": A.document_columns(n, False, F.col("widest") * 5), "document_columns_with_symbols": A.document_columns(n, True, F.col("widest")),
    }
    far = {"padding": A.ladder(n * 40, A.PADDING), "zoom": A.ladder(n * 30, A.ZOOM), "zoom_with_symbols": A.ladder(n * 70, A.ZOOM_WITH_SYMBOLS)}
    return counts.select("l_partkey", "n", *(c.cast("long").alias(k) for k, c in found.items()), *(c.cast("double").alias(k) for k, c in far.items()))


def symbol_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Workspace(spark, sf_dir).table("part")
    cpp = X.cpp_symbol_key(F.col("p_brand"), _text("/src/", F.col("p_type"), ".cpp"), F.col("p_size"), F.lit("FunctionDeclaration"), F.col("p_name"))
    return p.select("p_partkey", cpp.alias("cpp_key"), X.managed_symbol_key(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("managed_key"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Workspace(spark, sf_dir).table("customer")
    path = F.when(F.col("c_acctbal") >= 0, _text("C:\\src/", F.col("c_mktsegment"), "\\", F.col("c_name"), ".cs")).when(F.col("c_acctbal") < -500, "/src/")
    key = F.when(F.col("c_nationkey") < 8, _text("name:", F.col("c_name"))).when(F.col("c_nationkey") < 16, _text("/src/", F.col("c_name"), ".v2.csproj")).otherwise(_text("id:", F.col("c_custkey")))
    return c.select(
        "c_custkey", ids.display_file_name(path, F.col("c_mktsegment")).alias("file_name"), ids.reference_label(key, F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment"))).alias("label"),
        ids.normalized_path(_text(" /src/", F.col("c_name"), "// ")).alias("path"),
    )


def native_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.native_rollup(CE._native(Workspace(spark, sf_dir)))
    return rows.select("library", "import_kind", ids.native_label("library", "import_kind", "imports").alias("label"))


def focused_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = V.View(documents=False, cycles_only=True, hidden_kinds=frozenset({"1-URGENT", "2-HIGH"})).focused("symbol", "1-URGENT")
    return V.visible_nodes(payload_nodes(Workspace(spark, sf_dir)), view).select("id", "label")


def map_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    selected = nodes.where("group = 'project'").select(F.col("id").alias("seed"))
    return G.map_seeds(selected, edges.select(F.col("source").alias("seed"), F.col("target").alias("node")), edges, "outgoing")


def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _first_suppliers(Workspace(spark, sf_dir)).select(
        F.col("s").alias("document_id"), F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 500).alias("line"),
        F.when(F.col("p_size") > 25, F.col("p_partkey") % 500 + F.col("p_size")).alias("closing_line"), F.lit(480).cast("long").alias("last_line"),
    )
    return S.line_ends(rows).select("document_id", "symbol_id", "line", "end")


def symbol_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.in_line_order(Workspace(spark, sf_dir).symbols).select("document_id", "symbol_id", F.col("place").cast("long").alias("place"))


def _spelled(w: Workspace) -> DataFrame:
    l = _numbered_lines(w).join(w.table("part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    name = F.when(F.col("l_returnflag") == "A", F.upper("p_brand")).otherwise(F.col("p_brand"))
    return l.select("l_suppkey", name.alias("name"), "p_name", F.struct("at", name.alias("name")).alias("ordinal"))


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distinct_names(_spelled(Workspace(spark, sf_dir)), ["l_suppkey"])


def labelled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labelled_references(_spelled(Workspace(spark, sf_dir)).select(F.col("l_suppkey").alias("source"), F.col("name").alias("target"), F.col("p_name").alias("label")))


def managed_before_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    native = _lines(spark, sf_dir).select(F.when(F.col("l_returnflag") == "A", _text("/SRC/P", F.col("l_partkey"))).otherwise(_text("/src/p", F.col("l_partkey"))).alias("path"), F.struct("at", "l_returnflag").alias("ordinal"))
    taken = w.table("part").where("p_size > 10").select(_text("/Src/p", F.col("p_partkey")).alias("path"))
    return E.without_taken(native, taken).select("path", F.col("ordinal.at").alias("at"))


def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.include_edges(_lines(spark, sf_dir).select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))


def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_files(_lines(spark, sf_dir).select(_text("/src/f", F.col("at"), ".cpp").alias("path")))


def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = _first_suppliers(Workspace(spark, sf_dir)).select(F.col("s").alias("document_id"), F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("line"), _text("u", F.col("p_partkey")).alias("usr"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    refs = _lines(spark, sf_dir).groupBy(F.col("at").alias("ref_id")).agg(F.min("l_suppkey").alias("document_id"), F.min(F.col("l_orderkey") % 2500).alias("line"), F.min(F.when(F.col("l_quantity") >= 25, _text("u", F.col("l_partkey")))).alias("usr"))
    ranges = declared.where("end > line + 20").select("document_id", "symbol_id", F.col("line").alias("start"), "end", F.col("symbol_id").alias("idx"))
    return S.fallback_source(stage(refs, "refs"), stage(declared.drop("end"), "declared"), ranges)


def search_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    found = V.graph_search(payload_nodes(w), "order1")
    docs = V.search_document_edges(w.observations, w.declared, found.where("group = 'document'")).withColumn("kind", F.lit("document-reference"))
    columns = ["source", "target", "kind", "dimmed"]
    return V.search_edges(other_edges(w), found).select(*columns).unionByName(docs.select(*columns))


def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    edges = w.documents.select(ids.node_id("project", "project_key").alias("source"), F.col("document_id").alias("target"))
    return P.as_json(payload_nodes(w).select("id", "label", F.col("group").alias("node_group")), edges)


def visible_impact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes a package's change reaches over visible edges: no assemblies, nor projects that are hidden one by one."""
    w = Workspace(spark, sf_dir)
    nodes, edges = upper_graph(w)
    hidden = w.projects.where("n_nationkey > 20").select(ids.node_id("project", "project_key").alias("id"))
    view = V.View(assemblies=False)
    shown = stage(V.visible_nodes(nodes, view, hidden).select("id", "group"), "shown")
    seeds = shown.where("group = 'package'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return G.impact_counts(seeds, stage(V.visible_edges(edges, shown.select("id"), view), "edges"), "incoming")


def filtered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of parts by supplier while a filter is set: all hits, none omitted."""
    w = Workspace(spark, sf_dir)
    items = _first_suppliers(w).where(F.contains(F.lower("p_name"), F.lit("red"))).select(F.col("s").alias("section"), F.col("p_partkey").alias("item"))
    return K.capped_sections(items, ["section"], ["item"], None).select("section", "item", F.col("omitted").cast("long").alias("omitted"))


QUERIES = {f.__name__: f for f in (
    dependency_candidates, kind_labels, message_texts, native_attributes, reference_dedupe, symbol_dedupe, pinned_nodes, hidden_nodes, include_discovery, placement_order, cluster_order, edge_springs, structured_massive,
    step_functions, symbol_keys, display_names, native_labels, focused_nodes, map_seeds, line_ends, symbol_order, distinct_names, labelled_references, managed_before_native, include_edges, capped_files, fallback_source,
    search_edges, payload_json, visible_impact_count, filtered_sections,
)}

_SPELLED = "sp AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN upper(p_brand) ELSE p_brand END AS name, p_name, l_orderkey * 10 + l_linenumber AS o FROM lineitem JOIN part ON l_partkey = p_partkey)"
_FIRST = "JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"
_GROUP_RANK = "CASE grp " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(A.GROUPS)) + " ELSE 6 END"

ORACLES = {
    "dependency_candidates": """
        SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS at, ['type', 'method', 'property', 'field', 'event', 'parameter', 'local'][l_linenumber] AS kind FROM lineitem WHERE l_linestatus <> 'O')
        WHERE kind IN ('type', 'method', 'property', 'field', 'event')""",
    "kind_labels": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Class' WHEN 'O' THEN 'Type Alias' ELSE o_orderstatus END AS label FROM orders",
    "message_texts": """
        SELECT event_id, CASE WHEN event_type <= 'error' THEN event_type || ' by ' || user_id || ': ' || event_id WHEN event_type <> 'purchase' THEN 'ja ' || event_type || ' ' || user_id || ' {7}' ELSE event_type END AS message FROM events""",
    "native_attributes": """
        WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS symbol_id FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
        SELECT l_orderkey AS document_id, 'lib' || l_suppkey AS library, CASE l_returnflag WHEN 'A' THEN 'DllImport' ELSE 'LibraryImport' END AS import_kind, symbol_id,
               CASE WHEN l_quantity >= 25 THEN 'E' ELSE 'F' END || l_partkey AS imported FROM lineitem LEFT JOIN d ON k = l_orderkey AND n = l_linenumber WHERE l_returnflag IN ('A', 'R')""",
    "reference_dedupe": """
        SELECT l_suppkey AS document_id, CASE WHEN l_quantity >= 10 THEN 'u' || l_linenumber END AS source_usr, 'p' || l_partkey AS target, l_linenumber AS line, l_returnflag AS kind, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY ALL""",
    "symbol_dedupe": "SELECT l_suppkey AS document_id, l_linenumber AS line, l_returnflag AS kind, 'p' || l_partkey AS display_name, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY ALL",
    "pinned_nodes": "SELECT user_id, event_type AS node_id, arg_max(value, event_id) AS x, CAST(max(event_id) AS DOUBLE) AS y FROM events WHERE value >= 1 AND value <= 20 GROUP BY ALL",
    "hidden_nodes": """
        SELECT user_id, event_type AS node_id, arg_max(CASE WHEN value < 10 THEN event_type ELSE props END, event_id) AS label, arg_max(CASE WHEN value < 20 THEN 'document' ELSE '' END, event_id) AS node_group FROM events GROUP BY ALL""",
    "include_discovery": """
        WITH RECURSIVE f AS (SELECT p_partkey AS k FROM part WHERE p_type <> 'PROMO'), e AS (SELECT DISTINCT l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem JOIN f ON k = l_partkey + l_linenumber),
        r AS (SELECT p_partkey AS k, 0 AS round FROM part JOIN f ON k = p_partkey WHERE p_size = 1 UNION SELECT b, round + 1 FROM r JOIN e ON a = k WHERE round < 400),
        s AS (SELECT k, CAST(min(round) AS BIGINT) AS round FROM r GROUP BY k)
        SELECT '/src/p' || k || '.h' AS path, round, (SELECT count(*) FROM s) > 50000 AS over FROM s QUALIFY row_number() OVER (ORDER BY round, upper('/src/p' || k || '.h')) <= 50000""",
    "placement_order": facts(f"""
        SELECT seed, peer, row_number() OVER (PARTITION BY seed ORDER BY {_GROUP_RANK}, {CG._RANK}, weight DESC, lower(label), label, peer) AS place FROM near JOIN all_nodes ON id = peer""", GRAPH, CG._UPPER, CG._NEAR),
    "cluster_order": CG.ORACLES["placement_clusters"].replace("SELECT seed, direction, coalesce", ", cl AS (SELECT seed, direction, coalesce", 1) + f""")
        SELECT seed, direction, context, row_number() OVER (PARTITION BY seed, direction ORDER BY context LIKE 'external:%', {CG._RANK}, weight DESC, lower(context), context) AS place FROM cl""",
    "edge_springs": facts(f"""
        , z AS (SELECT id, 20.0 + length(label) * 3.5 AS w, CASE WHEN grp = 'project' THEN 24.0 ELSE 12.0 END AS p FROM all_nodes),
        e AS (SELECT source, target, kind, rk, cf, min(CASE WHEN kind = 'project-reference' THEN 1 ELSE weight END) AS weight FROM kind_edges GROUP BY ALL)
        SELECT source, target, kind, CAST(greatest(64.0, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in A.REST.items())} ELSE 100.0 END, a.w + b.w + greatest(a.p, b.p) + 32.0) AS DOUBLE) AS length,
               round(CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in A.STIFF.items())} ELSE 0.6 END * least(2.0, 1.0 + 0.1 * ln(greatest(1, weight) + 1.0)), 6) AS stiffness
        FROM e JOIN z a ON a.id = source JOIN z b ON b.id = target WHERE source <> target""", GRAPH),
    "structured_massive": facts("""
        , t AS (SELECT count(*) AS t FROM all_nodes), v AS (SELECT id, label, symbol_kind, CASE WHEN grp IN ('package', 'assembly') THEN 'external' ELSE grp END AS g FROM all_nodes),
        o AS (SELECT id, g, symbol_kind, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY g, symbol_kind) AS n FROM v WINDOW w AS (PARTITION BY g, symbol_kind ORDER BY lower(label), label, id)),
        strip(g, y, gap, few, many, down) AS (VALUES ('project', -360.0, 260.0, 6, 4, 120.0), ('document', -120.0, 188.0, 8, 6, 92.0), ('external', 360.0, 164.0, 6, 8, 84.0)),
        a AS (SELECT id, o.g, i, n, y, gap, down, CASE WHEN t >= 1200 THEN many ELSE few END AS per FROM o JOIN strip USING (g), t),
        kinds AS (SELECT symbol_kind, n, CASE WHEN n <= 6 THEN n WHEN n <= 24 THEN 6 WHEN n <= 96 THEN 10 ELSE 14 END AS r, row_number() OVER (ORDER BY lower(symbol_kind), symbol_kind) AS k,
                     CASE WHEN t >= 1400 THEN 124.0 ELSE 136.0 END AS cell, CASE WHEN t >= 1400 THEN 1100.0 ELSE 900.0 END AS half FROM (SELECT symbol_kind, count(*) AS n FROM v WHERE g = 'symbol' GROUP BY symbol_kind), t),
        z AS (SELECT *, greatest(160.0, ceil(n / r) * cell) AS wide, greatest(72.0, r * 46.0) AS high FROM kinds),
        c AS (SELECT k, CAST(-half AS DOUBLE) AS x, CAST(32 AS DOUBLE) AS y, CAST(high AS DOUBLE) AS h, CAST(-half + wide + 96 AS DOUBLE) AS nx FROM z WHERE k = 1
              UNION ALL SELECT z.k, CASE WHEN nx + wide > half THEN -half ELSE nx END, CASE WHEN nx + wide > half THEN y + h + 96 ELSE y END, CASE WHEN nx + wide > half THEN high ELSE greatest(h, high) END,
                               CASE WHEN nx + wide > half THEN -half ELSE nx END + wide + 96 FROM c JOIN z ON z.k = c.k + 1)
        SELECT id, CAST((i % per - (least(per, n - i // per * per) - 1) / 2) * gap AS DOUBLE) AS x, CAST(y + (i // per - CASE WHEN g = 'external' THEN 0 ELSE (ceil(n / per) - 1) / 2 END) * down AS DOUBLE) AS y FROM a
        UNION ALL SELECT id, CAST(c.x + i // r * cell + cell / 2 AS DOUBLE), CAST(c.y + i % r * 46 + 23 AS DOUBLE) FROM o JOIN z USING (symbol_kind) JOIN c USING (k) WHERE o.g = 'symbol'""", GRAPH, recursive=True)
        # The first section wraps only where it is wider than the whole canvas, and then no higher: the row above is empty.
        .replace("CAST(32 AS DOUBLE) AS y", "CASE WHEN wide > 2 * half THEN 128.0 ELSE 32.0 END::DOUBLE AS y"),
    "step_functions": """
        SELECT l_partkey, n, CAST(CASE WHEN n <= 6 THEN greatest(1, n) WHEN n <= 24 THEN 6 WHEN n <= 96 THEN 10 ELSE 14 END AS BIGINT) AS section_rows,
               CAST(CASE WHEN n <= 10 THEN 1 WHEN n <= 28 THEN 2 WHEN n <= 54 THEN 3 ELSE 4 END AS BIGINT) AS symbol_columns,
               CAST(CASE WHEN n <= 4 THEN greatest(1, n) WHEN n <= 10 THEN 2 WHEN n <= 24 THEN 3 ELSE 4 END AS BIGINT) AS seed_columns,
               CAST(CASE WHEN n <= 4 THEN greatest(1, n) WHEN n <= 12 THEN 4 WHEN n <= 24 THEN 5 ELSE 6 END AS BIGINT) AS external_columns,
               CAST(CASE WHEN n BETWEEN 11 AND 20 AND widest * 5 > 220 THEN 3 WHEN n <= 4 THEN 1 WHEN n <= 10 THEN 2 WHEN n <= 20 THEN 4 WHEN n <= 40 THEN 5 ELSE 6 END AS BIGINT) AS document_columns,
               CAST(CASE WHEN n <= 4 THEN 1 WHEN n <= 10 THEN 2 WHEN n <= 20 THEN 3 WHEN n <= 40 THEN 4 ELSE 5 END AS BIGINT) AS document_columns_with_symbols,
               CAST(CASE WHEN n * 40 <= 499 THEN 56 WHEN n * 40 <= 1399 THEN 84 ELSE 120 END AS DOUBLE) AS padding,
               CAST(CASE WHEN n * 30 <= 71 THEN 1 WHEN n * 30 <= 399 THEN 0.72 WHEN n * 30 <= 1199 THEN 0.52 ELSE 0.32 END AS DOUBLE) AS zoom,
               CAST(CASE WHEN n * 70 <= 279 THEN 0.64 WHEN n * 70 <= 899 THEN 0.42 WHEN n * 70 <= 1799 THEN 0.24 WHEN n * 70 <= 2999 THEN 0.16 ELSE 0.12 END AS DOUBLE) AS zoom_with_symbols
        FROM (SELECT l_partkey, count(*) AS n, max(l_quantity) AS widest FROM lineitem GROUP BY l_partkey)""",
    "symbol_keys": "SELECT p_partkey, 'cpp|' || p_brand || '|/src/' || p_type || '.cpp|' || p_size || '|FunctionDeclaration|' || p_name AS cpp_key, p_brand || '|' || p_type || '|' || p_name AS managed_key FROM part",
    "display_names": """
        SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name || '.cs' ELSE c_mktsegment END AS file_name,
               CASE WHEN c_acctbal > 9000 THEN c_mktsegment WHEN c_nationkey < 8 THEN c_name WHEN c_nationkey < 16 THEN c_name || '.v2' ELSE CAST(c_custkey AS VARCHAR) END AS label, '/src/' || c_name AS path FROM customer""",
    "native_labels": f"""
        SELECT library, import_kind, library || ' [' || import_kind || ': ' || array_to_string(string_split(imports, ', ')[1:2], ', ') || CASE WHEN n_imports > 2 THEN ' +' || (n_imports - 2) || ' more' ELSE '' END || ']' AS label FROM ({CE.ORACLES['native_rollup']})""",
    "focused_nodes": facts("SELECT id, label FROM all_nodes WHERE grp <> 'document' AND NOT coalesce(symbol_kind = '2-HIGH', false)", GRAPH),
    "map_seeds": facts("SELECT id AS seed, id AS node FROM unodes WHERE grp = 'project' UNION SELECT source, target FROM uedges WHERE target IN (SELECT source FROM uedges)", GRAPH, CG._UPPER),
    "line_ends": f"""
        SELECT document_id, symbol_id, line, coalesce(c, least(480, greatest(line, coalesce(after - 1, 480)))) AS "end"
        FROM (SELECT *, lead(line) OVER (PARTITION BY document_id ORDER BY line, symbol_id) AS after FROM (SELECT s AS document_id, p_partkey AS symbol_id, p_partkey % 500 AS line, CASE WHEN p_size > 25 THEN p_partkey % 500 + p_size END AS c FROM part {_FIRST}))""",
    "symbol_order": facts("SELECT document_id, symbol_id, row_number() OVER (PARTITION BY document_id ORDER BY line, name, symbol_id) AS place FROM syms"),
    "distinct_names": f"WITH {_SPELLED} SELECT l_suppkey, arg_min(name, {{'o': o, 'n': name}}) AS name FROM sp GROUP BY l_suppkey, upper(name)",
    "labelled_references": f"WITH {_SPELLED} SELECT l_suppkey AS source, arg_min(name, {{'u': upper(p_name), 'l': p_name, 't': name}}) AS target, arg_min(p_name, {{'u': upper(p_name), 'l': p_name, 't': name}}) AS label FROM sp GROUP BY l_suppkey, upper(name)",
    "managed_before_native": """
        SELECT CASE WHEN f = 'A' THEN '/SRC/P' ELSE '/src/p' END || k AS path, o AS "at" FROM (
          SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS o, l_returnflag AS f, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag) AS n
          FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) WHERE n = 1""",
    "include_edges": "SELECT DISTINCT l_partkey AS source, l_suppkey AS target, CAST(1 AS BIGINT) AS reference_count FROM lineitem WHERE l_partkey <> l_suppkey",
    "capped_files": """
        SELECT path, (SELECT count(*) FROM lineitem) > 250000 AS over FROM (SELECT '/src/f' || (l_orderkey * 10 + l_linenumber) || '.cpp' AS path FROM lineitem) QUALIFY row_number() OVER (ORDER BY upper(path)) <= 250000""",
    "fallback_source": f"""
        WITH d AS (SELECT s AS doc, p_partkey AS id, p_size FROM part {_FIRST}),
        r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, min(l_suppkey) AS doc, min(l_orderkey % 2500) AS line, min(CASE WHEN l_quantity >= 25 THEN 'u' || l_partkey END) AS usr FROM lineitem GROUP BY ALL),
        f AS (SELECT ref_id, coalesce((SELECT id FROM d WHERE 'u' || id = usr), (SELECT max(id) FROM d WHERE d.doc = r.doc AND p_size > 20 AND r.line BETWEEN id AND id + p_size), (SELECT max(id) FROM d WHERE d.doc = r.doc AND id <= r.line)) AS symbol_id FROM r)
        SELECT ref_id, symbol_id FROM f WHERE symbol_id IS NOT NULL""",
    "search_edges": facts("""
        , hit AS (SELECT id FROM all_nodes WHERE grp IN ('document', 'symbol') AND contains(lower(label), 'order1'))
        SELECT source, target, kind, NOT (source IN (SELECT id FROM hit) OR target IN (SELECT id FROM hit)) AS dimmed FROM (SELECT DISTINCT source, target, kind, rk, cf FROM kind_edges)""", GRAPH),
    "payload_json": facts("""
        SELECT 'node' AS part, CAST(to_json({'id': id, 'label': label, 'node_group': grp}) AS VARCHAR) AS json FROM all_nodes
        UNION ALL SELECT 'edge', CAST(to_json({'source': source, 'target': target}) AS VARCHAR) FROM kind_edges WHERE kind = 'contains-document'""", GRAPH),
    "visible_impact_count": facts("""
        , vn AS (SELECT id, grp FROM unodes WHERE grp <> 'assembly' AND id NOT IN (SELECT HIDDEN FROM nation WHERE n_nationkey > 20)),
        ve AS (SELECT source, target FROM uedges WHERE kind <> 'project-assembly' AND source IN (SELECT id FROM vn) AND target IN (SELECT id FROM vn)),
        r AS (SELECT id AS seed, id AS node FROM vn WHERE grp = 'package' UNION SELECT seed, source FROM r JOIN ve ON target = node) SELECT seed, count(*) - 1 AS impact FROM r GROUP BY seed""".replace("HIDDEN", node("project", "('name:' || n_name)")), GRAPH, CG._UPPER, recursive=True),
    "filtered_sections": f"SELECT s AS section, p_partkey AS item, CAST(0 AS BIGINT) AS omitted FROM part {_FIRST} WHERE contains(lower(p_name), 'red')",
}
