"""Queries over the graph: cycles, components, reach, roll-ups, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.catalog.edges import payload_edges
from depweave.catalog.sql import CYCLES, GRAPH, facts, node
from depweave.functions import ids
from depweave.operators import components as C
from depweave.operators import edges as E
from depweave.operators import graph as G
from depweave.operators import payload as P
from depweave.operators import rollup as R
from depweave.plans.numbering import numbered
from depweave.plans.staging import stage
from depweave.sources.workspace import Workspace


def project_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.components_of_cycles(Workspace(spark, sf_dir).project_references)
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def project_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = Workspace(spark, sf_dir).project_references
    return G.cycles(refs, G.components_of_cycles(refs), "project")


def cycle_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    inside = G.components_of_cycles(w.project_references).select(F.col("node").alias("project_key")).distinct()
    return w.projects.join(inside.withColumn("_in", F.lit(True)), "project_key", "left").select("project_key", F.coalesce("_in", F.lit(False)).alias("is_in_cycle"))


def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = Workspace(spark, sf_dir).project_references
    return G.flag_cycles(refs.select("source", "target"), G.components_of_cycles(refs))


def upper_graph(w: Workspace) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, group``) and edges of projects and what they use outside."""
    pk = ids.node_id("project", "project_key")
    nodes = P.nodes(
        P.node_rows(w.projects, pk, "name", "project", "name"),
        P.node_rows(w.packages, ids.node_id("package", "name"), "name", "package", "project_key"),
        P.node_rows(w.assemblies, ids.node_id("assembly", "name"), "name", "assembly", "project_key"),
    )
    edges = P.edges(
        P.edge_rows(w.packages, pk, ids.node_id("package", "name"), "project-package"),
        P.edge_rows(w.assemblies, pk, ids.node_id("assembly", "name"), "project-assembly"),
        P.edge_rows(w.project_references, ids.node_id("project", "source"), ids.node_id("project", "target"), "project-reference", F.col("weight")),
    )
    return nodes, stage(edges, "edges")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return C.connected_components(w.project_references, "source", "target")


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.metrics(*upper_graph(Workspace(spark, sf_dir)))


def layout_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layout_choice(graph_metrics(spark, sf_dir))


def performance_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.performance_mode(graph_metrics(spark, sf_dir))


def _projects_as_seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where("group = 'project'").select(F.col("id").alias("seed"), F.col("id").alias("node"))


def dependency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    return G.dependency_map(_projects_as_seeds(nodes), edges, "both").select("seed", "source", "target", "kind")


def impact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    return G.reach(_projects_as_seeds(nodes), edges, "outgoing").select("seed", "node")


def impact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    seeds = nodes.where("group = 'package'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return G.impact_counts(seeds, edges, "incoming")


def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    contains = w.symbols.select(F.col("document_id").alias("source"), F.col("symbol_id").alias("target"))
    chosen = w.documents.where("document_id like 'document:s%'").select(F.col("document_id").alias("seed"), F.lit("document").alias("group"))
    chosen = chosen.unionByName(w.symbols.where("symbol_id like 'symbol:p%'").select(F.col("symbol_id").alias("seed"), F.lit("symbol").alias("group")))
    return G.expand_seeds(chosen, contains)


def ownership_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    docs = w.documents.select(F.col("project_key").alias("source"), F.col("document_id").alias("target"), F.lit("contains-document").alias("kind"), F.lit(0).alias("ordinal"))
    syms = w.symbols.select(F.col("document_id").alias("source"), F.col("symbol_id").alias("target"), F.lit("contains-symbol").alias("kind"), F.lit(0).alias("ordinal"))
    return G.ownership(w.symbols.select(F.col("symbol_id").alias("node")), docs.unionByName(syms))


def neighbor_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    seeds = stage(_projects_as_seeds(nodes), "seeds")
    return G.neighbours(G.dependency_map(seeds, edges, "both"), seeds)


def placement_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    nodes, edges = upper_graph(w)
    seeds = stage(_projects_as_seeds(nodes), "seeds")
    regions = w.table("nation").join(w.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(ids.node_id("project", F.concat(F.lit("name:"), "n_name")).alias("peer"), F.col("r_name").alias("context"))
    return G.clusters(G.neighbours(G.dependency_map(seeds, edges, "both"), seeds), regions)


def _project_owners(w: Workspace) -> DataFrame:
    pk = ids.node_id("project", "project_key")
    docs = w.documents.select(F.col("document_id").alias("node"), pk.alias("owner"))
    syms = w.symbols.join(w.documents.select("document_id", "project_key"), "document_id").select(F.col("symbol_id").alias("node"), pk.alias("owner"))
    return docs.unionByName(syms).unionByName(w.projects.select(pk.alias("node"), pk.alias("owner")))


def _project_weights(w: Workspace) -> DataFrame:
    owners, syms = _project_owners(w), E.symbol_edges(w.observations, w.declared)
    edges = P.edge_rows(w.project_references, ids.node_id("project", "source"), ids.node_id("project", "target"), "project-reference")
    edges = edges.unionByName(P.edge_rows(syms, F.col("source"), F.col("target"), ids.symbol_edge_kind("reference_kind"), F.col("reference_count"), "reference_kind", "confidence"))
    docs = w.documents.select(F.col("document_id").alias("node"), ids.node_id("project", "project_key").alias("owner"))
    return R.added(R.rolled_up(edges, owners, R.PROJECT), R.rolled_up_references(w.observations, w.declared, docs, R.PROJECT))


def _supplier_links(w: Workspace) -> DataFrame:
    """Edges between documents of suppliers: from each supplier of a part to the next one, and from the last to the first."""
    pairs = w.table("lineitem").select("l_partkey", "l_suppkey").distinct()
    order = Window.partitionBy("l_partkey").orderBy("l_suppkey")
    after = F.coalesce(F.lead("l_suppkey").over(order), F.first("l_suppkey").over(order))
    doc = lambda c: F.concat(F.lit("document:s"), c)
    return pairs.select(doc(F.col("l_suppkey")).alias("source"), doc(after).alias("target")).where("source <> target").distinct()


def document_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of documents, over a graph that grows with the tables."""
    found = stage(G.components_of_cycles(stage(_supplier_links(Workspace(spark, sf_dir)), "links")), "members")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects in the order of their layers, and in a layer by label."""
    w = Workspace(spark, sf_dir)
    found = numbered(_layers(w), [F.col("layer"), F.lower("label"), F.col("label"), F.col("node")], "place")
    return found.select("node", F.col("place").cast("long").alias("place"))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project_weights(Workspace(spark, sf_dir)).select("a", "b", F.col("weight").cast("double").alias("weight"))


def _of_documents(w: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """Observations and declarations of known documents, edges between symbols, the documents of these, and what kinds count for."""
    ids_ = w.documents.select("document_id")
    syms = E.symbol_edges(w.observations, w.declared)
    edges = P.edge_rows(syms, F.col("source"), F.col("target"), ids.symbol_edge_kind("reference_kind"), F.col("reference_count"), "reference_kind", "confidence")
    owners = w.symbols.select(F.col("symbol_id").alias("node"), F.col("document_id").alias("owner"))
    return P.among(w.observations, "source_document_id", ids_), P.among(w.declared, "document_id", ids_), edges, owners, R.DOCUMENT


def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolled_up_documents(*_of_documents(Workspace(spark, sf_dir))).select("a", "b", F.col("weight").cast("double").alias("weight"))


def symbol_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.symbol_adjacency(payload_edges(Workspace(spark, sf_dir))).select("a", "b", F.col("weight").cast("double").alias("weight"))


def node_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.importance(_project_weights(Workspace(spark, sf_dir))).select("node", F.col("importance").cast("double").alias("importance"))


def in_out_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = upper_graph(Workspace(spark, sf_dir))
    return R.in_out_weights(edges, _projects_as_seeds(nodes))


def document_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    found = R.with_symbols(R.importance_of_documents(*_of_documents(w)), w.symbols)
    return found.select("node", F.col("importance").cast("double").alias("importance"))


def relayout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents of a workspace need a new layout once those of suppliers join those of customers."""
    docs = Workspace(spark, sf_dir).documents.select(F.col("document_id").alias("node"))
    old = docs.where("node like 'document:c%'")
    return G.needs_layout(old, docs, docs)


def _layers(w: Workspace) -> DataFrame:
    refs = stage(w.project_references, "refs")
    return G.layers(w.projects.select(F.col("project_key").alias("node"), F.col("name").alias("label")), refs, G.components_of_cycles(refs))


def project_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(Workspace(spark, sf_dir)).select("node", F.col("layer").cast("long").alias("layer"))


def flow_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    refs = w.project_references.select(F.col("source").alias("a"), F.col("target").alias("b"), (F.col("weight") * F.lit("8").cast("decimal(4,1)")).alias("weight"))
    return R.flow_bias(refs, _layers(w)).select("node", F.round("bias", 9).alias("bias"))


def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return G.order_layers(_layers(w), w.project_references.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight"))


QUERIES = {f.__name__: f for f in (
    project_scc, project_cycles, cycle_membership, cycle_edges, components, graph_metrics, layout_choice, performance_mode, dependency_map, impact_nodes, impact_count, seed_expansion, ownership_context,
    neighbor_placement, placement_clusters, document_scc, topological_order, project_rollup, document_rollup, symbol_adjacency, node_importance, in_out_weights, document_importance, relayout, project_layers, flow_bias, layer_order,
)}

_UPPER = f"""
unodes AS (SELECT id, grp FROM all_nodes WHERE grp IN ('project', 'package', 'assembly')),
uedges AS (
  SELECT source, target, kind, weight FROM kind_edges WHERE kind IN ('project-package', 'project-assembly')
  UNION ALL SELECT {node('project', 'source')}, {node('project', 'target')}, 'project-reference', weight FROM refs)
"""
_METRICS = """
both_ways AS (SELECT source AS a, target AS b FROM uedges UNION SELECT target, source FROM uedges),
linked AS (SELECT a, b FROM both_ways UNION SELECT l.a, w.b FROM linked l JOIN both_ways w ON l.b = w.a),
comps AS (SELECT a AS node, least(a, min(b)) AS c FROM linked GROUP BY a),
m AS (SELECT (SELECT count(*) FROM unodes) AS node_count, (SELECT count(*) FROM uedges) AS edge_count, CAST(0 AS BIGINT) AS symbol_count,
             (SELECT count(*) FROM unodes WHERE id NOT IN (SELECT a FROM both_ways)) AS isolated_count,
             (SELECT count(DISTINCT c) FROM comps) + (SELECT count(*) FROM unodes WHERE id NOT IN (SELECT a FROM both_ways)) AS component_count,
             (SELECT max(n) FROM (SELECT count(*) AS n FROM comps GROUP BY c)) AS largest_component)
"""
_GROUPS = """
groups AS (SELECT project_key AS node, name AS label, coalesce(component, project_key) AS g FROM projects LEFT JOIN members ON node = project_key),
dag AS (SELECT DISTINCT x.g AS a, y.g AS b FROM refs JOIN groups x ON x.node = source JOIN groups y ON y.node = target WHERE x.g <> y.g),
ways AS (SELECT DISTINCT g, 0 AS layer FROM groups UNION SELECT b, layer + 1 FROM ways JOIN dag ON g = a),
lay AS (SELECT node, label, max(layer) AS layer FROM groups JOIN ways USING (g) GROUP BY node, label),
layered AS (SELECT node, CASE WHEN (SELECT max(layer) FROM lay) = 0 AND (SELECT count(*) FROM lay) > 6
   THEN CAST(floor((row_number() OVER (ORDER BY lower(label), label) - 1) / ceil(sqrt((SELECT count(*) FROM lay)))) AS BIGINT) ELSE layer END AS layer FROM lay)
"""
_OWNERS = f"""
owners AS (SELECT document_id AS node, {node('project', 'project_key')} AS owner FROM docs UNION ALL SELECT symbol_id, {node('project', 'project_key')} FROM syms JOIN docs USING (document_id)
  UNION ALL SELECT {node('project', 'project_key')}, {node('project', 'project_key')} FROM projects)
"""
_CASE = lambda t: "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DECIMAL(4,1))" for k, v in t.items()) + " END"
_WEIGHTS = f"pw AS (SELECT x.owner AS a, y.owner AS b, sum(weight * {_CASE(R.PROJECT)}) AS weight FROM kind_edges JOIN owners x ON x.node = source JOIN owners y ON y.node = target WHERE x.owner <> y.owner AND {_CASE(R.PROJECT)} IS NOT NULL GROUP BY ALL)"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in G.KIND_RANKS) + " ELSE 9 END"
_NEAR = f"""
touch AS (SELECT source AS seed, target AS peer, true AS o, weight, kind FROM uedges WHERE source <> target AND source IN (SELECT id FROM unodes WHERE grp = 'project')
  UNION ALL SELECT target, source, false, weight, kind FROM uedges WHERE source <> target AND target IN (SELECT id FROM unodes WHERE grp = 'project')),
near AS (SELECT seed, peer, CASE WHEN min(o) <> max(o) THEN 'both' WHEN max(o) THEN 'outgoing' ELSE 'incoming' END AS direction, CAST(sum(greatest(1, weight)) AS BIGINT) AS weight,
                arg_min(kind, {{'r': {_RANK}, 'k': kind}}) AS kind FROM touch GROUP BY seed, peer)
"""

ORACLES = {
    "project_scc": facts("SELECT node, component FROM members", CYCLES, recursive=True),
    "document_scc": """
        WITH RECURSIVE p AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem),
        n AS (SELECT s, coalesce(lead(s) OVER w, first_value(s) OVER w) AS t FROM p WINDOW w AS (PARTITION BY k ORDER BY s)),
        e AS (SELECT DISTINCT s, t FROM n WHERE s <> t), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
        SELECT 'document:s' || x.s AS node, min('document:s' || x.t) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY x.s""",
    "topological_order": facts("SELECT node, row_number() OVER (ORDER BY layered.layer, lower(label), label, node) AS place FROM layered JOIN lay USING (node)", CYCLES, _GROUPS, recursive=True),
    "project_cycles": facts("""
        SELECT 'project-cycle-' || row_number() OVER (ORDER BY component) AS cycle_id, 'project' AS graph_kind, component AS least, size, edge_count
        FROM (SELECT component, count(*) AS size FROM members GROUP BY component)
        JOIN (SELECT a.component, count(*) AS edge_count FROM refs JOIN members a ON a.node = source JOIN members b ON b.node = target AND a.component = b.component GROUP BY a.component) USING (component)""", CYCLES, recursive=True),
    "cycle_membership": facts("SELECT project_key, project_key IN (SELECT node FROM members) AS is_in_cycle FROM projects", CYCLES, recursive=True),
    "cycle_edges": facts("SELECT source, target, EXISTS (SELECT 1 FROM members a JOIN members b USING (component) WHERE a.node = source AND b.node = target) AS is_cycle_edge FROM refs", CYCLES, recursive=True),
    "components": facts("""
        , w AS (SELECT source AS a, target AS b FROM refs UNION SELECT target, source FROM refs), l AS (SELECT a, b FROM w UNION SELECT l.a, w.b FROM l JOIN w ON l.b = w.a)
        SELECT a AS node, least(a, min(b)) AS component FROM l GROUP BY a""", recursive=True),
    "graph_metrics": facts("SELECT *, CAST(2 * edge_count AS DOUBLE) / node_count AS average_degree FROM m", GRAPH, _UPPER, _METRICS, recursive=True),
    "layout_choice": facts("""
        SELECT CASE WHEN edge_count = 0 THEN 'structured-massive' WHEN node_count <= 160 AND 2.0 * edge_count / node_count <= 2.2 AND largest_component / node_count >= 0.75 THEN 'breadthfirst'
                    WHEN component_count >= 16 AND largest_component / node_count < 0.45 THEN 'structured-massive' WHEN node_count >= 2200 AND isolated_count / node_count >= 0.7 THEN 'structured-massive'
                    WHEN node_count >= 900 AND largest_component / node_count >= 0.6 THEN 'cose' ELSE 'semantic-flow' END AS layout FROM m""", GRAPH, _UPPER, _METRICS, recursive=True),
    "performance_mode": facts("SELECT CASE WHEN node_count >= 1800 OR edge_count >= 6200 THEN 'massive' WHEN node_count >= 900 OR edge_count >= 2600 THEN 'large' ELSE 'normal' END AS mode FROM m", GRAPH, _UPPER, _METRICS, recursive=True),
    "dependency_map": facts("SELECT DISTINCT id AS seed, source, target, kind FROM unodes JOIN uedges ON id = source OR id = target WHERE grp = 'project'", GRAPH, _UPPER),
    "impact_nodes": facts(", r AS (SELECT id AS seed, id AS node FROM unodes WHERE grp = 'project' UNION SELECT seed, target FROM r JOIN uedges ON source = node) SELECT seed, node FROM r", GRAPH, _UPPER, recursive=True),
    "impact_count": facts(", r AS (SELECT id AS seed, id AS node FROM unodes WHERE grp = 'package' UNION SELECT seed, source FROM r JOIN uedges ON target = node) SELECT seed, count(*) - 1 AS impact FROM r GROUP BY seed", GRAPH, _UPPER, recursive=True),
    "seed_expansion": facts("""
        SELECT document_id AS seed, document_id AS node FROM docs WHERE document_id LIKE 'document:s%' UNION SELECT document_id, symbol_id FROM syms WHERE document_id LIKE 'document:s%'
        UNION SELECT symbol_id, symbol_id FROM syms WHERE symbol_id LIKE 'symbol:p%' UNION SELECT symbol_id, document_id FROM syms WHERE symbol_id LIKE 'symbol:p%'"""),
    "ownership_context": facts("SELECT symbol_id AS node, document_id AS document, project_key AS project FROM syms JOIN docs USING (document_id)"),
    "neighbor_placement": facts("SELECT * FROM near", GRAPH, _UPPER, _NEAR),
    "placement_clusters": facts(f"""
        , ctx AS (SELECT {node('project', "('name:' || n_name)")} AS peer, r_name AS context FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT seed, direction, coalesce(context, 'external:' || peer) AS context, count(*) AS members, CAST(sum(weight) AS BIGINT) AS weight, arg_min(kind, {{'r': {_RANK}, 'k': kind}}) AS kind
        FROM near LEFT JOIN ctx USING (peer) GROUP BY seed, direction, coalesce(context, 'external:' || peer)""", GRAPH, _UPPER, _NEAR),
    "project_rollup": facts("SELECT a, b, CAST(weight AS DOUBLE) AS weight FROM pw", GRAPH, _OWNERS, _WEIGHTS),
    "document_rollup": facts(f"""
        , o AS (SELECT document_id AS node, document_id AS owner FROM docs UNION ALL SELECT symbol_id, document_id FROM syms)
        SELECT x.owner AS a, y.owner AS b, CAST(sum(weight * {_CASE(R.DOCUMENT)}) AS DOUBLE) AS weight FROM kind_edges JOIN o x ON x.node = source JOIN o y ON y.node = target
        WHERE x.owner <> y.owner AND {_CASE(R.DOCUMENT)} IS NOT NULL GROUP BY ALL""", GRAPH),
    "symbol_adjacency": facts(f"SELECT source AS a, target AS b, CAST(sum(weight * {_CASE(R.SYMBOL)}) AS DOUBLE) AS weight FROM kind_edges WHERE {_CASE(R.SYMBOL)} IS NOT NULL GROUP BY ALL", GRAPH),
    "node_importance": facts("SELECT node, CAST(sum(weight) AS DOUBLE) AS importance FROM (SELECT a AS node, weight FROM pw UNION ALL SELECT b, weight FROM pw) GROUP BY node", GRAPH, _OWNERS, _WEIGHTS),
    "in_out_weights": facts("""
        SELECT id AS seed, CAST(coalesce((SELECT sum(greatest(1, weight)) FROM uedges WHERE target = id), 0) AS BIGINT) AS incoming,
               CAST(coalesce((SELECT sum(greatest(1, weight)) FROM uedges WHERE source = id), 0) AS BIGINT) AS outgoing FROM unodes WHERE grp = 'project'""", GRAPH, _UPPER),
    "document_importance": facts(f"""
        , o AS (SELECT document_id AS node, document_id AS owner FROM docs UNION ALL SELECT symbol_id, document_id FROM syms),
        dw AS (SELECT x.owner AS a, y.owner AS b, weight * {_CASE(R.DOCUMENT)} AS weight FROM kind_edges JOIN o x ON x.node = source JOIN o y ON y.node = target WHERE x.owner <> y.owner AND {_CASE(R.DOCUMENT)} IS NOT NULL),
        parts AS (SELECT a AS node, weight FROM dw UNION ALL SELECT b, weight FROM dw UNION ALL SELECT document_id, 0.35 FROM syms)
        SELECT node, CAST(sum(weight) AS DOUBLE) AS importance FROM parts GROUP BY node""", GRAPH),
    "relayout": facts("SELECT count(*) FILTER (document_id LIKE 'document:s%') >= greatest(12, floor(count(*) * 0.18)) AS relayout FROM docs"),
    "project_layers": facts("SELECT node, CAST(layer AS BIGINT) AS layer FROM layered", CYCLES, _GROUPS, recursive=True),
    "flow_bias": facts("""
        , both_ways AS (SELECT source AS a, target AS b, weight FROM refs UNION ALL SELECT target, source, weight FROM refs)
        SELECT x.node, round(greatest(-1.0, least(1.0, coalesce((SELECT sum(weight * (y.layer - x.layer)) / sum(weight) FROM both_ways JOIN layered y ON y.node = b WHERE a = x.node), 0.0))), 9) AS bias FROM layered x""", CYCLES, _GROUPS, recursive=True),
}
