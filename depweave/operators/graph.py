"""Graph algorithms as loops of joins: cycles, reach, layers, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.operators.components import connected_components
from depweave.plans.beside import beside
from depweave.plans.loops import until_settled
from depweave.plans.carry import KEY_ROWS
from depweave.plans.numbering import largest_key, numbered, places
from depweave.plans.staging import stage, unstage

#: Kinds of edges that are dependencies; all but containment.
DEPENDENCY_KINDS = (
    "document-reference", "project-assembly", "project-dll", "project-package", "project-reference",
    "symbol-call", "symbol-creation", "symbol-implementation", "symbol-inheritance", "symbol-reference",
)
#: Members of cycles up to which they are broadcast to the edges.
BROADCAST_MEMBERS = 500_000
#: Kinds from the most telling one on; others come last.
KIND_RANKS = (
    ("symbol-call", 0), ("symbol-inheritance", 1), ("symbol-implementation", 1), ("document-reference", 2), ("project-reference", 3),
    ("symbol-reference", 4), ("symbol-creation", 5), ("project-package", 6), ("project-assembly", 7), ("project-dll", 8),
)


def is_dependency(kind: Column) -> Column:
    return kind.isin(*DEPENDENCY_KINDS)


def kind_rank(kind: Column) -> Column:
    rank = F.lit(9)
    for name, n in KIND_RANKS:
        rank = F.when(kind == name, n).otherwise(rank)
    return rank


def components_of_cycles(edges: DataFrame) -> DataFrame:
    """``node, component`` for the strongly connected components that are cycles: of several nodes, or of one with a loop.

    ``edges``: ``source, target``; blank ends are dropped. Rounds of: cut off nodes that nothing
    leads to or from; give each node the least node that reaches it; a component is what of the
    nodes with one such label reaches back to the node of that name; go on with the rest. A
    component is named by its least node among those still in the round, so names are unique, and
    all its nodes carry it.
    """
    live = stage(edges.where("trim(source) <> '' and trim(target) <> ''").select("source", "target").distinct(), "edges")
    found: list[DataFrame] = []
    loops = stage(live.where("source = target").select(F.col("source").alias("node")).distinct(), "loops")
    while True:
        live = _trim(live)
        if not live.limit(1).count():
            break
        nodes = live.select(F.col("source").alias("node")).union(live.select("target")).distinct()

        def forward(s: DataFrame, e: DataFrame = live) -> DataFrame:
            reached = e.join(s.select(F.col("node").alias("source"), "label"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("m"))
            return s.join(reached, "node", "left").select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved"))

        labels = until_settled(nodes.withColumn("label", F.col("node")), forward)
        inner = stage(
            live.join(labels.select(F.col("node").alias("source"), F.col("label").alias("l1")), "source")
            .join(labels.select(F.col("node").alias("target"), F.col("label").alias("l2")), "target").where("l1 = l2").select("source", "target"),
            "inner",
        )

        def backward(s: DataFrame, e: DataFrame = inner) -> DataFrame:
            back = e.join(s.where("inside").select(F.col("node").alias("target")), "target").select(F.col("source").alias("node")).distinct().withColumn("hit", F.lit(True))
            return s.join(back, "node", "left").select("node", "label", (F.col("inside") | F.coalesce("hit", F.lit(False))).alias("inside"), (~F.col("inside") & F.coalesce("hit", F.lit(False))).alias("moved"))

        marked = until_settled(labels.withColumn("inside", F.col("node") == F.col("label")), backward)
        part = stage(marked.where("inside").select("node", F.col("label").alias("component")), "component")
        found.append(part)
        rest = live.join(part.select(F.col("node").alias("source")), "source", "left_anti").join(part.select(F.col("node").alias("target")), "target", "left_anti")
        new = stage(rest.select("source", "target"), "edges")
        for old in (live, inner, labels, marked):
            unstage(old)
        live = new
    if not found:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0).unionByName(loops.select("node", F.col("node").alias("component")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    several = every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    cycles = every.join(several, "component", "left_semi").select("node", "component")
    alone = loops.join(cycles, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cycles.unionByName(alone)


def _trim(edges: DataFrame) -> DataFrame:
    """Edges but loops, without those at nodes that have no way in or no way out, until there are none."""
    now, size = stage(edges.where("source <> target"), "edges"), -1
    unstage(edges)
    while True:
        count = now.count()
        if count in (0, size):
            return now
        size = count
        keep = now.join(now.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        new = stage(keep.join(now.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "edges")
        unstage(now)
        now = new


def cycles(edges: DataFrame, members: DataFrame, graph_kind: str) -> DataFrame:
    """``cycle_id, graph_kind, size, edge_count``: rows of edges inside each cycle count, whatever their own counts.

    Cycles are numbered by their least member.
    """
    m = stage(members, "members")
    inside = (
        edges.join(m.select(F.col("node").alias("source"), F.col("component").alias("c1")), "source")
        .join(m.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target").where("c1 = c2")
        .groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("edge_count"))
    )
    sizes = m.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    return numbered(sizes.join(inside, "component"), ["least"], "_n").select(F.concat(F.lit(f"{graph_kind}-cycle-"), "_n").alias("cycle_id"), F.lit(graph_kind).alias("graph_kind"), "least", "size", "edge_count")


def flag_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with ``is_cycle_edge``: whether their ends are in one cycle. A node is in one component at most.

    Members are staged and counted: up to BROADCAST_MEMBERS they are broadcast, so the edges stay where they are.
    """
    m = stage(members.select("node", "component").distinct(), "members")
    m = F.broadcast(m) if m.count() <= BROADCAST_MEMBERS else m
    of = lambda end, name: m.select(F.col("node").alias(end), F.col("component").alias(name))
    found = edges.join(of("source", "_c1"), "source", "left").join(of("target", "_c2"), "target", "left")
    return found.select(*edges.columns, F.coalesce(F.col("_c1") == F.col("_c2"), F.lit(False)).alias("is_cycle_edge"))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """``a, b``: where an edge leads from a node in a direction: incoming, outgoing or both."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return out.distinct() if direction == "outgoing" else back.distinct() if direction == "incoming" else out.union(back).distinct()


def reach(seeds: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """``seed, node, hops`` of all nodes that are reached from each seed (``seed, node``), the seeds' own at 0; breadth first, all seeds at once."""
    ways = stage(steps(edges, direction), "ways")
    visited = stage(seeds.select("seed", "node").distinct().withColumn("hops", F.lit(0)), "visited")
    front, hop = visited, 0
    while True:
        hop += 1
        seen = visited.select("seed", F.col("node").alias("b"))
        new = front.select("seed", F.col("node").alias("a")).join(ways, "a").select("seed", "b").distinct().join(seen, ["seed", "b"], "left_anti")
        front = stage(new.select("seed", F.col("b").alias("node"), F.lit(hop).alias("hops")), "front")
        if not front.limit(1).count():
            unstage(ways)
            return visited
        visited = visited.unionByName(front)


def impact_counts(seeds: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """``seed, impact``: how many nodes besides the seed's own are reached."""
    return reach(seeds, edges, direction).groupBy("seed").agg(F.sum((F.col("hops") > 0).cast("long")).alias("impact"))


def expand_seeds(selected: DataFrame, contains: DataFrame, symbols_on: bool = True, documents_on: bool = True) -> DataFrame:
    """``seed, node``: a document with the symbols that it contains, a symbol with the documents that contain it.

    ``selected``: ``seed, group``; ``contains``: ``source`` (document), ``target`` (symbol).
    """
    out = selected.select("seed", F.col("seed").alias("node"))
    if symbols_on:
        down = selected.where("group = 'document'").join(contains, F.col("seed") == F.col("source"))
        out = out.unionByName(down.select("seed", F.col("target").alias("node")))
    if documents_on:
        up = selected.where("group = 'symbol'").join(contains, F.col("seed") == F.col("target"))
        out = out.unionByName(up.select("seed", F.col("source").alias("node")))
    return out.distinct()


def map_seeds(selected: DataFrame, seeds: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """Seeds of a one-hop map: the selected node, and of the others those with a dependency in the direction."""
    has = steps(edges.where(is_dependency(F.col("kind"))), direction).select(F.col("a").alias("node")).distinct()
    return selected.select("seed", F.col("seed").alias("node")).unionByName(seeds.where("seed <> node").join(has, "node", "left_semi").select("seed", "node")).distinct()


def dependency_map(seeds: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """Dependency edges (``seed`` and the edge) that begin or end, by direction, at a node of the seed."""
    rows = edges.where(is_dependency(F.col("kind")))
    out = seeds.join(rows, F.col("node") == F.col("source")).drop("node")
    back = seeds.join(rows, F.col("node") == F.col("target")).drop("node")
    return (out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)).distinct()


def neighbours(edges_of_seeds: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, peer, direction, weight, kind``: each node beyond a seed's own, with all weight between and the most telling kind.

    Edges with both or no ends among the seed's nodes are skipped.
    """
    s = seeds.select("seed", F.col("node").alias("source"), F.lit(True).alias("from_seed"))
    t = seeds.select("seed", F.col("node").alias("target"), F.lit(True).alias("to_seed"))
    one = edges_of_seeds.join(s, ["seed", "source"], "left").join(t, ["seed", "target"], "left").where("coalesce(from_seed, false) <> coalesce(to_seed, false)")
    out = F.coalesce("from_seed", F.lit(False))
    rows = one.select("seed", F.when(out, F.col("target")).otherwise(F.col("source")).alias("peer"), out.alias("out"), F.greatest(F.lit(1), "weight").alias("weight"), "kind")
    both = F.when(F.min("out") != F.max("out"), "both").when(F.max("out"), "outgoing").otherwise("incoming")
    return rows.groupBy("seed", "peer").agg(both.alias("direction"), F.sum("weight").alias("weight"), F.min_by("kind", F.struct(kind_rank(F.col("kind")), "kind")).alias("kind"))


def clusters(placed: DataFrame, context: DataFrame) -> DataFrame:
    """``seed, direction, context, members, weight, kind``: neighbours by direction and by what they belong to (``peer, context``)."""
    rows = placed.join(context, "peer", "left").withColumn("context", F.coalesce("context", F.concat(F.lit("external:"), "peer")))
    return rows.groupBy("seed", "direction", "context").agg(F.count("*").alias("members"), F.sum("weight").alias("weight"), F.min_by("kind", F.struct(kind_rank(F.col("kind")), "kind")).alias("kind"))


def ownership(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """``node, document, project``: what contains a node, one and two levels up; of several containers the last by ordinal.

    ``contains``: ``source, target, kind, ordinal`` of containment edges.
    """
    last = contains.groupBy(F.col("target").alias("node"), "kind").agg(F.max_by("source", F.struct("ordinal", "source")).alias("owner"))
    docs = last.where("kind = 'contains-symbol'").select("node", F.col("owner").alias("document"))
    tops = last.where("kind = 'contains-document'").select("node", F.col("owner").alias("project"))
    of = nodes.select("node").distinct().join(docs, "node", "left").join(tops, "node", "left")
    upper = tops.select(F.col("node").alias("document"), F.col("project").alias("above"))
    return of.join(upper, "document", "left").select("node", "document", F.coalesce("project", "above").alias("project"))


def ownership_graph(nodes: DataFrame, contains: DataFrame, shown: DataFrame, projects: bool = True) -> tuple[DataFrame, DataFrame]:
    """The visible context of nodes (``node, group``): rows ``node`` and rows ``source, target, kind`` of containment edges.

    A symbol brings the documents that contain it and, if projects are shown, their projects; a
    document its projects. Containers and edges count where they are shown: ``shown`` has the nodes
    (``node``), ``contains`` the edges (``source, target, kind``) that are not hidden.
    """
    to = contains.select("source", "target", "kind").distinct().join(shown.select(F.col("node").alias("source")).distinct(), "source", "left_semi")
    within = lambda kind: to.where(F.col("kind") == kind).select("source", "target", "kind")
    of = lambda group: nodes.where(F.col("group") == group).select(F.col("node").alias("target")).distinct()
    edges = within("contains-symbol").join(of("symbol"), "target", "left_semi").select("source", "target", "kind")
    if projects:
        documents = edges.select(F.col("source").alias("target")).unionByName(of("document")).distinct()
        edges = edges.unionByName(within("contains-document").join(documents, "target", "left_semi").select("source", "target", "kind"))
    return edges.select(F.col("source").alias("node")).distinct(), edges


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: visible nodes and edges, symbols, isolated nodes, components, the largest component, mean degree."""
    parts = connected_components(edges, "source", "target")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    linked = sizes.agg(F.count("*").alias("c"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("linked"))
    n = nodes.agg(F.count("*").alias("node_count"), F.coalesce(F.sum((F.col("group") == "symbol").cast("long")), F.lit(0)).alias("symbol_count"))
    e = edges.agg(F.count("*").alias("edge_count"))
    lone = edges.where("source <> target").select(F.col("source").alias("x")).union(edges.where("source <> target").select("target")).distinct().agg(F.count("*").alias("with_edge"))
    return beside(n, e, linked, lone).select(
        "node_count", "edge_count", "symbol_count", (F.col("node_count") - F.col("with_edge")).alias("isolated_count"),
        (F.col("c") + F.col("node_count") - F.col("linked")).alias("component_count"),
        F.greatest("largest", F.when(F.col("node_count") > 0, 1).otherwise(0)).alias("largest_component"),
        F.when(F.col("node_count") > 0, 2 * F.col("edge_count") / F.col("node_count")).otherwise(0.0).alias("average_degree"),
    )


def layout_choice(m: DataFrame) -> DataFrame:
    """The name of the layout for the metrics of a graph."""
    n, e = F.col("node_count"), F.col("edge_count")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0)
    giant, lone = share("largest_component"), share("isolated_count")
    name = (
        F.when(e == 0, "structured-massive").when((n <= 160) & (F.col("average_degree") <= 2.2) & (giant >= 0.75), "breadthfirst")
        .when((F.col("component_count") >= 16) & (giant < 0.45), "structured-massive").when((n >= 2200) & (lone >= 0.7), "structured-massive")
        .when((n >= 900) & (giant >= 0.6), "cose").otherwise("semantic-flow")
    )
    return m.select(name.alias("layout"))


def performance_mode(m: DataFrame) -> DataFrame:
    n, e = F.col("node_count"), F.col("edge_count")
    return m.select(F.when((n >= 1800) | (e >= 6200), "massive").when((n >= 900) | (e >= 2600), "large").otherwise("normal").alias("mode"))


def needs_layout(before: DataFrame, now: DataFrame, positioned: DataFrame) -> DataFrame:
    """One row ``relayout``: whether at least max(12, 18 % of the larger of before and now) nodes are new, or one has no position."""
    new = now.join(before, "node", "left_anti").agg(F.count("*").alias("new"))
    bare = now.join(positioned, "node", "left_anti").agg(F.count("*").alias("bare"))
    sizes = beside(before.agg(F.count("*").alias("b")), now.agg(F.count("*").alias("n")), new, bare)
    limit = F.greatest(F.lit(12), F.floor(F.greatest("b", "n") * 0.18))
    return sizes.select(((F.col("new") >= limit) | (F.col("bare") > 0)).alias("relayout"))


def layers(nodes: DataFrame, edges: DataFrame, members: DataFrame, label: str = "label") -> DataFrame:
    """``node, label, layer``: the longest way from a node without predecessors, nodes of one cycle in one layer.

    If all stand in layer 0 and there are more than six, they are cut by label into layers of ceil(sqrt(n)).
    """
    top = nodes.select("node", label).join(members.select("node", "component"), "node", "left").select("node", F.col(label).alias("label"), F.coalesce("component", "node").alias("group"))
    top = stage(top, "groups")
    of = top.select("node", "group")
    dag = stage(
        edges.join(of.select(F.col("node").alias("source"), F.col("group").alias("a")), "source").join(of.select(F.col("node").alias("target"), F.col("group").alias("b")), "target")
        .where("a <> b").select("a", "b").distinct(),
        "dag",
    )

    def step(s: DataFrame) -> DataFrame:
        up = dag.join(s.select(F.col("group").alias("a"), "layer"), "a").groupBy(F.col("b").alias("group")).agg((F.max("layer") + 1).alias("up"))
        return s.join(up, "group", "left").select("group", F.greatest("layer", "up").alias("layer"), (F.col("up") > F.col("layer")).alias("moved"))

    found = until_settled(top.select("group").distinct().withColumn("layer", F.lit(0)), step)
    out = top.join(found, "group").select("node", "label", "layer")
    flat = out.agg(F.max("layer").alias("most"), F.count("*").alias("n")).first()
    if flat["most"] == 0 and flat["n"] > 6:
        size = int(-(-(flat["n"] ** 0.5) // 1))
        out = numbered(out, [F.lower("label"), "label", "node"], "_n").withColumn("layer", F.floor((F.col("_n") - 1) / size).cast("int")).select("node", "label", "layer")
    return out


def order_layers(placed: DataFrame, weights: DataFrame, sweeps: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """``node, layer, seat``: nodes of a layer by the weighted mean seat of their neighbours in the layer before, then in the one after, in turn.

    Nodes without such neighbours come last; ties by label. ``weights``: ``a, b, weight``. Layers
    wider than ``key_rows`` are seated by ranges of their order, so that no layer is one task.
    """
    widest = largest_key(placed, ["layer"])
    seat = lambda df, order: places(df, ["layer"], order, "seat", "_n", widest, key_rows).drop("_n")
    by_label = [F.lower("label"), F.col("label"), F.col("node")]
    now = stage(seat(placed, by_label), "seats")
    both = weights.select("a", "b", "weight").unionByName(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = stage(both, "weights")
    for sweep in range(2 * sweeps):
        side = -1 if sweep % 2 == 0 else 1
        near = (
            now.select(F.col("node").alias("a"), "layer").join(both, "a")
            .join(now.select(F.col("node").alias("b"), (F.col("layer") - side).alias("layer"), "seat"), ["b", "layer"])
            .groupBy(F.col("a").alias("node")).agg((F.sum(F.col("weight") * F.col("seat")) / F.sum("weight")).alias("mean"))
        )
        new = stage(seat(now.drop("seat").join(near, "node", "left"), [F.asc_nulls_last("mean"), *by_label]).drop("mean"), "seats")
        unstage(now)
        now = new
    unstage(both)
    return now.select("node", "layer", "seat")
