import random

import pytest

from depweave.operators import graph as G
from depweave.operators.components import connected_components
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string") if pairs else spark.createDataFrame([], "source string, target string")


def brute_cycles(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            for m in list(reach[n]):
                reach[n] |= reach[m]
    return {frozenset(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)]
    found = {}
    for node, part in rows(G.components_of_cycles(edges(spark, pairs))):
        found.setdefault(part, set()).add(node)
    assert {frozenset(x) for x in found.values()} == brute_cycles(pairs)


def test_cycle_edges_count_rows_not_weights(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (" ", "a"), ("d", "e"), ("e", "d")])
    members = G.components_of_cycles(e)
    got = rows(G.cycles(e, members, "project"), "cycle_id", "least", "size", "edge_count")
    assert got == [("project-cycle-1", "a", 3, 4), ("project-cycle-2", "d", 2, 2), ("project-cycle-3", "x", 1, 1)]
    flags = dict(((s, t), f) for s, t, f in rows(G.flag_cycles(e, members)))
    assert flags["a", "b"] and not flags["c", "d"] and flags["x", "x"]


def test_no_edges(spark):
    assert rows(G.components_of_cycles(edges(spark, []))) == []
    assert rows(connected_components(edges(spark, []), "source", "target")) == []


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", "z"), ("y", None)])
    parts = dict(rows(connected_components(e, "source", "target")))
    assert set(parts.values()) == {"n000", "z"} and len(parts) == 42


def test_reach_and_impact(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("x", "c")])
    seeds = spark.createDataFrame([("a", "a"), ("x", "x")], "seed string, node string")
    assert rows(G.reach(seeds, e, "outgoing")) == sorted([("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("x", "x", 0), ("x", "c", 1), ("x", "a", 2), ("x", "b", 3), ("x", "d", 3)], key=repr)
    assert rows(G.impact_counts(seeds, e, "incoming")) == [("a", 4), ("x", 0)]


def test_layers(spark):
    nodes = spark.createDataFrame([(x, x) for x in "abcde"], "node string, label string")
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d")])
    got = dict((n, k) for n, _, k in rows(G.layers(nodes, e, G.components_of_cycles(e))))
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    flat = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(9)], "node string, label string")
    none = edges(spark, [])
    assert sorted(k for _, _, k in rows(G.layers(flat, none, G.components_of_cycles(none)))) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_neighbours_skip_edges_within_the_seed(spark):
    e = spark.createDataFrame([("s", "p", "symbol-call", 2), ("p", "s", "document-reference", 0), ("s", "t", "symbol-call", 9), ("q", "t", "symbol-creation", 1)], "source string, target string, kind string, weight long")
    seeds = spark.createDataFrame([("s", "s"), ("s", "t")], "seed string, node string")
    got = rows(G.neighbours(G.dependency_map(seeds, e, "both"), seeds))
    assert got == [("s", "p", "both", 3, "symbol-call"), ("s", "q", "incoming", 1, "symbol-creation")]


def test_layout_choice_and_mode(spark):
    m = "node_count long, edge_count long, isolated_count long, component_count long, largest_component long, average_degree double"
    cases = [((10, 0, 10, 10, 1, 0.0), "structured-massive"), ((100, 90, 0, 1, 100, 1.8), "breadthfirst"), ((200, 100, 0, 20, 20, 1.0), "structured-massive"), ((3000, 900, 2400, 2, 2000, 0.6), "structured-massive"), ((900, 5000, 0, 1, 900, 11.1), "cose"), ((300, 900, 0, 1, 300, 6.0), "semantic-flow")]
    for values, name in cases:
        assert rows(G.layout_choice(spark.createDataFrame([values], m))) == [(name,)]
    assert rows(G.performance_mode(spark.createDataFrame([(900, 0, 0, 0, 0, 0.0)], m))) == [("large",)]
    assert rows(G.performance_mode(spark.createDataFrame([(1, 6200, 0, 0, 0, 0.0)], m))) == [("massive",)]


def test_seats_of_random_layers(spark):
    """Against layers that are seated one after the other, and by ranges as by windows."""
    rng = random.Random(12)
    placed = [(f"n{k}", rng.choice(["a", "B", "b", "c", f"x{k}"]), k % 4) for k in range(60)]
    weights = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(1, 9)) for _ in range(150)]
    layer = {n: l for n, _, l in placed}
    both = {}
    for a, b, w in weights:
        both[a, b] = both.get((a, b), 0) + w
        both[b, a] = both.get((b, a), 0) + w

    def seated(key):
        out = {}
        for l in range(4):
            for seat, (n, _, _) in enumerate(sorted((p for p in placed if p[2] == l), key=lambda p: (*key(p), p[1].lower(), p[1], p[0])), 1):
                out[n] = seat
        return out

    now = seated(lambda p: ())
    for sweep in range(6):
        side = -1 if sweep % 2 == 0 else 1

        def mean(p, now=now, side=side):
            near = [(w, now[b]) for (a, b), w in both.items() if a == p[0] and layer[b] == p[2] + side]
            return (not near, sum(w * s for w, s in near) / sum(w for w, _ in near) if near else 0)

        now = seated(mean)
    df = spark.createDataFrame(placed, "node string, label string, layer int").repartition(3)
    pairs = spark.createDataFrame(weights, "a string, b string, weight int")
    for key_rows in (1000, 5):
        assert {r["node"]: r["seat"] for r in G.order_layers(df, pairs, key_rows=key_rows).collect()} == now
