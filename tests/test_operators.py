import random

import pytest
from pyspark.sql import functions as F

from depweave.functions import ids
from depweave.operators import edges as E
from depweave.operators import layout as L
from depweave.operators import payload as P
from depweave.operators import ranked as K
from depweave.operators import resolve as S
from depweave.operators import rollup as R
from depweave.operators import view as V
from depweave.plans import carry
from tests.conftest import rows

OBS = "ordinal long, source_document_id string, source_symbol_key string, target_symbol_key string, reference_kind string, confidence string, file string, line int, snippet string"
DECL = "symbol_key string, symbol_id string, document_id string, ordinal long"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_edges(spark):
    decl = spark.createDataFrame([("t", "T1", "d1", 2), ("t", "T0", "d2", 1), ("s", "S", "d1", 1), ("s", "S9", "d9", 9)], DECL)
    obs = spark.createDataFrame([
        (1, "d1", "s", "t", None, None, " ", 0, ""), (2, "d1", "s", "t", " CALL", None, "f", 3, "x"), (3, "d1", "s", "t", "call", "high", "g", 4, "y"),
        (4, "d1", None, "t", None, None, None, None, None), (5, "d1", "s", "gone", None, None, None, None, None), (6, "d9", "s", "s", None, None, None, None, None), (7, "d9", "s", "t", "call", "high", None, None, None),
    ], OBS)
    assert rows(E.document_edges(obs, decl)) == sorted([("d1", "d2", 4, "f", 3, "x"), ("d9", "d1", 2, None, None, None), ("d9", "d2", 1, None, None, None)], key=repr)
    got = rows(E.symbol_edges(obs, decl))
    assert ("S", "T0", "call", "high", 2, "f", 3, "x") in got and ("S", "T0", "reference", "high", 1, None, None, None) in got
    assert ("S9", "T0", "call", "high", 1, None, None, None) in got
    assert ("S9", "S", "reference", "high", 1, None, None, None) in got


def test_merge_adds_counts_and_dedupe_drops_weights(spark):
    e = "source string, target string, reference_count long, sample_file string, sample_line int, sample_snippet string"
    a = spark.createDataFrame([("x", "y", 2, None, None, None), ("p", "q", 1, "A", 1, "a"), ("z", "z", 0, None, None, None)], e)
    b = spark.createDataFrame([("x", "y", 3, "B", 2, "b"), ("p", "q", 1, "B", 2, "b")], e)
    assert rows(E.merge_edges(a, b)) == [("p", "q", 2, "A", 1, "a"), ("x", "y", 5, "B", 2, "b")]
    raw = spark.createDataFrame([("x", "y", "k", 2, None, None, "1"), ("x", "y", "k", 5, None, None, "2")], "source string, target string, kind string, weight long, reference_kind string, confidence string, ordinal string")
    assert rows(P.edges(raw), "id", "weight") == [("edge:k:x->y", 2)]


def test_dominant_kind_tie(spark):
    k = spark.createDataFrame([("a", "b", x) for x in ("reference", "call", "call", "reference")], "source string, target string, reference_kind string")
    assert rows(E.dominant_kind(k)) == [("a", "b", "call", 4)]


def test_cap_counts_repeats(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "symbol_id string, ordinal long")
    assert rows(P.capped_symbols(s, 3), "symbol_id", "rank") == [("a", 1), ("a", 2), ("b", 3)]
    assert rows(P.capped_symbols(s, -1)) == []


def test_ids(spark):
    assert one(spark, ids.node_id("package", F.lit("Newtonsoft.Json")))[0] != one(spark, ids.node_id("package", F.lit("Newtonsoft.Json ")))[0]
    assert one(spark, ids.normalize(F.lit(" "))) == ("empty_00000000",)
    assert one(spark, ids.node_id("dll", F.lit("")))[0].startswith("dll:empty_")
    assert one(spark, ids.identifier_fragment(F.lit("A.b_C-d!"))) == ("a_b_cd",)
    assert one(spark, ids.identifier_fragment(F.lit("!!"))) == ("symbol",)
    assert one(spark, ids.project_key(F.lit("/a/b/"), F.lit("x"), F.lit("y")), ids.project_key(F.lit(" "), F.lit(" x "), F.lit("y")), ids.project_key(F.lit(None).cast("string"), F.lit(""), F.lit(""))) == ("/a/b", "id:x", "name:project")
    assert one(spark, ids.snippet(F.lit("x" * 181))) == ("x" * 177 + "...",)
    assert one(spark, ids.edge_id(F.lit("k"), F.lit("s"), F.lit("t"), F.lit(None).cast("string"), F.lit("High"))) == ("edge:k:none:high:s->t",)
    assert one(spark, ids.parse_imports(F.lit("zeta, alpha,,Beta,BETA")))[0] == ["alpha", "Beta", "zeta"]
    assert one(spark, ids.native_label(F.lit("k.dll"), F.lit("DllImport"), F.array(*map(F.lit, "abc")))) == ("k.dll [DllImport: a, b +1 more]",)
    assert one(spark, ids.reference_label(F.lit("/x/App.csproj"), F.lit(" ")), ids.reference_label(F.lit("name:Q"), F.lit(None).cast("string"))) == ("App", "Q")
    names = {n: one(spark, ids.ignored_directory(F.lit(n)))[0] for n in ("bin", "OBJ", "Third_Party", "CMAKE-BUILD-Release", "  bin  ", "cmake_build_debug", "vendorized", "package", "")}
    assert [n for n, v in names.items() if not v] == ["cmake_build_debug", "vendorized", "package", ""]
    assert one(spark, ids.lookup_names(F.lit("A::B"), F.lit("f")))[0] == ["A::B::f", "A::f", "f"]


def test_case_order(spark):
    n = spark.createDataFrame([("k", "_", 1), ("k", "a", 2), ("k", "Z", 3), ("k", "A", 4)], "key string, name string, ordinal long")
    assert [r["name"] for r in E.distinct_names(n, ["key"]).collect()] == ["a", "Z", "_"]


def test_ranges(spark):
    r = spark.createDataFrame([("d", "outer", 1, 1000, 0), ("d", "inner", 10, 20, 1), ("d", "far", 2000, 2100, 2)], "document_id string, symbol_id string, start int, end int, idx int")
    q = spark.createDataFrame([(i, "d", line) for i, line in enumerate([1, 10, 20, 21, 1000, 1500, 2050])], "ref_id int, document_id string, line int")
    assert [x[3] for x in rows(S.enclosing_ranges(q, r))] == ["outer", "inner", "inner", "outer", "outer", "far"]


def test_handles(spark):
    loads = spark.createDataFrame([("d", "h", 3, "one"), ("d", "H", 7, "two"), ("e", "h", 1, "three")], "document_id string, handle string, line int, library string")
    calls = spark.createDataFrame([(1, "d", "h", 2), (2, "d", "H", 3), (3, "d", "h", 6), (4, "d", "h", 9)], "call_id int, document_id string, handle string, line int")
    assert rows(S.handle_libraries(calls, loads), "call_id", "library") == [(2, "one"), (3, "one"), (4, "two")]


def test_tiers(spark):
    c = "ref int, ref_document string, ref_line int, ref_key string, document_id string, line int, is_definition boolean, key string"
    data = [
        (1, "d", 50, "me", "d", 10, True, "a"), (1, "d", 50, "me", "d", 40, True, "b"), (1, "d", 50, "me", "d", 45, True, "me"), (1, "d", 50, "me", "d", 60, True, "c"),
        (2, "d", 5, "me", "d", 60, True, "a"), (2, "d", 5, "me", "d", 40, False, "b"), (3, "d", 5, "me", "f", 9, True, "a"), (3, "d", 5, "me", "e", 9, True, "b"), (3, "d", 5, "me", "a", 1, False, "c"), (4, "d", 5, "me", "z", 1, False, "a"),
    ]
    assert rows(S.preferred(spark.createDataFrame(data, c), ["ref"]), "ref", "tier", "key") == [(1, 1, "b"), (2, 2, "b"), (3, 3, "b"), (4, 4, "a")]


def test_scopes(spark):
    sym = spark.createDataFrame([("k1", "A::B::f", "x", 1, True), ("k2", "A::f", "x", 2, True), ("k3", "f", "x", 3, True), ("k4", "Z::g", "x", 4, True)], "key string, qualified_name string, document_id string, line int, is_definition boolean")
    refs = spark.createDataFrame([(1, "f", "A::B::C", "d", 9, "s"), (2, "f", "", "d", 9, "s"), (3, "g", "A", "d", 9, "s"), (4, "B::f", "A", "d", 9, "s")], "ref_id int, token string, scope string, ref_document string, ref_line int, ref_key string")
    assert rows(S.resolve_scoped(refs.withColumn("namespace_scope", F.col("scope")), sym), "ref_id", "key") == [(1, "k1"), (2, "k3"), (3, "k4"), (4, "k1")]


def test_qualified_names_go_through_namespaces_and_simple_ones_through_all_scopes(spark):
    sym = spark.createDataFrame(
        [("inner", "A::T::X::f", "x", 1, True), ("outer", "A::X::f", "x", 2, True), ("member", "A::T::m", "x", 3, True), ("free", "A::m", "x", 4, True), ("far", "Q::R::z", "x", 5, True)],
        "key string, qualified_name string, document_id string, line int, is_definition boolean",
    )
    refs = spark.createDataFrame([(1, "X::f"), (2, "m"), (3, "N::z"), (4, "N::none")], "ref_id int, token string").selectExpr("*", "'A::T' AS scope", "'A' AS namespace_scope", "'d' AS ref_document", "9 AS ref_line", "'s' AS ref_key")
    # The last but one is found by its simple name, although it is qualified.
    assert rows(S.resolve_scoped(refs, sym), "ref_id", "key") == [(1, "outer"), (2, "member"), (3, "far")]


def test_candidates_of_a_name_that_all_have(spark):
    """The bounded candidates hold the preferred one of all."""
    rng = random.Random(6)
    sym = [(f"k{rng.randrange(60)}", "n", f"d{rng.randrange(8)}", rng.randrange(50), rng.random() < 0.5) for _ in range(200)]
    refs = [(i, "n", "", "", f"d{rng.randrange(9)}", rng.randrange(50), f"k{rng.randrange(70)}") for i in range(40)]
    s = spark.createDataFrame(sym, "key string, qualified_name string, document_id string, line int, is_definition boolean")
    r = spark.createDataFrame(refs, "ref_id int, token string, scope string, namespace_scope string, ref_document string, ref_line int, ref_key string")
    want = S.preferred(r.crossJoin(s), ["ref_id"])
    assert rows(S.resolve_scoped(r, s), "ref_id", "key", "document_id", "line") == rows(want, "ref_id", "key", "document_id", "line")


def test_fallback_source(spark):
    refs = spark.createDataFrame([(1, "d", 5, "u"), (2, "d", 12, None), (3, "d", 30, None)], "ref_id int, document_id string, line int, usr string")
    decl = spark.createDataFrame([("u", "d", 3, "A"), ("u", "d", 9, "B"), ("v", "d", 25, "C")], "usr string, document_id string, line int, symbol_id string")
    ranges = spark.createDataFrame([("d", "R", 10, 15, 0)], "document_id string, symbol_id string, start int, end int, idx int")
    assert rows(S.fallback_source(refs, decl, ranges)) == [(1, "A"), (2, "R"), (3, "C")]


def test_includes(spark):
    inc = spark.createDataFrame([(1, "p", "/own", "a.h", True), (2, "p", "/own", "a.h", False), (3, "p", "/own", "/r/x.h", False), (4, "p", "/own", "no.h", True)], "include_id int, project string, own_directory string, target string, quoted boolean")
    dirs = spark.createDataFrame([("p", "/two", 2), ("p", "/one", 1)], "project string, directory string, ordinal int")
    files = spark.createDataFrame([(x,) for x in ("/own/a.h", "/one/a.h", "/two/a.h", "/r/x.h")], "path string")
    assert rows(S.first_match(inc, dirs, files)) == [(1, "/own/a.h"), (2, "/one/a.h"), (3, "/r/x.h")]


def test_view(spark):
    nodes = spark.createDataFrame([("p", "P", "project", None, True), ("s", "Sym", "symbol", None, False), ("d", "Doc", "document", None, True)], "id string, label string, group string, symbol_kind string, is_in_cycle boolean")
    assert rows(V.visible_nodes(nodes, V.View()), "id") == [("d",), ("p",)]
    assert rows(V.visible_nodes(nodes, V.View(symbols=True, hidden_kinds=frozenset({"Unknown"}))), "id") == [("d",), ("p",)]
    assert rows(V.visible_nodes(nodes, V.View(symbols=True, cycles_only=True), nodes.where("id = 'd'")), "id") == [("p",)]
    assert rows(V.graph_search(nodes, " SYM ")) and not rows(V.graph_search(nodes, " "))
    edges = spark.createDataFrame([("p", "d", "contains-document"), ("d", "s", "contains-symbol"), ("d", "d", "document-reference")], "source string, target string, kind string")
    assert rows(V.visible_edges(edges, V.visible_nodes(nodes, V.View(document_dependencies=False)), V.View(document_dependencies=False)), "kind") == [("contains-document",)]
    focus = V.View(cycles_only=True, document_dependencies=False).focused("symbol", "Class")
    assert focus.symbols and not focus.cycles_only and focus.document_dependencies
    assert V.direction("x") == "both" and V.direction("incoming") == "incoming"
    assert rows(V.search_edges(edges, nodes.where("id = 's'")), "kind", "dimmed") == [("contains-document", True), ("contains-symbol", False), ("document-reference", True)]


def test_rollup_and_bias(spark):
    e = spark.createDataFrame([("a1", "b1", "symbol-call", 2), ("a1", "a2", "symbol-call", 9), ("a1", "b1", "contains-symbol", 9)], "source string, target string, kind string, weight long")
    own = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")], "node string, owner string")
    got = R.rolled_up(e, own, R.PROJECT)
    assert [(a, b, float(w)) for a, b, w in rows(got)] == [("A", "B", 6.4)]
    layers = spark.createDataFrame([("A", 0), ("B", 3), ("C", 1)], "node string, layer int")
    assert rows(R.flow_bias(got, layers)) == [("A", 1.0), ("B", -1.0), ("C", 0.0)]
    assert [(n, float(x)) for n, x in rows(R.importance(got))] == [("A", 6.4), ("B", 6.4)]
    assert [(n, float(x)) for n, x in rows(R.document_importance(got, spark.createDataFrame([("A",), ("C",)], "document_id string")))] == [("A", 6.75), ("B", 6.4), ("C", 0.35)]


def test_windows(spark):
    s = spark.createDataFrame([("u", i, x) for i, x in enumerate("aabba")], "user string, n int, state string")
    assert rows(K.without_repeats(s, "user", ["n"], "state"), "n") == [(0,), (2,), (4,)]
    many = spark.range(100).selectExpr("id % 2 as workspace", "id as snapshot_id")
    assert K.retained(many).count() == 40 and rows(K.latest(many)) == [(0, 98), (1, 99)]
    capped = K.capped_sections(many, ["workspace"], ["snapshot_id"], 30)
    assert capped.count() == 60 and capped.select("omitted").distinct().first()[0] == 20


def test_layouts(spark):
    n = spark.createDataFrame([(1, 0.2, 0.0), (2, 0.1, 0.0), (3, 9.0, 9.0)], "id int, x double, y double")
    assert rows(L.spread(n, ["id"])) == [(1, 0.2 - 86.0, 0.0), (2, 0.2 + 86.0, 0.0), (3, 9.0, 9.0)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 40.0), (2, 90.0, 0.0, 100.0, 40.0)], "id int, x double, y double, w double, h double")
    moved = {r["id"]: r["x"] for r in L.relaxed(boxes, passes=3).collect()}
    assert moved[2] - moved[1] >= 99.0
    nodes = spark.createDataFrame([("a", "c", 0.0, 0.0), ("b", "c", 0.0, 0.0), ("l", "l", 5.0, 5.0)], "id string, component string, x double, y double")
    links = spark.createDataFrame([("c", "a", "b", 1)], "component string, source string, target string, weight long")
    once, again = rows(L.forces(nodes, links)), rows(L.forces(nodes, links))
    assert once == again and len(once) == 3


def test_numbering(spark):
    from depweave.plans.numbering import numbered

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7)
    got = [(r["x"], r["n"]) for r in numbered(df, ["x"], "n").collect()]
    assert len(got) == 1000 and all(n == x + 1 for x, n in got)


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in several ranges, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_carried_over_ranges(spark, many_ranges):
    """A key of most rows is dealt over tasks, and every value arrives."""
    rng = random.Random(7)
    data = [(None if k % 50 == 3 else "hot" if k % 3 else f"k{k % 40}", k, rng.choice([None, None, None, rng.randrange(1000)])) for k in range(6000)]
    df = spark.createDataFrame(data, "key string, at int, value int").repartition(5)
    for inclusive, key_rows in ((True, 0), (False, 0), (True, 10_000), (False, 10_000)):
        last, want = {}, {}
        for key, at, value in data:
            if not inclusive:
                want[at] = last.get(key)
            if value is not None:
                last[key] = value
            if inclusive:
                want[at] = last.get(key)
        got = {r["at"]: r["out"] for r in carry.carried(df, ["key"], ["at"], "value", "out", inclusive, key_rows).collect()}
        assert got == want
    down, seen = {}, {}
    for key, at, value in reversed(data):
        seen[key] = value if value is not None else seen.get(key)
        down[at] = seen[key]
    assert {r["at"]: r["out"] for r in carry.carried(df, ["key"], [F.col("at").desc()], "value", "out", key_rows=0).collect()} == down
    # Values that stand in one range only reach the end of a key that goes on over all others.
    lone = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("at"), F.when(F.col("id") == 2, 5).alias("value"))
    assert [tuple(r) for r in carry.carried(lone, ["key"], ["at"], "value", "out", key_rows=0).groupBy("out").count().orderBy("out").collect()] == [(None, 2), (5, 3998)]
    ranges = [r["count"] for r in carry.ranged(df, ["key"], ["at"]).groupBy("_p").count().collect()]
    assert len(ranges) >= 3 and max(ranges) < 0.5 * len(data)
    assert carry.carried(df.limit(0), ["key"], ["at"], "value", "out", key_rows=-1).count() == 0
