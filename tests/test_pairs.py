"""Edges between documents, from packed lists of those that declare what others observe."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.operators import arrange as A
from depweave.operators import edges as E
from depweave.operators import graph as G
from depweave.operators import pairs as P
from depweave.operators import payload as Y
from depweave.operators import rollup as R
from depweave.operators import view as V

from .conftest import rows

IDS = ["d1", "d2", "d10", "d01", "d0", "d", "", "7", "007", "x9y", "d123456789012345678", "d1234567890123456789", "é3", "d1\n4", "e5", "e6"]


def shuffled(spark, df):
    """Bytes that df writes for other tasks."""
    def written():
        found = spark._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def hot(spark):
    """400 documents that observe what 5000 declare."""
    seen = spark.range(400).select(F.concat(F.lit("a"), "id").alias("source_document_id"), F.lit("k").alias("target_symbol_key"), F.lit("call").alias("reference_kind"), F.col("id").alias("ordinal"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("s").alias("snippet"))
    return seen, spark.range(5000).select(F.lit("k").alias("symbol_key"), F.concat(F.lit("b"), "id").alias("document_id"), F.col("id").alias("ordinal"))


def some(spark, seed=3):
    rng = random.Random(seed)
    declared = [(rng.choice("klmn"), rng.choice([*IDS, None]), 0) for _ in range(60)] + [("m", f"z{i}", 0) for i in range(300)] + [(None, "d1", 0), ("q", "d1", 0)]
    seen = [(rng.choice([*IDS, None]), rng.choice(["k", "l", "m", "n", "o", None]), rng.choice(["Call", "call", "use", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, " ", "f", "g"]), rng.choice([None, 0, 1, 2]), rng.choice([None, "", "s", "t"])) for _ in range(400)]
    return seen, declared, (
        spark.createDataFrame(seen, "source_document_id string, target_symbol_key string, reference_kind string, ordinal long, file string, line int, snippet string"),
        spark.createDataFrame(declared * 2, "symbol_key string, document_id string, ordinal long"),
    )


@pytest.fixture(params=[None, (64, 3)])
def parts(request, spark, monkeypatch):
    """Also with a few pairs and rows at a time."""
    if request.param:
        monkeypatch.setattr(P, "PAIRS", request.param[0])
        monkeypatch.setattr(P, "ROWS", request.param[1])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def pairs(seen, declared):
    of = {}
    for key, doc, _ in set(declared):
        of.setdefault(key, []).append(doc)
    return [(s, doc, *rest) for s, key, *rest in seen if key is not None for doc in of.get(key, ())]


def test_lists_come_back():
    rng = random.Random(1)
    lists = [sorted(rng.sample(range(10 ** rng.randrange(1, 18)), rng.randrange(1, 9))) for _ in range(200)] + [[0], [999_999_999_999_999_999]]
    sizes = [len(x) for x in lists]
    data, offsets = P.packed(np.array(sum(lists, []), np.int64), np.append(0, np.cumsum(sizes))[:-1])
    numbers, found = P.unpacked(data, offsets)
    assert found.tolist() == sizes and numbers.tolist() == sum(lists, [])


def test_document_edges_of_any_ids(spark, parts):
    seen, declared, (obs, decl) = some(spark)
    want = Counter((s, t) for s, t, *_ in pairs(seen, declared) if s is not None and t is not None and s != t)
    assert rows(E.document_edges(obs, decl, samples=False)) == sorted(((s, t, n) for (s, t), n in want.items()), key=repr)
    assert rows(E.document_edges(obs, decl), "source", "target", "reference_count") == sorted(((s, t, n) for (s, t), n in want.items()), key=repr)
    assert E.document_edges(obs.limit(0), decl, samples=False).count() == E.document_edges(obs, decl.limit(0)).count() == 0


def test_no_pair_of_documents_is_shuffled(spark):
    seen, declared = hot(spark)
    found = E.document_edges(seen, declared, samples=False)
    assert found.count() == 2_000_000 and shuffled(spark, found) < 4_000_000


def test_first_samples_of_any_ids(spark, parts):
    seen, declared, (obs, decl) = some(spark)
    best = {}
    for s, t, _, at, file, line, text in pairs(seen, declared):
        file, line, text = file if file and file.strip() else None, line if line and line > 0 else None, text or None
        if s is None or t is None or s == t or (file, line, text) == (None, None, None):
            continue
        rank = tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in (at, text, file, line))
        if (s, t) not in best or rank < best[s, t][0]:
            best[s, t] = rank, (file, line, text)
    got = {(r["source"], r["target"]): (r["sample_file"], r["sample_line"], r["sample_snippet"]) for r in E.document_edges(obs, decl).collect()}
    assert {k for k, v in got.items() if v != (None, None, None)} == set(best) and all(got[k] == v[1] for k, v in best.items())


def test_samples_are_not_shuffled_by_pair(spark):
    found = E.document_edges(*hot(spark))
    assert found.where("sample_file = 'f' and sample_line = 1").count() == 2_000_000 and shuffled(spark, found) < 6_000_000


def test_merged_origins_are_not_shuffled_by_pair(spark, parts):
    """The first origin's samples go before, whatever their ordinals."""
    seen, declared, (obs, decl) = some(spark, 5)
    odd = F.when(F.col("reference_kind") == "use", 0).otherwise(1)
    both = E.merge_edges(E.document_edges(obs.where("reference_kind = 'use'"), decl), E.document_edges(obs.where("reference_kind is null or reference_kind <> 'use'"), decl))
    assert rows(E.document_edges(obs, decl, odd)) == rows(both)
    found = E.document_edges(*hot(spark), origin=F.col("ordinal") % 2)
    assert found.agg(F.sum("reference_count")).first()[0] == 2_000_000 and shuffled(spark, found) < 6_000_000


def test_dominant_kinds_of_any_ids(spark, parts):
    """As the operator over all pairs has them."""
    seen, declared, (obs, decl) = some(spark, 7)
    kinds = spark.createDataFrame([(s, t, kind) for s, t, kind, *_ in pairs(seen, declared)], "source string, target string, reference_kind string")
    assert rows(E.dominant_kinds(obs, decl)) == rows(E.dominant_kind(kinds), "source", "target", "reference_kind", "reference_count")
    seen, declared = hot(spark)
    found = E.dominant_kinds(seen, declared)
    assert found.count() == 2_000_000 and shuffled(spark, found) < 4_000_000


def known(spark):
    """The hot documents, and no edges between symbols."""
    seen, declared = hot(spark)
    edges = spark.createDataFrame([], "source string, target string, kind string, weight long")
    return seen, declared, edges, spark.createDataFrame([], "node string, owner string")


def test_documents_roll_up_without_shuffled_pairs(spark, parts):
    """With edges between symbols among them, one of a pair that documents have as well, one of a new pair, one within a document."""
    seen, declared, (obs, decl) = some(spark, 9)
    edges = spark.createDataFrame([("s1", "s2", "symbol-call", 2), ("s1", "s3", "symbol-creation", 1), ("s2", "s4", "symbol-call", 9), ("s1", "s2", "other", 5), ("s1", "gone", "symbol-call", 1)], "source string, target string, kind string, weight long")
    owners = spark.createDataFrame([("s1", "d1"), ("s2", "d2"), ("s3", "new7"), ("s4", "d2")], "node string, owner string")
    want = Counter()
    for s, t, *_ in pairs(seen, declared):
        if s is not None and t is not None and s != t:
            want[s, t] += 34
    want["d1", "d2"] += 56
    want["d1", "new7"] += 22
    found = R.rolled_up_documents(obs, decl, edges, owners, R.DOCUMENT)
    assert rows(found.withColumn("weight", (F.col("weight") * 10).cast("long"))) == sorted(((*k, n) for k, n in want.items()), key=repr)
    hot_ = R.rolled_up_documents(*known(spark), R.DOCUMENT)
    assert hot_.count() == 2_000_000 and shuffled(spark, hot_) < 4_000_000


def test_importance_makes_no_pairs(spark):
    """As the importance of rolled up documents; a document that observes what it alone declares has none."""
    seen, declared, (obs, decl) = some(spark, 9)
    more = spark.createDataFrame([("own", "only", None, 1, None, None, None)], obs.schema)
    obs, decl = obs.unionByName(more), decl.unionByName(spark.createDataFrame([("only", "own", 1)], decl.schema))
    edges = spark.createDataFrame([("s1", "s2", "symbol-call", 2), ("s2", "s1", "symbol-creation", 1)], "source string, target string, kind string, weight long")
    owners = spark.createDataFrame([("s1", "d1"), ("s2", "new7")], "node string, owner string")
    want = R.importance(R.rolled_up_documents(obs, decl, edges, owners, R.DOCUMENT))
    text = lambda df: rows(df.select("node", F.col("importance").cast("double").alias("i")))
    assert text(R.importance_of_documents(obs, decl, edges, owners, R.DOCUMENT)) == text(want) and "own" not in dict(text(want))
    seen, declared, edges, owners = known(spark)
    far = spark.range(200_000).select(F.lit("k").alias("symbol_key"), F.concat(F.lit("c"), "id").alias("document_id"), F.col("id").alias("ordinal"))
    found = R.importance_of_documents(seen, declared.unionByName(far), edges, owners, R.DOCUMENT).agg(F.sum("importance").cast("double")).first()[0]
    assert found == 2 * 3.4 * 400 * 205_000  # 82 million pairs


@pytest.mark.parametrize("most", [100, 2, 0])
def test_ends_are_chosen_before_pairs_are_made(spark, most):
    """Rows among ids, by few ids, by few others or by a shuffle: all the same."""
    _, _, (obs, decl) = some(spark, 11)
    ids = spark.createDataFrame([(x,) for x in [*IDS[:-2], "none", "none", None]], "id string")
    assert rows(Y.among(obs, "source_document_id", ids, most)) == rows(obs.where(F.col("source_document_id").isin(IDS[:-2])))
    edges = E.document_edges(Y.among(obs, "source_document_id", ids, most), Y.among(decl, "document_id", ids, most), samples=False)
    assert rows(edges) == rows(Y.between(E.document_edges(obs, decl, samples=False), ids))
    seen, declared = hot(spark)
    found = E.document_edges(Y.among(seen, "source_document_id", declared.select("document_id")), declared, samples=False)
    assert found.count() == 0
    found = G.flag_cycles(E.document_edges(Y.among(seen, "source_document_id", seen.select("source_document_id")), declared, samples=False), spark.createDataFrame([("b1", "x")], "node string, component string"))
    assert shuffled(spark, found) < 4_000_000


def test_springs_have_the_sizes_of_their_ends(spark, parts):
    _, _, (obs, decl) = some(spark, 13)
    sizes = spark.createDataFrame([(x, 20.0 + 5 * i, 6.0 * (i % 3)) for i, x in enumerate(IDS[:-1])], "id string, half_width double, padding double")
    edges = E.document_edges(obs, decl, samples=False).select("source", "target", F.lit("document-reference").alias("kind"), F.col("reference_count").alias("weight"))
    assert rows(A.document_springs(obs, decl, sizes)) == rows(A.springs(edges, sizes))
    seen, declared = hot(spark)
    every = seen.select(F.col("source_document_id").alias("id")).union(declared.select("document_id")).withColumns({"half_width": F.length("id") * 1.0, "padding": F.lit(1.0)})
    assert shuffled(spark, A.document_springs(seen, declared, every)) < 4_000_000


def test_searched_edges_know_their_ends(spark, parts):
    _, _, (obs, decl) = some(spark, 15)
    hits = spark.createDataFrame([("d1",), ("d2",), ("007",), ("none",)], "id string")
    assert rows(V.search_document_edges(obs, decl, hits)) == rows(V.search_edges(E.document_edges(obs, decl, samples=False), hits), "source", "target", "reference_count", "dimmed")
    seen, declared = hot(spark)
    found = V.search_document_edges(seen, declared, declared.select(F.col("document_id").alias("id")).where("id < 'b2'"))
    assert found.where("not dimmed").count() == 400 * 1112 and shuffled(spark, found) < 4_000_000


def test_visible_document_edges(spark):
    _, _, (obs, decl) = some(spark, 17)
    shown = spark.createDataFrame([(x,) for x in IDS[::2]], "id string")
    want = E.document_edges(obs, decl, samples=False).where(F.col("source").isin(IDS[::2]) & F.col("target").isin(IDS[::2]))
    assert rows(V.visible_document_edges(obs, decl, shown, V.View())) == rows(want) and want.count()
    assert V.visible_document_edges(obs, decl, shown, V.View(document_dependencies=False)).count() == 0
    seen, declared = hot(spark)
    every = seen.select(F.col("source_document_id").alias("id")).union(declared.select("document_id"))
    assert shuffled(spark, V.visible_document_edges(seen, declared, every, V.View())) < 4_000_000
