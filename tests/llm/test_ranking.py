"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from depweave.llm import ranking
from depweave.llm.term_tree import Best, Items, build, search


def words(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def brute(docs, items, best=20):
    """All rows (item_id, rank, doc_id, score)."""
    terms = [(d, words(t)) for d, t in docs]
    terms = [(d, w) for d, w in terms if w]
    n_docs, total = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for d, w in terms:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scored)[:best], 1)]
    return out


def make(rng, n, vocabulary):
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.3:
            texts.append(rng.choice(texts))  # copies, so ties
        else:
            texts.append(" ".join(rng.choice(vocabulary[: rng.choice([5, 20, len(vocabulary)])]) for _ in range(rng.choice([1, 3, 12, 60]))))
    return texts


def ordered(rows):
    return sorted(rows, key=repr)


def test_trees_find_what_all_scores_find_and_cut_off():
    rng = random.Random(1)
    for round_ in range(20):
        n_terms, best = rng.choice([3, 30, 200]), rng.choice([1, 4, 20])
        docs = []
        for d in range(rng.choice([0, 1, 40, 400])):
            if docs and rng.random() < 0.3:
                docs.append((*rng.choice(docs)[:3], None if d % 9 == 0 else d))
                continue
            terms = np.array(sorted({int(n_terms * rng.random() ** 3) for _ in range(rng.randint(1, 12))}), np.int32)
            docs.append((terms, np.array([rng.choice([1, 1, 1, 2, 9]) for _ in terms], np.int32), rng.choice([75, 80, 100, 400]), d))
        asked = [(k, {rng.randrange(n_terms): rng.randint(0, 9000) for _ in range(rng.randint(1, 8))}) for k in range(6)]
        items = Items(asked, n_terms)
        found = Best(len(asked), best)
        for k in range(0, len(docs), 100):  # several trees, the best go on from one to the next
            search(build(docs[k : k + 100], best), items, found)
        for k, weights in asked:
            scores = []
            for terms, tf, m, d in docs:
                s = sum(weights[t] * (10**9 * f // (1000 * f + 12 * m)) for t, f in zip(terms.tolist(), tf.tolist()) if t in weights)
                if s:
                    scores.append((s, d is not None, -(d or 0)))
            assert sorted(found.heaps[k]) == sorted(sorted(scores, reverse=True)[:best]), round_
    # One item of a rare term: most of the tree is never opened.
    docs = [(np.array([k % 5, 5 + k % 7, 20 + k % 400], np.int32), np.ones(3, np.int32), 100, k) for k in range(4000)]
    root = build(docs, 2)
    assert search(root, Items([(0, {33: 5000, 0: 10})], 420), Best(1, 2)) < 400


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Été", "naïve", "x1", *(f"w{k}" for k in range(80))]
    docs = [(None if k % 31 == 0 else k, t) for k, t in enumerate(make(rng, 300, vocabulary))]
    docs += [(1, "THE of"), (1, "THE of"), (5000, None), (5001, ""), (5002, "-- !"), (5003, "rare_w1 " + "the " * 60000), (5004, "É é   w1")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30])))) for k in range(12)] + [(90, ""), (91, None), (92, "nowhere"), (None, "of w1 w1"), (93, "The the THE rare")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS item", "1 AS score", "2 AS rank")
    wanted = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'clash' AS doc_id", "3 AS item")
    got = [tuple(r) for r in ranking.search_items(frame.repartition(3), wanted).collect()]
    assert ordered(got) == ordered(brute(docs, items))
    got = [tuple(r) for r in ranking.search_items(frame.repartition(2), wanted, best=3).collect()]
    assert ordered(got) == ordered(brute(docs, items, 3))


def test_items_in_several_passes(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    docs, items = list(enumerate(make(rng, 60, vocabulary))), list(enumerate(make(rng, 20, vocabulary)))
    monkeypatch.setattr(ranking, "ITEM_BYTES", 200)
    got = [tuple(r) for r in ranking.search_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert ordered(got) == ordered(brute(docs, items))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    doc = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranking.search_items(none, item).collect() == []
    assert ranking.search_items(doc, item.limit(0)).collect() == []
