"""Near-duplicate classes against brute force, and the pipeline against its stages one by one."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from depweave.llm import contamination, near_duplicates as N, pieces, secret_scan
from tests.llm.test_texts import brute_hits

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute_classes(docs):
    """Least id of each component of texts that are equal or similar."""
    ids = sorted({i for i, t in docs if i is not None})
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    known = [(i, t, shingles(t)) for i, t in docs if i is not None and t is not None]
    for a in range(len(known)):
        for b in range(a):
            (i, s, x), (j, t, y) = known[a], known[b]
            union = sum((x | y).values())
            if s == t or (union and sum((x & y).values()) / union >= N.SIMILARITY):
                part[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def make_docs():
    rng = random.Random(11)
    say = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    docs = []
    for base in range(12):
        words = say(rng.choice([6, 40, 150, 400]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, len(words) // 60, len(words) // 12])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())[2:6]
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, " ".join(say(80))) for i in range(20)]
    return docs


def test_classes_against_brute_force(spark):
    docs = make_docs()
    extra = [(900, None), (901, ""), (902, ""), (903, "!?"), (904, "one two"), (905, "One two."), (None, docs[0][1]), (None, "only here"), (906, docs[3][1]), (906, "another text with this id, quite different from all"), (907, None)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumns({"class_id": F.lit("x"), "band": F.lit(1)})
    got = N.classes(df).collect()
    expected = brute_classes(docs + extra)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == expected and len(got) == len(docs + extra)
    assert sorted(str(r["class_id"]) for r in got if r["doc_id"] is None) == sorted([str(expected[0]), "None"])
    kept = N.drop_copies(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and sorted(x for x in ids if x is not None) == sorted(set(expected.values())) and ids.count(None) == 1
    assert N.classes(df.limit(0)).count() == 0 and N.drop_copies(df.limit(0)).count() == 0


def test_no_link_is_lost_by_repeated_or_missing_ids(spark):
    """Classes of rows, found by looking at all pairs of rows."""
    rng = random.Random(13)
    docs = []
    for base in range(14):
        words = [f"b{base}w{rng.randrange(200)}" for _ in range(rng.choice([5, 60, 90]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 9])):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            docs.append((rng.choice([None, rng.randrange(40), rng.randrange(40)]), " ".join(copy)))
    docs += [(5, "text A " * 40), (5, "text B of the same id " * 30), (7, "text B of the same id " * 30 + "end"), (None, "text B of the same id " * 29), (None, "alone " * 9), (None, "alone " * 9), (None, None), (5, None), (None, "")]
    part = list(range(len(docs)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    sets = [shingles(t or "") for _, t in docs]
    for a, b in itertools.combinations(range(len(docs)), 2):
        (i, s), (j, t) = docs[a], docs[b]
        union = sum((sets[a] | sets[b]).values())
        alike = s is not None and t is not None and (s == t or (union and sum((sets[a] & sets[b]).values()) / union >= N.SIMILARITY))
        if alike or (i is not None and i == j):
            part[find(a)] = find(b)
    name = {}
    for k, (i, _) in enumerate(docs):
        name[find(k)] = min((x for x in (name.get(find(k)), i) if x is not None), default=None)
    want = sorted(((i, name[find(k)]) for k, (i, _) in enumerate(docs)), key=repr)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(((r["doc_id"], r["class_id"]) for r in N.classes(df).collect()), key=repr) == want
    assert (5, 5) in want and (7, 5) in want and (None, 5) in want and (None, None) in want
    kept = [r["doc_id"] for r in N.drop_copies(df).collect()]
    bare = {find(k) for k, (i, t) in enumerate(docs) if name[find(k)] is None and t is not None}
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in want if c is not None}) and kept.count(None) == len(bare) + 1
    named = df.selectExpr("'id' || lpad(doc_id, 3, '0') AS doc_id", "text")  # ids of another type
    assert sorted(((r["doc_id"], r["class_id"]) for r in N.classes(named).collect()), key=repr) == sorted(((i and f"id{i:03}" if i != 0 else "id000", c and f"id{c:03}" if c != 0 else "id000") for i, c in want), key=repr)


def test_hot_group_makes_few_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    copies = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        copies.append((i, " ".join(words)))
    df = spark.createDataFrame(copies + [(1000 + i, copies[0][1]) for i in range(200)], "doc_id long, text string")
    got = N.classes(df)
    assert [r["class_id"] for r in got.select("class_id").distinct().collect()] == [0] and got.count() == 350
    firsts = N.signed(df).where("id < 1000").select("id", "bands")
    assert N.buckets(firsts).where("id != lead").select("id", "lead").distinct().count() < 150 * 12


def test_no_link_of_a_filled_in_form_is_lost(spark):
    rng = random.Random(21)
    form = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(400):
        own = [f"d{i}w{k}" for k in range(rng.randrange(13, 19))]
        if i >= 340:  # similar to the document 340 before it: 0.8 to 0.85; all others have 0.7 to 0.78 with each other
            own = [w for w in docs[i - 340][1].split() if w.startswith("d")]
            own = own[:-8] + [f"d{i}w{k}" for k in range(8)]
        docs.append((i, " ".join(form[:60] + own + form[60:])))
    rng.shuffle(docs)
    ids = list(range(400))
    rng.shuffle(ids)
    docs = [(i, t) for i, (_, t) in zip(ids, docs, strict=True)]
    expected = brute_classes(docs)
    assert 300 < len(set(expected.values())) < 390
    got = N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng, errors = random.Random(8), []
    for _ in range(120):
        words = [f"{rng.randrange(400)}".encode() for _ in range(rng.choice([7, 60, 900]))] * (2 if weighted else 1)
        other = [w if rng.random() > 0.03 else b"z%d" % rng.randrange(10**6) for w in words]
        a, b = N.cells(words), N.cells(other)
        errors.append((N.signature(a) == N.signature(b)).mean() - N.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_cells_are_counts():
    words = [b"a", b"b"] * 6
    assert len(N.cells(words)) == 8 and len(set(N.cells(words).tolist())) == 8 and len(N.cells([])) == 0 and len(N.cells([b"x"])) == 1
    long = [b"word%d" % (i % 50_000) for i in range(60_000)]
    assert (N.word_hashes(long)[:10] == N.word_hashes(long[:10])).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    done = {}
    now = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, now, DATA)
        assert out.columns == docs.columns
        done[name] = {r["doc_id"]: r for r in out.collect()}
        now = spark.createDataFrame(list(done[name].values()), docs.schema)
    good = done["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = [q for i, q in labels.items() if i in good]
    assert sum(q == 0 for q in kept) <= 0.1 * max(1, sum(q == 0 for q in labels.values())) + 1 and sum(q == 1 for q in kept) >= 0.97 * sum(q == 1 for q in labels.values())
    part = brute_classes([(i, r["text"]) for i, r in good.items()])
    assert set(done["near-duplicates"]) == set(part.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    automaton = contamination.automaton(items)
    clean = set()
    for i, r in done["near-duplicates"].items():
        n, ranges, _ = contamination.hits(r["text"], automaton)
        hit = sum(b - a for a, b in ranges)
        if not (hit and 20 * hit >= n):
            clean.add(i)
        if hit:
            assert brute_hits(r["text"], items)[1] == {x for a, b in ranges for x in range(a, b)}
    assert set(done["decontamination"]) == clean
    keywords = secret_scan.automaton()
    for i, r in done["secrets"].items():
        before = done["decontamination"][i]["text"]
        assert (r["text"] == before) == (not secret_scan.find(before, keywords)) and r["n_chars"] == len(r["text"])
    words = pieces.load()
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(last) == set(done["secrets"]) and all(pieces.decode_ids(words, r["ids"]) == done["secrets"][i]["text"] for i, r in last.items())


def test_stages_pass_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, None, "en", None, None), (3, "token = abcdefghijklmnopqr and more words in this text", "en", "s", 53)], schema).withColumns({"score": F.lit(1), "overlap": F.lit(2), "found": F.lit(3)})
    for name, apply in corpus_pipeline.STAGES[1:-1]:
        assert apply(spark, odd, DATA).columns == odd.columns
        assert apply(spark, odd.limit(0), DATA).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.without_copies(spark, odd, DATA).collect()} == {None, 1, 2, 3}
    assert corpus_pipeline.without_copies(spark, odd, DATA).where("doc_id = 1").count() == 1
    assert corpus_pipeline.as_pieces(spark, odd, DATA).count() == 5
    assert corpus_pipeline.good_quality(spark, odd, DATA).columns == odd.columns
