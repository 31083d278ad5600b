"""Language identification, quality, and what both do with odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import languages, quality
from depweave.llm.common import held_out, trainable
from depweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, DATA).join(docs, "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["a"] > 0.98 and 0 <= row["lo"] and row["hi"] <= 1


def test_language_odd_rows(spark):
    rows = [(i, "der die und das ist ein haus" if i % 2 else "the and of is a house in this", "de" if i % 2 else "en", None) for i in range(40)]
    train = spark.createDataFrame([*rows, (99, None, "en", None), (98, "x", None, None)], DOC)
    model = languages.fit(train)
    assert model.languages == ("de", "en")
    odd = spark.createDataFrame([(1, None, None, "a"), (2, "", None, "a"), (3, "123 !?", None, "a"), (4, "THE HOUSE IS OF THE", None, "b"), (4, "das haus " * 400_000, None, "b"), (None, "this is", None, None)], DOC)
    got = {(r["doc_id"], r["lang_pred"]) for r in languages.predict(odd.withColumn("score", F.lit("x")).withColumn("found", F.lit(1)), model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (None, "en")}
    empty = languages.fit(spark.createDataFrame([], DOC))
    assert [(r["lang_pred"], r["score"]) for r in languages.predict(odd.where("doc_id = 1"), empty).collect()] == [("und", 0.0)]
    assert languages.predict(spark.createDataFrame([], DOC), model).count() == 0
    with pytest.raises(ValueError):
        languages.fit(train, max_languages=1)


def test_language_scores_are_those_of_counts_one_by_one(spark):
    model = languages.fit(spark.createDataFrame([(1, "aab b", "x", None), (2, "ccd", "y", None)], DOC), bits=8)
    text = "ab c"
    sums = model.prior.copy()
    for buckets, _ in languages.gram_buckets([text], [0], model.orders, model.bits):
        for b in buckets:
            sums += model.weights[:, b]
    assert np.allclose(languages.log_odds(model, [text])[0], sums)
    alone, together = languages.log_odds(model, ["abc"])[0], languages.log_odds(model, ["zz", "abc", ""])[1]
    assert np.allclose(alone, together)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op8_quality"](spark, DATA).join(labels, "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row["a"] > 0.95 and row["n"] > 50  # a few hundred labels; texts of two words are hard
    assert got.where("score < 0 or score > 1 or (score >= 0.7) != (predicted = 1)").count() == 0


def test_quality_odd_rows(spark):
    good = [(i, "plain words stand here in good order and say something new " + "abcdefghij"[i % 10], None, None) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! " * (3 + i % 5), None, None) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (500, None, None, None), (501, "", None, None)], DOC)
    marks = [(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(1, 1), (None, 1), (3, None), (4, 7), (5, 0), (777, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = {r["doc_id"]: r for r in quality.score(docs.withColumn("Score", F.lit(9)).withColumn("extra", F.lit(1)), model).collect()}
    assert all(scored[i]["predicted"] == 1 for i, *_ in good) and all(scored[i]["predicted"] == 0 for i, *_ in bad)
    assert 0 <= scored[500]["score"] <= 1 and scored[500]["score"] == scored[501]["score"]
    assert quality.keep(docs.withColumn("score", F.lit(9)), model).columns == [*docs.columns, "score"]
    assert quality.score(spark.createDataFrame([], DOC), model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.keep(docs, nothing).count() == docs.count()
    assert quality.fit(docs, labels.where("quality = 0")).constant == 0.0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_long_text_has_the_indicators_of_its_pieces(monkeypatch, size):
    rng = random.Random(size)
    texts = ["Some words, again and again and 12 more. " * 200, ""] + ["".join(rng.choice(["a", "B", "Buy ", "buy ", " ", "\n", "é", "1", "!", "NOW NOW "]) for _ in range(60)) for _ in range(100)]
    whole = [quality.indicators(t, 14).tolist() for t in texts]
    monkeypatch.setattr(quality, "PIECE", size)
    assert [quality.indicators(t, 14).tolist() for t in texts] == whole


@pytest.mark.parametrize("size", [2, 3, 7, 20])
def test_long_text_has_the_language_scores_of_its_pieces(monkeypatch, size):
    rng = random.Random(size)
    weights = np.random.default_rng(1).normal(size=(2, 4097)).astype(np.float32)
    weights[:, -1] = 0
    model = languages.LanguageModel(("a", "b"), np.zeros(2), weights, (1, 2, 3), 12)
    texts = ["".join(rng.choice(["a", "B", "c", " ", "--", "é", "1", "ß"]) for _ in range(rng.randrange(60))) for _ in range(100)]
    whole = languages.log_odds(model, texts)
    monkeypatch.setattr(languages, "PIECE", size)
    assert np.allclose(languages.log_odds(model, texts), whole, atol=1e-4)


def test_dual_descent_finds_the_least_hinge_loss():
    """Against plain subgradient descent on the same loss."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    signs, ratio = np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.normal(size=30)
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(np.square(ratio[r]).sum())
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - signs * (x @ w)).sum()
    best, w = np.inf, np.zeros(30)
    for step in range(20_000):
        short = signs * (x @ w) < 1
        w = w - (w - (signs[short, None] * x[short]).sum(axis=0)) / (1 + step)
        best = min(best, loss(w))
    assert loss(quality._support_vectors(rows, ratio, signs, np.ones(60), 500, 1)) <= best * 1.005


def test_support_vectors_separate():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 8) + (0 if i % 2 else 30)).astype(np.int32) for i in range(80)]
    signs = np.array([1.0 if i % 2 else -1.0 for i in range(80)])
    ratio = np.where(np.arange(70) < 30, 1.0, np.where(np.arange(70) < 40, 0.1, -1.0))
    w = quality._support_vectors(rows, ratio, signs, np.full(80, 1.0), 50, 1) * ratio
    assert np.mean([np.sign(w[r].sum()) == s for r, s in zip(rows, signs, strict=True)]) > 0.97


def test_held_out_is_by_the_text_of_the_id(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h"), trainable(F.col("id")).alias("t")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) and r["t"] != r["h"] for r in got)
    none = spark.sql("select cast(null as long) as id").select(held_out(F.col("id")).alias("h"), trainable(F.col("id")).alias("t")).first()
    assert tuple(none) == (False, False)
