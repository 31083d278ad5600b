"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, sample_share, struct_udf

#: Characters that are hashed at once; longer texts are scored piece by piece.
PIECE = 1 << 19
#: What counts as a letter after lower-casing.
_NONE = re.compile("[^a-z\xaa-\U0010ffff]+")
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``weights[l, b]``: log-probability of gram bucket b in language l; a last column of zeros stands for no gram."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...]
    bits: int


def _pieces(texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of about PIECE characters: the place in texts of each part, the part, and how many characters before it come with it.

    A text that is longer is cut after each PIECE characters; the next part begins with the last
    ``overlap`` of those before, so that grams across the cut are found there.
    """
    owners, parts, heads, held = [], [], [], 0
    for i, text in enumerate(texts):
        text, tail = text.lower(), ""
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE]
            if len(text) > PIECE:
                part = _NONE.sub(" ", part)
                part = tail + (part[1:] if tail[-1:] == " " == part[:1] else part)
            owners.append(i)
            parts.append(part)
            heads.append(len(tail))
            tail = part[-overlap:] if overlap else ""
            held += len(part)
            if held >= PIECE:
                yield owners, parts, heads
                owners, parts, heads, held = [], [], [], 0
    if parts:
        yield owners, parts, heads


def gram_buckets(parts: list[str], heads: list[int], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all grams, 2**bits where there is none, and where the grams of each part begin.

    Runs of characters that are no letters count as one space; no gram crosses from one part into
    the next, and none counts that ends in the first ``heads`` characters of a part.
    """
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    codes[~(((codes >= 97) & (codes <= 122)) | (codes >= 0xAA))] = 32
    codes[ends] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    ends = np.cumsum(keep)[ends] - 1
    codes = np.concatenate([codes[keep], np.zeros(max(orders), np.uint32)])
    n = int(ends[-1]) + 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    none = codes == 0
    for order in orders:
        hashed = np.full(n, np.uint32(order * 0x9E3779B9 & 0xFFFFFFFF))
        bad = np.zeros(n, bool)
        for k in range(order):
            hashed = (hashed ^ codes[k : k + n]) * np.uint32(0x01000193 + 2 * k * 0x5BD1E995 & 0xFFFFFFFF)
            bad |= none[k : k + n]
        if order == 1:
            bad |= codes[:n] == 32
        for start, head in zip(starts.tolist(), heads, strict=True):
            if head >= order:
                bad[start : start + head - order + 1] = True
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        buckets = (hashed >> np.uint32(32 - bits)).astype(np.int32)
        buckets[bad] = 1 << bits
        yield buckets, starts


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), sample_rows: int = 20_000, smoothing: float = 0.5, max_languages: int = 512) -> LanguageModel:
    """Learns from the rows that have a text and a language.

    ``sample_rows`` bounds the sample that is learnt from: a sample by hash of the key whose
    expected size it is (all rows where there are fewer). Gram counts are made on the executors;
    only languages x 2**bits sums come to the driver, and more than ``max_languages`` different
    labels are an error. With no labelled row the model knows no language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where("text is not null and lang is not null")
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(by_lang) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(by_lang))
    place, size, total = {x: i for i, x in enumerate(languages)}, (1 << bits) + 1, sum(by_lang.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), size), np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for owners, parts, heads in _pieces(texts, max(orders) - 1):
                which = np.array([place[langs[i]] for i in owners])
                for buckets, starts in gram_buckets(parts, heads, orders, bits):
                    of = np.repeat(which, np.diff(np.append(starts, len(buckets))))
                    sums += np.bincount(of * size + buckets, minlength=sums.size).reshape(sums.shape)
        at_lang, at_bucket = np.nonzero(sums[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(at_lang, pa.int32()), pa.array(at_bucket, pa.int32()), pa.array(sums[at_lang, at_bucket], pa.int64())], names=["l", "b", "n"])

    counts = np.zeros((len(languages), size - 1))
    if languages:
        sample = rows.where(sample_share(F.col("key"), sample_rows / max(1, total), 1))
        summed = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
        counts[summed["l"].to_numpy(), summed["b"].to_numpy()] = summed["n"].to_numpy()
    weights = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=1, keepdims=True))
    weights = np.concatenate([weights, np.zeros((len(languages), 1))], axis=1).astype(np.float32)
    prior = np.log(np.array([by_lang[x] for x in languages], float) / max(1, total))
    return LanguageModel(languages, prior, weights, orders, bits)


def log_odds(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Joint log-probability of each text with each language: sparse rows of gram counts times the weights."""
    joint = np.tile(model.prior, (len(texts), 1))
    for owners, parts, heads in _pieces(texts, max(model.orders) - 1):
        got = np.zeros((len(parts), len(model.languages)))
        for buckets, starts in gram_buckets(parts, heads, model.orders, model.bits):
            for at, weights in enumerate(model.weights):
                got[:, at] += np.add.reduceat(weights.take(buckets), starts)
        np.add.at(joint, owners, got)
    return joint


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs with ``lang_pred`` and ``score``, the posterior probability of that language.

    Nulls, texts without a letter, and all texts under a model without languages: ``und`` with
    score 0. Ties go to the language that sorts first. Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: list[str | None]) -> list[list]:
        model = shared.value
        known = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            joint = log_odds(model, [texts[i] for i in known])
            best = joint.argmax(axis=1)
            share = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = model.languages[b], round(s, 6)
        return [names, scores]

    run = struct_udf(each, [("lang_pred", pa.string()), ("score", pa.float64())], "lang_pred string, score double")
    out = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn(out, run(F.col(text))).select(*kept, f"{out}.lang_pred", f"{out}.score")
