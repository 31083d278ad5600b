"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, sample_share, struct_udf

#: Bytes that are hashed at once; pieces of longer texts overlap by OVERLAP.
PIECE, OVERLAP = 1 << 20, 2
_POWERS = np.cumprod(np.full(64, 0x01000193, np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class QualityModel:
    """``weights``: ratio times support-vector weight of each bucket; the margin goes through a fitted logistic curve."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    constant: float | None = None


def _mix(hashed: np.ndarray, bits: int) -> np.ndarray:
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (hashed >> np.uint32(32 - bits)).astype(np.int32)


def indicators(text: str, bits: int) -> np.ndarray:
    """Sorted buckets of the n-grams that a text has: 1 to 3 bytes, and 1 to 3 word shapes.

    A digit counts as 0. The shape of a word is its case, its last byte if that is ASCII and no
    letter, and how many words before it are the same word, up to 4 (so that a word said over and
    over leaves a trace whatever the word is). Long texts are hashed piece by piece; grams and
    words that go on from one piece to the next are whole.
    """
    flags = np.zeros(1 << bits, bool)
    raw, words = text.encode("utf-8", "surrogatepass"), _Words()
    for at in range(0, len(raw), PIECE):
        codes = np.frombuffer(raw[at : at + PIECE + OVERLAP], np.uint8).astype(np.uint32)
        digits = (codes >= 48) & (codes <= 57)
        if digits.any():
            codes[digits] = 48
        flags[_mix(codes * np.uint32(0x9E3779B1), bits)] = True
        if len(codes) > 1:
            two = codes[:-1] * np.uint32(0x85EBCA77) ^ codes[1:] * np.uint32(0xC2B2AE3D)
            flags[_mix(two, bits)] = True
            if len(codes) > 2:
                flags[_mix(two[:-1] * np.uint32(0x27D4EB2F) ^ codes[2:] * np.uint32(0x165667B1), bits)] = True
        before, shapes = words.shapes(codes[:PIECE], at + PIECE >= len(raw))
        for order in (1, 2, 3):
            seen = np.concatenate([before[max(0, len(before) - order + 1) :], shapes]) if order > 1 else shapes
            if len(seen) >= order:
                hashed = np.full(len(seen) - order + 1, np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF))
                for k in range(order):
                    hashed = (hashed ^ seen[k : k + len(hashed)]) * np.uint32(0x5BD1E995 + 2 * k)
                flags[_mix(hashed, bits)] = True
    return np.flatnonzero(flags).astype(np.int32)


class _Words:
    """The word shapes of a text that comes piece by piece."""

    def __init__(self) -> None:
        self.open: tuple[int, np.uint64, int, int] | None = None  # of a word that goes on: bytes, hash, capitals, letters so far
        self.last_byte = 32
        self.said: tuple[np.uint64, int] | None = None  # hash of the last word, and how often it was said before
        self.tail = np.zeros(0, np.uint32)

    def shapes(self, codes: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """The last two shapes before this piece, and those of the words that end in it."""
        before = self.tail
        space = codes <= 32
        first = ~space
        first[1:] &= space[:-1]
        goes_on = self.open is not None and not space[0]
        closing = self.open is not None and not goes_on  # it ended with the piece before
        starts = np.flatnonzero(first)
        words, ups, letters, tails = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        size = self.open[0] if goes_on else 0
        length = len(codes)
        if len(starts):
            last = ~space
            last[:-1] &= space[1:]
            stops = np.flatnonzero(last)
            seat = np.arange(length) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [length]])))
            if goes_on:
                seat[: stops[0] + 1] += size
            words = np.add.reduceat(np.where(space, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(seat, 63)]), starts)
            upper = (codes >= 65) & (codes <= 90)
            letter = upper | ((codes >= 97) & (codes <= 122)) | (codes >= 128)
            ups, letters = np.add.reduceat(upper.astype(np.int64), starts), np.add.reduceat(letter.astype(np.int64), starts)
            tails = np.where(letter[stops], 0, codes[stops]).astype(np.uint32)
            if goes_on:
                words[:1] += self.open[1]
                ups[0] += self.open[2]
                letters[0] += self.open[3]
        if closing:
            _, hashed, up, all_letters = self.open
            byte = self.last_byte
            is_letter = 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128
            words, ups, letters = np.concatenate([[hashed], words]).astype(np.uint64), np.concatenate([[up], ups]), np.concatenate([[all_letters], letters])
            tails = np.concatenate([[0 if is_letter else byte], tails]).astype(np.uint32)
        self.open = None
        if not ends and len(codes) and not space[-1]:
            since = int(starts[-1])
            self.open = (length - since + (size if goes_on and len(starts) == 1 else 0), words[-1], int(ups[-1]), int(letters[-1]))
            words, ups, letters, tails = words[:-1], ups[:-1], letters[:-1], tails[:-1]
        self.last_byte = int(codes[-1]) if length else self.last_byte
        if not len(words):
            return before, np.zeros(0, np.uint32)
        case = np.where(ups == 0, 0, np.where(ups == letters, 2, 1)) + np.where(letters == 0, 4, 0)
        same = np.zeros(len(words), np.int64)
        same[1:] = words[1:] == words[:-1]
        run = np.zeros(len(words), np.int64)
        if self.said is not None and words[0] == self.said[0]:
            run[0] = min(self.said[1] + 1, 4)
        for _ in range(4):
            run[1:] = np.where(same[1:] > 0, np.minimum(run[:-1] + 1, 4), 0)
        self.said = (words[-1], int(run[-1]))
        found = (case * 5 + run + 64 * tails).astype(np.uint32)
        self.tail = np.concatenate([before, found])[-2:]
        return before, found


def _support_vectors(rows: list[np.ndarray], ratio: np.ndarray, signs: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights of a linear model with hinge loss, by dual coordinate descent over rows of unit length."""
    scaled = [ratio[x] / max(1e-9, float(np.sqrt(np.square(ratio[x]).sum()))) for x in rows]
    weights, duals, order = np.zeros(len(ratio)), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * weights[rows[i]].dot(scaled[i]) - 1
            new = min(max(duals[i] - slope, 0.0), cost[i])
            if new != duals[i]:
                weights[rows[i]] += (new - duals[i]) * signs[i] * scaled[i]
                most = max(most, abs(new - duals[i]))
                duals[i] = new
        if most < 1e-3:
            break
    return weights


def _logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with targets drawn in from 0 and 1; Newton's steps."""
    n1, n0 = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, inputs = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(inputs @ beta, -30, 30)))
        grad = inputs.T @ (weight * (p - target)) + 1e-6 * beta
        hess = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", *, bits: int = 17, sample_rows: int = 5_000, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> QualityModel:
    """Learns from the documents that labels marks 0 or 1.

    ``sample_rows`` bounds what is learnt from, and what comes to the driver: of each class a
    sample by hash of the key with half of it as expected size (the whole class where it is
    smaller). A quarter of the sample is kept from the fit to set the logistic curve, in which each
    class has its weight among all labels. Keys with a null, unknown or contradicting label teach
    nothing; repeated labels count once. With one class or none the score is constant: its label,
    or 1 where nothing is known.
    """
    marks = (
        labels.select(F.col(key).alias("key"), F.col(label).alias("y"))
        .where("key is not null and y in (0, 1)")
        .groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("key", "y")
    )
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return QualityModel(np.zeros(0), np.zeros(0), 0.0, 0.0, float(next(iter(sizes), 1)))
    share = {y: min(1.0, sample_rows / 2 / n) for y, n in sizes.items()}
    chosen = marks.where(reduce(or_, ((F.col("y") == y) & sample_share(F.col("key"), s, seed) for y, s in share.items())))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), pa.array([indicators(t or "", bits).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["key", "y", "x"])

    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "y", "text")
    key_type = sample.schema["key"].dataType.simpleString()
    got = sorted(((r["key"], r["y"], bytes(r["x"])) for r in sample.mapInArrow(features, f"key {key_type}, y int, x binary").collect()))
    rows, good = [np.frombuffer(x, np.int32) for _, _, x in got], np.array([y == 1 for _, y, _ in got], bool)
    if not (good.any() and (~good).any()):
        return QualityModel(np.zeros(0), np.zeros(0), 0.0, 0.0, float(good.any() or not len(good)))
    kept = np.arange(len(rows)) % 4 == 3
    if not (good[kept].any() and (~good[kept]).any() and good[~kept].any() and (~good[~kept]).any()):
        kept[:] = False
    use = np.flatnonzero(~kept)
    have = {y: np.full(1 << bits, 1.0) for y in (True, False)}
    for i in use:
        have[bool(good[i])][rows[i]] += 1
    ratio = np.log(have[True] / have[True].sum()) - np.log(have[False] / have[False].sum())
    signs = np.where(good, 1.0, -1.0)
    weights = ratio * _support_vectors([rows[i] for i in use], ratio, signs[use], np.full(len(use), cost), epochs, seed)
    of = np.flatnonzero(kept) if kept.any() else use
    margins = np.array([weights[rows[i]].sum() / max(1e-9, float(np.sqrt(np.square(ratio[rows[i]]).sum()))) for i in of])
    weight = np.where(good[of], sizes[1] / max(1, good[of].sum()), sizes[0] / max(1, (~good[of]).sum()))
    slope, offset = _logistic(margins, good[of], weight * len(of) / weight.sum())
    return QualityModel(ratio.astype(np.float32), weights.astype(np.float32), slope, offset)


def score_text(model: QualityModel, text: str) -> float:
    """Probability that the text's label is 1."""
    if model.constant is not None:
        return model.constant
    has = indicators(text, int(len(model.ratio)).bit_length() - 1)
    margin = float(model.weights[has].sum(dtype=np.float64)) / max(1e-9, float(np.sqrt(np.square(model.ratio[has]).sum(dtype=np.float64))))
    return round(float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))), 6)


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold, else 0).

    A null text is scored as an empty one. Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: list[str | None]) -> list[list]:
        got = [score_text(shared.value, t or "") for t in texts]
        return [got, [int(s >= threshold) for s in got]]

    run = struct_udf(each, [("score", pa.float64()), ("predicted", pa.int32())], "score double, predicted int")
    out = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.withColumn(out, run(F.col(text))).select(*kept, f"{out}.score", f"{out}.predicted")


def keep(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns as they are, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = struct_udf(lambda texts: [[score_text(shared.value, t or "") for t in texts]], [("score", pa.float64())], "score double")
    name = fresh(docs, "found")
    return docs.withColumn(name, run(F.col(text))).where(F.col(f"{name}.score") >= threshold).drop(name)
