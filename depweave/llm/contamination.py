"""Benchmark decontamination: one automaton over windows of benchmark words, run once over every text; a join of windows for a benchmark too large for it."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, struct_udf
from depweave.plans.staging import stage

WINDOW = 13
#: A to Z in lower case; every other ASCII character that is no letter or digit is a space; the rest stays.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Bytes of benchmark text that one automaton is built over (and that is broadcast); the windows of a larger benchmark are joined.
AUTOMATON_BYTES = 16 << 20


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Every run of ``size`` words; all words if there are fewer; nothing if there are none."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> ahocorasick.Automaton:
    """An automaton of all windows; each knows its length in words and the items it comes from."""
    owners: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        for w in windows(normal_words(text), size):
            owners[w].add(item)
    found = ahocorasick.Automaton()
    for w, of in owners.items():
        found.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, frozenset(x for x in of if x is not None)))
    if owners:
        found.make_automaton()
    return found


def hits(text: str | None, found: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged ranges of hit words (end exclusive), and the items that occur."""
    words = normal_words(text)
    if not words or not len(found):
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    ranges: list[list[int]] = []
    items: set[str] = set()
    at = before = 0
    for last, (length, of) in found.iter(line.decode("latin-1")):
        items |= of
        before, at = before + line.count(b" ", at, last), last  # so many words end before the space at `last`
        start = before - line.count(b" ", last - length + 1, last)
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], before)
            while len(ranges) > 1 and start <= ranges[-2][1]:
                end = ranges.pop()[1]
                ranges[-1][1] = max(ranges[-1][1], end)
            ranges[-1][0] = min(ranges[-1][0], start)
        else:
            ranges.append([start, before])
    return len(words), [(a, b) for a, b in ranges], items


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as spans of the original text in code points, end exclusive."""
    if not ranges:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    points = lambda a, b: len(raw[a:b].decode("utf-8", "surrogatepass"))
    out, at, base = [], 0, 0
    for first, end in ranges:
        s, e = places[first][0], places[end - 1][1]
        start = base + points(at, s)
        out.append((start, start + points(s, e)))
        at, base = e, out[-1][1]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "overlap", window: int = WINDOW) -> DataFrame:
    """The rows of docs with ``out``: ``n_words, n_hit, items, spans, contaminated``.

    ``items`` are the ids, as text and sorted, of the items of which some window occurs; ``spans``
    are the hit passages in code points of the original text. A document is contaminated if at
    least a twentieth of its words, and at least one, are hit. Null and wordless texts have no
    words and are clean; items without words are ignored; the words of an item without an id count
    as hits, though it can't be listed; an empty benchmark hits nothing.

    The benchmark's size is measured first. Up to AUTOMATON_BYTES it is one broadcast automaton, run
    once over each text; a larger one is joined by the hashes of its windows. Both find the same.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    found = fresh(docs, "found")
    got = (_scanned if total <= AUTOMATON_BYTES else _joined)(docs, rows, text, found, window)
    o = F.col(found)
    n_hit = F.aggregate(o["ranges"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    result = F.struct(
        o["n_words"].alias("n_words"), n_hit.alias("n_hit"), o["items"].alias("items"), o["spans"].alias("spans"),
        ((n_hit > 0) & (n_hit * 20 >= o["n_words"])).alias("contaminated"),
    )
    return got.select(*kept, result.alias(out))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = [("n_words", pa.int64()), ("ranges", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
_FOUND_DDL = "n_words long, ranges array<struct<start long, end long>>, items array<string>, spans array<struct<start long, end long>>"


def _row(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: list[str]) -> tuple:
    pairs = lambda xs: [{"start": a, "end": b} for a, b in xs]
    return n_words, pairs(ranges), items, pairs(char_spans(text or "", ranges))


def _scanned(docs: DataFrame, rows: DataFrame, text: str, found: str, window: int) -> DataFrame:
    """docs with ``found``, by one broadcast automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton([(r["item"], r["text"]) for r in rows.collect()], window))

    def each(texts: list[str | None]) -> list[list]:
        cols: list[list] = [[], [], [], []]
        for t in texts:
            n, ranges, items = hits(t, shared.value)
            for c, x in zip(cols, _row(t, n, ranges, sorted(items)), strict=True):
                c.append(x)
        return cols

    return docs.withColumn(found, struct_udf(each, _FOUND, _FOUND_DDL)(F.col(text)))


def _marks(sizes: list[int] | None, window: int):
    """A column function: ``at, size, mark`` of the windows of a text, of the given sizes or as those of a benchmark item; mark is a 128-bit hash of the words."""

    def each(texts: list[str | None]) -> list[list]:
        cols: list[list] = [[], [], []]
        for t in texts:
            words = normal_words(t)
            of = sizes if sizes is not None else [min(window, len(words))] if words else []
            places = [(i, n) for n in of for i in range(len(words) - n + 1)]
            cols[0].append([i for i, _ in places])
            cols[1].append([n for _, n in places])
            cols[2].append([hashlib.md5(b" ".join(words[i : i + n]), usedforsecurity=False).digest() for i, n in places])
        return cols

    fields = [("at", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("mark", pa.list_(pa.binary()))]
    return struct_udf(each, fields, "at array<long>, size array<long>, mark array<binary>")


def _joined(docs: DataFrame, rows: DataFrame, text: str, found: str, window: int) -> DataFrame:
    """docs with ``found``, by joining the windows of texts with those of the benchmark.

    Equal texts are cut once. A window is joined as one row, however many items have it, and only
    the windows that occur meet their items, so what is gathered for a text is bounded by its words
    and its items.
    """
    zipped = F.explode(F.arrays_zip("w.at", "w.size", "w.mark")).alias("w")
    known = rows.select("item", _marks(None, window)("text").alias("w")).select("item", zipped)
    known = stage(known.select("item", "w.size", "w.mark").distinct(), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most so many as a window has words
    key, hit = fresh(docs, "text_key"), fresh(docs, "hit")
    texts = docs.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias(key)).agg(F.first(text).alias("text"))
    cut = texts.select(key, _marks(sizes, window)("text").alias("w")).select(key, zipped).select(key, "w.*")
    met = stage(cut.join(known.select("mark").distinct(), "mark", "left_semi"), "met")
    places = met.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("to")))).alias("places"))
    items = met.select(key, "mark").distinct().join(known.where("item is not null").select("item", "mark"), "mark").groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = places.join(items, key, "left").select(key, F.struct("places", "items").alias(hit))

    def each(of: list[dict]) -> list[list]:
        cols: list[list] = [[], [], [], []]
        for r in of:
            ranges: list[tuple[int, int]] = []
            for p in (r["hit"] or {}).get("places") or []:
                if ranges and p["at"] <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], p["to"]))
                else:
                    ranges.append((p["at"], p["to"]))
            for c, x in zip(cols, _row(r["text"], len(normal_words(r["text"])), ranges, (r["hit"] or {}).get("items") or []), strict=True):
                c.append(x)
        return cols

    got = docs.withColumn(key, F.sha2(F.col(text), 256)).join(both, key, "left")
    return got.withColumn(found, struct_udf(each, _FOUND, _FOUND_DDL)(F.struct(F.col(text).alias("text"), F.col(hit).alias("hit"))))


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of words, hit words and items, a hash of the item ids, and whether it is contaminated."""
    found = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark)
    o = F.col("overlap")
    return found.select(
        "doc_id", o["n_words"].alias("n_words"), o["n_hit"].alias("n_hit"), F.size(o["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(o["items"], ","), 256).alias("items_sha256"), o["contaminated"].alias("contaminated"),
    )


def items_hash(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns as they are, that are not contaminated."""
    name = fresh(docs, "overlap")
    return scan(docs, benchmark, text, out=name).where(~F.col(f"{name}.contaminated")).drop(name)
