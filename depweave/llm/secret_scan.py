"""Secret scans: keyword automaton first, anchored expressions near its hits, then embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, struct_udf

#: The kinds in the order that ties are listed in.
KINDS = ("assign", "access", "hex", "github", "npm")
#: The expressions that are tried at the start of a keyword; on UTF-8 bytes, so that only ASCII letters have two cases.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])")
#: Keyword in lower case, kind, offset of the expression's start before the keyword.
KEYWORDS = (
    ("password", "assign"), ("passwd", "assign"), ("secret", "assign"), ("token", "assign"), ("apikey", "assign"), ("api_key", "assign"),
    ("akia", "access"),
    ("ghp_", "github"), ("gho_", "github"), ("ghu_", "github"), ("ghs_", "github"), ("ghr_", "github"),
    ("npm_", "npm"),
)
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that a run of hexadecimal digits is made of become h, all others a dot.
_SHAPE = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_RUN = b"h" * LEAST_HEX


def _crc_ends(token: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of what follows the prefix."""
    body, value, said = token[4:-6], zlib.crc32(token[4:-6]), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        said = _BASE62[digit : digit + 1] + said
    return bool(body) and said == token[-6:]


#: What a match of each kind must pass.
CHECKS: dict[str, tuple[re.Pattern[bytes], Callable[[re.Match[bytes]], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST_VALUE),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "github": (GITHUB, lambda m: _crc_ends(m[0])),
    "npm": (NPM, lambda m: _crc_ends(m[0])),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then by kind as KINDS lists them.

    Per kind the matches are those that a left-to-right search without overlap finds, failing ones
    included; the failing ones are dropped at the end, as they too use up their characters.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[int, int, int]] = []
    free = dict.fromkeys(CHECKS, 0)
    for last, (kind, length) in keywords.iter(raw.translate(_LOWER).decode("latin-1")):
        start = last - length + 1
        if start >= free[kind]:
            pattern, passes = CHECKS[kind]
            if m := pattern.match(raw, start):
                free[kind] = m.end()
                if passes(m):
                    spans.append((start, KINDS.index(kind), m.end()))
    shape, at = raw.translate(_SHAPE), 0
    while (at := shape.find(_RUN, at)) >= 0:
        m = HEX.match(raw, at)
        spans.append((at, KINDS.index("hex"), m.end()))
        at = m.end()
    spans.sort()
    if len(raw) == len(text):
        return [(KINDS[k], s, e) for s, k, e in spans]
    marks, places, at, points = sorted({x for s, _, e in spans for x in (s, e)}), {}, 0, 0
    for x in marks:
        points += len(raw[at:x].decode("utf-8", "surrogatepass"))
        places[x], at = points, x
    return [(KINDS[k], places[s], places[e]) for s, k, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_cached: list[ahocorasick.Automaton] = []


def _keywords() -> ahocorasick.Automaton:
    if not _cached:
        _cached.append(automaton())
    return _cached[0]


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """The rows of docs with ``out``, an array of structs ``kind, start, end`` (code points, end exclusive).

    Nulls, empty texts and clean texts get an empty array. A column of docs named like ``out`` is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(texts: list[str | None]) -> list[list]:
        return [[[{"kind": k, "start": s, "end": e} for k, s, e in find(t, _keywords())] for t in texts]]

    run = struct_udf(each, [("spans", kind)], "spans array<struct<kind string, start long, end long>>")
    name = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.withColumn(name, run(F.col(text))).select(*kept, F.col(f"{name}.spans").alias(out))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, a hash of their spans, and all spans as text; null counts as empty."""
    spans = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), out="secrets").drop("text")
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every secret in the text replaced by a mark; overlapping spans become one mark.

    Texts without a secret, empty texts and nulls stay as they are.
    """

    def each(texts: list[str | None]) -> list[list]:
        out = []
        for t in texts:
            parts, at, end = [], 0, -1
            for _, s, e in find(t, _keywords()):
                if s >= end:
                    parts += [t[at:s], mark]
                at = end = max(end, e)
            out.append("".join(parts) + t[at:] if parts else t)
        return [out]

    run = struct_udf(each, [("text", pa.string())], "text string")
    name = fresh(docs, "clean")
    return docs.withColumn(name, run(F.col(text))).withColumn(text, F.col(f"{name}.text")).drop(name)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
