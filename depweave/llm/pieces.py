"""SentencePiece encoding and decoding: Viterbi over a stream, with a window bounded by the longest piece."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import fresh, struct_udf

#: Where the public vocabulary lies that queries use; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
#: Stretches of text whose ids are remembered by a task (it saves time only), and the longest one that is.
REMEMBERED, LONGEST = 150_000, 48
_NORMAL, _BYTE, _USER = 1, 6, 4


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a plain space for the model's space mark, so that the mark itself stays an ordinary character.

    ``pieces``: piece to (id, score). ``spelled``: the bytes that each id stands for. ``bytes_at``:
    the id of byte 0, or None where the model has no byte pieces (then ``unknown`` stands for every
    character without a piece).
    """

    pieces: dict[str, tuple[int, float]]
    spelled: list[bytes]
    unknown: int
    bytes_at: int | None
    prefix: bool
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "longest", max(map(len, self.pieces), default=1))


def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model whose normalizer leaves texts as they are.

    Of a model of the BPE kind the piece scores are used, as of one of the unigram kind.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models whose normalizer is the identity can be decoded without loss")
    spelled, pieces, at = [], {}, {}
    for i, p in enumerate(proto.pieces):
        text = p.piece.replace(_SPACE, " ")
        spelled.append(text.encode() if p.type in (_NORMAL, _USER) else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"")
        if p.type in (_NORMAL, _USER):
            pieces[text] = (i, p.score)
        elif p.type == _BYTE:
            at[spelled[-1][0]] = i
    first = at.get(0)
    if at and [at.get(b) for b in range(256)] != list(range(first, first + 256)):
        raise ValueError("byte pieces must have consecutive ids")
    return Vocabulary(pieces, spelled, proto.trainer_spec.unk_id, first, proto.normalizer_spec.add_dummy_prefix)


def _cuts(words: Vocabulary) -> re.Pattern[str] | None:
    """Stretches between boundaries that no piece spans, so that they can be encoded apart from each other.

    Where no piece has a space behind another character, that is in front of a space that follows a
    word; where no piece has a line feed, around each line feed; and in front of marks that no piece
    has behind a letter or digit, unless one has some mark behind what stands there. None if spaces
    don't cut.
    """
    if any(" " in p.lstrip(" ") for p in words.pieces):
        return None
    before: dict[str, set[str]] = {m: set() for m in "!#$%&*,.?|"}
    for p in words.pieces:
        for x, m in zip(p, p[1:]):
            if m in before:
                before[m].add(x)
    cut = [m for m, xs in before.items() if not any(x.isalpha() or x.isdecimal() for x in xs)]
    marks = re.escape("".join(cut))
    behind = re.escape("".join(sorted(set().union(*(before[m] for m in cut))))) or " "
    feed = "" if any("\n" in p for p in words.pieces) else "\n"
    word = f"[^ {feed}{marks}]*"
    return re.compile(f" *[^ {feed}]{word}" + (f"(?:(?<=[{behind}])[{marks}]{word})*" if marks else "") + ("|\n" if feed else "") + "| +")


class Encoder:
    """Streaming Viterbi over the pieces of a vocabulary."""

    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        #: Nodes are lists: what follows by character, and id and score of the piece that ends here, id -1 if none does.
        self.trie: dict = {}
        for text, (number, score) in words.pieces.items():
            kids, node = self.trie, None
            for c in text:
                node = kids.setdefault(c, [{}, -1, 0.0])
                kids = node[0]
            node[1:] = [number, score]
        self.unknown_score = min((s for _, s in words.pieces.values()), default=0.0) - 10
        self.memory: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.stretch = _cuts(words)

    def spell(self, character: str) -> list[int]:
        """Ids of a character that has no piece."""
        if self.words.bytes_at is None:
            return [self.words.unknown]
        return [self.words.bytes_at + b for b in character.encode("utf-8", "surrogatepass")]

    def stream(self, text: str) -> Iterator[int]:
        """The ids of the path of the highest score; of equal paths, of the one that has the longer last piece.

        Scores are kept for the boundaries that a piece may still reach, no more than the longest
        piece is long. Behind that window a boundary which no surviving path goes through is
        forgotten, and as soon as all surviving paths go through one boundary, the ids up to it are
        given out. Every boundary is settled once and forgotten once, so the time is linear in the
        text; what is retained besides the window are the surviving paths since they last met.
        """
        trie, lowest, end, window = self.trie, self.unknown_score, len(text), self.words.longest
        # By boundary from `base` on: the best piece that ends there, how many paths go on from it, and the sum of their first steps.
        base = root = 0
        length, found, kids, steps = [0], [0], [0], [0]
        low, best = 0, [0.0]  # by boundary from `low` on
        for start in range(end):
            here, kin, at, single = best[start - low], trie, start, False
            while at < end:
                node = kin.get(text[at])
                if node is None:
                    break
                at += 1
                kin, number, score = node
                if number >= 0:
                    single |= at == start + 1
                    total, k = here + score, at - low
                    while len(best) <= k:
                        best.append(None)
                        length.append(0)
                        found.append(0)
                        kids.append(0)
                        steps.append(0)
                    if best[k] is None or total > best[k]:
                        best[k], length[at - base], found[at - base] = total, at - start, number
            k = start + 1 - low
            if not single:
                if len(best) == k:
                    best.append(None)
                    length.append(0)
                    found.append(0)
                    kids.append(0)
                    steps.append(0)
                if best[k] is None or here + lowest > best[k]:
                    best[k], length[start + 1 - base], found[start + 1 - base] = here + lowest, 1, -1
            if len(best) == k + 1:  # no piece spans the next boundary: all paths meet in it
                yield from self._ids(text, length, found, base, root, start + 1)
                base = root = low = start + 1
                length, found, kids, steps, best = [0], [0], [0], [0], [best[k]]
                continue
            settled = start + 1 - base  # no piece that begins later ends here
            step = length[settled]
            kids[settled - step] += 1
            steps[settled - step] += step
            closed = start + 1 - window  # no piece from here on is still to be settled
            if closed < root:
                continue
            dead = closed
            while dead > root and not kids[dead - base]:
                step = length[dead - base]
                dead -= step
                kids[dead - base] -= 1
                steps[dead - base] -= step
            before = root
            while root <= closed and kids[root - base] == 1:
                root += steps[root - base]
            if root > before:
                yield from self._ids(text, length, found, base, before, root)
            if root - base > 4096:
                del length[: root - base], found[: root - base], kids[: root - base], steps[: root - base]
                base = root
            if start - low > 4096:
                del best[: start - low]
                low = start
        yield from self._ids(text, length, found, base, root, end)

    def _ids(self, text: str, length: list[int], found: list[int], base: int, since: int, to: int) -> list[int]:
        """Ids of the path from one boundary to another."""
        path = []
        while to > since:
            number, start = found[to - base], to - length[to - base]
            if number >= 0:
                path.append(number)
            else:
                path += reversed(self.spell(text[start]))
            to = start
        path.reverse()
        return path

    def encode(self, text: str) -> array:
        """The ids of a whole text. All paths meet where it is cut into stretches, so they are streamed one by one, each once while it is remembered."""
        out = array("i")
        if not text:
            return out
        if self.words.prefix:
            text = " " + text
        if self.stretch is None:
            out.extend(self.stream(text))
            return out
        memory, older = self.memory, self.older
        for part in self.stretch.findall(text):
            ids = memory.get(part)
            if ids is None:
                ids = older.get(part)
                if ids is None:
                    ids = array("i", self.stream(part))
                if len(part) <= LONGEST:
                    if len(memory) >= REMEMBERED:  # what was not used for two rounds is forgotten
                        self.memory, self.older = memory, older = {}, memory
                    memory[part] = ids
            out.extend(ids)
        return out


def _text(words: Vocabulary, parts: list[bytes]) -> str:
    text = b"".join(parts).decode("utf-8", "replace")
    return text[1:] if words.prefix and text[:1] == " " else text


def decode_ids(words: Vocabulary, ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return _text(words, [words.spelled[i] for i in ids])


_encoders: dict[int, Encoder] = {}


def encode(docs: DataFrame, words: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows of docs with ``out``, the ids of the whole text (array<int>).

    Null gives null, an empty text an empty array. A literal space mark (U+2581) is spelled in bytes
    and so survives decoding. A column of docs named like ``out`` is replaced. The vocabulary, of
    fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def each(texts: list[str | None]) -> list:
        if (encoder := _encoders.get(id(shared.value))) is None:
            _encoders.clear()  # workers are used again; what an earlier job left would stay
            encoder = _encoders[id(shared.value)] = Encoder(shared.value)
        offsets, flat = [0], array("i")
        for t in texts:
            if t:
                flat.extend(encoder.encode(t))
            offsets.append(len(flat))
        values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([t is None for t in texts], pa.bool_()))
        return [lists]

    run = struct_udf(each, [("ids", pa.list_(pa.int32()))], "ids array<int>")
    name = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.withColumn(name, run(F.col(text))).select(*kept, F.col(f"{name}.ids").alias(out))


def decode(docs: DataFrame, words: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows of docs with ``out``, the text of the ids; null gives null, no ids an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def each(rows: pa.ListArray) -> list[list]:
        words = shared.value
        ends = rows.offsets.to_numpy()
        spelled = np.array(words.spelled, object).take(rows.values.to_numpy())
        known = rows.is_valid().to_pylist()
        return [[_text(words, spelled[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], known)]]

    run = struct_udf(each, [("text", pa.string())], "text string", arrow=True)
    name = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.withColumn(name, run(F.col(ids))).select(*kept, F.col(f"{name}.text").alias(out))


def vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """The vocabulary at path, or at the path in the setting ``spark.depweave.pieces``, or at MODEL."""
    return load(path or spark.conf.get("spark.depweave.pieces", MODEL))
