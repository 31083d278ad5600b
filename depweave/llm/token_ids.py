"""Token ids by a tokenizer file, with the ids of words remembered."""

from __future__ import annotations

import json
import sys
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: What a file must say for texts to be encoded word by word (white space separates, case is dropped, words are spelled in bytes).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may follow a word; a run of them is one unit of the split.
_MARKS = ".,;:!?"
#: Below this letter every letter is composed already and the same in all versions of Unicode.
_PLAIN_BELOW = "ɐ"
#: Words that a worker remembers (some 100 MB), and the longest one.
REMEMBERED, LONGEST = 400_000, 64
#: How bytes are written as letters. Printable bytes are themselves, the rest follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_LETTER = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """The ids of words of a text, as bytes of little-endian unsigned 32-bit integers.

    A word is what stands between white space. A word of letters, perhaps with marks behind it, is
    put together from the model's pieces of the letters and of the marks; all others go through the
    whole tokenizer, as every text does if the file is of another kind.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, cut = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        steps = cut.get("pretokenizers", [])
        self.by_word = (
            [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZERS
            and normal["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT}
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and not spec.get("post_processor") and all(not x["content"].isalpha() and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in spec["added_tokens"])
        )

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        stem = low.rstrip(_MARKS)
        if len(word) > LONGEST:
            return self._library(word)
        if stem.isalpha() and max(stem) < _PLAIN_BELOW:
            if stem == word:
                letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_AS_LETTER)
                got = np.array([x.id for x in self.whole.model.tokenize(letters)], "<u4").tobytes()
            else:
                got = self[stem] + self[low[len(stem) :]]
        else:
            got = self._library(word)
        self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; none for null."""
        if not text:
            return b""
        if not self.by_word:
            return self._library(text)
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each worker."""
    if sys.byteorder != "little":
        raise RuntimeError("ids are kept as little-endian integers")
    return WordIds(path)
