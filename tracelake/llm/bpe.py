"""Byte-level BPE over pre-tokens: splitting a text as the vocabulary's pre-tokenizer does, and a memo of encoded pre-tokens.

The vocabulary file is a parameter. Its text travels to the workers as a broadcast value: its size does not depend on the data.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

from tracelake.llm.common import worker_value

#: Characters beyond these make a text take the pattern of the whole plane, or of all planes, which are slower.
BEYOND_LATIN = re.compile("[^\\x00-ɏ‐-‧‰-⁞€]")
BEYOND_PLANE = re.compile("[\U00010000-\U0010ffff]")
LATIN, PLANE, ALL = 0x24F, 0xFFFF, sys.maxunicode
#: Pre-tokens that a worker remembers at most (but for those of one batch). Bounds memory only: results do not depend on it.
MEMO_ENTRIES = 600_000
#: New pre-tokens that the library encodes in one go.
LEARNED_TOGETHER = 20_000


def _in_class(kind: str, c: str) -> bool:
    category = unicodedata.category(c)
    return category == "Cn" if kind == "unassigned" else category[0] == "Z" or c in "\t\n\v\f\r\x85" if kind == "space" else category[0] == kind


@lru_cache
def character_class(kind: str, last: int) -> str:
    """The characters up to `last` of a class (L, N, space or unassigned), as ranges for a regular expression."""
    out, begin = [], None
    for c in range(last + 2):
        inside = c <= last and _in_class(kind, chr(c))
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(rf"\U{begin:08x}-\U{c - 1:08x}")
            begin = None
    return "".join(out)


@lru_cache
def pretoken_pattern(last: int) -> re.Pattern[str]:
    """The byte-level pre-tokenizer's pattern for texts of characters up to `last`."""
    letters, numbers, spaces = (character_class(k, last) for k in ("L", "N", "space"))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


@lru_cache
def unassigned() -> re.Pattern[str]:
    """Characters that this Python's Unicode does not know: the library's may have given them a class."""
    return re.compile(f"[{character_class('unassigned', ALL)}]")


class Vocabulary:
    """A tokenizers .json file: its text, special strings and a digest that names it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        self.key = (len(self.text), zlib.crc32(self.text.encode()))

    def broadcast(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self.text)


def special_strings(spec: dict) -> tuple[str, ...]:
    return tuple(t["content"] for t in spec["added_tokens"])


def is_plain_byte_level(spec: dict) -> bool:
    """True if the file's pre-tokenizer is the one that pretoken_pattern() stands for and nothing else touches text or ids."""
    pre = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and spec["post_processor"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
    loose = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"] for t in spec["added_tokens"])
    return plain and not loose and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


@lru_cache
def _special_pattern(specials: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")


def pretokens(text: str, specials: tuple[str, ...]) -> list[str] | None:
    """The pre-tokens, special strings among them as they stand; None if the text holds a character that is not assigned."""
    last = LATIN
    if not text.isascii() and BEYOND_LATIN.search(text):
        if unassigned().search(text):
            return None
        last = ALL if BEYOND_PLANE.search(text) else PLANE
    find = pretoken_pattern(last).findall
    if not any(s in text for s in specials):
        return find(text)
    out: list[str] = []
    for k, part in enumerate(_special_pattern(specials).split(text)):
        if k % 2:
            out.append(part)
        else:
            out += find(part)
    return out


class Memo(dict):
    """Pre-tokens' ids; a pre-token that is not there yet stands for itself and is listed as new.

    It looks into the one before it, so pre-tokens in use move on and the rest is forgotten with that one.
    """

    def __init__(self, old: dict | None = None):
        super().__init__()
        self.new: list[str] = []
        self.old: dict = {} if old is None else old

    def __missing__(self, word: str) -> bytes | str:
        known = self.old.get(word)
        if known is None:
            known = word
            self.new.append(word)
        self[word] = known
        return known


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned integers of `dtype`.

    Byte-level BPE encodes pre-tokens on their own, so ids of a text are its pre-tokens' ids in a row. The library encodes
    each distinct pre-token of a batch once, newline-joined with the other new ones; a memo keeps the bytes. A special string
    is a pre-token of its own. Other vocabularies, and texts that pretokens() does not split, go to the library whole.
    """

    def __init__(self, text: str, entries: int | None = None):
        self.entries = entries
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = special_strings(spec)
        most = max(self.library.get_vocab_size(with_added_tokens=True), *(t["id"] + 1 for t in spec["added_tokens"]), 1)
        self.dtype = np.dtype("<u2" if most <= 65536 else "<u4")
        self.memo = Memo()
        self.newline = self._ids("\n")
        self.split = is_plain_byte_level(spec) and len(self.newline) == 1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self) -> None:
        """Encodes the memo's new pre-tokens: one that is not all white space has none but a first space, so newlines part them."""
        memo, words = self.memo, self.memo.new
        memo.new = []
        joined = [w for w in words if not w.isspace() and w not in self.specials]
        for at in range(0, len(joined), LEARNED_TOGETHER):
            part = joined[at : at + LEARNED_TOGETHER]
            ids = self._ids("\n".join(part))
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)) * self.dtype.itemsize
            if len(ends) == len(part):
                raw, begin, step = ids.tobytes(), 0, self.dtype.itemsize
                for w, end in zip(part, ends.tolist(), strict=True):
                    memo[w] = raw[begin:end]
                    begin = end + step
        for w in words:
            if memo[w] is w:
                memo[w] = self._ids(w).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.memo) > (self.entries or MEMO_ENTRIES) // 2:
            self.memo.old = {}
            self.memo = Memo(self.memo)
        memo = self.memo
        parts: list[list | None] = []
        for text in texts:
            words = pretokens(text, self.specials) if self.split else None
            parts.append(None if words is None else list(map(memo.__getitem__, words)))
        if memo.new:
            self._learn()
        out = []
        for text, own in zip(texts, parts, strict=True):
            if own is None:
                out.append(self._ids(text).tobytes())
                continue
            try:
                out.append(b"".join(own))
            except TypeError:  # pre-tokens that were new
                out.append(b"".join([x if type(x) is bytes else memo[x] for x in own]))
        return out


def encoder(key: tuple, text, entries: int | None = None) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, with a memo of so many pre-tokens."""
    return worker_value(("encoder", key, entries), lambda: Encoder(text.value, entries))
