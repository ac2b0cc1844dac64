"""Token counts without ids: pre-tokens that are one token are counted at sight, only the rest is merged.

Offline, on the driver, each vocabulary string is run through the merges on its own. Those that end as the single token they
name, and that the pre-tokenizer keeps as one pre-token, are proven: such a pre-token counts one wherever it stands. Workers
merge other pre-tokens by rank and remember how many tokens they make.

Counts equal those of the tokenizers library with its defaults: a special string inside a text is one token; no begin, end or
added tokens; no truncation or padding. Texts of any script go by this method; only one with a character that Python's Unicode
does not know (the library may be of a later version) is counted by the library, as is every text of another kind of vocabulary.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); texts are read whole, and a pre-token of any length is
merged in n log n steps; each row gives a row, repeated or without doc_id or not; equally ranked pairs are merged from the left;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import cached_property
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.bpe import Vocabulary, is_plain_byte_level, pretokens, special_strings
from tracelake.llm.common import documents, map_arrow, worker_value

LIMIT = 512
#: Pre-tokens that a worker remembers; beyond it starts anew from the proven ones.
MEMO_ENTRIES = 400_000
#: Bytes beyond which a pre-token is merged by a heap, and characters beyond which it is not remembered.
LONG_WORD, LONGEST_KEPT = 48, 256


def byte_symbols() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


class Merges:
    """Merge ranks by pairs of symbols."""

    def __init__(self, spec: dict):
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.symbol = byte_symbols()

    def tokens(self, word: str) -> list[str]:
        """The word's tokens: the lowest-ranked pair is merged wherever it stands, until no pair has a rank."""
        parts = [self.symbol[b] for b in word.encode()]
        if len(parts) > LONG_WORD:
            return self._long(parts)
        rank, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            a, b = parts[at], parts[at + 1]
            out, k = parts[:at], at
            while k < len(parts):
                if parts[k] == a and k + 1 < len(parts) and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same by a heap of pairs over linked parts, in n log n steps."""
        rank = self.rank.get
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            j = after[k]
            # A part that was merged into the one before it is empty; a pair that has changed since has another rank.
            if j >= n or rank((parts[k], parts[j])) != r:
                continue
            parts[k] += parts[j]
            parts[j] = ""
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (r := rank((parts[k], parts[m]))) is not None:
                    heappush(heap, (r, k))
            i = before[k]
            if i >= 0 and (r := rank((parts[i], parts[k]))) is not None:
                heappush(heap, (r, i))
        return [p for p in parts if p]


def whole_tokens(spec: dict) -> list[str]:
    """The vocabulary strings proven to encode alone as one token, as text."""
    merges = Merges(spec)
    byte = {s: b for b, s in merges.symbol.items()}
    proven = []
    for token in spec["model"]["vocab"]:
        try:
            text = bytes(byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not the bytes of whole characters: no text has it as a pre-token
        if text not in special_strings(spec) and pretokens(text, special_strings(spec)) == [text] and merges.tokens(text) == [token]:
            proven.append(text)
    return proven


class Memo(dict):
    """Tokens by pre-token: proven ones are there from the start, others are merged when first seen."""

    def __init__(self, whole: dict[str, int], merges: Merges):
        super().__init__(whole)
        self.whole, self.merges = whole, merges

    def __missing__(self, word: str) -> int:
        n = len(self.merges.tokens(word))
        if len(word) <= LONGEST_KEPT:
            self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.update(self.whole)


class Counter:
    """Counts tokens of whole texts."""

    def __init__(self, text: str, proven: list[str] | None = None):
        spec = json.loads(text)
        self.text = text
        self.specials = special_strings(spec)
        self.split = is_plain_byte_level(spec)
        self.whole = dict.fromkeys([*(whole_tokens(spec) if proven is None else proven), *self.specials], 1) if self.split else {}
        self.memo = Memo(self.whole, Merges(spec)) if self.split else None

    @cached_property
    def library(self):
        """The tokenizers library, for texts that are not split here."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.text)
        library.no_truncation()
        library.no_padding()
        return library

    def __call__(self, text: str) -> int:
        words = pretokens(text, self.specials) if self.split else None
        if words is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        self.memo.trim()
        return sum(map(self.memo.__getitem__, words))


_PROVEN: dict[tuple, list[str]] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document. No shuffle; the vocabulary and its proofs are broadcast."""
    spark, voc = docs.sparkSession, Vocabulary(vocabulary)
    key = voc.key
    if key not in _PROVEN:
        spec = json.loads(voc.text)
        _PROVEN[key] = whole_tokens(spec) if is_plain_byte_level(spec) else []
    held = spark.sparkContext.broadcast((voc.text, _PROVEN[key]))

    def make():
        count = worker_value(("counter", key), lambda: Counter(*held.value))

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array([x > limit for x in n], type=pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return batch

    return map_arrow(documents(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
