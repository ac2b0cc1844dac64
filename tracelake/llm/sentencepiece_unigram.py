"""SentencePiece encoding and decoding under the unigram rule: the segmentation of highest total score, by Viterbi over a trie.

Pieces and scores come from a .model file (a parameter), whose scores are taken as log scores as they stand. Pieces sit in a
double-array trie: a step along a byte is one addition and one comparison. Scores add in double precision; of segmentations
with equal scores, the one whose last piece is longest wins, position by position. A character that no piece covers costs ten
less than the lowest score and becomes byte pieces (the unknown piece where the model has none).

The model's own normalisation must be the identity: a space is written as U+2581, and one is put before a text that is not
empty where the model asks for it. As long as no piece has the marker behind another character, the best segmentation of a text
is that of its marked words in a row, so each distinct word is segmented once and remembered.

Decoding puts pieces together, byte pieces as UTF-8 (bytes that are none become U+FFFD), markers as spaces, and drops the one
that encoding put in front.

Defined cases: a null text is an empty one, which has no pieces; texts and words of any length are segmented whole, in linear steps; of
segmentations of equal score the first found is taken; each row gives a row, repeated or without doc_id or not; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import binary, documents, map_arrow, worker_value

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers at most.
MEMO_ENTRIES = 500_000


def _fields(data: bytes):
    """(field, value) of a protocol buffer's message: numbers as int, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 2: None, 5: 4}[key & 7]
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class DoubleArray:
    """A trie of byte strings. From state s, byte c leads to base[s] + c if check there is s; value[s] is a string's number or -1."""

    def __init__(self, strings: list[bytes]):
        size = 1024
        base, check, value = (np.full(size, k, dtype=np.int64) for k in (0, -1, -1))
        check[0] = 0
        low = 1  # no slot before it is free
        todo = deque([(0, sorted((s, k) for k, s in enumerate(strings)), 0)])
        while todo:
            state, rows, depth = todo.popleft()
            children: dict[int, list] = {}
            for s, k in rows:
                if len(s) == depth:
                    value[state] = k
                else:
                    children.setdefault(s[depth], []).append((s, k))
            if not children:
                continue
            codes = sorted(children)
            window = 256
            while True:
                if low + window + 512 >= len(check):
                    base, check, value = (np.append(x, np.full(len(x), k, dtype=np.int64)) for x, k in ((base, 0), (check, -1), (value, -1)))
                free = np.flatnonzero(check[low : low + window] < 0) + low - codes[0]
                free = free[free > 0]
                for c in codes[1:]:
                    free = free[check[free + c] < 0]
                if len(free):
                    break
                window *= 4
                while low + window + 512 >= len(check):
                    base, check, value = (np.append(x, np.full(len(x), k, dtype=np.int64)) for x, k in ((base, 0), (check, -1), (value, -1)))
            at = int(free[0])
            base[state] = at
            check[[at + c for c in codes]] = state
            while check[low] >= 0:
                low += 1
            todo.extend((at + c, children[c], depth + 1) for c in codes)
        end = int(np.flatnonzero(check >= 0)[-1]) + 1
        self.base, self.check, self.value = (x[:end].tolist() for x in (base, check, value))

    def prefixes(self, data: bytes, at: int = 0):
        """(end, number) of every string that begins at `at`."""
        base, check, value = self.base, self.check, self.value
        state, n, size = 0, len(check), len(data)
        while at < size:
            step = base[state] + data[at]
            if not base[state] or step >= n or check[step] != state:
                return
            state = step
            at += 1
            if value[state] >= 0:
                yield at, value[state]


class Memo(dict):
    """Segmented words: (ids, score, characters without a piece). It looks into the one before it, so words in use move on."""

    def __init__(self, model: Unigram, old: dict | None = None):
        super().__init__()
        self.model = model
        self.old = {} if old is None else old

    def __missing__(self, word: str) -> tuple[bytes, float, int]:
        known = self.old.get(word)
        if known is None:
            ids, score, unknown = self.model.segment(word)
            known = struct.pack(f"<{len(ids)}I", *ids), score, unknown
        self[word] = known
        return known

    def __reduce__(self):
        return Memo, (self.model,)


class Unigram:
    def __init__(self, model: bytes):
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, charsmap, tidy, escape = True, b"", True, True
        for field, value in _fields(model):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1])
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, tidy, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap or tidy or not escape:
            raise ValueError("this model's normalisation is not the identity")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        own = [k for k, kind in enumerate(self.kinds) if kind in (NORMAL, USER_DEFINED) and self.pieces[k]]
        self.numbers = own
        self.trie = DoubleArray([self.pieces[k] for k in own])
        self.floor = min((self.scores[k] for k in own), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(self.pieces[k][3:5], 16): k for k, kind in enumerate(self.kinds) if kind == BYTE}
        # Words can be segmented one by one if a piece's markers all come first.
        self.by_word = all(MARK not in self.pieces[k].decode("utf-8", "replace").lstrip(MARK) for k in own)
        self.own_scores = [self.scores[k] for k in own]
        self.memo = Memo(self)

    def segment(self, text: str) -> tuple[list[int], float, int]:
        """(ids, score, characters without a piece) of a marked text, by Viterbi. Steps along the trie stand here in full: this is the inner loop."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        base, check, value, slots = self.trie.base, self.trie.check, self.trie.value, len(self.trie.check)
        numbers, scores, floor, low = self.numbers, self.own_scores, self.floor, -np.inf
        best = [low] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)
        piece = [-1] * (n + 1)
        at = 0
        while at < n:
            first = data[at]
            single = at + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
            so_far, covered = best[at], False
            state, end = 0, at
            while end < n:
                step = base[state]
                if not step:
                    break
                step += data[end]
                if step >= slots or check[step] != state:
                    break
                state = step
                end += 1
                k = value[state]
                if k >= 0:
                    score = so_far + scores[k]
                    if end == single:
                        covered = True
                    if score > best[end]:
                        best[end] = score
                        back[end] = at
                        piece[end] = k
            if not covered and so_far + floor > best[single]:
                best[single] = so_far + floor
                back[single] = at
                piece[single] = -1
            at = single
        ids: list[int] = []
        end, unknown = n, 0
        while end > 0:
            at, k = back[end], piece[end]
            if k >= 0:
                ids.append(numbers[k])
            else:
                unknown += 1
                ids += [self.bytes[b] for b in reversed(data[at:end])] if self.bytes else [self.unknown]
            end = at
        ids.reverse()
        return ids, best[n], unknown

    def marked(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> tuple[bytes, float, int]:
        """(ids as little-endian unsigned 32-bit, score, characters without a piece)."""
        words = WORDS.findall(self.marked(text)) if self.by_word else [self.marked(text)] if text else []
        if not words:
            return b"", 0.0, 0
        if len(self.memo) > MEMO_ENTRIES // 2:
            self.memo.old = {}
            self.memo = Memo(self, self.memo)
        ids, scores, unknown = zip(*map(self.memo.__getitem__, words), strict=True)
        return b"".join(ids), float(sum(scores)), sum(unknown)

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    @property
    def raw(self) -> list[bytes]:
        """What each piece stands for; control pieces stand for nothing."""
        if not hasattr(self, "_raw"):
            stands = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
            self._raw = [stands.get(kind, lambda p: p)(p) for p, kind in zip(self.pieces, self.kinds, strict=True)]
        return self._raw


WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _model(spark: SparkSession, path: str):
    """The model, built once on the driver, for the workers; its size does not depend on the data."""
    with open(path, "rb") as f:
        data = f.read()
    key = (len(data), zlib.crc32(data))
    if key not in _BUILT:
        _BUILT[key] = Unigram(data)
    return spark.sparkContext.broadcast(_BUILT[key]), key


_BUILT: dict[tuple, Unigram] = {}


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), score, n_unknown for every whole text. No shuffle."""
    held, key = _model(docs.sparkSession, model_path)

    def make():
        model = worker_value(("unigram", key), lambda: held.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, score, unknown = zip(*map(model.encode, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            return pa.RecordBatch.from_arrays([b.column(0), binary(list(ids)), pa.array(score, type=pa.float64()), pa.array(unknown, type=pa.int64())], ["doc_id", "ids", "score", "n_unknown"])

        return batch

    return map_arrow(documents(docs), "doc_id long, ids binary, score double, n_unknown long", make)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of encode_documents()'s rows; null ids give an empty text."""
    held, key = _model(encoded.sparkSession, model_path)

    def make():
        model = worker_value(("unigram", key), lambda: held.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or b"") for x in b.column(1).to_pylist()], type=pa.string())], ["doc_id", "text"])

        return batch

    return map_arrow(encoded.select("doc_id", "ids"), "doc_id long, text string", make)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_unknown, score, ids_crc32, and whether decoding gives the text again, encoding and decoding each once."""
    held, key = _model(docs.sparkSession, model_path)

    def make():
        model = worker_value(("unigram", key), lambda: held.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            got = [model.encode(t) for t in texts]
            same = [model.decode(ids) == t for t, (ids, _, _) in zip(texts, got, strict=True)]
            arrays = [pa.array([len(g[0]) // 4 for g in got], type=pa.int64()), pa.array([g[2] for g in got], type=pa.int64()), pa.array([g[1] for g in got], type=pa.float64()), pa.array([zlib.crc32(g[0]) for g in got], type=pa.int64()), pa.array(same, type=pa.bool_())]
            return pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_pieces", "n_unknown", "score", "ids_crc32", "decodes_to_text"])

        return batch

    return map_arrow(documents(docs), "doc_id long, n_pieces long, n_unknown long, score double, ids_crc32 long, decodes_to_text boolean", make)
