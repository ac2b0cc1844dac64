"""Language identification word by word: a linear-chain conditional random field over the words of a text.

Emissions are sums of learned weights of hashed features of a word: its affixes (1 to 4 bytes at either end), its inner 2- and
3-grams, and the word itself (the lexicon). Transitions between the languages of neighbouring words are learned with them, on
sequences in which passages of documents of all languages follow one another, so a passage switches when enough words say so.
Forward-backward gives each word's probabilities; a document's language is the one with the largest sum over its words that
have a letter, and the score is that sum's share.

Training takes a passage of at most PASSAGE words of each of at most TRAIN_DOCS documents, picked by a hash of doc_id over the
whole table, among those that the split leaves for learning; prediction reads the text only, and whole texts. Forward-backward
is exact: texts are cut into blocks whose transfer matrices are multiplied up, so a batch takes as many steps as its blocks.

Defined cases: a text that is null or has no letter (category L) is `und` with score 0; without any learned language every text is;
with one language it is that one's wherever there is a letter; of languages with equal sums the first by name is taken; long texts
are labelled whole, in blocks; a null doc_id counts as held out from learning; repeated rows are rows of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import ALL, character_class
from tracelake.llm.common import documents, map_arrow, map_rows, release
from tracelake.llm.hashing import mix, rolling

BITS = 16
TRAIN_DOCS = 4000
PASSAGE = 24
ROW = 64
ROUNDS = 60
#: Words whose transfer matrices are multiplied one after the other.
BLOCK = 64
#: Words that a worker remembers; beyond it starts anew.
MEMO_ENTRIES = 100_000
HELD_OUT = 2
UNDETERMINED = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache
def letter() -> re.Pattern[str]:
    """A letter: Unicode's category L, without numerals that are letters in other respects."""
    return re.compile(f"[{character_class('L', ALL)}]")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of every feature of the words."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) + 1
    end = begin + size
    owner = np.repeat(np.arange(len(words)), size + 1)  # of each place from a word's first byte to the space behind it
    number, bucket = [], []

    def add(kind: int, at: np.ndarray, who: np.ndarray, n: int) -> None:
        number.append(who)
        bucket.append(mix(rolled[n][at] + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF), BITS))

    rolled = {n: rolling(data, n) for n in (2, 3, 4, 5)}
    every = np.arange(len(words))
    for n in (1, 2, 3, 4):
        long = size >= n
        add(1, begin[long] - 1, every[long], n + 1)
        add(2, end[long] - n, every[long], n + 1)
    for n in (2, 3):
        at = np.arange(1, len(data) - n)
        fits = at + n <= end[owner[at - 1]]
        add(3, at[fits], owner[at[fits] - 1], n)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(np.append(begin, len(data)), np.append(size + 1, 1))[: len(data)].astype(np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) * (data.astype(np.uint64) ^ np.uint64(0x5DEECE66D)), out=total[1:])
    whole = total[end] - total[begin]
    number.append(every)
    bucket.append(mix(((whole ^ (whole >> np.uint64(32))) + np.uint64(4)).astype(np.uint32), BITS))
    return np.concatenate(number), np.concatenate(bucket)


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """(word, language): sums of weights."""
    out = np.zeros((len(words), weights.shape[1]), dtype=np.float32)
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        number, bucket = word_features(part)
        for k in range(weights.shape[1]):
            out[at : at + len(part), k] = np.bincount(number, weights=weights[bucket, k], minlength=len(part))
    return out


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _row_marginals(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (row, place, language) and expected transitions of rows of equal length; e, a: exponentials of scores."""
    rows, n, k = e.shape
    alpha = np.empty_like(e)
    beta = np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, n):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        right = e[:, t + 1] * beta[:, t + 1]
        x = right @ a.T
        beta[:, t] = x / x.sum(1, keepdims=True)
        joint = alpha[:, t][:, :, None] * a[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pairs


def fit(passages: list[tuple[str, list[bytes]]], rounds: int = ROUNDS, seed: int = 7) -> Crf:
    """Maximum likelihood of passages (language, words) in a shuffled row, by Adam on the whole sample."""
    languages = sorted({lang for lang, words in passages if words})
    k = len(languages)
    if k < 2:
        return Crf(languages, np.zeros((1 << BITS, k), dtype=np.float32), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(passages))
    number: dict[bytes, int] = {}
    ids: list[int] = []
    truth: list[int] = []
    for p in order.tolist():
        lang, words = passages[p]
        ids += [number.setdefault(w, len(number)) for w in words]
        truth += [languages.index(lang)] * len(words)
    row = min(ROW, len(ids))
    whole = len(ids) // row * row
    # Rows of equal length, and one of what is left.
    rows = [tuple(np.array(v[a:b]).reshape(-1, width) for v in (ids, truth)) for a, b, width in ((0, whole, row), (whole, len(ids), len(ids) - whole)) if b > a]
    flat = np.array(ids)
    who, bucket = word_features(list(number))
    weights, transitions = np.zeros((1 << BITS, k)), np.zeros((k, k))
    target = np.zeros((len(number), k))
    np.add.at(target, (flat, np.array(truth)), 1)
    steps = np.zeros((k, k))
    for _, y in rows:
        np.add.at(steps, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for r in range(1, rounds + 1):
        em = np.stack([np.bincount(who, weights=weights[bucket, j], minlength=len(number)) for j in range(k)], axis=1)
        em -= em.max(1, keepdims=True)
        odds = np.exp(np.maximum(em, -30))
        got = [_row_marginals(odds[x], np.exp(transitions)) for x, _ in rows]
        gamma = np.concatenate([g.reshape(-1, k) for g, _ in got])
        expected = np.stack([np.bincount(flat, weights=gamma[:, j], minlength=len(number)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(bucket, weights=(expected - target)[who, j], minlength=1 << BITS) for j in range(k)], axis=1) / flat.size + 1e-6 * weights
        gt = (sum(p for _, p in got) - steps) / flat.size + 1e-5 * transitions
        for value, grad, m, v, rate in ((weights, g, state[0], state[1], 0.05), (transitions, gt, state[2], state[3], 0.1)):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-7)
    return Crf(languages, weights.astype(np.float32), transitions)


class Labeller:
    """Predicts documents in batches with what it remembers of words."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.a = np.exp(crf.transitions).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.e = np.zeros((0, len(self.crf.languages)), dtype=np.float32)
        self.letter = np.zeros(0, dtype=bool)

    def _look_up(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MEMO_ENTRIES:
            self.clear()
        number, had = self.number, len(self.number)
        found = []
        for t in texts:
            words = words_of(t)
            found.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
        if len(number) > had:
            new = list(islice(number, had, None))
            em = emissions(new, self.crf.weights)
            if em.shape[1]:
                em -= em.max(1, keepdims=True)
            self.e = np.concatenate([self.e, np.exp(np.maximum(em, -30))])
            self.letter = np.concatenate([self.letter, np.array([letter().search(w.decode("utf-8", "replace")) is not None for w in new], dtype=bool)])
        return found

    def marginals(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Of each text (as numbers of words), the probabilities (word, language)."""
        a, k = self.a, len(self.crf.languages)
        size = np.array([len(f) for f in found], dtype=np.int64)
        blocks = -(-size // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64)
        total = int(blocks.sum())
        if not total:
            return [np.zeros((0, k), dtype=np.float32) for _ in found]
        flat = np.full(total * BLOCK, -1, dtype=np.int64)
        for f, at in zip(found, first.tolist(), strict=True):
            flat[at * BLOCK : at * BLOCK + len(f)] = f
        real = (flat >= 0).reshape(total, BLOCK)
        e = self.e[flat].reshape(total, BLOCK, k)  # padding takes any row; it is never used
        # Products of a block's transfer matrices.
        product = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
        for t in range(BLOCK):
            own = real[:, t]
            if not own.any():
                break
            p = (product[own].reshape(-1, k) @ a).reshape(-1, k, k) * e[own, t][:, None, :]
            product[own] = p / p.max((1, 2), keepdims=True)
        # Messages into each block from the left and from the right.
        left = np.full((total, k), 1 / k, dtype=np.float32)
        right = np.ones((total, k), dtype=np.float32)
        for b in range(1, int(blocks.max())):
            at = first[blocks > b] + b
            x = np.einsum("ij,ijk->ik", left[at - 1], product[at - 1])
            left[at] = x / x.sum(1, keepdims=True)
        for b in range(2, int(blocks.max()) + 1):
            at = first[blocks >= b] + blocks[blocks >= b] - b
            x = np.einsum("ijk,ik->ij", product[at + 1], right[at + 1])
            right[at] = x / x.sum(1, keepdims=True)
        alpha = np.zeros((total, BLOCK, k), dtype=np.float32)
        now = left
        for t in range(BLOCK):
            x = (now @ a) * e[:, t]
            x /= x.sum(1, keepdims=True)
            alpha[:, t] = x
            now = x
        now = right
        for t in range(BLOCK - 1, -1, -1):
            g = alpha[:, t] * now
            back = (e[:, t] * now) @ a.T
            back /= back.sum(1, keepdims=True)
            now = np.where(real[:, t][:, None], back, now)
            alpha[:, t] = g / g.sum(1, keepdims=True)
        flatter = alpha.reshape(-1, k)
        return [flatter[at * BLOCK : at * BLOCK + n] for at, n in zip(first.tolist(), size.tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        found = self._look_up(texts)
        out = []
        for f, g in zip(found, self.marginals(found) if self.crf.languages else [None] * len(found), strict=True):
            own = self.letter[f] if len(f) else np.zeros(0, dtype=bool)
            if g is None or not own.any():
                out.append((UNDETERMINED, 0.0))
                continue
            share = g[own].sum(0, dtype=np.float64) / own.sum()
            at = int(share.argmax())
            out.append((self.crf.languages[at], float(min(1.0, share[at]))))
        return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def _picked(ids: DataFrame, limit: int) -> DataFrame:
    """(doc_id): the `limit` different ids with the smallest hashes. Hashes are cut off where enough are below, so few ids are shuffled."""
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    share = min(1.0, 8 * limit / max(1, ids.count()))
    while True:
        below = ids.where(order <= int(share * (1 << 32))).distinct()
        if share >= 1 or below.limit(limit).count() == limit:
            return below.orderBy(order, "doc_id").limit(limit)
        share = min(1.0, 16 * share)


def passages(docs: DataFrame, limit: int = TRAIN_DOCS, passage: int = PASSAGE) -> list[tuple[str, list[bytes]]]:
    """(language, words) of at most `limit` rows for learning: a passage of at most `passage` words of each, at a place that a hash picks.

    Different ids are picked by a hash; of their rows, copies of one passage count once, and the first by that hash are taken.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("lang").isNotNull() & ~held_out())
    rows = own.join(F.broadcast(_picked(own.select("doc_id"), limit)), "doc_id").select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 31)).alias("at"), "text")

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = words_of(t)
                begin = at % max(1, len(w) - passage + 1)
                out.append(b" ".join(w[begin : begin + passage]))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.binary())], ["doc_id", "lang", "words"])

        return batch

    got = map_arrow(rows, "doc_id long, lang string, words binary", make).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "words").limit(limit).collect()
    return [(r["lang"], bytes(r["words"]).split()) for r in sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["words"])))]


def identify(docs: DataFrame, model: Crf | None = None, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document. No shuffle; the model is broadcast, its size is fixed."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, limit) if model is None else model)

    def make():
        label = Labeller(held.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            got = label(b.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return batch

    return map_arrow(documents(docs).select("doc_id", held_out().alias("held_out"), "text"), SCHEMA, make)


def learned(docs: DataFrame, limit: int = TRAIN_DOCS) -> Crf:
    """The model of a table's own labels."""
    crf = fit(passages(docs, limit))
    release()
    return crf


def rows_in_a_language(docs: DataFrame, least: float, languages: list[str] | None = None, model: Crf | None = None, limit: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs in which one of the languages (all learned ones if None) has at least this share of the words, with docs' own columns; none is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, limit) if model is None else model)

    def make():
        label = Labeller(held.value)
        fits = lambda lang, score: lang != UNDETERMINED and score >= least and (languages is None or lang in languages)
        return lambda texts: [pa.array([fits(*got) for got in label(texts)], type=pa.bool_())]

    return map_rows(docs, "found boolean", make).where("found").select("_row.*")
