"""Quality rules: counts of a text, then a logistic regression on hashed word and character n-grams, probability-calibrated.

Words are [^\\x20\\x09-\\x0D]+. Features are the shares of hashed words, word pairs and character 3-, 4- and 5-grams of a whole
text among those of their kind; characters are taken as bytes of UTF-8, so an n-gram beyond ASCII spans fewer characters. The model is trained on labelled rows (quality 1 or 0), at most TRAIN_ROWS of them, taken by a
hash of doc_id over the whole table; one row in three is held back and calibrates the probability (Platt scaling). A document
is kept if the base rule holds and its calibrated probability of good quality reaches KEEP_AT, a fixed threshold.

Scoring is a pass over Arrow batches without a shuffle; the weights are broadcast, their size is fixed.

Defined cases: a null text has no words, fails the base rule and is dropped; without labelled rows, or with one class only,
every probability is that class's share (1.0 without any) and the base rule decides; repeated and contradicting labels train as
they stand; an empty table gives no rows; other columns are ignored. Words in a window found twice are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import binary, documents, map_arrow, map_rows, release
from tracelake.llm.hashing import mix, rolling, spans

#: Buckets of hashed features, as a power of two, for each kind of n-gram.
BITS = 17
KINDS = 5
TRAIN_ROWS = 1200
#: Tasks that make the features of training rows.
TRAIN_TASKS = 12
KEEP_AT = 0.5
#: Bytes whose n-grams are hashed at a time.
BLOCK = 1 << 20

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not equal.any():
        return 0
    suspect = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    seen: dict[tuple, list[int]] = {}
    for at in suspect.tolist():
        seen.setdefault(tuple(ids[at : at + window].tolist()), []).append(at)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(cover, places, 1)
            np.add.at(cover, np.array(places) + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = len(data) - len(data.translate(None, SPACES))
    return len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def features(data: bytes):
    """(kind, buckets) of a text's hashed n-grams, block by block: words, word pairs, 3-, 4- and 5-grams of bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        words = []
        at = 0
        while at < len(begin):  # whole words, about BLOCK bytes at a time
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + BLOCK)))
            lo = begin[at]
            words.append(spans(a[lo : end[to - 1]], begin[at:to] - lo, end[at:to] - lo))
            at = to
        h = np.concatenate(words)
        yield 0, mix(h.copy(), BITS)
        if len(h) > 1:
            yield 1, mix(h[:-1] * np.uint32(0x9E3779B1) + h[1:], BITS)
    for n in (3, 4, 5):
        for at in range(0, max(1, len(a) - n + 1), BLOCK):
            h = rolling(a[at : at + BLOCK + n - 1], n)
            if len(h):
                yield n - 1, mix(h, BITS)


def margin(data: bytes, weights: np.ndarray, bias: float) -> float:
    """The regression's score: over the kinds, the mean weight of the text's n-grams of that kind."""
    total, count = [0.0] * KINDS, [0] * KINDS
    for kind, h in features(data):
        total[kind] += float(weights[kind][h].sum(dtype=np.float64))
        count[kind] += len(h)
    return bias + sum(t / n for t, n in zip(total, count, strict=True) if n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def p_good(self, text: str) -> float:
        z = self.slope * margin(text.encode("utf-8", "replace"), self.weights, self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, held: np.ndarray, rounds: int = 120) -> Model:
    """Logistic regression by Nesterov's accelerated gradient on sparse rows (buckets over all kinds, shares), then Platt scaling on the held rows."""
    size = KINDS << BITS
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 1.0, 1e-9, 1 - 1e-9)
        return Model(np.zeros((KINDS, 1 << BITS), dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    used = ~held if len(set(y[~held].tolist())) == 2 else np.ones(len(y), dtype=bool)
    own = [r for r, u in zip(rows, used, strict=True) if u]
    col = np.concatenate([r[0] for r in own])
    val = np.concatenate([r[1] for r in own]).astype(np.float32)
    row = np.repeat(np.arange(len(own), dtype=np.int32), [len(r[0]) for r in own])
    cols = np.unique(col)
    col = np.searchsorted(cols, col).astype(np.int32)
    # Frequent buckets are scaled down, rare ones up, as far as a floor.
    norm = (1 / np.sqrt(np.bincount(col, weights=val * val, minlength=len(cols)) / len(own) + 1e-7)).astype(np.float32)
    val *= norm[col]
    target = y[used].astype(np.float64)
    # Both classes weigh the same.
    weight = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    longest = np.bincount(row, weights=val * val, minlength=len(own)).max()
    rate, decay = 4.0 / (longest + 1), 1e-4
    w, b = np.zeros(len(cols)), 0.0
    v, c = w, b
    for k in range(rounds):
        p = _sigmoid(np.bincount(row, weights=val * v[col], minlength=len(own)) + c)
        g = weight * (p - target) / len(own)
        w2 = v - rate * len(own) * 0.25 * (np.bincount(col, weights=val * g[row], minlength=len(cols)) + decay * v)
        b2 = c - rate * len(own) * 0.25 * float(g.sum()) / 10
        pull = k / (k + 3)
        v, c = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    weights = np.zeros(size, dtype=np.float32)
    weights[cols] = w * norm
    model = Model(weights.reshape(KINDS, -1), float(b), 1.0, 0.0)
    apart = held if len(set(y[held].tolist())) == 2 else used
    z = np.array([model.bias + float((weights[i] * s).sum()) for (i, s), h in zip(rows, apart, strict=True) if h])
    model.slope, model.shift = platt(z, y[apart])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a calibrated probability, by Newton's method on smoothed targets."""
    good, bad = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = float(np.std(z)) or 1.0
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    ab = np.zeros(2)
    loss = lambda q: float(np.logaddexp(0, x @ q).sum() - t @ (x @ q))
    for _ in range(50):
        p = _sigmoid(x @ ab)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(step).max() < 1e-7:
            break
    return float(ab[0]) / scale, float(ab[1])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> pa.Table:
    """(doc_id, quality, h, buckets, shares) of at most `limit` labelled rows, features made on the executors from whole texts.

    Different labels are taken by the order of a hash of doc_id, and joined by broadcast, since the limit bounds them. Of their
    documents, copies count once, and the first by that hash are taken.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    met = documents(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    once = met.groupBy("doc_id", "quality", "h").agg(F.first("text").alias("text"))
    rows = once.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(limit).repartition(TRAIN_TASKS).select("doc_id", "quality", "h", "text")

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            buckets, shares = [], []
            for t in b.column(3).to_pylist():
                got: list[list[np.ndarray]] = [[] for _ in range(KINDS)]
                for kind, h in features(t.encode("utf-8", "replace")):
                    got[kind].append(h)
                i, s = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
                for kind, parts in enumerate(got):
                    if parts:
                        key, n = np.unique(np.concatenate(parts), return_counts=True)
                        i.append(key.astype(np.int64) + (kind << BITS))
                        s.append(n / n.sum())
                buckets.append(np.concatenate(i).astype("<i4").tobytes())
                shares.append(np.concatenate(s).astype("<f4").tobytes())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), binary(buckets), binary(shares)], ["doc_id", "quality", "h", "buckets", "shares"])

        return batch

    return map_arrow(rows, "doc_id long, quality int, h long, buckets binary, shares binary", make).toArrow()


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    got = training_rows(docs, labels, limit)
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("h", "ascending")]).combine_chunks()
    rows = [(np.frombuffer(i.as_buffer(), dtype="<i4"), np.frombuffer(s.as_buffer(), dtype="<f4")) for i, s in zip(got.column("buckets"), got.column("shares"), strict=True)]
    quality, ids = (got.column(c).to_numpy().astype(np.int64) for c in ("quality", "doc_id"))
    model = fit(rows, quality, ids % 3 == 0)
    del got, rows
    release()
    return model


def _judged(texts: list[str], model: Model, keep_at: float) -> list[pa.Array]:
    out = []
    for t in texts:
        counts = base_counts(t)
        failed, p = base_failed(counts[0], counts[4]), model.p_good(t)
        out.append((*counts, failed, p, not failed and p >= keep_at))
    columns = list(zip(*out, strict=True)) or [()] * 8
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    return [pa.array(v, type=k) for v, k in zip(columns, kinds, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good and kept for every document."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limit))

    def make():
        model = held.value
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), *_judged(b.column(1).to_pylist(), model, keep_at)], names)

    return map_arrow(documents(docs), SCHEMA, make)


def kept_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns; each row is judged by itself, and none is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limit))

    def make():
        model = held.value
        return lambda texts: _judged(texts, model, keep_at)[-1:]

    return map_rows(docs, "kept boolean", make).where("kept").select("_row.*")
