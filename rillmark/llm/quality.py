"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs take linear
time by half the difference of the square of the sum and the sum of squares.  Inputs
are a text's words hashed to 2**BITS places (counts, scaled to length 1), STATS structure
statistics of the whole text, and its size in characters as metadata.

Training takes SAMPLE labelled rows at most, those with the least hashes of ids, by
AdaGrad in one task; weights are 2**BITS + STATS + SIZES rows of 1 + RANK floats, a
bound that makes them safe to broadcast.  That task reads places and values alone: texts are
hashed where they are.  Scoring covers every row, in place.

Defined results: null and empty texts are scored from their statistics, all zero;
without any labelled row the score is 0.5; a null or negative size counts as 0; a
doc_id labelled twice counts once with its greatest label, and with its least text;
null labels and null ids are not learnt from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import words as W
from rillmark.llm.cluster import held_out

BITS, STATS, SIZES, RANK = 15, 16, 24, 8
WIDTH = (1 << BITS) + STATS + SIZES
SAMPLE, EPOCHS, RATE, DECAY = 12_000, 3, 0.05, 1e-5
_KIND = np.zeros(256, np.int8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 punctuation, 5 white space
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[0x20, *range(9, 14)]] = 5


def _per_text(w: W.Words, value: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(value)))
    return np.diff(sums[w.first])


def statistics(w: W.Words, distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """STATS numbers between 0 and about 1 for each text."""
    n, size = w.counts, np.diff(w.at)
    at_least, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    kinds = [np.diff(np.concatenate(([0], np.cumsum(_KIND[w.raw] == k)))[w.at]) / bytes_ for k in range(6)]
    length = w.end - w.start
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc()[1:] == w.doc()[:-1])
    lines = np.diff(np.concatenate(([0], np.cumsum(w.raw == 10)))[w.at])
    first, last = (_KIND[w.raw[w.start]], _KIND[w.raw[w.end - 1]]) if len(w.hash) else (np.zeros(0, np.int8),) * 2
    before = _KIND[w.raw[np.maximum(w.end - 2, w.start)]] if len(w.hash) else np.zeros(0, np.int8)
    return np.stack(
        [
            *kinds,
            np.log1p(n) / 10,
            _per_text(w, length) / at_least / 10,
            _per_text(w, length > 14) / at_least,
            distinct / at_least,
            most / at_least,
            _per_text(w, same) / at_least,
            np.minimum(lines / at_least, 1),
            _per_text(w, last == 4) / at_least,
            _per_text(w, (last == 4) & (before == 4)) / at_least,
            _per_text(w, first == 1) / at_least,
        ],
        1,
    )


def features(column: pa.Array, sizes: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: (text, place, value), sorted by text."""
    chars = np.maximum(np.nan_to_num(sizes.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)), 0)
    for i, j, w in W.of_column(column):
        doc, rows = w.doc(), np.arange(j - i)
        pairs, counts = np.unique(doc << BITS | (W.mix(w.hash) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        owner = pairs >> BITS
        norm = np.sqrt(np.bincount(owner, counts.astype(np.float64) ** 2, minlength=j - i))
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        most = np.zeros(j - i)
        some = cut[1:] > cut[:-1]
        if len(counts):
            most[some] = np.maximum.reduceat(counts, cut[:-1][some])
        stats = statistics(w, np.diff(cut), most)
        size = np.minimum(np.log2(chars[i:j] + 1).astype(np.int64), SIZES - 1)
        t = np.concatenate((owner, np.repeat(rows, STATS), rows))
        p = np.concatenate((pairs & ((1 << BITS) - 1), np.tile(np.arange(STATS) + (1 << BITS), j - i), size + (1 << BITS) + STATS))
        x = np.concatenate((counts / norm[owner] if len(owner) else np.zeros(0), stats.ravel(), np.ones(j - i)))
        order = np.argsort(t, kind="stable")
        yield i, j, t[order], p[order], x[order]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights: a row for each place (w, v), and a last one whose w is the bias."""
    rng = np.random.default_rng(2)
    m = np.concatenate((np.zeros((WIDTH + 1, 1)), rng.normal(0, 0.05, (WIDTH + 1, RANK))), 1)
    seen = np.full((WIDTH + 1, 1 + RANK), 1e-3)
    for _ in range(EPOCHS):
        for place, x, label in rows:
            own = m[place]
            w, v = own[:, 0], own[:, 1:]
            s = x @ v
            value = m[WIDTH, 0] + w @ x + 0.5 * (s @ s - (x * x) @ (v * v).sum(1))
            g = 1 / (1 + np.exp(-np.clip(value, -35, 35))) - label
            step = np.empty_like(own)
            step[:, 0] = g * x
            step[:, 1:] = g * (x[:, None] * s - v * (x * x)[:, None])
            step += DECAY * own
            seen[place] += step * step
            m[place] = own - RATE * step / np.sqrt(seen[place])
            seen[WIDTH, 0] += g * g
            m[WIDTH, 0] -= RATE * g / np.sqrt(seen[WIDTH, 0])
    return m


def scores(column: pa.Array, sizes: pa.Array, m: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for i, j, t, p, x in features(column, sizes):
        own = m[p]
        head = np.searchsorted(t, np.arange(j - i))
        sums = np.add.reduceat(own * x[:, None], head)
        squares = np.add.reduceat(((own[:, 1:] * x[:, None]) ** 2).sum(1), head)
        out[i:j] = m[WIDTH, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def trained(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id", mod, rest))
    own = own.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    chosen = own.orderBy("h", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"), F.max("label").alias("label"), F.max("h").alias("h"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t, p, x in features(batch.column(2), batch.column(3)):
                cut = np.searchsorted(t, np.arange(j - i + 1))
                own = [pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for v in (p.astype("<i4"), x.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1, 4)), *own], names=["h", "doc_id", "label", "places", "amounts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(p, "<i4"), np.frombuffer(x, "<f8"), y) for batch in batches for y, p, x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(rows).astype("<f4").tobytes() if rows else b""], pa.binary())})

    own = texts.select("h", "doc_id", "text", "n_chars", "label").mapInArrow(hashed, "h long, doc_id long, label int, places binary, amounts binary")
    for (found,) in own.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(run, "weights binary").collect():
        if found:
            return np.frombuffer(bytes(found), "<f4").reshape(WIDTH + 1, 1 + RANK).astype(np.float64)
    return np.zeros((WIDTH + 1, 1 + RANK))


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), batch.column(2), sent.value))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.col(size_col)).mapInArrow(run, "doc_id long, score double")
