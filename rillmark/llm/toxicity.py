"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, its pairs of neighbours and its pairs
with one word between, hashed to 2**BITS buckets.  Training is online, one row after
the other in the order of a hash of the id, with a learning rate for each coordinate;
the L1 penalty leaves few weights, which are broadcast as (bucket, weight) (at most 2**BITS of them) and
summed over each whole text in place, without a shuffle.

Training takes SAMPLE labelled rows at most, those with the least hashes of ids; that
bound is what makes one task enough for it.  That task reads buckets alone: texts are hashed
where they are.  Scoring covers every row.

Defined results: null and empty texts get the score of the bias alone; without any
labelled row the score is 0.5; a doc_id labelled twice counts once with its greatest
label, and with its least text; null labels and null ids are not learnt from; a null id
is never held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import words as W
from rillmark.llm.cluster import held_out

BITS, SAMPLE, EPOCHS = 20, 20_000, 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.0
_SALTS = (np.uint64(0x51), np.uint64(0xB2), np.uint64(0xC3))


#: Buckets with weights, sorted, and these; the bias, if any, has bucket 2**BITS.
Weights = tuple[np.ndarray, np.ndarray]


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair and skip-pair; repeats are not removed."""
    doc, h = w.doc(), w.hash
    found = [(doc, h)]
    for gap in (1, 2):
        at = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(h) > gap else np.zeros(0, np.int64)
        found.append((doc[at], W.pair(h[at], h[at + gap])))
    buckets = [(W.mix(x ^ salt) >> np.uint64(64 - BITS)).astype(np.int64) for (_, x), salt in zip(found, _SALTS, strict=True)]
    return np.concatenate([d for d, _ in found]), np.concatenate(buckets)


class Ftrl:
    """Weights by bucket; the last one is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        i = np.append(buckets, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as 16-bit steps; 65535 is a step that ends at no bucket."""
    step = np.diff(buckets, prepend=0)
    out = np.full(int((step // 65535 + 1).sum()), 65535, "<u2")
    out[np.cumsum(step // 65535 + 1) - 1] = step % 65535
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    step = np.frombuffer(raw, "<u2")
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def fit(rows: list[tuple[bytes, int]]) -> Weights:
    """Rows have packed distinct buckets and a label."""
    model = Ftrl()
    for _ in range(EPOCHS):
        for buckets, label in rows:
            model.learn(unpacked(buckets), label)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32)


def dense(weights: Weights) -> np.ndarray:
    """By bucket, the bias last."""
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[weights[0]] = weights[1]
    return out


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """weights: by bucket, the bias last."""
    out = np.full(len(column), float(weights[-1]))
    some = weights[:-1] != 0
    for i, j, w in W.of_column(column, W.ALNUM):
        doc, bucket = features(w)
        on = some[bucket]
        once = np.unique(doc[on] << BITS | bucket[on])
        out[i:j] += np.bincount(once >> BITS, weights[once & ((1 << BITS) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, rest: int, most: int) -> DataFrame:
    """(h, doc_id, text, label) of `most` learnable rows at most; they are learnt in the order of h."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id", mod, rest))
    own = own.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    chosen = own.orderBy("h", "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"), F.max("h").alias("h")).select("h", "doc_id", "text", "label")


def trained(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, label_col: str = "toxic", sample: int = SAMPLE) -> Weights:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in W.of_column(batch.column(2), W.ALNUM):
                doc, bucket = features(w)
                once = np.unique(doc << BITS | bucket)
                cut = np.searchsorted(once >> BITS, np.arange(j - i + 1))
                once &= (1 << BITS) - 1
                own = pa.array([packed(once[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1, 3)), own], names=["h", "doc_id", "label", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)
        at, w = fit(rows)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "weight": pa.array(w, pa.float32())})

    chosen = labelled(docs, labels, label_col, mod, rest, sample).mapInArrow(hashed, "h long, doc_id long, label int, buckets binary")
    found = chosen.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(run, "bucket int, weight float").toArrow().sort_by("bucket")
    return found["bucket"].to_numpy(), found["weight"].to_numpy()


def scored(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dense(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), weights))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, weights: Weights, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dense(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), weights) < threshold))

    return docs.mapInArrow(run, docs.schema)
