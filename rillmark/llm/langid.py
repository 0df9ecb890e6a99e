"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams, n from 1 to LONGEST, lower-cased and hashed to 2**BITS
places.  The kernel of two texts is the size of their common set over the geometric
mean of their sizes.  LANDMARKS training texts span the Nyström approximation;
one-versus-rest ridge regression on it gives a weight of each landmark for each
language.  Scoring multiplies a batch's presence matrix by the landmarks' and the
result by these weights, in place and without a shuffle.

Training takes SAMPLE rows in all, as many of each language and at least one of each, those with the least
hashes of ids; landmarks are drawn from them in turn, LANDMARKS or one for each language.  So the model
grows with the number of languages, all of which are learnt, not with the rows.  One pass counts
the languages; another keeps of each the ids whose hash is under a bound that its count sets (EXTRA times what is wanted), and only
these are ranked.  Only the presence bits of the sample
(2**BITS / 8 bytes a row) reach the driver.  Scoring covers every row and whole texts.

Defined results: null text, and text without a letter, is `und` with score 0; without any
training row every text is `und`; a doc_id that repeats with one language is learnt
once, with its least text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm import words as W
from rillmark.llm.cluster import held_out

BITS, LONGEST, SAMPLE, LANDMARKS, RIDGE = 13, 3, 4096, 192, 1e-3
EXTRA, SPARE = 1.5, 32
ROWS, CHUNK = 256, 1 << 20
_FACTORS = np.random.default_rng(10).integers(1, 2**31, LONGEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 2**BITS zeros and ones for each text."""
    n = len(at) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(at))
    code = np.zeros(len(raw), np.uint32)
    low = _LOWER[raw].astype(np.uint32)
    for k in range(LONGEST):
        if k:
            code, doc_k = code[:-1] if len(code) else code, doc[k:]
        else:
            doc_k = doc
        code = code * np.uint32(256) + low[k:]
        inside = doc[: len(code)] == doc_k
        place = ((code + np.uint32(k)) * _FACTORS[k]) >> np.uint32(32 - BITS)
        out[doc_k[inside], place[inside]] = 1
    return out


def rows_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows with their bytes, offsets and presence."""
    raw, at = W.buffers(column)
    for a, b in W.chunks(at, CHUNK):
        for i in range(a, b, ROWS):
            j = min(b, i + ROWS)
            own = raw[at[i] : at[j]]
            yield i, j, own, at[i : j + 1] - at[i], presence(own, at[i : j + 1] - at[i])


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(y.sum(1), 1)[None, :])


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence of each
    weights: np.ndarray  # landmark by language

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and its score from 0 to 1."""
        value = kernel(x, self.landmarks) @ self.weights
        best = value.argmax(1)
        return best, np.clip((value[np.arange(len(x)), best] + 1) / 2, 0, 1)


def fit(x: np.ndarray, language: list[str]) -> Model:
    names = sorted(set(language))
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in language])
    by_name = [[k for k, v in enumerate(language) if v == n] for n in names]
    turn = [k for row in zip(*(rows + [-1] * (max(map(len, by_name)) - len(rows)) for rows in by_name), strict=True) for k in row if k >= 0]
    marks = x[turn[: max(LANDMARKS, len(names))]]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    phi = kernel(x, marks).astype(np.float64) @ root
    ridge = np.linalg.solve(phi.T @ phi + RIDGE * len(x) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, marks, (root @ ridge).astype(np.float32))


def trained(docs: DataFrame, mod: int = 4, rest: int = 2, sample: int = SAMPLE) -> Model | None:
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest))
    counts = own.groupBy("lang").count().toArrow()
    if not counts.num_rows:
        return None
    each = max(1, sample // counts.num_rows)
    rate = docs.sparkSession.createDataFrame([(n, min(1.0, (EXTRA * each + SPARE) / k)) for n, k in zip(counts["lang"].to_pylist(), counts["count"].to_pylist(), strict=True)], "lang string, rate double")
    h = F.xxhash64("doc_id")
    few = own.join(F.broadcast(rate), "lang").where(F.pmod(h, F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("doc_id", "lang").distinct()
    chosen = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))).where(F.col("at") <= each).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, x in rows_of(batch.column(1)):
                bits = np.packbits(x.astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    rows = texts.mapInArrow(run, "doc_id long, lang string, bits binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1).astype(np.float32)
    return fit(x, rows["lang"].to_pylist())


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        for batch in batches:
            for i, j, raw, at, x in rows_of(batch.column(1)):
                letters = np.diff(np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))[at]) > 0
                for k in np.flatnonzero(~letters):
                    letters[k] = any(map(str.isalpha, bytes(raw[at[k] : at[k + 1]]).decode()))
                if learnt is None:
                    names, score = ["und"] * (j - i), np.zeros(j - i)
                else:
                    best, score = learnt.predict(x)
                    names = [learnt.languages[b] if on else "und" for b, on in zip(best, letters, strict=True)]
                    score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")
