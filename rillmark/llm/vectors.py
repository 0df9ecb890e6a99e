"""Embedding near-duplicates: an epsilon grid order join.

Unit vectors with cosine >= t lie within sqrt(2 - 2 t) of each other.  They are
projected on leading principal axes, put in grid cells of that width and sorted by cell;
the sequence is cut into intervals of at most INTERVAL rows, and where the first axis's cell changes, with their bounding boxes.
Pairs of intervals that share or neighbour a cell of the first two axes and are not provably distant are joined, each by a task of bounded
size, by halving recursively and skipping distant halves; leaves multiply
matrices in double precision.  Vectors travel in the precision of their column, which is exact.

Where few vectors are provably distant, as in one dense label, work is the square of the number of intervals: the
method has no bound below that.

Equal vectors of one label collapse to one row with a count first.  A task returns, for
each vector that links, how many it links with and one edge of a spanning forest, so
pairs are never written out.

Defined results: a vector links with nothing if it is null, zero, or has null or
non-finite components, or if its label or id is null (component_id is its own id then);
vectors of different lengths never link; rows that repeat an id with the same vector
count once; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rillmark.llm.cluster import Scratch, components

THRESHOLD = 0.98
AXES, CELLS = 8, 4
INTERVAL, LEAF = 2048, 128
#: Leading components that the principal axes are made of, and sums that reach the driver.
MOMENTS, SUMS = 256, 32
_SLACK = 1e-9


def _facts(kind: str):
    """Adds each vector's bytes (of this kind), a key of them and its length; nulls where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys, sizes = [], [], []
            for v in batch.column(1):
                x = v.values if v.is_valid else None
                a = None if x is None or x.null_count or not len(x) else x.cast(pa.float64()).to_numpy()
                ok = a is not None and np.isfinite(a).all() and a.any() and np.isfinite(a @ a) and a @ a > 0
                raw.append(a.astype(kind).tobytes() if ok else None)
                keys.append(md5(raw[-1], usedforsecurity=False).digest() if ok else None)
                sizes.append(len(a) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "label", "raw", "key", "size"])

    return run


def _unit_rows(flat: bytes, rows: int, size: int) -> np.ndarray:
    """Rows of length 1, in double precision, of vectors of `size` numbers of four or eight bytes."""
    x = np.frombuffer(flat, f"<f{len(flat) // (rows * size)}").reshape(rows, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def unit(raw: list[bytes], size: int) -> np.ndarray:
    return _unit_rows(b"".join(raw), len(raw), size)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        size = batch.column(1).to_numpy()
        for d in np.unique(size):
            x = unit(batch.column(0).filter(pa.array(size == d)).to_pylist(), int(d))[:, :MOMENTS]
            own = sums.setdefault(int(d), [0, 0.0, 0.0])
            own[0] += len(x)
            own[1] += x.sum(0)
            own[2] += x.T @ x
    rows = [(TaskContext.get().partitionId() % SUMS, d, n, s.tobytes(), c.tobytes()) for d, (n, s, c) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "size", "n", "s", "c"])


def _summed(t: pa.Table) -> pa.Table:
    s = sum(np.frombuffer(x) for x in t["s"].to_pylist())
    c = sum(np.frombuffer(x) for x in t["c"].to_pylist())
    return pa.table({"part": t["part"].slice(0, 1), "size": t["size"].slice(0, 1), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "s": pa.array([s.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary())})


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, orthonormal axes by falling variance: at most SUMS sums of squares reach the driver."""
    kinds = "part int, size int, n long, s binary, c binary"
    sums = reps.select("raw", "size").mapInArrow(_moments, kinds).groupBy("part", "size").applyInArrow(_summed, kinds).collect()
    out = {}
    for d in {r["size"] for r in sums}:
        own = [r for r in sums if r["size"] == d]
        n, s = sum(r["n"] for r in own), sum(np.frombuffer(r["s"]) for r in own)
        c = sum(np.frombuffer(r["c"]) for r in own).reshape(len(s), -1)
        _, axes = np.linalg.eigh(c / n - np.outer(s / n, s / n))
        out[d] = axes[:, ::-1][:, :AXES]
    return out


def _far(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float(gap @ gap) > eps * eps


def _labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the two sides of a bipartite graph; a label is a number of the left side."""
    a, b = np.arange(len(mask)), np.full(mask.shape[1], len(mask))
    while True:
        new_b = np.minimum(b, np.where(mask, a[:, None], len(mask)).min(0))
        new_a = np.minimum(a, np.where(mask, new_b[None, :], len(mask)).min(1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


class Join:
    """The recursive join of two intervals, or of one with itself."""

    def __init__(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cx: np.ndarray, cy: np.ndarray, same: bool, threshold: float) -> None:
        self.x, self.y, self.px, self.py, self.cx, self.cy, self.same, self.threshold = x, y, px, py, cx, cy, same, threshold
        self.eps = np.sqrt(2 - 2 * threshold) + _SLACK
        self.nx, self.ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.parent = np.arange(len(x) + (0 if same else len(y)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def run(self, a: int, b: int, c: int, d: int) -> None:
        """Rows a:b of the left with c:d of the right."""
        if self.same and a > c:
            return
        if _far(self.px[a:b].min(0), self.px[a:b].max(0), self.py[c:d].min(0), self.py[c:d].max(0), self.eps):
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.leaf(a, b, c, d)
        elif b - a >= d - c and not (self.same and a == c):
            m = self.half(a, b)
            self.run(a, m, c, d)
            self.run(m, b, c, d)
        elif self.same and a == c:
            m = self.half(a, b)
            self.run(a, m, a, m)
            self.run(a, m, m, b)
            self.run(m, b, m, b)
        else:
            m = self.half(c, d)
            self.run(a, b, c, m)
            self.run(a, b, m, d)

    @staticmethod
    def half(a: int, b: int) -> int:
        """A multiple of LEAF from a, so halves of either side meet the same cuts."""
        return a + max(LEAF, (b - a) // 2 // LEAF * LEAF)

    def leaf(self, a: int, b: int, c: int, d: int) -> None:
        mask = self.x[a:b] @ self.y[c:d].T >= self.threshold
        own = self.same and a == c
        if own:
            np.fill_diagonal(mask, False)
        if not mask.any():
            return
        self.nx[a:b] += mask @ self.cy[c:d]
        if not own:
            self.ny[c:d] += mask.T @ self.cx[a:b]
        left, right = _labels(mask)
        shift = 0 if self.same else len(self.x)
        for i in np.flatnonzero(left != np.arange(b - a)):
            self.union(a + int(i), a + int(left[i]))
        for j in np.flatnonzero(right < b - a):
            self.union(shift + c + int(j), a + int(right[j]))

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of `vectors`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col), F.col(label_col).cast("string").alias("label"))
    exact = "<f4" if own.schema[vector_col].dataType == ArrayType(FloatType(), own.schema[vector_col].dataType.containsNull) else "<f8"
    rows = scratch.keep(own.mapInArrow(_facts(exact), "vec_id long, label string, raw binary, key binary, size int"))
    able = rows.where("vec_id is not null and label is not null and key is not null")
    once = able.groupBy("vec_id", "label", "key").agg(F.first("raw").alias("raw"), F.first("size").alias("size"))
    reps = scratch.keep(once.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"), F.first("size").alias("size")))
    axes = spark.sparkContext.broadcast(principal_axes(reps))
    eps = float(np.sqrt(2 - 2 * threshold) + _SLACK)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(4).to_numpy()
            grid = np.zeros((len(size), CELLS), np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                p = unit(batch.column(3).take(pa.array(at)).to_pylist(), int(d))[:, :MOMENTS] @ axes.value[int(d)]
                grid[at, : min(CELLS, p.shape[1])] = np.floor(p[:, :CELLS] / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, grid.T)], names=[*batch.schema.names, *(f"c{k}" for k in range(CELLS))])

    kinds = "label string, rep long, copies long, raw binary, size int"
    order = ["label", "size", *(f"c{k}" for k in range(CELLS)), "rep"]
    placed = reps.select("label", "rep", "copies", "raw", "size").mapInArrow(cells, f"{kinds}, {', '.join(f'c{k} int' for k in range(CELLS))}")
    sequence = scratch.keep(placed).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            label, size, cell = batch.column(0).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            edge = [0, *(k for k in range(1, len(label)) if label[k] != label[k - 1] or size[k] != size[k - 1] or cell[k] != cell[k - 1]), len(label)]
            for a, b in zip(edge, edge[1:], strict=False):
                for i in range(a, b, INTERVAL):
                    j = min(b, i + INTERVAL)
                    raw = batch.column(3).slice(i, j - i).to_pylist()
                    p = unit(raw, int(size[a]))[:, :MOMENTS] @ axes.value[int(size[a])]
                    p = np.pad(p, ((0, 0), (0, AXES - p.shape[1])))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "interval": pa.array([base + n], pa.int64()),
                            "label": pa.array([label[a]], pa.string()),
                            "size": pa.array([size[a]], pa.int32()),
                            "lo": pa.array([p.min(0)], pa.list_(pa.float64())),
                            "hi": pa.array([p.max(0)], pa.list_(pa.float64())),
                            "ids": pa.array([batch.column(1).slice(i, j - i).to_numpy().tobytes()], pa.binary()),
                            "counts": pa.array([batch.column(2).slice(i, j - i).to_numpy().tobytes()], pa.binary()),
                            "raw": pa.array([b"".join(raw)], pa.binary()),
                        }
                    )
                    n += 1

    intervals = scratch.keep(sequence.select("label", "rep", "copies", "raw", "size", "c0").mapInArrow(cut, "interval long, label string, size int, lo array<double>, hi array<double>, ids binary, counts binary, raw binary"))
    meta = intervals.select("interval", "label", "size", "lo", "hi")

    def cells_of(t: DataFrame, wider: int) -> DataFrame:
        """A row for each cell of the first two axes that an interval may meet."""
        for k in range(2):
            ends = [F.floor(F.get(F.col(c), F.lit(k)) / eps).cast("int") for c in t.columns[3:5]]
            t = t.withColumn(f"s{k}", F.explode(F.sequence(ends[0] - wider, ends[1] + wider)))
        return t

    left = cells_of(meta.toDF("i", "label", "size", "lo1", "hi1"), 0)
    right = cells_of(meta.toDF("j", "label", "size", "lo2", "hi2"), 1)
    gaps = F.zip_with(F.zip_with("lo1", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi1", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(F.transform(gaps, lambda g: g * g), F.lit(0.0), lambda s, g: s + g) <= eps * eps
    pairs = left.join(right, ["label", "size", "s0", "s1"]).where((F.col("i") <= F.col("j")) & near).select("i", "j").distinct()
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("interval"))
    loaded = sides.join(intervals.select("interval", "size", "ids", "counts", "raw").hint("merge"), "interval")

    def join(t: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), r["raw"], r["size"]) for r in sorted(t.to_pylist(), key=lambda r: r["interval"])]
        a, b = parts[0], parts[-1]
        x, y = (_unit_rows(p[2], len(p[0]), p[3]) for p in (a, b))
        px, py = (v[:, :MOMENTS] @ axes.value[v.shape[1]] for v in (x, y))
        same = len(parts) == 1
        j = Join(x, y, px, py, a[1], b[1], same, threshold)
        j.run(0, len(x), 0, len(y))
        ids, links = (a[0], j.nx + (j.ny if same else 0)) if same else (np.concatenate((a[0], b[0])), np.concatenate((j.nx, j.ny)))
        at = np.flatnonzero(links)
        roots = np.array([j.root(int(k)) for k in at], np.int64)
        return pa.table({"rep": pa.array(ids[at]), "links": pa.array(links[at]), "root": pa.array(ids[roots] if len(at) else np.zeros(0, np.int64))})

    met = scratch.keep(loaded.groupBy("i", "j").applyInArrow(join, "rep long, links long, root long"))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(scratch, met.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).toDF("rep", "component")
    facts = reps.select("label", "key", "rep", "copies").join(links, "rep", "left").join(named, "rep", "left")
    facts = facts.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "label", "key").join(facts, ["label", "key"], "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return scratch.only(out.withColumn("kept", F.col("vec_id") == F.col("component_id")))
