"""Scratch tables in the shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ from all that are taken."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode, where it is unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rillmark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of one key that one task may always get in a join.
HOT = 500
#: Edges of which one task makes the components, and rows of a few numbers that are broadcast, in some megabytes; small stages of many tasks would take longer.
FEW = 200_000


class Scratch:
    """Tables written once and read again, which cuts lineage: a lost executor costs a re-read, not a re-run.

    `keep` returns the table; `drop` removes those that no result still reads; what results still
    read goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        at, fs = self._at(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame) -> DataFrame:
        """Writes a result and removes all tables that led to it."""
        out = self.keep(df)
        for path in self.paths[:-1]:
            self._delete(path)
        return out

    def drop_paths(self, paths: list[str]) -> None:
        for path in paths:
            self._delete(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that keep() returned."""
        for t in tables:
            for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
                self._delete(path)


def hot_join(left: DataFrame, keyed: DataFrame, key: str, total: int, least: int = HOT, by: tuple[str, ...] = ()) -> DataFrame:
    """`left` (of `total` rows) joined by `key` with `keyed`, which has in `rows` how many rows of `left` have it.

    Rows of a key with more than a quarter of a task's share (and more than `least`) are dealt to several tasks, and its
    row of `keyed` is copied to each.  There are at most four such keys for each task of a shuffle, so
    their table is broadcast.  `keyed` is read twice: keep it.  by: columns that tell rows of a key apart, all if none is given.
    """
    most = max(least, total // (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total <= most:
        return left.join(keyed.drop("rows").hint("merge"), key)
    share, salt = free_names([*left.columns, *keyed.columns], "share", "salt")
    parts = F.ceil(F.col("rows") / most).cast("int")
    hot = keyed.where(F.col("rows") > most).select(key, parts.alias(share)).distinct()
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(salt, F.pmod(F.xxhash64(*(by or left.columns)), F.coalesce(share, F.lit(1))).cast("int")).drop(share)
    copies = keyed.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows")
    return dealt.join(copies.hint("merge"), [key, salt]).drop(salt)


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of one task: each node takes the least label next to it, and the label of its label, until none changes."""
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(nodes))
        while True:
            before, least = label.copy(), np.minimum(label[a], label[b])
            # The roots of both ends get the least, so whole trees move at once.
            for end in (a, b):
                np.minimum.at(label, before[end], least)
                np.minimum.at(label, end, least)
            while (up := label[label] != label).any():
                label[up] = label[label[up]]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (src, dst; 64-bit ids): component is the least node reachable.

    Alternates large-star and small-star contraction with minimums, which combine before they are shuffled, and
    joins that deal a node's neighbours to several tasks if it has many (`hot_join`); ends when the
    edges no longer change.  FEW edges are contracted by one task.  Self-loops and repeated edges are harmless.
    """
    e = scratch.keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())

    def seen(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(t: DataFrame, total: int) -> DataFrame:
        """(a, b) with m, the least b of each a; a table that may have hot nodes is written first."""
        found = t.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
        return hot_join(t, scratch.keep(found) if total > HOT else found, "a", total)

    mark = seen(e)
    if not mark[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if mark[0] <= FEW:
        return scratch.keep(e.coalesce(1).mapInArrow(_least_reachable, "node long, component long"))
    for _ in range(most_rounds):
        begin = len(scratch.paths)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large) if mark[0] > HOT else large
        joined = with_least(large, mark[0])
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = scratch.keep(small.where("a <> b").distinct())
        now = seen(after)
        scratch.drop(e)
        scratch.drop_paths(scratch.paths[begin:-1])
        e = after
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components: edges still change after {most_rounds} rounds")


def held_out(column: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest, F.lit(False))
