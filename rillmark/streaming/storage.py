"""Committed batches in a folder: topics, partial aggregates, indexes and watermarks.

A batch is written whole to a staging folder, its id is claimed by a file that only one writer can
create, and the winner's folder is renamed to `batch=<id>`.  A writer that finds an id claimed and
not renamed (its owner died in between) does the rename itself.  A batch id that is
there already is never written again, so a replay after a failure changes nothing, and of two writers
neither is lost.
Paths go through Hadoop's file systems, so a folder may be in any store they read.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def names(self) -> list[str]:
        at, fs = self._at("")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)

    def rename(self, old: str, new: str) -> bool:
        """Whether it was there and has the new name."""
        (a, fs), (b, _) = self._at(old), self._at(new)
        try:
            return fs.rename(a, b)
        except Py4JJavaError:
            if fs.exists(a):
                raise
            return False

    def claim(self, name: str, text: str) -> bool:
        """Makes a file with this text unless there is one; of several claimants one succeeds."""
        at, fs = self._at(name)
        if fs.getUri().getScheme() == "file":  # Hadoop's own create looks first and writes then
            path = at.toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            own = f"{path}.{uuid.uuid4().hex}"
            with open(own, "w") as out:
                out.write(text)
            try:
                os.link(own, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(own)
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def write_text(self, name: str, text: str) -> None:
        at, fs = self._at(name)
        out = fs.create(at, True)
        out.write(text.encode())
        out.close()

    def read_text(self, name: str) -> str:
        at, fs = self._at(name)
        source = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


class Batches(Folder):
    """Committed batches of one schema, and snapshots that stand for ranges of them."""

    def batch_ids(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.names() if n.startswith("batch="))

    def covered(self) -> int:
        """Batches up to this id are in the last whole snapshot; -1 for none."""
        return max((int(n.partition("=")[2]) for n in self.names() if n.startswith("snapshot=") and self.exists(f"{n}/_SUCCESS")), default=-1)

    def commit(self, df: DataFrame, batch_id: int, rows_per_file: int | None = None) -> bool:
        """Whether it was written now; a batch that is there, or in a snapshot, stays as it is."""
        if self.exists(f"batch={batch_id}") or batch_id <= self.covered():
            return False
        staged = f"_staging-{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
        writer.parquet(f"{self.path}/{staged}")
        if not self.claim(f"_claims/{batch_id}", staged):
            self.settle(batch_id)
            self.delete(staged)
            return False
        if not self.rename(staged, f"batch={batch_id}") and not self.exists(f"batch={batch_id}"):
            raise OSError(f"{self.path}: {staged} is gone")
        return True

    def settle(self, batch_id: int, timeout: float = 30.0) -> None:
        """Waits until a claimed batch is there; its rows were whole before it was claimed, so anyone may finish it."""
        end = time.monotonic() + timeout
        while not self.exists(f"batch={batch_id}") and batch_id > self.covered():
            staged = self.read_text(f"_claims/{batch_id}")
            if staged and self.rename(staged, f"batch={batch_id}"):
                return
            if time.monotonic() >= end:
                raise OSError(f"{self.path}: batch {batch_id} is claimed and not there")
            time.sleep(0.05)

    def next_id(self) -> int:
        """The id after all that are committed or claimed; claimed ones are settled first."""
        claimed = [int(n) for n in Folder(self.spark, f"{self.path}/_claims").names() if n.isdigit()]
        known = set(self.batch_ids())
        for b in sorted(set(claimed) - known):
            self.settle(b)
        return max([*known, *claimed, self.covered()], default=-1) + 1

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        """All rows, the snapshot's first; empty with `schema` if nothing is committed."""
        upto = self.covered()
        paths = [f"{self.path}/batch={b}" for b in self.batch_ids() if b > upto]
        if upto >= 0:
            paths.append(f"{self.path}/snapshot={upto}")
        if not paths:
            if schema is None:
                raise AnalysisException(f"{self.path} has no batch and no schema is given")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def compact(self, merged: DataFrame, upto: int) -> None:
        """Puts `merged`, made of all batches up to `upto`, in their place: it counts once it is whole, and only then do they go."""
        before = self.covered()
        if upto <= before:
            return
        merged.write.mode("overwrite").parquet(f"{self.path}/snapshot={upto}")
        for b in [b for b in self.batch_ids() if b <= upto]:
            self.delete(f"batch={b}")
            self.delete(f"_claims/{b}")
        if before >= 0:
            self.delete(f"snapshot={before}")


class Topic(Batches):
    """A persisted log of rows with coordinates (_pid, _ver, _idx); _idx rises within a partition of a commit."""

    def append(self, df: DataFrame, batch_id: int, partitions: int | None = None, pid: Column | None = None, order: tuple[str, ...] = (), rows_per_file: int | None = None) -> bool:
        """pid: the partition of each row, in which rows stand by `order`; with `order` alone partitions are ranges of it, so
        all rows stand by it; else rows stay in the tasks that made them, or are dealt to `partitions`."""
        at, own = F.monotonically_increasing_id(), df.columns
        place = F.shiftright(at, 33).cast("int")
        if pid is not None:
            df, place = df.withColumn("_pid", pid.cast("int")), F.col("_pid")
            df = (df.repartition(partitions, "_pid") if partitions else df.repartition("_pid")).sortWithinPartitions("_pid", *order)
        elif order:
            df = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
        elif partitions:
            df = df.repartition(partitions)
        out = df.select(*own, place.alias("_pid"), F.lit(batch_id).cast("bigint").alias("_ver"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_idx"))
        return self.commit(out, batch_id, rows_per_file)

    def write(self, df: DataFrame, partitions: int | None = None) -> int:
        """A one-off append as the next commit; its id.  Writers that race for an id try the next."""
        while True:
            batch_id = self.next_id()
            if self.append(df, batch_id, partitions):
                return batch_id

    def stream(self, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
        """Unread rows, as a stream; the reader's checkpoint is its query's."""
        reader = self.spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(f"{self.path}/batch=*")

    def count(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n"))

    def partition_counts(self) -> DataFrame:
        return self.read().groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))

    def get(self, pid: int, ver: int, idx: int) -> DataFrame:
        return self.read().where((F.col("_pid") == pid) & (F.col("_ver") == ver) & (F.col("_idx") == idx))

    def peek(self, n: int, pid: int = 0, after: tuple[int, int] = (-1, -1)) -> DataFrame:
        """The next n rows of a partition past (commit, place), without moving any reader."""
        ver, idx = after
        past = (F.col("_ver") > ver) | ((F.col("_ver") == ver) & (F.col("_idx") > idx))
        return self.read().where((F.col("_pid") == pid) & past).orderBy("_ver", "_idx").limit(n)

    def dump(self) -> list:
        """All rows, in memory: for tests and small topics."""
        return self.read().orderBy("_ver", "_pid", "_idx").collect()

    def wait(self, after: int = -1, timeout: float = 10.0, every: float = 0.2, pid: int | None = None) -> bool:
        """Whether a commit past `after` (with rows of partition `pid`, if that is given) came within `timeout` seconds."""
        end = time.monotonic() + timeout
        while True:
            last = max(self.batch_ids(), default=-1)
            if last > after and (pid is None or self.read().where((F.col("_pid") == pid) & (F.col("_ver") > after)).head(1)):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(every)


class Reader:
    """A named reader of a topic that advances its own checkpoint in each partition."""

    def __init__(self, topic: Topic, name: str) -> None:
        self.topic, self.at = topic, Folder(topic.spark, f"{topic.path}/_readers/{name}")

    def checkpoint(self, pid: int) -> tuple[int, int]:
        return tuple(json.loads(self.at.read_text(f"{pid}.json"))) if self.at.exists(f"{pid}.json") else (-1, -1)

    def checkpoints(self) -> dict[int, tuple[int, int]]:
        return {int(n.partition(".")[0]): self.checkpoint(int(n.partition(".")[0])) for n in self.at.names() if n.endswith(".json")}

    def read(self, n: int, pid: int | None = None) -> list:
        """The next n rows of a partition, or of one drawn at random."""
        if pid is None:
            pid = random.choice([r["_pid"] for r in self.topic.partition_counts().collect()])
        rows = self.topic.peek(n, pid, self.checkpoint(pid)).collect()
        if rows:
            self.at.write_text(f"{pid}.json", json.dumps([rows[-1]["_ver"], rows[-1]["_idx"]]))
        return rows


class WatermarkLog(Folder):
    """Event-time completeness by commit, in milliseconds; it never falls.  It informs only: nothing is dropped by it.

    An entry is a file's name, so one listing gives the whole log and no file is read.
    """

    def set(self, version: int, millis: int) -> None:
        before = [w for v, w in self._all() if v <= version]
        self.write_text(f"{version}={max([millis, *before])}", "")

    def _all(self) -> list[tuple[int, int]]:
        found: dict[int, int] = {}
        for v, _, w in (n.partition("=") for n in self.names() if "=" in n and n[0] != "."):
            found[int(v)] = max(int(w), found.get(int(v), int(w)))
        return sorted(found.items())

    def at(self, version: int | None = None) -> int | None:
        """The watermark as of a commit, or now; None where there is none yet."""
        own = [w for v, w in self._all() if version is None or v <= version]
        return max(own, default=None)

    def table(self) -> DataFrame:
        """(ver, wm); a commit that was set late is at least what came before it."""
        out, most = [], None
        for v, w in self._all():
            most = w if most is None else max(most, w)
            out.append((v, most))
        return self.spark.createDataFrame(out, "ver long, wm long")


def consumed(spark: SparkSession, checkpoint: str, source: int, batch_id: int, topic: Topic) -> int:
    """The last commit of a topic that a query had read in whole by one of its batches, as its checkpoint tells; -1 for none."""
    at = Folder(spark, checkpoint)
    lines = at.read_text(f"offsets/{batch_id}").split("\n")[2:]
    source = source if source < len(lines) else 0  # one reader for all that read the same stream
    upto = json.loads(lines[source])["logOffset"]
    log = Folder(spark, f"{checkpoint}/sources/{source}")
    logs = sorted((int(n.partition(".")[0]), n.endswith(".compact"), n) for n in log.names() if n.partition(".")[0].isdigit())
    logs = [x for x in logs if x[0] <= upto]
    begin = max((k for k, x in enumerate(logs) if x[1]), default=0)  # a compacted file holds all before it
    read: dict[int, set[str]] = {}
    for _, _, name in logs[begin:]:
        for line in log.read_text(name).split("\n")[1:]:
            path = json.loads(line)["path"]
            read.setdefault(int(path.rpartition("batch=")[2].partition("/")[0]), set()).add(path)
    for version in sorted(read, reverse=True):
        files = [n for n in Folder(spark, f"{topic.path}/batch={version}").names() if n.startswith("part-")]
        if len(read[version]) >= len(files):
            return version
    return -1


def default_watermark(inputs: list[int | None]) -> int | None:
    """The least of the inputs' watermarks; none until each has one."""
    return None if not inputs or any(w is None for w in inputs) else min(inputs)


def lag(root: int | None, leaf: int | None) -> int | None:
    """Milliseconds by which a leaf's watermark is behind its root's; none until both have one."""
    return None if root is None or leaf is None else root - leaf


def list_topics(spark: SparkSession, job_dir: str) -> list[str]:
    """Steps of a job's folder that have committed topics."""
    return [n for n in Folder(spark, job_dir).names() if Folder(spark, f"{job_dir}/{n}").exists("data")]
