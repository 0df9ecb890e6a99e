"""Jobs: named steps with one definition, interpreted as a batch plan, as streaming queries, or as a list.

A step is a function of its inputs' DataFrames, so the batch interpreter composes all
steps to one plan for Catalyst; the streaming interpreter gives each persisted step its
own query with a checkpoint, and its readers its committed topic.  A lazy step is part of the
plan or query of each step that reads it.

Watermarks: a step without one of its own has the least of its inputs', each as of the commits that the step's
query had read by that batch; none until each input has one.  An input is a topic of this job or another
(`existing_watermarked`), or a source with a watermark, of which the rows that the batch read count (joins and
lazy steps of such a source have no watermark: pipe it first).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rillmark.functions.monoids import Monoid
from rillmark.operators import joins
from rillmark.operators.index import COORDINATES, Index, entries
from rillmark.operators.streams import Grouped, Key, Stream, merge
from rillmark.streaming.storage import Topic, WatermarkLog, consumed, default_watermark
from rillmark.streaming.tables import AggrTable


@dataclass(frozen=True)
class JobConfig:
    spark: SparkSession
    job_dir: str
    files_per_batch: int | None = None
    partitions: int | None = None
    log_level: str = "WARN"


@dataclass(frozen=True)
class Step:
    """What a step makes of its inputs.  kind: source, lazy, topic, table or sink; the with_ methods return copies.

    stateless: each batch of the input can be made alone.  meet: of a consuming join, its sides, what it gives of a pair, and
    whether it is one-to-many.  topic, log: of a source that is a topic, its place and its watermarks'.
    """

    kind: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    monoid: Monoid | None = None
    effect: Callable[[DataFrame, int], None] | None = None
    indexes: dict[str, Column] = field(default_factory=dict)
    watermark: Column | None = None
    no_watermark: bool = False
    files_per_batch: int | None = None
    rows_per_batch: int | None = None
    partitions: int | None = None
    stateless: bool = False
    stateful: bool = False
    meet: tuple[Callable[..., DataFrame], list[Column], bool] | None = None
    topic: str | None = None
    log: str | None = None

    def index_by(self, name: str, keys: Column) -> Step:
        """An index that is committed with the rows; only topics have one."""
        if self.kind != "topic":
            raise TypeError(f"a {self.kind} can't be indexed")
        return replace(self, indexes={**self.indexes, name: keys})

    def watermark_by(self, millis: Column) -> Step:
        """The watermark is this of the last row of each batch: by the coordinates in the topic that it pipes, if it keeps them; else by its own."""
        return replace(self, watermark=millis)

    def without_watermark(self) -> Step:
        return replace(self, no_watermark=True)

    def with_batch_size(self, files: int | None = None, rows: int | None = None) -> Step:
        """The most files, or rows, of a batch; for rows, the topics that the step reads are written in files of no more."""
        return replace(self, files_per_batch=files, rows_per_batch=rows)

    def lazily(self) -> Step:
        """Not persisted: computed by each step that reads it."""
        if self.kind != "topic" or self.indexes or self.watermark is not None:
            raise TypeError("only a topic without indexes and watermark can be lazy")
        return replace(self, kind="lazy")

    def with_output_partitions(self, n: int) -> Step:
        return replace(self, partitions=n)


class Job:
    """Steps by name, in the order they were added; names are unique."""

    def __init__(self, config: JobConfig) -> None:
        self.config, self.steps = config, {}
        self.counts: dict[str, dict[str, int]] = {}
        self._starts: dict[str, Callable[[], Any]] = {}

    def run(self, name: str, step: Step) -> str:
        if name in self.steps:
            raise ValueError(f"step {name} exists")
        missing = [i for i in step.inputs if i not in self.steps]
        if missing:
            raise ValueError(f"step {name} reads {missing}, which no step makes")
        if any(self.steps[i].kind in ("table", "sink") for i in step.inputs):
            raise TypeError(f"step {name} reads a table or a sink")
        self.steps[name] = step
        return name

    # Builders.
    def source(self, name: str, df: DataFrame, watermark: Column | None = None) -> str:
        """A bounded or streaming DataFrame; `watermark`: epoch milliseconds, of which the greatest of each batch counts."""
        return self.run(name, Step("source", (), lambda: df, watermark=watermark))

    def existing(self, name: str, path: str) -> str:
        """A topic that another job writes."""
        topic = Topic(self.config.spark, path)
        return self.run(name, Step("source", (), lambda: topic.stream(topic.read().schema, self.config.files_per_batch) if self._streaming else topic.read(), topic=path))

    def existing_watermarked(self, name: str, path: str) -> str:
        """A step of another job, by its folder: its topic with its watermarks."""
        self.existing(name, f"{path}/data")
        self.steps[name] = replace(self.steps[name], log=f"{path}/watermark")
        return name

    def pipe(self, source: str, f: Callable[[Stream], Stream]) -> Step:
        return Step("topic", (source,), lambda df: f(Stream(df, source)).df, stateless=True)

    def consuming_join(self, left: str, right: str, left_key: Column, right_key: Column, left_order: Column, right_order: Column, project: list[Column], many: bool = False) -> Step:
        """A streaming join that forgets pairs that have met (one-to-one), or in which the last left row of a key wins (`many`)."""
        by = (left_key, right_key, left_order, right_order)
        return Step("topic", (left, right), lambda l, r: joins.consuming(l, r, *by, many).select(*project), stateful=True, meet=(lambda l, r: joins.sides(l, r, *by), project, many))  # noqa: E741

    def one_to_one_join(self, left: str, right: str, left_key: Column, right_key: Column, project: list[Column], optional: bool = False) -> Step:
        return Step("topic", (left, right), lambda l, r: joins.one_to_one(l, r, left_key, right_key, project, optional))  # noqa: E741

    def one_to_many_join(self, left: str, right: str, left_key: Column, right_key: Column, project: list[Column], optional: bool = False) -> Step:
        return Step("topic", (left, right), lambda l, r: joins.one_to_many(l, r, left_key, right_key, project, optional))  # noqa: E741

    def aggregate(self, source: str, keys: Column | Key, monoid: Monoid, value: Column) -> Step:
        return Step("table", (source,), lambda df: Grouped(Stream(df, source), keys).partials(monoid, value), monoid)

    def at_least_once(self, source: str, effect: Callable[[DataFrame, int], None]) -> Step:
        """effect(rows, batch id) sees every row at least once."""
        return Step("sink", (source,), lambda df: df, effect=effect)

    def eventual_index(self, source: str, name: str, keys: Column) -> Step:
        """An index of a topic that is built by a step of its own."""
        if self.steps[source].kind != "topic":
            raise TypeError(f"a {self.steps[source].kind} can't be indexed")
        return Step("topic", (source,), lambda df: entries(df, keys).withColumnsRenamed({c: f"{c}_of" for c in COORDINATES}), stateless=True)

    # Interpreters.
    _streaming = False

    def list_topics(self) -> list[str]:
        return [n for n, s in self.steps.items() if s.kind == "topic"]

    def path(self, name: str) -> str:
        return f"{self.config.job_dir}/{name}"

    def topic(self, name: str) -> Topic:
        return Topic(self.config.spark, f"{self.path(name)}/data")

    def table(self, name: str) -> AggrTable:
        step = self.steps[name]
        return AggrTable(self.config.spark, self.path(name), step.monoid, self._schema(name))

    def index(self, name: str, index: str) -> Index:
        return Index(Topic(self.config.spark, f"{self.path(name)}/index/{index}").read())

    def watermark_log(self, name: str) -> WatermarkLog:
        return WatermarkLog(self.config.spark, self.steps[name].log or f"{self.path(name)}/watermark")

    def watermark(self, name: str, version: int | None = None) -> int | None:
        """Of a step now, or as of a commit; of a source with a watermark, the greatest that a reader of it has seen."""
        if self.steps[name].kind == "source" and self.steps[name].watermark is not None:
            seen = [self._source_log(name, n).at(version) for n, s in self.steps.items() if name in s.inputs]
            return max((w for w in seen if w is not None), default=None)
        return self.watermark_log(name).at(version)

    def _source_log(self, name: str, reader: str) -> WatermarkLog:
        return WatermarkLog(self.config.spark, f"{self.path(name)}/watermark-{reader}")

    def _schema(self, name: str):
        return self.batch(name, partial=True).schema

    def batch(self, name: str, partial: bool = False) -> DataFrame:
        """The whole of a step over bounded sources, as one plan: a table's (key, value), or its partial results."""
        made: dict[str, DataFrame] = {}
        for n in self._needed(name):
            made[n] = self.steps[n].make(*(made[i] for i in self.steps[n].inputs))
        step = self.steps[name]
        return merge(made[name], step.monoid) if step.kind == "table" and not partial else made[name]

    def _needed(self, name: str) -> list[str]:
        want = {name}
        for n in reversed(list(self.steps)):
            if n in want:
                want.update(self.steps[n].inputs)
        return [n for n in self.steps if n in want]

    def start(self, available_now: bool = True, every: str = "1 second", restarts: int = 0, throttle: float = 1.0) -> list:
        """Starts the streaming queries of all steps; with `available_now`, each step drains its input before the next starts.

        A drained query that fails starts again from its checkpoint after `throttle` seconds, `restarts` times at most; of
        queries that run on, `supervise` takes care.
        """
        self._streaming, queries, schemas = True, [], {}
        try:
            for name, step in self.steps.items():
                if step.kind in ("source", "lazy"):
                    continue
                inputs = [self._input(i, step, schemas) for i in step.inputs]
                out = step.make(*inputs) if step.kind != "table" else inputs[0]
                if step.kind == "topic":
                    schemas[name] = out.schema
                df = inputs[0] if step.stateless else step.meet[0](*inputs) if step.meet else out
                writer = df.writeStream.queryName(name).option("checkpointLocation", f"{self.path(name)}/checkpoint").foreachBatch(self._commit(name, step))
                writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
                self._starts[name] = self._starter(writer, any(self.steps[i].stateful for i in self._lazy(name)))
                queries.append(self._drained(name, restarts, throttle) if available_now else self._starts[name]())
            return queries
        finally:
            self._streaming = False

    def _starter(self, writer, stateful: bool) -> Callable[[], Any]:
        def start():
            if not stateful:
                return writer.start()
            with joins.state_store(self.config.spark):
                return writer.start()

        return start

    def _drained(self, name: str, restarts: int, throttle: float):
        while True:
            query = self._starts[name]()
            try:
                query.awaitTermination()
                return query
            except StreamingQueryException:
                self._count(name, failures=1)
                if restarts <= 0:
                    raise
                restarts -= 1
                time.sleep(throttle)

    def supervise(self, queries: list, seconds: float, restarts: int = 3, throttle: float = 1.0) -> list:
        """Watches running queries for a while: one that failed starts again after `throttle` seconds, `restarts` times at most; then its error is raised."""
        end, left = time.monotonic() + seconds, dict.fromkeys((q.name for q in queries), restarts)
        while time.monotonic() < end:
            for k, q in enumerate(queries):
                if not q.isActive and (error := q.exception()) is not None:
                    self._count(q.name, failures=1)
                    if left[q.name] <= 0:
                        raise error
                    left[q.name] -= 1
                    time.sleep(throttle)
                    queries[k] = self._starts[q.name]()
            time.sleep(min(0.2, max(0.0, end - time.monotonic())))
        return queries

    def _lazy(self, name: str) -> list[str]:
        """The lazy steps that a step's query takes in."""
        own = [i for i in self.steps[name].inputs if self.steps[i].kind == "lazy"]
        return own + [x for i in own for x in self._lazy(i)]

    def _roots(self, name: str) -> list[tuple[str, bool]]:
        """The persisted inputs of a step in the order of its query's sources, and whether it reads them directly."""
        found = []
        for i in self.steps[name].inputs:
            found += [(r, False) for r, _ in self._roots(i)] if self.steps[i].kind == "lazy" else [(i, True)]
        return found

    def _input(self, name: str, reader: Step, schemas: dict) -> DataFrame:
        own = self.steps[name]
        if own.kind == "source":
            return own.make()
        if own.kind == "lazy":
            return own.make(*(self._input(i, reader, schemas) for i in own.inputs))
        schema = schemas[name]
        schema = StructType([*(f for f in schema if f.name not in COORDINATES), StructField("_pid", IntegerType()), StructField("_ver", LongType()), StructField("_idx", LongType())])
        at = Topic(self.config.spark, f"{self.path(name)}/data")
        if not at.exists():
            at.commit(self.config.spark.createDataFrame([], schema), -1)
        return at.stream(schema, 1 if reader.rows_per_batch else reader.files_per_batch or self.config.files_per_batch)

    def _rows_per_file(self, name: str) -> int | None:
        """The least batch, in rows, of the steps that read a topic."""
        return min((s.rows_per_batch for n, s in self.steps.items() if s.rows_per_batch and name in (r for r, _ in self._roots(n))), default=None)

    def _count(self, name: str, **more: int) -> None:
        own = self.counts.setdefault(name, {"batches": 0, "rows": 0, "ms": 0, "failures": 0})
        for k, n in more.items():
            own[k] += n

    def _commit(self, name: str, step: Step) -> Callable[[DataFrame, int], None]:
        def each(df: DataFrame, batch_id: int) -> None:
            begin, rows = time.monotonic(), 0
            log = WatermarkLog(self.config.spark, f"{self.path(name)}/watermark")
            made = step.make(df) if step.stateless or step.kind == "table" else df
            if step.meet and step.kind == "topic":
                made = joins.Meetings(f"{self.path(name)}/state", step.meet[2]).met(df, batch_id).select(*step.meet[1])
            last = None
            if step.kind == "table":
                self.table_at(name).add(made, batch_id)
            elif step.kind == "sink":
                step.effect(made, batch_id)
            else:
                own = [c for c in made.columns if c not in COORDINATES]
                topic = self.topic(name)
                topic.append(made.select(*own), batch_id, step.partitions or self.config.partitions, rows_per_file=self._rows_per_file(name))
                written = self.config.spark.read.parquet(f"{topic.path}/batch={batch_id}")
                rows = written.count()
                for index, keys in step.indexes.items():
                    Topic(self.config.spark, f"{self.path(name)}/index/{index}").commit(entries(written, keys), batch_id)
                if step.watermark is not None:
                    came = made if step.stateless and set(COORDINATES) <= set(made.columns) else written  # tasks read files in no order
                    last = came.agg(F.max_by(step.watermark, F.struct("_ver", "_pid", "_idx"))).first()[0]
            if not step.no_watermark and step.watermark is None:
                last = default_watermark([self._seen(root, direct and len(step.inputs) == 1, k, name, df, batch_id) for k, (root, direct) in enumerate(self._roots(name))])
            if last is not None:
                log.set(batch_id, int(last))
            self._count(name, batches=1, rows=rows, ms=int(1000 * (time.monotonic() - begin)))

        return each

    def _seen(self, root: str, alone: bool, k: int, name: str, df: DataFrame, batch_id: int) -> int | None:
        """An input's watermark as of what a query had read by a batch."""
        own, spark = self.steps[root], self.config.spark
        if own.kind == "source" and own.watermark is not None:
            step = self.steps[name]
            if not alone or not (step.stateless or step.kind in ("table", "sink")):
                return None
            log, most = self._source_log(root, name), df.agg(F.max(own.watermark)).first()[0]
            if most is not None:
                log.set(batch_id, int(most))
            return log.at(batch_id)
        if own.kind == "source" and own.log is None:
            return None
        topic = Topic(spark, own.topic or f"{self.path(root)}/data")
        return self.watermark_log(root).at(consumed(spark, f"{self.path(name)}/checkpoint", k, batch_id, topic))

    def table_at(self, name: str) -> AggrTable:
        return AggrTable(self.config.spark, self.path(name), self.steps[name].monoid)

    def progress(self, queries: list) -> dict[str, Any]:
        """Rows read and batch milliseconds of each query's last batch."""
        return {q.name: {"rows": p["numInputRows"], "ms": p["batchDuration"], "sources": [s["endOffset"] for s in p["sources"]]} for q in queries if (p := q.lastProgress)}

    def metrics(self) -> dict[str, dict[str, int]]:
        """By step, since this job was made: batches committed, rows written to its topic, milliseconds of commits, failures."""
        return {n: dict(c) for n, c in self.counts.items()}
