"""Streaming runs of jobs that queries() also runs in batch: drained by micro-batches, then read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillmark import queries as Q
from rillmark.functions import monoids as M
from rillmark.functions.scalars import millis, words
from rillmark.operators.index import Index
from rillmark.operators.joins import Meetings, sides
from rillmark.plans.jobs import Job, JobConfig
from rillmark.session import ship
from rillmark.streaming.storage import Folder, Topic
from rillmark.streaming.workdir import work_dir


def streamed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's file as a stream: the folder is read, and only that file of it, or the table's folder of files."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    at = Folder(spark, f"{sf_dir}/{table}.parquet")
    path, fs = at._at("")
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(at.path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def job(spark: SparkSession, sf_dir: str, *tables: str) -> Job:
    out = Job(JobConfig(spark, work_dir(spark, "job")))
    for t in tables:
        out.source(t, streamed(spark, sf_dir, t))
    return out


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STREAM_ORACLE_SQL: dict[str, str] = {}


def twin(sql: str):
    def add(f):
        STREAM_QUERIES[f.__name__], STREAM_ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@twin(Q.ORACLE_SQL["word_count"])
def word_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "documents")
    j.run("counts", j.aggregate("documents", words(F.col("text")), M.Count, F.col("doc_id")))
    j.start()
    return Q.keyed(j.table_at("counts").rows(), word="key", n="value")


@twin(Q.ORACLE_SQL["order_topology"])
def order_topology_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "orders")
    good = Q.order_topology_job(j, "orders")
    j.start()
    return Q.keyed(j.table_at(good).rows(), order_id="key", good="value")


@twin(Q.ORACLE_SQL["mean_by_user"])
def mean_by_user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "events")
    j.run("mean", j.aggregate("events", Q.one("user_id"), M.Mean, F.col("value")))
    j.start()
    table = j.table_at("mean")
    table.compact()
    return table.rows().select(F.col("key").alias("user_id"), F.round("value", 6).alias("mean"))


@twin("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def index_fetch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "events")
    j.run("kept", j.pipe("events", lambda s: s.map("event_id", "event_type", "value")).index_by("by_type", F.array("event_type")))
    j.start()
    return j.index("kept", "by_type").fetch(j.topic("kept").read(), "error").select("event_id", "event_type")


@twin("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def eventual_index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "events")
    j.run("kept", j.pipe("events", lambda s: s.map("event_id", "event_type")))
    j.run("by_type", j.eventual_index("kept", "by_type", F.array("event_type")))
    j.start()
    return Index(j.topic("by_type").read()).counts("", "~")


def _met_stream(spark: SparkSession, rows: DataFrame, project: list[Column], name: str, schema: str, many: bool = False) -> DataFrame:
    folder = work_dir(spark, name)
    at, state = Topic(spark, f"{folder}/data"), Meetings(f"{folder}/state", many)
    query = rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda df, n: at.append(state.met(df, n).select(*project), n)).trigger(availableNow=True).start()
    query.awaitTermination()
    return at.read(schema).select(*StructType.fromDDL(schema).names)


@twin("SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON a.event_id = b.event_id")
def consuming_join_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streamed(spark, sf_dir, "events").select("event_id", "user_id")
    both = sides(e, e, F.col("event_id"), F.col("event_id"), F.col("event_id"), F.col("event_id"))
    return _met_stream(spark, both, [F.col("l.event_id").alias("x"), F.col("r.event_id").alias("y")], "consuming", "x long, y long")


@twin("SELECT c_custkey, o_orderkey, make_timestamp(1600000000000000 + c_custkey * 1234567) AS at FROM customer JOIN orders ON c_custkey = o_custkey")
def consuming_one_to_many_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, whichever comes first; times keep their microseconds in the state."""
    c = streamed(spark, sf_dir, "customer").select("c_custkey", F.timestamp_micros(F.lit(1600000000000000) + F.col("c_custkey") * 1234567).alias("at"))
    o = streamed(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = sides(c, o, F.col("c_custkey"), F.col("o_custkey"), F.col("c_custkey"), F.col("o_orderkey"))
    return _met_stream(spark, both, [F.col("l.c_custkey"), F.col("r.o_orderkey"), F.col("l.at").cast("timestamp_ntz").alias("at")], "one-to-many", "c_custkey long, o_orderkey long, at timestamp_ntz", many=True)


def _by_commit(spark: SparkSession, sf_dir: str) -> Topic:
    """`events` in commits of one file, by event_id."""
    return Q.written(spark, sf_dir, 1)


@twin("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def existing_topic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = Job(JobConfig(spark, work_dir(spark, "job")))
    j.existing("events", Q.written(spark, sf_dir).path)
    j.run("n", j.aggregate("events", Q.one("user_id"), M.Count, F.lit(1)))
    j.start()
    return Q.keyed(j.table_at("n").rows(), user_id="key", n="value")


@twin("SELECT event_id, event_type FROM events")
def at_least_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that writes what it sees to a topic."""
    j = Job(JobConfig(spark, work_dir(spark, "job")))
    j.existing("events", Q.written(spark, sf_dir).path)
    seen = Topic(spark, f"{j.config.job_dir}/seen")
    j.run("sink", j.at_least_once("events", lambda df, n: seen.append(df.select("event_id", "event_type"), n)))
    j.start()
    return seen.read().select("event_id", "event_type").distinct()


_RUNNING = "SELECT ver, max(own) OVER (ORDER BY ver) AS wm FROM (SELECT {ver} AS ver, {own} AS own FROM events GROUP BY 1)"


@twin(_RUNNING.format(ver=Q._VER, own=f"arg_max({Q._MS}, event_id)"))
def custom_watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is a commit; its watermark is that of its last row."""
    j = Job(JobConfig(spark, work_dir(spark, "job"), files_per_batch=1))
    j.existing("events", _by_commit(spark, sf_dir).path)
    j.run("kept", j.pipe("events", lambda s: s.map("event_id", "ts")).watermark_by(millis(F.col("ts"))))
    j.start()
    return j.watermark_log("kept").table()


@twin(_RUNNING.format(ver=Q._VER, own=f"max({Q._MS})"))
def source_watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's watermark from its source's; the step keeps no time itself."""
    log = _by_commit(spark, sf_dir)
    j = Job(JobConfig(spark, work_dir(spark, "job")))
    j.source("events", log.stream(log.read().schema, 1), millis(F.col("ts")))
    j.run("kept", j.pipe("events", lambda s: s.map("event_id")))
    j.start()
    return j.watermark_log("kept").table()


@twin(f"SELECT min(wm) AS wm FROM (SELECT max({Q._MS}) AS wm FROM events UNION ALL SELECT CAST(max(epoch_ms(o_orderdate)) AS BIGINT) FROM orders)")
def default_watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a join of two steps, and of a table in another job that reads it with its watermark."""
    j = job(spark, sf_dir, "events", "orders")
    folder, paths = work_dir(spark, "sorted"), {}
    for name, ts, key in (("events", "ts", "event_id"), ("orders", "o_orderdate", "o_orderkey")):
        log = Topic(spark, f"{folder}/{name}")
        log.append(spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("ms", millis(F.col(ts).cast("timestamp"))), 0, order=("ms", key))
        paths[name] = j.existing(f"{name}_by_time", log.path)
        j.run(f"own_{name}", j.pipe(paths[name], lambda s: s).watermark_by(F.col("ms")))
    j.run("met", j.one_to_one_join("own_events", "own_orders", F.col("event_id"), F.col("o_orderkey"), [F.col("l.event_id")]))
    j.start()
    other = Job(JobConfig(spark, work_dir(spark, "job")))
    other.existing_watermarked("met", j.path("met"))
    other.run("n", other.aggregate("met", Q.one(F.lit(1)), M.Count, F.lit(1)))
    other.start()
    return spark.createDataFrame([(other.watermark("n"),)], "wm long")
