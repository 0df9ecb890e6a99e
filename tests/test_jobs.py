import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions import monoids as M
from rillmark.operators.streams import Key, Stream
from rillmark.plans.jobs import Job, JobConfig
from rillmark.sources.pull import custom_stream, custom_stream_parts
from rillmark.sources.push import EXISTED, FAILED, QUEUE_FULL, SUCCESS, BatchWriterConfig, is_failed, push_stream
from rillmark.streaming.storage import Topic
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = "id long, k long, v long, ts long"


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(i, rng.randrange(7), rng.randrange(-50, 50), rng.randrange(10**6)) for i in range(n)]


def build(job, source):
    job.run("big", job.pipe(source, lambda s: s.map_maybe(id=F.col("id"), k=F.col("k"), v=F.when(F.col("v") > -20, F.col("v")), ts=F.col("ts"))).index_by("by_k", F.array("k")).watermark_by(F.col("ts")))
    job.run("met", job.one_to_one_join("big", "big", F.col("id"), F.col("id"), [F.col("l.k"), F.col("r.v")]))
    job.run("total", job.aggregate("met", F.array("k", F.lit(-1).cast("long")), M.Tuple(s=M.Sum(), n=M.Count), F.struct(F.col("v").alias("s"), F.lit(1).alias("n"))))


@pytest.mark.parametrize("seed", [1, 2])
def test_streaming_equals_batch_for_any_split(spark, tmp_path, seed):
    rows, rng = rows_of(seed), random.Random(seed)
    source = Topic(spark, f"{tmp_path}/source")
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        source.write(spark.createDataFrame(rows[a:b], SCHEMA))
    job = Job(JobConfig(spark, f"{tmp_path}/job", files_per_batch=1))
    job.existing("source", source.path)
    build(job, "source")
    want = sorted(map(repr, job.batch("total").collect()))
    job.start()
    table = job.table_at("total")
    assert sorted(map(repr, table.rows().collect())) == want
    job.start()  # nothing new: a second run reads nothing twice
    assert sorted(map(repr, table.rows().collect())) == want
    # A late row counts like any other.
    source.write(spark.createDataFrame([(999, 3, 5, 0)], SCHEMA))
    queries = job.start()
    assert sorted(map(repr, table.rows().collect())) == sorted(map(repr, job.batch("total").collect())) != want
    kept = job.index("big", "by_k").fetch(job.topic("big").read(), 3)
    assert {r["id"] for r in kept.collect()} == {r[0] for r in rows if r[1] == 3 and r[2] > -20} | {999}
    assert job.watermark("big") is not None and job.progress(queries)


def test_names_inputs_and_kinds_are_checked(spark, tmp_path):
    job = Job(JobConfig(spark, str(tmp_path)))
    df = spark.createDataFrame(rows_of(0, 3), SCHEMA)
    job.source("s", df)
    build(job, "s")
    with pytest.raises(ValueError, match="exists"):
        job.source("s", df)
    with pytest.raises(ValueError, match="no step makes"):
        job.run("x", job.pipe("nothing", lambda s: s))
    with pytest.raises(TypeError):
        job.run("y", job.pipe("total", lambda s: s))
    with pytest.raises(TypeError):
        job.aggregate("s", F.array("k"), M.Count, F.lit(1)).index_by("i", F.array("k"))
    assert job.list_topics() == ["big", "met"]
    step = job.pipe("s", lambda s: s)
    assert step.with_batch_size(5).files_per_batch == 5 and step.with_output_partitions(2).partitions == 2 and step.files_per_batch is None


def test_sink_sees_every_row(spark, tmp_path):
    source = Topic(spark, f"{tmp_path}/source")
    source.write(spark.createDataFrame(rows_of(0, 9), SCHEMA))
    job, seen = Job(JobConfig(spark, f"{tmp_path}/job")), []
    job.existing("s", source.path)
    job.run("sink", job.at_least_once("s", lambda df, n: seen.extend(r["id"] for r in df.collect())))
    job.start()
    assert sorted(seen) == list(range(9))


def test_benign_io_drops_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    out = Stream(df).benign_io("y", F.udf(lambda x: x if x and x > 1 else None, "long"), F.col("x")).df
    assert [tuple(r) for r in out.collect()] == [(2, 2)]


def test_custom_stream(spark, tmp_path):
    df = custom_stream(spark, "numbers", StructType([StructField("x", LongType())]), lambda at: [(k,) for k in range(at, min(at + 4, 10))])
    out = Topic(spark, f"{tmp_path}/out")
    query = df.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda d, n: out.append(d, n)).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["x"] for r in out.read().collect()) == list(range(10))


def test_push_writer(spark, tmp_path):
    topic, writer = push_stream(spark, f"{tmp_path}/p", StructType([StructField("x", LongType())]), BatchWriterConfig(max_items=3, max_delay_s=5), watermark=lambda item: item[0] * 10)
    a, b, c = (writer.write((k,), key) for k, key in ((1, b"k"), (2, b"k"), (3, None)))
    assert [f.result(60) for f in (a, b, c)] == [SUCCESS, EXISTED, SUCCESS]
    later = writer.write((4,), b"k")
    writer.close()
    assert later.result(60) == EXISTED and sorted(r["x"] for r in topic.read().collect()) == [1, 3]
    assert writer.log.at() == 10
    assert writer.write((5,)).result(1) == FAILED and is_failed(QUEUE_FULL) and not is_failed(EXISTED)


def test_push_keys_outlive_writers_and_hold_between_them(spark, tmp_path):
    schema, config = StructType([StructField("x", LongType())]), BatchWriterConfig(max_items=4, max_delay_s=0.1)
    path, results = f"{tmp_path}/p", []
    topic, first = push_stream(spark, path, schema, config)
    results += [first.write((k,), b"%d" % k) for k in range(6)]
    first.close()
    _, again = push_stream(spark, path, schema, config)  # after a restart
    assert [again.write((100 + k,), b"%d" % k).result(60) for k in (0, 5)] == [EXISTED, EXISTED]
    _, other = push_stream(spark, path, schema, config)
    rng = random.Random(1)
    for k in range(60):  # two writers, the same keys
        results.append(rng.choice((again, other)).write((k,), b"%d" % rng.randrange(30)))
    again.close()
    other.close()
    done = [f.result(60) for f in results]
    keys = [bytes(r["_key"]) for r in topic.read().collect()]
    assert len(keys) == len(set(keys)) == done.count(SUCCESS) and set(done) == {SUCCESS, EXISTED}


def test_watermarks_are_as_of_what_a_step_has_read(spark, tmp_path):
    """A table that reads a topic in files of one batch each: its watermark follows its own batches, not the topic's."""
    source = Topic(spark, f"{tmp_path}/source")
    for k, ts in enumerate((30, 10, 50)):
        source.append(spark.createDataFrame([(k, 1, 1, ts)], SCHEMA), k, 1)
    job = Job(JobConfig(spark, f"{tmp_path}/job", files_per_batch=1))
    job.source("s", source.stream(source.read().schema, 1), F.col("ts"))
    job.run("kept", job.pipe("s", lambda s: s.map("id", "k")))
    job.run("n", job.aggregate("kept", Key(F.col("k")), M.Count, F.lit(1)))
    job.run("none", job.pipe("s", lambda s: s).without_watermark())
    job.start()
    assert [job.watermark("kept", v) for v in (0, 1, 2)] == [30, 30, 50]
    assert [tuple(r) for r in job.table_at("n").watermarks.table().collect()] == [(0, 30), (1, 30), (2, 50)] or job.watermark("n") == 50
    assert job.watermark("s") == 50 and job.watermark("none") is None
    other = Job(JobConfig(spark, f"{tmp_path}/other"))
    other.existing_watermarked("kept", job.path("kept"))
    other.run("copy", other.pipe("kept", lambda s: s.map("id")))
    other.start()
    assert other.watermark("copy") == 50 and other.metrics()["copy"]["rows"] == 3


def test_lazy_steps_batches_of_rows_and_restarts(spark, tmp_path):
    source = Topic(spark, f"{tmp_path}/source")
    source.write(spark.createDataFrame(rows_of(2, 40), SCHEMA).coalesce(1))
    job, sizes, failed = Job(JobConfig(spark, f"{tmp_path}/job", partitions=1)), [], []
    job.existing("s", source.path)
    job.run("big", job.pipe("s", lambda s: s.filter("v > -20")).lazily())
    job.run("kept", job.pipe("big", lambda s: s.map("id", "v")))

    def effect(df, n):
        if not failed:
            failed.append(n)
            raise RuntimeError("the first time")
        sizes.append(df.count())

    job.run("sink", job.at_least_once("kept", effect).with_batch_size(rows=7))
    job.start(restarts=1, throttle=0.1)
    want = sum(r[2] > -20 for r in rows_of(2, 40))
    assert sum(sizes) == want and max(sizes) <= 7 and job.list_topics() == ["kept"]
    assert job.metrics()["sink"]["failures"] == 1 and job.metrics()["kept"]["rows"] == want
    with pytest.raises(TypeError):
        job.pipe("s", lambda s: s).watermark_by(F.col("ts")).lazily()


def test_a_running_query_is_started_again(spark, tmp_path):
    source = Topic(spark, f"{tmp_path}/source")
    source.write(spark.createDataFrame(rows_of(1, 5), SCHEMA))
    job, seen = Job(JobConfig(spark, f"{tmp_path}/job")), []
    job.existing("s", source.path)

    def effect(df, n):
        seen.append(n)
        if len(seen) == 1:
            raise RuntimeError("once")

    job.run("sink", job.at_least_once("s", effect))
    queries = job.start(available_now=False, every="0 seconds")
    queries = job.supervise(queries, 8, throttle=0.1)
    for q in queries:
        q.stop()
    assert len(seen) >= 2 and job.metrics()["sink"]["failures"] == 1


def test_custom_stream_in_parts(spark, tmp_path):
    df = custom_stream_parts(spark, "parts", StructType([StructField("part", LongType()), StructField("x", LongType())]), lambda: [3, 0, 5], lambda part, a, b: [(part, k) for k in range(a, b)])
    out = Topic(spark, f"{tmp_path}/out")
    query = df.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda d, n: out.append(d, n)).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["part"], r["x"]) for r in out.read().collect()) == [(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]


@pytest.mark.parametrize("many", [False, True])
def test_consuming_joins_in_a_job(spark, tmp_path, many):
    """In a session whose state store is not set for them; the setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    left, right = (Topic(spark, f"{tmp_path}/{n}") for n in ("l", "r"))
    left.write(spark.createDataFrame([(k, k, 10 * k, 0) for k in range(5)], SCHEMA))
    right.write(spark.createDataFrame([(100 + k, k % 5, k, 0) for k in range(5 if not many else 12)], SCHEMA))
    job = Job(JobConfig(spark, f"{tmp_path}/job"))
    job.existing("l", left.path)
    job.existing("r", right.path)
    job.run("met", job.consuming_join("l", "r", F.col("k"), F.col("k"), F.col("id"), F.col("id"), [F.col("l.v").alias("a"), F.col("r.id").alias("b")], many))
    job.start()
    assert sorted((r["a"], r["b"]) for r in job.topic("met").read().collect()) == sorted((10 * (k % 5), 100 + k) for k in range(12 if many else 5))
    assert spark.conf.get(name, None) == before


def test_a_null_key_is_a_key(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "x long, k string")
    got = {r["key"]: r["value"] for r in Stream(df).group_by(Key(F.col("k"))).aggregate(M.Count, F.lit(1)).collect()}
    assert got == {None: 2, "a": 1}


def test_one_to_many_meetings_of_several_batches_in_a_job(spark, tmp_path):
    """Right rows wait for a left row of a later batch; a new left row counts from then on; times keep their microseconds; no state in Python."""
    left, right = (Topic(spark, f"{tmp_path}/{n}") for n in ("l", "r"))
    job = Job(JobConfig(spark, f"{tmp_path}/job"))
    got = []
    for lefts, rights in (([], [(1, 1), (2, 2)]), ([(1, 7, 1)], [(3, 1)]), ([(1, 8, 2), (2, 9, 3)], [(4, 1), (5, 3)])):
        left.write(spark.createDataFrame(lefts, "k long, at long, us long").withColumn("t", F.timestamp_micros(F.lit(1600000000000000) + F.col("us"))))
        right.write(spark.createDataFrame(rights, "id long, k long"))
        if not got:
            job.existing("l", left.path)
            job.existing("r", right.path)
            job.run("met", job.consuming_join("l", "r", F.col("k"), F.col("k"), F.col("at"), 10 * F.col("id"), [F.col("l.at").alias("a"), F.unix_micros("l.t").alias("t"), F.col("r.id").alias("b")], True))
        queries = job.start()
        assert not any("TransformWithState" in q._jsq.toString() or q.lastProgress and q.lastProgress["stateOperators"] for q in queries)
        got.append(sorted((r["a"], r["t"] - 1600000000000000, r["b"]) for r in job.topic("met").read("a long, t long, b long").collect()))
    assert got == [[], [(7, 1, 1), (7, 1, 3)], [(7, 1, 1), (7, 1, 3), (8, 2, 4), (9, 3, 2)]]
