import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillmark.functions import monoids as M
from rillmark.operators.index import Index, entries
from rillmark.plans.jobs import Job, JobConfig
from rillmark.streaming.storage import Reader, Topic, WatermarkLog, default_watermark, lag, list_topics
from rillmark.streaming.tables import AggrTable


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)


@pytest.mark.parametrize("seed", [3, 4])
def test_readers_see_what_a_list_of_each_partition_holds(spark, tmp_path, seed):
    """Random commits to random partitions; readers of random names take random numbers of rows."""
    rng, t = random.Random(seed), Topic(spark, f"{tmp_path}/t")
    kept: dict[int, list[int]] = {p: [] for p in range(3)}
    for ver in range(4):
        rows = [(rng.randrange(3), rng.randrange(1000)) for _ in range(rng.randint(1, 30))]
        assert t.append(spark.createDataFrame(rows, "p int, x int"), ver, 2, F.col("p"), ("x",))
        for p in kept:
            kept[p] += sorted(x for q, x in rows if q == p)
    at: dict[tuple[str, int], int] = {}
    readers = {n: Reader(t, n) for n in ("left", "right")}
    for _ in range(12):
        name, p, n = rng.choice(list(readers)), rng.randrange(3), rng.randint(1, 25)
        begin = at.get((name, p), 0)
        assert [r["x"] for r in readers[name].read(n, p)] == kept[p][begin : begin + n]
        at[name, p] = min(begin + n, len(kept[p]))
    assert {(n, p) for n, r in readers.items() for p in r.checkpoints()} == {k for k, n in at.items() if n}
    assert {r["_pid"]: r["n"] for r in t.partition_counts().collect()} == {p: len(x) for p, x in kept.items() if x}
    assert t.count().first()["n"] == sum(map(len, kept.values()))
    some = rng.choice(t.read().collect())
    assert [r["x"] for r in t.get(some["_pid"], some["_ver"], some["_idx"]).collect()] == [some["x"]]
    fresh = Reader(t, "any")
    seen = [r["x"] for _ in range(60) for r in fresh.read(9)]
    assert len(seen) > 0 and set(seen) <= {x for own in kept.values() for x in own}


def test_partition_counts(spark, tmp_path):
    t = Topic(spark, f"{tmp_path}/t")
    t.append(strings(spark, *"abcdefgh"), 0, partitions=2)
    assert sorted(r["n"] for r in t.partition_counts().collect()) == [4, 4]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = Topic(spark, f"{tmp_path}/t")
    assert t.append(strings(spark, "a"), 0) and not t.append(strings(spark, "b"), 0)
    assert [r["value"] for r in t.read().collect()] == ["a"]


@pytest.mark.parametrize("seed", [5, 6])
def test_an_index_is_a_dict_of_lists(spark, tmp_path, seed):
    """Random rows with zero to three keys, over several commits."""
    rng, t, held = random.Random(seed), Topic(spark, f"{tmp_path}/t"), defaultdict(list)
    for ver in range(3):
        rows = [(1000 * ver + i, [rng.choice("pqrstuv") for _ in range(rng.randint(0, 3))]) for i in range(rng.randint(5, 40))]
        t.append(spark.createDataFrame(rows, "id int, keys array<string>"), ver, 1, F.lit(0), ("id",))
        for i, keys in rows:
            for k in keys:
                held[k].append(i)
    rows = t.read()
    ix = Index(entries(rows, F.col("keys")))
    for k in "pqrstuvw":
        assert sorted(r["id"] for r in ix.fetch(rows, k).collect()) == sorted(held.get(k, []))
        assert ix.count(k).first()["n"] == len(held.get(k, []))
        vers = [r["_ver"] for r in ix.lookup(k).collect()]
        assert vers == sorted(vers) == [i // 1000 for i in sorted(held.get(k, []))]
    low, high = sorted(rng.sample("pqrstuv", 2))
    inside = sorted(k for k in held if low <= k <= high)
    assert [tuple(r) for r in ix.counts(low, high).collect()] == [(k, len(held[k])) for k in inside]
    assert [r["key"] for r in ix.range(low, high).collect()] == [k for k in inside for _ in held[k]]
    assert [r["key"] for r in ix.range(low, high, limit=4, reverse=True).collect()] == [k for k in reversed(inside) for _ in held[k]][:4]


def partial(spark, rows, monoid):
    return spark.createDataFrame(rows, "key long, x long").groupBy("key").agg(*monoid.lifted(F.col("x")))


def test_table_rows_ranges_late_rows_and_compaction(spark, tmp_path):
    table = AggrTable(spark, f"{tmp_path}/a", M.Sum(), "key long, _v long")
    assert table.rows().collect() == [] and table.get_blocking(1, 0.1) is None
    table.add(partial(spark, [(k, k) for k in range(11)], M.Sum()), 0)
    table.add(partial(spark, [(k, k) for k in range(11)], M.Sum()), 1)
    assert not table.add(partial(spark, [(0, 99)], M.Sum()), 1)
    want = [(k, 2 * k) for k in range(3, 8)]
    assert [tuple(r) for r in table.get_row_range(3, 7).collect()] == want
    table.compact()
    assert table.batches.batch_ids() == [] and table.batches.covered() == 1
    assert not table.add(partial(spark, [(3, 99)], M.Sum()), 0)  # a replay of what the snapshot holds
    assert [tuple(r) for r in table.get_row_range(3, 7).collect()] == want
    table.add(partial(spark, [(3, 1)], M.Sum()), 2)
    table.compact()
    assert table.get_row(3).first()["value"] == 7 and table.get_row(50).collect() == []
    assert table.get_blocking(3, 1) == 7
    table.set(partial(spark, [(3, 5)], M.Sum()))
    table.add(partial(spark, [(3, 1)], M.Sum()), 9)
    assert table.get_row(3).first()["value"] == 6


def test_watermarks_are_monotone_and_versioned(spark, tmp_path):
    log = WatermarkLog(spark, f"{tmp_path}/w")
    assert log.at() is None and log.at(0) is None
    log.set(1, 100)
    log.set(3, 50)
    log.set(5, 200)
    assert [log.at(v) for v in (0, 1, 2, 3, 4, 5, None)] == [None, 100, 100, 100, 100, 200, 200]
    assert [tuple(r) for r in log.table().orderBy("ver").collect()] == [(1, 100), (3, 100), (5, 200)]


@pytest.mark.parametrize(("inputs", "want"), [([3, 5], 3), ([3, None], None), ([], None), ([7], 7)])
def test_default_watermark_waits_for_all_inputs(inputs, want):
    assert default_watermark(inputs) == want


def test_waiting_dumping_and_listing(spark, tmp_path):
    t = Topic(spark, f"{tmp_path}/step/data")
    assert not t.wait(timeout=0.1) and list_topics(spark, str(tmp_path)) == []
    t.write(strings(spark, "a", "b"))
    assert t.wait(timeout=0.1) and not t.wait(after=0, timeout=0.1)
    assert [r["value"] for r in t.dump()] == ["a", "b"] and list_topics(spark, str(tmp_path)) == ["step"]
    assert lag(9, 4) == 5 and lag(None, 4) is None


def test_writers_that_race_lose_nothing(spark, tmp_path):
    t, ids = Topic(spark, f"{tmp_path}/t"), []

    def write(k):
        for j in range(4):
            ids.append(t.write(strings(spark, f"{k}-{j}")))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(ids) == list(range(12)) == t.batch_ids()
    assert sorted(r["value"] for r in t.read().collect()) == sorted(f"{k}-{j}" for k in range(3) for j in range(4))


def test_a_commit_whose_writer_died_is_finished_by_others(spark, tmp_path):
    t = Topic(spark, f"{tmp_path}/t")
    strings(spark, "a").selectExpr("value", "0 as _pid", "cast(0 as long) as _ver", "cast(0 as long) as _idx").write.parquet(f"{t.path}/_staging-dead")
    assert t.claim("_claims/0", "_staging-dead") and not t.claim("_claims/0", "other")
    assert not t.append(strings(spark, "b"), 0)  # a replay
    assert t.write(strings(spark, "c")) == 1
    assert [r["value"] for r in t.dump()] == ["a", "c"] and [n for n in t.names() if n.startswith("_staging")] == []


def test_waiting_for_a_partition(spark, tmp_path):
    t = Topic(spark, f"{tmp_path}/t")
    t.append(strings(spark, "a"), 0, 1, F.lit(2))
    assert t.wait(pid=2, timeout=0.1) and not t.wait(pid=1, timeout=0.1) and not t.wait(after=0, pid=2, timeout=0.1)


def test_rows_in_order_without_a_partition_stand_in_ranges(spark, tmp_path):
    """Several tasks write them, and a step that reads all files knows which row was last."""
    t = Topic(spark, f"{tmp_path}/t")
    df = spark.range(4000).select("id", (F.col("id") * 7919 % 4001).alias("at"), F.repeat(F.lit("x"), F.when(F.col("id") % 4001 < 900, 90).otherwise(1).cast("int")).alias("s"))
    t.append(df.withColumn("at", F.when(F.col("at") > 2000, 2000).otherwise(F.col("at"))), 0, 4, order=("at", "id"))
    rows = t.dump()
    assert [(r["at"], r["id"]) for r in rows] == sorted((r["at"], r["id"]) for r in rows) and len(rows) == 4000
    assert t.partition_counts().count() == 4 and max(r["n"] for r in t.partition_counts().collect()) < 2000
    j = Job(JobConfig(spark, f"{tmp_path}/job"))
    j.existing("t", t.path)
    j.run("own", j.pipe("t", lambda s: s).watermark_by(F.col("at") * 10000 + F.col("id")))
    j.start()
    assert j.watermark("own") == 2000 * 10000 + rows[-1]["id"]
