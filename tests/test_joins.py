import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators.joins import Meetings, consuming, one_to_many, one_to_one, sides, state_store
from rillmark.streaming.storage import Topic

BOTH = ["l", "r"]
SCHEMA = "payload string, k1 string, k2 string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_self_join_meets_each_row_with_itself(spark):
    df = frame(spark, [("joinKey1", "1", "2"), ("joinKey2", "5", "6"), ("joinKey3", "5", "6")])
    got = one_to_one(df, df, F.col("payload"), F.col("payload"), BOTH).collect()
    assert len(got) == 3 and all(r["l"] == r["r"] for r in got)


def test_one_to_many_is_the_nested_loop(spark):
    left = [("k1", "1", "2"), ("k2", "2", "3"), ("k3", "4", "5")]
    right = [("k1", "1", "3"), ("k1", "5", "7"), ("k2", "7", "9"), (None, "0", "0")]
    got = one_to_many(frame(spark, left), frame(spark, right), F.col("payload"), F.col("payload"), BOTH, validate=True).collect()
    assert sorted((tuple(r["l"]), tuple(r["r"])) for r in got) == sorted((a, b) for a in left for b in right if a[0] == b[0])


def test_validate_raises_for_a_repeated_left_key(spark):
    df = frame(spark, [("k", "1", "2"), ("k", "2", "3")])
    with pytest.raises(Exception, match="left key repeats"):
        one_to_many(df, df, F.col("payload"), F.col("payload"), BOTH, validate=True).collect()


@pytest.mark.parametrize(("optional", "n"), [(False, 0), (True, 1)])
def test_null_keys_meet_only_if_optional(spark, optional, n):
    df = frame(spark, [(None, "1", "2")])
    assert len(one_to_one(df, df, F.col("payload"), F.col("payload"), BOTH, optional).collect()) == n


@pytest.mark.parametrize("many", [False, True])
def test_consuming_join_in_order_of_arrival(spark, tmp_path, many):
    """L1 R1 L2 R2 gives (L1, R1), (L2, R2); with many, the last left row wins and early right rows wait."""
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(0, 2, 1, 100), (1, 1, 1, 10), (1, 3, 1, 11), (0, 4, 1, 101), (1, 5, 1, 12), (1, 9, 2, 13)], "side int, at long, k long, v long").coalesce(1).write.parquet(folder)
    rows = spark.readStream.schema("side int, at long, k long, v long").parquet(folder)
    met = consuming(rows.where("side = 0"), rows.where("side = 1"), F.col("k"), F.col("k"), F.col("at"), F.col("at"), many)
    at = Topic(spark, f"{tmp_path}/out")
    with state_store(spark):
        query = met.select("l.v", F.col("r.v").alias("w")).writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda df, n: at.append(df, n)).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["v"], r["w"]) for r in at.read().collect())
    assert got == ([(100, 10), (100, 11), (101, 12)] if many else [(100, 10), (101, 11)])


def plain(batches, many):
    """The pairs of each micro-batch: rows (side, at, key, v), in the order of their time, against what waits of their key."""
    left, right, backlog, out = {}, {}, {}, []
    for rows in batches:
        met = []
        for side, _, k, v in sorted(rows, key=lambda x: (x[1], x[0])):
            if k is None:
                continue
            if many and side == 0:
                left[k] = v
                met += [(v, w) for w in backlog.pop(k, [])]
            elif many:
                met += [(left[k], v)] if k in left else []
                backlog.setdefault(k, []).extend([] if k in left else [v])
            else:
                own, other = (left, right) if side == 0 else (right, left)
                if k in other:
                    w = other.pop(k)
                    met.append((v, w) if side == 0 else (w, v))
                else:
                    own[k] = v
        out.append(sorted(met))
    return out


@pytest.mark.parametrize("many", [False, True])
def test_meetings_by_batches_equal_the_plain_machine(spark, tmp_path, many):
    """Over more batches than are merged; a batch that comes again gives what it gave and changes nothing."""
    rng, schema = random.Random(3), "side int, at long, k long, v long"
    times = rng.sample(range(1000), 300)
    made = [(rng.randrange(2), times[i], rng.choice([None, *range(9)]), i) for i in range(300)]
    batches = [made[a : a + 30] for a in range(0, 300, 30)]
    state, got = Meetings(f"{tmp_path}/state", many), []
    assert len(batches) > Meetings.MERGED
    for n, b in enumerate(batches):
        df = spark.createDataFrame(b, schema)
        both = sides(df.where("side = 0"), df.where("side = 1"), F.col("k"), F.col("k"), F.col("at"), F.col("at"))
        for _ in range(1 + (n in (3, 8))):
            met = sorted(tuple(r) for r in state.met(both, n).select("l.v", "r.v").collect())
        got.append(met)
    assert got == plain(batches, many) and sum(map(len, got)) > 50
    df = spark.createDataFrame(made, schema)
    whole = consuming(df.where("side = 0"), df.where("side = 1"), F.col("k"), F.col("k"), F.col("at"), F.col("at"), many).select("l.v", "r.v")
    assert sorted(tuple(r) for r in whole.collect()) == plain([made], many)[0]
    assert "TransformWithState" not in whole._jdf.queryExecution().toString()
