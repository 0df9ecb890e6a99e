"""Queries over the driver's tables, one for each engine operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import monoids as M
from rillmark.functions.scalars import from_millis, millis, sliding, tumbling, words
from rillmark.operators.index import Index, entries
from rillmark.operators.joins import one_to_many, one_to_one
from rillmark.operators.streams import Key, Stream
from rillmark.plans.jobs import Job, JobConfig
from rillmark.sources.push import BatchWriterConfig, push_stream
from rillmark.streaming.storage import Reader, Topic, WatermarkLog, lag
from rillmark.streaming.tables import AggrTable
from rillmark.streaming.workdir import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def stream(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    return Stream(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, persisted=True)


def job(spark: SparkSession, sf_dir: str, *tables: str) -> Job:
    out = Job(JobConfig(spark, "unused"))
    for t in tables:
        out.source(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return out


def one(c: Column | str) -> Key:
    """A single key."""
    return Key(F.col(c) if isinstance(c, str) else c)


def keyed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with coordinates: 1000 events a commit, four partitions."""
    df = stream(spark, sf_dir, "events").df
    return df.withColumns({"_pid": (F.col("event_id") % 4).cast("int"), "_ver": F.floor(F.col("event_id") / 1000).cast("long"), "_idx": F.col("event_id")})


COMMITS = 3
_VER = f"CAST(floor(event_id / 100) AS BIGINT) % {COMMITS}"


def written(spark: SparkSession, sf_dir: str, partitions: int = 4) -> Topic:
    """`events` as a topic of COMMITS commits: partitions by event_id, in each the events in its order."""
    out, df = Topic(spark, f"{work_dir(spark, 'topic')}/events/data"), stream(spark, sf_dir, "events").df
    for ver in range(COMMITS):
        out.append(df.where(F.floor(F.col("event_id") / 100) % COMMITS == ver), ver, partitions, F.col("event_id") % partitions, ("event_id",))
    return out


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "documents")
    j.run("counts", j.aggregate("documents", words(F.col("text")), M.Count, F.col("doc_id")))
    return keyed(j.batch("counts"), word="key", n="value")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def events_by_user_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = one(F.struct("user_id", F.to_date("ts").alias("day")))
    return stream(spark, sf_dir, "events").group_by(key).aggregate(M.Count, F.lit(1)).select("key.*", F.col("value").alias("n"))


@query("SELECT user_id, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY user_id")
def sum_int_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(stream(spark, sf_dir, "events").group_by(one("user_id")).aggregate(M.Sum(), F.col("event_id")), user_id="key", total="value")


def _wrap_sql(bits: int, signed: bool) -> str:
    size, half = 1 << bits, 1 << (bits - 1)
    low = f"((sum(event_id) % {size}) + {size}) % {size}"
    return f"SELECT user_id, CAST({f'CASE WHEN {low} >= {half} THEN {low} - {size} ELSE {low} END' if signed else low} AS BIGINT) AS total FROM events GROUP BY user_id"


def _wrap(bits: int, signed: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keyed(stream(spark, sf_dir, "events").group_by(one("user_id")).aggregate(M.Sum(bits, True, signed), F.col("event_id")), user_id="key", total="value")

    run.__name__ = f"sum_wrap_{'int' if signed else 'uint'}{bits}"
    return run


for _bits, _signed in ((8, True), (8, False), (16, True), (16, False), (32, True), (32, False)):
    query(_wrap_sql(_bits, _signed))(_wrap(_bits, _signed))


@query(f"SELECT user_id, CAST(CASE WHEN low >= {1 << 63}::HUGEINT THEN low - {1 << 64}::HUGEINT ELSE low END AS BIGINT) AS total FROM (SELECT user_id, CAST(sum(CAST(event_id % 10 AS HUGEINT) * 922337203685477580) AS HUGEINT) % {1 << 64}::HUGEINT AS low FROM events GROUP BY user_id)")
def sum_wrap_int64(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("event_id") % 10 * F.lit(922337203685477580)
    return keyed(stream(spark, sf_dir, "events").group_by(one("user_id")).aggregate(M.Sum(64, True), big), user_id="key", total="value")


@query("SELECT event_type, min(event_id) AS min_i, max(event_id) AS max_i, min(value) AS min_d, max(value) AS max_d, min(CAST(value AS FLOAT)) AS min_f, max(CAST(value AS FLOAT)) AS max_f FROM events GROUP BY event_type")
def min_max_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct(F.col("event_id").alias("min_i"), F.col("event_id").alias("max_i"), F.col("value").alias("min_d"), F.col("value").alias("max_d"), F.col("value").cast("float").alias("min_f"), F.col("value").cast("float").alias("max_f"))
    m = M.Tuple(min_i=M.Min, max_i=M.Max, min_d=M.Min, max_d=M.Max, min_f=M.Min, max_f=M.Max)
    return stream(spark, sf_dir, "events").group_by(one("event_type")).aggregate(m, v).select(F.col("key").alias("event_type"), "value.*")


@query("SELECT user_id, bool_and(value > 10) AS every, bool_or(value > 90) AS some FROM events GROUP BY user_id")
def all_any_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct((F.col("value") > 10).alias("every"), (F.col("value") > 90).alias("some"))
    return stream(spark, sf_dir, "events").group_by(one("user_id")).aggregate(M.Tuple(every=M.All, some=M.Any), v).select(F.col("key").alias("user_id"), "value.*")


@query("SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def mean_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").group_by(one("user_id")).aggregate(M.Mean, F.col("value")).select(F.col("key").alias("user_id"), F.round("value", 6).alias("mean"))


@query("SELECT c_nationkey AS nation, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS time_elapsed, count(*) AS num_finished FROM customer GROUP BY 1")
def pairwise_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct(F.round("c_acctbal").cast("bigint").alias("time_elapsed"), F.lit(1).cast("bigint").alias("num_finished"))
    return stream(spark, sf_dir, "customer").group_by(one("c_nationkey")).aggregate(M.Pairwise("time_elapsed", "num_finished"), v).select(F.col("key").alias("nation"), "value.*")


@query("SELECT l_orderkey AS k, product(l_quantity) AS p, count(*) AS n FROM lineitem GROUP BY 1")
def product_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order; products of whole numbers this size are exact."""
    v = F.struct(F.col("l_quantity").alias("p"), F.lit(1).alias("n"))
    return stream(spark, sf_dir, "lineitem").group_by(one("l_orderkey")).aggregate(M.Tuple(p=M.Product, n=M.Count), v).select(F.col("key").alias("k"), "value.*")


@query("SELECT count(*) AS n FROM events")
def global_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").group_by(one(F.lit(True))).aggregate(M.Count, F.lit(1)).select(F.col("value").alias("n"))


@query("SELECT k, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'click' THEN ['c', 'c'] WHEN 'error' THEN [] ELSE [event_type, 'other'] END) AS k FROM events) GROUP BY k")
def multi_key_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    keys = F.when(t == "click", F.array(F.lit("c"), F.lit("c"))).when(t == "error", F.array().cast("array<string>")).otherwise(F.array(t, F.lit("other")))
    return keyed(stream(spark, sf_dir, "events").group_by(keys).aggregate(M.Count, F.lit(1)), k="key", n="value")


@query("SELECT event_id, round(value * 2, 4) AS doubled FROM events WHERE event_type = 'purchase'")
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").filter("event_type = 'purchase'").map("event_id", F.round(F.col("value") * 2, 4).alias("doubled")).df


@query("SELECT event_id, value AS big FROM events WHERE value > 50")
def map_maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").map_maybe(event_id=F.col("event_id"), big=F.when(F.col("value") > 50, F.col("value"))).df


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def pipe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    j.run("even", j.pipe("events", lambda s: s.map_maybe(event_id=F.col("event_id"), k=F.when(k % 2 == 0, k))))
    return j.batch("even")


@query("SELECT event_id, upper(event_type) AS loud FROM events WHERE event_type <> 'view'")
def benign_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").benign_io("loud", lambda t: F.when(t != "view", F.upper(t)), F.col("event_type")).map("event_id", "loud").df


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_to_one(stream(spark, sf_dir, "documents").df, stream(spark, sf_dir, "labels").df, F.col("doc_id"), F.col("doc_id"), [F.col(c) for c in ("l.doc_id", "l.lang", "r.quality", "r.toxic")])


@query("SELECT a.event_id, a.user_id, b.event_type FROM events a JOIN events b ON a.event_id = b.event_id")
def one_to_one_self_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").df
    return one_to_one(e, e, F.col("event_id"), F.col("event_id"), [F.col(c) for c in ("l.event_id", "l.user_id", "r.event_type")])


@query("SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON nullif(a.event_id, 0) IS NOT DISTINCT FROM nullif(b.event_id, 0)")
def one_to_one_optional_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event; the key is null for one of them, so it is unique on each side."""
    e, k = stream(spark, sf_dir, "events").df, F.nullif(F.col("event_id"), F.lit(0))
    return one_to_one(e, e, k, k, [F.col("l.event_id").alias("x"), F.col("r.event_id").alias("y")], optional=True)


@query("SELECT o.o_orderkey, o.o_orderstatus, l.l_partkey, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def one_to_many_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_to_many(stream(spark, sf_dir, "orders").df, stream(spark, sf_dir, "lineitem").df, F.col("o_orderkey"), F.col("l_orderkey"), [F.col(c) for c in ("l.o_orderkey", "l.o_orderstatus", "r.l_partkey", "r.l_quantity")])


@query("SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def one_to_many_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_to_many(stream(spark, sf_dir, "customer").df, stream(spark, sf_dir, "orders").df, F.col("c_custkey"), F.col("o_custkey"), [F.col(c) for c in ("l.c_custkey", "l.c_name", "r.o_orderkey")], validate=True)


@query("SELECT n.n_name, c.c_custkey FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey")
def nation_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_to_many(stream(spark, sf_dir, "nation").df, stream(spark, sf_dir, "customer").df, F.col("n_nationkey"), F.col("c_nationkey"), [F.col("l.n_name"), F.col("r.c_custkey")])


def order_topology_job(j: Job, orders: str) -> str:
    """Three lazy looks at each order, joined one-to-one twice, then all of them by order: the reference's benchmark shape."""
    key = F.col("order_id")
    j.run("fraud", j.pipe(orders, lambda s: s.map(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") > 300_000).alias("is_fraud"))).lazily())
    j.run("stock", j.pipe(orders, lambda s: s.map(F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") != "P").alias("in_stock"))).lazily())
    j.run("details", j.pipe(orders, lambda s: s.benign_io("good_details", lambda c: c != "5-LOW", F.col("o_orderpriority")).map(F.col("o_orderkey").alias("order_id"), "good_details")).lazily())
    j.run("checked", j.one_to_one_join("fraud", "stock", key, key, [F.col("l.order_id"), (~F.col("l.is_fraud") & F.col("r.in_stock")).alias("good")]).lazily())
    j.run("joined", j.one_to_one_join("checked", "details", key, key, [F.col("l.order_id"), (F.col("l.good") & F.col("r.good_details")).alias("good")]).lazily())
    return j.run("good", j.aggregate("joined", one("order_id"), M.All, F.col("good")))


@query("SELECT o_orderkey AS order_id, bool_and(NOT o_totalprice > 300000 AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') AS good FROM orders GROUP BY 1")
def order_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "orders")
    return keyed(j.batch(order_topology_job(j, "orders")), order_id="key", good="value")


def _table(spark: SparkSession, sf_dir: str) -> AggrTable:
    """Counts and means of each user: a table with a set of partial results for each commit of the topic."""
    m, log = M.Tuple(n=M.Count, mean=M.Mean), written(spark, sf_dir)
    out = AggrTable(spark, work_dir(spark, "table"), m)
    for ver in range(COMMITS):
        own = log.read().where(F.col("_ver") == ver)
        out.add(Stream(own).group_by(one("user_id")).partials(m, F.struct(F.lit(1).alias("n"), F.col("value").alias("mean"))), ver)
    return out


def _user(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("user_id"), "value.n", F.round("value.mean", 9).alias("mean"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM events WHERE user_id = 5 GROUP BY user_id")
def row_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(_table(spark, sf_dir).get_row(5))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id BETWEEN 10 AND 20 GROUP BY user_id")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(_table(spark, sf_dir).get_row_range(10, 20)).drop("mean")


@query("SELECT count(*) AS n, round(avg(value), 9) AS mean FROM events WHERE user_id = 7")
def row_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir).get_blocking(7, 30)
    return spark.createDataFrame([(found["n"], round(found["mean"], 9))], "n long, mean double")


@query("SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY user_id")
def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(_table(spark, sf_dir).rows())


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def table_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table held before it was set is gone; what came after counts."""
    out, e = AggrTable(spark, work_dir(spark, "table"), M.Count), stream(spark, sf_dir, "events")

    def part(s: Stream) -> DataFrame:
        return s.group_by(one("event_type")).partials(M.Count, F.lit(1))

    out.add(part(e), 0)
    out.set(part(e.filter("event_type = 'click'")))
    out.add(part(e.filter("event_type <> 'click'")), 5)
    return keyed(out.rows(), key="key", n="value")


@query("SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY user_id")
def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hour's events come last, after the watermark passed them and the table was compacted: they count like all others."""
    m, e = M.Tuple(n=M.Count, mean=M.Mean), stream(spark, sf_dir, "events")
    out, early = AggrTable(spark, work_dir(spark, "table"), m), F.hour("ts") == 0

    def part(s: Stream) -> DataFrame:
        return s.group_by(one("user_id")).partials(m, F.struct(F.lit(1).alias("n"), F.col("value").alias("mean")))

    out.add(part(e.filter(~early)), 0)
    out.watermarks.set(0, e.df.agg(F.max(millis(F.col("ts")))).first()[0])
    out.compact()
    out.add(part(e.filter(early)), 1)
    return _user(out.rows())


@query("SELECT event_id % 4 AS pid, CAST(floor(event_id / 1000) AS BIGINT) AS ver, event_id AS idx FROM events WHERE event_type = 'click'")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Index(entries(topic(spark, sf_dir), F.array("event_type"))).lookup("click")
    return found.select(F.col("_pid").cast("bigint").alias("pid"), F.col("_ver").alias("ver"), F.col("_idx").alias("idx"))


@query("SELECT event_type AS key, event_id AS idx FROM events WHERE event_type BETWEEN 'click' AND 'purchase'")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(entries(topic(spark, sf_dir), F.array("event_type"))).range("click", "purchase").select("key", F.col("_idx").alias("idx"))


@query("SELECT user_id AS key, event_id AS idx FROM events WHERE user_id BETWEEN 3 AND 30 ORDER BY user_id DESC, CAST(floor(event_id / 1000) AS BIGINT) DESC, event_id % 4 DESC, event_id DESC LIMIT 25")
def index_range_reverse_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(entries(topic(spark, sf_dir), F.array("user_id"))).range(3, 30, limit=25, reverse=True).select("key", F.col("_idx").alias("idx"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(entries(topic(spark, sf_dir), F.array("event_type"))).count("error")


@query("SELECT user_id AS key, count(*) AS n FROM events WHERE user_id BETWEEN 3 AND 40 GROUP BY user_id")
def index_count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(entries(topic(spark, sf_dir), F.array("user_id"))).counts(3, 40)


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def index_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic(spark, sf_dir)
    return Index(entries(rows, F.array("user_id"))).fetch(rows, 7).select("event_id", "user_id", "event_type")


@query("SELECT w AS key, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w BETWEEN 'tha' AND 'the' GROUP BY w")
def index_words_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stream(spark, sf_dir, "documents").df.withColumns({"_pid": F.lit(0), "_ver": F.lit(0).cast("long"), "_idx": F.col("doc_id")})
    return Index(entries(docs, words(F.col("text")))).counts("tha", "the")


@query("SELECT count(*) AS n FROM events")
def topic_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).count()


@query("SELECT CAST(event_id % 4 AS INTEGER) AS pid, count(*) AS n FROM events GROUP BY 1")
def partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).partition_counts().withColumnRenamed("_pid", "pid")


@query(f"SELECT event_id, event_type FROM events WHERE event_id % 4 = 1 AND ({_VER} > 0 OR event_id > 301) ORDER BY {_VER}, event_id LIMIT 10")
def peek_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten after event 301 in its partition."""
    log = written(spark, sf_dir)
    at = log.read().where("event_id = 301").first()
    return log.peek(10, 1, (at["_ver"], at["_idx"])).select("event_id", "event_type")


@query(f"SELECT event_id, event_type FROM events WHERE event_id % 4 = 2 ORDER BY {_VER}, event_id LIMIT 5 OFFSET 7")
def read_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's second read goes on where its first ended; another reader doesn't move it."""
    log = written(spark, sf_dir)
    own, other = Reader(log, "own"), Reader(log, "other")
    own.read(7, 2)
    other.read(3, 2)
    return spark.createDataFrame([(r["event_id"], r["event_type"]) for r in own.read(5, 2)], "event_id long, event_type string")


@query("SELECT event_id, event_type FROM events WHERE event_id = 777")
def topic_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the coordinates that an index has of it."""
    log = written(spark, sf_dir)
    at = Index(entries(log.read(), F.array("event_id"))).lookup(777).first()
    return log.get(*at).select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream(spark, sf_dir, "events").group_by(one(tumbling(F.col("ts"), 60))).aggregate(M.Count, F.lit(1))
    return out.select(F.col("key").cast("timestamp_ntz").alias("start"), F.col("value").alias("n"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1")
def sliding_1h_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream(spark, sf_dir, "events").group_by(sliding(F.col("ts"), 60, 30)).aggregate(M.Count, F.lit(1))
    return out.select(F.col("key").cast("timestamp_ntz").alias("start"), F.col("value").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY 1")
def calendar_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = M.Monoid("decimal", (("_v", F.sum, F.sum),), lambda c: c["_v"].cast("decimal(28,2)"))
    return keyed(stream(spark, sf_dir, "events").group_by(one(F.to_date("ts"))).aggregate(total, F.col("value").cast("decimal(18,2)")), day="key", total="value")


@query("SELECT event_id, ms, make_timestamp(ms * 1000) AS back FROM (SELECT event_id, CAST(floor((epoch_us(ts) + 500) / 1000) AS BIGINT) AS ms FROM events)")
def epoch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = millis(F.col("ts"))
    return stream(spark, sf_dir, "events").map("event_id", ms.alias("ms"), from_millis(ms).cast("timestamp_ntz").alias("back")).df


def _set_by_hand(spark: SparkSession, sf_dir: str) -> WatermarkLog:
    """The greatest time of each commit of the topic, set one after the other."""
    log, found = WatermarkLog(spark, f"{work_dir(spark, 'log')}/watermark"), written(spark, sf_dir).read().groupBy("_ver").agg(F.max(millis(F.col("ts"))).alias("wm"))
    for ver, wm in sorted(tuple(r) for r in found.collect()):
        log.set(ver, wm)
    return log


_MS = "CAST(floor((epoch_us(ts) + 500) / 1000) AS BIGINT)"


@query(f"SELECT ver, max(own) OVER (ORDER BY ver) AS wm FROM (SELECT {_VER} AS ver, max({_MS}) AS own FROM events GROUP BY 1)")
def set_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_by_hand(spark, sf_dir).table()


@query(f"SELECT max({_MS}) AS wm FROM events WHERE {_VER} <= 1")
def watermark_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_set_by_hand(spark, sf_dir).at(1),)], "wm long")


@query(f"SELECT max({_MS}) - max({_MS}) FILTER ({_VER} = 0) AS ms FROM events")
def watermark_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _set_by_hand(spark, sf_dir)
    return spark.createDataFrame([(lag(log.at(), log.at(0)),)], "ms long")


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, min(c_custkey) AS first FROM customer GROUP BY ALL")
def dedupe_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are pushed with the key (nation, segment), by one writer and, after it ended, by another: the first of each key is written."""
    rows = stream(spark, sf_dir, "customer").df.select("c_custkey", "c_nationkey", "c_mktsegment")
    path, schema, half = work_dir(spark, "push"), "c_custkey long, c_nationkey int, c_mktsegment string", rows.agg(F.max("c_custkey")).first()[0] // 2
    for own in (rows.where(F.col("c_custkey") <= half), rows.where(F.col("c_custkey") > half)):
        log, writer = push_stream(spark, path, spark.createDataFrame([], schema).schema, BatchWriterConfig(max_items=1 << 16, max_bytes=1 << 30, max_queue=1 << 20))
        for r in own.orderBy("c_custkey").toLocalIterator():
            writer.write(tuple(r), f"{r['c_nationkey']}-{r['c_mktsegment']}".encode())
        writer.close()
    return log.read().select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("first"))


@query("SELECT CAST(epoch_ms(o_orderdate) AS BIGINT) AS wm FROM orders ORDER BY o_orderkey LIMIT 1")
def push_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first item of the writer's batch."""
    rows = stream(spark, sf_dir, "orders").df.select("o_orderkey", millis(F.col("o_orderdate").cast("timestamp")).alias("ms")).orderBy("o_orderkey").limit(20).collect()
    _, writer = push_stream(spark, work_dir(spark, "push"), spark.createDataFrame([], "o_orderkey long, ms long").schema, BatchWriterConfig(max_items=20, max_delay_s=20), watermark=lambda item: item[1])
    for r in rows:
        writer.write(tuple(r), str(r["o_orderkey"]).encode())
    writer.close()
    return spark.createDataFrame([(writer.log.at(),)], "wm long")


@query("SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, count(*) AS n FROM lineitem GROUP BY 1")
def revenue_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = M.Monoid("decimal", (("_v", F.sum, F.sum),), lambda c: c["_v"].cast("decimal(28,2)"))
    v = F.struct(F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"), F.lit(1).alias("n"))
    return stream(spark, sf_dir, "lineitem").group_by(one("l_orderkey")).aggregate(M.Tuple(revenue=money, n=M.Count), v).select(F.col("key").alias("k"), "value.*")


@query("SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def join_chain_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job(spark, sf_dir, "nation", "customer", "orders")
    j.run("placed", j.one_to_many_join("nation", "customer", F.col("n_nationkey"), F.col("c_nationkey"), [F.col("r.c_custkey"), F.col("r.c_mktsegment"), F.col("l.n_name")]))
    j.run("bought", j.one_to_many_join("placed", "orders", F.col("c_custkey"), F.col("o_custkey"), [F.col("l.c_mktsegment"), F.col("l.n_name")]))
    j.run("n", j.aggregate("bought", one(F.struct(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))), M.Count, F.lit(1)))
    return j.batch("n").select("key.*", F.col("value").alias("n"))
