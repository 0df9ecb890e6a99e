import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import components_of, prose
from tests.test_queries import SF, check

import __spark_entry__ as entry
import corpus_pipeline
from rillmark.llm import decontaminate, neardup, secrets, toxicity
from rillmark.session import ship


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_licences", "op7_near_duplicates", "op8_secrets", "op9_near_vectors"])
def test_query_equals_its_sql(spark, duck, name):
    check(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name])


def test_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_effect(spark, tmp_path):
    ship(spark)
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        made.append((name, docs, spark.read.parquet(f"{tmp_path}/{name}")))
        docs = made[-1][2]
    assert [n for n, _, _ in made] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(set(out.columns) == set(corpus_pipeline.COLUMNS) for _, _, out in made[:-1])
    (_, start, calm), (_, _, once), (_, _, apart), (_, _, safe), (_, _, packed) = made
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.scored(start, toxicity.trained(start, labels))
    assert calm.count() == scores.where("score < 0.5").count() < start.count()
    kept = {r["doc_id"] for r in neardup.near_duplicates(calm).where("kept").collect()}
    assert {r["doc_id"] for r in once.collect()} == kept and once.count() == len(kept) < calm.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert apart.count() == once.count() and decontaminate.contamination(apart, bench).agg(F.sum("n_hit")).first()[0] == 0
    same = once.join(apart.select("doc_id", F.col("text").alias("after")), "doc_id").join(decontaminate.contamination(once, bench).where("n_hit = 0"), "doc_id")
    assert same.where("text <> after").count() == 0
    assert safe.count() == apart.count() and secrets.secrets(safe).where("size(spans) > 0").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in safe.collect()}


def small_tables(spark, to, rows, marks, items):
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("x") for n in ("spans", "rep", "kept", "__id", "component_id")})
    wide.repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage against a plain version that uses none of the library, on nulls, empty and repeated texts, repeated ids and clashing columns."""
    from rillmark.llm.decontaminate import MARK

    rng = random.Random(31)
    item = prose(rng, 14)
    rows = [(i, prose(rng, rng.randint(8, 60)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper(), "en", "s", 0) for i in range(0, 20, 3)]  # copies
    rows += [(200, f"{prose(rng, 9)} {item} {prose(rng, 9)}", "en", "s", 0), (201, f"key token=abcdefgh1234 {prose(rng, 9)}", "en", "s", 0), (202, None, "en", "s", 0), (203, "", None, None, None)]
    rows += [(204, "first text of one id with some words", "en", "s", 0), (204, "another text of that id with others", "en", "s", 0), (204, "another text of that id with others", "de", "s", 0), (None, "no id here", "en", "s", 0), (None, None, None, None, None)]
    rows += [(300 + i, f"{prose(rng, 20)} grumbold {prose(rng, 20)}", "en", "s", 0) for i in range(60)]
    marks = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 1) for i in range(60)]
    sf = small_tables(spark, tmp_path / "in", rows, marks, [("a", item), (None, "x"), ("b", None)])
    ship(spark)
    made, held = {"start": spark.read.parquet(f"{sf}/documents.parquet")}, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[held or "start"], sf).write.parquet(f"{tmp_path}/{name}")
        made[name], held = spark.read.parquet(f"{tmp_path}/{name}"), name
    calm, once, apart, safe = ([tuple(r) for r in made[n].select("doc_id", "text").collect()] for n in ("toxicity", "near_duplicates", "decontamination", "secrets"))
    assert Counter(calm) == Counter((r[0], r[1]) for r in rows if "grumbold" not in (r[1] or ""))

    def sets(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    by_id = defaultdict(list)
    for i, t in calm:
        if i is not None:
            by_id[i].append(sets(t))
    own = components_of(by_id, lambda a, b: any(x and 100 * len(x & y) >= 80 * len(x | y) for x in a for y in b))
    assert Counter(once) == Counter({(i, t) for i, t in calm if i is not None and own[i] == i}) + Counter((i, t) for i, t in calm if i is None)
    want = Counter((i, t.replace(item, MARK) if t else t) for i, t in once)
    assert Counter(apart) == want and (200, next(t for i, t in apart if i == 200)) not in once
    assert Counter(safe) == Counter((i, re.sub(r"token=[a-z0-9]+", "[redacted]", t) if t else t) for i, t in apart)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted((i or -1, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]))) for i, t in safe)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in made["packing"].collect()) == ids
    kept = made["near_duplicates"].where("doc_id = 204").select("lang", "text").collect()
    assert sorted(map(tuple, kept)) == [("de", "another text of that id with others"), ("en", "first text of one id with some words")]


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = small_tables(spark, tmp_path / "in", [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_leaves_one_table(spark):
    from rillmark.llm.cluster import shared_dir
    from rillmark.streaming.storage import Folder

    before = set(Folder(spark, shared_dir(spark)).names())
    out = corpus_pipeline.run(spark, SF)
    left = [n for n in Folder(spark, shared_dir(spark)).names() if n not in before and n.startswith("pipeline")]
    assert len(left) == 1 and len(Folder(spark, f"{shared_dir(spark)}/{left[0]}").names()) == 1 and out.count() > 0


def test_workers_of_the_pipeline_give_memory_back(spark, tmp_path):
    """In one worker, 30 arrays of 10 MB are freed between small ones that stay: without the pipeline's settings it holds about 300 MB more."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        def held():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096 / 1e6

        for _ in batches:
            before = held()
            np.ones(30 << 20, np.uint8)  # once freed, glibc's own limit for arrays of their own is above 10 MB
            arrays, small = [], []
            for _ in range(30):
                arrays.append(np.ones(10 << 20, np.uint8))
                small += [np.ones(100_000, np.uint8) for _ in range(5)]
            arrays.clear()
            yield pa.RecordBatch.from_pydict({"mb": [held() - before - sum(x.nbytes for x in small) / 1e6]})

    corpus_pipeline.packed(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    got = [r["mb"] for r in spark.range(1).mapInArrow(run, "mb double").collect()]
    assert len(got) == 1 and got[0] < 100
