"""Every query of the engine against its SQL in DuckDB."""

import datetime
import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def value(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(map(value, v))
    if isinstance(v, list | tuple):
        return tuple(map(value, v))
    if isinstance(v, dict):
        return tuple(map(value, v.values()))
    return v if not isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def check(spark, duck, name, run, sql):
    df = run(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def _names():
    from rillmark.queries import QUERIES
    from rillmark.streaming.twins import STREAM_QUERIES

    return [*QUERIES, *STREAM_QUERIES]


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    check(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name])


def test_products_take_every_line(spark, duck):
    import __spark_entry__ as entry

    got = entry.queries()["product_by_order"](spark, SF).agg({"n": "sum", "k": "count"}).first()
    assert tuple(sorted(got)) == tuple(sorted(duck.execute("SELECT count(*), count(DISTINCT l_orderkey) FROM lineitem").fetchone()))


@pytest.mark.parametrize("name", ["consuming_join_stream", "one_to_one_optional_key"])
def test_these_joins_take_every_event_once(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF)
    assert got.where("x = y").distinct().count() == got.count() == duck.execute("SELECT count(*) FROM events").fetchone()[0]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports where their folder and the pipeline are gone."""
    (tmp_path / "rillmark").mkdir()
    for p in ROOT.joinpath("rillmark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "rillmark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, sys.argv[1]); import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    n, some = out.stdout.split()
    assert int(n) > 40 and some == "False"
