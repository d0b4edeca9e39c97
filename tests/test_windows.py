"""Frames of tables that are cut into slices, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.operators.relational import rel

from .compare import rows

N = 4_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("windows") / "t.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS id, CASE WHEN i % 11 > 0 THEN chr(97 + CAST(hash(i) % 2 AS INTEGER)) END AS p, CASE WHEN i % 13 > 0 THEN CAST(hash(i, 1) % 900 AS BIGINT) END AS k,
        CASE WHEN i % 17 > 0 THEN DATE '1950-01-01' + CAST(hash(i, 2) % 40 AS INTEGER) END AS d, CASE WHEN i % 5 = 0 THEN 'nan'::DOUBLE ELSE hash(i, 3) % 7 - 3.0 END AS f, CAST(hash(i, 4) % 1000 AS BIGINT) AS v FROM range({N}) r(i)) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{path}')")
    return spark.read.parquet(path), con


@pytest.mark.parametrize("window", [
    "partition by p order by k groups between 1 preceding and 1 following",
    "order by k desc nulls first groups between 2 preceding and current row",
    "partition by p order by d desc nulls last, k nulls first groups between 3 following and 20 following",
    "order by f, d groups between 7 preceding and 2 preceding",
    # NaN is a partition of several slices
    "partition by f order by k groups between 300 preceding and 2 following",
    # reaches over more steps than a slice has
    "partition by p order by k groups between 200 preceding and 10 following",
])
def test_groups_frames_by_slices(table, monkeypatch, window):
    df, con = table
    monkeypatch.setattr(windows, "SLICE_ROWS", 250)
    items = {"n": f"count(*) over ({window})", "hi": f"max(v) over ({window})", "total": f"sum(v) over ({window})", "first": f"min(id) over ({window})"}
    got = rel(df, "o").select("o.id", **items).frame()
    want = con.execute(f"SELECT id, {', '.join(f'{e} AS {n}' for n, e in items.items())} FROM t")
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_no_task_has_a_whole_partition(table, monkeypatch):
    df, _ = table
    monkeypatch.setattr(windows, "SLICE_ROWS", 250)
    got = rel(df).select("id", n="count(*) over (order by k groups between 1 preceding and 1 following)").frame()
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == N and max(sizes) < N / 2
