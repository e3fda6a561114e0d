"""Every catalogue query against the same result in SQL."""

import re

import pytest

from keyloom.plans import catalog, plan_text
from keyloom.sources import partitions_for, storage


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, same, name):
    same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r.k: r.v for r in entry.entry(spark).collect()}
    assert rows[1234] == 10873.0 and 998 not in rows and 999 not in rows
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["delete_many", "multiget_many", "lazy_delete"])
def test_partitions_grow_with_the_data(spark, sf, monkeypatch, name):
    """With ten times the data no task gets more of it, and the rows are those of SQL."""
    import duckdb

    monkeypatch.setattr(storage, "PARTITION_BYTES", 10_000)
    larger = sf.replace("0.001", "0.01")
    n = [catalog._n(spark, d) for d in (sf, larger)]
    assert n[0] > catalog.N and n[1] > 5 * n[0]
    df = catalog.queries()[name](spark, larger)
    dealt = {int(x) for x in re.findall(r"hashpartitioning\(k\S*, (\d+)\)", plan_text(df))}
    assert n[1] in dealt and catalog.N not in dealt
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{larger}/{t}.parquet')")
    assert sorted(map(tuple, df.select("k", "v").collect())) == sorted(con.sql(f"SELECT k, v FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_partitions_for_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/1", "a/2", "b"):
        (tmp_path / name).write_bytes(bytes(2 * storage.PARTITION_BYTES // 3))
    count = lambda *names, **how: partitions_for(spark, [f"{tmp_path}/{x}" for x in names], **how)
    assert [count("a"), count("a", "b"), count("*"), count("b", "none"), count("none", least=5), count("a", least=9)] == [2, 2, 2, 1, 5, 9]
