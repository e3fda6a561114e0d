"""Versions on disk, bucketed tables and streams of updates."""

import pytest
from pyspark.sql import functions as F

from keyloom import SUM, KeyedFrame, fold
from keyloom.plans import exchanges, plan_text
from keyloom.sources import Store, load_bucketed, read_table, save_bucketed
from keyloom.streaming import upsert_stream


def small(spark, n=4):
    return KeyedFrame.from_df(spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")), "k", n=n)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.versions() == []
    first = small(spark)
    store.save(first, "1")
    store.save(first.put(5, -5), "2")
    assert store.versions() == ["1", "2"]
    assert store.get(5, "1") == 15 and store.get(5) == -5 and store.get(999) is None
    assert sorted(r.k for r in store.lookup([1, 2, 2, 500]).collect()) == [1, 2]
    assert store.load("1").count() == 200 and store.load("1").num_partitions == 4
    assert "PartitionFilters: [isnotnull(__p" in plan_text(store.lookup([7])).replace("\n", "")
    with pytest.raises(Exception, match="exist"):
        store.save(first, "1")


def test_broken_off_writes(spark, tmp_path, monkeypatch):
    """A write that stops at any step leaves no version, and can be done again."""
    store = Store(spark, str(tmp_path / "store"))
    store.save(small(spark), "1")

    def stop(*a):
        raise OSError("stopped")

    for step in ("_commit", "_files"):  # after the data; before them
        with monkeypatch.context() as m:
            m.setattr(store, step, stop)
            with pytest.raises(OSError):
                store.save(small(spark).put(5, -5), "2")
        assert store.versions() == ["1"]
    half = tmp_path / "store" / "v=2" / "data-x" / "__p=0"
    half.mkdir(parents=True, exist_ok=True)
    (half / "part-0.parquet").write_bytes(b"half a file")
    (tmp_path / "store" / "v=2" / "_draft-x").write_text('{"da')
    assert store.versions() == ["1"] and store.get(5) == 15
    store.save(small(spark).put(5, -5), "2")
    assert store.versions() == ["1", "2"] and store.get(5) == -5 and store.load("2").count() == 200
    assert not half.exists()


def test_version_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i, v in enumerate(("9", "10", "a2", "a10")):
        store.save(small(spark).put(0, i), v)
    assert store.versions() == ["9", "10", "a2", "a10"] and store.get(0) == 3 and store.get(0, "10") == 1


def test_deltas(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save(small(spark), "1")
    rows = spark.createDataFrame([(5, -5, 1), (5, -6, 2), (900, 9, 1)], "k long, v long, ord int")
    store.save_delta(rows, "2", "1", order_by="ord")
    store.save_delta(rows.limit(0), "3", "2", order_by="ord")
    store.save_delta(rows.where("k = 900").withColumn("v", F.lit(None).cast("long")), "4", "3")
    assert store.chain("4") == ["1", "2", "3", "4"] and store.get(5) == -6 and store.get(900, "3") == 9 and store.get(900) is None
    assert store.load("1").count() == 200 and store.load().count() == 201 and store.load("3").get(900) == 9
    assert sorted((r.k, r.v) for r in store.lookup([5, 6, 7000], "2").collect()) == [(5, -6), (6, 18)]
    with pytest.raises(ValueError, match="by overwrite"):
        store.save_delta(rows, "5", "4", SUM)


def test_bucketed(spark):
    save_bucketed(small(spark), "some_buckets")
    t = load_bucketed(spark, "some_buckets", "k", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert exchanges(t.inner_join(t.map_values(lambda v: -v), lambda k, a, b: a + b).to_df()) == 0
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert t.get(3) == 9
    spark.sql("DROP TABLE some_buckets")


def test_sources(spark, sf, tmp_path):
    spark.range(5).selectExpr("cast(id as string) k", "cast(id * 2 as string) v").write.csv(str(tmp_path / "csv"))
    spark.range(5).selectExpr("id k", "id * 2 v").write.json(str(tmp_path / "json"))
    assert read_table(spark, str(tmp_path / "csv"), "_c0", format="csv", n=2).get("3") == "6"
    assert read_table(spark, str(tmp_path / "json"), "k", format="json", n=2).get(3) == 6
    assert read_table(spark, f"{sf}/nation.parquet", "n_name", "n_regionkey", n=2).count() == 25


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(1, 10 + i), (i, 1)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v long").parquet(source)
        query = upsert_stream(stream, store, "k", 2, merge=SUM).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.k: r.v for r in store.load().to_df().collect()} == {0: 1, 1: 22}
    assert len(store.versions()) == 2
    assert len(store.chain(store.versions()[-1])) == 2  # the second batch wrote its updates alone


@pytest.mark.parametrize("merge", [SUM, fold(None, lambda k, a, u: a + u)])
def test_stream_after_a_failure(spark, tmp_path, monkeypatch, merge):
    """A batch that fails in the middle of its write is written once after a restart; full versions come every so often."""
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    real = Store._commit
    for i in range(4):
        spark.createDataFrame([(1, 10**i)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v long").parquet(source)
        for fails in (True, False) if i else (False,):
            with monkeypatch.context() as m:
                if fails:
                    m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
                query = upsert_stream(stream, store, "k", 2, merge=merge, every=3).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
                if fails:
                    with pytest.raises(Exception, match="stopped"):
                        query.awaitTermination()
                else:
                    query.awaitTermination()
    assert Store._commit is real and store.load().get(1) == 1111
    assert [len(store.chain(v)) for v in store.versions()] == ([1, 2, 3, 1] if merge == SUM else [1, 1, 1, 1])
