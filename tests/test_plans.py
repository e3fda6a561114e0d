"""The table itself is never shuffled again."""

import re

import pytest
from pyspark.sql import functions as F

from keyloom import MAX, OVERWRITE, SUM, KeyedFrame, fold
from keyloom.plans import exchanges, plan_text


@pytest.fixture(scope="module")
def base(spark):
    t = KeyedFrame.from_df(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k", n=6).cache()
    t.count()
    return t


@pytest.fixture(autouse=True)
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_same_layout_needs_no_shuffle(base):
    other = base.map_values(lambda v: v + 1)
    f = lambda k, a, b: a
    for t in (base.inner_join(other, f), base.left_join(other, f), base.full_outer_join(other, f), base.diff(other), base.full_outer_join(other, f, lazy=True)):
        assert exchanges(t.to_df()) == 0
    chain = base.full_outer_join(other, f).inner_join(other, f).filter(lambda k, v: v > 3).left_join(base, f)
    assert exchanges(chain.to_df()) == 0


def test_updates_alone_are_shuffled(spark, base):
    updates = spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("v"))
    for t in (base.multiput_df(updates), base.multiput({1: 5}), base.multiput_df(updates, fold(None, lambda k, a, u: a - u)), base.update_join(updates, lambda k, a, u: a + u), base.delete_df(updates), base.inner_join(updates, lambda k, a, b: b)):
        assert exchanges(t.to_df()) == 1
    many = base
    for i in range(4):
        many = many.multiput_df(updates.where(F.col("k") >= i))
    assert exchanges(many.to_df()) == 4
    assert exchanges(base.lookup(updates)) <= 2


@pytest.mark.parametrize("merge", [OVERWRITE, SUM, MAX])
def test_named_merges_combine_before_the_shuffle(spark, merge):
    """Where n is the number of shuffle partitions, the only shuffle of updates is that of partial results."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    updates = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    base = KeyedFrame.from_df(spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("v")), "k", n=n).cache()
    built = KeyedFrame.from_df(updates, "k", n=n, merge=merge)
    for t in (built, base.multiput_df(updates, merge), base.aggregate_using_index(updates, merge), base.update_join(updates, merge)):
        plan = plan_text(t.to_df())
        assert exchanges(t.to_df()) == 1
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert re.search("partial_(sum|max|first|max_by)", below)
    joined = base.inner_join(updates, lambda k, a, b: b).to_df()
    assert exchanges(joined) == 1 and "partial_first" in plan_text(joined)
    # another n: combined rows are shuffled once more
    assert exchanges(KeyedFrame.from_df(updates, "k", n=n + 2, merge=SUM).to_df()) == 2


def test_layouts_of_the_input_are_kept(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    kept = KeyedFrame.from_df(rows.repartition(7, "k"), "k")
    assert kept.num_partitions == 7 and exchanges(kept.to_df()) == 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [KeyedFrame.from_df(x, "k").num_partitions for x in (rows, rows.repartition(7, "v"), rows.repartition(7), rows.repartition(7, "k", "v"))] == [n] * 4
    assert KeyedFrame.from_df(rows.repartition(7, "k"), "k", n=3).num_partitions == 3


def test_small_overwrites_only_filter_the_table(base):
    plan = plan_text(base.put(3, 1).to_df())
    assert "Aggregate" not in plan.split("InMemoryRelation")[0]


def test_filters_and_columns_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    found = KeyedFrame.from_df(rows, "o_orderkey", "o_totalprice", n=4).lookup([7])
    plan = plan_text(found)
    assert "EqualTo(o_orderkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
