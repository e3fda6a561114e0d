"""The engine's operators as queries over the test tables, each with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.merge import SUM, Fold, PandasFold, fold
from ..operators.frame import KeyedFrame, shared_folder
from ..operators.layered import Reducer
from ..sources.storage import Store, load_bucketed, partitions_for, save_bucketed

N = 8  # least partitions of the tables below

#: What the tables below are made of.
_TABLES = ("customer", "part", "orders", "lineitem", "events")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _n(spark: SparkSession, d: str) -> int:
    """Partitions of the tables of d.  All have one layout, whose partitions grow in number with the data, not in size."""
    return partitions_for(spark, [f"{d}/{t}.parquet" for t in _TABLES], least=N)


def _read(spark: SparkSession, d: str, table: str, k: str, v: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(F.col(k).alias("k"), F.col(v).alias("v"))


def _orders(spark: SparkSession, d: str, where: str = "true", n: int | None = None) -> KeyedFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").where(where)
    return KeyedFrame.from_df(rows.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "k", n=n or _n(spark, d))


def _quantities(spark: SparkSession, d: str, n: int | None = None) -> KeyedFrame:
    """By order; some orders have no lines."""
    return KeyedFrame.from_df(_read(spark, d, "lineitem", "l_orderkey", "l_quantity"), "k", n=n or _n(spark, d), merge=SUM)


def _customers(spark: SparkSession, d: str) -> KeyedFrame:
    return KeyedFrame.from_df(_read(spark, d, "customer", "c_custkey", "c_acctbal"), "k", n=_n(spark, d))


def _builders(spark: SparkSession, d: str) -> KeyedFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'")
    return KeyedFrame.from_df(rows.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k", n=_n(spark, d))


def _finished(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders by customer: repeats keys; the order key gives the order."""
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'")
    return rows.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("u"), F.col("o_orderkey").alias("ord"))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


_O = "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders)"
_C = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
_B = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING')"
_OPEN = "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O')"
_QUANTITY = "(SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey)"
_LAST = "(SELECT k, u FROM (SELECT o_custkey AS k, o_totalprice AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') t WHERE rn = 1)"
_TOTAL = "(SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)"


@_query(f"SELECT k, v FROM {_O}")
def build_unique(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).to_df()


@_query("SELECT k, v FROM (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1")
def build_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "event_id")
    return KeyedFrame.from_df(rows, "k", "v", n=_n(spark, d), order_by="event_id").to_df()


@_query("SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY o_custkey")
def build_fold_commutative(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"), F.lit(1).cast("long").alias("v"))
    return KeyedFrame.from_df(rows, "k", n=_n(spark, d), merge=SUM).to_df()


@_query("SELECT user_id AS k, list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.5 + x) AS v FROM events GROUP BY user_id")
def build_fold_ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "event_id")
    return KeyedFrame.from_df(rows, "k", "v", n=_n(spark, d), merge=fold(None, lambda k, a, x: a * 0.5 + x), order_by="event_id").to_df()


@_query("SELECT user_id AS k, list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.5 + x) AS v FROM events GROUP BY user_id")
def build_fold_pandas(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "event_id")
    return KeyedFrame.from_df(rows, "k", "v", n=_n(spark, d), merge=PandasFold(lambda k, u: u, lambda k, a, x: a * 0.5 + x), order_by="event_id").to_df()


@_query(f"SELECT k, v FROM {_O} WHERE k = 1234")
def get(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).lookup([1234])


@_query(f"SELECT k, v FROM {_O} WHERE k IN (-1, 0, 1, 98, 98)")
def multiget(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).lookup([-1, 0, 1, 98, 98])


@_query(f"SELECT k, v FROM {_O} WHERE k IN (SELECT l_orderkey FROM lineitem)")
def multiget_many(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"))
    return _orders(spark, d).lookup(wanted)


@_query(f"SELECT count(*) AS n FROM {_O}")
def count(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).to_df().agg(F.count("*").alias("n"))


@_query(f"SELECT k, v FROM {_O} UNION ALL SELECT CAST(-1 AS BIGINT) AS k, CAST(-1.0 AS DOUBLE) AS v")
def put_insert(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).put(-1, -1.0).to_df()


@_query(f"SELECT k, CASE WHEN k = 1234 THEN CAST(10873.0 AS DOUBLE) ELSE v END AS v FROM {_O}")
def put_update(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).put(1234, 10873.0).to_df()


_THREE = "(SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(-1.0 AS DOUBLE)), (CAST(0 AS BIGINT), CAST(1.0 AS DOUBLE)), (CAST(1 AS BIGINT), CAST(7.0 AS DOUBLE))) AS t(k, v))"


@_query(f"SELECT coalesce(b.k, u.k) AS k, CASE WHEN u.k IS NULL THEN b.v ELSE u.v END AS v FROM {_O} b FULL JOIN {_THREE} u ON b.k = u.k")
def multiput_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).multiput({-1: -1.0, 0: 1.0, 1: 7.0}).to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, CASE WHEN b.k IS NULL THEN u.v WHEN u.k IS NULL THEN b.v ELSE b.v + u.v END AS v FROM {_O} b FULL JOIN {_THREE} u ON b.k = u.k")
def multiput_merge(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).multiput({-1: -1.0, 0: 1.0, 1: 7.0}, merge=SUM).to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, CASE WHEN b.k IS NULL THEN length(u.t) * 1.0e0 WHEN u.k IS NULL THEN b.v ELSE b.v - length(u.t) END AS v FROM {_O} b FULL JOIN (SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'aaaa'), (CAST(0 AS BIGINT), 'bb')) AS t(k, t)) u ON b.k = u.k")
def multiput_project(spark: SparkSession, d: str) -> DataFrame:
    """Updates of another type than the values."""
    spec = fold(lambda k, u: F.length(u).cast("double"), lambda k, old, u: old - F.length(u))
    return _orders(spark, d).multiput({-1: "aaaa", 0: "bb"}, merge=spec, update_type="string").to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, CASE WHEN u.k IS NULL THEN b.v ELSE u.u END AS v FROM {_C} b FULL JOIN {_LAST} u ON b.k = u.k")
def multiput_rdd_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).multiput_df(_finished(spark, d).withColumnRenamed("u", "v"), order_by="ord").to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, round(CASE WHEN b.k IS NULL THEN u.s WHEN u.k IS NULL THEN b.v ELSE b.v + u.s END, 2) AS v FROM {_B} b FULL JOIN {_TOTAL} u ON b.k = u.k")
def multiput_rdd_dups(spark: SparkSession, d: str) -> DataFrame:
    return _builders(spark, d).multiput_df(_finished(spark, d).select("k", "u"), merge=SUM).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, round(CASE WHEN b.k IS NULL THEN u.s WHEN u.k IS NULL THEN b.v ELSE b.v + u.s END, 2) AS v FROM {_B} b FULL JOIN {_TOTAL} u ON b.k = u.k")
def multiput_rdd_fold(spark: SparkSession, d: str) -> DataFrame:
    """The same with an opaque fold over each key's rows in order."""
    spec = Fold(lambda k, u: u["u"], lambda k, a, u: a + u["u"])
    updates = _finished(spark, d).select("k", F.struct("ord", "u").alias("u"))
    return _builders(spark, d).multiput_df(updates, merge=spec, order_by=F.col("u.ord")).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT k, v FROM {_O} WHERE NOT (k IN (-1, 0, 998, 999))")
def delete(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).delete([-1, 0, 998, 999]).to_df()


@_query(f"SELECT k, v FROM {_O} WHERE k NOT IN (SELECT l_orderkey FROM lineitem)")
def delete_many(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).delete_df(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"))).to_df()


@_query(f"SELECT k, v FROM {_O} WHERE k % 2 = 0 AND v > 100000")
def filter_(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(lambda k, v: (k % 2 == 0) & (v > 100000)).to_df()


@_query(f"SELECT k, -v AS v FROM {_O}")
def map_values(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map_values(lambda v: -v).to_df()


@_query(f"SELECT k, v + k AS v FROM {_O}")
def map_values_with_key(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).map_values(lambda k, v: v + k, with_key=True).to_df()


_CHANGED = "(SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN -o_totalprice ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'F')"


def _changed(spark: SparkSession, d: str) -> KeyedFrame:
    """Unfinished orders; the values of urgent ones differ."""
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'F'")
    value = F.when(F.col("o_orderpriority") == "1-URGENT", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return KeyedFrame.from_df(rows.select(F.col("o_orderkey").alias("k"), value.alias("v")), "k", n=_n(spark, d))


@_query(f"SELECT a.k, a.v FROM {_O} a JOIN {_CHANGED} o ON a.k = o.k WHERE a.v <> o.v")
def diff(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).diff(_changed(spark, d)).to_df()


@_query(f"SELECT a.k, a.v FROM {_C} a JOIN {_LAST} o ON a.k = o.k WHERE a.v <> o.u")
def diff_pairs_dups(spark: SparkSession, d: str) -> DataFrame:
    last = _customers(spark, d).create_using_index(_finished(spark, d), order_by="ord", values="u")
    return _customers(spark, d).diff(last).to_df()


@_query(f"SELECT coalesce(a.k, d.k) AS k, coalesce(a.v, 0) + coalesce(d.v, 0) AS v FROM {_OPEN} a FULL JOIN {_QUANTITY} d ON a.k = d.k")
def full_outer_join(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, "o_orderstatus = 'O'").full_outer_join(_quantities(spark, d), lambda k, x, y: _zero(x) + _zero(y)).to_df()


@_query(_SQL["full_outer_join"])
def full_outer_join_lazy(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, "o_orderstatus = 'O'").full_outer_join(_quantities(spark, d), lambda k, x, y: _zero(x) + _zero(y), lazy=True).to_df()


_STACK = f"(SELECT k, sum(v) AS v FROM (SELECT k, v FROM {_OPEN} a UNION ALL SELECT k, v * 2 AS v FROM {_QUANTITY} b UNION ALL SELECT o_orderkey AS k, o_totalprice * 4 AS v FROM orders WHERE o_orderpriority = '1-URGENT') s GROUP BY k)"


def _stack(spark: SparkSession, d: str):
    plus = Reducer(lambda k, x, y: _zero(x) + _zero(y), associative=True)
    first = _orders(spark, d, "o_orderstatus = 'O'").full_outer_join(_quantities(spark, d).map_values(lambda v: v * 2), plus, lazy=True)
    return first.full_outer_join(_orders(spark, d, "o_orderpriority = '1-URGENT'").map_values(lambda v: v * 4), plus, lazy=True)


@_query(f"SELECT k, round(v, 2) AS v FROM {_STACK}")
def lazy_stack(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT k, round(v, 2) AS v FROM {_STACK}")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).reindex().map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT k, round(v, 2) AS v FROM {_STACK} WHERE k IN (3, 6000, 9000, 14000)")
def lazy_multiget(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).lookup([3, 6000, 9000, 14000, 3]).select("k", F.round("v", 2).alias("v"))


@_query(f"SELECT k, round(v, 2) AS v FROM {_STACK} WHERE v > 500000")
def lazy_filter(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).filter(lambda k, v: v > 500000).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT k, CASE WHEN k = 3 THEN CAST(1.0 AS DOUBLE) ELSE round(v, 2) END AS v FROM {_STACK} WHERE k <> 9000")
def lazy_put_delete(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).map_values(lambda v: F.round(v, 2)).put(3, 1.0).delete([9000]).to_df()


@_query(f"SELECT count(*) AS n FROM {_STACK}")
def lazy_count(spark: SparkSession, d: str) -> DataFrame:
    return _stack(spark, d).to_df().agg(F.count("*").alias("n"))


@_query(f"SELECT c.k, round(c.v + coalesce(u.s, 0), 2) AS v FROM {_C} c LEFT JOIN {_TOTAL} u ON c.k = u.k")
def update_join_dups(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).update_join(_finished(spark, d).select("k", "u"), lambda k, v, u: v + u).map_values(lambda v: F.round(v, 2)).to_df()


@_query(_SQL["update_join_dups"])
def update_join_named(spark: SparkSession, d: str) -> DataFrame:
    """The same by a named merge, which combines before the shuffle."""
    return _customers(spark, d).update_join(_finished(spark, d).select("k", "u"), SUM).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT b.k, round(b.v - u.v, 2) AS v FROM {_O} b JOIN {_STACK} u ON b.k = u.k")
def lazy_inner_join(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).inner_join(_stack(spark, d), lambda k, v, u: F.round(v - u, 2), name="v").to_df()


@_query(f"SELECT b.k, round(b.v - coalesce(u.v, 0), 2) AS v FROM {_O} b LEFT JOIN {_STACK} u ON b.k = u.k")
def lazy_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).left_join(_stack(spark, d), lambda k, v, u: F.round(v - _zero(u), 2), name="v").to_df()


@_query(f"SELECT b.k, round(b.v + coalesce(u.v, 0), 2) AS v FROM {_O} b LEFT JOIN {_STACK} u ON b.k = u.k")
def lazy_update_join(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).update_join(_stack(spark, d), lambda k, v, u: v + u).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT b.k, b.v FROM {_O} b JOIN {_STACK} u ON b.k = u.k WHERE abs(b.v - u.v) > 0.005")
def lazy_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rounded, as sums in another order differ in the last places."""
    cents = lambda t: t.map_values(lambda v: F.round(v, 2))
    return cents(_orders(spark, d)).diff(cents(_stack(spark, d))).to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, round(coalesce(b.v, 0) + coalesce(u.v, 0), 2) AS v FROM {_OPEN} b FULL JOIN {_STACK} u ON b.k = u.k")
def lazy_multiput(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, "o_orderstatus = 'O'").multiput_df(_stack(spark, d), SUM).map_values(lambda v: F.round(v, 2)).to_df()


@_query(f"SELECT k, v FROM {_O} WHERE k NOT IN (SELECT k FROM {_STACK} s)")
def lazy_delete(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).delete_df(_stack(spark, d)).to_df()


@_query(f"SELECT c.k, round(c.v - coalesce(u.u, 0), 2) AS v FROM {_C} c LEFT JOIN {_LAST} u ON c.k = u.k")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    other = _finished(spark, d).select("k", F.struct("ord", "u").alias("u"))
    return _customers(spark, d).left_join(other, lambda k, v, u: F.round(v - _zero(u["u"]), 2), order_by=F.col("u.ord"), name="v").to_df()


@_query(f"SELECT b.k, round(b.v - u.u, 2) AS v FROM {_O} b JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) u ON b.k = u.k")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("u"))
    return orders.inner_join(orders.aggregate_using_index(rows, SUM), lambda k, v, u: F.round(v - u, 2), name="v").to_df()


@_query(f"SELECT b.k, b.v - u.u AS v FROM {_C} b JOIN {_LAST} u ON b.k = u.k")
def inner_join_pairs(spark: SparkSession, d: str) -> DataFrame:
    other = _finished(spark, d).select("k", F.struct("ord", "u").alias("u"))
    return _customers(spark, d).inner_join(other, lambda k, v, u: v - u["u"], order_by=F.col("u.ord"), name="v").to_df()


@_query(f"SELECT k, u AS v FROM {_LAST} u")
def create_using_index(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).create_using_index(_finished(spark, d).withColumnRenamed("u", "v"), order_by="ord", values="v").to_df()


@_query("SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey")
def aggregate_using_index(spark: SparkSession, d: str) -> DataFrame:
    parts = KeyedFrame.from_df(_read(spark, d, "part", "p_partkey", "p_retailprice"), "k", n=_n(spark, d))
    return parts.aggregate_using_index(_read(spark, d, "lineitem", "l_partkey", "l_quantity"), SUM).to_df()


@_query("SELECT l_orderkey AS k1, l_linenumber AS k2, sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber")
def tuple_key(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_quantity").alias("v"))
    return KeyedFrame.from_df(rows, ["k1", "k2"], n=_n(spark, d), merge=SUM).to_df()


@_query("SELECT n.n_name AS k, n.n_regionkey AS v FROM nation n WHERE n.n_name IN (SELECT max(n_name) FROM nation UNION ALL SELECT 'NOWHERE')")
def string_key(spark: SparkSession, d: str) -> DataFrame:
    nations = KeyedFrame.from_df(_read(spark, d, "nation", "n_name", "n_regionkey"), "k", n=N)
    last = nations.to_df().agg(F.max("k").alias("k")).union(spark.sql("SELECT 'NOWHERE' AS k"))
    return nations.lookup(last)


@_query(f"SELECT 'v1' AS ver, k, v FROM {_O} WHERE k = 1234 UNION ALL SELECT 'v2' AS ver, k, CAST(10873.0 AS DOUBLE) AS v FROM {_O} WHERE k = 1234")
def version_isolation(spark: SparkSession, d: str) -> DataFrame:
    first = _orders(spark, d)
    second = first.put(1234, 10873.0)
    tag = lambda t, name: t.lookup([1234]).select(F.lit(name).alias("ver"), "k", "v")
    return tag(first, "v1").union(tag(second, "v2"))


@_query(f"SELECT t.k, EXISTS (SELECT 1 FROM {_O} b WHERE b.k = t.k) AS here FROM (VALUES (CAST(-1 AS BIGINT)), (CAST(0 AS BIGINT)), (CAST(98 AS BIGINT))) AS t(k)")
def contains(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    return spark.createDataFrame([(k, orders.contains(k)) for k in (-1, 0, 98)], "k long, here boolean")


@_query(f"SELECT k, v FROM {_O} WHERE v > 100000")
def persisted(spark: SparkSession, d: str) -> DataFrame:
    """Kept in memory, with a name that SQL knows."""
    _orders(spark, d).persist().set_name("keyloom_orders")
    return spark.sql("SELECT k, v FROM keyloom_orders WHERE v > 100000")


@_query(f"SELECT k, CASE WHEN k IN (0, 1, 2) THEN CAST(-1.0 AS DOUBLE) ELSE v END AS v FROM {_O}")
def compacted(spark: SparkSession, d: str) -> DataFrame:
    """A stack of writes, its plan cut."""
    table = _orders(spark, d)
    for k in range(3):
        table = table.put(k, -1.0)
    return table.compact().to_df()


@_query("SELECT CAST(8 AS INTEGER) AS n, count(DISTINCT o_orderkey) AS keys, CAST(0 AS BIGINT) AS elsewhere FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def layout(spark: SparkSession, d: str) -> DataFrame:
    """Tables of one layout hold a key in the same partition."""
    a, b = _orders(spark, d, n=N), _quantities(spark, d, n=N)
    placed = lambda t, name: t.to_df().select("k", F.spark_partition_id().alias(name))
    both = placed(a, "p").join(placed(b, "q"), "k")
    return both.agg(F.lit(a.num_partitions).alias("n"), F.count("*").alias("keys"), F.count_if(F.col("p") != F.col("q")).alias("elsewhere"))


@_query("SELECT CAST(5 AS INTEGER) AS n, count(*) AS keys FROM orders")
def layout_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A layout that the input has is kept."""
    table = KeyedFrame.from_df(_read(spark, d, "orders", "o_orderkey", "o_totalprice").repartition(5, "k"), "k")
    return table.to_df().agg(F.lit(table.num_partitions).alias("n"), F.count("*").alias("keys"))


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/keyloom-{uuid.uuid4().hex}"


@_query(f"SELECT k, v FROM {_O}")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as a version and read again."""
    store = Store(spark, _place(spark))
    store.save(_orders(spark, d), "1")
    return store.load().to_df()


@_query(f"SELECT coalesce(b.k, u.k) AS k, CASE WHEN u.k IS NULL THEN b.v ELSE u.u END AS v FROM {_C} b FULL JOIN {_LAST} u ON b.k = u.k")
def store_delta(spark: SparkSession, d: str) -> DataFrame:
    """A version that holds its updates alone, merged when it is read."""
    store = Store(spark, _place(spark))
    store.save(_customers(spark, d), "9")
    store.save_delta(_finished(spark, d).withColumnRenamed("u", "v"), "10", "9", order_by="ord")
    return store.load().to_df()


@_query(f"SELECT b.k, b.v - u.v AS v FROM {_O} b JOIN {_QUANTITY} u ON b.k = u.k")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Tables in equal buckets, joined without a shuffle."""
    tables = []
    for name, table in (("orders", _orders(spark, d)), ("quantities", _quantities(spark, d))):
        save_bucketed(table, f"keyloom_{name}", _place(spark))
        tables.append(load_bucketed(spark, f"keyloom_{name}", "k", table.num_partitions))
    return tables[0].inner_join(tables[1], lambda k, v, u: v - u, name="v").to_df()


def _codec(name: str, codec: K.KeyCodec, logical: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.read.parquet(f"{d}/orders.parquet").select(codec.encode(logical(F.col("o_orderkey"))).alias("k"), F.col("o_totalprice").alias("v"))
        return KeyedFrame.from_df(rows, "k", n=_n(spark, d)).map_values(lambda k, v: v, with_key=True).to_df().select(codec.decode(F.col("k")).alias("k"), "v")

    run.__name__ = name
    _query(sql)(run)


_codec("key_long", K.WholeNumber(), lambda k: k - 500, "SELECT o_orderkey - 500 AS k, o_totalprice AS v FROM orders")
_codec("key_int", K.WholeNumber("int"), lambda k: (k - 500).cast("int"), "SELECT CAST(o_orderkey - 500 AS INTEGER) AS k, o_totalprice AS v FROM orders")
_codec("key_short", K.WholeNumber("smallint"), lambda k: (k - 15000).cast("smallint"), "SELECT CAST(o_orderkey - 15000 AS SMALLINT) AS k, o_totalprice AS v FROM orders")
_codec("key_big_integer", K.BigInteger(), lambda k: F.concat(F.lit("+00123456789012345678901234567890123456789"), k.cast("string")), "SELECT '123456789012345678901234567890123456789' || o_orderkey AS k, o_totalprice AS v FROM orders")
_codec("key_uuid", K.Uuid(), lambda k: F.concat(F.lit("0A0B0C0D-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0")), "SELECT '0a0b0c0d-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_totalprice AS v FROM orders")
_codec("key_text", K.Text(), lambda k: F.concat(F.lit("é"), k.cast("string")), "SELECT 'é' || o_orderkey AS k, o_totalprice AS v FROM orders")


@_query("SELECT chr(65 + n_nationkey) AS k, n_regionkey AS v FROM nation")
def key_char(spark: SparkSession, d: str) -> DataFrame:
    codec = K.Character()
    rows = spark.read.parquet(f"{d}/nation.parquet").select(codec.encode(F.char(65 + F.col("n_nationkey"))).alias("k"), F.col("n_regionkey").alias("v"))
    return KeyedFrame.from_df(rows, "k", n=N).to_df().select(codec.decode(F.col("k")).alias("k"), "v")


@_query("SELECT l_orderkey AS k1, CAST(l_linenumber AS VARCHAR) AS k2, sum(l_quantity) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber")
def key_pair(spark: SparkSession, d: str) -> DataFrame:
    codec = K.Pair(K.WholeNumber(), K.Text())
    pair = F.struct(F.col("l_orderkey").alias("_1"), F.col("l_linenumber").cast("string").alias("_2"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(codec.encode(pair).alias("k"), F.col("l_quantity").alias("v"))
    table = KeyedFrame.from_df(rows, "k", n=_n(spark, d), merge=SUM).to_df().withColumn("k", codec.decode(F.col("k")))
    return table.select(F.col("k._1").alias("k1"), F.col("k._2").alias("k2"), "v")


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): f for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name.rstrip("_"): sql for name, sql in _SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Build, put, join with the version before, filter."""
    first = _orders(spark, d)
    second = first.put(1234, 10873.0).delete([998, 999])
    return first.inner_join(second, lambda k, a, b: b, name="v").filter(lambda k, v: v != 0).to_df()
