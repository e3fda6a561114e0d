"""Operators on small tables, with duplicates, nulls and absent keys."""

import pytest
from pyspark.sql import functions as F

from keyloom import MAX, MIN, OVERWRITE, SUM, KeyedFrame, PandasFold, Reducer, fold


def table(spark, rows, n=3):
    return KeyedFrame.from_df(spark.createDataFrame(rows, "k long, v int"), "k", n=n)


def as_dict(t):
    return {r[0]: r[1] for r in t.to_df().collect()}


@pytest.fixture(scope="module")
def pairs(spark):
    return table(spark, [(i, i) for i in range(101)], 5)


@pytest.fixture(scope="module")
def evens(pairs):
    return pairs.filter(lambda k, v: v % 2 == 0)


def zero(x):
    return F.coalesce(x, F.lit(0))


def test_reads(pairs, evens):
    assert evens.multiget([-1, 0, 1, 98, 98]) == {0: 0, 98: 98}
    assert evens.get(97) is None and evens.get(4) == 4 and evens.contains(4) and not evens.contains(5)
    assert pairs.count() == 101 and evens.count() == 51 and pairs.multiget([]) == {}
    assert len(pairs.multiget(range(-2000, 2000))) == 101


def test_projections(pairs):
    assert as_dict(pairs.map_values(lambda v: -v))[7] == -7
    assert as_dict(pairs.map_values(lambda k, v: k + v, with_key=True))[7] == 14
    assert pairs.filter(F.col("k") < 3).count() == 3


def test_diff(spark, pairs):
    flipped = pairs.map_values(lambda v: F.when(v % 2 == 0, -v).otherwise(v))
    changed = {i: i for i in range(2, 101, 2)}
    assert as_dict(pairs.diff(flipped)) == changed
    assert as_dict(pairs.diff(flipped.to_df())) == changed
    a, b = table(spark, [(i, 0) for i in range(24)], 3), table(spark, [(i, 1) for i in range(8, 16)], 2)
    assert as_dict(a.diff(b)) == {i: 0 for i in range(8, 16)}


def test_full_outer_join(spark):
    a, b = table(spark, [(i, i) for i in range(100)]), table(spark, [(i, i) for i in range(50, 200)])
    plus = lambda k, x, y: zero(x) + zero(y)
    want = {i: i + (i if 50 <= i < 100 else 0) for i in range(200)}
    for other in (b, b.to_df(), table(spark, [(i, i) for i in range(50, 200)], 7)):
        assert as_dict(a.full_outer_join(other, plus)) == want
    assert as_dict(a.full_outer_join(b, plus, lazy=True)) == want


def test_joins(spark):
    a = table(spark, [(i, 1) for i in range(10)], 2)
    b = spark.createDataFrame([(i, i) for i in range(0, 20, 2)] + [(0, 50)], "k long, u int")
    last = {"order_by": "u"}
    assert as_dict(a.inner_join(b, lambda k, x, y: x + y, **last)) == {0: 51, 2: 3, 4: 5, 6: 7, 8: 9}
    assert as_dict(a.left_join(b, lambda k, x, y: zero(y), **last)) == {i: (50 if i == 0 else i if i % 2 == 0 else 0) for i in range(10)}
    assert as_dict(a.update_join(b, lambda k, x, y: x + y, **last)) == {i: (51 if i == 0 else 1 + i if i % 2 == 0 else 1) for i in range(10)}


def test_index_aggregation(spark, pairs):
    rows = spark.createDataFrame([(i, 1) for i in range(101)] + [(i, 1) for i in range(0, 101, 2)], "k long, v int")
    assert {k: int(v) for k, v in as_dict(pairs.aggregate_using_index(rows, SUM)).items()} == {i: 1 + (i % 2 == 0) for i in range(101)}
    new = spark.createDataFrame([(0, 1), (-1, 1)], "k long, v int")
    assert {k: int(v) for k, v in as_dict(pairs.aggregate_using_index(new, SUM)).items()} == {0: 1, -1: 1}
    assert as_dict(pairs.create_using_index(new)) == {0: 1, -1: 1}


def test_writes(spark, evens):
    base = {i: i for i in range(0, 101, 2)}
    assert as_dict(evens.put(0, 1)) == base | {0: 1}
    assert as_dict(evens.put(-1, -1)) == base | {-1: -1}
    assert as_dict(evens.multiput({-1: -1, 0: 1, 1: 1})) == base | {-1: -1, 0: 1, 1: 1}
    assert as_dict(evens.multiput({-1: -1, 2: 1}, SUM)) == base | {-1: -1, 2: 3}
    spec = fold(lambda k, u: u * 10, lambda k, old, u: old + u)
    updates = spark.createDataFrame([(2, 1), (2, 5), (-1, 3), (-1, 4)], "k long, u int")
    want = base | {2: 8, -1: 34}
    assert as_dict(evens.multiput_df(updates, spec, order_by="u")) == want
    assert as_dict(evens.multiput_df(updates, PandasFold(lambda k, u: u * 10, lambda k, a, u: int(a) + u), order_by="u")) == want
    assert as_dict(evens.delete([0, -1])) == {k: v for k, v in base.items() if k}
    assert as_dict(evens.delete_df(updates.select("k"))) == {k: v for k, v in base.items() if k != 2}
    assert as_dict(evens) == base  # the version before


def test_nulls(spark):
    t = table(spark, [(1, None), (2, 2)])
    assert as_dict(t) == {1: None, 2: 2} and t.get(1) is None and not t.contains(1)
    spec = fold(lambda k, u: u * 10, lambda k, old, u: old + u)
    assert as_dict(t.multiput({1: 1, 2: 1}, spec)) == {1: 10, 2: 3}
    assert as_dict(t.put(2, None)) == {1: None, 2: None}
    other = table(spark, [(1, 5), (2, None)])
    assert as_dict(t.inner_join(other, lambda k, x, y: y)) == {1: 5}
    assert as_dict(t.update_join(other, lambda k, x, y: zero(x) + zero(y))) == {1: None, 2: 2}
    assert as_dict(t.full_outer_join(other, lambda k, x, y: zero(x) + zero(y))) == {1: 5, 2: 2}
    with pytest.raises(Exception, match="null in key column k"):
        table(spark, [(None, 1)]).count()
    with pytest.raises(TypeError):
        KeyedFrame.from_df(spark.createDataFrame([(1.0, 1)], "k double, v int"), "k")


def test_empty(spark):
    t = table(spark, [])
    assert t.count() == 0 and t.get(1) is None and as_dict(t.put(1, 1)) == {1: 1}
    assert as_dict(t.full_outer_join(table(spark, [(1, 2)]), lambda k, x, y: y)) == {1: 2}
    assert as_dict(table(spark, [(1, 2)]).inner_join(t, lambda k, x, y: y)) == {}


def test_composite_keys_and_values(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "y"), (1, "a", 3, "z")], "a long, b string, v int, w string")
    t = KeyedFrame.from_df(rows, ["a", "b"], n=3, order_by="v")
    assert t.multiget([(1, "a"), (1, "b"), (2, "a")]) == {(1, "a"): (3, "z"), (1, "b"): (2, "y")}
    assert t.put((2, "c"), (9, "q")).get((2, "c")) == (9, "q")
    assert t.delete([(1, "a")]).count() == 1
    t.assert_unique()


def test_layers(spark):
    plus = Reducer(lambda k, x, y: zero(x) + zero(y), associative=True)
    a, b, c, d = (table(spark, [(i, 10**j + i) for i in range(j, j + 6)]) for j in range(4))
    lazy = a.full_outer_join(b, plus, lazy=True).full_outer_join(c, plus, lazy=True).full_outer_join(d, plus, lazy=True)
    assert len(lazy.layers) == 4
    eager = a.full_outer_join(b, plus).full_outer_join(c, plus).full_outer_join(d, plus)
    right = a.full_outer_join(b.full_outer_join(c.full_outer_join(d, plus, lazy=True), plus, lazy=True), plus, lazy=True)
    want = as_dict(eager)
    assert as_dict(lazy) == want == as_dict(right) and len(right.layers) == 4
    assert lazy.count() == len(want) and lazy.multiget([3, 3, 99]) == {3: want[3]}
    assert as_dict(lazy.filter(lambda k, v: v > 1000)) == {k: v for k, v in want.items() if v > 1000}
    assert as_dict(lazy.reindex()) == want and as_dict(lazy.put(3, 0).delete([4])) == {k: (0 if k == 3 else v) for k, v in want.items() if k != 4}
    minus = lambda k, x, y: zero(x) - zero(y)  # noqa: E731  not associative: a stack on the right stays one layer
    nested = a.full_outer_join(b.full_outer_join(c, minus, lazy=True), minus, lazy=True)
    assert len(nested.layers) == 2 and as_dict(nested) == as_dict(a.full_outer_join(b.full_outer_join(c, minus), minus))


def test_persistence(spark):
    t = table(spark, [(i, i) for i in range(50)]).cache()
    assert t.get(7) == 7 and t.set_name("seven").name == "seven" and spark.table("seven").count() == 50
    many = t
    for i in range(6):
        many = many.put(i, -i)
    packed = many.compact()
    assert as_dict(packed) == as_dict(many) and packed.num_partitions == 3 and t.reindex() is t
    packed.unpersist()
    t.unpersist()


def test_named_update_joins(spark):
    a = table(spark, [(1, 1), (2, None), (3, 3)])
    rows = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1), (4, 5, 1), (3, None, 1)], "k long, u int, ord int")
    updates = rows.select("k", "u")
    assert as_dict(a.update_join(updates, SUM)) == {1: 13, 2: None, 3: 3}
    assert as_dict(a.update_join(updates, MIN)) == {1: 1, 2: None, 3: 3} and as_dict(a.update_join(updates, MAX)) == {1: 7, 2: None, 3: 3}
    last = a.update_join(rows.select("k", F.struct("u", "ord").alias("s")).select("k", F.col("s.u").alias("v"), F.col("s.ord").alias("ord")), OVERWRITE, order_by="ord")
    assert as_dict(last) == {1: 7, 2: None, 3: None}


def test_lazy_tables_as_operands(spark):
    plus = Reducer(lambda k, x, y: zero(x) + zero(y), associative=True)
    a, b = table(spark, [(i, i) for i in range(6)]), table(spark, [(i, 10 * i) for i in range(3, 9)], 4)
    lazy = table(spark, [(i, 1) for i in range(2, 5)]).full_outer_join(b, plus, lazy=True)
    eager = lazy.merged()
    assert as_dict(eager) == {2: 1, 3: 31, 4: 41, 5: 50, 6: 60, 7: 70, 8: 80}
    for f in (
        lambda o: a.inner_join(o, lambda k, x, y: x + y), lambda o: a.left_join(o, lambda k, x, y: zero(y)), lambda o: a.update_join(o, lambda k, x, y: x - y), lambda o: a.update_join(o, SUM),
        lambda o: a.diff(o), lambda o: a.multiput_df(o), lambda o: a.multiput_df(o, SUM), lambda o: a.delete_df(o), lambda o: a.full_outer_join(o, plus), lambda o: a.create_using_index(o), lambda o: a.aggregate_using_index(o, SUM),
    ):
        assert as_dict(f(lazy)) == as_dict(f(eager))
    assert as_dict(lazy.inner_join(lazy, lambda k, x, y: x - y)) == {k: 0 for k in range(2, 9)}
    other = KeyedFrame.from_df(spark.createDataFrame([(1, 1)], "q long, v int"), "q", n=3)
    with pytest.raises(ValueError, match="key columns differ"):
        a.full_outer_join(other, plus, lazy=True)


def test_python_folds_keep_values(spark):
    """NaN is a value, and whole numbers stay exact."""
    nan = float("nan")
    t = KeyedFrame.from_df(spark.createDataFrame([(1, nan), (2, None)], "k long, v double"), "k", n=2)
    spec, plain = PandasFold(lambda k, u: u, lambda k, a, u: a + u), fold(None, lambda k, a, u: a + u)
    for how in (spec, plain):
        got = as_dict(t.multiput({1: 5.0, 2: 5.0}, how))
        assert got[1] != got[1] and got[2] == 5.0
    big = KeyedFrame.from_df(spark.createDataFrame([(1, 2**60 + 1)], "k long, v long"), "k", n=2)
    assert as_dict(big.multiput({1: 1, 2: 2}, spec)) == {1: 2**60 + 2, 2: 2}
    assert as_dict(big.multiput({1: None}, PandasFold(lambda k, u: u, lambda k, a, u: a if u is None else u))) == {1: 2**60 + 1}
