"""Key codecs: round trips, injectivity and freedom from prefixes."""

import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import keys as K

few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
text = st.text(st.characters(exclude_categories=("Cs",)), max_size=8)


def both(spark, codec, kind, values):
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").select("x", codec.encode(F.col("x")).alias("e"))
    rows = df.select("x", "e", codec.decode(F.col("e")).alias("d")).collect()
    assert all(r.d == r.x for r in rows)
    coded = [bytes(r.e) if not isinstance(r.e, str) else r.e.encode() for r in rows]
    assert len(set(coded)) == len(values)
    return coded


def no_prefix(coded):
    coded = sorted(coded)
    assert not any(b.startswith(a) for a, b in zip(coded, coded[1:], strict=False))


@few
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=30, max_size=40))
def test_long(spark, values):
    coded = both(spark, K.WholeNumber(), "long", [*values, 0, -1, 2**63 - 1, -(2**63)])
    assert {len(c) for c in coded} == {8}
    assert (5).to_bytes(8, "big") in both(spark, K.WholeNumber(), "long", [5])


@few
@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=30, max_size=40))
def test_int_and_short(spark, values):
    both(spark, K.WholeNumber("int"), "int", [*values, 0, -1])
    both(spark, K.WholeNumber("smallint"), "smallint", [v >> 16 for v in values])


@few
@given(st.lists(text, min_size=30, max_size=40))
def test_text(spark, values):
    no_prefix(both(spark, K.Text(), "string", [*values, "", "a", "ab", "abc"]))


@few
@given(st.lists(st.tuples(text, st.integers(-(2**63), 2**63 - 1)), min_size=20, max_size=30))
def test_pair(spark, values):
    no_prefix(both(spark, K.Pair(K.Text(), K.WholeNumber()), "struct<_1: string, _2: bigint>", values))


def test_nested_pair(spark):
    codec = K.Pair(K.Pair(K.WholeNumber("int"), K.Text()), K.Text())
    no_prefix(both(spark, codec, "struct<_1: struct<_1: int, _2: string>, _2: string>", [((1, "a"), "b"), ((1, ""), "ab"), ((1, "ab"), "")]))


def test_logical(spark):
    one = lambda codec, x: spark.range(1).select(codec.encode(F.lit(x))).first()[0]
    assert [one(K.BigInteger(), x) for x in ("+007", "-0", "-12", "9" * 60)] == ["7", "0", "-12", "9" * 60]
    value = uuid.uuid4()
    assert one(K.Uuid(), str(value).upper()) == str(value)
    assert one(K.Character(), "é") == "é"
    for codec, bad in ((K.BigInteger(), "1.5"), (K.Uuid(), "abc"), (K.Character(), "ab")):
        with pytest.raises(Exception, match="not a"):
            one(codec, bad)
