"""Key types: which columns may be keys, and codecs between logical keys and Spark columns.

A key is one column or several (a composite key).  Spark hashes and compares typed columns, so a
codec is only needed for logical types that Spark lacks (arbitrary big integers, UUIDs, single characters) or
where a key has to become bytes.  Every codec is injective, and no encoding is a prefix of
another of the same codec.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATOMIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


class KeyCodec(Protocol):
    """encode: logical column to the column that is stored as key; decode: back."""

    def encode(self, key: Column) -> Column: ...
    def decode(self, key: Column) -> Column: ...


class WholeNumber:
    """Long, Int and Short keys as big-endian two's complement bytes of a fixed width."""

    def __init__(self, kind: str = "bigint"):
        self.kind, self.width = kind, {"bigint": 8, "int": 4, "smallint": 2}[kind]

    def encode(self, key: Column) -> Column:
        return F.unhex(F.right(F.lpad(F.hex(key.cast("bigint")), 16, "0"), F.lit(2 * self.width)))

    def decode(self, key: Column) -> Column:
        sign = F.when(F.hex(key).rlike("^[89A-F]"), "F" * (16 - 2 * self.width)).otherwise("0" * (16 - 2 * self.width))
        return F.conv(F.concat(sign, F.hex(key)), 16, -10).cast("bigint").cast(self.kind)


class Character:
    """Keys of a single character; any other string is an error."""

    def encode(self, key: Column) -> Column:
        return F.when(key.isNull() | (F.char_length(key) == 1), key).otherwise(F.raise_error(F.concat(F.lit("not a single character: "), key)).cast("string"))

    def decode(self, key: Column) -> Column:
        return key


class BigInteger:
    """Whole numbers of any size, given as decimal strings, in their canonical form."""

    def encode(self, key: Column) -> Column:
        text = F.trim(key.cast("string"))
        digits = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]+)$", 1), "^0+(?=.)", "")
        bad = F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("string")
        return F.when(text.isNull(), None).when(digits == "", bad).when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)

    def decode(self, key: Column) -> Column:
        return key


class Uuid:
    """UUIDs by value: 36 lower-case characters."""

    def encode(self, key: Column) -> Column:
        text = F.lower(F.trim(key))
        return F.when(text.isNull() | text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), text)).cast("string"))

    def decode(self, key: Column) -> Column:
        return key


class Text:
    """Strings as bytes: four bytes of length, then UTF-8."""

    def encode(self, key: Column) -> Column:
        raw = F.encode(key, "UTF-8")
        return F.concat(WholeNumber("int").encode(F.octet_length(raw)), raw)

    def decode(self, key: Column) -> Column:
        return F.decode(F.substring(key, 5, 2**31 - 1), "UTF-8")


class Pair:
    """A struct of two keys as bytes: four bytes of the first one's length, the first, the second.  Nests."""

    def __init__(self, first: KeyCodec, second: KeyCodec):
        self.first, self.second = first, second

    def encode(self, key: Column) -> Column:
        a = self.first.encode(key.getField("_1"))
        return F.concat(WholeNumber("int").encode(F.octet_length(a)), a, self.second.encode(key.getField("_2")))

    def decode(self, key: Column) -> Column:
        size = WholeNumber("int").decode(F.substring(key, 1, 4))
        rest = F.substring(key, 5, 2**31 - 1)
        return F.struct(self.first.decode(rest.substr(F.lit(1), size)).alias("_1"), self.second.decode(rest.substr(size + 1, F.octet_length(rest))).alias("_2"))


def check_type(kind: T.DataType, name: str) -> None:
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            check_type(field.dataType, f"{name}.{field.name}")
    elif not isinstance(kind, _ATOMIC):
        raise TypeError(f"column {name} of type {kind.simpleString()} cannot be a key")


def check_keys(df: DataFrame, keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("a keyed table needs at least one key column")
    for k in keys:
        if k not in df.columns:
            raise ValueError(f"no key column {k!r} among {df.columns}")
        check_type(df.schema[k].dataType, k)


def reject_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, which fails at run time if a key is null.  A predicate, so filters on keys are still pushed below it."""
    nullable = [k for k in keys if df.schema[k].nullable]
    for k in nullable:
        df = df.where(F.when(F.col(f"`{k}`").isNull(), F.raise_error(F.lit(f"null in key column {k}")).cast("boolean")).otherwise(F.lit(True)))
    return df
