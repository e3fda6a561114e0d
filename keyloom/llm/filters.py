"""A bounded filter for a set of keys: what fails it is surely not in the set.

A Bloom filter of BITS bits, whatever the number of keys.  It is built by one aggregation, read on
the driver (BITS / 64 numbers at most) and sent to the tasks that scan the corpus, so that they only emit rows
that may be asked for; an exact join follows.  With more keys than it has bits for it lets more through, and
the join does the rest: results never depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24

_U = np.uint64
#: The constants of 64-bit XXH.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _hash(*columns: np.ndarray) -> np.ndarray:
    """As Spark's xxhash64 of long columns without nulls."""
    h = np.full(len(columns[0]), 42, _U)
    for c in columns:
        h = h + _P5 + _U(8)
        h ^= _turn(np.asarray(c, np.int64).view(_U) * _P2, 31) * _P1
        h = _turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        h ^= h >> _U(32)
    return h


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, *columns: str) -> Filter:
        """Of the rows of long columns; repeated rows and nulls do no harm."""
        h = F.xxhash64(*(F.col(c).cast("long") for c in columns))
        places: list[Column] = [h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(BITS - 1)]
        bits = keys.select(F.explode(F.array(*places)).alias("p"))
        rows = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
        words = np.zeros(BITS // 64, _U)
        words[np.asarray(rows["w"])] = np.asarray(rows["b"]).view(_U)
        return cls(words)

    def may_have(self, *columns: np.ndarray) -> np.ndarray:
        h = _hash(*columns)
        found = np.ones(len(h), bool)
        for p in (h & _U(BITS - 1), (h >> _U(32)) & _U(BITS - 1)):
            found &= (self.words[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) != 0
        return found
