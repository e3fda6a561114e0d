"""Lazy full outer merges: a stack of tables that is merged when it is read.

Chains with the same reducer flatten into one stack, so any number of layers is merged by one union and one
aggregation.  A stack on the right flattens only if the reducer is declared associative; else it
is merged first.  Reads, writes and filters give what the eager join would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame

from .frame import KeyedFrame, merge_sides


class Reducer:
    """f(key, left or null, right or null); associative: stacks on the right may be flattened."""

    def __init__(self, f: Callable[[Column, Column, Column], Column], associative: bool = False):
        self.f, self.associative = f, associative

    def __call__(self, key: Column, left: Column, right: Column) -> Column:
        return self.f(key, left, right)


class LayeredFrame:
    def __init__(self, layers: list[KeyedFrame], reducer: Callable[[Column, Column, Column], Column]):
        self.layers, self.reducer = layers, reducer

    @classmethod
    def of(cls, left: KeyedFrame | LayeredFrame, right: KeyedFrame | LayeredFrame, f: Callable[[Column, Column, Column], Column]) -> LayeredFrame:
        same = lambda x: isinstance(x, LayeredFrame) and x.reducer is f
        first = left.layers if same(left) else [left.compact(cache=False) if isinstance(left, LayeredFrame) else left]
        second = right.layers if same(right) and getattr(f, "associative", False) else [right.compact(cache=False) if isinstance(right, LayeredFrame) else right]
        head = first[0]
        if differ := {t.keys for t in (*first, *second)} - {head.keys}:
            raise ValueError(f"key columns differ: {head.keys} and {sorted(differ)[0]}")
        kinds = {tuple(t._packed().schema["__v"].dataType.simpleString() for t in [x])[0] for x in (*first, *second)}
        if len(kinds) > 1:
            raise ValueError(f"layers need values of one type, not {sorted(kinds)}")
        aligned = [t if t.num_partitions == head.num_partitions else KeyedFrame(t.to_df().repartition(head.num_partitions, *t.keys), t.keys, t.values, head.num_partitions) for t in (*first, *second)]
        return cls(aligned, f)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.layers[0].keys

    def merged(self) -> KeyedFrame:
        """The merged table, not computed yet."""
        head = self.layers[0]
        if len(self.layers) == 1:
            return head
        name = head.values[0] if len(head.values) == 1 else "value"
        return head._like(merge_sides([t._packed() for t in self.layers], head.keys, self.reducer, head.key, name), [name])

    def full_outer_join(self, other: KeyedFrame | LayeredFrame | DataFrame, f: Callable[[Column, Column, Column], Column], lazy: bool = False, **how: Any):
        if lazy and isinstance(other, KeyedFrame | LayeredFrame):
            return LayeredFrame.of(self, other, f)
        return self.merged().full_outer_join(other, f, **how)

    def compact(self, cache: bool = True) -> KeyedFrame:
        """One table instead of the stack."""
        merged = self.merged()
        return merged.persist() if cache else merged

    reindex = compact

    def to_df(self) -> DataFrame:
        return self.merged().to_df()

    def count(self) -> int:
        return self.merged().count()

    def lookup(self, keys: Iterable[Any] | DataFrame) -> DataFrame:
        """Key predicates are pushed through the merge into every layer."""
        return self.merged().lookup(keys)

    def __getattr__(self, name: str) -> Any:
        """Everything else is the merged table's."""
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.merged(), name)
