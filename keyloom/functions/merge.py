"""What happens when several values meet at one key.

A merge says how the updates of a key fold into its old value: `project(key, update)` where there is no
value yet (or a null one), `merge(key, old, update)` after that.  The named merges are plain
aggregates, of which partial results are shuffled; `Fold` takes any functions of columns and `PandasFold` any
Python functions, and both fold a key's updates in order, gathered in one row or task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OrderBy = str | Column | Sequence[str | Column] | None


def ordering(order_by: OrderBy) -> Column:
    """One column, a struct, to order a key's updates by; without order_by, 0: any order will do."""
    if order_by is None:
        return F.lit(0)
    parts = [order_by] if isinstance(order_by, str | Column) else list(order_by)
    return F.struct(*(F.col(f"`{p}`") if isinstance(p, str) else p for p in parts))


@dataclass(frozen=True)
class Overwrite:
    """The last update by order_by wins, a null as well as any other."""


@dataclass(frozen=True)
class Algebraic:
    """sum, min or max of the old value and all updates; nulls count as absent."""

    name: str

    def aggregate(self, value: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.name](value)

    def pair(self, old: Column, update: Column) -> Column:
        """Of two values."""
        if self.name == "sum":
            return F.when(update.isNull(), old).otherwise(old + update)
        return {"min": F.least, "max": F.greatest}[self.name](old, update)


@dataclass(frozen=True)
class Fold:
    """Ordered left fold with functions of columns, which stay in the optimizer."""

    project: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class PandasFold:
    """Ordered left fold with Python functions of values (None where null), for logic that columns cannot express."""

    project: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any, Any], Any]


Merge = Overwrite | Algebraic | Fold | PandasFold

OVERWRITE, SUM, MIN, MAX = Overwrite(), Algebraic("sum"), Algebraic("min"), Algebraic("max")


def fold(project: Callable[[Column, Column], Column] | None, merge: Callable[[Column, Column, Column], Column]) -> Fold:
    return Fold(project or (lambda k, u: u), merge)


def run_fold(spec: Fold, key: Column, items: Column, kind: str) -> Column:
    """items: array of structs (src, ord, v, u), sorted; src 0 is the old value v, others are updates u."""

    def step(acc: Column, x: Column) -> Column:
        update = F.when(acc.isNull(), spec.project(key, x["u"])).otherwise(spec.merge(key, acc, x["u"]))
        return F.when(x["src"] == 0, x["v"]).otherwise(update).cast(kind)

    return F.aggregate(items, F.lit(None).cast(kind), step)
