"""Streams of updates into a keyed table: each micro-batch is one multiput, and one version of a Store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.merge import OVERWRITE, Algebraic, Merge, OrderBy, Overwrite
from ..operators.frame import KeyedFrame
from ..sources.storage import Store


def upsert_stream(updates: DataFrame, store: Store, keys: str | list[str], n: int, merge: Merge = OVERWRITE, order_by: OrderBy = None, every: int = 16) -> DataStreamWriter:
    """A stream writer (start it with a checkpoint location).  Version names are zero-padded batch
    numbers.  A batch that was written before a restart is not written again, so updates count once; one
    that was broken off is.

    With a named merge a batch writes its own updates alone, as a delta, and every so many versions a full one; with
    a fold, which needs the old values, each version is full."""

    def write(batch: DataFrame, number: int) -> None:
        name, there = f"{number:012d}", store.versions()
        if name in there:
            return
        before = [v for v in there if v < name]
        if not before:
            store.save(KeyedFrame.from_df(batch, keys, n=n, merge=merge, order_by=order_by), name)
        elif isinstance(merge, Overwrite | Algebraic) and len(store.chain(before[-1])) < every:
            store.save_delta(batch, name, before[-1], merge, order_by)
        else:
            store.save(store.load(before[-1]).multiput_df(batch, merge, order_by), name)

    return updates.writeStream.foreachBatch(write)
