"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing.  Pieces are dealt evenly at random, so every task has the same mixture of lengths, also where the input
is sorted.  A task packs its pieces best-fit, longest first (in the fullest bin that has room).  Nearly full bins are done;
underfull ones go on as items, each with the pieces that it holds, to a tree of merging tasks, FAN_IN to one, that pack
them best-fit in the same way, until one task is left or no two of them fit together.

What goes on is bounded without loss.  Two bins can only be joined if one of them is at most half full (small), and
best fit leaves a task one such bin at most.  So after a round of T tasks at most T joins can still be made, each by a small
bin, and of the bins of one fill, which are interchangeable, no more than there are small bins anywhere can be of use, and none
that has less room than the emptiest bin of all needs.  All others are done as they are.  A task takes in FAN_IN tasks' bins at most,
or as many as CHUNK if that is more tasks; its memory is a few numbers for each bin and piece.

Each round is written to the checkpoint folder before its bins are used: whether a bin is done
or goes on is decided once, also when executors are lost.

Defined results: a null or empty text is one piece, the end token alone.  A document of more
than `capacity` tokens is cut; its first piece is the shorter one.  Very long texts are tokenised whole, in memory one at a
time.  Repeated rows and equal lengths are packed like any others; an empty table gives no sequences.  Sequence ids are unique and otherwise
arbitrary.  Other columns of items go along; columns named sequence_id or offset are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, kinds, read
from .words import lean

CAPACITY, END = 1024, 2
#: Free tokens of a nearly full bin; tasks that one merges; bins for which a merging task is added.
SLACK, FAN_IN, CHUNK = 2, 8, 400_000

_HARD = r"\S{400}|\s{400}|<\|"


class ByteBpe:
    """Ids as by the tokenizers library's byte-level BPE.  tiktoken, which has the same vocabulary
    as ranks and the same pattern, is several times faster; texts with special tokens' strings or
    very long runs, on which it is slow, go through the library itself."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return next(self.all(pa.array([text])))

    def all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null as empty."""
        hard = pc.match_substring_regex(texts, _HARD).fill_null(False).to_pylist()
        for text, by_library in zip(texts, hard, strict=True):
            text = text.as_py() or ""
            if self.fast is None or by_library:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                yield np.array(self.fast.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, path: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(path, ranks)
        for batch in it:
            row, out = [], []
            for i, ids in enumerate(coder.all(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k in range(len(at) - 1):
                    row.append(i)
                    out.append((k, at[k], at[k + 1] - at[k], zlib.crc32(ids[at[k] : at[k + 1]].tobytes())))
            table = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, k]) for k in (1, 2, 3))], names=[doc_id, "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[f"`{doc_id}`"], docs[f"`{text}`"].alias("__text")).mapInArrow(lean(batches), f"{kinds(docs, doc_id)} piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, longest first.  (bin of each item, fill of each bin); ties keep the given order."""
    where, rest, mask = np.empty(len(sizes), np.int64), [], 0
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_rest[room].pop()
            if not by_rest[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(rest)
            rest.append(capacity)
        where[i] = b
        rest[b] = room = room - size
        if room:
            if not by_rest[room]:
                mask |= 1 << room
            by_rest[room].append(b)
    return where, capacity - np.array(rest, np.int64)


class _Bins:
    """Bins as a list array of pieces, with the fill of each and the length of each piece."""

    def __init__(self, parts: pa.StructArray, at: np.ndarray, used: np.ndarray, size: np.ndarray):
        self.parts, self.at, self.used, self.size = parts, at, used, size

    def together(self, order: np.ndarray, groups: np.ndarray, used: np.ndarray) -> _Bins:
        """New bins: the pieces of bins order[groups[k]:groups[k + 1]] together."""
        many = np.diff(self.at)[order]
        to = np.concatenate([[0], np.cumsum(many)])
        rows = np.repeat(self.at[:-1][order] - to[:-1], many) + np.arange(to[-1])
        return _Bins(self.parts.take(pa.array(rows)), to[groups], used, self.size[rows])

    def offsets(self) -> np.ndarray:
        """The place of each piece in its bin."""
        before = np.cumsum(self.size) - self.size
        return before - np.repeat(before[self.at[:-1]], np.diff(self.at)) if len(before) else before


def _join(bins: list[_Bins]) -> _Bins:
    parts = pa.chunked_array([b.parts for b in bins]).combine_chunks()
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.at) for b in bins]))])
    return _Bins(parts, at, *(np.concatenate(c) for c in zip(*((b.used, b.size) for b in bins), strict=True)))


def _round(capacity: int, number: int, length: str, slack: int):
    """One task of a round: bins in, bins out; level counts a task's bins of one fill from 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, given = TaskContext.get().partitionId(), []
        for batch in it:
            parts = batch.column("parts")
            at = np.asarray(parts.offsets).astype(np.int64)
            inside = parts.values.slice(at[0], at[-1] - at[0])
            given.append(_Bins(inside, at - at[0], np.asarray(batch.column("used")).astype(np.int64), np.asarray(inside.field(length)).astype(np.int64)))
        if not given:
            return
        bins = _join(given)
        del given
        where, used = best_fit(bins.used, capacity)
        order = np.argsort(where, kind="stable")
        bins = bins.together(order, np.searchsorted(where[order], np.arange(len(used) + 1)), used)
        by = np.argsort(used, kind="stable")
        level = np.empty(len(used), np.int64)
        level[by] = np.arange(len(by)) - np.searchsorted(used[by], used[by])
        ids = (number << 58) + (task << 32) + np.arange(len(used))
        at, offset = pa.array(bins.at, pa.int32()), pa.array(bins.offsets())
        columns = {"bin": pa.array(ids), "used": pa.array(used), "level": pa.array(level), "done": pa.array(used >= capacity - slack), "parts": pa.ListArray.from_arrays(at, bins.parts), "places": pa.ListArray.from_arrays(at, offset)}
        table = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        for lo in range(0, len(used), 10_000):
            yield table.slice(lo, 10_000)

    return batches


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", slack: int = SLACK, fan_in: int = FAN_IN, chunk: int = CHUNK) -> DataFrame:
    """The rows of items (lengths from 1 to capacity) plus sequence_id and offset, the place of
    the row in its sequence.  Columns of these names are replaced."""
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    tasks, number = max(1, items.rdd.getNumPartitions()), 0
    bins = items.select(F.col(f"`{length}`").cast("long").alias("used"), F.array(F.struct(*(F.col(f"`{c}`") for c in own))).alias("parts")).repartition(tasks)
    schema = f"bin long, used long, level long, done boolean, parts {bins.schema['parts'].dataType.simpleString()}, places array<long>"
    finished: list[DataFrame] = []
    before = (tasks + 1, 0)
    while True:
        bins = cut(bins.mapInArrow(_round(capacity, number, length, slack), schema))
        least, small = bins.where("not done").agg(F.min("used"), F.count_if(F.col("used") * 2 <= capacity)).first()
        may = ~F.col("done") & (F.col("used") + F.lit(least) <= capacity) & (F.col("level") < small)
        stuck = tasks == 1 or (tasks >= before[0] and small >= before[1])
        count = bins.where(may).count() if small and not stuck else 0
        if count < 2:
            finished.append(bins)
            break
        finished.append(bins.where(~may))
        before, tasks, number = (tasks, small), max(-(-tasks // fan_in), -(-count // chunk)), number + 1
        bins = bins.where(may).select("used", "parts").repartition(tasks)
    packed = reduce(DataFrame.union, finished).select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip(F.col("parts").alias("p"), F.col("places").alias("o"))).alias("x"))
    return packed.select(*(F.col("x.p")[c].alias(c) for c in own), "sequence_id", F.col("x.o").alias("offset"))


def query(spark: SparkSession, sf_dir: str, path: str | None = None, ranks: str | None = None) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), path, ranks)


def pack_documents(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(pieces(docs, path, ranks))
