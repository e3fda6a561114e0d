"""Near-duplicate documents by ProbMinHash.

A document is the set of its runs of SHINGLE words; each weighs 1, however often it occurs, as in the similarity that is verified.
Every shingle is a Poisson process with its weight as rate, whose points fall into REGISTERS registers; a
register keeps the shingle of its earliest point, and a shingle is given up at the first point
later than all registers' (early termination).  Two documents agree in a register with their
probability Jaccard similarity, which at equal weights is the Jaccard similarity of the sets.  Registers are banded; documents that agree in a band are
candidates, and are verified by the exact Jaccard similarity of their shingle sets.

Exact copies (equal word sequences) are one class from the start, and only its least document goes on.  A
band's bucket is never expanded into rows of pairs.  First its members meet its most central member, the one
that shares most buckets with others over all bands.  Then the buckets whose members are still in different
components are settled exactly: the members of a bucket's largest component, and the others, are dealt into blocks of bounded
size; the former's blocks meet those of the others, the latter's each other as well, each two in
one task, and there every two members of different components that a prefix filter (exact: it loses no similar pair) cannot
part are verified.  A task gives back one link for each join of components.  So no pair that shares a
bucket is lost, and rows are in proportion to the band table, times the blocks of those outside the largest component.

Groups are the connected components of all verified links.  Defined results: a null text, or one
without words, is alone.  A text of fewer than SHINGLE words is one shingle; very long texts are used whole, one at a time.  The least doc_id stands
for its group; rows with a null doc_id are alone.  Rows that repeat a doc_id count as one document, and stay or go together.
An empty table gives an empty one.  Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .filters import Filter
from .graph import components
from .tables import cut, drop, read, unused

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
REGISTERS = BANDS * ROWS
#: Shingles of a block of members that meet in one task, and those that a member counts for besides its own.
BLOCK, EACH = 1 << 19, 256
_SEQUENCE = 0xA24BAED4963EE407


def shingles(word: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their counts, offsets of the texts): texts in order, hashes in order."""
    run, first = W.windows(word, at, size)
    owner = W.owners(at)[first]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < size))
    if len(short):
        alone = []
        for t in short:  # at most size - 1 words each
            total = np.zeros(1, np.uint64)
            for w in word[at[t] : at[t + 1]]:
                total = W.mix(total * np.uint64(_SEQUENCE) + w)
            alone.append(total)
        run, owner = np.concatenate([run, *alone]), np.concatenate([owner, short])
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])])) if len(run) else np.zeros(0, np.int64)
    return run[head], np.diff(np.concatenate([head, [len(run)]])), np.searchsorted(owner[head], np.arange(len(at)))


def signatures(element: np.ndarray, weight: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signature of each weighted set: the element that each of m registers keeps."""
    n = len(at) - 1
    when, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    live, owner, rate = np.arange(len(element)), W.owners(at), weight.astype(float)
    clock = np.zeros(len(element))
    seed = W.mix(element ^ np.uint64(0x5851F42D4C957F2D))
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(live):
        seed = seed + step
        draw = W.mix(seed)
        clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[live]
        latest = when.reshape(n, m).max(1)
        early = clock < latest[owner[live]]
        live, clock, seed, draw = live[early], clock[early], seed[early], draw[early]
        slot = owner[live] * m + ((W.mix(draw ^ step) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(when, slot, clock)
        first = when[slot] == clock
        who[slot[first]] = element[live[first]]
    return who.reshape(n, m)


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = W.mix(key * np.uint64(_SEQUENCE) + signature[:, r : bands * rows : rows])
    return key.view(np.int64)


def _digests(word: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for base in (_SEQUENCE, 0x9FB21C651E98DF25):
        power = W.powers(base, len(word) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:-1], dtype=np.uint64)])
        back = W.powers(pow(base, -1, 2**64), len(word) + 1)
        out.append(W.mix((total[at[1:]] - total[at[:-1]]) * back[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out


def sketch(docs: DataFrame, doc_id: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, x and y (a 128-bit digest of the words), n (distinct shingles; 0: no words), bands."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = W.strings(batch.column(1))
            for lo, hi in W.slices(column):
                word, at = W.words(column.slice(lo, hi - lo))
                element, _, to = shingles(word, at)
                keys = _bands(signatures(element, np.ones(len(element)), to, bands * rows), bands, rows)
                x, y = _digests(word, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(x), pa.array(y), pa.array(np.diff(to)), lists], names=["id", "x", "y", "n", "bands"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(W.lean(batches), "id long, x long, y long, n long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, s: the distinct shingles of the documents in ids, by 64-bit hash.  Texts are not shuffled: each
    task makes the sets of the documents that pass a filter of ids, and an exact semi-join follows."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(ids, "id").words)  # of fixed size

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Filter(shared.value)
        for batch in it:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(wanted.may_have(np.asarray(batch.column(0)))))
            column = W.strings(batch.column(1))
            for lo, hi in W.slices(column):
                element, _, at = shingles(*W.words(column.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(element.view(np.int64)))], names=["id", "s"])

    made = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(W.lean(batches), "id long, s array<long>")
    return made.join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("s_u")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("s").alias("s_v")), "v")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return both.where(common >= similarity * (F.size("s_u") + F.size("s_v") - common) - 1e-9).select("u", "v")


def _pairs(members: DataFrame, pivot: DataFrame, similarity: float) -> DataFrame:
    """Members (key, id, n, root) with the pivot (key, p_id, p_n, p_root) of their bucket, where they may be similar and are in other components."""
    met = members.join(pivot, "key").where("root <> p_root").where(F.least("n", "p_n") >= similarity * F.greatest("n", "p_n"))
    return met.select(F.greatest("id", "p_id").alias("u"), F.least("id", "p_id").alias("v")).distinct()


def joins(id: np.ndarray, root: np.ndarray, side: np.ndarray, element: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the components (root) of similar sets: all that any two sets would join, but for
    two of one side where there are two sides.  Only one link for each join."""
    code, token, count = np.unique(element, return_inverse=True, return_counts=True)
    pair = np.unique(W.owners(at) * len(code) + token)  # distinct, in order
    owner, token = np.divmod(pair, max(1, len(code)))
    at = np.searchsorted(owner, np.arange(len(id) + 1))
    size = np.diff(at)
    # similar sets share one of the rarest elements of each, in any common order of rarity
    order = np.lexsort((token, count[token], owner))
    place = np.arange(len(order)) - at[owner[order]]
    first = order[(place <= size[owner[order]] - np.ceil(similarity * size[owner[order]] - 1e-6)) & (count[token[order]] > 1)]
    first = first[np.argsort(token[first], kind="stable")]
    ends = np.flatnonzero(np.diff(token[first])) + 1
    met = np.zeros((len(id), len(id)), bool)
    for rows in np.split(owner[first], ends):
        if len(rows) > 1:
            met[np.ix_(rows, rows)] = True
    two = (side != side[:1]).any()
    root, u, v, marked = root.copy(), [], [], np.zeros(len(code), bool)
    for i in np.flatnonzero(met.any(1)):
        other = np.flatnonzero(met[i, :i])
        other = other[(root[other] != root[i]) & (np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-6)]
        if two:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        marked[token[at[i] : at[i + 1]]] = True
        to = np.concatenate([[0], np.cumsum(size[other])])
        rows = np.repeat(at[other] - to[:-1], size[other]) + np.arange(to[-1])
        common = np.add.reduceat(marked[token[rows]].astype(np.int64), to[:-1])
        marked[token[at[i] : at[i + 1]]] = False
        like = other[common >= similarity * (size[other] + size[i] - common) - 1e-9]
        _, one = np.unique(root[like], return_index=True)
        u.append(np.maximum(id[like[one]], id[i]))
        v.append(np.minimum(id[like[one]], id[i]))
        root[np.isin(root, root[like])] = root[i]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + u), np.concatenate(none + v)


def _settled(known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """known: key, id, n, root.  Links u, v that join the components of all similar members of each bucket (None: no bucket has two)."""
    parts = known.groupBy("key", "root").agg(F.sum(F.col("n") + EACH).alias("load"))
    buckets = parts.groupBy("key").agg(F.count("*").alias("roots"), F.sum("load").alias("load"), F.max(F.struct("load", "root")).alias("main")).where("roots > 1")
    blocks = lambda load: F.ceil(load / BLOCK)
    buckets = cut(buckets.select("key", "load", F.col("main.root").alias("main"), blocks(F.col("main.load")).alias("mains"), blocks(F.col("load") - F.col("main.load")).alias("others")))
    load = buckets.agg(F.sum("load")).first()[0]
    if load is None:
        return None
    whole, is_main, spread = F.col("load") <= BLOCK, F.col("root") == F.col("main"), F.xxhash64("id")
    own = F.when(whole, 0).when(is_main, F.pmod(spread, "mains")).otherwise(F.col("mains") + F.pmod(spread, "others"))
    meets = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    block = known.join(buckets, "key").withColumn("block", own.cast("long")).withColumn("with", F.explode(meets))
    part = F.when(whole, F.pmod("key", F.lit(load // BLOCK + 1))).otherwise(F.col("key"))  # small buckets meet in one task
    block = block.select(part.alias("part"), F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "root")

    def meet(table: pa.Table) -> pa.Table:
        id, first = np.unique(np.asarray(table["id"]), return_index=True)
        table = table.take(pa.array(first))
        s = table["s"].combine_chunks()
        element, at = np.asarray(s.values), np.asarray(s.offsets).astype(np.int64)
        u, v = joins(id, np.asarray(table["root"]), np.asarray(table["block"]), element[at[0] : at[-1]], at - at[0], similarity)
        return pa.table({"u": u, "v": v})

    return cut(block.join(sets, "id").groupBy("part", "lo", "hi").applyInArrow(meet, "u long, v long"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its group)."""
    marks = cut(sketch(docs, doc_id, text, bands, rows))
    real = marks.where("id is not null and n > 0")
    first = cut(real.groupBy("x", "y").agg(F.min(F.struct("id", "n", "bands")).alias("d")))
    heads = first.select("d.id", "d.n", F.explode("d.bands").alias("key"))
    shared = heads.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(heads.join(shared, "key"))  # rows of documents that share a bucket, for each such bucket
    central = members.groupBy("id").agg(F.sum("size").alias("central"))
    pivot = members.join(central, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("central", -F.col("id"))).alias("p")).select("key", F.col("p.id").alias("p_id"), F.col("p.n").alias("p_n"), F.col("p.id").alias("p_root"))
    sets = cut(_sets(docs, members.select("id").distinct(), doc_id, text).dropDuplicates(["id"]))
    links = cut(_verified(_pairs(members.withColumn("root", F.col("id")), pivot, similarity), sets, similarity))
    roots = components(links)
    known = cut(members.select("key", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    fresh = _settled(known, sets, similarity)
    if fresh is not None and not fresh.isEmpty():
        roots = components(links.union(fresh))
        drop(fresh)
    drop(sets, members, links, known)
    classes = marks.select("id", "x", "y", "n").join(first.select("x", "y", F.col("d.id").alias("head")), ["x", "y"], "left")
    named = classes.withColumn("head", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("head")).otherwise(F.col("id")))
    named = named.join(roots.select(F.col("node").alias("head"), "root"), "head", "left")
    return named.select(F.col("id").alias("doc_id"), F.coalesce("root", "head").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but for documents that are not the least of their group."""
    (name,) = unused(docs, "gone")
    gone = groups(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
