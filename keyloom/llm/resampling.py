"""Quality classifier by importance resampling.

Two generative models over hashed word 1-grams and 2-grams: the raw model counts every document, the
target model those of a bounded sample of labelled rows that are good and not toxic.  PRIOR expected
counts, drawn as the raw model has them, stand by every bucket, so a rare bucket says nothing.  A document's
weight is TEMPERATURE times the mean, over its n-grams, of log(target / raw): the log likelihood ratio of
TEMPERATURE n-grams drawn from the document.  (The sum over all n-grams would take a document's overlapping and repeated n-grams for
independent evidence; weights would be hundreds, noise of a few units would decide nothing, and long documents would win.)

Gumbel noise is added to the weight and the k documents with the largest keys are taken, which is
sampling k documents without replacement with probabilities in proportion to exp(weight).  k does not depend on weights:
it is the number of documents times the share of good ones among the labelled documents that are there, so labels
should be a random part of the documents; or it is given.

Counts: one pass over the corpus adds up BUCKETS counters a task; the two models have
BUCKETS numbers each, whatever the input.  The second pass scores documents where they lie.  The kth
key is found exactly, by counting 16 bits of the keys at a time; nothing is sorted or collected.

Defined results: a null or empty text has no n-grams and is never taken.  Very long texts are used whole, in memory one at a
time.  Equal keys, as rows of one doc_id and text have, are taken or left together, so ties at the kth key may add rows.  Labels that are null count
as not good; of rows that repeat a doc_id in labels any bad one makes it bad.  Without labelled documents every document with a word
is taken; an empty table gives an empty one.  Columns may have any names: no name is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import cut, kinds, read

BUCKETS, PRIOR, TEMPERATURE, SEED = 1 << 16, 20.0, 16.0, 17
#: Most labelled documents that are read, those with the smallest hashes.
LABELLED = 20_000
#: Keys and weights are kept as whole numbers of 1 / UNIT.
UNIT = 1 << 32


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    word, at = W.words(column)
    pair, first = W.windows(word, at, 2)
    owner = W.owners(at)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([owner, owner[first]]), (np.concatenate([W.mix(word), pair]) >> shift).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(-(2**62)))


def _has(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, ids), max(len(among) - 1, 0))
    return among[at] == ids if len(among) else np.zeros(len(ids), bool)


def labelled(labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids of labelled documents: those of the target (good and not toxic), all good ones, and the others."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    clean = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good"), F.min(good & clean).alias("target"))
    rows = one.select("doc_id", "good", "target").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most).collect()
    ids = lambda f: np.sort(np.array([r.doc_id for r in rows if f(r)], np.int64))
    return ids(lambda r: r.target), ids(lambda r: r.good), ids(lambda r: not r.good)


def fit(docs: DataFrame, good: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in it:
            column, chosen = W.strings(batch.column(1)), _has(_ids(batch.column(0)), good)
            for lo, hi in W.slices(column):
                owner, bucket = _grams(column.slice(lo, hi - lo))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[lo:hi][owner]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(W.lean(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[np.asarray(rows["bucket"])], target[np.asarray(rows["bucket"])] = np.asarray(rows["raw"]), np.asarray(rows["target"])
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    noise = W.mix(W.mix(ids.view(np.uint64)) + np.uint64(seed))
    return -np.log(-np.log(((noise >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))


def scores(ids: pa.Array, texts: pa.Array, ratio: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(weight, key) of each document in units; least long where there are no n-grams."""
    column = W.strings(texts)
    total, n = np.zeros(len(column)), np.zeros(len(column))
    for lo, hi in W.slices(column):
        owner, bucket = _grams(column.slice(lo, hi - lo))
        total[lo:hi] = np.bincount(owner, ratio[bucket], hi - lo)
        n[lo:hi] = np.bincount(owner, minlength=hi - lo)
    weight = TEMPERATURE * total / np.maximum(n, 1)
    whole = lambda x: np.where(n > 0, np.round(x * UNIT), -(2.0**62)).astype(np.int64)
    return whole(weight), whole(weight + gumbel(_ids(ids), seed))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The kth largest value of a long column within +-2**62, by four counts of 16 bits; None if there are fewer."""
    if k < 1:
        return None
    bits = F.col(column) + F.lit(2**62)
    found, left = 0, k
    for shift in (48, 32, 16, 0):
        inside = df.where(F.shiftright(bits, shift + 16) == found) if shift < 48 else df
        digits = inside.groupBy(F.shiftright(bits, shift).bitwiseAND(0xFFFF).alias("digit")).count().collect()  # 65,536 rows at most
        for digit, count in sorted(((r["digit"], r["count"]) for r in digits), reverse=True):
            if left <= count:
                found = (found << 16) | digit
                break
            left -= count
        else:
            return None
    return found - 2**62


def model(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[np.ndarray, int]:
    """(log ratios, the least key that is taken)."""
    target, good, bad = labelled(labels)
    ratio = fit(docs, target)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            _, key = scores(batch.column(0), batch.column(1), ratio, seed)
            ids = _ids(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_has(ids, good)), pa.array(_has(ids, bad))], names=["key", "good", "bad"])

    scored = cut(docs.select("doc_id", "text").mapInArrow(W.lean(score), "key long, good boolean, bad boolean").where(F.col("key") > -(2**62)))
    if k is None:
        count = scored.agg(F.count("*").alias("all"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad")).first()
        known = count["good"] + count["bad"]
        k = -(-count["all"] * count["good"] // known) if known and len(target) else count["all"]
    least = kth_largest(scored, "key", k)
    return ratio, least if least is not None else 2**62 if k < 1 else -(2**62) + 1  # fewer than k: all with n-grams


def resample(docs: DataFrame, labels: DataFrame, digest: bool = False, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents that are taken, all columns; with `digest` their doc_id, weight and key alone."""
    ratio, least = model(docs, labels, k, seed)
    source = docs.select("doc_id", "text") if digest else docs
    found = source.columns

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            weight, key = scores(batch.column(found.index("doc_id")), batch.column(found.index("text")), ratio, seed)
            if digest:
                kept = pa.array(key >= least)
                batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight / UNIT), pa.array(key / UNIT), kept], names=["doc_id", "log_weight", "sample_key", "kept"])
                yield batch.filter(kept)
            else:
                yield batch.filter(pa.array(key >= least))

    return source.mapInArrow(W.lean(take), kinds(docs, "doc_id") + "log_weight double, sample_key double, kept boolean" if digest else docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), digest=True)
