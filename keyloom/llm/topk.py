"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates and queries meet in blocks: a block of at most about BLOCK candidates keeps one list per
dimension, sorted by that component, and answers at most about QUERIES queries.  A query
reads all lists together, from the end that its component favours, and scores every vector that
it comes upon; it stops once its kth score is greater than the bound, the score of a vector made of
the components at the depth reached, which nothing unread can exceed.  A block gives k rows a
query at most, and the k best of these over all blocks are the result.

Every query must meet every candidate, so each side is dealt once for each block row or column of the other; both
sides of a block are bounded, so are its memory and time.  Candidates are dealt to blocks by position,
which no frequent id or vector can upset, queries by their distinct ids.

Defined results: vectors that are null or hold null, NaN or infinite components take no part.
Vectors of another length than the query's are no candidates.  Equal scores go to the smaller
id.  Scores beyond 64 bits count as the largest or smallest long of equal size, 2**63 - 1 or its negative, and tie.  A query whose vec_id occurs more than once is answered once, for its least vector; all rows of
that id are left out of its candidates; other repeated rows are candidates each.  Rows with a null id take no part.
Empty tables give an empty one; very long vectors are used whole.  Other columns, of any names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

BLOCK, QUERIES, FIRST_DEPTH = 32_768, 2_048, 8
#: Candidates of a block at least, where there are fewer blocks than cores.
SMALL = 2_048


def threshold(vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of the k best, their scores, depth read).  order: per dimension, positions by falling component."""
    n, d = vectors.shape
    lists = np.flatnonzero(query)
    down = query[lists] > 0
    seen = ids == own
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64 if vectors.dtype == object else vectors.dtype)
    at, step = 0, depth
    if not len(lists):  # every score is 0
        lists, down = np.arange(min(d, 1)), np.ones(min(d, 1), bool)
    while at < n:
        to = min(n, at + step)
        fresh = np.concatenate([order[j, at:to] if up else order[j, n - to : n - at] for j, up in zip(lists, down, strict=True)])
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        fresh = np.flatnonzero(np.bincount(fresh, minlength=n)) if len(fresh) > n // 8 else np.unique(fresh)
        got = _within(vectors[fresh] @ query)
        if len(best) == k:
            better = got >= scores[-1]
            fresh, got = fresh[better], got[better]
        best, scores = np.concatenate([best, fresh]), np.concatenate([scores, got])
        first = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[first], scores[first]
        at, step = to, 2 * step
        if len(best) == k and at < n:
            edge = vectors[np.where(down, order[lists, at - 1], order[lists, n - at]), lists]
            if scores[-1] > _within(edge @ query[lists]):
                break
    return best, scores, at


#: Largest score.
MOST = 2**63 - 1


def _within(scores):
    """Exact whole numbers of any size as longs, the largest and smallest ones for those beyond."""
    if getattr(scores, "dtype", None) == object:
        return np.array([max(-MOST, min(MOST, x)) for x in scores], np.int64)
    return max(-MOST, min(MOST, scores)) if isinstance(scores, int) else scores


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(np.int64).reshape(len(flat), -1)


def search(queries: DataFrame, candidates: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector", block: int = BLOCK, most: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score.  Vectors are arrays of long; both sides have columns vec_id and vector."""
    usable = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id is not null and v is not null and size(v) > 0")
    asked, offered = usable(queries).groupBy("id").agg(F.min("v").alias("v")), usable(candidates)
    count, cores = offered.count(), queries.sparkSession.sparkContext.defaultParallelism
    rows, columns = max(1, -(-count // block), min(cores, count // SMALL)), max(1, -(-asked.count() // most))
    deal = lambda df, by, own, n, other, m: df.withColumn(own, F.pmod(by, F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("d", F.size("v"))
    keys = ["r", "c", "d"]
    asked, offered = deal(asked, F.xxhash64("id"), "c", columns, "r", rows).groupBy(keys), deal(offered, F.monotonically_increasing_id(), "r", rows, "c", columns).groupBy(keys)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            vectors, asked_for = _matrix(right["v"]), _matrix(left["v"])
            ids = np.asarray(right["id"])
            most = np.abs(vectors.astype(float)).max() * np.abs(asked_for.astype(float)).max() * vectors.shape[1]
            kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object  # all exact; the first is the fastest
            vectors, asked_for = vectors.astype(kind), asked_for.astype(kind)
            order = np.ascontiguousarray(np.argsort(-vectors, axis=0, kind="stable").T)
            for own, query in zip(np.asarray(left["id"]).tolist(), asked_for, strict=True):
                best, scores, _ = threshold(vectors, ids, order, query, own, k)
                out[0] += [own] * len(best)
                out[1] += ids[best].tolist()
                out[2] += scores.astype(np.int64).tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], schema=schema)

    found = asked.cogroup(offered).applyInArrow(answer, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def scaled(vector: str, by: int = 1024) -> Column:
    """floor(by * x) of each component; null unless all components are finite."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(v, lambda x: F.floor(F.lit(float(by)) * x.cast("double"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("vector"))
    return search(rows.where("vec_id % 100 = 0"), rows, 10)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
