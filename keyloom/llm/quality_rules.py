"""Quality rules: counts over a text's words and lines, and suffix-array repetition.

The suffixes of a text's words are sorted by prefix doubling, starting from windows of MIN_RUN
words that occur at least twice in the text, since no other suffix begins a repeat of that length.
Neighbours' longest common prefixes give, for each such position, the longest repeat that
starts there (the deepest LCP interval that holds it); the union of these spans is the covered
part.  A text is rejected if more than MAX_COVERED % of its words are covered, or if its longest
repeat has more than MAX_RUN words; texts that fail the base rules are rejected before.

All is done on 64-bit word hashes, vectorised over slices of about a megabyte of text, where
the rows lie: no shuffle.  Memory follows the longest text.

Defined results: a null or empty text has no words, all counts 0, and fails the base rules.
An empty table gives an empty one; very long texts are used whole, one at a time; other columns may have any names.
Repeated rows are judged alike.  Words are `[^\\x20\\x09-\\x0D]+`, lines are split at \\n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words as W
from .tables import kinds, read

#: Shortest repeat that counts, in words; most covered words in 100; longest repeat allowed.
MIN_RUN, MAX_COVERED, MAX_RUN = 5, 40, 200
#: Base rules: fewest words; most words of repeated 3-word windows in 100.
MIN_WORDS, MAX_REPEAT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPEATS = ("covered_words", "longest_repeat")
#: Fixed value: the symbols that are counted.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BASE = 0xD6E8FEB86659FD93


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorting order, which elements of it have an equal neighbour)."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order, twice


def _within(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return W.mix(key ^ W.mix(text.astype(np.uint64) + np.uint64(1)))


def _cover(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(word: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which a repeat of `least` words or more within its text starts, the length of the longest such)."""
    key, first = W.windows(word, at, least)
    owner = W.owners(at)
    order, twice = _again(_within(key, owner[first]))
    if not twice.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Windows found twice, and what may follow one, in the order of their words (past the end: 0).
    here = first[order[twice]]
    here = np.unique((here[:, None] + np.arange(least + 1)).ravel())
    here = here[here < len(word)]
    ahead = np.minimum(here[:, None] + np.arange(least), len(word) - 1)
    column = np.where(here[:, None] + np.arange(least) < at[1:][owner[here]][:, None], word[ahead], np.uint64(0))
    by = np.lexsort((*column.T[::-1], owner[here]))
    suffix = here[by]  # the suffix array, so far by the first `least` words
    column = column[by]
    head = np.concatenate([[True], (column[1:] != column[:-1]).any(1) | (owner[suffix[1:]] != owner[suffix[:-1]])])
    group = np.cumsum(head) - 1
    n, end = len(word), at[1:][owner]
    rank = np.full(n, -1, np.int64)

    def put() -> None:
        nonlocal group
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([starts, [len(group)]]))
        group = np.repeat(starts, size)
        rank[suffix] = group
        put.open = np.repeat(size > 1, size)

    put()
    first_group = group.copy()
    step = least
    while put.open.any() and step < n:
        slot = np.flatnonzero(put.open)
        p = suffix[slot]
        q = p + step
        then = np.where(q < end[p], rank[np.minimum(q, n - 1)], -1)
        by = np.lexsort((then, group[slot]))
        suffix[slot] = p[by]
        fresh = np.concatenate([[True], (then[by][1:] != then[by][:-1]) | (group[slot][by][1:] != group[slot][by][:-1])])
        finer = group.copy()
        finer[slot] = slot[np.maximum.accumulate(np.where(fresh, np.arange(len(slot)), 0))]
        group = finer
        put()
        step *= 2
    # LCP of neighbours within a first group, by bisection over prefix hashes.
    power = W.powers(_BASE, n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:n], dtype=np.uint64)])
    pair = np.flatnonzero(first_group[1:] == first_group[:-1])
    a, b = np.minimum(suffix[pair], suffix[pair + 1]), np.maximum(suffix[pair], suffix[pair + 1])
    lo, hi = np.full(len(pair), least), end[b] - b
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        equal = (total[a + mid] - total[a]) * power[b - a] == total[b + mid] - total[b]
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    longest = np.zeros(len(suffix), np.int64)
    longest[pair] = lo
    longest[pair + 1] = np.maximum(longest[pair + 1], lo)
    return suffix[longest > 0], longest[longest > 0]


def measure(column: pa.Array, least: int = MIN_RUN) -> dict[str, np.ndarray]:
    """Counts of every text of a string array."""
    raw, at = W.bytes_of(column)
    starts, ends = W.spans(raw, at)
    word, word_at = W.hashes(raw, starts, ends), np.searchsorted(starts, at)
    n = np.diff(word_at)
    out = {"n_words": n, "word_chars": _per_text(~W.separators(raw) & ((raw & 0xC0) != 0x80), at), "n_symbols": _per_text(_SYMBOL[raw], at)}
    # Lines: cut at \n and at the ends of texts.
    cuts = np.flatnonzero(raw == 10)
    line_from = np.unique(np.concatenate([at[:-1], cuts + 1]))
    line_from = line_from[line_from < len(raw)]
    line_to = np.minimum(np.concatenate([line_from[1:], [len(raw)]]), len(raw))
    line_to -= (line_to > line_from) & (raw[np.maximum(line_to - 1, 0)] == 10) if len(raw) else 0
    has = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[has], line_to[has]
    text = np.searchsorted(at, line_from, "right") - 1
    _, where = np.unique(_within(W.hashes(raw, line_from, line_to), text), return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=len(n)) - np.bincount(text[where], minlength=len(n))
    triple, first = W.windows(word, word_at, 3)
    owner = W.owners(word_at)
    order, twice = _again(_within(triple, owner[first]))
    hit = first[order[twice]]
    out["n_repeat_words"] = _per_text(_cover(hit, np.full(len(hit), 3), len(word)), word_at)
    place, length = repeats(word, word_at, least)
    out["covered_words"] = _per_text(_cover(place, length, len(word)), word_at)
    out["longest_repeat"] = np.zeros(len(n), np.int64)
    np.maximum.at(out["longest_repeat"], owner[place], length)
    return out


def judge(column: pa.Array, least: int = MIN_RUN, covered: int = MAX_COVERED, run: int = MAX_RUN) -> dict[str, np.ndarray]:
    """Counts of every text, base_failed and kept, slice by slice."""
    found = [measure(column.slice(lo, hi - lo), least) for lo, hi in W.slices(column)]
    names = (*COUNTS, *REPEATS)
    out = {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in names}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["covered_words"] <= covered * out["n_words"]) & (out["longest_repeat"] <= run)
    return out


def assess(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), **limits: int) -> DataFrame:
    """`keep` columns plus the counts, base_failed and kept."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = judge(W.strings(batch.column(batch.num_columns - 1)), **limits)
            names = [*COUNTS, "base_failed", "kept", *REPEATS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[n]) for n in names)], names=[*keep, *names])

    longs = lambda names: "".join(f"{n} long, " for n in names)
    counts = f"{longs(COUNTS)}base_failed boolean, kept boolean, {longs(REPEATS)}".rstrip(", ")
    return docs.select(*keep, docs[f"`{text}`"].alias("__text")).mapInArrow(W.lean(batches), kinds(docs, *keep) + counts)


def keep_good(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """The rows, all columns, that the rules keep."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(judge(W.strings(batch.column(text)), **limits)["kept"]))

    return docs.mapInArrow(W.lean(batches), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"))
