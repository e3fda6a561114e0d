"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Lines of equal sets are found by a hash of the set: all but the first go.
Words are ordered by rarity, as counted over all lines in a
table of RARITY counters (words that share a counter share a rank; any order common to all lines gives
exact results).  Two lines of similarity t or more share one of the n - ceil(t n) + 1 rarest words of
each (prefix filter), of which one posting each is dealt to the word's bucket.  In a bucket, the lines of a word
meet in the order of their sizes, as far as sizes and places allow.  A pair goes on if its sizes (length filter), its places in the two
prefixes (positional filter) and the parities of its words over 128 hash classes allow enough common words (classes whose parities differ
can only understate how much two lines do); it is then verified by exact Jaccard.

A line goes if any earlier line is similar enough, whether or not that one goes as well; earlier is by
(doc_id, line number).  So a line needs one match.  Postings of a word that look alike in all that the filters see stand behind the first
of them.  Of the lines of a word that pass the filters a line first meets all, if they are
few, or else the closest; lines that fail with these and had more to meet, then meet the rest.  Copies cost a few
candidates each, however many there are, and nothing is capped.  Later rounds compare parities by four hashes, over 512 classes and fewer, which
leaves hardly any dissimilar pair, and only the earliest of equal sets; they first take the closest, and all for lines that still fail.  Copies
within a task's input are settled before the shuffle, so a line that all documents share is one posting a word and task.

Defined results: lines are split at \\n; a line without a word never goes; a null text has no lines.  Very long texts and lines are used
whole, one at a time.  Rows with a null doc_id stay as they are and are compared with none.  Rows that repeat a doc_id count as one document: the same
line numbers go from each.  Where only equal sets reach the similarity (up to three words at 0.8), lines match by equal sets alone.
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
from .tables import cut, drop, read, unused

SIMILARITY, RARITY = 0.8, 1 << 18
#: Earlier lines of a word that a line is verified with at once: all, if there are so many at most, else the closest
#: CLOSE; postings of a very common word.
FEW, CLOSE, COMMON = 2, 1, 1024
#: Earlier lines of a word that a line whose first ones failed is verified with next; postings that it meets at once.
THEN, MEET = 256, 1 << 16
#: Parts that the counters are added up in.
PARTS = 256
#: Buckets of postings for each partition of the input; text whose postings a task holds at once.
SPREAD, CHUNK_BYTES = 4, 1 << 22
_CODE = 38  # bits of a word's hash within its code; 6 bits of rarity stand above
_LINE = np.dtype([("doc", "<i8"), ("line", "<i4"), ("mark", "<u8")])
#: Numbers of 64 bits that hold the parities of a line by one hash after another, in the first round and in later ones.
_COARSE, _FINE = (2,), (8, 4, 2, 2)
#: Classes of lines that are counted at once.
CELLS = 1 << 21


def _kind(groups: tuple[int, ...]) -> np.dtype:
    """A posting, with the parities of its line; in later rounds also the hash of its set."""
    mark = [("mark", "<u8")] if groups == _FINE else []
    return np.dtype([("token", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("place", "<i4"), *mark, *((f"bits{k}", "<u8") for k in range(sum(groups)))])


def _begins(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number and first byte of each line that has a byte or ends in \\n)."""
    begin = np.flatnonzero(raw == 10) + 1
    begin = np.insert(begin, np.searchsorted(begin, at[:-1]), at[:-1])
    begin = begin[(begin < len(raw)) & (np.diff(begin, prepend=-1) > 0)]
    text = np.searchsorted(at, begin, "right") - 1
    return text, np.arange(len(begin)) - np.searchsorted(text, text), begin


def _lines(raw: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and number of each line that has a word, first word of each)."""
    text, number, begin = _begins(raw, at)
    word = np.searchsorted(starts, begin)
    has = np.diff(np.concatenate([word, [len(starts)]])) > 0
    return text[has], number[has], word[has]


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: text, number and first word of each line; hashes of all words."""
    for lo, hi in W.slices(column):
        raw, at = W.bytes_of(column.slice(lo, hi - lo))
        starts, ends = W.spans(raw, at)
        text, number, first = _lines(raw, at, starts)
        yield text + lo, number, first, W.hashes(raw, starts, ends)


def rarity(docs: DataFrame) -> np.ndarray:
    """Six-bit rank of each counter: of how many words it has seen, the logarithm."""

    each, most = RARITY // PARTS, np.iinfo(np.uint32).max

    def rows(seen: np.ndarray, dtype: str) -> pa.RecordBatch:
        cells = seen.astype(dtype).reshape(-1, each)
        some = np.flatnonzero(cells.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cells[i].tobytes() for i in some], pa.binary())], names=["part", "seen"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(RARITY, np.int64), 0
        for batch in it:
            for *_, word in _parts(W.strings(batch.column(0))):
                if total + len(word) > most:
                    yield rows(seen, "<u4")
                    seen, total = np.zeros(RARITY, np.int64), 0
                seen += np.bincount((word & np.uint64(RARITY - 1)).astype(np.int64), minlength=RARITY)
                total += len(word)
        yield rows(seen, "<u4")

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["part", "seen"])

    counted = docs.select("text").mapInArrow(W.lean(count), "part int, seen binary").repartition("part").mapInArrow(W.lean(add), "part int, seen binary")
    seen = np.zeros((PARTS, each))
    for row in counted.collect():  # PARTS rows
        seen[row.part] += np.frombuffer(row.seen, "<i8")
    return np.minimum(63, np.floor(2 * np.log2(seen.ravel() + 1))).astype(np.uint64)


def _sets(first: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the distinct words of each line, rarest first; offsets of the lines)."""
    line = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.concatenate([first, [len(word)]])))
    code = _codes(word, rank)
    if len(first) < 1 << 20:
        packed = np.sort((line << np.uint64(44)) | code)
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
        code, line = packed & np.uint64((1 << 44) - 1), (packed >> np.uint64(44)).astype(np.int64)
    else:
        order = np.lexsort((code, line))
        code, line = code[order], line[order]
        head = np.concatenate([[True], (code[1:] != code[:-1]) | (line[1:] != line[:-1])])
        code, line = code[head], line[head].astype(np.int64)
    return code, np.searchsorted(line, np.arange(len(first) + 1))


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _codes(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Six bits of rarity, then bits of the hash: words in the order of their codes are rarest first."""
    return (rank[(word & np.uint64(RARITY - 1)).astype(np.int64)] << np.uint64(_CODE)) | (word >> np.uint64(64 - _CODE))


def _place(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, bucket) of a key."""
    return (key >> np.uint64(32)).astype(np.uint32), (key % np.uint64(buckets)).astype(np.int64)


def _parities(mixed: np.ndarray, at: np.ndarray, groups: tuple[int, ...]) -> list[np.ndarray]:
    """Whether a line has an odd number of words in each class, for each hash; mixed: hashes of the words."""
    out: list[np.ndarray] = []
    for numbers in groups:
        kinds = 64 * numbers
        bits, step = np.empty((len(at) - 1, numbers), np.uint64), max(1, CELLS // kinds)
        for lo in range(0, len(bits), step):
            some = at[lo : lo + step + 1]
            cell = W.owners(some) * kinds + (mixed[some[0] : some[-1]] >> np.uint64(65 - kinds.bit_length())).astype(np.int64)
            odd = (np.bincount(cell, minlength=kinds * (len(some) - 1)) & 1).astype(np.uint8)
            bits[lo : lo + step] = np.packbits(odd, bitorder="little").view("<u8").reshape(-1, numbers)
        out += [np.ascontiguousarray(bits[:, k]) for k in range(numbers)]
        mixed = mixed << np.uint64(kinds.bit_length() - 1)  # the next hash
    return out


class _Asked:
    """A filter for tokens, of 2 ** 24 bits whatever their number: what fails it was not asked for.  Two places a token, without hashing, as
    each word of the corpus is looked up."""

    TURN = 0x1E3779B1

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> _Asked:
        """Of the column token; repeated ones do no harm."""
        turned = (F.col("token") * F.lit(cls.TURN).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        places = keys.select(F.explode(F.array(F.shiftright("token", 8), F.shiftright(turned, 8))).alias("p"))
        rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
        words = np.zeros(1 << 18, np.uint64)
        words[np.asarray(rows["w"])] = np.asarray(rows["b"]).view(np.uint64)
        return cls(words)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> np.uint32(6)] >> (place & np.uint32(63)).astype(np.uint64)) & np.uint64(1) != 0

    def may_have(self, token: np.ndarray) -> np.ndarray:
        found = self._has(token >> np.uint32(8))
        some = np.flatnonzero(found)
        found[some] = self._has(token[some] * np.uint32(self.TURN) >> np.uint32(8))
        return found


class _Leads:
    """The earliest line of each set that a task has seen, by the hash of the set."""

    def __init__(self):
        self.mark, self.doc, self.line = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, mark: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which lines are no leads; which of these are copies of an earlier line, not repeated rows)."""
        order = np.lexsort((line, doc, mark))
        mark, doc, line = mark[order], doc[order], line[order]
        fresh = np.ones(len(mark), bool)
        fresh[1:] = mark[1:] != mark[:-1]
        head = np.flatnonzero(fresh)
        place = np.searchsorted(self.mark, mark[head])
        at = np.minimum(place, max(0, len(self.mark) - 1))
        known = self.mark[at] == mark[head] if len(self.mark) else np.zeros(len(head), bool)
        first_doc, first_line = doc[head].copy(), line[head].copy()
        before = known.copy()
        before[known] = (self.doc[at[known]] < first_doc[known]) | ((self.doc[at[known]] == first_doc[known]) & (self.line[at[known]] <= first_line[known]))
        first_doc[before], first_line[before] = self.doc[at[before]], self.line[at[before]]
        self.doc[at[known]], self.line[at[known]] = first_doc[known], first_line[known]
        new = ~known
        self.mark, self.doc, self.line = (np.insert(x, place[new], y[new]) for x, y in ((self.mark, mark[head]), (self.doc, first_doc), (self.line, first_line)))
        many = np.diff(np.append(head, len(mark)))
        other = (doc != np.repeat(first_doc, many)) | (line != np.repeat(first_line, many))
        none = ~fresh
        none[head[before]] = True
        out = np.zeros(len(order), bool)
        out[order[none]] = True
        return out, order[none & other]


def postings(docs: DataFrame, rank: np.ndarray, buckets: int, t: float, only: _Asked | None = None) -> DataFrame:
    """bucket, kind, blob: packed postings (kind 0), lines that are copies of an earlier one of their chunk (kind 1), and
    the others with the hash of their set, dealt by it (kind 2).
    With `only`, a filter of tokens, just the postings that pass it."""
    shared = docs.sparkSession.sparkContext.broadcast((rank, None if only is None else only.words))  # of fixed size

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, asked = shared.value
        wanted = None if asked is None else _Asked(asked)
        earlier = _Leads()

        def chunk(ids: np.ndarray, known: np.ndarray, column: pa.Array) -> Iterator[pa.RecordBatch]:
            lines, posts, total = [], [], 0
            for text, number, first, word in _parts(column):
                use = known[text]
                if wanted is not None and len(first):
                    use &= np.logical_or.reduceat(wanted.may_have(_place(W.mix(_codes(word, ranks)), buckets)[0]), first)
                if not use.all():
                    words = np.repeat(use, np.diff(np.concatenate([first, [len(word)]])))
                    word = word[words]
                    first = np.concatenate([[0], np.cumsum(words)])[first][use]
                    text, number = text[use], number[use]
                if not len(first):
                    continue
                code, at = _sets(first, word, ranks)
                n = np.diff(at)
                mixed = W.mix(code)
                mark = np.add.reduceat(W.mix(code ^ np.uint64(0xABCD)), at[:-1]) ^ W.mix(n.astype(np.uint64))
                size = np.where(n * (1 - t) < t - 1e-6, 0, prefix_length(n, t))  # none where only equal sets are similar
                line = np.repeat(np.arange(len(n)), size)
                place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                token, bucket = _place(mixed[np.repeat(at[:-1], size) + place], buckets)
                line += total
                if wanted is not None:
                    some = wanted.may_have(token)
                    line, place, token, bucket = line[some], place[some], token[some], bucket[some]
                lines.append((ids[text], number.astype(np.int32), n.astype(np.int32), mark, *_parities(mixed, at, _COARSE if wanted is None else _FINE)))
                posts.append((line, place, token, bucket))
                total += len(n)
            if not lines:
                return
            doc, number, n, mark, *bits = (np.concatenate(c) for c in zip(*lines, strict=True))
            line, place, token, bucket = (np.concatenate(c) for c in zip(*posts, strict=True))
            copy, gone = earlier.add(mark, doc, number)
            by = np.flatnonzero(~copy[line])
            by = by[np.argsort(bucket[by].astype(np.uint16) if buckets <= 1 << 16 else bucket[by], kind="stable")]
            bucket, line = bucket[by], line[by]
            full = [token[by], doc[line], number[line], n[line], place[by].astype(np.int32), *(b[line] for b in ([] if wanted is None else [mark]) + bits)]  # in the order of _kind
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = [(int(bucket[a]), 0, _pack([c[a:b] for c in full])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            if wanted is None:
                if len(gone):
                    rows.append((int(mark[gone[0]] % np.uint64(buckets)), 1, _pack([doc[gone], number[gone], mark[gone]])))
                by = np.flatnonzero(~copy)
                bucket = (mark % np.uint64(buckets)).astype(np.int64)
                by = by[np.argsort(bucket[by], kind="stable")]
                edge = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
                full = [doc[by], number[by], mark[by]]
                rows += [(int(bucket[by[a]]), 2, _pack([c[a:b] for c in full])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

        for batch in it:
            known, ids, column = np.asarray(batch.column(0).is_valid()), np.asarray(batch.column(0).fill_null(0)), W.strings(batch.column(1))
            for lo, hi in W.slices(column, CHUNK_BYTES):
                yield from chunk(ids[lo:hi], known[lo:hi], column.slice(lo, hi - lo))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(W.lean(deal), "bucket long, kind int, blob binary")


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of postings, each as its lowest bytes, then the next and so on: the high ones are mostly 0 and compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _unpack(blobs: list[bytes], kind: np.dtype) -> dict[str, np.ndarray]:
    out: dict[str, list] = {c: [np.zeros(0, kind[c])] for c in kind.names}
    for blob in blobs:
        n, at = len(blob) // kind.itemsize, 0
        for c in kind.names:
            size = kind[c].itemsize
            out[c].append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind[c]).ravel())
            at += n * size
    return {c: np.concatenate(v) for c, v in out.items()}


def _copies(post: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The lines whose set an earlier line has, by the hash of the set."""
    order = np.lexsort((post["line"], post["doc"], post["mark"]))
    post = {c: v[order] for c, v in post.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = post["mark"][1:] != post["mark"][:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    other = (post["doc"] != post["doc"][first]) | (post["line"] != post["line"][first])  # a repeated row is no copy
    return {c: v[other] for c, v in post.items()}


class _Postings:
    """Postings of a bucket by word, then document order, as columns; `start` is the first of the same word."""

    def __init__(self, blobs: list[bytes], t: float, groups: tuple[int, ...]):
        self.first = {0, *np.cumsum(groups)}  # the numbers that begin a hash's
        post = _unpack(blobs, _kind(groups))
        order = np.argsort(post["token"])
        token = post["token"][order]
        twice = np.zeros(len(order), bool)  # a word of one posting has no pairs
        twice[1:] = token[1:] == token[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        order = order[np.lexsort((post["line"][order], post["doc"][order], post["token"][order]))]
        if "mark" in post:  # an open line is no copy, and of equal sets the earliest stands for all
            mark = post.pop("mark")[order]
            order = order[np.sort(np.unique(W.mix(mark) ^ post["token"][order], return_index=True)[1])]
        self._set(t, {c: v[order] for c, v in post.items()})

    def _set(self, t: float, post: dict[str, np.ndarray]) -> None:
        self.t = t
        self.token, self.doc, self.line, self.n, self.place, *self.bits = post.values()
        self.tail = self.n - self.place  # words from this one on
        fresh = np.ones(len(self.token), bool)
        fresh[1:] = self.token[1:] != self.token[:-1]
        self.start = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))

    def __len__(self) -> int:
        return len(self.token)

    def lead(self) -> tuple[np.ndarray, np.ndarray]:
        """Keeps, of the postings of a word that look alike (in size, place and parities), the first.  (Postings that
        go, those that they look like; as postings before.)  many: which of those that stay have had others."""
        bits = self.bits[0]
        for more in self.bits[1:]:
            bits = W.mix(bits) ^ more
        key = W.mix(bits ^ W.mix((self.token.astype(np.uint64) << np.uint64(32)) ^ W.mix((self.n.astype(np.uint64) << np.uint64(32)) | self.place.astype(np.uint64))))
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        first = np.empty(len(key), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        again = np.flatnonzero(first != np.arange(len(key)))
        like = first[again]
        other = (self.doc[again] != self.doc[like]) | (self.line[again] != self.line[like])
        y, x = self[again[other]], self[like[other]]
        stay = np.ones(len(key), bool)
        stay[again] = False
        self.many = np.zeros(len(key), bool)
        self.many[like] = True
        self.many = self.many[stay]
        columns = (self.token, self.doc, self.line, self.n, self.place, *self.bits)
        self._set(self.t, {str(k): c[stay] for k, c in enumerate(columns)})
        return y, x

    def __getitem__(self, i: np.ndarray) -> dict[str, np.ndarray]:
        return {"token": self.token[i], "doc": self.doc[i], "line": self.line[i]}

    def may(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs pass the length, positional and parity filters, how far apart these are)."""
        both = self.n[x] + self.n[y]
        need = np.ceil(self.t / (1 + self.t) * both - 1e-9)
        at = np.flatnonzero(np.minimum(self.tail[x], self.tail[y]) >= need)  # only sizes that allow it have such places
        x, y, most = x[at], y[at], (both[at] - 2 * need[at]).astype(np.int64)
        apart = far = np.zeros(len(at), np.int64)
        for k, bits in enumerate(self.bits):
            apart = (0 if k in self.first else apart) + np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64)
            ok = np.flatnonzero(apart <= most)
            at, x, y, most, apart, far = at[ok], x[ok], y[ok], most[ok], apart[ok], np.maximum(far, apart)[ok]
        other = (self.doc[x] != self.doc[y]) | (self.line[x] != self.line[y])
        return at[other], far[other]


_FOUND = "y_doc long, y_line int, x_doc long, x_line int, kind int, bucket long, token long"
_KINDS = pa.schema([("y_doc", pa.int64()), ("y_line", pa.int32()), ("x_doc", pa.int64()), ("x_line", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("token", pa.int64())])


def _rows(y: np.ndarray, x: np.ndarray, kind: np.ndarray | int, bucket: int) -> pa.Table:
    """y, x: postings."""
    full = lambda v: np.full(len(y["doc"]), v) if np.isscalar(v) else v
    cols = [y["doc"], y["line"], x["doc"], x["line"], full(kind), full(bucket), y.get("token", np.zeros(len(y["doc"]), np.uint32))]
    return pa.table([pa.array(c).cast(f.type) for c, f in zip(cols, _KINDS, strict=True)], schema=_KINDS)


def _near(posts: _Postings, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, apart) of the pairs of one word that pass, x earlier; index: postings by word and size.  Each
    posting meets those that follow it in this order as long as sizes and its own place allow."""
    n, t = posts.n[index].astype(np.int64), posts.t
    largest = np.floor(np.minimum(n / t, posts.tail[index] * ((1 + t) / t) - n) + 1e-6).astype(np.int64)
    token = posts.token[index].astype(np.uint64) << np.uint64(32)
    many = np.searchsorted(token | n.view(np.uint64), token | np.maximum(largest, 0).view(np.uint64), "right") - np.arange(1, len(index) + 1)
    start = np.flatnonzero(many > 0)
    to = np.cumsum(many[start])
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(to, (to[lo - 1] if lo else 0) + MEET, "right")))
        size = many[start[lo:hi]]
        a = np.repeat(start[lo:hi], size)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        a, b = index[a], index[b]
        x, y = np.minimum(a, b), np.maximum(a, b)
        at, apart = posts.may(x, y)
        yield x[at], y[at], apart
        lo = hi


def _first(t: float):
    """Pairs of lines that pass the filters.  A line with up to FEW earlier ones of a word gets them all (kind 0); one
    with more gets the CLOSE closest, or in very common words the earliest (kind 2).  Kind 1: copies."""

    def meet(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py() if len(table) else 0
        kind, blobs = np.asarray(table["kind"]), table["blob"].to_pylist()
        posts = _Postings([b for b, k in zip(blobs, kind, strict=True) if k == 0], t, _COARSE)
        of = lambda what: _unpack([b for b, k in zip(blobs, kind, strict=True) if k == what], _LINE)
        out = [_rows(gone, gone, 1, bucket) for gone in (of(1), _copies(of(2)))]
        out.append(_rows(*posts.lead(), 2, bucket))
        if not len(posts):
            return pa.concat_tables(out)
        size = np.diff(np.append(np.unique(posts.start), len(posts)))
        common = np.repeat(size > COMMON, size)
        some = np.flatnonzero(~common & np.repeat(size > 1, size))
        some = some[np.lexsort((posts.n[some], posts.token[some]))]
        found = list(_near(posts, some))
        if found:
            x, y, apart = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.lexsort((x, apart, y))
            x, y = x[order], y[order]
            head = np.flatnonzero(np.diff(y, prepend=-1))
            many = np.diff(np.append(head, len(y)))
            more = np.repeat((many > FEW) | np.logical_or.reduceat(posts.many[x], head), many)
            keep = np.arange(len(y)) - np.repeat(head, many) < np.repeat(np.where(many > FEW, CLOSE, FEW), many)
            out.append(_rows(posts[y[keep]], posts[x[keep]], np.where(more[keep], 2, 0), bucket))
        live, k = np.flatnonzero(common), 0
        while len(live):
            live = live[posts.start[live] + k < live]
            at, _ = posts.may(posts.start[live] + k, live)
            y = live[at]
            out.append(_rows(posts[y], posts[posts.start[y] + k], np.where((posts.start[y] + k + 1 < y) | posts.many[posts.start[y] + k], 2, 0), bucket))
            live = np.delete(live, at)
            k += 1
        del posts, blobs
        W.trim()
        return pa.concat_tables(out)

    return meet


def _rest(t: float, most: int | None):
    """For the asked lines the earlier ones of the word that pass the filters: the `most` closest (kind 2 where there are
    more, else 0), or all."""

    def meet(table: pa.Table, asked: pa.Table) -> pa.Table:
        posts = _Postings([b for b, k in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == 0], t, _FINE)
        none, bucket = np.zeros(0, np.int64), asked["bucket"][0].as_py() if len(asked) else 0
        out = [_rows(posts[none], posts[none], 0, bucket)]
        if len(asked) and len(posts):
            mark = lambda token, doc, line: W.mix(W.mix(doc.astype(np.int64).view(np.uint64)) + (line.astype(np.uint64) << np.uint64(32)) + token.astype(np.uint64))
            have, want = mark(posts.token, posts.doc, posts.line), mark(*(np.asarray(asked[c]) for c in ("token", "y_doc", "y_line")))
            order = np.argsort(have)
            place = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
            for y in np.unique(order[place][have[order][place] == want]):
                best, apart = none, none
                for lo in range(posts.start[y], y, MEET):  # in blocks
                    x = np.arange(lo, min(y, lo + MEET))
                    at, far = posts.may(x, np.full(len(x), y))
                    best, apart = np.append(best, x[at]), np.append(apart, far)
                    if most is not None and len(best) > most:
                        first = np.argsort(apart, kind="stable")[: most + 1]
                        best, apart = best[first], apart[first]
                more = most is not None and len(best) > most
                best = best[np.argsort(apart, kind="stable")[:most]]
                out.append(_rows(posts[np.full(len(best), y)], posts[best], 2 if more else 0, bucket))
        return pa.concat_tables(out)

    return meet


def _line_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc, line, s: the word hashes of the needed (doc, line).  Texts are not shuffled: each task makes the
    sets of the lines that pass a filter of the needed ones, and an exact semi-join follows."""
    shared = docs.sparkSession.sparkContext.broadcast([Filter.of(needed, "doc").words, Filter.of(needed, "doc", "line").words])  # of fixed size

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, line = (Filter(w) for w in shared.value)
        for batch in it:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(doc.may_have(np.asarray(batch.column(0)))))
            ids = np.asarray(batch.column(0))
            column = W.strings(batch.column(1))
            for lo, hi in W.slices(column):
                raw, at = W.bytes_of(column.slice(lo, hi - lo))
                text, number, begin = _begins(raw, at)
                use = line.may_have(ids[lo + text], number)
                size = np.diff(begin, append=len(raw))[use]
                to = np.concatenate([[0], np.cumsum(size)])
                raw = raw[np.repeat(begin[use] - to[:-1], size) + np.arange(to[-1])]  # these lines alone
                starts, ends = W.spans(raw, to)
                word, owner = W.hashes(raw, starts, ends), np.searchsorted(to, starts, "right") - 1
                order = np.lexsort((word, owner))
                word, owner = word[order], owner[order]
                head = np.ones(len(word), bool)
                head[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                offsets = np.searchsorted(owner[head], np.arange(len(size) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + text[use]]), pa.array(number[use].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(word[head].view(np.int64)))], names=["doc", "line", "s"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(W.lean(batches), "doc long, line int, s array<long>")
    return made.join(needed, ["doc", "line"], "left_semi").dropDuplicates(["doc", "line"])


def _verified(docs: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """y_doc, y_line of the pairs that are similar enough."""
    needed = cut(pairs.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")).union(pairs.select("x_doc", "x_line")).distinct())
    sets = _line_sets(docs, needed)
    named = lambda p: sets.select(F.col("doc").alias(f"{p}_doc"), F.col("line").alias(f"{p}_line"), F.col("s").alias(f"{p}_s"))
    both = pairs.join(named("x"), ["x_doc", "x_line"]).join(named("y"), ["y_doc", "y_line"])
    common = F.size(F.array_intersect("x_s", "y_s"))
    return both.where(common >= t * (F.size("x_s") + F.size("y_s") - common) - 1e-9).select("y_doc", "y_line").distinct()


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, line (from 0) of every line that goes."""
    docs = docs.select("doc_id", "text")
    buckets = SPREAD * docs.rdd.getNumPartitions()
    rank = rarity(docs)
    posts = postings(docs, rank, buckets, similarity)
    found = cut(posts.groupBy("bucket").applyInArrow(_first(similarity), _FOUND))
    copies = cut(found.where("kind = 1").select("y_doc", "y_line").distinct())
    pairs = cut(found.where("kind <> 1").join(copies, ["y_doc", "y_line"], "left_anti"))
    drop(found)
    gone = cut(_verified(docs, pairs.select("y_doc", "y_line", "x_doc", "x_line").distinct(), similarity).union(copies))
    spent = [pairs, copies]
    for most in (THEN, None):
        open_ = cut(pairs.where("kind = 2").join(gone, ["y_doc", "y_line"], "left_anti").select("bucket", "token", "y_doc", "y_line").distinct())
        drop(*spent)
        spent = [open_]
        if open_.isEmpty():
            break
        again = postings(docs, rank, buckets, similarity, _Asked.of(open_))
        pairs = cut(again.groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(_rest(similarity, most), _FOUND))
        more = cut(gone.union(_verified(docs, pairs.select("y_doc", "y_line", "x_doc", "x_line").distinct(), similarity)))
        spent += [pairs, gone]
        gone = more
    drop(*spent)
    return gone.select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line"))


def remove_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, without the repeated lines; n_chars, if there, counts what is left.
    Documents that lose every line that has a word go."""
    doc, lines, rest = unused(docs, "doc", "lines", "rest")
    gone = repeated_lines(docs, similarity).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(lines))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(lines, i)), "\n")
    joined = docs.join(gone, docs["doc_id"] == gone[doc], "left")
    joined = joined.withColumn(rest, F.when(F.col(lines).isNotNull(), left)).where(F.col(lines).isNull() | F.col(rest).rlike(r"[^\x20\x09-\x0D]"))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out["text"] = F.coalesce(rest, "text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col(rest).isNotNull(), F.length(rest).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*(v.alias(c) for c, v in out.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its lines that go (from 0, in order) and their number."""
    docs = read(spark, sf_dir, "documents")
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    none = F.array().cast("array<int>")
    return docs.select("doc_id").join(gone, "doc_id", "left").select("doc_id", F.coalesce("lines", none).alias("lines"), F.size(F.coalesce("lines", none)).cast("long").alias("n_removed"))
