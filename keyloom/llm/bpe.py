"""BPE encoding and decoding of whole texts by tree concatenation.

A text of more than LEAF characters is halved again and again; the leaves are encoded by
themselves, and two neighbours are joined by encoding a window around their join anew.  The
window grows until it agrees with both sides: on each side it and the side have two tokens in a
row that cover the same bytes.  A pair of tokens that stands in a valid encoding is compatible,
and an encoding all of whose neighbouring tokens are compatible is the encoding of the whole, so
left part + window + right part is exact.  A cut goes to white space where there is some near the middle;
the pre-tokenizer starts afresh there, and the window check is on the words at the join.

A leaf of plain Latin text is cut into the pre-tokenizer's words, and each distinct word of a
task is encoded once by the library and remembered, in a cache of bounded size.  A leaf with any other
code point goes through the library as it is, so that no Unicode table but the library's matters.

Defined results: a null or empty text has no tokens and decodes to an empty text.  Strings of
special tokens in a text become those tokens, as in the library.  Repeated rows are encoded
alike; an empty table gives an empty one; other columns may have any names.  Memory follows the longest text.

Halves of unsplit text are encoded by the library's threads at once; texts with white space, whose leaves are words that a task
remembers, one after the other, as many tasks run beside each other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters of a leaf; how far from the middle white space is looked for; first window.
LEAF, NEAR, WINDOW = 16_384, 256, 64
#: Distinct words that a task remembers before it forgets them all, and their longest length.
CACHE_WORDS, CACHE_LENGTH = 250_000, 64

#: Fixed value: the pre-tokenizer's pattern, for Latin text.
_LETTER = "a-zªµºÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9²³¹¼½¾]|[^\s\xa0\x85{_LETTER}0-9²³¹¼½¾]+")
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~\x85\xa0-ɏ]*")
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0]")


class TreeBpe:
    """Encodes as `tokenizer` (a tokenizers.Tokenizer that normalises to NFC, single spaces and
    lower case, and has no spaces in tokens) does with add_special_tokens=False."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.leaf_size, self.window = leaf, window
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.sizes = np.array([len(n.removesuffix("</w>")) for n in self.names])  # a character of a token is a byte of text
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.windows = 0

    # A word or leaf is (its ids as little-endian unsigned 32-bit numbers, decoded text).

    def _library(self, text: str) -> tuple[bytes, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def _words(self, text: str) -> tuple[list[bytes], list[str]]:
        cache, ids, said = self.cache, [], []
        for w in _WORD.findall(text):
            got = cache.get(w)
            if got is None:
                got = self._library(w)
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            ids.append(got[0])
            said.append(got[1])
        return ids, said

    def _leaf(self, text: str) -> tuple[bytes, str]:
        if not _PLAIN.fullmatch(text):
            return self._library(text)
        ids, said = self._words(text)
        return b"".join(ids), " ".join(said)

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a decoder, tokens and single spaces."""
        return " ".join([self.names[i] for i in ids])

    def _tree(self, text: str) -> list[tuple[bytes, str]]:
        """Encodings of consecutive stretches of a normalised text."""
        if len(text) <= self.leaf_size:
            return [self._leaf(text)]
        cut = self._space(text, len(text) // 2)
        if cut is None:
            ids = self._unsplit(text, len(text) // 2)[0]
            return [(ids.tobytes(), self.decode(ids.tolist()))]
        left, right = self._tree(text[:cut]), self._tree(text[cut:])
        self._check(text, cut)
        return left + right

    def _space(self, text: str, at: int) -> int | None:
        """White space near the middle, outside which both halves have something."""
        found = _SPACE.search(text, at, min(len(text), at + NEAR))
        return found.start() if found else None

    def _check(self, text: str, cut: int) -> None:
        """Window over the words at a cut in white space: both sides must be as in the whole."""
        w = self.window
        while True:
            a, b = max(0, cut - w), min(len(text), cut + w)
            self.windows += 1
            left, right, both = (self._library(x)[0] for x in (text[a:cut], text[cut:b], text[a:b]))
            if left + right == both:
                return
            if (a, b) == (0, len(text)):
                raise ValueError("the tokenizer joins tokens over white space")
            w *= 2

    def _spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and, for each, the byte of the text (white space left out) at which it starts; one number more for the end."""
        ids = np.frombuffer(self._library(text)[0], "<u4")
        return ids, np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def _leaves(self, text: str, cut: int | None) -> list[str]:
        """The stretches that halving leaves, in order; cut: where the text is halved, else its middle."""
        if cut is None and len(text) <= self.leaf_size:
            return [text]
        cut = cut or self._middle(text)
        return self._leaves(text[:cut], None) + self._leaves(text[cut:], None)

    def _middle(self, text: str) -> int:
        return self._space(text, len(text) // 2) or len(text) // 2

    def _unsplit(self, text: str, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Encodes text without white space near its middle; as _spans.  The library encodes the leaves in parallel threads; then
        they are joined pair by pair."""
        leaves = self.tokenizer.encode_batch(self._leaves(text, cut), add_special_tokens=False)
        ids = (np.array(leaf.ids, "<u4") for leaf in leaves)
        return self._joined(text, cut, ((i, np.concatenate([[0], np.cumsum(self.sizes[i])])) for i in ids))

    def _joined(self, text: str, cut: int | None, leaves: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and places of text, whose encoded leaves come next."""
        if cut is None and len(text) <= self.leaf_size:
            return next(leaves)
        cut = cut or self._middle(text)
        (l_ids, l_at), (r_ids, r_at) = self._joined(text[:cut], None, leaves), self._joined(text[cut:], None, leaves)
        bytes_in = lambda x: len(re.sub(_SPACE, "", x).encode())
        w = self.window
        while True:
            a, b = max(0, cut - w), min(len(text), cut + w)
            self.windows += 1
            ids, at = self._spans(text[a:b])
            start = int(l_at[-1]) - bytes_in(text[a:cut])  # of the window, in bytes of the whole
            at = at + start
            into = [(0, 0)] if a == 0 else self._agree(l_ids, l_at, ids, at, 0, len(l_ids))
            right_at = r_at + l_at[-1]
            out = [(len(ids), len(r_ids))] if b == len(text) else self._agree(ids, at, r_ids, right_at, 0, len(ids))
            if into and out and into[0][1] <= out[-1][0]:
                (i, j), (k, m) = into[0], out[-1]
                joined = np.concatenate([l_ids[:i], ids[j:k], r_ids[m:]])
                return joined, np.concatenate([[0], np.cumsum(self.sizes[joined])])
            w *= 2

    @staticmethod
    def _agree(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        """Pairs (i, j): the token before and the token at position i of x and j of y are the same bytes and ids."""
        _, i, j = np.intersect1d(x_at[:-1], y_at[:-1], return_indices=True)
        ok = (i > lo) & (i < hi) & (j > 0)
        i, j = i[ok], j[ok]
        ok = (x[i] == y[j]) & (x[i - 1] == y[j - 1]) & (x_at[i - 1] == y_at[j - 1])
        return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit numbers, their decoded text)."""
        ids, said = [], []
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if self.special and self.special.fullmatch(part):
                name = self.tokenizer.token_to_id(part)
                got = [(np.array([name], "<u4").tobytes(), part)]
            elif _PLAIN.fullmatch(part):
                got = self._tree(unicodedata.normalize("NFC", part).lower())
            else:
                got = self._tree(self.tokenizer.normalizer.normalize_str(part))
            ids += [g[0] for g in got if g[0]]
            said += [g[1] for g in got if g[0]]
        return b"".join(ids), " ".join(said)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids and decoded text themselves."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeBpe(path)
        for batch in it:
            rows = [[] for _ in range(5 if ids else 3)]
            for x in batch.column(1):
                packed, decoded = coder.encode(x.as_py())
                rows[0].append(len(packed) // 4)
                rows[1].append(hashlib.sha256(packed).hexdigest())
                rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    rows[3].append(np.frombuffer(packed, "<u4").astype(np.int32))
                    rows[4].append(decoded)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(rows) + 1])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[f"`{doc_id}`"], docs[f"`{text}`"].alias("__text")).mapInArrow(batches, f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
