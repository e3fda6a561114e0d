"""Token counts of a unigram tokenizer by count-only Viterbi.

The vocabulary (pieces with scores) is packed into an Aho-Corasick automaton, which
enumerates every piece that ends at each code point of a word.  Dynamic programming carries
the best score and, of the path that has it, the number of pieces; no path is kept.

Tie rules are those of the tokenizers library's Unigram model: of paths to the same end with
equal scores the one whose last piece starts first wins; scores are summed left to right in
double precision; a code point that no one-character piece covers may be an unknown piece that
scores the lowest score less 10, and comes after all pieces; runs of unknown pieces fuse and fall
back to one piece a byte where the vocabulary has all 256 byte pieces, else count as one.

Text becomes words as with the Metaspace pre-tokenizer (prefix always, split): U+2581 replaces
each space and starts a word, and one is set before the text unless it starts with one already.
So words are counted one by one and each distinct word of a task once, in a cache of bounded
size.  Documents are counted where they lie, without a shuffle.

Defined results: a null or empty text has 0 tokens.  Repeated rows are counted alike.  An empty table gives an
empty one, and other columns may have any names.  A text of any length is counted whole; memory follows the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"
#: Distinct words that a task remembers before it forgets them all, and their longest length.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


class Counter:
    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        have = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.singles = frozenset(p for p in have if len(p) == 1)
        self.cache: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of one word."""
        if not self.singles.issuperset(text):
            return self.with_unknown(text)
        best = [0.0] + [-math.inf] * len(text)
        count = [0] * len(best)
        for last, (length, score) in self.automaton.iter(text):  # by end; of one end the longest first
            before = last + 1 - length
            score += best[before]
            if score > best[last + 1]:
                best[last + 1], count[last + 1] = score, count[before] + 1
        return count[-1]

    def with_unknown(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        fused = bytearray(n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for last, (length, score) in self.automaton.iter(text):
            ends[last + 1].append((length, score))
            if length == 1:
                single[last] = 1
        for end in range(1, n + 1):
            top, pieces, is_unknown = None, 0, 0
            for length, score in sorted(ends[end], reverse=True) if len(ends[end]) > 1 else ends[end]:
                before = best[end - length]
                if before is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[end - length] + 1
            if not single[end - 1] and (before := best[end - 1]) is not None and (top is None or before + self.unknown > top):
                top, is_unknown = before + self.unknown, 1
                pieces = count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.bytes else 1 - fused[end - 1])
            best[end], count[end], fused[end] = top, pieces, is_unknown
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if not words[0]:
            del words[0]
        cache, total = self.cache, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus n_tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(list(vocabulary))  # as large as the vocabulary, whatever the data

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in it:
            column = batch.column(batch.num_columns - 1)
            counts = pa.array([counter.text(x.as_py()) for x in column], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*keep, "n_tokens"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, docs[f"`{text}`"].alias("__text")).mapInArrow(batches, f"{kinds} n_tokens long")


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(len(model))]


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_vocabulary(path))
