"""URL filters by a bit-parallel wildcard automaton.

All glob patterns are packed into one row of 64-bit words, a bit for each pattern state.
One Shift-And step advances every pattern over one byte of every URL of a batch:
``D = ((D << 1) & B[byte]) | (D & loop)``; a state that a ``*`` follows loops on any byte.
URLs are judged where they lie: no shuffle, and the tables are as large as the rules.

Canonical form: ``.`` + host + U+0002 + path.  Host: after the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased.  Path: then up to ``?``, ``#`` or the end.  A U+0002 of the
URL itself becomes ``%02``, so the separator occurs once.

Very long URLs are used whole, at a step a byte; an empty table gives an empty one; other columns may have any names.
Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule
and no glob, and gets the default verdict.  Of rules that fit, the longest wins (host plus path);
of equally long ones the first listed.  Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import unused
from .words import bytes_of, slices, strings

MARK = "\x02"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def glob(self) -> str:
        """The rule on canonical URLs: its host or a subdomain, then its path as a prefix."""
        return f"*.{self.host}{MARK}{self.path}*"


class Glob(NamedTuple):
    """`pattern` is over host and path of the canonical form; `*` any run, `?` any byte."""

    verdict: str
    pattern: str

    @property
    def glob(self) -> str:
        return self.pattern.replace("/", f"{MARK}/", 1) if "/" in self.pattern else self.pattern


class Automaton:
    """Shift-And over any number of globs at once."""

    def __init__(self, globs: Sequence[str]):
        bits = [len(g.encode().replace(b"*", b"")) + 1 for g in globs]
        self.size = max(1, -(-sum(bits) // 64))
        step = np.zeros((256, self.size), np.uint64)
        loop, begin = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.last: list[tuple[int, int]] = []
        put = lambda row, i: row.__setitem__(i // 64, row[i // 64] | np.uint64(1 << i % 64))
        at = 0
        for glob in globs:
            put(begin, at)
            for byte in glob.encode():
                if byte == ord("*"):
                    put(loop, at)
                    continue
                at += 1
                for b in range(256) if byte == ord("?") else [byte]:
                    put(step[b], at)
            self.last.append((at // 64, at % 64))
            at += 1
        self.step, self.loop, self.begin = step, loop, begin

    def run(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which globs match each whole text: bool, texts x globs."""
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        start, length = at[:-1][order], length[order]
        state = np.tile(self.begin, (len(order), 1))
        live = len(order)
        for k in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -k, "left"))  # texts longer than k
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[raw[start[:live] + k]]) | (now & self.loop)
        out = np.empty((len(order), len(self.last)), bool)
        for j, (word, bit) in enumerate(self.last):
            out[order, j] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out


def judge(pages: DataFrame, url: str, rules: Sequence[Rule], globs: Sequence[Glob] = (), default: str = "allow", keep: Sequence[str] = ()) -> DataFrame:
    """`keep` columns plus host, path, rule (string or null), verdict and pattern (of the glob that
    decided, or null), which replace kept columns of these names.  A block glob beats an allow glob; both only count where no rule fits."""
    keep = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "pattern")]
    pages = pages.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, url])))
    found, (is_url, canonical, host, path) = F.col(f"`{url}`"), unused(pages, "is_url", "canonical", "the_host", "the_path")
    source = pages.select(
        *(F.col(f"`{c}`") for c in keep),
        F.coalesce(F.regexp_extract(found, "://([^/?#]*)", 1), F.lit("")).alias(host),
        F.coalesce(F.regexp_extract(found, "://[^/?#]*([^?#]*)", 1), F.lit("")).alias(path),
        F.coalesce(found.contains("://"), F.lit(False)).alias(is_url),
    )
    source = source.withColumn(host, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    safe = lambda c: F.replace(F.col(c), F.lit(MARK), F.lit("%02"))
    source = source.withColumn(canonical, F.when(F.col(is_url), F.concat(F.lit("."), safe(host), F.lit(MARK), safe(path))).otherwise("")).drop(is_url)
    ranked = sorted(rules, key=lambda r: -len(r.host + r.path))
    decided = sorted(globs, key=lambda g: g.verdict != "block")
    machine = Automaton([r.glob for r in ranked] + [g.glob for g in decided])
    names = pa.array([r.host + r.path for r in ranked] + [None])
    verdicts = pa.array([r.verdict for r in ranked] + [g.verdict for g in decided] + [default])
    said = pa.array([g.pattern for g in decided] + [None])
    n, m = len(ranked), len(decided)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text = strings(batch.column(canonical))
            for lo, hi in slices(text):
                hit = machine.run(*bytes_of(text.slice(lo, hi - lo)))
                hit[pa.compute.equal(text.slice(lo, hi - lo), "").to_numpy(zero_copy_only=False)] = False
                rule = np.where(hit[:, :n].any(1), hit[:, :n].argmax(1), n) if n else np.zeros(hi - lo, int)
                glob = np.where(hit[:, n:].any(1), hit[:, n:].argmax(1), m) if m else np.zeros(hi - lo, int)
                glob = np.where(rule < n, m, glob)
                cols = [batch.column(c).slice(lo, hi - lo) for c in (*keep, host, path)]
                yield pa.RecordBatch.from_arrays([*cols, names.take(pa.array(rule)), verdicts.take(pa.array(np.where(rule < n, rule, n + glob))), said.take(pa.array(glob))], names=[*keep, "host", "path", "rule", "verdict", "pattern"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*(F.col(f"`{c}`") for c in keep)).schema) + "," * bool(keep)
    return source.mapInArrow(batches, f"{kinds} host string, path string, rule string, verdict string, pattern string")


#: The rules that the query is asked for.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: What decides where no rule fits.
GLOBS = (Glob("block", "*.casino-*/*"), Glob("block", "*.cheap-pills.*/*"), Glob("block", "*.spam-farm.*/*"), Glob("block", "*/??/*.exe"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", RULES, GLOBS, keep=["page_id"])


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, q) GROUP BY page_id),
g AS (
  SELECT page_id, CASE
    WHEN path LIKE '/%' AND ('.' || host) LIKE '%.casino-%' THEN '*.casino-*/*'
    WHEN path LIKE '/%' AND ('.' || host) LIKE '%.cheap-pills.%' THEN '*.cheap-pills.*/*'
    WHEN path LIKE '/%' AND ('.' || host) LIKE '%.spam-farm.%' THEN '*.spam-farm.*/*'
    WHEN path LIKE '/__/%.exe' THEN '*/??/*.exe' END AS pattern FROM p)
SELECT p.page_id, host, path, rule, coalesce(best.verdict, CASE WHEN g.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN g.pattern END AS pattern
FROM p LEFT JOIN best USING (page_id) LEFT JOIN g USING (page_id)
"""
