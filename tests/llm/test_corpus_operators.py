"""Importance resampling, near duplicates, line dedup, tool calls and the pipeline."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from keyloom.llm import graph, line_dedup, near_dup, resampling, tool_calls
from keyloom.llm import words as W

SEPARATOR = r"[^\x20\x09-\x0D]+"


# ---- resampling ----


def test_kth_largest(spark):
    r = random.Random(1)
    values = sorted((r.randint(-(2**62), 2**62 - 1) if r.random() < 0.5 else r.randint(-5, 5) for _ in range(300)), reverse=True)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [resampling.kth_largest(df, "v", k) for k in (1, 150, 300)] == [values[k - 1] for k in (1, 150, 300)]
    assert resampling.kth_largest(df, "v", 301) is None and resampling.kth_largest(df, "v", 0) is None


@pytest.fixture(scope="module")
def judged(spark):
    """Clean documents, junk from another distribution, and labels of a part of them."""
    r = random.Random(9)
    words = {True: [f"good{i}" for i in range(300)], False: [f"b&d{i}" for i in range(300)]}
    rows = [(i, " ".join(r.choice(words[i % 5 > 0]) if r.random() < 0.9 else r.choice(words[r.random() < 0.5]) for _ in range(r.randint(40, 200))), "k") for i in range(600)]
    rows += [(1000, None, "k"), (1001, "", "k"), (None, rows[1][1], None), (7, rows[7][1], "k")]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)] + [(4, None, None), (5000, 1, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, weight string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_parts_good_from_bad(judged):
    docs, labels = judged
    kept = resampling.resample(docs, labels)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    unlabelled = [i for i in range(1, 600, 2)]
    good, bad = [i in ids for i in unlabelled if i % 5], [i in ids for i in unlabelled if i % 5 == 0]
    assert kept.columns == docs.columns and np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert 1000 not in ids and 1001 not in ids and ids.count(7) in (0, 2)
    digest = resampling.resample(docs, labels, digest=True)
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in digest.collect()) and digest.columns == ["doc_id", "log_weight", "sample_key", "kept"]


def test_resampling_weights(judged):
    """Counts and weights against plain Python over the same hashed n-grams."""
    import pyarrow as pa

    docs, labels = judged
    good, fine, bad = resampling.labelled(labels)
    assert len(good) == len(fine) == 240 and len(bad) == 61 and not set(fine) & set(bad)  # every fifth is bad; 4 has a null label as well
    ratio = resampling.fit(docs, good)
    rows = docs.collect()
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for r in rows:
        _, bucket = resampling._grams(W.strings(pa.array([r.text])))
        np.add.at(raw, bucket, 1)
        if r.doc_id in set(good.tolist()):
            np.add.at(target, bucket, 1)
    want = np.log((target + resampling.PRIOR) / (raw * target.sum() / raw.sum() + resampling.PRIOR))
    assert np.allclose(ratio, want)
    _, bucket = resampling._grams(W.strings(pa.array([rows[0].text])))
    weight, key = resampling.scores(pa.array([rows[0].doc_id]), pa.array([rows[0].text]), ratio)
    assert weight[0] / resampling.UNIT == pytest.approx(resampling.TEMPERATURE * ratio[bucket].mean(), abs=1e-8) and key[0] != weight[0]


def test_resampling_is_gumbel_top_k(judged):
    """The documents taken against a sort of all keys in plain Python; k by the labels, and given."""
    import pyarrow as pa

    docs, labels = judged
    docs = docs.dropDuplicates(["doc_id"])
    target, good, bad = resampling.labelled(labels)
    ratio = resampling.fit(docs, target)
    rows = [r for r in docs.collect() if re.search(SEPARATOR, r.text or "")]
    weight = {r.doc_id: resampling.TEMPERATURE * ratio[resampling._grams(W.strings(pa.array([r.text])))[1]].mean() for r in rows}
    key = {i: w + resampling.gumbel(np.array([-(2**62) if i is None else i]))[0] for i, w in weight.items()}
    known = [r.doc_id for r in rows if r.doc_id in set(good) | set(bad)]
    share = sum(i in set(good) for i in known) / len(known)
    for k, given in ((int(np.ceil(len(rows) * share)), None), (40, 40), (0, 0), (len(rows), 10**6)):
        best = sorted(key, key=key.get, reverse=True)[:k]
        assert sorted(map(str, best)) == sorted(str(r.doc_id) for r in resampling.resample(docs, labels, digest=True, k=given).collect())
    top = sorted(weight, key=weight.get, reverse=True)[:40]
    assert len(set(top) & set(sorted(key, key=key.get, reverse=True)[:40])) < 20  # a sample, no threshold


def test_resampling_shares_follow_weights(spark, judged):
    """Of documents with two texts, in equal numbers, a small sample takes shares in proportion to exp(weight)."""
    docs, labels = judged
    good, bad = (r.text for r in docs.where("doc_id in (1, 5)").orderBy("doc_id").collect())
    texts = [f"{good} {good} {bad}", f"{good} {bad} {bad}"]
    many = spark.range(10_000, 30_000).selectExpr("id AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{texts[0]}' ELSE '{texts[1]}' END AS text").unionByName(docs.select("doc_id", "text"))
    rows = [r for r in resampling.resample(many, labels, digest=True, k=2000, seed=3).collect() if (r.doc_id or 0) >= 10_000]
    weight = [[r.log_weight for r in rows if r.doc_id % 2 == i] for i in (0, 1)]
    assert all(len(set(w)) == 1 for w in weight)
    got, want = np.log(len(weight[0]) / len(weight[1])), weight[0][0] - weight[1][0]
    assert 1 < want < 4 and abs(got - want) < 0.35, (got, want)


def test_resampling_without_labels(judged):
    docs, labels = judged
    assert resampling.resample(docs, labels.limit(0)).count() == 602  # all with a word
    assert resampling.resample(docs.limit(0), labels).count() == 0


# ---- filters ----


def test_filter_has_no_false_negatives(spark):
    from keyloom.llm.filters import Filter

    r = np.random.default_rng(3)
    a, b = r.integers(-(2**63), 2**63, 2000), r.integers(0, 50, 2000)
    table = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, None)], "a long, b int")
    one, two = Filter.of(table, "a"), Filter.of(table, "a", "b")
    assert one.may_have(a).all() and two.may_have(a, b).all()
    assert one.may_have(a + 1).mean() < 0.01 and two.may_have(a, b + 60).mean() < 0.01
    assert not Filter.of(table.limit(0), "a").may_have(a).any()


# ---- near duplicates ----


def shingle_set(text):
    w = re.findall(SEPARATOR, text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(texts):
    """texts: id to text; the least id of each group, and the number of links."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 100))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    wx, wy = np.ones(len(x)), np.ones(len(y))
    wx[:100], wy[:50] = 3, 2
    signature = near_dup.signatures(np.concatenate([x, y]), np.concatenate([wx, wy]), np.array([0, len(x), len(x) + len(y)]), 4000)
    weights = {e: [u, 0.0] for e, u in zip(x.tolist(), wx, strict=True)}
    for e, v in zip(y.tolist(), wy, strict=True):
        weights.setdefault(e, [0.0, 0.0])[1] = v
    table = np.array(list(weights.values()))
    want = sum(1 / np.maximum(table[:, 0] / u, table[:, 1] / v).sum() for u, v in table if u and v)
    assert abs((signature[0] == signature[1]).mean() - want) < 0.03


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(5, 5), (1, 0)]
    root = {}
    find = lambda i: i if root.get(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {n for e in edges for n in e}
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in nodes if find(n) != n}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(docs, prose, no_docs):
    want = brute_groups(dict(enumerate(prose)))
    rows = near_dup.groups(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == want
    assert sum(want[i] != i for i in want) >= 25
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    kept = near_dup.deduplicate(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted([3] + [i for i in want if want[i] == i]) and None in ids
    assert near_dup.groups(no_docs).count() == near_dup.deduplicate(no_docs).count() == 0


def test_hot_group(spark):
    """Many copies of one text, each with other edits: one group, and others stay apart."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        words[r.randrange(120)] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{i}_{k}" for k in range(60)) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.groups(docs).collect()}
    assert got == brute_groups(dict(enumerate(texts))) and len(set(got.values())) == 51


def test_crowded_bucket(spark, monkeypatch):
    """Strangers that share a long passage and its buckets, and similar pairs among them: every pair is met, in one block or in many."""
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(80))
    own = [[f"d{i}_{k}" for k in range(20)] for i in range(150)]
    texts = [passage + " " + " ".join(words) for words in own]
    texts += [passage + " " + " ".join(own[i][:-4]) + f" e{i} f{i}" for i in range(0, 150, 3)]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(dict(enumerate(texts)))
    assert len(set(want.values())) == 150
    for block in (1 << 19, 20_000):
        monkeypatch.setattr(near_dup, "BLOCK", block, raising=False)
        assert {x.doc_id: x.class_id for x in near_dup.groups(docs, bands=6, rows=1).collect()} == want


def test_hot_group_with_strangers(spark, monkeypatch):
    """A large group of edits of one text, which shares its buckets with many strangers and with pairs that are similar: no link is lost,
    in one block or in many, and the group's own blocks do not meet each other."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(300):
        words = list(base)
        for _ in range(2):
            words[r.randrange(60, 100)] = f"edit{r.randrange(40)}"
        texts.append(" ".join(words))
    strangers = [base[:60] + [f"s{i}_{k}" for k in range(40)] for i in range(40)]
    texts += [" ".join(w) for w in strangers] + [" ".join(w[:-3] + ["x", "y", "z"]) for w in strangers[::2]]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(dict(enumerate(texts)))
    met = []
    real = near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda df: met.append(df.columns) or real(df))
    for block in (1 << 19, 15_000):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {x.doc_id: x.class_id for x in near_dup.groups(docs, bands=8, rows=2).collect()}
        assert got == want
    assert ["key", "load", "main", "mains", "others"] in met


def test_other_repeat_counts(spark):
    """Near copies that differ in how often a passage repeats: the sets count, not the occurrences."""
    texts = []
    for i in range(8):
        passage, rest = " ".join(f"p{i}_{k}" for k in range(10)), " ".join(f"r{i}_{k}" for k in range(90))
        texts += [f"{passage} {passage} {rest}", f"{passage} " * 100 + rest]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dup.groups(docs).collect()} == {i: i - i % 2 for i in range(16)} == brute_groups(dict(enumerate(texts)))


# ---- line dedup ----


def brute_lines(texts):
    lines = [(i, k, frozenset(re.findall(SEPARATOR, x))) for i in sorted(texts) for k, x in enumerate((texts[i] or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = set()
    for n, (i, k, s) in enumerate(lines):
        if any(len(s & t) >= 0.8 * len(s | t) - 1e-9 for _, _, t in lines[:n]):
            gone.add((i, k))
    return gone


def test_repeated_lines(docs, prose, no_docs):
    want = brute_lines(dict(enumerate(prose)))
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == want and len(want) > 60
    assert line_dedup.repeated_lines(no_docs).count() == 0


def test_near_lines(spark):
    """Similarities around the threshold, long and short lines, ties."""
    r = random.Random(8)
    texts = {}
    for i in range(80):
        n = r.choice([1, 2, 3, 4, 5, 6, 9, 10, 20, 45, 90, 200])
        base = [f"t{r.randrange(12)}" if n < 7 else f"u{n}_{j}" for j in range(n)]
        for j in range(0, n, r.choice([3, 5, 8, 11])):
            base[r.randrange(n)] = f"x{r.randrange(6)}"
        texts[i] = "\n".join([" ".join(base), " ".join(r.sample(base, n))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs).collect()} == brute_lines(texts)


def test_short_lines_at_lower_similarity(spark):
    docs = spark.createDataFrame([(1, "a b c d\nq r"), (2, "a b c\nq r s")], "doc_id long, text string")
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs, 0.6).collect()} == {(2, 0), (2, 1)}


def test_rest_after_a_failed_first_match(spark):
    """The first candidate that passes the filters may fail; a later one must be found."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(20)]
    texts = {}
    for i in range(40):
        words = list(base)
        for j in r.sample(range(20), r.choice([2, 3, 4])):
            words[j] = f"z{r.randrange(30)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs).collect()} == brute_lines(texts)


def test_names_that_clash(spark):
    """Columns of any names come through, with their values."""
    names = ["doc", "lines", "rest", "gone", "__left", "__lines", "__doc", "__gone", "line", "id", "key", "n", "root", "bands", "class_id", "kept", "key", "weight"]
    names = list(dict.fromkeys(names))
    rows = [(1, "a b c d e f\nq r s t", 11, *names), (2, "a b c d e f\nx y z", 9, *names), (3, "a b c d e f\nq r s t", 11, *names)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {', '.join(f'`{n}` string' for n in names)}")
    lines = sorted(map(tuple, line_dedup.remove_lines(docs).collect()))
    assert lines == [rows[0], (2, "x y z", 5, *names)]
    assert sorted(map(tuple, near_dup.deduplicate(docs).collect())) == rows[:2]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, resampling.resample(docs, labels).collect())) == rows


def test_copies_over_tasks_and_chunks(spark, monkeypatch):
    """Equal sets in one chunk, in chunks of one task and in several tasks, with ids out of order and repeated rows."""
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 60)
    r = random.Random(13)
    lines = [" ".join(f"w{r.randrange(30)}" for _ in range(r.choice([1, 2, 5, 8]))) for _ in range(25)]
    texts = {i: "\n".join(r.choice(lines) for _ in range(3)) for i in r.sample(range(1000), 60)}
    rows = list(texts.items())
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").repartition(3)
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs).collect()} == brute_lines(texts)


def test_hardly_any_dissimilar_candidates(spark):
    """Long lines of different words that share rare ones do not go on to be verified."""
    r = random.Random(21)
    texts = [" ".join(r.sample([f"w{i}" for i in range(2000)], 160)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    posts = line_dedup.postings(docs, line_dedup.rarity(docs), 8, 0.8)
    assert posts.groupBy("bucket").applyInArrow(line_dedup._first(0.8), line_dedup._FOUND).where("kind <> 1").count() <= 5


def test_parities(monkeypatch):
    """In blocks of any size, by every hash: of each class whether a line has an odd number of its words."""
    r = np.random.default_rng(5)
    mixed, at = r.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([0, 1, 40, 41, 200, 300])
    want = []
    for bits, above in ((9, 0), (8, 9), (7, 17), (7, 24)):
        place = [((int(x) << above) % (1 << 64)) >> (64 - bits) for x in mixed]
        sets = [sum(1 << k for k in range(1 << bits) if place[a:b].count(k) % 2) for a, b in zip(at[:-1], at[1:], strict=True)]
        want += [[x >> 64 * k & (1 << 64) - 1 for x in sets] for k in range((1 << bits) // 64)]
    for cells in (1, 1100, 1 << 21):
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        assert [x.tolist() for x in line_dedup._parities(mixed, at, line_dedup._FINE)] == want


def test_asked_tokens_pass(spark):
    tokens = [0, 1, 255, 256, 2**31, 2**32 - 1, *(random.Random(3).randrange(2**32) for _ in range(500))]
    asked = line_dedup._Asked.of(spark.createDataFrame([(t,) for t in tokens], "token long"))
    assert asked.may_have(np.array(tokens, np.uint32)).all()
    assert asked.may_have(np.arange(5, 2**32, 2**32 // 1000, dtype=np.uint32)).sum() < 20


def test_later_rounds(spark, monkeypatch):
    """Nearly all lines need the later rounds, among copies in several tasks."""
    monkeypatch.setattr(line_dedup, "FEW", 0)
    monkeypatch.setattr(line_dedup, "THEN", 1)
    r = random.Random(17)
    lines = []
    for n in (6, 12, 25, 60):
        for _ in range(14):
            words = [f"v{n}_{i}" for i in range(n)]
            for j in r.sample(range(n), r.randint(0, n // 5 + 1)):
                words[j] = f"z{r.randrange(25)}"
            lines.append(" ".join(words))
    texts = {i: "\n".join(r.sample(lines, 2)) for i in r.sample(range(1000), 90)}
    rows = list(texts.items())
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(5)
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs).collect()} == brute_lines(texts)


def test_removed_lines(spark, docs, prose):
    gone = brute_lines(dict(enumerate(prose)))
    out = line_dedup.remove_lines(docs)
    rows = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and rows[None] == "nobody here " * 9
    for i, t in enumerate(prose):
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
        if any((i, k) in gone for k in range(len((t or "").split("\n")))):
            assert rows.get(i) == (left if re.search(SEPARATOR, left) else None)
        else:
            assert rows[i] == t
    counted = line_dedup.remove_lines(spark.createDataFrame([(1, "a b c d\nq r", 11), (2, "a b c d\nx", 9)], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, counted.collect())) == [(1, "a b c d\nq r", 11), (2, "x", 1)]


# ---- tool calls ----


def test_tool_calls(spark):
    text = '{"b":1,"a":{"y":[1,2.50,{"k":null}],"x":"é\\u0001"}}'
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "f", text, []), (1, "b", 1, "f", '{"b":"s"}', ["a"]), (1, "c", 2, "g", "[1]", ["a", "b"]), (1, "d", 3, "f", "nope", ["c", "zz"]),
            (1, "x", 4, "f", '{"b":2}', ["y"]), (1, "y", 5, "f", '{"b":2}', ["x"]), (1, "z", 6, "f", '{"b":2,"q":1}', ["y", "a"]), (1, "a", 9, "f", "{}", None),
            (None, "a", 1, "f", "{}", None), (2, "a", 1, None, None, None), (1, "e", 7, "f", '{"b":1.0}', ["d", None, "d"]), (1, "m", 8, "g", '{"b":1}', ["e", "b"]), (1, "s", 8, "f", '{"b":1}', ["s"]), (1, "h", 8, "f", "{}", ["m"]),
        ],
        "conv_id long, call_id string, seq long, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "a", 1, "ok"), (1, "a", 0, "first"), (3, "q", 1, "lost"), (1, None, 1, "n")], "conv_id long, call_id string, seq long, content string")
    schemas = spark.createDataFrame([("f", "b", "integer", True), ("f", "a", "object", None), (None, "a", "x", True)], "name string, field string, type string, required boolean")
    rows = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    level = {k[1]: r.level for k, r in rows.items() if k[0] == 1}
    assert [level[x] for x in "abcdemh"] == [0, 1, 2, 3, 4, 5, 6] and all(rows[1, x].status == "cycle" and level[x] is None for x in "xyzs")
    assert rows[1, "a"].json == '{"arguments":{"a":{"x":"é\\u0001","y":[1,2.5,{"k":null}]},"b":1},"content":"first","id":"a","level":0,"name":"f","status":"linked"}'
    assert rows[1, "a"].repeats == 2 and rows[1, "b"].errors == ["wrong type b"] and rows[1, "d"].errors == ["arguments are no JSON object", "no call zz"]
    assert rows[1, "z"].errors == ["unknown q"] and rows[1, "h"].errors == ["missing b"] and rows[1, "e"].errors == [] and rows[1, "m"].errors == ["no schema"]
    assert rows[3, "q"].status == "orphan_result" and rows[None, "a"].status == rows[1, None].status == "no_id" and rows[2, "a"].status == "no_result"
    none = tool_calls.link(calls.limit(0), results.limit(0), schemas.limit(0))
    assert none.count() == 0


def test_long_chains(spark):
    """Chains in a number of rounds that grows with the logarithm of their length."""
    nodes = spark.range(300).selectExpr("id % 2 AS conv_id", "cast(id as string) AS call_id")
    edges = spark.range(2, 300).selectExpr("id % 2 AS conv_id", "cast(id as string) AS call_id", "cast(id - 2 as string) AS dep")
    assert {int(r.call_id): r.level for r in tool_calls.levels(edges, nodes).collect()} == {i: i // 2 for i in range(300)}


def test_levels_against_brute_force(spark):
    """Random graphs with cycles, chains and calls that wait for several others; one conversation holds most calls."""
    r = random.Random(21)
    edges = {(0 if r.random() < 0.7 else 1, a, b) for a, b in ((r.randrange(90), r.randrange(90)) for _ in range(140)) if b < a or r.random() < 0.03}
    edges |= {(0, i, i - 1) for i in range(60, 80)}
    nodes = [(c, i) for c in (0, 1) for i in range(90)]
    deps = {}
    for c, a, b in edges:
        deps.setdefault((c, a), []).append((c, b))
    level: dict = {}
    for _ in nodes:  # until nothing changes
        for x in nodes:
            if x not in level and all(d in level for d in deps.get(x, [])):
                level[x] = max((level[d] + 1 for d in deps.get(x, [])), default=0)
    frame = spark.createDataFrame([(c, str(a), str(b)) for c, a, b in edges], "conv_id long, call_id string, dep string")
    got = {(x.conv_id, int(x.call_id)): x.level for x in tool_calls.levels(frame, spark.createDataFrame([(c, str(i)) for c, i in nodes], "conv_id long, call_id string")).collect()}
    assert got == {x: level.get(x) for x in nodes} and 0 < sum(v is None for v in got.values()) < 100


def test_tool_calls_with_odd_rows(spark):
    """Long arguments, columns whose names clash, and no rows at all."""
    long = "y" * 300_000
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"x":"%s"}' % long, [], 1, "s", "j", 2)], "conv_id long, call_id string, seq long, name string, arguments string, after array<string>, level int, status string, json string, n int")
    results = spark.createDataFrame([(1, "a", 1, long, 3, "p")], "conv_id long, call_id string, seq long, content string, extra int, parsed string")
    schemas = spark.createDataFrame([("f", "x", "string", True)], "name string, field string, type string, required boolean")
    (row,) = tool_calls.link(calls, results, schemas).collect()
    assert row.status == "linked" and row.errors == [] and row.level == 0 and row.json.count("y") >= 600_000
    assert [r.status for r in tool_calls.link(calls.limit(0), results, schemas).collect()] == ["orphan_result"]
    chat = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link(*tool_calls.turns(chat)).count() == 0


def test_tool_calls_are_native(spark, sf):
    from keyloom.plans import plan_text

    assert not re.search("Python|Pandas|Arrow", plan_text(tool_calls.query(spark, sf)))


# ---- pipeline ----


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    want = {r.doc_id for r in rows}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == want and {"sequence_id", "offset"} <= set(packed[0].asDict())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in want) <= 2


def test_pipeline_empty(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_pipeline_run_on_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert tool_calls.query(spark, str(tmp_path)).count() == 0 and line_dedup.query(spark, str(tmp_path)).count() == 0 and near_dup.query(spark, str(tmp_path)).count() == 0
