"""Line, suffix and near-duplicate removal, SimHash links, components."""

import os
import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import components, line_dedup, near_dedup, queries, simhash, suffix_dedup
from conftest import ODD


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup_edges(spark, odd, none):
    out = line_dedup.dedup_lines(odd)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.spans) for r in out.collect()]
    assert len(got) == len(ODD) + 1 and {g[4] for g in got} == {"clash"}
    by = {g[0]: g for g in got}
    assert by[1][1:4] == (None, 0, 0) and by[2][1:4] == ("", 1, 0)
    assert by[9][3] == 2 and by[10][3] == 1 and by[10][1] == ""
    assert line_dedup.dedup_lines(none).count() == 0 and set(out.columns) == {*odd.columns, "n_removed"}


def every_run(rows, min_words=8):
    """Later copies of runs of any number of lines go, if the whole run has min_words words."""
    lines = [(d, t.split("\n")) for d, t in rows]
    words = lambda x: 0 if not x.strip(" ") else x.count(" ") + 1
    gone, first = set(), {}
    for k, (_, x) in enumerate(lines):
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if first.setdefault(tuple(x[i:j]), (k, i)) < (k, i) and sum(map(words, x[i:j])) >= min_words:
                    gone |= {(k, n) for n in range(i, j)}
    return {d: "\n".join(v for n, v in enumerate(x) if (k, n) not in gone) for k, (d, x) in enumerate(lines)}


@pytest.mark.parametrize("min_words", [0, 1, 8])
def test_line_dedup_of_any_run_length(spark, docs, min_words):
    rnd = random.Random(6)
    pool = ["", "", " ", "   "] + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6))) for _ in range(9)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 16)))) for i in range(80)]
    rows += [(200, "p p p\nq q q\nr r r"), (201, "z\np p p\nq q q\nr r r\ny"), (202, "\n" * 300 + "p p p\nq q q\nr r r" + "\n" * 300)]
    rows += [(i + 1000, t) for i, t in docs if t.count("\n") < 60]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), min_words).collect()}
    want = every_run(rows, min_words)
    assert got == want
    assert min_words != 8 or want[201] == "z\ny"


def test_line_dedup_of_a_long_text_and_rows_repeated_whole(spark):
    long = "\n".join(f"line {i} of a text of many lines, all different" for i in range(20000))
    rows = [(1, long), (2, "first\n" + long + "\nlast"), (3, long), (3, long), (None, "eight words are in this line of text"), (4, "eight words are in this line of text\nx")]
    got = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()))
    assert got == [(0, rows[4][1], 0), (1, long, 0), (2, "first\nlast", 20000), (3, "", 20000), (3, "", 20000), (4, "x", 1)]


def test_line_dedup_joins_alike_at_any_size(spark, docs):
    """What grows with the input is merged also while it is small, so that the shuffles grow with the input and not faster."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = frame(spark, docs)
    classes = plan(line_dedup.ranked(line_dedup.line_rows(df), ["h1", "h2"]))
    assert "SortMergeJoin" in classes and "BroadcastHashJoin" not in classes
    cut = plan(line_dedup.dedup_lines(df))
    assert "SortMergeJoin" in cut and cut.count("BroadcastHashJoin [_id") == 0


def test_op1_removes_runs_of_three_short_lines(spark, tmp_path):
    frame(spark, [(1, "p p p\nq q q\nr r r"), (2, "z\np p p\nq q q\nr r r")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.text) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()} == {(1, "p p p\nq q q\nr r r"), (2, "z")}


@pytest.mark.parametrize("width", [80, 400])
def test_suffixes_equal_brute_force(spark, docs, width):
    rnd = random.Random(width)
    shared = "".join(rnd.choice("abc é") for _ in range(3 * width))
    rows = [(i, t) for i, t in docs[:60]]
    for i in range(60):
        a, n = rnd.randrange(2 * width), rnd.randrange(width - 5, width + 60)
        rows.append((5000 + i, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(40))) + shared[a:a + n] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(40)))))
    rows += [(9001, "q" * (2 * width)), (9002, "ab" * width), (9003, shared), (9004, shared), (9005, shared + shared), (9006, None), (9007, ""), (9008, shared[: width - 1]), (9009, "z" * (width - 1))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), brute.sha(bytes(r.kept))) for r in suffix_dedup.dedup_suffixes(frame(spark, rows), width).collect()}
    assert got == dict(zip((i for i, _ in rows), brute.suffixes(rows, width)))


def test_suffix_neighbours_across_buckets(spark):
    head = lambda *x: bytes(x) + bytes(64 - len(x))
    rows = [(h, c, c, 1 + (c == 40)) for c, h in enumerate([head(1, 1)] * 30 + [head(2, i) for i in range(20)] + [head(3, 7)] * 25 + [head(9, 9)])]
    df = spark.createDataFrame(rows, "head binary, c1 long, c2 long, copies long")
    got = {(r.c1, r.met) for r in suffix_dedup.neighbours(df).collect()}
    assert got == {(c, True) for c in [*range(30), *range(50, 75)]} | {(40, False)}


@given(st.lists(st.binary(min_size=16, max_size=16) | st.sampled_from([b"a" * 16, b"a" * 15 + b"b", b"a" * 8 + b"\xff" * 8]), max_size=60), st.sampled_from([1, 5, 64]))
@settings(max_examples=100, deadline=None)
def test_multikey_quicksort_and_common_prefixes(rows, least):
    words = np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(-1, 2)
    own = [rows[i] for i in suffix_dedup.multikey_quicksort(words, least)]
    assert own == sorted(rows)
    words = np.frombuffer(b"".join(own), ">u8").astype(np.uint64).reshape(-1, 2)
    want = [len(os.path.commonprefix([x, y])) for x, y in zip(own, own[1:])]
    assert suffix_dedup.common_prefixes(words).tolist()[1:] == want


def test_suffixes_of_rows_without_an_id(spark):
    rnd = random.Random(1)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(600)) for _ in range(2))
    rows = [(5, "x" + a), (None, "y" + a), (None, b), (7, b[:300])]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_suffixes(frame(spark, rows)).collect())
    assert got == [(0, 600, 0), (0, 601, 600), (5, 601, 600), (7, 300, 0)]


def test_shared_passages(spark, docs):
    """Every passage of 50 words that two texts share is told, and nothing under 25 words."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(1, 9)))
    passage = [word() for _ in range(54)]
    rows = list(docs)
    for i in range(120):
        n = (20, 24, 50, 54)[i % 4]
        a = rnd.randrange(54 - n + 1)
        rows.append((10000 + i, " ".join([*(word() for _ in range(rnd.randrange(90))), *passage[a:a + n], *(word() for _ in range(rnd.randrange(90)))])))
    rows += [(20000, None), (20001, ""), (20002, rows[-1][1]), (20003, " ".join(word() for _ in range(49)))]
    got = {r.doc_id: r.n_shared for r in suffix_dedup.dedup_suffixes(frame(spark, rows), passage=50).collect()}
    grams = lambda n: {i: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, (t or "").split()) for i, t in rows)}

    def sharing(n):
        own, seen = grams(n), {}
        for i, g in own.items():
            for x in g:
                seen.setdefault(x, set()).add(i)
        return {i for v in seen.values() if len(v) > 1 for i in v}

    told = {i for i, n in got.items() if n}
    flat = {i for i, t in rows if t and "\n" not in t}
    assert sharing(50) & flat <= told <= sharing(25) and {10002, 10003} <= told and not {10000, 10001, 20003} & told


def test_suffix_edges(spark, odd, none):
    got = {}
    for r in suffix_dedup.dedup_suffixes(odd).collect():
        got.setdefault(r.doc_id, r)
    assert got[1].n_bytes == 0 and got[12].n_removed == got[13].n_removed == 900 and got[4].n_removed == 0
    assert suffix_dedup.dedup_suffixes(none).count() == 0


def test_simhash_equals_brute_force(spark, docs):
    rows = docs + [(9000 + i, t) for i, t in ODD]
    fps = brute.simhash(rows)
    roots = brute.components(fps, 2)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert got == {i: (fps[i], roots[i]) for i in fps}


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_links_equal_all_pairs_also_in_large_groups(spark, tau):
    rnd = np.random.default_rng(tau)
    base = int(rnd.integers(0, 2**62))
    fps = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 20, (150, 2))} | {int(x) for x in rnd.integers(0, 2**63, 200)}
    fps |= {x ^ 7 for x in list(fps)[:40]} | {x ^ 3 for x in list(fps)[:40]}
    df = spark.createDataFrame([(simhash.signed(x),) for x in sorted(fps)], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(df, tau)).collect()}
    want = brute.components({simhash.signed(x): x for x in fps}, tau)
    assert {x: got.get(x, x) for x in want} == want


def test_thresholds_cover_tau():
    p = np.full(64, 0.5)
    for tau in range(5):
        for m in range(1, tau + 2):
            parts = simhash.correlated_parts(1000, np.outer(p, p) * 1000 + np.diag(p * (1 - p)) * 1000, m)
            assert sorted(b for x in parts for b in x) == list(range(64))
            _, ts = simhash.allocate(10**6, p, parts, tau)
            assert sum(t + 1 for t in ts) == tau + 1


def test_simhash_edges(spark, odd, none):
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()]
    assert len(got) == len(ODD) + 1 and {c for i, c in got if i in (1, 2, 3)} == {1} and {c for i, c in got if i in (5, -3)} == {-3}
    assert simhash.simhash_components(none).count() == 0


def test_similar_groups(spark, odd, none):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    texts = [[word() for _ in range(rnd.randrange(60, 900))] for _ in range(40)]
    rows, family = [], {}
    for k, t in enumerate(texts):
        for c in range(1 if k % 2 else 400 if k == 0 else 5):
            own = list(t)
            for _ in range(len(own) // 80 if c > 1 else 0):  # a hundredth of the words, so a similarity of 0.85 or more
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
            family[len(rows) - 1] = k
    got = {r.doc_id: r.group_id for r in near_dedup.similar_groups(frame(spark, rows)).collect()}
    assert {(family[i], family[g]) for i, g in got.items()} == {(k, k) for k in range(40)}
    assert sum(i == g for i, g in got.items()) <= 42
    edges = [(r.doc_id, r.group_id) for r in near_dedup.similar_groups(odd).collect()]
    assert len(edges) == len(ODD) + 1 and near_dedup.similar_groups(none).count() == 0
    assert {g for i, g in edges if i in (1, 2)} == {1}


def exact_groups(rows, words=5, similarity=0.8):
    """All pairs by the cosine of their sets of shingles of plain words, linked into groups."""
    sets = {}
    for i, t in rows:
        w = re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).encode().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) * len(sets[j])) ** 0.5 - 1e-9 and bool(sets[i]) == bool(sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4, 128])
def test_similar_groups_equal_all_pairs(spark, docs, block):
    """Families around the bound: copies of one base whose cosine to each other is below 0.8, to the base above or below; some differ in case and marks."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    rows = list(docs)
    for k, edits in enumerate((4, 6, 8, 9, 10, 16)):
        base = [word() for _ in range(200)]
        rows += [(10000 + 1000 * k, " ".join(base))]
        for c in range(1, 40):
            own = list(base)
            for _ in range(edits):
                own[rnd.randrange(200)] = word()
            own[c % 200] = own[c % 200].title() + ","
            rows.append((10000 + 1000 * k + c, " ".join(own)))
    got = {r.doc_id: r.group_id for r in near_dedup.similar_groups(frame(spark, rows), block=block).collect()}
    assert got == exact_groups(rows)


def test_similar_groups_of_short_texts(spark):
    """Pairs at 0.8 or a little more with no third text to join them: 4 shingles against 6, 8 against 12, 16 against 25."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for n, more in [(4, 2)] * 300 + [(8, 4)] * 100 + [(16, 9)] * 300:
        text = [word() for _ in range(n + 4 + more)]
        rows += [(len(rows), " ".join(text[: n + 4])), (len(rows) + 1, " ".join(text))]
    got = {r.doc_id: r.group_id for r in near_dedup.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_similar_groups_search_by_pigeonhole(spark):
    """Pairs within 2 bits of their SimHashes meet by these alone: with one sample of all shingles, they share no other key."""
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    fp = lambda t: simhash.majority(near_dedup.mixed(near_dedup.plain_hashes(t, 5), 0))
    rows, within = [], []
    while len(within) < 24:
        text = [word() for _ in range(604)]
        other = list(text)
        other[rnd.randrange(20, 580)] = word()
        pair = [" ".join(text), " ".join(other)]
        bits = (fp(pair[0]) ^ fp(pair[1])).bit_count()
        if bits in (1, 2):
            within.append(len(rows))
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = {r.doc_id: r.group_id for r in near_dedup.similar_groups(frame(spark, rows), bands=1, sample=10**6).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("a,b,both", [(4, 5, 4), (13, 14, 12), (20, 25, 20)])
def test_differing_bits_of_random_sets(a, b, both):
    rng = np.random.default_rng(a)
    share = []
    for _ in range(400):
        h = rng.integers(0, 2**64, a + b - both, np.uint64)
        share.append((simhash.majority(h[:a]) ^ simhash.majority(h[a - both:])).bit_count() / 64)
    assert abs(np.mean(share) - near_dedup.differing(a, b, both)) < 0.01
    assert near_dedup.allowed(0.8)[a] >= near_dedup.most_bits(near_dedup.differing(a, b, both)) > 256 * near_dedup.differing(a, b, both)


def test_group_roots_equal_all_pairs_in_large_groups(spark):
    """One group of many blocks whose links form chains across them."""
    rnd = np.random.default_rng(5)
    prints = rnd.integers(0, 2**63, (12, 4), np.uint64)
    rows = []
    for i in range(600):
        x = prints[i % 12].copy()
        x[0] ^= np.uint64((1 << (i // 12)) - 1)
        rows.append((1, i, x.tobytes(), 0))
    df = spark.createDataFrame(rows, "key long, doc_id long, body binary, weight long")
    got = {r.node: r.root for r in near_dedup.group_roots(df, lambda bodies: near_dedup.close_prints(bodies, 1), 8).collect()}
    assert got == {i: i % 12 for i in range(600)}
    assert near_dedup.group_roots(df, lambda bodies: near_dedup.close_prints(bodies, 0), 8).count() == 0
