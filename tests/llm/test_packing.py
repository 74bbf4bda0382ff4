"""Packing, decontamination and the pipeline."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import decontaminate, packing, queries
from conftest import ODD


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(max_examples=100, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, a, b, first, each, offset in packing.plan_bins(counts, 64):
        for r in range(a, b):
            assert r not in ranks[length]
            ranks[length].add(r)
            bins[first + (r - a) // each].append((offset + (r - a) % each * length, length))
    assert {k: len(v) for k, v in ranks.items()} == counts
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64
    assert len(bins) == brute.best_fit(lengths, 64)


def test_capacity_tree():
    tree, held = packing.CapacityTree(100), set()
    rnd = random.Random(1)
    for _ in range(2000):
        x = rnd.randrange(1, 101)
        (held.add if rnd.random() < 0.5 else held.discard)(x)
        tree.mark(x, x in held)
        y = rnd.randrange(1, 101)
        assert tree.at_least(y) == min((h for h in held if h >= y), default=-1)


def check_packed(rows, texts, limit):
    from tokenizers import Tokenizer

    tok, by, seqs = Tokenizer.from_file(queries.vocabulary_file()), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, a, len(ids[a:a + limit]), zlib.crc32(ids[a:a + limit].tobytes())) for k, a in enumerate(range(0, len(ids), limit))]
        assert sorted(set(by[i])) == want, (i, (t or "")[:100])
    for own in seqs.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= limit
    assert len(seqs) == brute.best_fit([r.length for r in rows], limit)


def test_packing(spark, docs, odd, none):
    tricky = ["it's, 'tis. don't.", "a.b,c...d.,e", "ΑΣ. Σας, ΣΊΣΥΦΟΣ", "İstanbul, été.", "<|endoftext|> x<|startoftext|>.", "tabs\tand\r\nlines\x0b\x1c\x85here", "3.14,15 ½ ² x_y.", "“q”. «w», …"]
    rows = docs[:80] + [(9000 + i, t) for i, t in ODD] + [(8000 + i, t) for i, t in enumerate(tricky)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_packed(packing.pack_documents(df, queries.vocabulary_file(), 512).collect(), dict(rows), 512)
    check_packed(packing.pack_documents(odd, queries.vocabulary_file()).collect(), dict(ODD), 2048)
    assert packing.pack_documents(none, queries.vocabulary_file()).count() == 0


def test_common_order():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        masks = defaultdict(int)
        for i, w in enumerate(a):
            masks[w] |= 1 << i
        assert decontaminate.common_order(masks, len(a), b).bit_count() == brute.lcs(a, b)


def leak_case(rnd):
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(14, 70)))) for i in range(60)]
    docs, planted = [], set()
    for d in range(300):
        words = [word() for _ in range(rnd.randrange(5, 400))]
        if d % 3 == 0:
            i, t = items[rnd.randrange(60)]
            own = t.split()
            if d % 2:  # a paraphrase: every eighth word is another
                own = [word() if k % 8 == 3 else w for k, w in enumerate(own)]
            at = rnd.randrange(len(words))
            words[at:at] = [w.title() + "," if rnd.random() < 0.1 else w for w in own]
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, planted


def test_leaks_are_found_and_clean_documents_left(spark, odd, none):
    docs, items, planted = leak_case(random.Random(11))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    whole = set()
    for d, t in docs:  # brute force: every item against every stretch of twice its length
        words = decontaminate.words_of(t)
        for i, x in items:
            item = decontaminate.words_of(x)
            n = len(item)
            if any(brute.lcs(item, words[a:a + 2 * n]) >= 0.8 * n for a in range(0, max(1, len(words) - n), max(1, n // 2)) if len(set(item) & set(words[a:a + 2 * n])) >= 0.5 * len(set(item))):
                whole.add((d, i))
    assert len(got & planted) >= 0.97 * len(planted)
    assert len(got & whole) >= 0.9 * len(whole) and {d for d, _ in got - whole} <= {d for d, _ in planted | whole}
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, decontaminate.Settings(block=25)).collect()}
    assert len(blocks & planted) >= 0.95 * len(planted)
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(odd, bench).count() == 0


def test_pipeline(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns = None
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {d for d, _ in docs}
    for name, stage in pipeline.STAGES[:-1]:
        columns = columns or df.columns
        df = stage(spark, df, sf)
        assert df.columns == columns, name
        now = {r.doc_id for r in df.select("doc_id").collect()}
        assert now <= kept and now, name
        kept = now
        df = spark.createDataFrame(df.collect(), df.schema)
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(texts) > 0.6 * len(docs)
    check_packed(pipeline.STAGES[-1][1](spark, df, sf).collect(), texts, 2048)
    check_packed(pipeline.run(spark, sf).collect(), texts, 2048)


def test_pipeline_equals_brute_force(spark, sf, docs, tmp_path):
    """Every stage's rows against plain versions, on documents with planted cases of each kind."""
    from test_dedup import every_run, exact_groups
    from test_scans import plain_score

    from quern.llm import toxicity

    pipeline, rnd = pytest.importorskip("corpus_pipeline"), random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    own = [(i, t) for i, t in docs if t and len(t) < 2000]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    rows, made = list(own), iter(range(10**6, 2 * 10**6))

    def put(text):
        rows.append((next(made), text))
        return rows[-1][0]

    toxic = []
    for k in range(60):
        toxic.append(put(f"{prose(2)} such a vilething you foulword {word()}" if k % 2 else prose(3)))
        labels.append((toxic[-1], k % 2))
    base = " ".join(word() for _ in range(120))
    put(base)
    for _ in range(4):
        words = base.split()
        for k in rnd.sample(range(120), 3):
            words[k] = word()
        put(" ".join(words))
    twin = prose(1)
    put(f"{twin} end"), put(f"{twin} end.")
    block = prose(3)
    put(f"{prose(2)}\n{block}\n{prose(1)}"), put(f"{block}\n{prose(2)}"), put(block)
    leaks = {put(f"{prose(2)} {t} {prose(2)}") for _, t in items[:8]}
    rows += [(None, prose(2)), (1, prose(2)), (next(made), None), (next(made), "")]
    other = {"lang": "en", "source": "s"}
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for name, df in (("documents", spark.createDataFrame([tuple({"doc_id": i, "text": t, "n_chars": len(t or "")}.get(c, other.get(c)) for c in schema.names) for i, t in rows], schema)),
                     ("labels", spark.createDataFrame([(i, 1, k) for i, k in labels], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    at = str(tmp_path)
    df = spark.read.parquet(f"{at}/documents.parquet")
    lexicon = toxicity.learn(df, spark.read.parquet(f"{at}/labels.parquet"))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")

    def after(stage, df):
        out = spark.createDataFrame(stage(spark, df, at).collect(), df.schema)
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=key)

    df, got = after(pipeline.drop_toxic, df)
    assert got == sorted([r for r in rows if plain_score(r[1] or "", lexicon.weights, lexicon.coef) < 0.3], key=key)
    assert not set(toxic[1::2]) & {i for i, _ in got} and set(toxic[::2]) <= {i for i, _ in got}

    before = got
    df, got = after(pipeline.drop_repeated_lines, df)
    want = every_run([(k, t or "") for k, (_, t) in enumerate(before)])
    assert got == sorted([(i, t if t is None else want[k]) for k, (i, t) in enumerate(before) if want[k].strip(" ") or want[k] == (t or "")], key=key)

    before = got
    df, got = after(pipeline.drop_near_copies, df)
    groups = exact_groups([(k, t) for k, (_, t) in enumerate(before)])
    assert got == [r for k, r in enumerate(before) if groups[k] == k] and len(got) < len(before) - 5

    before = got
    df, got = after(pipeline.drop_leaks, df)
    some, whole = set(), set()
    for i, t in before:
        words = decontaminate.words_of(t or "")
        for _, x in items:
            item = decontaminate.words_of(x)
            n = len(item)
            if any(words[a:a + n] == item for a in range(len(words) - n + 1)):
                whole.add((i, t))
            elif len(set(item) & set(words)) >= 0.5 * len(set(item)) and any(brute.lcs(item, words[a:a + 2 * n]) >= 0.8 * n for a in range(0, max(1, len(words) - n), max(1, n // 2))):
                some.add((i, t))
    assert not whole & set(got) and set(before) - set(got) <= whole | some and leaks & {i for i, _ in whole} == leaks
    texts = [(k, t) for k, (_, t) in enumerate(got)]
    numbered = spark.createDataFrame([tuple({"doc_id": k, "text": t, "n_chars": 0}.get(c, other.get(c)) for c in schema.names) for k, t in texts], schema)
    check_packed(pipeline.pack(spark, numbered, at).collect(), dict(texts), 2048)


def test_pipeline_stages_on_nothing(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0, name


def test_queries_on_a_whole_table(spark, sf, docs):
    for name, q in queries.queries().items():
        if name != "pipeline":
            assert q(spark, sf).count() > 0, name


def test_pipeline_decides_by_row(spark, sf, docs):
    """Rows that share a doc_id, or have none, are decided by their own texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(21)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    near = lambda t: t + " " + text(1)

    def rows(pairs):
        other = {"lang": "en", "source": "s"}
        return spark.createDataFrame([tuple({"doc_id": i, "text": t, "n_chars": len(t)}.get(c, other.get(c)) for c in whole.columns) for i, t in pairs], whole.schema)

    def after(stage, pairs):
        return sorted(((r.doc_id, r.text) for r in stage(spark, rows(pairs), sf).collect()), key=str)

    kept = {r.doc_id for r in pipeline.drop_toxic(spark, whole, sf).select("doc_id").collect()}
    toxic = next(t for i, t in docs if t and i not in kept)
    assert after(pipeline.drop_toxic, [(7, toxic), (7, "a clean text"), (None, toxic)]) == [(7, "a clean text")]

    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if r.text)
    leak, clean = f"{text(30)} {item} {text(30)}", text(60)
    assert after(pipeline.drop_leaks, [(7, leak), (7, clean), (None, leak)] + [(100 + k, text(60)) for k in range(5)])[-1] == (7, clean)

    a, b, c, d = (text(40) for _ in range(4))
    got = after(pipeline.drop_near_copies, [(5, a), (5, b), (2, near(a)), (9, near(b)), (None, c), (None, near(c)), (8, d), (8, d)])
    assert sorted((str(i), t[:40]) for i, t in got) == sorted((str(i), t[:40]) for i, t in [(5, b), (2, a), (None, c), (8, d)])


def test_pipeline_searches_near_copies_by_pigeonhole(spark, sf, monkeypatch):
    """The near-dedup stage has the operator's search, thresholds by dynamic programming, look at the SimHashes of all its texts."""
    from quern.llm import near_dedup, simhash

    pipeline, planned, searched = pytest.importorskip("corpus_pipeline"), [], []
    plan, links = simhash.plan_probes, simhash.links
    monkeypatch.setattr(simhash, "plan_probes", lambda fps, tau: planned.append(plan(fps, tau)) or planned[-1])
    monkeypatch.setattr(near_dedup, "links", lambda fps, tau: searched.append({r.fp for r in fps.collect()}) or links(fps, tau), raising=False)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    pipeline.drop_near_copies(spark, whole, sf)
    texts = {r.text or "" for r in whole.select("text").collect()}
    assert searched == [{simhash.signed(simhash.majority(near_dedup.mixed(near_dedup.plain_hashes(t, 5), 0))) for t in texts}]
    assert len(planned) == 1 and sum(t + 1 for _, t in planned[0]) == 3
