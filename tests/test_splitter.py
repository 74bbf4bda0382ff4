"""Splits are disjoint and complete; chunk arithmetic at its edges."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import prefix, splitter


def chunks(spark, extents, n):
    df = spark.createDataFrame(extents, "relative_fno long, block_id long, blocks long")
    return sorted((r.relative_fno, r.block_id, r.grp) for r in splitter.chunk_by_weight(df, n).collect())


def test_sample_ranges_leave_out_nulls_and_fractions(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1000.0, 2000.0, 2001.0, 4000.0, None, 2000.5)], "id double")
    got = splitter.labelled(df, "id", splitter.integer_ranges([1000, 2000, 3000])).groupBy("range").count().collect()
    assert {r[0]: r[1] for r in got} == {"r0": 1, "r1": 2, "r2": 1, "r3": 1}
    assert [r.sql("id") for r in splitter.integer_ranges([1000, 2000, 3000])] == ["id < 1000", "id BETWEEN 1000 AND 2000", "id BETWEEN 2001 AND 3000", "id > 3000"]
    whole = splitter.labelled(df, "id", splitter.half_open_ranges([1000, 2000]), missing="none").groupBy("range").count().collect()
    assert {r[0]: r[1] for r in whole} == {"r0": 1, "r1": 1, "r2": 4, "none": 1}


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=5, unique=True), st.lists(st.one_of(st.none(), st.integers(-60, 60)), max_size=40))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_half_open_ranges_hold_each_value_once(spark, bounds, values):
    ranges = splitter.half_open_ranges(sorted(bounds))
    df = spark.createDataFrame([(v,) for v in values], "v int")
    hits = df.select("v", sum((F.coalesce(r.holds(F.col("v")), F.lit(False)).cast("int") for r in ranges), F.lit(0)).alias("n")).collect()
    assert all(r.n == (r.v is not None) for r in hits)


@pytest.mark.parametrize("extents, n, want", [
    ([(1, 0, 5)], 10, [9]), ([(1, 0, 100), (1, 100, 1)], 4, [3, 3]), ([(0, 0, 0), (1, 0, 10)], 2, [0, 1]), ([(1, i, 1) for i in range(4)], 2, [0, 0, 1, 1]),
    ([(1, 0, 1), (1, 1, 1)], 10, [4, 9]), ([(1, i, 3) for i in range(5)], 1, [0] * 5), ([], 3, []), ([(1, 0, 0), (1, 1, 0)], 3, [0, 0])])
def test_chunk_edges(spark, extents, n, want):
    assert [g for *_, g in chunks(spark, extents, n)] == want


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30)), min_size=1, max_size=40), st.integers(1, 7))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_chunks_are_balanced(spark, parts, n):
    at, extents = {}, []
    for f, w in sorted(parts):
        extents.append((f, at.get(f, 0), w))
        at[f] = at.get(f, 0) + max(w, 1)
    total, got, cum = sum(w for *_, w in extents), chunks(spark, extents, n), 0
    weight = {}
    for (f, b, w), (_, _, g) in zip(sorted(extents), got):
        cum += w
        assert g == (0 if not total else max(0, ((100 * cum - 1) * n) // (100 * total)))
        weight[g] = weight.get(g, 0) + w
    assert all(0 <= g < n for g in weight) and max(weight.values()) <= total / n + max(w for *_, w in extents)


def test_ordinals_and_sums_equal_a_global_window(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 13, i) for i in range(3000)] + [(None, 0, -1)], "k int, s int, v long")
    got = [r.n for r in prefix.ordinal(df, ["k", "s", "v"], "n", 5).orderBy("n").collect()]
    assert got == list(range(5, 3006))
    sums = {(r.k, r.s, r.cum) for r in prefix.running_sum(df, ["k", "s"], "v").collect()}
    df.createOrReplaceTempView("t")
    assert sums == {(r.k, r.s, r.c) for r in spark.sql("SELECT k, s, sum(v) OVER (ORDER BY k, s) c FROM t").collect()}


def test_buckets_split_a_frequent_first_column(spark):
    df = spark.createDataFrame([(1, f"b{i:05d}") for i in range(4000)], "f int, b string")
    sizes = [r["count"] for r in prefix.bucketed(df, ["f", "b"], 16).groupBy("_bucket").count().collect()]
    assert 12 <= len(sizes) <= 16 and max(sizes) < 700
    got = [r.n for r in prefix.ordinal(df, ["f", "b"], "n").orderBy("b").collect()]
    assert got == list(range(1, 4001))


def test_extents_outside_all_chunks(spark):
    extents = spark.createDataFrame([(1, 0, 5), (1, 5, 5), (1, 20, 1), (2, 0, 9), (3, 0, 1)], "relative_fno long, block_id long, blocks long")
    chunks = spark.createDataFrame([(0, 1, 0, 1, 9), (4, 2, 0, 2, 8)], "grp long, first_fno long, first_block long, last_fno long, last_block long")
    assert sorted((r.relative_fno, r.block_id, r.grp) for r in splitter.in_chunks(extents, chunks).collect()) == [(1, 0, 0), (1, 5, 0), (2, 0, 4)]


def test_queue_lines_read_back(spark):
    from quern.sources.queue_file import scan_queue

    df = spark.createDataFrame([(1, 0, 5), (1, 5, 5), (2, 0, 9)], "relative_fno long, block_id long, blocks long")
    lines = splitter.queue_lines(splitter.chunk_table(splitter.chunk_by_weight(df, 2)), "S.T", "D.T", F.lit(77))
    got = scan_queue(lines.select((F.col("grp") + 1).alias("line"), "value")).orderBy("roworder").collect()
    assert [tuple(r) for r in got] == [
        (1, "SELECT * FROM S.T WHERE (obj, fno, blk, row) BETWEEN (77, 1, 0, 0) AND (77, 1, 4, 10000)", "D.T"),
        (2, "SELECT * FROM S.T WHERE (obj, fno, blk, row) BETWEEN (77, 1, 5, 0) AND (77, 2, 8, 10000)", "D.T")]


def test_running_sum_deals_rows_once(spark):
    df = spark.range(3000).selectExpr("IF(id % 10 = 0, NULL, id % 97) AS f", "id AS b", "id % 5 AS w")
    out = prefix.running_sum(df, ["f", "b"], "w", buckets=16)
    total, want = 0, {}
    for r in sorted(df.collect(), key=lambda r: (r.f is not None, r.f or 0, r.b)):
        want[r.b] = total = total + r.w
    assert {r.b: r.cum for r in out.collect()} == want
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
