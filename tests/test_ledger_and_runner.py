"""Ledger versions, and the runner with its cap, gap, failures and restarts; streams and JDBC."""

import threading
import time
from datetime import datetime

import pytest

from quern.operators import ledger as L
from quern.operators.splitter import integer_ranges
from quern.plans.runner import Runner, Settings
from quern.sources import jdbc
from quern.sources.ledger_store import open_ledger
from quern.streaming.bounded import drained_load


def rows(spark, *items):
    full = [(i, i, run, f"q'{i}\"", None, "T", status, None, None, None, None, True) for i, run, status in items]
    return spark.createDataFrame(full, L.LEDGER)


def states(df):
    return {r.id: r.status for r in df.collect()}


@pytest.mark.parametrize("kind", ["parquet", "JSON"])
def test_store(spark, tmp_path, kind):
    s = open_ledger(spark, kind, str(tmp_path / "ledger"))
    assert L.next_id(s.read()).first()[0] == 1
    s.change(lambda df: L.append(df, rows(spark, (1, 100, "NEW"), (2, 100, None), (3, 101, "RUNNING"))))
    assert L.next_id(s.read()).first()[0] == 4 and L.lookup(s.read(), 9).isEmpty()
    at = datetime(2024, 1, 2, 3, 4, 5, 678901)
    change = spark.createDataFrame([(1, "FAILED", None, at), (77, "X", "y", at)], "id long, status string, notes string, started_datetime timestamp")
    s.change(lambda df: L.update_by_id(df, change))
    got = {r.id: r for r in s.read().collect()}
    assert got[1].status == "FAILED" and got[1].started_datetime == at and got[1]["query"] == "q'1\"" and got[2].status is None and len(got) == 3
    s.change(lambda df: L.merge_upsert(df, rows(spark, (2, 100, "NEW"), (4, 101, "NEW"))))
    assert states(s.read()) == {1: "FAILED", 2: "NEW", 3: "RUNNING", 4: "NEW"}
    s.change(lambda df: L.clear_run(df, 100))
    assert {r.id: r.iscurrentrow for r in s.read().collect()} == {1: False, 2: False, 3: True, 4: True}
    assert L.current_run(s.read(), 101).count() == 2 and L.rows_where(s.read(), "  ").count() == 4
    s.truncate()
    assert s.read().isEmpty() and len(s.versions()) >= 1


def test_writing_nulls_and_versions(spark):
    df = rows(spark, (1, 100, "NEW"), (2, 100, "RUNNING"))
    change = spark.createDataFrame([(1, None)], "id long, status string")
    assert states(L.update_by_id(df, change)) == {1: "NEW", 2: "RUNNING"}
    assert states(L.update_by_id(df, change, write_nulls=True)) == {1: None, 2: "RUNNING"}
    new = L.new_version(df, rows(spark, (2, 100, "COMPLETED"))).collect()
    assert sorted((r.id, r.status, r.iscurrentrow) for r in new) == [(1, "NEW", True), (2, "COMPLETED", True), (2, "RUNNING", False)]


def test_changes_of_one_id_count_once(spark):
    df = rows(spark, (1, 100, "NEW"), (2, 100, "RUNNING"))
    twice = spark.createDataFrame([(1, "FAILED"), (1, "COMPLETED"), (1, None), (9, "NEW"), (9, "FAILED")], "id long, status string")
    assert sorted((r.id, r.status) for r in L.update_by_id(df, twice).collect()) == [(1, "FAILED"), (2, "RUNNING")]
    merged = L.merge_upsert(df, rows(spark, (1, 100, "FAILED"), (1, 100, "NEW"), (3, 100, "NEW"), (3, 100, "NEW")))
    assert sorted((r.id, r.status) for r in merged.collect()) == [(1, "NEW"), (2, "RUNNING"), (3, "NEW")]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (open_ledger(spark, "parquet", str(tmp_path / "l")) for _ in range(2))
    put = lambda s, ids: [s.change(lambda df, i=i: L.append(df, rows(spark, (i, 100, "NEW")))) for i in ids]
    threads = [threading.Thread(target=put, args=(s, ids)) for s, ids in ((one, range(1, 5)), (two, range(5, 9)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(states(one.read())) == list(range(1, 9)) and len(one.versions()) <= 4
    (tmp_path / "l" / "_lock").write_text("")
    held = type(one)(spark, one.path, tries=2, wait=0)
    with pytest.raises(TimeoutError, match="another writer"):
        held.change(lambda df: df)


def test_new_columns(spark):
    from quern.operators.loader import evolved

    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 5)], "k int, w int")
    assert sorted(map(str, evolved(a, b).collect())) == ["Row(k=1, v='x', w=None)", "Row(k=2, v=None, w=5)"]
    assert evolved(a, b, "ignore").columns == ["k", "v"]
    with pytest.raises(ValueError, match="new columns: w"):
        evolved(a, b, "halt")


def test_snapshots_are_read_again_until_valid(spark):
    from quern.operators.monitor import Snapshot
    from quern.sources.snapshots import valid_snapshots

    good, bad, now, seen = '[{"output":{"applications":[]}}]', "[]", [0.0], []

    def read():
        seen.append(now[0])
        if len(seen) == 1:
            raise OSError("refused")
        return spark.createDataFrame([(bad if len(seen) < 4 else good,)], "j string")

    def sleep(x):
        now[0] += x

    again = lambda: valid_snapshots(read, Snapshot("j"), 900, 30, lambda: now[0], sleep)
    assert again().first().j == good and seen == [0, 30, 60, 90]
    seen.clear()
    with pytest.raises(TimeoutError, match="not valid"):
        valid_snapshots(lambda: spark.createDataFrame([(bad,)], "j string"), Snapshot("j"), 60, 30, lambda: now[0], sleep)


def test_queue_choice(spark):
    df = rows(spark, (3, 1, "NEW"), (1, 1, "RUNNING"), (2, 1, None), (4, 1, "COMPLETED-FAILEDDROP"), (5, 1, "FAILED"))
    assert [r.id for r in L.pending(df).collect()] == [2, 3] and L.next_pending(df).first().id == 2
    assert L.any_not_done(df).first()[0] is True and L.any_not_done(df.where("id > 3")).first()[0] is False and L.any_not_done(df.limit(0)).first()[0] is False
    slots = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    assert [L.first_free(u, "n", r).first()[0] for u, r in ((slots(), 0), (slots(1), 0), (slots(1, 2, 3), 2), (slots(2, 4), 1), (slots(5), 1))] == [1, 2, 4, 3, 2]


def test_runner(spark, tmp_path):
    store, seen, lock, most = open_ledger(spark, "parquet", str(tmp_path / "l")), [], threading.Lock(), [0, 0]

    def load(item):
        with lock:
            most[0] += 1
            most[1] = max(most)
        time.sleep(0.3)
        with lock:
            most[0] -= 1
            seen.append(item.id)
        if item.id == 2:
            raise ValueError("no such table")
        spark.range(10).write.mode("overwrite").parquet(f"{tmp_path}/out/{item.id}")

    def cleanup(item):
        if item.id == 3:
            raise OSError("busy")

    clear = []
    run = Runner(spark, store, load, Settings(run=100, cap=2, gap=0.0, poll=0.1), cleanup, lambda item: clear.append(item.id))
    run.start(rows(spark, *[(i, 100, "NEW") for i in range(1, 6)]))
    done = {r.id: r for r in run.go()}
    assert {i: r.status for i, r in done.items()} == {1: "COMPLETED", 2: "FAILED", 3: "COMPLETED-FAILEDDROP", 4: "COMPLETED", 5: "COMPLETED"}
    assert sorted(seen) == sorted(clear) == [1, 2, 3, 4, 5] and most[1] <= 2 and "no such table" in done[2].notes
    assert not any(r.iscurrentrow for r in done.values()) and all(r.finished_datetime for r in done.values())
    run.start(rows(spark, *[(i, 100, "NEW") for i in range(11, 13)]))  # the run is past: the next start loads the queue again
    assert L.current_run(store.read(), 100).count() == 2


def test_runner_resumes(spark, tmp_path):
    store, seen = open_ledger(spark, "parquet", str(tmp_path / "l")), []
    store.change(lambda df: rows(spark, (1, 100, "COMPLETED"), (2, 100, "RUNNING"), (3, 100, "NEW"), (4, 7, "RUNNING")))
    run = Runner(spark, store, lambda item: seen.append(item.id), Settings(run=100, cap=1, gap=0.0, poll=0.05))
    run.start(rows(spark, (9, 100, "NEW")))  # the ledger has the run: the queue isn't read again
    run.go()
    assert seen == [2, 3] and states(store.read())[4] == "RUNNING" and 9 not in states(store.read())


def test_runner_keeps_the_gap(spark, tmp_path):
    store, at = open_ledger(spark, "parquet", str(tmp_path / "l")), []

    def load(item):
        at.append(time.monotonic())
        time.sleep(3 if item.id == 1 else 0)

    run = Runner(spark, store, load, Settings(run=100, cap=3, gap=1.5, poll=0.1))
    run.start(rows(spark, (1, 100, "NEW"), (2, 100, "NEW")))
    run.go()
    assert at[1] - at[0] >= 1.4


def test_retry():
    left, waits = [2], []

    def action():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "done"

    assert jdbc.retried(action, 3, 5, waits.append) == "done" and waits == [5, 5]
    with pytest.raises(ZeroDivisionError):
        jdbc.retried(lambda: 1 / 0, 2, 0, waits.append)


def test_jdbc_ranges(spark):
    url = "jdbc:derby:memory:t;create=true"
    df = spark.range(1, 5001).selectExpr("id AS K", "id % 7 AS V")
    jdbc.table_sink(df, url, "T", driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = jdbc.ranged_source(spark, url, "T", "K", integer_ranges([1000, 2000, 3000]), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 5000
    assert jdbc.query_source(spark, url, "SELECT K FROM T WHERE K < 10", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 9


def test_stream_stops_and_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").write.parquet(src)
    schema = "k int, v string"
    load = lambda: drained_load(spark.readStream.schema(schema).parquet(src), out, mark, ["k"]).awaitTermination(60)
    load()
    spark.createDataFrame([(2, "c"), (3, "d")], schema).write.mode("append").parquet(src)
    load()
    load()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).select("k", "v").collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_snapshot_source(spark, tmp_path):
    from quern.sources.snapshots import SnapshotSource

    (tmp_path / "s.json").write_text('[{"output":{"applications":[]}}]')
    spark.dataSource.register(SnapshotSource)
    got = spark.read.format("snapshot").option("url", (tmp_path / "s.json").as_uri()).load().collect()
    assert [r.snapshot for r in got] == ['[{"output":{"applications":[]}}]']


def test_states(spark, tmp_path):
    from quern.plans.status import confirmed, job_state, stream_state

    spark.sparkContext.setJobGroup("own_1", "x")
    spark.range(3).count()
    spark.sparkContext.setJobGroup("own_2", "x")
    assert confirmed(lambda: job_state(spark, "own_1"), "COMPLETED", 5, 0.2) and job_state(spark, "nobody") == "UNKNOWN"
    assert not confirmed(lambda: "FAILED", "COMPLETED", 2, 0)
    spark.range(3).write.parquet(str(tmp_path / "s"))
    q = drained_load(spark.readStream.schema("id long").parquet(str(tmp_path / "s")), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert stream_state(q) == "COMPLETED"


def test_staged_files(tmp_path):
    from quern.sources import files

    at = str(tmp_path / "stage")
    assert files.listed(at, "job") == []
    one, ten = files.stage(at, "job_1", "a"), files.stage(at, "job_10", "b")
    assert files.drop_staged(at, "job_1") == ["job_1.txt"] and files.listed(at, "job") == ["job_10.txt"] and files.template(ten) == "b" and one != ten
