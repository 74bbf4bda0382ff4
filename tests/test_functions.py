"""Text, time, queue lines, monitoring."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import text, timing
from quern.operators import loader, monitor
from quern.sources import queue_file


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize("seconds, want", [(0, ""), (0.5, "0 seconds"), (60, "1 minutes  and "), (61, "1 minutes  and 1 seconds"), (3600, "1 hours, "), (3661, "1 hours, 1 minutes , 1 seconds"), (-1, "59 minutes  and 59 seconds")])
def test_duration(spark, seconds, want):
    assert one(spark, timing.duration_text(F.lit(int(seconds * 1_000_000)).cast("long"))) == want


@pytest.mark.parametrize("name, space, match", [("RUN_100_1.App", "RUN_100_1", True), ("App", None, False), ("RUN_100_1.a.b", "RUN_100_1", False), ("RUN_10_1.App", "RUN_10_1", False), (None, None, False)])
def test_names(spark, name, space, match):
    c = F.lit(name).cast("string")
    assert one(spark, text.namespace_of(c)) == space and one(spark, text.has_run_prefix(c, "RUN_100_")) is match


def test_template_and_targets(spark):
    assert one(spark, text.render_template(F.lit("(~QUERYTEXT~)->~TARGETTABLE~"), F.lit("q $1 \\ ~TARGETTABLE~"), F.lit("T"))) == "(q $1 \\ T)->T"
    got = one(spark, text.split_target(F.lit("DB.T ColumnMap(a=x, b=y) keycolumns(a)")))
    assert (got.name, got["columns"], got["keys"]) == ("DB.T", ["a=x", "b=y"], ["a"])
    assert one(spark, text.split_target(F.lit("DB.T")))["columns"] == []
    assert one(spark, text.stripped(F.lit(" \t x y\n"))) == "x y" and one(spark, text.joined(F.lit("a"), F.lit(None), F.lit(1))) == "a1"


def test_queue_file(spark, tmp_path):
    path = tmp_path / "queue.txt"
    path.write_bytes(b'SELECT * FROM A.T|B.T\r\nSELECT 1   |C\r\n\r\n"x BETWEEN \'x\' AND \'y\'"|"D"||||||\r\n"a|b"|E\r\n"say ""hi"""|F\r\nsame|G\r\nsame|G')
    got = [tuple(r) for r in queue_file.scan_queue(queue_file.read_lines(spark, str(path))).orderBy("roworder").collect()]
    assert got == [(1, "SELECT * FROM A.T", "B.T"), (2, "SELECT 1   ", "C"), (4, "x BETWEEN 'x' AND 'y'", "D"), (5, "a|b", "E"), (6, 'say "hi"', "F"), (7, "same", "G"), (8, "same", "G")]
    rows = queue_file.items_of(queue_file.scan_queue(queue_file.read_lines(spark, str(path))), 100, 5).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(5, 12)) and {r.status for r in rows} == {"NEW"}
    path.write_text("only\n")
    with pytest.raises(Exception, match="without a target"):
        queue_file.scan_queue(queue_file.read_lines(spark, str(path))).collect()


APP, BARE = {"entityType": "APPLICATION", "fullName": "n.a", "statusChange": "RUNNING"}, {"fullName": "n.b"}


@pytest.mark.parametrize("output, valid, apps, nodes, stores", [
    ({"applications": [APP, BARE], "clusterNodes": [{"entityType": "N", "fullName": "f", "version": "1"}, {"entityType": "N", "name": "x"}], "search": {"rx": 1}}, True, 1, 1, 1),
    ({"applications": []}, True, 0, 0, 0), ({"applications": [{"entityType": "A", "fullName": None}]}, False, 0, 0, 0), ({"applications": [{"entityType": "A"}]}, False, 0, 0, 0), ({}, False, 0, 0, 0),
    ({"applications": {"fullName": "x"}}, False, 0, 0, 0), ({"applications": [APP, "text"]}, False, 0, 0, 0), ({"applications": [APP], "clusterNodes": 5, "search": [1]}, True, 1, 0, 0)])
def test_snapshots(spark, output, valid, apps, nodes, stores):
    df = spark.createDataFrame([(json.dumps([{"output": output}]),)], "j string")
    s = monitor.Snapshot("j")
    assert df.select(s.valid()).first()[0] is valid
    assert [s.open_apps(df).count(), s.open_nodes(df).count(), s.open_store(df).count()] == [apps, nodes, stores]
    if nodes:
        assert s.open_nodes(df).first().name == "f"


def test_snapshots_that_are_not_lists(spark):
    df = spark.createDataFrame([("{}",), ("[]",), ("no json",), (None,), ("[1]",)], "j string")
    assert {r[0] for r in df.select(monitor.Snapshot("j").valid()).collect()} == {False}


@pytest.mark.parametrize("results, want", [([("Success", "x")], (True, "")), ([("Failure", "a"), ("Success", "b")], (False, "a;b;")), ([("Success", "x"), ("Failure", None), ("Success", "c")], (False, "c;")), ([], (True, ""))])
def test_results_fold(spark, results, want):
    df = spark.createDataFrame([(results,)], "r array<struct<executionStatus:string,failureMessage:string>>")
    assert tuple(df.select(monitor.folded_results(F.col("r"))).first()[0]) == want


def test_loader(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "m"), (None, "m")], "k int, v string")
    assert sorted(map(str, loader.insert_ignore(target, rows, ["k"]).collect())) == sorted(["Row(k=2, v='c')"] + ["Row(k=None, v='m')"] * 2)
    assert loader.mapped(rows, ["x=v", "k"], ["k"]).columns == ["k", "x"]
