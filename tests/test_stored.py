"""Tables on disk: what upserts read and rewrite, and what a second run does."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gigmatch.operators import upserts
from gigmatch.sources import files, stored

SCHEMA = "scrobbled_at timestamp, artist_name string, album_name string"


def at(day, hour=12):
    return dt.datetime(2026, 1, day, hour)


def plays(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return stored.StoredTable(str(tmp_path / "plays"), SCHEMA, ["scrobbled_at", "artist_name"])


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def scanned(df, metric="numPartitions"):
    """A metric of all file scans of a query that ran."""
    df.collect()
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and node.metrics().contains(metric):
            out.append(node.metrics().apply(metric).value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_first_of_key_is_the_same_whatever_the_order(spark):
    rows = [(at(1), "a", "z"), (at(1), "a", None), (at(1), "a", "b"), (at(1), None, None), (at(2), "a", None)]
    want = [(at(1), "a", "b"), (at(1), None, None), (at(2), "a", None)]
    for order in (rows, rows[::-1]):
        got = upserts.first_of_key(plays(spark, *order).repartition(3), ["scrobbled_at", "artist_name"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_insert_touches_only_days_that_change(spark, table):
    assert stored.insert_ignore(table, plays(spark, *[(at(d), "a", "x") for d in range(1, 11)])) == 10
    before = files_of(table.path)
    again = plays(spark, (at(3), "a", "other"), (at(4), "b", None), (at(4), "b", "won"), (at(20), "c", None))
    assert stored.insert_ignore(table, again) == 2
    after = files_of(table.path)
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.split("day=")[1][:10] for p in before if p not in same} == {"2026-01-04"}
    got = {(r.scrobbled_at.day, r.artist_name): r.album_name for r in table.read(spark).collect()}
    assert got[(3, "a")] == "x" and got[(4, "b")] == "won" and got[(20, "c")] is None and len(got) == 12
    assert stored.insert_ignore(table, again) == 0 and files_of(table.path) == after


def test_only_partitions_of_incoming_rows_are_read(spark, table):
    stored.insert_ignore(table, plays(spark, *[(at(d), "a", "x") for d in range(1, 29)]))
    parts = stored.partitions(table.placed(plays(spark, (at(5), "q", None), (at(6), "q", None))), ["day"], "test")
    assert min(scanned(table.read_partitions(parts))) <= 2
    assert 28 in scanned(table.read(spark))


def test_null_partitions_and_keys_are_stored_once(spark, table):
    rows = plays(spark, (None, "a", "x"), (None, "a", "y"), (at(1), None, "z"))
    assert stored.insert_ignore(table, rows) == 2 and stored.insert_ignore(table, rows) == 0
    assert sorted((r.artist_name or "", r.album_name) for r in table.read(spark).collect()) == [("", "z"), ("a", "x")]


def test_update_rewrites_what_differs(spark, tmp_path):
    table = stored.StoredTable(str(tmp_path / "shows"), "source string, id long, n int, seen int", ["source", "id"], "src", "source", "string", "''")
    rows = lambda *r: spark.createDataFrame(list(r), "source string, id long, n int, seen int")
    assert stored.update(table, rows(("a", 1, 1, 1), ("b", 1, 1, 1), (None, 1, 1, 1)), ["n"]) == 3
    before = files_of(table.path)
    assert stored.update(table, rows(("a", 1, 5, 9), ("b", 1, 1, 9), ("c", 1, 1, 1)), ["n"]) == 2
    after = files_of(table.path)
    assert {p for p in before if "src=b" in p} <= set(after) and all(after[p] == t for p, t in before.items() if "src=b" in p)
    assert sorted(((r.source or ""), r.n, r.seen) for r in table.read(spark).collect()) == [("", 1, 1), ("a", 5, 1), ("b", 1, 1), ("c", 1, 1)]
    held = stored.update(table, rows(("a", 1, 7, 9)), ["n"], {"n": F.col("_new_n") < 6})
    assert held == 0 and files_of(table.path) == after


def test_an_empty_insert_writes_nothing(spark, table):
    assert stored.insert_ignore(table, plays(spark)) == 0
    assert table.read(spark).count() == 0


def captures_at(spark, day, n):
    return spark.range(n).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit(f"H{day}").alias("headliner"), F.lit(dt.date(2026, 1, day)).alias("captured_at"))


def test_a_capture_is_written_once_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "captures")
    for day in range(1, 31):
        files.write_snapshot(captures_at(spark, day, day), F.col("captured_at"), path)
    files.write_snapshot(captures_at(spark, 30, 7), F.col("captured_at"), path)
    counts = {r.captured_at.day: r.event_count for r in files.read_captures(spark, path, "date").collect()}
    assert counts == {d: 7 if d == 30 else d for d in range(1, 31)}
    latest, previous = files.read_capture(spark, path, 1, "date"), files.read_capture(spark, path, 2, "date")
    assert latest.count() == 7 and {r.headliner for r in previous.collect()} == {"H29"}
    both = latest.select("source_id").union(previous.select("source_id"))
    assert sum(n for n in scanned(both) if n < 30) == 2 and 30 not in scanned(both)
