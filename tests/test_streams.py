"""Streams over several runs: what late, repeated and replayed rows do, and what is written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gigmatch.operators import history
from gigmatch.sources import stored
from gigmatch.streaming import streams

PLAYS = "scrobbled_at timestamp, artist_name string"


def at(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_late_plays_are_dropped_and_batches_count_once(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = stored.StoredTable(str(tmp_path / "plays"), PLAYS, ["scrobbled_at", "artist_name"])
    runs = [
        [(at(0), "a"), (at(0), "a"), (at(100), "b")],
        [(at(101), "b"), (at(95), "in time")],
        [(at(102), "c"), (at(10), "late"), (at(100), "b")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, PLAYS).write.mode("append").parquet(path)
        streams.sink_plays(spark.readStream.schema(PLAYS).parquet(path), table, state, "10 days")
    got = sorted((r.artist_name, r.scrobbled_at) for r in table.read(spark).collect())
    assert got == sorted([("a", at(0)), ("b", at(100)), ("b", at(101)), ("in time", at(95)), ("c", at(102))])
    batch = spark.createDataFrame([(at(200), "z")], PLAYS)
    assert streams.insert_batch(table, batch, 99, f"{state}/applied") == 1
    again = spark.createDataFrame([(at(200), "z"), (at(201), "y")], PLAYS)
    assert streams.insert_batch(table, again, 99, f"{state}/applied") == 0
    assert streams.insert_batch(table, again, 100, f"{state}/applied") == 1


@pytest.mark.parametrize("span", [0.5, 100.0])
def test_landmarks_move_and_only_changed_keys_are_written(spark, tmp_path, span):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "key string, scrobbled_at timestamp"
    epoch, ref = F.lit("1970-01-01").cast("timestamp"), F.lit("2026-06-01").cast("timestamp")
    runs = [[("a", at(0)), ("a", at(40)), ("b", at(1))], [("a", at(70))], [("c", at(80)), ("c", at(-400))]]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        streams.sink_affinity(spark.readStream.schema(schema).parquet(path), epoch, out, state, 10.0, span=span)
    got = {r.key: (r.weight, r.play_count) for r in streams.read_affinity(spark, out, epoch, ref, 10.0, span=span).collect()}
    whole = history.decayed_affinity(spark.read.schema(schema).parquet(path).withColumn("raw_name", F.col("key")), ref, 10.0)
    assert got == {r.key: (pytest.approx(r.weight, abs=1e-6), r.play_count) for r in whole.collect()}
    written = {}
    for r in spark.read.parquet(out).collect():
        written.setdefault(r.batch, set()).add(r.key)
    assert sorted(map(sorted, written.values())) == [["a"], ["a", "b"], ["c"]]
    assert all(r.weight < 2.0 ** (span + 3) for r in spark.read.parquet(out).collect())


def test_sums_don_t_overflow_however_far_the_epoch(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, epoch = "key string, scrobbled_at timestamp", F.lit("1970-01-01").cast("timestamp")
    spark.createDataFrame([("a", at(0)), ("a", at(1))], schema).write.parquet(path)
    streams.sink_affinity(spark.readStream.schema(schema).parquet(path), epoch, out, state, 1.0)  # 20,000 half-lives
    assert streams.read_affinity(spark, out, epoch, F.lit("2026-01-02").cast("timestamp"), 1.0).first().weight == 1.5


SHOWS = "source string, captured_at date, source_id string, openers array<string>"


def test_captures_over_runs(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda n: dt.date(2026, 1, n)
    runs = [
        [("s", day(1), "1", ["x"]), ("s", day(1), "2", None), ("t", day(1), "1", [])],
        [("s", day(2), "1", ["x", "y", "y", "z"]), ("s", day(3), "1", ["w"]), ("s", day(3), "2", ["q"])],
        [("t", day(9), "1", ["new"]), ("u", day(9), "1", [])],
    ]
    for rows in runs:
        spark.createDataFrame(rows, SHOWS).repartition(3).write.mode("append").parquet(path)
        streams.stream_snapshot_diff(spark.readStream.schema(SHOWS).parquet(path), out, state)
    changes = spark.read.schema(streams.CHANGE).parquet(f"{out}/changes")
    got = sorted((r.source, r.captured_at.day, r.source_id, r.change_type, r.opener) for r in changes.collect())
    assert got == sorted(
        [("s", 1, "1", "new_event", ""), ("s", 1, "2", "new_event", ""), ("t", 1, "1", "new_event", ""),
         ("s", 2, "1", "opener_added", "y"), ("s", 2, "1", "opener_added", "z"),
         ("s", 3, "1", "opener_added", "w"), ("s", 3, "2", "new_event", ""),
         ("t", 9, "1", "opener_added", "new"), ("u", 9, "1", "new_event", "")]
    )
    whole = streams.diff_all(spark.read.schema(SHOWS).parquet(path)).collect()
    assert sorted((r.source, r.captured_at.day, r.source_id, r.change_type, r.opener) for r in whole) == got
