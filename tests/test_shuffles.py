"""What jobs over large histories send through shuffles: plays, not the rows that they are joined to."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from gigmatch.operators import history, shows
from gigmatch.plans import catalogue, catalogue_stored
from gigmatch.sources import shared
from gigmatch.streaming import streams

PLAY = "user_id long, key string, raw_name string, scrobbled_at timestamp"


def dealt_by(df):
    """The columns that each exchange of the plan deals rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x).split(", ")[:-1] for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


@pytest.fixture(scope="module")
def listened(spark):
    at = F.timestamp_seconds(F.col("id") * 40_000 + 1_600_000_000)
    plays = spark.range(3000).select((F.col("id") % 40).alias("user_id"), F.concat(F.lit("k"), F.col("id") % 37).alias("key"), F.lit("n").alias("raw_name"), at.alias("scrobbled_at"))
    odd = spark.createDataFrame([(None, "k1", "n", None), (None, "k2", "n", "2024-01-01 00:00:00"), (99, "no tags", "n", "2024-01-01 00:00:00"), (98, None, "n", "2024-01-01 00:00:00")], "user_id long, key string, raw_name string, t string")
    plays = plays.unionByName(odd.withColumn("scrobbled_at", F.col("t").cast("timestamp")).drop("t"))
    tags = spark.range(37).select(F.concat(F.lit("k"), "id").alias("key"), F.explode(F.sequence(F.lit(0), F.col("id") % 12)).alias("t"))
    tags = tags.select("key", F.when(F.col("t") != 3, F.concat(F.lit("t"), "t")).alias("tag"), (F.col("t") + 0.5).alias("weight"))
    return plays, tags.unionByName(spark.createDataFrame([(None, "t1", 1.0), ("k5", None, None)], "key string, tag string, weight double"))


def by_row(df):
    return {(r.user_id, r.tag): r.weight for r in df.collect()}


@pytest.mark.parametrize("most", [100_000, 10])
def test_taste_by_listener_is_taste_of_affinity(spark, listened, most):
    plays, tags = listened
    ref = F.lit("2024-02-01").cast("timestamp")
    got = by_row(history.taste_by_listener(plays, tags, ref, 300.0, ["user_id"], most))
    want = by_row(history.taste_vector(tags, history.decayed_affinity(plays, ref, 300.0, ["user_id"]), ["user_id"]))
    assert got == {k: v if v is None else pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert (0, None) in got and (None, "t1") in got and 99 not in {u for u, _ in got}


def test_taste_is_not_shuffled_by_tag(spark, sf):
    got = dealt_by(catalogue.QUERIES["taste_vector_by_user"](spark, sf))
    assert ["user_id"] in got and not [x for x in got if "tag" in x or "key" in x]


@pytest.mark.parametrize("most, rows", [(100_000, 2_000_000), (100_000, 60), (20, 60)])
def test_best_score_by_group_with_ties_and_a_null_group(spark, most, rows):
    who = [(e, a, f"k{a % 7}") for e in range(30) for a in range(e % 4, 40, 9)] + [(90, 3, "nobody's"), (91, 4, None)]
    total = lambda g, k: (g or 0) * k % 5 / 4  # noqa: E731  ties in every group
    scores = [(g, f"k{k}", total(g, k), k * 1.0, "v") for g in (1, 2, 3, None) for k in range(7) if g != 3 or k < 2]
    frames = [spark.createDataFrame(who, "event_id long, artist_id long, key string"), spark.createDataFrame(scores, "nation int, key string, score_total double, taste_score double, scoring_version string")]
    got = {(r.nation, r.event_id): (r.artist_id, r.score_total, r.taste_score, r.scoring_version) for r in shows.best_score_by_group(*frames, ["nation"], most, rows).collect()}
    want = {}
    for e, a, k in who:
        for g, key, score, taste, version in scores:
            if key == k:
                want[g, e] = max(want.get((g, e), (-1, 0)), (score, -a, taste, version))
    assert got == {x: (-a, score, taste, version) for x, (score, a, taste, version) in want.items()}


def test_shows_are_not_shuffled_once_per_group(spark, sf):
    got = dealt_by(catalogue_stored.QUERIES["score_shows_by_group"](spark, sf))
    assert not [x for x in got if "nation" in x]


def test_affinity_batches_keep_no_state_and_count_once_when_they_run_again(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, epoch, ref = "key string, scrobbled_at timestamp", F.lit("2020-01-01").cast("timestamp"), F.lit("2026-06-01").cast("timestamp")

    def arrive(*keys):
        spark.createDataFrame([(k, dt.datetime(2026, 1, 1 + i)) for i, k in enumerate(keys)], schema).write.mode("append").parquet(path)

    def drained():
        streams.sink_affinity(spark.readStream.schema(schema).parquet(path), epoch, out, state, 30.0)
        return {r.key: (r.weight, r.play_count) for r in streams.read_affinity(spark, out, epoch, ref, 30.0).collect()}

    arrive("a", "a", "b")
    first = drained()
    assert {k: n for k, (_, n) in first.items()} == {"a": 2, "b": 1}
    arrive("a", "c")
    second = drained()
    assert {k: n for k, (_, n) in second.items()} == {"a": 3, "b": 1, "c": 1} and not (tmp_path / "state/state").exists()
    assert {(r.batch, r.key): r.play_count for r in spark.read.parquet(out).collect()} == {(0, "a"): 2, (0, "b"): 1, (1, "a"): 1, (1, "c"): 1}
    for name in ("1", ".1.crc"):  # as if it broke off after writing
        (tmp_path / "state/commits" / name).unlink()
    assert drained() == second
    whole = history.decayed_affinity(spark.read.schema(schema).parquet(path).withColumn("raw_name", F.col("key")), ref, 30.0)
    assert second == {r.key: (pytest.approx(r.weight, abs=1e-6), r.play_count) for r in whole.collect()}


def test_written_tables_leave_no_shuffle_files_only_inside_freed(spark):
    name = shared._CLEANUP
    before = spark.conf.get(name, None)
    with pytest.raises(ValueError), shared.freed(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name, None) == before
