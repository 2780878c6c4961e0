"""Captures of sources: differences, counts, health, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAILING_RUNS, DROP_SHARE, LEAST_RUNS = 7, 0.5, 3


def latest_snapshot(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the n-th latest capture of each source.

    Captures are ranked on one row each; shows are then picked by a join with one row per source, which also prunes
    a table that is stored by source or capture.
    """
    order = Window.partitionBy("source").orderBy(F.desc("captured_at"))
    runs = snapshots.select("source", "captured_at").distinct().withColumn("_n", F.row_number().over(order))
    wanted = runs.filter(F.col("_n") == n).drop("_n")
    return snapshots.join(F.broadcast(wanted), ["source", "captured_at"], "left_semi")  # one row per source


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    return latest_snapshot(snapshots, 2)


def with_previous(snapshots: DataFrame) -> DataFrame:
    """(source, captured_at, previous_at): each capture and the one strictly before it."""
    runs = snapshots.select("source", "captured_at").distinct()
    before = F.lag("captured_at").over(Window.partitionBy("source").orderBy("captured_at"))
    return runs.withColumn("previous_at", before)


def new_event(curr: DataFrame, prev: DataFrame, as_of: Column) -> DataFrame:
    """Shows of the current capture that the previous one lacks; a first capture has only new ones."""
    fresh = curr.join(prev.select("source", "source_id"), ["source", "source_id"], "left_anti")
    detail = F.to_json(F.struct("headliner", F.col("date").cast("string").alias("date")))
    return fresh.select("source", F.col("source_id").alias("event_source_id"), F.lit("new_event").alias("change_type"), detail.alias("change_detail"), as_of.alias("detected_at"))


def openers_except(curr: Column, prev: Column) -> Column:
    return F.array_except(curr, prev)


def opener_added(curr: DataFrame, prev: DataFrame, as_of: Column, one_per_event: bool = False) -> DataFrame:
    """One row per opener that the previous capture of the show lacks (the first in order only, if told so)."""
    before = prev.select("source", "source_id", F.col("openers").alias("_before"))
    added = openers_except(F.col("openers"), F.coalesce("_before", F.array().cast("array<string>")))
    both = curr.join(before, ["source", "source_id"]).withColumn("_added", added)
    both = both.withColumn("_added", F.slice(F.array_sort("_added"), 1, 1)) if one_per_event else both
    rows = both.select("source", F.col("source_id").alias("event_source_id"), F.explode("_added").alias("opener"))
    return rows.select("source", "event_source_id", F.lit("opener_added").alias("change_type"), F.to_json(F.struct("opener")).alias("change_detail"), as_of.alias("detected_at"))


def snapshot_diff(curr: DataFrame, prev: DataFrame, as_of: Column) -> DataFrame:
    return new_event(curr, prev, as_of).unionByName(opener_added(curr, prev, as_of))


def source_counts(raw_events: DataFrame) -> DataFrame:
    return raw_events.groupBy("source", "captured_at").agg(F.count(F.lit(1)).alias("n"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("source", "change_type", "detected_at").agg(F.count(F.lit(1)).alias("n"))


def anomaly(n: Column, known: Column, mean: Column, drop: float = DROP_SHARE, least: int = LEAST_RUNS) -> Column:
    """Why a run of ``n`` events after ``known`` runs of this mean is anomalous; null if it isn't."""
    sudden = (known >= least) & (mean > 0) & (n < mean * (1 - drop))
    # The messages.
    return F.when(n == 0, F.format_string("Source '%s' returned 0 events", "source")).when(
        sudden, F.format_string("Source '%s' returned %d events, trailing mean %.1f", F.col("source"), n, mean)
    )


def source_health(counts: DataFrame, window: int = TRAILING_RUNS, drop: float = DROP_SHARE, least: int = LEAST_RUNS) -> DataFrame:
    """Every run of each source (source, captured_at, n) against the runs before it.

    No rows at all is an anomaly, and so is a drop below the share of the trailing mean once there are enough runs;
    anomalous runs count in the means after them.  A latest row per source is that source's health.  A run that
    returned nothing is known only by a row with n = 0, which the caller's calendar of runs supplies.
    """
    runs = Window.partitionBy("source").orderBy("captured_at")
    before = runs.rowsBetween(-window, -1)
    reason = anomaly(F.col("n"), F.count("n").over(before), F.avg("n").over(before), drop, least)
    marked = counts.withColumn("anomaly_reason", reason).withColumn("anomaly_flag", F.col("anomaly_reason").isNotNull())
    good = F.when(~F.col("anomaly_flag"), F.col("captured_at"))
    return marked.select(
        "source",
        "captured_at",
        F.last(good, ignorenulls=True).over(runs.rowsBetween(Window.unboundedPreceding, 0)).alias("last_success_at"),
        F.col("n").alias("last_event_count"),
        F.collect_list("n").over(runs.rowsBetween(-(window - 1), 0)).alias("trailing_counts"),
        "anomaly_flag",
        "anomaly_reason",
    )


def latest_run(ledger: DataFrame) -> DataFrame:
    """The latest run of each stage with its duration in seconds."""
    order = Window.partitionBy("stage_name").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = ledger.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return last.withColumn("seconds", F.unix_seconds("ended_at") - F.unix_seconds("started_at"))
