"""Idempotent writes as set operations: stored rows, incoming rows, a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the first in the order of the other columns, from left to right, nulls last."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    order = [x for c in rest for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c).alias(c))]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(*key, *[F.col("_first").getField(c).alias(c) for c in rest]).select(*rows.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one per key: the ``first_of_key``."""
    return first_of_key(incoming, key).join(stored.select(*key), key, "left_anti").select(*incoming.columns)


def upsert_insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The whole table after the insert; ``sources.stored.insert_ignore`` writes only what changes."""
    return stored.unionByName(new_rows(incoming, stored, key))


def upsert_update(stored: DataFrame, incoming: DataFrame, key: list[str], update: list[str], when: dict[str, Column] | None = None) -> DataFrame:
    """Stored and incoming rows by key: where both are there, the columns of ``update`` are taken from the incoming.

    ``incoming`` has one row per key.  ``when`` holds a column's update back where its condition is false.  This is
    the whole table after the update; ``sources.stored.update`` writes only the partitions that change.
    """
    return merged(stored, incoming, key, update, when).drop("_changed")


def merged(stored: DataFrame, incoming: DataFrame, key: list[str], update: list[str], when: dict[str, Column] | None = None) -> DataFrame:
    """``upsert_update`` with ``_changed``: whether a row is new or any of its columns differs from the stored one."""
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns], F.lit(True).alias("_new"))
    old = stored.withColumn("_old", F.lit(True))
    match = reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[f"_new_{k}"]) for k in key])
    both = old.join(new, match, "full")

    def picked(c: str) -> Column:
        if f"_new_{c}" not in new.columns:
            return F.col(c)
        fresh = F.col("_old").isNull()
        if c in update:
            changed = F.col("_new").isNotNull() & (when or {}).get(c, F.lit(True))
            fresh = fresh | changed
        return F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(c))

    differs = reduce(lambda a, b: a | b, [~picked(c).eqNullSafe(F.col(c)) for c in stored.columns])
    return both.select(*[picked(c).alias(c) for c in stored.columns], (F.col("_old").isNull() | differs).alias("_changed"))


def upsert_tags(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(artist_id, tag): the newest weight and when it was fetched."""
    rows = stored.unionByName(incoming)
    newest = F.max_by(F.struct("weight", "fetched_at"), F.struct("fetched_at", "weight")).alias("_n")
    return rows.groupBy("artist_id", "tag").agg(newest).select("artist_id", "tag", "_n.weight", "_n.fetched_at")


def upsert_matches(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_update(stored, incoming, ["event_id", "artist_id"], ["matched_name", "match_type", "confidence", "status"])


def upsert_scores(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    rest = [c for c in stored.columns if c not in ("event_id", "scoring_version")]
    return upsert_update(stored, incoming, ["event_id", "scoring_version"], rest)


def upsert_resolutions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_update(stored, incoming, ["artist_name", "track_name"], ["chosen_uri", "candidates", "resolved_at"])


def unresolved_queue(stored: DataFrame, failed: DataFrame, as_of: Column) -> DataFrame:
    """Queue of names that no search resolved: attempts add up, first and last times are kept."""
    fresh = failed.select(
        "raw_name", "failure_reason", F.lit(1).cast("long").alias("attempt_count"),
        as_of.alias("first_failed_at"), as_of.alias("last_attempted_at"),
    )
    return stored.unionByName(fresh).groupBy("raw_name").agg(
        F.min_by("failure_reason", "first_failed_at").alias("failure_reason"),
        F.sum("attempt_count").alias("attempt_count"),
        F.min("first_failed_at").alias("first_failed_at"),
        F.max("last_attempted_at").alias("last_attempted_at"),
    )


def upsert_source_health(stored: DataFrame, health: DataFrame) -> DataFrame:
    """Health rows by source; the last success only moves on healthy runs."""
    rest = [c for c in stored.columns if c not in ("source", "last_success_at")]
    healthy = {"last_success_at": ~F.col("_new_anomaly_flag")}
    return upsert_update(stored, health, ["source"], [*rest, "last_success_at"], healthy)


def union_sources(*events: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)


def quarantine(df: DataFrame, checks: dict[str, Column], stage_name: str, as_of: Column, record_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all ``checks`` (message to condition), and dead letters with the first message that applies."""
    error = F.lit(None).cast("string")
    for message, good in reversed(checks.items()):
        error = F.when(~F.coalesce(good, F.lit(False)), message).otherwise(error)
    marked = df.withColumn("_error", error)
    dead = marked.filter(F.col("_error").isNotNull()).select(
        F.lit(stage_name).alias("stage_name"),
        F.col(record_id).cast("string").alias("record_id"),
        F.to_json(F.struct(*df.columns)).alias("raw_content"),
        F.col("_error").alias("error_message"),
        as_of.alias("occurred_at"),
    )
    return marked.filter(F.col("_error").isNull()).drop("_error"), dead
