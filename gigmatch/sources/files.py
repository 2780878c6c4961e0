"""Captures, digests, feeds and playlists to files and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.functions.scoring import TERMS
from gigmatch.sources.json_feeds import RAW_EVENT
from gigmatch.sources.stored import partitions, picked

_EVENT_JSON = """array<struct<source: string, source_id: string, headliner: string, openers: array<string>, date: string,
    doors_time: string, show_time: string, venue: string, on_sale_date: string, ticket_url: string>>"""


def snapshot_rows(raw_events: DataFrame, captured_at: Column, per_value: int = 1000) -> DataFrame:
    """(source, captured_at, part, raw_content, event_count): a capture's shows as JSON arrays.

    An array holds about ``per_value`` shows, dealt by a hash of their ids: a large source gets more arrays, not a
    longer one.
    """
    event = F.struct(*[F.col(c).cast("string").alias(c) if c != "openers" else F.col(c) for c in RAW_EVENT])
    sizes = raw_events.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / per_value).alias("_parts"))
    rows = raw_events.join(sizes, "source").withColumn("part", F.pmod(F.xxhash64("source_id"), F.col("_parts")).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("source_id", event.alias("event"))))
    grouped = rows.groupBy("source", "part").agg(listed.alias("_l"), F.count(F.lit(1)).alias("event_count"))
    content = F.to_json(F.transform("_l", lambda x: x["event"]))
    return grouped.select("source", captured_at.alias("captured_at"), "part", content.alias("raw_content"), "event_count")


def write_snapshot(raw_events: DataFrame, captured_at: Column, path: str) -> None:
    """Store one capture of each source: its shows, exploded, and one row (source, captured_at, event_count).

    Both lie by source and capture; writing a capture again replaces it.
    """
    rows = raw_events.withColumn("captured_at", captured_at)
    _replace_captures(rows, f"{path}/shows")
    counted = rows.groupBy("source", "captured_at").agg(F.count(F.lit(1)).alias("event_count"))
    _replace_captures(counted, f"{path}/captures")


def _replace_captures(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "captured_at").parquet(path)


def read_snapshots(spark: SparkSession, path: str, kind: str = "timestamp") -> DataFrame:
    """All stored shows with their source and capture; ``kind`` is the type of captured_at."""
    found = spark.read.parquet(f"{path}/shows").dtypes
    schema = ", ".join(f"{c} {t}" for c, t in found if c not in ("source", "captured_at"))
    return spark.read.schema(f"{schema}, source string, captured_at {kind}").parquet(f"{path}/shows")


def read_captures(spark: SparkSession, path: str, kind: str = "timestamp") -> DataFrame:
    """(source, captured_at, event_count) of every stored capture, without opening a show."""
    return spark.read.schema(f"event_count bigint, source string, captured_at {kind}").parquet(f"{path}/captures")


def read_capture(spark: SparkSession, path: str, n: int = 1, kind: str = "timestamp") -> DataFrame:
    """Shows of the n-th latest capture of each source; no other capture's files are opened."""
    order = Window.partitionBy("source").orderBy(F.desc("captured_at"))
    wanted = read_captures(spark, path, kind).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == n)
    wanted = partitions(wanted, ["source", "captured_at"], "capture-wanted")
    return read_snapshots(spark, path, kind).join(picked(wanted), ["source", "captured_at"], "left_semi")


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Captures with ``raw_content`` back to one row per show."""
    rows = snapshots.select("captured_at", F.explode(F.from_json("raw_content", _EVENT_JSON)).alias("e"))
    kinds = {"date": "date", "on_sale_date": "date"}
    return rows.select("captured_at", *[F.col(f"e.{c}").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"e.{c}") for c in RAW_EVENT])


def digest_lines(digest: DataFrame) -> DataFrame:
    """One readable line per show of the digest."""
    who = F.when(F.size("matched_artists") > 0, F.concat(F.lit(" ["), F.array_join("matched_artists", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.format_string("%.4f  %s  %s @ %s", F.col("score_total"), F.col("date").cast("string"), F.col("headliner"), F.col("venue")), who)
    return digest.select("event_id", line.alias("line"))


def digest_calendar(digest: DataFrame) -> DataFrame:
    """One calendar entry per show of the digest."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    entry = F.concat_ws(
        "\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("source"), F.lit("-"), F.col("source_id")),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("date"))), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("date", 1))),
        F.concat(F.lit("SUMMARY:"), F.col("headliner"), F.lit(" @ "), F.col("venue")), F.lit("END:VEVENT"),
    )
    return digest.select("event_id", entry.alias("entry"))


def digest_json(digest: DataFrame) -> DataFrame:
    terms = F.struct(*[F.col(f"{t}_score").alias(t) for t in TERMS])
    fields = F.struct(
        "headliner", "venue", F.col("date").cast("string").alias("date"), "source", "source_id", "score_total",
        terms.alias("score_terms"), "matched_artists", "ticket_url",
    )
    return digest.select("event_id", F.to_json(fields).alias("entry"))


def write_digest(digest: DataFrame, format: str, path: str) -> None:
    """The ordered digest as json, text or ics; an ics calendar is one file, as its first and last lines must be."""
    ordered = digest.orderBy(F.desc("score_total"), "date", "source_id")
    column = {"json": digest_json, "text": digest_lines, "ics": digest_calendar}[format](ordered).select(F.col("entry" if format != "text" else "line").alias("value"))
    if format == "ics":
        spark = digest.sparkSession
        edge = lambda line: spark.createDataFrame([(line,)], "value string")
        column = edge("BEGIN:VCALENDAR\nVERSION:2.0").union(column).union(edge("END:VCALENDAR")).coalesce(1)
    column.write.mode("overwrite").text(path)


def write_feed_json(feed: DataFrame, path: str) -> None:
    feed.write.mode("overwrite").json(path)


def playlist_json(plan: DataFrame, name: str, public: bool) -> DataFrame:
    """One JSON document: name, public flag and the resolved URIs in order (a playlist is short by its limit)."""
    listed = F.array_sort(F.collect_list(F.when(F.col("uri").isNotNull(), F.struct("rank", "uri"))))
    grouped = plan.agg(F.transform(listed, lambda x: x["uri"]).alias("uris"))
    return grouped.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(public).alias("public"), "uris")).alias("playlist"))


def export_playlist(plan: DataFrame, name: str, public: bool, path: str) -> None:
    playlist_json(plan, name, public).write.mode("overwrite").text(path)
