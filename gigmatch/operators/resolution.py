"""Which known performer a listed name stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmatch.functions.names import MATCH_THRESHOLD, REVIEW_FLOOR, match_status, match_threshold, normalize_name
from gigmatch.operators.fuzzy import most_similar
from gigmatch.sources.shared import materialise


def event_artist_names(events: DataFrame) -> DataFrame:
    """(event_id, pos, name): the headliner at 0, then the openers."""
    names = F.concat(F.array("headliner"), F.coalesce("openers", F.array().cast("array<string>")))
    return events.select("event_id", F.posexplode(names).alias("pos", "name"))


def _lowest(artists: DataFrame, key: str) -> DataFrame:
    """One row per key: its lowest artist_id."""
    return artists.groupBy(key).agg(F.min_by(F.struct("artist_id", "raw_name"), "artist_id").alias("_a")).select(key, "_a.artist_id", "_a.raw_name")


def _match(df: DataFrame, kind: str) -> DataFrame:
    return df.select("name", "artist_id", "raw_name", F.lit(kind).alias("match_type"), F.lit(1.0).alias("confidence"), F.lit("matched").alias("status"))


def resolve_mbid(names: DataFrame, artists: DataFrame) -> DataFrame:
    """Names (name, event_mbid) to the performer with that identifier."""
    known = _lowest(artists.filter(F.coalesce("mbid", F.lit("")) != "").select(F.col("mbid").alias("event_mbid"), "artist_id", "raw_name"), "event_mbid")
    return _match(names.filter(F.coalesce("event_mbid", F.lit("")) != "").join(known, "event_mbid"), "mbid")


def resolve_exact(names: DataFrame, artists: DataFrame, match_empty_norm: bool = False) -> DataFrame:
    """Names (name) to the lowest performer of the same normal form.

    Names without Latin letters or digits all have the empty normal form; they match nothing unless told otherwise.
    """
    asked = names.select("name").distinct().withColumn("norm", normalize_name(F.col("name")))
    known = artists.select("artist_id", "raw_name", normalize_name(F.col("raw_name")).alias("norm"))
    if not match_empty_norm:
        asked, known = asked.filter("norm <> ''"), known.filter("norm <> ''")
    return _match(asked.join(_lowest(known, "norm"), "norm"), "exact")


def resolve_fuzzy(names: DataFrame, artists: DataFrame, threshold: float = MATCH_THRESHOLD, floor: float = REVIEW_FLOOR) -> DataFrame:
    """Names (name) to the most similar performer, matched or for review; names below ``floor`` give no row.

    Distinct normal forms are compared once, however often they occur (``fuzzy.most_similar``); of equally similar
    performers the lowest artist_id counts.
    """
    asked = names.select("name").distinct().withColumn("norm", normalize_name(F.col("name"))).filter("norm <> ''")
    known = artists.select("artist_id", "raw_name", normalize_name(F.col("raw_name")).alias("known")).filter("known <> ''")
    known = materialise(_lowest(known, "known"), "fuzzy-known")
    pairs = most_similar(asked.select("norm").distinct(), known.select("known", "artist_id"), floor)[0]
    best = asked.join(pairs, "norm").join(known, "known")
    status = match_status(F.col("score"), match_threshold(F.col("name"), F.col("raw_name"), threshold), floor)
    return best.select("name", known["artist_id"], "raw_name", F.lit("fuzzy").alias("match_type"), F.round("score", 6).alias("confidence"), status.alias("status"))


def last_write_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows that share a key, the last in ``order``."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def resolve_artist_ids(artists: DataFrame, search_results: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Performers with identifiers from search results (query, rank, name, mbid), and those left unresolved.

    Of each unresolved performer's results, the first whose name is equal but for case decides, even if its
    identifier is blank.
    """
    equal = search_results.filter(F.lower("name") == F.lower("query"))
    first = equal.groupBy(F.col("query").alias("raw_name")).agg(F.min_by("mbid", "rank").alias("_m"))
    joined = artists.join(first.select("raw_name", F.nullif(F.trim("_m"), F.lit("")).alias("_mbid")), "raw_name", "left")
    hit = ~F.col("resolved") & F.col("_mbid").isNotNull()
    done = joined.select(
        "artist_id",
        "raw_name",
        F.when(hit, F.col("_mbid")).otherwise(F.col("mbid")).alias("mbid"),
        (F.col("resolved") | hit).alias("resolved"),
        F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    failed = done.filter(~F.col("resolved")).select("raw_name", F.lit("no_match").alias("failure_reason"))
    return done, failed
