"""Plays, affinity, tags and taste.

Every operator takes ``by``: extra grouping columns such as the listener.  Without them there is one listener.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gigmatch.functions.names import artist_key
from gigmatch.functions.scoring import DAY_MICROS, HALF_LIFE_DAYS, decay_weight, discovery_signal, recency_signal
from gigmatch.operators.neighbours import neighbour_search
from gigmatch.sources.shared import BROADCAST_ROWS, freed, materialise


def valid_plays(parsed: DataFrame) -> DataFrame:
    """Finished plays with a time, a performer and a track; blank albums become null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    good = (F.coalesce("now_playing", F.lit("")) == "") & F.col("uts").isNotNull()
    return parsed.filter(good & ~blank("artist_name") & ~blank("track_name")).select(
        F.timestamp_seconds(F.col("uts")).alias("scrobbled_at"),
        F.trim("artist_name").alias("artist_name"),
        F.trim("track_name").alias("track_name"),
        F.nullif(F.trim("album_name"), F.lit("")).alias("album_name"),
    )


def since_filter(plays: DataFrame, checkpoint: Column | None = None, since: Column | None = None, ts: str = "scrobbled_at") -> DataFrame:
    """Plays at or after the later of the two bounds; no bound, no filter."""
    bounds = [b for b in (checkpoint, since) if b is not None]
    for bound in bounds:
        plays = plays.filter(F.col(ts) >= bound)
    return plays


def plays_with_artist(plays: DataFrame, artists: DataFrame, by: list[str] = []) -> DataFrame:
    """Each play with its performer's key; plays without a known performer keep their own name as key."""
    known = artists.select(F.col("artist_id").alias("_aid"), "raw_name", "mbid")
    joined = plays.join(known, plays["artist_id"] == known["_aid"], "left")
    name = F.coalesce("raw_name", "artist_name")
    return joined.select(*by, artist_key(F.col("mbid"), name).alias("key"), name.alias("raw_name"), "scrobbled_at")


def decayed_affinity(plays: DataFrame, ref: Column, half_life: float = HALF_LIFE_DAYS, by: list[str] = []) -> DataFrame:
    """Per key: summed decay weights, plays, and the name of the latest play.  One aggregation, combined map-side."""
    latest = F.max(F.struct("scrobbled_at", "raw_name"))
    grouped = plays.groupBy(*by, "key").agg(
        F.round(F.sum(decay_weight(F.col("scrobbled_at"), ref, half_life)), 6).alias("weight"),
        F.count(F.lit(1)).alias("play_count"),
        latest.alias("_latest"),
    )
    return grouped.select(*by, "key", F.col("_latest.raw_name").alias("raw_name"), "weight", "play_count")


def top_affinity(affinity: DataFrame, n: int = 50, by: list[str] = []) -> DataFrame:
    """The n heaviest keys, per group if ``by`` is given; ties by key."""
    order = [F.desc("weight"), F.asc("key")]
    if not by:
        return affinity.orderBy(*order).limit(n)
    ranked = affinity.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def last_play_days(plays: DataFrame, ref: Column, by: list[str] = []) -> DataFrame:
    last = F.max("scrobbled_at")
    days = (F.unix_micros(ref) - F.unix_micros(F.col("_last"))) / F.lit(DAY_MICROS)
    return plays.groupBy(*by, "key").agg(last.alias("_last")).select(*by, "key", days.alias("days"))


def play_counts(plays: DataFrame, artists: DataFrame, by: list[str] = []) -> DataFrame:
    """Plays per performer; those never played count 0 (if ``by`` is given, only played ones are listed)."""
    counted = plays.groupBy(*by, "artist_id").agg(F.count(F.lit(1)).alias("n"))
    if by:
        return counted
    return artists.select("artist_id").join(counted, "artist_id", "left").select("artist_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def tag_rows(artists: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """(key, tag, weight): of several performers with one key, the highest id's weight counts."""
    joined = artists.join(artist_tags, "artist_id")
    key = artist_key(F.col("mbid"), F.col("raw_name")).alias("key")
    return joined.select(key, "tag", "weight", "artist_id").groupBy("key", "tag").agg(F.max_by("weight", "artist_id").alias("weight"))


def taste_vector(tags: DataFrame, affinity: DataFrame, by: list[str] = []) -> DataFrame:
    """Per tag: weights of the performers' tags, times the listener's affinity for them."""
    liked = affinity.filter(F.col("weight") > 0).select(*by, "key", F.col("weight").alias("_affinity"))
    return tags.join(liked, "key").groupBy(*by, "tag").agg(F.sum(F.col("_affinity") * F.col("weight")).alias("weight"))


def taste_by_listener(plays: DataFrame, tags: DataFrame, ref: Column, half_life: float = HALF_LIFE_DAYS, by: list[str] = ["user_id"], most: int = BROADCAST_ROWS) -> DataFrame:
    """``taste_vector`` of each listener's ``decayed_affinity``, with one shuffle: of plays, by listener.

    Up to ``most`` rows of tags go to every task, with numbers for keys and tags; a listener's plays are together in a
    task before they meet the tags, so no pair of play and tag is shuffled.  More tags are joined by key.  ``by`` should
    have many groups.
    """
    tags = materialise(tags, "tags")
    if tags.count() > most:
        return taste_vector(tags, decayed_affinity(plays, ref, half_life, by), by)
    keys, names = (materialise(tags.select(c).distinct().withColumn(f"_{c}", F.monotonically_increasing_id()), f"taste-{c}") for c in ("key", "tag"))
    numbered = tags.join(keys, "key").join(names, tags["tag"].eqNullSafe(names["tag"])).select(F.col("_key").alias("key"), F.col("_tag").alias("tag"), "weight")
    known = plays.join(F.broadcast(keys), "key").select(*by, F.col("_key").alias("key"), F.lit(None).cast("string").alias("raw_name"), "scrobbled_at")
    affinity = decayed_affinity(known.repartition(*by), ref, half_life, by)
    taste = taste_vector(F.broadcast(numbered), affinity, by).withColumnRenamed("tag", "_tag")
    return taste.join(F.broadcast(names), "_tag").select(*by, "tag", "weight")


def vector_norms(vectors: DataFrame, key: list[str]) -> DataFrame:
    return vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def tag_overlap(a: DataFrame, b: DataFrame, by: list[str] = []) -> DataFrame:
    """(…, a, b, tag, wa, wb) for the tags that two vectors share; vectors are (key, tag, weight), ``b`` may carry ``by``."""
    left = a.select(F.col("key").alias("a"), "tag", F.col("weight").alias("wa"))
    right = b.select(*by, F.col("key").alias("b"), "tag", F.col("weight").alias("wb"))
    return left.join(right, "tag").select(*by, "a", "b", "tag", "wa", "wb")


def cosine(a: DataFrame, b: DataFrame, by: list[str] = []) -> DataFrame:
    """(…, a, b, similarity) of vectors that share a tag; all others have similarity 0 and no row."""
    dots = tag_overlap(a, b, by).groupBy(*by, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na = vector_norms(a, ["key"]).select(F.col("key").alias("a"), F.col("norm").alias("na"))
    nb = vector_norms(b, [*by, "key"]).select(*by, F.col("key").alias("b"), F.col("norm").alias("nb"))
    joined = dots.join(na, "a").join(nb, [*by, "b"])
    return joined.filter("dot <> 0 AND na <> 0 AND nb <> 0").select(*by, "a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity"))


def adjacency(tags: DataFrame, taste: DataFrame, by: list[str] = []) -> DataFrame:
    """(…, key, adjacency): cosine of each performer's tags with the listener's taste."""
    whole = taste.select(*by, F.lit("taste").alias("key"), "tag", "weight")
    return cosine(tags, whole, by).select(*by, F.col("a").alias("key"), F.col("similarity").alias("adjacency"))


def nearest_neighbors(vectors: DataFrame, top_n: int = 10, targets: DataFrame | None = None, include_self: bool = False) -> DataFrame:
    """(key, neighbor, similarity, rank): per target, the most similar keys above 0; ties by key.

    Exact; only pairs that may be among the best are compared (``neighbours.neighbour_search``).  A vector has a
    row per tag.
    """
    return neighbour_search(vectors, top_n, targets, include_self)[0]


def signals(plays: DataFrame, tags: DataFrame, matched: DataFrame, ref: Column, half_life: float = HALF_LIFE_DAYS, affinity_cap: int | None = 10_000, unplayed_recency: float = 1.0, by: list[str] = []) -> DataFrame:
    """The five signals of every key in ``matched`` (…, key).

    With ``by`` and a ``matched`` of keys alone, each group has those that it played and those near its taste.
    Affinity beyond the cap counts as none.  A performer never played has full recency unless told otherwise.
    With ``by`` the plays are read once: their sums per group and key are written, as several steps read them.
    """
    if by:
        decayed = F.round(F.sum(decay_weight(F.col("scrobbled_at"), ref, half_life)), 6).alias("weight")
        totals = plays.groupBy(*by, "key").agg(decayed, F.count(F.lit(1)).alias("play_count"), F.max("scrobbled_at").alias("scrobbled_at"))
        with freed(plays.sparkSession):
            plays = materialise(totals, "signals-totals")
    affinity = plays.select(*by, "key", "weight", "play_count") if by else decayed_affinity(plays, ref, half_life)
    affinity = affinity if affinity_cap is None else top_affinity(affinity, affinity_cap, by).drop("rank")
    taste = taste_vector(tags, affinity, by)
    near = adjacency(tags.join(matched.select("key").distinct(), "key", "left_semi"), taste, by)
    days = last_play_days(plays, ref, by)
    if by and by[0] not in matched.columns:
        matched = near.select(*by, "key").unionByName(days.select(*by, "key").join(matched.select("key").distinct(), "key", "left_semi").select(*by, "key")).distinct()
    joined = (
        matched.join(affinity.select(*by, "key", "weight", "play_count"), [*by, "key"], "left")
        .join(near, [*by, "key"], "left")
        .join(days, [*by, "key"], "left")
    )
    count, near_value = F.coalesce("play_count", F.lit(0)), F.coalesce("adjacency", F.lit(0.0))
    recency = F.coalesce(recency_signal(F.col("days"), half_life), F.lit(unplayed_recency))
    return joined.select(
        *matched.columns,
        F.coalesce("weight", F.lit(0.0)).alias("taste"),
        near_value.alias("adjacency"),
        discovery_signal(near_value, count).alias("discovery"),
        recency.alias("recency"),
        F.lit(0.0).alias("distance"),
    )
