"""Scored shows: digests, the merged feed, playlists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.functions import links, scoring, venues
from gigmatch.functions.times import day_label, format_time_12h, show_epoch
from gigmatch.operators.travel import first_containing
from gigmatch.sources.shared import BROADCAST_ROWS, materialise

SOON_SECONDS = 7200
#: Pairs of performer and group that a task reduces to best scores.
GROUP_ROWS = 2_000_000
FEED_LIMIT, PLAYLIST_LIMIT, MAX_PLAYS, LEAST_DISCOVERY_SHARE = 2000, 30, 25, 0.5


def matched_only(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status") == "matched")


def upcoming(events: DataFrame, as_of: Column) -> DataFrame:
    return events.filter(F.col("date") >= as_of)


def tags_for_matched(artists: DataFrame, matches: DataFrame) -> DataFrame:
    return artists.join(matched_only(matches), "artist_id", "left_semi")


def best_score_per_event(artist_scores: DataFrame, by: list[str] = []) -> DataFrame:
    """Each show keeps the whole breakdown of its best performer; ties go to the lowest artist_id."""
    keys = [*by, "event_id", "scoring_version"]
    rest = [c for c in artist_scores.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score_total"), -F.col("artist_id"))).alias("_b")
    return artist_scores.groupBy(*keys).agg(best).select(*keys, *[f"_b.{c}" for c in rest])


def best_score_by_group(who: DataFrame, scored: DataFrame, by: list[str], most: int = BROADCAST_ROWS, rows: int = GROUP_ROWS) -> DataFrame:
    """``best_score_per_event`` of ``who`` (event_id, artist_id, key) joined to scores (…, key, terms, total), both written.

    A group's performers are ranked once, best first, so the best one of a show is its smallest rank.  Up to ``most``
    ranks go to every task, where they meet the shows' performers and are reduced at once: only performers are
    shuffled, into partitions of some ``rows`` pairs of performer and group.  More scores are joined by key.
    """
    billed = materialise(who.select("artist_id", "key").distinct().withColumn("_artist", F.monotonically_increasing_id()), "scores-billed")
    if scored.count() > most or billed.count() > most or billed.join(scored, "key").count() > most:
        return best_score_per_event(who.join(scored, "key").drop("key"), by)
    terms = [c for c in scored.columns if c not in [*by, "key", "scoring_version"]]
    order = Window.partitionBy(*by).orderBy(F.desc("score_total"), "artist_id")
    ranks = materialise(billed.join(scored, "key").withColumn("_rank", F.row_number().over(order)), "scores-ranks")
    groups = ranks.groupBy("_artist").count().agg(F.max("count")).first()[0] or 0
    dealt = who.join(F.broadcast(billed), ["artist_id", "key"]).select("event_id", "_artist").repartition(who.count() * groups // rows + 1, "event_id")
    best = dealt.join(F.broadcast(ranks.select(*by, "_artist", "_rank")), "_artist").groupBy(*by, "event_id").agg(F.min("_rank").alias("_least"))
    told = ranks.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_least") == F.col("_rank"))
    return best.join(F.broadcast(told), same).select(*by, "event_id", "scoring_version", "artist_id", *terms)


def collect_matched_names(matches: DataFrame, artists: DataFrame) -> DataFrame:
    named = matched_only(matches).join(artists.select("artist_id", "raw_name"), "artist_id")
    return named.groupBy("event_id").agg(F.array_sort(F.collect_list("raw_name")).alias("matched_artists"))


def digest_join(events: DataFrame, scores: DataFrame, matches: DataFrame, artists: DataFrame, version: str = scoring.DIGEST_VERSION) -> DataFrame:
    scored = scores.filter(F.col("scoring_version") == version)
    names = collect_matched_names(matches, artists)
    joined = events.join(scored, "event_id").join(names, "event_id", "left")
    return joined.withColumn("matched_artists", F.coalesce("matched_artists", F.array().cast("array<string>")))


def digest_order(digest: DataFrame) -> DataFrame:
    return digest.orderBy(F.desc("score_total"), "date", "source_id")


def feed_join(events: DataFrame, scores: DataFrame, matches: DataFrame, artists: DataFrame, version: str, as_of: Column) -> DataFrame:
    """Upcoming shows with score and matched performers where there are any."""
    scored = scores.filter(F.col("scoring_version") == version).select("event_id", "score_total")
    who = matched_only(matches).select("event_id", "artist_id").join(artists.select("artist_id", "raw_name"), "artist_id")
    return upcoming(events, as_of).join(scored, "event_id", "left").join(who, "event_id", "left")


def dedup_event_rows(rows: DataFrame) -> DataFrame:
    """One row per show: the lowest matched performer."""
    order = Window.partitionBy("event_id").orderBy(F.asc_nulls_last("artist_id"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def top_genres(artist_tags: DataFrame, k: int = 3) -> DataFrame:
    """(artist_id, genres): the k heaviest tags in order; ties by tag."""
    order = Window.partitionBy("artist_id").orderBy(F.desc("weight"), "tag")
    top = artist_tags.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "tag")))
    return top.groupBy("artist_id").agg(F.transform(ordered, lambda t: t["tag"]).alias("genres"))


def read_jdbc_matrix(venue_table: DataFrame, base_matrix: DataFrame, home_cell: str) -> DataFrame:
    """Travel from one home cell: (venue_id, name, minutes, miles).  Both tables may come from ``spark.read.jdbc``."""
    here = base_matrix.filter(F.col("cell_id") == home_cell)
    return venue_table.join(here, "venue_id").select(
        "venue_id", "name", venues.travel_minutes(F.col("base_seconds")).alias("minutes"), venues.travel_miles(F.col("base_meters")).alias("miles")
    )


def read_jdbc_tables(spark: SparkSession, url: str, venue_table: str, matrix_table: str, home_cell: str, properties: dict[str, str] = {}, partitions: int = 8) -> DataFrame:
    """``read_jdbc_matrix`` of two tables in a database, read in ``partitions`` ranges of venue_id.

    The database filters the home cell and the columns: no other row leaves it.  The ranges come from the home cell's
    own smallest and largest id.
    """
    home = spark.read.jdbc(url, matrix_table, properties=properties).filter(F.col("cell_id") == home_cell)
    low, high = (int(x or 0) for x in home.agg(F.min("venue_id"), F.max("venue_id")).first())

    def ranged(table: str) -> DataFrame:
        return spark.read.jdbc(url, table, column="venue_id", lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=properties)

    matrix = ranged(matrix_table).select("venue_id", "cell_id", "base_seconds", "base_meters")
    venue = ranged(venue_table).select("venue_id", "name").filter(F.col("venue_id").between(low, high))
    return read_jdbc_matrix(venue, matrix, home_cell)


def venue_travel(venue_names: DataFrame, travel: DataFrame) -> DataFrame:
    """(venue, minutes, miles): the first travel row, by venue_id, whose name holds the venue's or lies in it.

    Distinct names run through automata of the other side's (``travel.first_containing``).  Empty normal forms match
    nothing.
    """
    asked = venue_names.select("venue").distinct().withColumn("_v", venues.normalize_venue(F.col("venue"))).filter("_v <> ''")
    there = travel.select("venue_id", "minutes", "miles", venues.normalize_venue(F.col("name")).alias("_k"))
    first = first_containing(asked.select(F.col("_v").alias("v")).distinct(), there.filter("_k <> ''").select(F.col("_k").alias("k"), "venue_id"))
    one = there.groupBy("venue_id").agg(F.min(F.struct("minutes", "miles")).alias("_f")).withColumnRenamed("venue_id", "_id")
    pairs = asked.join(first, F.col("_v") == F.col("v")).join(one, F.col("venue_id") == F.col("_id"))
    return pairs.select("venue", "_f.minutes", "_f.miles")


def best_link(rows: DataFrame, group: list[str], url: str = "ticket_url", ord: str = "ord") -> DataFrame:
    """Per group the URL of the highest-ranked provider, the first on ties; (null, none) where no URL has a host."""
    provider = links.classify_provider(F.col(url))
    marked = rows.select(*group, F.col(url).alias("_url"), F.col(ord).alias("_ord"), provider.alias("_p"))
    usable = F.when(F.col("_p") != "none", F.struct(F.col("_url").alias("url"), F.col("_p").alias("provider")))
    rank = F.when(F.col("_p") != "none", F.struct(links.provider_rank(F.col("_p")), -F.col("_ord")))
    best = marked.groupBy(*group).agg(F.max_by(usable, rank).alias("_b"))
    return best.select(*group, F.col("_b.url").alias("url"), F.coalesce("_b.provider", F.lit("none")).alias("provider"))


def merge_shows(shows: DataFrame) -> DataFrame:
    """One row per show over all sources: the best-scored listing, with the best link of all of them.

    Listings of one show come in feed order: best score first, unscored last, then by ``ord``; the first wins ties.
    Constant memory per show: no group is collected.
    """
    key = venues.show_key(F.col("venue"), F.col("date"), F.col("headliner"))
    keyed = shows.withColumn("_key", key)
    names = [c for c in shows.columns if c not in ("ticket_url",)]
    provider = links.classify_provider(F.col("ticket_url"))
    usable = provider != "none"
    place = [F.col("score_total").isNotNull(), F.coalesce("score_total", F.lit(-1)), -F.col("ord")]
    link = F.max_by(
        F.when(usable, F.struct(F.col("ticket_url").alias("url"), provider.alias("provider"))),
        F.when(usable, F.struct(links.provider_rank(provider), *place)),
    )
    first = F.max_by(F.struct(*names), F.struct(*place))
    merged = keyed.groupBy("_key").agg(first.alias("_r"), link.alias("_l"), F.count(F.lit(1)).alias("listings"))
    chosen = F.coalesce("_l.provider", F.lit("none"))
    return merged.select(
        *[f"_r.{c}" for c in names], F.col("_l.url").alias("ticket_url"), chosen.alias("ticket_provider"),
        links.provider_label(chosen).alias("ticket_provider_label"), "listings",
    )


def feed_order(feed: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    return feed.orderBy(F.desc_nulls_last("score_total"), "date", "event_id").limit(limit)


def feed_rows(joined: DataFrame, genres: DataFrame, travel: DataFrame, as_of: Column) -> DataFrame:
    """Display columns of the feed, one row per show, before merging."""
    rows = dedup_event_rows(joined).withColumn("venue", venues.canonicalize_venue(F.col("venue")))
    rows = rows.join(genres, "artist_id", "left").join(travel, "venue", "left")
    return rows.select(
        "event_id", "source", "headliner", "venue", "date", "ticket_url",
        venues.venue_size(F.col("venue")).alias("venue_size"),
        day_label(F.col("date"), as_of).alias("date_display"),
        format_time_12h(F.col("doors_time")).alias("doors_display"),
        format_time_12h(F.col("show_time")).alias("show_display"),
        scoring.score_to_100(F.col("score_total")).alias("score_total"),
        F.col("raw_name").alias("matched_artist"),
        F.col("minutes").alias("travel_minutes"),
        "genres",
        show_epoch(F.col("date"), F.col("show_time"), F.col("doors_time")).alias("timestamp"),
    )


def feed_filter(feed: DataFrame, as_of: Column, date_range: str = "all", matched: bool = False, favourites: DataFrame | None = None) -> DataFrame:
    last = {"tonight": 0, "week": 7, "month": 30}.get(date_range)
    if date_range == "tonight":
        feed = feed.filter(F.col("date") == as_of)
    elif last is not None:
        feed = feed.filter(F.col("date") <= F.date_add(as_of, last))
    if matched:
        feed = feed.filter(F.col("score_total").isNotNull())
    return feed if favourites is None else feed.join(favourites.select("venue"), "venue", "left_semi")


def time_flags(feed: DataFrame, now: Column, today: Column) -> DataFrame:
    """``feed`` with is_past, is_soon (by epoch seconds) and day_label."""
    ts = F.col("timestamp")
    return feed.withColumns({
        "is_past": ts < now - SOON_SECONDS,
        "is_soon": (ts > now) & (ts < now + SOON_SECONDS),
        "day_label": day_label(F.col("date"), today),
    })


def venue_counts(feed: DataFrame) -> DataFrame:
    """(size, label, venue, n): shows per venue by tier."""
    size = F.min("venue_size")
    counted = feed.groupBy("venue").agg(size.alias("size"), F.count(F.lit(1)).alias("n"))
    table = F.create_map(*[F.lit(x) for pair in venues.TIER_LABELS.items() for x in pair])
    return counted.select("size", F.try_element_at(table, F.col("size")).alias("label"), "venue", "n")


def _day_order(sort_mode: str) -> list[Column]:
    by_time = [F.col("timestamp"), F.col("event_id")]
    return by_time if sort_mode == "date" else [F.col("score_total").isNull(), -F.coalesce("score_total", F.lit(0)), *by_time]


def feed_day_rows(feed: DataFrame, sort_mode: str = "date") -> DataFrame:
    """(day, place, event_id): a row per show, placed in its day by time, or by score with unscored ones last."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(*_day_order(sort_mode)))
    return feed.select(F.col("date").alias("day"), place.alias("place"), "event_id")


def feed_by_day(feed: DataFrame, sort_mode: str = "date") -> DataFrame:
    """(day, shows): ids of each day's shows in the order of ``feed_day_rows``, for days that fit one value."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(_day_order(sort_mode))]
    listed = F.array_sort(F.collect_list(F.struct(*keys, F.col("event_id").alias("id"))))
    return feed.groupBy(F.col("date").alias("day")).agg(F.transform(listed, lambda s: s["id"]).alias("shows"))


def candidate_artists(matches: DataFrame, scores: DataFrame, artists: DataFrame, version: str = scoring.FEED_VERSION) -> DataFrame:
    """Each matched performer with the best total of its shows."""
    scored = scores.filter(F.col("scoring_version") == version).select("event_id", "score_total")
    best = matched_only(matches).join(scored, "event_id").groupBy("artist_id").agg(F.max("score_total").alias("score"))
    return best.join(artists.select("artist_id", "raw_name"), "artist_id")


def select_artists(candidates: DataFrame, limit: int = PLAYLIST_LIMIT, max_plays: int = MAX_PLAYS, by: list[str] = []) -> DataFrame:
    """The best candidates (…, artist_id, raw_name, score, plays), least played first on ties, with their rank."""
    order = [F.desc("score"), F.asc("plays"), F.asc("raw_name"), F.asc("artist_id")]
    marked = candidates.withColumn("under_explored", scoring.under_explored(F.col("plays"), max_plays))
    if by:
        ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.filter(F.col("rank") <= limit)
    top = marked.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``limit`` rows


def tracks_per_artist(top_tracks: DataFrame, k: int = 1) -> DataFrame:
    order = Window.partitionBy("artist_name").orderBy("rank", "track_name")
    return top_tracks.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def rank_candidates(candidates: DataFrame, request: list[str], limit: int = 5) -> DataFrame:
    order = Window.partitionBy(*request).orderBy(F.desc("match_score"), F.coalesce("uri", F.lit("")))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def under_explored_pct(plan: DataFrame) -> DataFrame:
    """(share, enough): share of distinct performers that are little played; 0 for an empty plan."""
    share = F.coalesce(F.avg(F.col("under_explored").cast("double")), F.lit(0.0))
    got = plan.select("artist_id", "under_explored").distinct().agg(share.alias("share"))
    return got.withColumn("enough", F.col("share") >= LEAST_DISCOVERY_SHARE)


def plan_summary(plan: DataFrame) -> DataFrame:
    counts = plan.agg(F.count(F.lit(1)).alias("track_count"), F.count_if(F.col("uri").isNotNull()).alias("resolved_count"))
    return counts.crossJoin(under_explored_pct(plan).select(F.col("share").alias("under_explored_pct")))  # one row each

