"""The library's tables, mapped onto the driver's: plays from order lines, shows from orders, performers from parts.

Each view is built once as a DataFrame and once as SQL, independently.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REF, EVENTS_REF = "2001-11-30 00:00:00", "2024-01-31 00:00:00"
HALF_LIFE = 365.0
AS_OF = "2001-06-01"
HOSTS = (
    "www.etix.com", "www.ticketmaster.com", "dice.fm", "the_venue.example.org", "concerts.livenation.com",
    "www.songkick.com", "user@tickets.axs.com", "www.bandsintown.com:443",
)


def ref() -> Column:
    return F.lit(REF).cast("timestamp")


def events_ref() -> Column:
    return F.lit(EVENTS_REF).cast("timestamp")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; times are read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def id_of(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def plays(spark: SparkSession, sf: str, listeners: DataFrame | None = None) -> DataFrame:
    """Plays, with the columns of ``listeners`` (user_id, …) if given; they are joined to orders, before their lines are."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    order = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    order = order if listeners is None else order.join(listeners, "user_id")
    name = F.concat_ws(" ", "p_brand", "p_name")
    part = table(spark, sf, "part").select("p_partkey", name.alias("artist_name"), id_of(name).alias("artist_id"))
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(
        *([] if listeners is None else [c for c in listeners.columns if c != "user_id"]),
        "user_id",
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("scrobbled_at"),
        "artist_name",
        F.concat(F.lit("track-"), F.col("l_partkey").cast("string")).alias("track_name"),
        "artist_id",
    )


def artists(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_name")
    rows = table(spark, sf, "part").select(name.alias("raw_name")).distinct().withColumn("artist_id", id_of(F.col("raw_name")))
    known = F.col("artist_id") % 3 != 0
    mbid = F.when(known, F.concat(F.lit("mb-"), F.md5("raw_name")))
    return rows.select("artist_id", "raw_name", mbid.alias("mbid"), known.alias("resolved"))


def artist_tags(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tags = F.array("p_type", "p_brand", F.concat(F.lit("size-"), F.col("p_size").cast("string")))
    rows = part.select(id_of(F.concat_ws(" ", "p_brand", "p_name")).alias("artist_id"), F.explode(tags).alias("tag"))
    return rows.groupBy("artist_id", "tag").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def shows(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("artist"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    grouped = joined.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "artist")).alias("first"),
        F.array_sort(F.collect_set("artist")).alias("everyone"),
        F.min("l_shipdate").cast("date").alias("date"),
        F.min("s_name").alias("venue"),
    )
    order = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    rows = order.join(grouped, order["o_orderkey"] == grouped["l_orderkey"])
    key = F.col("o_orderkey")
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), (key % len(HOSTS)).cast("int"))
    return rows.select(
        key.alias("event_id"),
        F.col("o_orderpriority").alias("source"),
        key.cast("string").alias("source_id"),
        F.col("first.artist").alias("headliner"),
        F.slice(F.filter("everyone", lambda a: a != F.col("first.artist")), 1, 3).alias("openers"),
        "date",
        F.when(key % 3 == 0, "18:30").alias("doors_time"),
        F.when(key % 4 != 0, F.concat(F.lpad((key % 13 + 10).cast("string"), 2, "0"), F.lit(":15"))).alias("show_time"),
        "venue",
        F.when(key % 11 != 0, F.concat(F.lit("https://"), host, F.lit("/p/"), key.cast("string"), F.lit("/buy"))).alias("ticket_url"),
    )


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every billed performer of every show; each tenth show's are still for review."""
    show = shows(spark, sf)
    names = show.select("event_id", F.posexplode(F.concat(F.array("headliner"), F.col("openers"))).alias("pos", "matched_name"))
    status = F.when(F.col("event_id") % 10 == 0, "review").otherwise("matched")
    return names.select(
        "event_id", id_of(F.col("matched_name")).alias("artist_id"), "matched_name", F.lit("exact").alias("match_type"),
        F.lit(1.0).alias("confidence"), status.alias("status"), "pos",
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    a, e = F.col("artist_id"), F.col("event_id")
    return matches(spark, sf).filter("status = 'matched'").select(
        "event_id", "artist_id",
        ((a % 1000) / 100.0).alias("taste"), ((e % 97) / 97.0).alias("adjacency"), ((a % 89) / 89.0).alias("discovery"),
        ((e % 31) / 31.0).alias("recency"), F.lit(0.0).alias("distance"),
    )


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Daily captures of event kinds: one show per user seen that day, its openers the keys of that day."""
    events = table(spark, sf, "events")
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    rows = events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("captured_at"), F.col("user_id").cast("string").alias("source_id"))
    return rows.agg(F.array_sort(F.collect_set(key)).alias("openers"), F.min(F.to_date("ts")).alias("date"), F.concat(F.lit("act-"), F.max(F.col("user_id") % 50).cast("string")).alias("headliner"))


VIEWS = {
    "plays": """SELECT o_custkey AS user_id, o_orderdate + to_hours(l_linenumber) AS scrobbled_at,
        p_brand || ' ' || p_name AS artist_name, 'track-' || l_partkey AS track_name,
        ('0x' || substr(md5(p_brand || ' ' || p_name), 1, 12))::BIGINT AS artist_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "artists": """SELECT artist_id, raw_name, CASE WHEN artist_id % 3 <> 0 THEN 'mb-' || md5(raw_name) END AS mbid,
        artist_id % 3 <> 0 AS resolved FROM (SELECT DISTINCT p_brand || ' ' || p_name AS raw_name,
        ('0x' || substr(md5(p_brand || ' ' || p_name), 1, 12))::BIGINT AS artist_id FROM part)""",
    "artist_tags": """SELECT artist_id, tag, count(*)::DOUBLE AS weight FROM (
        SELECT ('0x' || substr(md5(p_brand || ' ' || p_name), 1, 12))::BIGINT AS artist_id,
        unnest([p_type, p_brand, 'size-' || p_size]) AS tag FROM part) GROUP BY ALL""",
    "keyed_plays": """SELECT user_id, coalesce(a.mbid, p.artist_name) AS key, p.artist_name AS raw_name, scrobbled_at
        FROM plays p JOIN artists a USING (artist_id)""",
    "shows": f"""SELECT o_orderkey AS event_id, o_orderpriority AS source, o_orderkey::VARCHAR AS source_id, headliner,
        list_filter(everyone, lambda a: a <> headliner)[1:3] AS openers, date,
        CASE WHEN o_orderkey % 3 = 0 THEN '18:30' END AS doors_time,
        CASE WHEN o_orderkey % 4 <> 0 THEN lpad((o_orderkey % 13 + 10)::VARCHAR, 2, '0') || ':15' END AS show_time, venue,
        CASE WHEN o_orderkey % 11 <> 0 THEN 'https://' || {list(HOSTS)}[o_orderkey % {len(HOSTS)} + 1] || '/p/' || o_orderkey || '/buy' END
        AS ticket_url FROM orders JOIN (
            SELECT l_orderkey, arg_min(artist, (l_linenumber, artist)) AS headliner, list_sort(list_distinct(list(artist))) AS everyone,
            min(l_shipdate)::DATE AS date, min(s_name) AS venue
            FROM (SELECT l.*, p_brand || ' ' || p_name AS artist, s_name FROM lineitem l JOIN part ON l_partkey = p_partkey
                  JOIN supplier ON l_suppkey = s_suppkey) GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "names": """SELECT event_id, (generate_subscripts(billing, 1) - 1)::INTEGER AS pos, unnest(billing) AS name
        FROM (SELECT event_id, [headliner] || openers AS billing FROM shows)""",
    "matches": """SELECT event_id, ('0x' || substr(md5(name), 1, 12))::BIGINT AS artist_id, name AS matched_name,
        'exact' AS match_type, 1.0::DOUBLE AS confidence, CASE WHEN event_id % 10 = 0 THEN 'review' ELSE 'matched' END AS status, pos FROM names""",
    "signals": """SELECT event_id, artist_id, (artist_id % 1000) / 100.0::DOUBLE AS taste, (event_id % 97) / 97.0::DOUBLE AS adjacency,
        (artist_id % 89) / 89.0::DOUBLE AS discovery, (event_id % 31) / 31.0::DOUBLE AS recency, 0.0::DOUBLE AS distance
        FROM matches WHERE status = 'matched'""",
    "artist_scores": """SELECT event_id, artist_id, version AS scoring_version, taste_score, adjacency_score, discovery_score, recency_score,
        0.0::DOUBLE AS distance_score,
        round(taste_score + adjacency_score + discovery_score + recency_score + 0.0, 6) AS score_total FROM (
        SELECT event_id, artist_id, version, round(CASE WHEN version = 'exact-match-v1' THEN taste WHEN taste > 0 THEN 0.5 * (taste / (taste + 5.0)) ELSE 0 END, 6) AS taste_score,
        round(CASE WHEN version = 'exact-match-v1' THEN 0 ELSE 0.5 * adjacency END, 6)::DOUBLE AS adjacency_score,
        round(CASE WHEN version = 'exact-match-v1' THEN 0 ELSE 2.0 * discovery END, 6)::DOUBLE AS discovery_score,
        round(CASE WHEN version = 'exact-match-v1' THEN 0 ELSE 0.3::DOUBLE * recency END, 6)::DOUBLE AS recency_score
        FROM signals, (SELECT unnest(['exact-match-v1', 'discovery-v1']) AS version))""",
    "scores": """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id, scoring_version
        ORDER BY score_total DESC, artist_id) AS n FROM artist_scores) WHERE n = 1""",
    "captures": """SELECT event_type AS source, ts::DATE AS captured_at, user_id::VARCHAR AS source_id,
        list_sort(list_distinct(list('k' || json_extract_string(props, '$.k')))) AS openers, min(ts::DATE) AS date,
        'act-' || max(user_id % 50) AS headliner FROM events GROUP BY 1, 2, 3""",
}


def sql(text: str) -> str:
    """``text`` with the views that it names, and those that they name, before it."""
    used: list[str] = []

    def need(part: str) -> None:
        for name, body in VIEWS.items():
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", part):
                need(body)
                used.append(name)

    need(text)
    return f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in used)}\n{text}" if used else text
