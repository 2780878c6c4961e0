"""All registered queries (``QUERIES``, ``SQL``); here those of sources and sinks, captures, upserts, digest, feed, playlist, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmatch.operators import captures, history, shows, upserts
from gigmatch.plans import jobs, views
from gigmatch.plans.catalogue import (
    AFFINITY,
    EPOCH,
    LABEL,
    NORM_VENUE,
    PROVIDERS,
    QUERIES,
    RANK,
    SQL,
    keyed,
    pick,
    query,
    scores,
    with_venue,
)
from gigmatch.plans.views import AS_OF, HALF_LIFE, as_of, ref, table
from gigmatch.sources import files, html_feeds, json_feeds
from gigmatch.streaming import streams

__all__ = ["QUERIES", "SQL"]

#: Ids of shows that share a page: pages grow in number with the table, not in length.
PAGE = 200
MADE = "source, source_id, headliner, array_to_string(openers, '+') AS openers, date, show_time, venue, ticket_url"


def flat(df):
    return df.withColumn("openers", F.array_join("openers", "+")).select("source", "source_id", "headliner", "openers", "date", "show_time", "venue", "ticket_url")


def obj(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


# --- sources ------------------------------------------------------------------------------------------------------


@query("""SELECT scrobbled_at::TIMESTAMPTZ::TIMESTAMP AS scrobbled_at, artist_name, track_name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'album-' || user_id END AS album_name
    FROM plays WHERE user_id % 7 <> 0 AND user_id % 11 <> 0 AND user_id % 13 <> 0""")
def parse_play_history(spark, sf):
    u = F.col("user_id")
    play = F.struct(
        F.struct(F.concat(F.lit(" "), "artist_name").alias("#text")).alias("artist"),
        F.struct(F.when(u % 3 == 0, " ").otherwise(F.concat(F.lit("album-"), u.cast("string"))).alias("#text")).alias("album"),
        F.when(u % 13 == 0, "  ").otherwise(F.col("track_name")).alias("name"),
        F.when(u % 7 != 0, F.struct(F.unix_seconds("scrobbled_at").cast("string").alias("uts"))).alias("date"),
        F.when(u % 11 == 0, F.struct(F.lit("true").alias("nowplaying"))).alias("@attr"),
    )
    pages = views.plays(spark, sf).groupBy("user_id").agg(F.collect_list(play).alias("track"))
    return json_feeds.parse_play_history(pages.select(obj(recenttracks=F.struct("track")).alias("raw_json")))


@query("SELECT scrobbled_at, artist_name, track_name, NULL::VARCHAR AS album_name FROM plays WHERE user_id % 5 <> 0 AND user_id % 6 <> 0")
def valid_plays(spark, sf):
    u = F.col("user_id")
    parsed = views.plays(spark, sf).select(
        F.when(u % 5 == 0, "1").alias("now_playing"), F.when(u % 6 != 0, F.unix_seconds("scrobbled_at")).alias("uts"), "artist_name", "track_name", F.lit("  ").alias("album_name")
    )
    return history.valid_plays(parsed)


@query(f"""SELECT 'tm' AS source, source_id, headliner, array_to_string(openers, '+') AS openers, date, show_time,
    CASE WHEN event_id % 7 = 0 THEN 'Unknown Venue' ELSE venue END AS venue, ticket_url FROM shows WHERE event_id % 17 <> 0""")
def parse_ticketing_json(spark, sf):
    e = F.col("event_id")
    acts = F.transform(F.concat(F.array("headliner"), F.array(F.lit("")), F.col("openers")), lambda n: F.struct(n.alias("name")))
    event = F.struct(
        F.when(e % 17 != 0, F.col("source_id")).alias("id"), F.lit("Some Night").alias("name"), F.col("ticket_url").alias("url"),
        F.struct(F.struct(F.col("date").cast("string").alias("localDate"), F.concat("show_time", F.lit(":00")).alias("localTime")).alias("start")).alias("dates"),
        F.struct(F.when(e % 7 != 0, F.array(F.struct(F.col("venue").alias("name")))).alias("venues"), acts.alias("attractions")).alias("_embedded"),
    )
    pages = views.shows(spark, sf).groupBy(F.floor(e / PAGE).alias("page")).agg(F.collect_list(event).alias("events"))
    return flat(json_feeds.parse_ticketing_json(pages.select(obj(_embedded=F.struct("events")).alias("raw_json")), "tm"))


@query("""SELECT 'flat' AS source, source_id, headliner || ' & Friends, &lt;b> café ©' AS headliner, '' AS openers, date, show_time, 'The Room' AS venue, ticket_url
    FROM shows WHERE event_id % 6 <> 0""")
def parse_flat_events_json(spark, sf):
    title = F.concat("headliner", F.lit(" &#38; Friends, &#38;lt;b&#62; caf&eacute; &copy;"), F.when(F.col("event_id") % 6 == 0, " CANCELLED").otherwise(""))
    event = F.struct(F.concat_ws(" ", F.col("date").cast("string"), F.concat("show_time", F.lit(":00"))).alias("start_date"), title.alias("title"), F.col("source_id").alias("id"), F.col("ticket_url").alias("url"))
    pages = views.shows(spark, sf).groupBy(F.floor(F.col("event_id") / PAGE).alias("page")).agg(F.collect_list(event).alias("events"))
    return flat(json_feeds.parse_flat_events_json(pages.select(obj(events=F.col("events")).alias("raw_json")), "flat", "The Room"))


@query("""SELECT 'ld' AS source, source_id, headliner, '' AS openers, date, show_time, 'House' AS venue,
    coalesce(ticket_url, 'https://house.example.org/') AS ticket_url FROM shows WHERE event_id % 8 <> 0""")
def extract_jsonld_events(spark, sf):
    e = F.col("event_id")
    start = F.concat(F.date_format("date", "yyyy-M-d"), F.coalesce(F.concat(F.lit("T"), "show_time", F.lit("-7:00")), F.lit("")))
    body = F.to_json(F.struct(F.when(e % 8 == 0, "Closed today").otherwise(F.col("headliner")).alias("name"), start.alias("startDate"), F.col("source_id").alias("@id"), F.col("ticket_url").alias("url")))
    block = F.concat(F.lit('<div class="event"><script type="application/ld+json">'), body, F.lit("</script></div>"))
    pages = views.shows(spark, sf).groupBy(F.floor(e / PAGE).alias("page")).agg(F.array_join(F.collect_list(block), "\n").alias("html"))
    return flat(html_feeds.extract_jsonld_events(pages, "ld", "House", "https://house.example.org/"))


@query("SELECT 'emb' AS source, source_id, headliner, '' AS openers, date, show_time, 'Tavern' AS venue, ticket_url FROM shows WHERE event_id % 9 <> 0")
def extract_embedded_json_events(spark, sf):
    e = F.col("event_id")
    start = F.concat(F.col("date").cast("string"), F.coalesce(F.concat(F.lit("T"), "show_time", F.lit(":00-08:00")), F.lit("")))
    item = F.struct(F.when(e % 9 == 0, "closed").otherwise(F.col("headliner")).alias("title"), start.alias("start"), F.col("source_id").alias("id"), F.col("ticket_url").alias("url"))
    held = F.replace(F.to_json(F.collect_list(item)), F.lit('"'), F.lit("&quot;"))
    pages = views.shows(spark, sf).groupBy(F.floor(e / PAGE).alias("page")).agg(F.concat(F.lit('<div class="cal" data-events="'), held, F.lit('"></div>')).alias("html"))
    return flat(html_feeds.extract_embedded_json_events(pages, "data-events", "emb", "Tavern"))


CARD = html_feeds.CardSpec(
    "cards", html_feeds.Select("div", "card", take="data-id"), html_feeds.Select("h2"), html_feeds.Select("meta", attr="itemprop", value="startDate", take="content"),
    html_feeds.Select("a", take="href"), html_feeds.Select("span", "time"), html_feeds.Select("span", "venue"),
)


@query("""SELECT 'cards' AS source, source_id, headliner, array_to_string(openers, '+') AS openers, date, show_time, venue, ticket_url FROM shows WHERE ticket_url IS NOT NULL""")
def extract_card_events(spark, sf):
    title = F.array_join(F.concat(F.array("headliner"), F.col("openers")), " • ")
    clock = F.coalesce(F.concat(F.lit("Show: "), F.date_format(F.concat(F.lit("2000-01-01 "), "show_time").cast("timestamp"), "h:mm a")), F.lit("tba"))
    card = F.concat(
        F.lit('<div class="event card" data-id="'), "source_id", F.lit('"><meta itemprop="startDate" content="'), F.col("date").cast("string"), F.lit('"><h2>'), title,
        F.lit('</h2><span class="venue">'), "venue", F.lit('</span><span class="time">'), clock, F.lit('</span><a href="'), "ticket_url", F.lit('">tickets</a></div>'),
    )
    rows = views.shows(spark, sf).filter("ticket_url IS NOT NULL")
    pages = rows.groupBy(F.floor(F.col("event_id") / PAGE).alias("page")).agg(F.array_join(F.collect_list(F.concat(card, card)), "<br>").alias("html"))
    return flat(html_feeds.extract_card_events(pages, CARD, as_of()))


DAY28 = "least(day(date), 28)"
INFERRED = f"(CASE WHEN date_diff('day', make_date(2001, month(date), {DAY28}), DATE '{AS_OF}') <= 90 THEN make_date(2001, month(date), {DAY28}) ELSE make_date(2002, month(date), {DAY28}) END)"
LISTED = f"SELECT *, {INFERRED} AS day FROM shows"
DATE_ID = "day || '-' || lower(replace(substr(headliner, 1, 10), ' ', ''))"


def calendar_lines(spark, sf):
    """Each show as a page: weekday line, headliner and openers, a sold-out line, a line of another weekday, a stop, a stray line."""
    day = F.concat(F.lit("Friday "), F.date_format("date", "MMMM"), F.lit(" "), F.least(F.day("date"), F.lit(28)).cast("string"), F.coalesce(F.concat(F.lit(" ("), F.date_format(F.concat(F.lit("2000-01-01 "), "show_time").cast("timestamp"), "h:mm a"), F.lit(")")), F.lit("")))
    lines = F.array(F.lit("Calendar"), day, F.array_join(F.concat(F.array("headliner"), F.col("openers")), " - "), F.lit("Sold Out"), F.lit("Sunday jam"), F.lit("Home"), F.lit("Stray"))
    return views.shows(spark, sf).select(F.col("event_id").alias("page_id"), F.posexplode(lines).alias("line_no", "line"))


@query(f"""SELECT 'cal' AS source, {DATE_ID} AS source_id, headliner, array_to_string(openers, '+') AS openers, day AS date, show_time, 'Club' AS venue, 'https://club.example.org/' AS ticket_url
    FROM ({LISTED}) JOIN (SELECT event_id FROM shows) USING (event_id)""")
def extract_listing_lines(spark, sf):
    return flat(html_feeds.extract_listing_lines(calendar_lines(spark, sf), "cal", "Club", "https://club.example.org/", as_of()))


@query(f"""SELECT event_id AS page_id, i::INTEGER AS line_no, CASE WHEN i BETWEEN 1 AND 4 THEN day END AS date FROM ({LISTED}), range(0, 7) r(i) WHERE event_id IN (SELECT event_id FROM shows)""")
def carry_forward_date(spark, sf):
    return html_feeds.carry_forward_date(calendar_lines(spark, sf), as_of()).select("page_id", "line_no", "date")


@query(f"""SELECT 'par' AS source, {DATE_ID} AS source_id, headliner, array_to_string(openers, '+') AS openers, day AS date, '20:00' AS show_time, 'Lounge' AS venue, 'https://lounge.example.org/' AS ticket_url
    FROM ({LISTED}) WHERE event_id % 5 <> 0 AND event_id IN (SELECT event_id FROM shows)""")
def extract_paragraph_events(spark, sf):
    guests = F.when(F.size("openers") > 0, F.concat(F.lit("\nw/ "), F.array_join("openers", " & "))).otherwise("")
    weekly = F.when(F.col("event_id") % 5 == 0, "\nevery Thursday").otherwise("")
    day = F.concat(F.lit("\nSat "), F.date_format("date", "MMM"), F.lit(" "), F.least(F.day("date"), F.lit(28)).cast("string"), F.lit("th"))
    text = F.concat("headliner", day, guests, F.lit("\nShow 8PM​"), weekly)
    return flat(html_feeds.extract_paragraph_events(views.shows(spark, sf).select(text.alias("paragraph")), "par", "Lounge", "https://lounge.example.org/", as_of()))


@query("SELECT raw_name AS artist, tag, CASE WHEN tag LIKE 'size-1%' THEN 0.0 ELSE weight END::DOUBLE AS weight FROM artists JOIN artist_tags USING (artist_id)")
def parse_artist_tags(spark, sf):
    count = F.when(F.col("tag").startswith("size-1"), "many").otherwise(F.col("weight").cast("string"))
    tag = F.struct(F.col("tag").alias("name"), count.alias("count"))
    rows = views.artists(spark, sf).join(views.artist_tags(spark, sf), "artist_id").groupBy("raw_name").agg(F.concat(F.collect_list(tag), F.array(F.struct(F.lit("").alias("name"), F.lit("1").alias("count")))).alias("tag"))
    return json_feeds.parse_artist_tags(rows.select(obj(toptags=F.struct("tag", F.struct(F.col("raw_name").alias("artist")).alias("@attr"))).alias("raw_json")))


TOP_TRACKS = "SELECT artist_name, track_name, row_number() OVER (PARTITION BY artist_name ORDER BY n DESC, track_name)::INTEGER AS rank FROM (SELECT artist_name, track_name, count(*) AS n FROM plays GROUP BY 1, 2)"


def top_tracks(spark, sf):
    from pyspark.sql import Window

    counted = views.plays(spark, sf).groupBy("artist_name", "track_name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("artist_name").orderBy(F.desc("n"), "track_name")
    return counted.select("artist_name", "track_name", F.row_number().over(order).alias("rank"))


@query(f"SELECT artist_name AS artist, rank, track_name AS track FROM ({TOP_TRACKS}) JOIN (SELECT DISTINCT artist_name FROM plays) USING (artist_name)")
def parse_top_tracks(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "track_name"))), lambda t: F.struct(t["track_name"].alias("name")))
    rows = top_tracks(spark, sf).groupBy("artist_name").agg(F.concat(F.array(F.struct(F.lit("").alias("name"))), listed).alias("track"))
    return json_feeds.parse_top_tracks(rows.select(obj(toptracks=F.struct("track", F.struct(F.col("artist_name").alias("artist")).alias("@attr"))).alias("raw_json")))


@query("SELECT event_id AS request_id, 'uri:' || (pos + 0) AS uri, matched_name AS name, matched_name || ', guest' AS artists, (event_id % 100)::INTEGER AS popularity FROM matches")
def parse_track_candidates(spark, sf):
    name = F.col("matched_name")
    item = F.struct(F.concat(F.lit("uri:"), F.col("pos").cast("string")).alias("uri"), name.alias("name"), F.array(F.struct(name.alias("name")), F.struct(F.lit("guest").alias("name"))).alias("artists"), (F.col("event_id") % 100).cast("int").alias("popularity"))
    rows = views.matches(spark, sf).groupBy(F.col("event_id").alias("request_id")).agg(F.collect_list(item).alias("items"))
    return json_feeds.parse_track_candidates(rows.select("request_id", obj(tracks=F.struct("items")).alias("raw_json")))


def raw_shows(spark, sf):
    s = views.shows(spark, sf)
    return s.select("source", "source_id", "headliner", "openers", "date", "doors_time", "show_time", "venue", F.lit(None).cast("date").alias("on_sale_date"), "ticket_url")


@query(f"SELECT source, TIMESTAMP '{views.REF}' AS captured_at, count(*) AS event_count, sum(length(headliner))::BIGINT AS letters FROM shows GROUP BY 1")
def write_snapshot(spark, sf):
    path = streams.shared_dir(spark, "snapshots")
    files.write_snapshot(raw_shows(spark, sf), ref(), path)
    files.write_snapshot(raw_shows(spark, sf), ref(), path)  # again: replaces the capture
    letters = F.sum(F.length("headliner")).alias("letters")
    found = files.read_snapshots(spark, path).groupBy("source", "captured_at").agg(letters)
    return files.read_captures(spark, path).join(found, ["source", "captured_at"])


@query(f"SELECT {MADE} FROM shows")
def read_snapshots(spark, sf):
    path = streams.shared_dir(spark, "snapshots")
    files.write_snapshot(raw_shows(spark, sf), ref(), path)
    return flat(files.read_snapshots(spark, path))


@query(f"SELECT source, TIMESTAMP '{views.REF}' AS captured_at, count(*) AS event_count, sum(length(headliner))::BIGINT AS letters FROM shows GROUP BY 1 ")
def snapshot_rows(spark, sf):
    made = files.snapshot_rows(raw_shows(spark, sf), ref())
    names = F.from_json("raw_content", "array<struct<headliner: string>>")
    letters = F.aggregate(names, F.lit(0).cast("long"), lambda s, x: s + F.length(x["headliner"]))
    counted = made.select("source", "captured_at", "event_count", letters.alias("letters")).groupBy("source", "captured_at")
    return counted.agg(F.sum("event_count").alias("event_count"), F.sum("letters").alias("letters"))


@query(f"SELECT {MADE} FROM shows ")
def parse_snapshots(spark, sf):
    return flat(files.parse_snapshots(files.snapshot_rows(raw_shows(spark, sf), ref())))


def travel(spark, sf):
    s = table(spark, sf, "supplier")
    venue = s.select(F.col("s_suppkey").alias("venue_id"), F.concat("s_name", F.lit(" Theater")).alias("name"))
    base = s.select(F.col("s_suppkey").alias("venue_id"), F.when(F.col("s_suppkey") % 4 == 0, "away").otherwise("home").alias("cell_id"), (F.col("s_suppkey") * 97 % 7200).alias("base_seconds"), (F.col("s_suppkey") * 1013 % 90000).alias("base_meters"))
    return shows.read_jdbc_matrix(venue, base, "home")


TRAVEL = "SELECT s_suppkey AS venue_id, s_name || ' Theater' AS name, round_even(s_suppkey * 97 % 7200 / 60.0::DOUBLE, 0)::INTEGER AS minutes, round((s_suppkey * 1013 % 90000) / 1609.34::DOUBLE, 1) AS miles FROM supplier WHERE s_suppkey % 4 <> 0"


@query(TRAVEL)
def read_jdbc_matrix(spark, sf):
    return travel(spark, sf)


@query(f"""SELECT venue, arg_min(minutes, venue_id) AS minutes, arg_min(miles, venue_id) AS miles FROM (SELECT DISTINCT venue, trim(lower(venue)) AS v FROM shows)
    JOIN (SELECT *, trim(replace(lower(name), 'theater', '')) AS k FROM ({TRAVEL})) ON contains(v, k) OR contains(k, v) GROUP BY 1""")
def venue_travel(spark, sf):
    return shows.venue_travel(views.shows(spark, sf).select("venue"), travel(spark, sf))


# --- captures -----------------------------------------------------------------------------------------------------

RUN = "DATE '2024-01-20'"
NOW = "(SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY captured_at DESC) AS n FROM captures)"


def two(spark, sf):
    rows = views.captures(spark, sf)
    return captures.latest_snapshot(rows), captures.previous_snapshot(rows)


for n, name in ((1, "latest_snapshot"), (2, "previous_snapshot")):
    query(f"SELECT source, source_id, captured_at, headliner FROM {NOW} JOIN (SELECT DISTINCT source FROM captures) USING (source) WHERE n = {n}", name)(
        lambda spark, sf, n=n: captures.latest_snapshot(views.captures(spark, sf), n).select("source", "source_id", "captured_at", "headliner")
    )


@query(f"""SELECT source, source_id AS event_source_id, 'new_event' AS change_type, '{{"headliner":"' || headliner || '","date":"' || date || '"}}' AS change_detail
    FROM {NOW} c WHERE n = 1 AND NOT EXISTS (FROM {NOW} p WHERE p.n = 2 AND p.source = c.source AND p.source_id = c.source_id) AND source IN (SELECT source FROM captures)""")
def snapshot_diff_new_event(spark, sf):
    return captures.new_event(*two(spark, sf), ref()).drop("detected_at")


@query(f"""SELECT source, event_source_id, 'opener_added' AS change_type, '{{"opener":"' || o || '"}}' AS change_detail FROM (
    SELECT c.source, c.source_id AS event_source_id, unnest(list_filter(c.openers, lambda x: NOT list_contains(p.openers, x))) AS o
    FROM {NOW} c JOIN {NOW} p ON c.n = 1 AND p.n = 2 AND p.source = c.source AND p.source_id = c.source_id) JOIN (SELECT DISTINCT source FROM captures) USING (source)""")
def snapshot_diff_opener_added(spark, sf):
    return captures.opener_added(*two(spark, sf), ref()).drop("detected_at")


query(f"""SELECT c.source, c.source_id, array_to_string(list_sort(list_filter(c.openers, lambda x: NOT list_contains(p.openers, x))), '+') AS value
    FROM {NOW} c JOIN {NOW} p ON c.n = 1 AND p.n = 2 AND p.source = c.source AND p.source_id = c.source_id JOIN (SELECT DISTINCT source FROM captures) s ON s.source = c.source""", "openers_except")(
    lambda spark, sf: (lambda c, p: c.join(p.select("source", "source_id", F.col("openers").alias("then")), ["source", "source_id"]).select("source", "source_id", F.array_join(F.array_sort(captures.openers_except(F.col("openers"), F.col("then"))), "+").alias("value")))(*two(spark, sf))
)
query("SELECT source, captured_at, count(*) AS n FROM captures GROUP BY 1, 2", "source_counts")(lambda spark, sf: captures.source_counts(views.captures(spark, sf)))
RUNS = "(SELECT DISTINCT source, captured_at, lag(captured_at) OVER (PARTITION BY source ORDER BY captured_at) AS before FROM (SELECT DISTINCT source, captured_at FROM captures))"
DIFFS = f"""SELECT c.source, c.captured_at, c.source_id, 'new_event' AS change_type, '' AS opener FROM captures c JOIN {RUNS} r USING (source, captured_at)
    WHERE NOT EXISTS (FROM captures p WHERE p.source = c.source AND p.captured_at = r.before AND p.source_id = c.source_id)
    UNION ALL SELECT source, captured_at, source_id, 'opener_added', unnest(a) FROM (SELECT c.source, c.captured_at, c.source_id, list_filter(c.openers, lambda x: NOT list_contains(p.openers, x)) AS a
    FROM captures c JOIN {RUNS} r USING (source, captured_at) JOIN captures p ON p.source = c.source AND p.captured_at = r.before AND p.source_id = c.source_id)"""


@query(f"SELECT source, change_type, captured_at AS detected_at, count(*) AS n FROM ({DIFFS}) GROUP BY 1, 2, 3")
def change_counts(spark, sf):
    return captures.change_counts(streams.diff_all(views.captures(spark, sf)).withColumnRenamed("captured_at", "detected_at"))


def run_counts(spark, sf):
    """Shows per source and day; some days drop to few or to none."""
    rows = captures.source_counts(views.captures(spark, sf))
    day = F.day("captured_at")
    return rows.withColumn("n", F.when(day % 9 == 0, F.lit(0)).when(day % 7 == 0, F.floor(F.col("n") / 3)).otherwise(F.col("n")).cast("long"))


RUN_COUNTS = "SELECT source, captured_at, CASE WHEN day(captured_at) % 9 = 0 THEN 0 WHEN day(captured_at) % 7 = 0 THEN n // 3 ELSE n END AS n FROM (SELECT source, captured_at, count(*) AS n FROM captures GROUP BY 1, 2)"
HEALTH = f"""SELECT source, captured_at, max(CASE WHEN NOT flag THEN captured_at END) OVER (PARTITION BY source ORDER BY captured_at) AS last_success_at, n AS last_event_count,
    array_to_string(list(n) OVER (PARTITION BY source ORDER BY captured_at ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), ',') AS trailing_counts, flag AS anomaly_flag,
    CASE WHEN n = 0 THEN format('Source ''{{}}'' returned 0 events', source) WHEN flag THEN printf('Source ''%s'' returned %d events, trailing mean %.1f', source, n, mean) END AS anomaly_reason
    FROM (SELECT *, n = 0 OR (known >= 3 AND mean > 0 AND n < mean * 0.5) AS flag FROM (SELECT *, avg(n) OVER w AS mean, count(n) OVER w AS known FROM ({RUN_COUNTS})
    WINDOW w AS (PARTITION BY source ORDER BY captured_at ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)))"""
short_health = lambda df: df.withColumn("trailing_counts", F.array_join(F.col("trailing_counts").cast("array<string>"), ","))


@query(HEALTH)
def source_health(spark, sf):
    return short_health(captures.source_health(run_counts(spark, sf)))


def ledger(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("stage_name"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("o_orderkey").cast("int") % 60)).alias("ended_at"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("error "), F.col("o_orderkey").cast("string"))).alias("error_message"),
    )


LAST_RUN = "(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"


@query(f"SELECT o_orderpriority AS stage_name, o_orderkey AS run_id, (o_orderkey % 60 * 60)::BIGINT AS seconds FROM {LAST_RUN}")
def latest_run(spark, sf):
    return captures.latest_run(ledger(spark, sf)).select("stage_name", "run_id", "seconds")


@query(f"""SELECT o_orderpriority AS stage_name, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS started_at, (o_orderkey % 60 * 60)::BIGINT AS seconds,
    CASE o_orderstatus WHEN 'F' THEN 'error ' || o_orderkey END AS error_message FROM {LAST_RUN} ORDER BY 1""")
def pipeline_health(spark, sf):
    return jobs.pipeline_health(ledger(spark, sf))


# --- upserts ------------------------------------------------------------------------------------------------------

KEY = ["scrobbled_at", "artist_name", "track_name"]
PLAY_ROWS = "SELECT DISTINCT scrobbled_at, artist_name, track_name FROM plays"


def play_rows(spark, sf):
    return views.plays(spark, sf).select(*KEY)


def stored_plays(spark, sf):
    return play_rows(spark, sf).filter(F.day("scrobbled_at") <= 15).distinct()


@query(f"{PLAY_ROWS} WHERE day(scrobbled_at) > 15")
def new_rows(spark, sf):
    return upserts.new_rows(play_rows(spark, sf), stored_plays(spark, sf), KEY)


@query(PLAY_ROWS)
def upsert_insert_ignore(spark, sf):
    return upserts.upsert_insert_ignore(stored_plays(spark, sf), play_rows(spark, sf), KEY)


def moved(spark, sf):
    """A stored table of even and third shows, and an incoming one of even and fifth shows with other values."""
    s = views.shows(spark, sf).select("event_id", "headliner", "venue", "ticket_url")
    e = F.col("event_id")
    stored = s.filter((e % 2 == 0) | (e % 3 == 0)).withColumn("seen", F.lit(1))
    return stored, s.filter((e % 2 == 0) | (e % 5 == 0)).select(e, F.lit("changed").alias("headliner"), "venue", F.lit("new").alias("ticket_url"), F.lit(2).alias("seen"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN headliner ELSE 'changed' END AS headliner, venue,
    CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN 'new' ELSE ticket_url END AS ticket_url, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN 2 ELSE 1 END AS seen
    FROM shows WHERE event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0""")
def upsert_update(spark, sf):
    return upserts.upsert_update(*moved(spark, sf), ["event_id"], ["ticket_url", "seen"])


@query("SELECT artist_id, tag, CASE WHEN artist_id % 2 = 0 THEN weight + 1 ELSE weight END AS weight, CASE WHEN artist_id % 2 = 0 THEN DATE '2001-02-01' ELSE DATE '2001-01-01' END AS fetched_at FROM artist_tags")
def upsert_tags(spark, sf):
    at = lambda d: F.lit(d).cast("date").alias("fetched_at")
    t = views.artist_tags(spark, sf)
    stored = t.select("artist_id", "tag", "weight", at("2001-01-01"))
    return upserts.upsert_tags(stored, t.filter("artist_id % 2 = 0").select("artist_id", "tag", (F.col("weight") + 1).alias("weight"), at("2001-02-01")))


@query("SELECT event_id, artist_id, matched_name, match_type, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'review' ELSE status END AS status, 1 AS created FROM matches")
def upsert_matches(spark, sf):
    m = views.matches(spark, sf).drop("pos")
    again = m.filter("event_id % 2 = 0").withColumns({"confidence": F.lit(0.5), "status": F.lit("review"), "created": F.lit(2)})
    return upserts.upsert_matches(m.withColumn("created", F.lit(1)), again)


@query("SELECT event_id, scoring_version, CASE WHEN scoring_version = 'discovery-v1' THEN score_total + 1 ELSE score_total END AS score_total FROM scores")
def upsert_scores(spark, sf):
    s = scores(spark, sf).select("event_id", "scoring_version", "score_total")
    return upserts.upsert_scores(s, s.filter("scoring_version = 'discovery-v1'").withColumn("score_total", F.col("score_total") + 1))


@query("SELECT artist_name, track_name, CASE WHEN n % 2 = 0 THEN 'uri-2' ELSE 'uri-1' END AS chosen_uri, 'first' AS source FROM (SELECT artist_name, track_name, count(*) AS n FROM plays GROUP BY 1, 2)")
def upsert_resolutions(spark, sf):
    t = views.plays(spark, sf).groupBy("artist_name", "track_name").agg(F.count(F.lit(1)).alias("n"))
    stored = t.select("artist_name", "track_name", F.lit("uri-1").alias("chosen_uri"), F.lit("first").alias("source"))
    return upserts.upsert_resolutions(stored, t.filter("n % 2 = 0").select("artist_name", "track_name", F.lit("uri-2").alias("chosen_uri"), F.lit("second").alias("source")))


@query(f"SELECT source, CASE WHEN anomaly_flag THEN DATE '2023-01-01' ELSE last_success_at END AS last_success_at, last_event_count, anomaly_flag FROM ({HEALTH}) JOIN (SELECT DISTINCT source FROM captures) USING (source) WHERE captured_at = {RUN}")
def upsert_source_health(spark, sf):
    health = captures.source_health(run_counts(spark, sf)).filter("captured_at = date '2024-01-20'").select("source", "last_success_at", "last_event_count", "anomaly_flag")
    stored = health.select("source", F.lit("2023-01-01").cast("date").alias("last_success_at"), F.lit(0).cast("long").alias("last_event_count"), F.lit(False).alias("anomaly_flag"))
    return upserts.upsert_source_health(stored, health)


@query(f"SELECT {MADE} FROM shows WHERE event_id % 2 = 0 UNION ALL SELECT source, source_id, headliner, NULL, date, NULL, venue, NULL FROM shows WHERE event_id % 2 = 1")
def union_sources(spark, sf):
    s = views.shows(spark, sf)
    return flat(upserts.union_sources(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1").select("source", "source_id", "headliner", "date", "venue")))


def checked(spark, sf):
    rows = views.shows(spark, sf).select("event_id", "headliner", "ticket_url", "show_time")
    checks = {"no link": F.col("ticket_url").isNotNull(), "no time": F.col("show_time").isNotNull()}
    return upserts.quarantine(rows, checks, "ingest", ref(), "event_id")


query("SELECT event_id, headliner, ticket_url, show_time FROM shows WHERE ticket_url IS NOT NULL AND show_time IS NOT NULL", "quarantine")(lambda spark, sf: checked(spark, sf)[0])
query("SELECT 'ingest' AS stage_name, event_id::VARCHAR AS record_id, CASE WHEN ticket_url IS NULL THEN 'no link' ELSE 'no time' END AS error_message FROM shows WHERE ticket_url IS NULL OR show_time IS NULL", "quarantine_dead_letter")(
    lambda spark, sf: checked(spark, sf)[1].select("stage_name", "record_id", "error_message")
)


@query(f"{PLAY_ROWS} ")
def ingest_history(spark, sf):
    play = F.struct(F.struct(F.col("artist_name").alias("#text")).alias("artist"), F.col("track_name").alias("name"), F.struct(F.unix_seconds("scrobbled_at").cast("string").alias("uts")).alias("date"))
    pages = views.plays(spark, sf).groupBy("user_id").agg(F.collect_list(play).alias("track"))
    raw = pages.select(obj(recenttracks=F.struct("track")).alias("raw_json"))
    return jobs.ingest_history(raw, stored_plays(spark, sf), views.artists(spark, sf).select("raw_name"))[0]


def ingested(spark, sf):
    new = raw_shows(spark, sf).filter("source_id % 3 <> 0")
    old = raw_shows(spark, sf).filter("source_id % 2 = 0").withColumns({"ticket_provider": F.lit("old"), "first_seen": F.lit("2000-01-01").cast("timestamp"), "last_seen": F.lit("2000-01-01").cast("timestamp")})
    counts = new.limit(0).select("source", ref().alias("captured_at"), F.lit(0).cast("long").alias("n"))
    return jobs.ingest_events(new, old, old, counts, ref())


@query(f"""SELECT source, source_id, CASE WHEN event_id % 3 <> 0 THEN p ELSE 'old' END AS ticket_provider, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '{views.REF}' END AS first_seen,
    CASE WHEN event_id % 3 <> 0 THEN TIMESTAMP '{views.REF}' ELSE TIMESTAMP '2000-01-01' END AS last_seen FROM shows JOIN ({PROVIDERS}) USING (event_id) WHERE event_id % 3 <> 0 OR event_id % 2 = 0""")
def ingest_events(spark, sf):
    return ingested(spark, sf)["events"].select("source", "source_id", "ticket_provider", "first_seen", "last_seen")


@query("SELECT source, source_id AS event_source_id, 'new_event' AS change_type FROM shows WHERE event_id % 3 <> 0 AND event_id % 2 = 1")
def ingest_events_changes(spark, sf):
    return ingested(spark, sf)["changes"].select("source", "event_source_id", "change_type")


# --- digest, feed -------------------------------------------------------------------------------------------------


def world(spark, sf):
    return views.shows(spark, sf), scores(spark, sf), views.matches(spark, sf), views.artists(spark, sf)


query("SELECT event_id, artist_id, matched_name FROM matches WHERE status = 'matched'", "matched_only")(lambda spark, sf: shows.matched_only(views.matches(spark, sf)).select("event_id", "artist_id", "matched_name"))
query(f"SELECT event_id, date FROM shows WHERE date >= DATE '{AS_OF}'", "upcoming")(lambda spark, sf: shows.upcoming(views.shows(spark, sf), as_of()).select("event_id", "date"))
query("SELECT artist_id, raw_name FROM artists WHERE artist_id IN (SELECT artist_id FROM matches WHERE status = 'matched')", "tags_for_matched")(lambda spark, sf: shows.tags_for_matched(views.artists(spark, sf), views.matches(spark, sf)).select("artist_id", "raw_name"))
MATCHED = "SELECT event_id, array_to_string(list_sort(list(raw_name)), '+') AS matched_artists FROM matches JOIN artists USING (artist_id) WHERE status = 'matched' GROUP BY 1"
joined_names = lambda df: df.withColumn("matched_artists", F.array_join("matched_artists", "+"))
query(MATCHED, "collect_matched_names")(lambda spark, sf: joined_names(shows.collect_matched_names(views.matches(spark, sf), views.artists(spark, sf))))
DIGEST = f"SELECT event_id, s.source, s.source_id, headliner, venue, date, score_total, coalesce(matched_artists, '') AS matched_artists FROM shows s JOIN scores USING (event_id) LEFT JOIN ({MATCHED}) USING (event_id) WHERE scoring_version = 'exact-match-v1'"
DIGEST_COLUMNS = ["event_id", "source", "source_id", "headliner", "venue", "date", "score_total", "matched_artists"]
query(DIGEST, "digest_join")(lambda spark, sf: joined_names(shows.digest_join(*world(spark, sf))).select(*DIGEST_COLUMNS))
query(f"{DIGEST} ORDER BY score_total DESC, date, source_id", "digest_order")(lambda spark, sf: joined_names(shows.digest_order(shows.digest_join(*world(spark, sf)))).select(*DIGEST_COLUMNS))
query(f"{DIGEST} ORDER BY score_total DESC, date, source_id", "build_digest")(lambda spark, sf: joined_names(jobs.build_digest(*world(spark, sf))).select(*DIGEST_COLUMNS))
query(f"SELECT event_id, printf('%.4f', score_total) || '  ' || date || '  ' || headliner || ' @ ' || venue || ' [' || replace(matched_artists, '+', ', ') || ']' AS line FROM ({DIGEST})", "write_digest_text")(lambda spark, sf: files.digest_lines(jobs.build_digest(*world(spark, sf))))
query(f"""SELECT event_id, concat_ws(chr(10), 'BEGIN:VEVENT', 'UID:' || source || '-' || source_id, 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(date + 1, '%Y%m%d'),
    'SUMMARY:' || headliner || ' @ ' || venue, 'END:VEVENT') AS entry FROM ({DIGEST})""", "write_digest_ics")(lambda spark, sf: files.digest_calendar(jobs.build_digest(*world(spark, sf))))
query(f"SELECT event_id, headliner, score_total, len(string_split(matched_artists, '+'))::INTEGER AS performers FROM ({DIGEST})", "write_digest")(
    lambda spark, sf: files.digest_json(jobs.build_digest(*world(spark, sf))).select("event_id", F.from_json("entry", "headliner string, score_total double, matched_artists array<string>").alias("e")).select("event_id", "e.headliner", "e.score_total", F.size("e.matched_artists").alias("performers"))
)
FEED = f"""SELECT s.event_id, s.date, sc.score_total, m.artist_id FROM shows s LEFT JOIN (SELECT event_id, score_total FROM scores WHERE scoring_version = 'discovery-v1') sc USING (event_id)
    LEFT JOIN (SELECT event_id, artist_id FROM matches WHERE status = 'matched') m USING (event_id) WHERE s.date >= DATE '{AS_OF}'"""
query(FEED, "feed_join")(lambda spark, sf: shows.feed_join(*world(spark, sf), "discovery-v1", as_of()).select("event_id", "date", "score_total", "artist_id"))
query(f"SELECT event_id, date, score_total, min(artist_id) AS artist_id FROM ({FEED}) JOIN (SELECT event_id FROM shows) USING (event_id) GROUP BY 1, 2, 3", "dedup_event_rows")(
    lambda spark, sf: shows.dedup_event_rows(shows.feed_join(*world(spark, sf), "discovery-v1", as_of())).select("event_id", "date", "score_total", "artist_id")
)
query("""SELECT artist_id, array_to_string(list(tag ORDER BY n), '+') AS genres FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY weight DESC, tag) AS n FROM artist_tags) WHERE n <= 3 GROUP BY 1""", "top_genres")(
    lambda spark, sf: shows.top_genres(views.artist_tags(spark, sf)).withColumn("genres", F.array_join("genres", "+"))
)


def listed(spark, sf):
    """Display rows of all upcoming shows, with venues of several spellings."""
    joined = shows.feed_join(with_venue(spark, sf), *world(spark, sf)[1:], "discovery-v1", as_of())
    near = shows.venue_travel(with_venue(spark, sf).select("venue"), travel(spark, sf))
    return shows.feed_rows(joined, shows.top_genres(views.artist_tags(spark, sf)), near, as_of())


ROWS = f"""SELECT event_id, {pick(("Revolution Hall", "Roseland Theater", "The Get Down", "Holocene", "Wonder Ballroom", "McMenamins Edgefield"))} AS venue,
    {pick(("mid", "large", "small", "small", "mid", "large"))} AS venue_size, date, headliner, ticket_url,
    CASE WHEN st IS NOT NULL THEN least(100, round_even(st * 100, 0))::INTEGER END AS score_total, {EPOCH} AS timestamp, s.source FROM shows s
    LEFT JOIN (SELECT event_id, score_total AS st FROM scores WHERE scoring_version = 'discovery-v1') USING (event_id) WHERE date >= DATE '{AS_OF}'"""
KEPT = ["event_id", "venue", "venue_size", "date", "headliner", "score_total", "timestamp"]
query(f"SELECT {', '.join(KEPT)} FROM ({ROWS}) WHERE date <= DATE '{AS_OF}' + 30 AND score_total IS NOT NULL AND venue_size <> 'mid' AND event_id IN (SELECT event_id FROM shows)", "feed_filter")(
    lambda spark, sf: shows.feed_filter(listed(spark, sf), as_of(), "month", True, with_favourites(spark, sf)).select(*KEPT)
)


def with_favourites(spark, sf):
    return listed(spark, sf).filter("venue_size <> 'mid'").select("venue").distinct()


DAY_LABEL = f"CASE WHEN date = DATE '{AS_OF}' THEN 'TONIGHT' WHEN date = DATE '{AS_OF}' + 1 THEN 'TOMORROW' ELSE strftime(date, '%a %b ') || day(date) END"
NOW_S = f"(epoch(DATE '{AS_OF}')::BIGINT + 72000)"
query(f"SELECT event_id, timestamp < {NOW_S} - 7200 AS is_past, timestamp > {NOW_S} AND timestamp < {NOW_S} + 7200 AS is_soon, {DAY_LABEL} AS day_label FROM ({ROWS}) JOIN (SELECT event_id FROM shows) USING (event_id)", "time_flags")(
    lambda spark, sf: shows.time_flags(listed(spark, sf), F.unix_seconds(as_of().cast("timestamp")) + 72000, as_of()).select("event_id", "is_past", "is_soon", "day_label")
)
query(f"SELECT venue_size AS size, CASE venue_size WHEN 'large' THEN 'Large Venues' WHEN 'mid' THEN 'Mid-Size Venues' ELSE 'Bars & Small Rooms' END AS label, venue, count(*) AS n FROM ({ROWS}) JOIN (SELECT event_id FROM shows) USING (event_id) GROUP BY 1, 2, 3", "venue_counts")(
    lambda spark, sf: shows.venue_counts(listed(spark, sf))
)
for mode, order in (("date", "timestamp, event_id"), ("score", "score_total DESC NULLS LAST, timestamp, event_id")):
    query(f"SELECT date AS day, array_to_string(list(event_id ORDER BY {order}), ',') AS shows FROM ({ROWS}) JOIN (SELECT event_id FROM shows) USING (event_id) GROUP BY 1", "feed_by_day" if mode == "date" else "feed_by_day_score")(
        lambda spark, sf, mode=mode: shows.feed_by_day(listed(spark, sf), mode).select("day", F.array_join(F.col("shows").cast("array<string>"), ",").alias("shows"))
    )
query(f"SELECT {', '.join(KEPT)} FROM ({ROWS}) WHERE event_id IN (SELECT event_id FROM shows) ORDER BY score_total DESC NULLS LAST, date, event_id LIMIT 2000", "feed_order")(
    lambda spark, sf: shows.feed_order(listed(spark, sf)).select(*KEPT)
)
LINK = f"SELECT event_id, CASE WHEN p <> 'none' THEN ticket_url END AS url, p, {RANK} AS r FROM ({PROVIDERS})"
query(f"""SELECT venue, coalesce(arg_max(url, (r, -event_id)) FILTER (p <> 'none'), NULL) AS url, coalesce(arg_max(p, (r, -event_id)) FILTER (p <> 'none'), 'none') AS provider FROM shows JOIN ({LINK}) USING (event_id) GROUP BY 1""", "best_link")(
    lambda spark, sf: shows.best_link(views.shows(spark, sf), ["venue"], ord="event_id")
)
PLACE = "(score_total IS NOT NULL)::INTEGER, coalesce(score_total, -1), -event_id"
MERGED = f"""SELECT arg_max(event_id, ({PLACE})) AS event_id, max(venue) AS venue, max(date) AS date, max(score_total) AS score_total,
    arg_max(url, (r, {PLACE})) FILTER (p <> 'none') AS ticket_url, coalesce(arg_max(p, (r, {PLACE})) FILTER (p <> 'none'), 'none') AS ticket_provider, count(*) AS listings
    FROM ({ROWS}) JOIN ({LINK}) USING (event_id) WHERE event_id IN (SELECT event_id FROM shows)
    GROUP BY {pick(NORM_VENUE)}, date, trim(regexp_replace(lower(headliner), '[^a-z0-9]+', ' ', 'g'))"""
MERGED_LABEL = f"SELECT * EXCLUDE (p), {LABEL} AS ticket_provider_label FROM (SELECT *, ticket_provider AS p FROM ({MERGED}))"
SHOWN = ["event_id", "venue", "date", "score_total", "ticket_url", "ticket_provider", "listings", "ticket_provider_label"]


@query(f"{MERGED_LABEL} WHERE event_id IN (SELECT event_id FROM shows)")
def merge_shows(spark, sf):
    return shows.merge_shows(listed(spark, sf).withColumn("ord", F.col("event_id"))).select(*SHOWN)


@query(f"{MERGED_LABEL} WHERE event_id IN (SELECT event_id FROM shows) ORDER BY score_total DESC NULLS LAST, date, event_id LIMIT 2000")
def build_show_feed(spark, sf):
    _, s, m, a = world(spark, sf)
    return jobs.build_show_feed(with_venue(spark, sf), s, m, a, views.artist_tags(spark, sf), travel(spark, sf), as_of()).select(*SHOWN)


@query(f"SELECT event_id, venue, score_total FROM ({MERGED_LABEL}) WHERE event_id IN (SELECT event_id FROM shows)")
def write_feed_json(spark, sf):
    feed = merge_shows(spark, sf)
    path = streams.shared_dir(spark, "feed")
    files.write_feed_json(feed, path)
    return spark.read.schema("event_id bigint, venue string, score_total int").json(path)


@query("""SELECT event_id, scoring_version, unnest(['taste', 'adjacency', 'discovery', 'recency', 'distance', 'TOTAL']) AS term,
    unnest([taste_score, adjacency_score, discovery_score, recency_score, distance_score, score_total]) AS value, coalesce(w, '') AS matched FROM scores
    LEFT JOIN (SELECT event_id, string_agg(raw_name || ' [exact, 1.000]', '; ' ORDER BY raw_name) AS w FROM matches JOIN artists USING (artist_id) WHERE status = 'matched' GROUP BY 1) USING (event_id)""")
def explain_show(spark, sf):
    return jobs.explain_show(*world(spark, sf))


# --- playlist -----------------------------------------------------------------------------------------------------

CANDIDATES = "SELECT artist_id, max(score_total) AS score, any_value(raw_name) AS raw_name FROM matches JOIN (SELECT event_id, scoring_version, score_total FROM scores) USING (event_id) JOIN artists USING (artist_id) WHERE status = 'matched' AND scoring_version = 'discovery-v1' GROUP BY 1"
COUNTS = "SELECT a.artist_id, count(p.user_id) AS plays FROM artists a LEFT JOIN plays p USING (artist_id) GROUP BY 1"
CHOSEN = f"SELECT *, plays <= 25 AS under_explored, row_number() OVER (ORDER BY score DESC, plays, raw_name, artist_id)::INTEGER AS rank FROM ({CANDIDATES}) JOIN ({COUNTS}) USING (artist_id) WHERE artist_id IN (SELECT artist_id FROM matches) AND artist_id IN (SELECT artist_id FROM plays) QUALIFY rank <= 30"


def candidates(spark, sf):
    return shows.candidate_artists(views.matches(spark, sf), scores(spark, sf), views.artists(spark, sf))


def with_plays(spark, sf):
    counts = history.play_counts(views.plays(spark, sf), views.artists(spark, sf))
    return candidates(spark, sf).join(counts.select("artist_id", F.col("n").alias("plays")), "artist_id")


query(f"SELECT artist_id, score, raw_name FROM ({CANDIDATES}) WHERE artist_id IN (SELECT artist_id FROM matches)", "candidate_artists")(lambda spark, sf: candidates(spark, sf))
query(CHOSEN, "select_artists")(lambda spark, sf: shows.select_artists(with_plays(spark, sf)))
query(f"SELECT artist_name, track_name, rank, rank AS nth FROM ({TOP_TRACKS}) WHERE rank <= 2 AND artist_name IN (SELECT artist_name FROM plays)", "tracks_per_artist")(lambda spark, sf: shows.tracks_per_artist(top_tracks(spark, sf), 2))
query("""SELECT event_id, 'uri' || pos AS uri, score AS match_score, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, 'uri' || pos) AS n
    FROM (SELECT *, round((artist_id % 7) / 7.0::DOUBLE, 6) AS score FROM matches)) WHERE n <= 2""", "rank_candidates")(
    lambda spark, sf: shows.rank_candidates(views.matches(spark, sf).select("event_id", F.concat(F.lit("uri"), F.col("pos").cast("string")).alias("uri"), F.round((F.col("artist_id") % 7) / 7.0, 6).alias("match_score")), ["event_id"], 2)
)


def catalog(spark, sf):
    """A catalogue: every track of every performer, spelled in capitals."""
    return top_tracks(spark, sf).select(F.concat(F.lit("uri:"), F.md5(F.concat("artist_name", "track_name"))).alias("uri"), F.upper("track_name").alias("name"), F.upper("artist_name").alias("artists"))


def plan(spark, sf):
    _, s, m, a = world(spark, sf)
    return jobs.build_playlist(s, m, a, views.plays(spark, sf), top_tracks(spark, sf), catalog(spark, sf))


PLAN = f"SELECT rank, artist_id, raw_name, track_name, score, plays, under_explored, 'uri:' || md5(raw_name || track_name) AS uri FROM ({CHOSEN}) c JOIN (SELECT artist_name AS raw_name, track_name FROM ({TOP_TRACKS}) WHERE rank = 1) USING (raw_name) WHERE raw_name IN (SELECT artist_name FROM plays)"
query(PLAN, "build_playlist")(plan)
query(f"SELECT count(*) AS track_count, count(uri) AS resolved_count, coalesce(avg(under_explored::INTEGER), 0)::DOUBLE AS under_explored_pct FROM ({PLAN}) WHERE raw_name IN (SELECT artist_name FROM plays)", "plan_summary")(lambda spark, sf: shows.plan_summary(plan(spark, sf)))
query(f"SELECT coalesce(avg(under_explored::INTEGER), 0)::DOUBLE AS share, coalesce(avg(under_explored::INTEGER), 0) >= 0.5 AS enough FROM ({PLAN}) WHERE raw_name IN (SELECT artist_name FROM plays)", "under_explored_pct")(lambda spark, sf: shows.under_explored_pct(plan(spark, sf)))
query(f"""SELECT '{{"name":"Discovery","public":false,"uris":[' || string_agg('"' || uri || '"', ',' ORDER BY rank) || ']}}' AS playlist FROM ({PLAN}) WHERE raw_name IN (SELECT artist_name FROM plays)""", "export_playlist")(
    lambda spark, sf: files.playlist_json(plan(spark, sf), "Discovery", False)
)
query(None, "track_match_score")(lambda spark, sf: _track_scores(spark, sf))


def _track_scores(spark, sf):
    from gigmatch.functions.names import track_match_score

    pairs = top_tracks(spark, sf).filter("rank = 1").join(catalog(spark, sf), F.upper("artist_name") == F.col("artists"))
    return pairs.select("artist_name", "track_name", "uri", track_match_score(F.col("artist_name"), F.col("track_name"), F.col("artists"), F.col("name")).alias("match_score"))


@query(f"SELECT artist_name, track_name, 'uri:' || md5(artist_name || track_name) AS chosen_uri FROM ({TOP_TRACKS}) WHERE rank = 1 AND artist_name IN (SELECT artist_name FROM plays)")
def resolve_tracks(spark, sf):
    wanted = top_tracks(spark, sf).filter("rank = 1").select("artist_name", "track_name")
    return jobs.resolve_tracks(wanted, catalog(spark, sf)).select("artist_name", "track_name", "chosen_uri")


# --- streams, drained ---------------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({HEALTH}) WHERE source IN (SELECT source FROM captures)")
def stream_source_health(spark, sf):
    rows = run_counts(spark, sf)
    path, out = streams.shared_dir(spark, "counts-in"), streams.shared_dir(spark, "counts-out")
    state, first = streams.shared_dir(spark, "state"), F.lit("2024-01-16").cast("date")
    stream = lambda: spark.readStream.schema("source string, captured_at date, n bigint").parquet(path)
    for part in (rows.filter(F.col("captured_at") < first), rows.filter(F.col("captured_at") >= first)):
        part.write.mode("append").parquet(path)
        streams.stream_source_health(stream(), out, state)
    return short_health(spark.read.parquet(f"{out}/health").drop("batch"))

