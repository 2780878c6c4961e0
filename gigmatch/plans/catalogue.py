"""Registered queries of the library and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.functions import links, names, scoring, times, venues
from gigmatch.operators import captures, history, resolution, shows, upserts
from gigmatch.plans import jobs, views
from gigmatch.plans.views import AS_OF, HALF_LIFE, REF, as_of, events_ref, ref, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = views.sql(sql)
        return f

    return add


def column(name: str, sql: str, view: Callable, expr: Callable, key: str = "event_id") -> None:
    """Register a column expression over a view: (key, value)."""
    query(sql, name)(lambda spark, sf: view(spark, sf).select(key, expr().alias("value")))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return history.plays_with_artist(views.plays(spark, sf), views.artists(spark, sf), ["user_id"])


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return history.tag_rows(views.artists(spark, sf), views.artist_tags(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return shows.best_score_per_event(artist_scores(spark, sf))


def artist_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = views.signals(spark, sf)
    both = [scoring.score_terms(s, v).drop(*scoring.TERMS) for v in scoring.CONFIGS]
    return both[0].unionByName(both[1])


DAYS = f"(epoch_us(TIMESTAMP '{REF}') - epoch_us(scrobbled_at)) / 86400000000.0::DOUBLE"
DECAY = f"pow(2.0::DOUBLE, -({DAYS}) / {HALF_LIFE}::DOUBLE)"
AFFINITY = f"SELECT user_id, key, arg_max(raw_name, (scrobbled_at, raw_name)) AS raw_name, round(sum({DECAY}), 6) AS weight, count(*) AS play_count FROM keyed_plays GROUP BY 1, 2"
ONE_AFFINITY = f"SELECT key, round(sum({DECAY}), 6) AS weight, count(*) AS play_count FROM keyed_plays GROUP BY 1"
TAG_ROWS = "SELECT coalesce(mbid, raw_name) AS key, tag, arg_max(weight, artist_id) AS weight FROM artists JOIN artist_tags USING (artist_id) GROUP BY 1, 2"
TASTE = f"SELECT tag, sum(a.weight * t.weight) AS weight FROM ({TAG_ROWS}) t JOIN ({ONE_AFFINITY}) a USING (key) WHERE a.weight > 0 GROUP BY tag"


# --- history, affinity, taste -------------------------------------------------------------------------------------


@query("SELECT user_id, coalesce(a.mbid, p.artist_name) AS key, coalesce(a.raw_name, p.artist_name) AS raw_name, scrobbled_at FROM plays p LEFT JOIN artists a USING (artist_id)")
def plays_with_artist(spark, sf):
    return keyed(spark, sf)


@query(f"SELECT * FROM plays WHERE scrobbled_at >= greatest(TIMESTAMP '2000-01-01', TIMESTAMP '1999-06-01')")
def since_filter(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp")
    return history.since_filter(views.plays(spark, sf), at("2000-01-01"), at("1999-06-01"))


@query(AFFINITY)
def decayed_affinity(spark, sf):
    return history.decayed_affinity(keyed(spark, sf), ref(), HALF_LIFE, ["user_id"])


@query(
    """SELECT user_id, event_type AS key, round(sum(pow(2.0::DOUBLE, -((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 56.0::DOUBLE)), 6) AS weight,
    count(*) AS play_count FROM events GROUP BY 1, 2"""
)
def decayed_affinity_events(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_type").alias("raw_name"), F.col("ts").alias("scrobbled_at"))
    return history.decayed_affinity(events, events_ref(), by=["user_id"]).drop("raw_name")


@query(f"SELECT user_id, key, raw_name, weight, play_count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, key) AS rank FROM ({AFFINITY})) WHERE rank <= 50")
def top_affinity(spark, sf):
    return history.top_affinity(decayed_affinity(spark, sf), 50, ["user_id"])


@query(f"SELECT user_id, key, min({DAYS}) AS days FROM keyed_plays GROUP BY 1, 2")
def last_play_days(spark, sf):
    return history.last_play_days(keyed(spark, sf), ref(), ["user_id"])


@query("SELECT a.artist_id, count(p.user_id) AS n FROM artists a LEFT JOIN plays p USING (artist_id) GROUP BY 1")
def play_counts(spark, sf):
    return history.play_counts(views.plays(spark, sf), views.artists(spark, sf))


@query(TAG_ROWS)
def tag_rows(spark, sf):
    return tagged(spark, sf)


@query(f"SELECT tag, round(weight, 6) AS weight FROM ({TASTE})")
def taste_vector(spark, sf):
    plays = keyed(spark, sf).drop("user_id")
    return history.taste_vector(tagged(spark, sf), history.decayed_affinity(plays, ref(), HALF_LIFE)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT key, round(sqrt(sum(weight * weight)), 9) AS norm FROM ({TAG_ROWS}) GROUP BY 1")
def vector_norms(spark, sf):
    return history.vector_norms(tagged(spark, sf), ["key"]).withColumn("norm", F.round("norm", 9))


COSINE = f"""SELECT x.key AS a, y.key AS b, sum(x.weight * y.weight) / (any_value(nx.norm) * any_value(ny.norm)) AS similarity
    FROM t x JOIN t y USING (tag) JOIN n nx ON nx.key = x.key JOIN n ny ON ny.key = y.key GROUP BY 1, 2"""


ALL_COSINE = f"(WITH t AS ({TAG_ROWS}), n AS (SELECT key, sqrt(sum(weight * weight)) AS norm FROM t GROUP BY 1) {COSINE})"


@query(f"SELECT x.key AS a, y.key AS b, tag, x.weight AS wa, y.weight AS wb FROM ({TAG_ROWS}) x JOIN ({TAG_ROWS}) y USING (tag)")
def tag_overlap(spark, sf):
    tags = tagged(spark, sf)
    return history.tag_overlap(tags, tags)


@query(f"SELECT a, b, round(similarity, 6) AS similarity FROM {ALL_COSINE}")
def cosine(spark, sf):
    tags = tagged(spark, sf)
    return history.cosine(tags, tags).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""SELECT key, neighbor, similarity, rank::INTEGER AS rank FROM (SELECT a AS key, b AS neighbor, round(similarity, 6) AS similarity,
    row_number() OVER (PARTITION BY a ORDER BY round(similarity, 6) DESC, b) AS rank FROM {ALL_COSINE} WHERE a <> b AND round(similarity, 6) > 0) WHERE rank <= 10"""
)
def nearest_neighbors(spark, sf):
    return history.nearest_neighbors(tagged(spark, sf))


@query(
    f"""SELECT user_id, tag, round(sum(a.weight * t.weight), 6) AS weight FROM ({TAG_ROWS}) t JOIN ({AFFINITY}) a USING (key) WHERE a.weight > 0 GROUP BY 1, 2"""
)
def taste_vector_by_user(spark, sf):
    taste = history.taste_by_listener(keyed(spark, sf), tagged(spark, sf), ref(), HALF_LIFE, ["user_id"])
    return taste.withColumn("weight", F.round("weight", 6))


# --- names and resolution -----------------------------------------------------------------------------------------

DIRTY = "CASE event_id % 4 WHEN 0 THEN 'The ' || headliner || '!' WHEN 1 THEN upper(headliner) WHEN 2 THEN replace(headliner, '#', ' & ') ELSE headliner || ' (live)' END"
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def dirty(spark, sf):
    e, h = F.col("event_id") % 4, F.col("headliner")
    name = (
        F.when(e == 0, F.concat(F.lit("The "), h, F.lit("!"))).when(e == 1, F.upper(h)).when(e == 2, F.replace(h, F.lit("#"), F.lit(" & "))).otherwise(F.concat(h, F.lit(" (live)")))
    )
    return views.shows(spark, sf).select("event_id", "headliner", name.alias("name"))


TOKENS = f"list_filter(string_split({NORM.format('{0}')}, ' '), lambda t: t <> '' AND t NOT IN ('the', 'a', 'an'))"
WORDS = f"list_distinct(list_filter(string_split({NORM.format('{0}')}, ' '), lambda t: t <> ''))"
column("normalize_name", f"SELECT event_id, {NORM.format('name')} AS value FROM (SELECT event_id, {DIRTY} AS name FROM shows)", dirty, lambda: names.normalize_name(F.col("name")))
column("distinctive_tokens", f"SELECT event_id, array_to_string({TOKENS.format('name')}, '|') AS value FROM (SELECT event_id, {DIRTY} AS name FROM shows)", dirty, lambda: F.array_join(names.distinctive_tokens(F.col("name")), "|"))
column(
    "match_threshold",
    f"""SELECT event_id, CASE WHEN len(x) > 0 AND len(y) > 0 AND len(x) <> len(y) AND (list_has_all(y, x) OR list_has_all(x, y)) THEN 0.92
    WHEN len(dx) = 1 AND len(dy) = 1 THEN 0.90 ELSE 0.75 END::DOUBLE AS value FROM (SELECT event_id, {WORDS.format('name')} AS x, {WORDS.format('headliner')} AS y,
    {TOKENS.format('name')} AS dx, {TOKENS.format('headliner')} AS dy FROM (SELECT event_id, headliner, {DIRTY} AS name FROM shows))""",
    dirty, lambda: names.match_threshold(F.col("name"), F.col("headliner")),
)
column(
    "match_status",
    "SELECT event_id, CASE WHEN c >= 0.55 THEN CASE WHEN round(c, 6) >= 0.75 THEN 'matched' ELSE 'review' END END AS value FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS c FROM shows)",
    views.shows, lambda: names.match_status((F.col("event_id") % 101) / 100.0, F.lit(0.75)),
)
column("artist_key", "SELECT artist_id, coalesce(nullif(mbid, ''), raw_name) AS value FROM artists", views.artists, lambda: names.artist_key(F.col("mbid"), F.col("raw_name")), "artist_id")
column("similarity", None, dirty, lambda: names.similarity(F.col("name"), F.col("headliner")))


@query("SELECT event_id, pos, name FROM names")
def event_artist_names(spark, sf):
    return resolution.event_artist_names(views.shows(spark, sf))


@query("SELECT name, artist_id, raw_name, 'mbid' AS match_type, 1.0::DOUBLE AS confidence, 'matched' AS status FROM (SELECT name, 'mb-' || md5(name) AS m FROM names) JOIN artists ON m = mbid")
def resolve_mbid(spark, sf):
    asked = event_artist_names(spark, sf).select("name", F.concat(F.lit("mb-"), F.md5("name")).alias("event_mbid"))
    return resolution.resolve_mbid(asked, views.artists(spark, sf))


@query(
    f"""SELECT d.name, k.artist_id, k.raw_name, 'exact' AS match_type, 1.0::DOUBLE AS confidence, 'matched' AS status
    FROM (SELECT DISTINCT name, {NORM.format('name')} AS norm FROM (SELECT {DIRTY} AS name FROM shows)) d
    JOIN (SELECT {NORM.format('raw_name')} AS norm, min(artist_id) AS artist_id, arg_min(raw_name, artist_id) AS raw_name FROM artists GROUP BY 1) k ON d.norm = k.norm AND d.norm <> ''"""
)
def resolve_exact(spark, sf):
    return resolution.resolve_exact(dirty(spark, sf), views.artists(spark, sf))


@query()
def resolve_fuzzy(spark, sf):
    return resolution.resolve_fuzzy(dirty(spark, sf), views.artists(spark, sf))


@query("SELECT event_id, artist_id, arg_max(matched_name, pos) AS matched_name, max(pos) AS pos FROM (SELECT event_id, artist_id % 5 AS artist_id, matched_name, pos FROM matches) GROUP BY 1, 2")
def last_write_wins(spark, sf):
    rows = views.matches(spark, sf).select("event_id", (F.col("artist_id") % 5).alias("artist_id"), "matched_name", "pos")
    return resolution.last_write_wins(rows, ["event_id", "artist_id"], ["pos"])


@query("SELECT event_id, artist_id, matched_name, match_type, confidence, 'matched' AS status FROM matches")
def resolve_events(spark, sf):
    return jobs.resolve_events(views.shows(spark, sf), views.artists(spark, sf), fuzzy=False)[0]


def spelled(spark, sf):
    """Shows whose headliners are spelled as in ``dirty``."""
    return views.shows(spark, sf).drop("headliner").join(dirty(spark, sf).select("event_id", F.col("name").alias("headliner")), "event_id")


@query()
def resolve_events_fuzzy(spark, sf):
    """All three steps on names with variants; every seventh performer's name comes with an identifier."""
    known = views.artists(spark, sf).filter("mbid IS NOT NULL AND artist_id % 7 = 0").select(F.upper("raw_name").alias("name"), F.col("mbid").alias("event_mbid"))
    return jobs.resolve_events(spelled(spark, sf), views.artists(spark, sf), mbids=known)[0]


def search_results(spark, sf):
    """Three results per performer: another name, the name in capitals, the name with a blank identifier."""
    known = views.artists(spark, sf).select("raw_name", "artist_id")
    result = lambda r, n, m: F.struct(F.lit(r).alias("rank"), n.alias("name"), m.alias("mbid"))
    late = F.when(F.col("artist_id") % 2 == 0, F.concat(F.lit(" found-"), F.col("artist_id").cast("string"))).otherwise(" ")
    results = F.array(result(1, F.reverse("raw_name"), F.lit("x")), result(2, F.upper("raw_name"), late), result(3, F.col("raw_name"), F.lit("later")))
    return known.select(F.col("raw_name").alias("query"), F.inline(results))


@query("""SELECT artist_id, raw_name, CASE WHEN NOT resolved AND artist_id % 2 = 0 THEN 'found-' || artist_id ELSE mbid END AS mbid,
    resolved OR artist_id % 2 = 0 AS resolved FROM artists""")
def resolve_artist_ids(spark, sf):
    stored = views.artists(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return resolution.resolve_artist_ids(stored, search_results(spark, sf), ref())[0].drop("updated_at")


@query(f"""SELECT raw_name, 'no_match' AS failure_reason, CASE WHEN artist_id % 9 = 0 THEN 3 ELSE 1 END::BIGINT AS attempt_count,
    CASE WHEN artist_id % 9 = 0 THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '{REF}' END AS first_failed_at,
    TIMESTAMP '{REF}' AS last_attempted_at FROM artists WHERE NOT resolved AND artist_id % 2 <> 0""")
def unresolved_queue(spark, sf):
    known = views.artists(spark, sf)
    stored_artists = known.withColumn("updated_at", F.lit(None).cast("timestamp"))
    failed = resolution.resolve_artist_ids(stored_artists, search_results(spark, sf), ref())[1]
    before = F.lit("2001-01-01").cast("timestamp")
    stored = known.filter(~F.col("resolved") & (F.col("artist_id") % 9 == 0) & (F.col("artist_id") % 2 != 0)).select(
        "raw_name", F.lit("no_match").alias("failure_reason"), F.lit(2).cast("long").alias("attempt_count"), before.alias("first_failed_at"), before.alias("last_attempted_at")
    )
    return upserts.unresolved_queue(stored, failed, ref())


# --- scoring ------------------------------------------------------------------------------------------------------

column("decay_weight", f"SELECT event_id, round(pow(2.0::DOUBLE, -(date_diff('day', date, DATE '2001-11-30')::DOUBLE) / 365.0::DOUBLE), 9) AS value FROM shows", views.shows, lambda: F.round(scoring.decay_weight(F.col("date").cast("timestamp"), ref(), HALF_LIFE), 9))
column("recency_signal", "SELECT event_id, round(pow(2.0::DOUBLE, -greatest(event_id % 200 - 20, 0)::DOUBLE / 56.0::DOUBLE), 9) AS value FROM shows", views.shows, lambda: F.round(scoring.recency_signal((F.col("event_id") % 200 - 20).cast("double")), 9))
column("discovery_signal", "SELECT event_id, adjacency / (1.0::DOUBLE + event_id % 7) AS value FROM signals", views.signals, lambda: scoring.discovery_signal(F.col("adjacency"), F.col("event_id") % 7))
column("saturate", "SELECT event_id, CASE WHEN taste > 0 THEN taste / (taste + 5.0::DOUBLE) ELSE 0 END::DOUBLE AS value FROM signals", views.signals, lambda: scoring.saturate(F.col("taste"), 5.0))
column("score_to_100", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN least(100, round_even((event_id % 331) / 250.0::DOUBLE * 100, 0))::INTEGER END AS value FROM shows", views.shows, lambda: scoring.score_to_100(F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 331) / 250.0)))
column("score_class", "SELECT event_id, CASE WHEN s IS NULL THEN 'none' WHEN s >= 70 THEN 'hi' WHEN s >= 40 THEN 'md' ELSE 'lo' END AS value FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 101 END AS s FROM shows)", views.shows, lambda: scoring.score_class(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 101)))
column("under_explored", "SELECT artist_id, n <= 25 AS value FROM (SELECT a.artist_id, count(p.user_id) AS n FROM artists a LEFT JOIN plays p USING (artist_id) GROUP BY 1)", play_counts, lambda: scoring.under_explored(F.col("n")), "artist_id")


@query("SELECT event_id, artist_id, scoring_version, taste_score, adjacency_score, discovery_score, recency_score, distance_score, score_total FROM artist_scores")
def score_terms(spark, sf):
    return artist_scores(spark, sf)


PIVOT = ", ".join(f"max({c}) FILTER (scoring_version = '{v}') AS {c.removesuffix('_score')}_{k}" for k, v in (("a", "exact-match-v1"), ("b", "discovery-v1")) for c in ("taste_score", "adjacency_score", "discovery_score", "recency_score", "score_total"))
DELTAS = ", ".join(f"round({t}_b - {t}_a, 6) AS {t}_delta" for t in ("taste", "adjacency", "discovery", "recency"))


@query(f"""SELECT event_id, artist_id, 'exact-match-v1' AS version_a, 'discovery-v1' AS version_b, score_total_a AS total_a, score_total_b AS total_b, {DELTAS},
    0.0::DOUBLE AS distance_delta, round(score_total_b - score_total_a, 6) AS total_delta FROM (SELECT event_id, artist_id, {PIVOT} FROM artist_scores GROUP BY 1, 2)""")
def ab_diff(spark, sf):
    return scoring.ab_diff(views.signals(spark, sf), "exact-match-v1", "discovery-v1")


@query("SELECT event_id, scoring_version, artist_id, taste_score, adjacency_score, discovery_score, recency_score, distance_score, score_total FROM scores")
def best_score_per_event(spark, sf):
    return scores(spark, sf)


SIGNALS = f"""SELECT k.key, coalesce(a.weight, 0)::DOUBLE AS taste, coalesce(c.similarity, 0)::DOUBLE AS adjacency,
    coalesce(c.similarity, 0)::DOUBLE / (1.0 + coalesce(a.play_count, 0)) AS discovery,
    CASE WHEN d.days IS NULL THEN 1.0 ELSE pow(2.0::DOUBLE, -greatest(d.days, 0) / {HALF_LIFE}::DOUBLE) END AS recency
    FROM (SELECT DISTINCT coalesce(mbid, raw_name) AS key FROM matches JOIN artists USING (artist_id) WHERE status = 'matched') k
    LEFT JOIN (SELECT * FROM ({ONE_AFFINITY}) ORDER BY weight DESC, key LIMIT 10000) a USING (key)
    LEFT JOIN (SELECT key, min({DAYS}) AS days FROM keyed_plays GROUP BY 1) d USING (key)
    LEFT JOIN (SELECT t.key, sum(t.weight * v.weight) / (any_value(n.norm) * any_value(m.norm)) AS similarity
        FROM ({TAG_ROWS}) t JOIN ({TASTE}) v USING (tag)
        JOIN (SELECT key, sqrt(sum(weight * weight)) AS norm FROM ({TAG_ROWS}) GROUP BY 1) n ON n.key = t.key,
        (SELECT sqrt(sum(weight * weight)) AS norm FROM ({TASTE})) m GROUP BY 1) c USING (key)"""


@query(
    f"""SELECT event_id, scoring_version, taste_score, adjacency_score,
    discovery_score, recency_score, score_total FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score_total DESC, artist_id) AS n FROM (
    SELECT *, round(taste_score + adjacency_score + discovery_score + recency_score, 6) AS score_total FROM (
    SELECT event_id, artist_id, 'discovery-v1' AS scoring_version, round(0.5 * (taste / (taste + 5.0)), 6) AS taste_score,
    round(0.5 * adjacency, 6) AS adjacency_score, round(2.0 * discovery, 6) AS discovery_score, round(0.3::DOUBLE * recency, 6) AS recency_score
    FROM matches JOIN artists USING (artist_id) JOIN ({SIGNALS}) s ON s.key = coalesce(mbid, raw_name) WHERE status = 'matched'))) WHERE n = 1"""
)
def score_shows(spark, sf):
    plays = views.plays(spark, sf).drop("user_id")
    got = jobs.score_shows(plays, views.artists(spark, sf), views.artist_tags(spark, sf), views.matches(spark, sf), "discovery-v1", ref(), HALF_LIFE)
    return got.select("event_id", "scoring_version", "taste_score", "adjacency_score", "discovery_score", "recency_score", "score_total")


# --- links, venues, times -----------------------------------------------------------------------------------------

HOST = "lower(regexp_extract(coalesce(ticket_url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1))"
PROVIDER = "CASE h WHEN '' THEN 'none' WHEN 'www.etix.com' THEN 'etix' WHEN 'www.ticketmaster.com' THEN 'ticketmaster' WHEN 'dice.fm' THEN 'dice' WHEN 'concerts.livenation.com' THEN 'livenation' WHEN 'www.songkick.com' THEN 'songkick' WHEN 'tickets.axs.com' THEN 'axs' WHEN 'www.bandsintown.com' THEN 'bandsintown' ELSE 'venue' END"
RANK = "CASE p WHEN 'none' THEN 0 WHEN 'venue' THEN 60 WHEN 'ticketmaster' THEN 20 WHEN 'livenation' THEN 20 WHEN 'songkick' THEN 10 WHEN 'bandsintown' THEN 10 ELSE 100 END"
LABEL = "CASE p WHEN 'etix' THEN 'Etix' WHEN 'ticketmaster' THEN 'Ticketmaster' WHEN 'dice' THEN 'Dice' WHEN 'livenation' THEN 'Live Nation' WHEN 'songkick' THEN 'Songkick' WHEN 'axs' THEN 'AXS' WHEN 'bandsintown' THEN 'Bandsintown' WHEN 'venue' THEN 'Venue' ELSE 'Tickets' END"
PROVIDERS = f"SELECT event_id, ticket_url, {PROVIDER} AS p FROM (SELECT event_id, ticket_url, {HOST} AS h FROM shows)"
url = lambda: F.col("ticket_url")
column("url_host", f"SELECT event_id, {HOST} AS value FROM shows", views.shows, lambda: links.url_host(url()))
column("classify_provider", f"SELECT event_id, p AS value FROM ({PROVIDERS}) JOIN shows USING (event_id)", views.shows, lambda: links.classify_provider(url()))
column("provider_rank", f"SELECT event_id, {RANK} AS value FROM ({PROVIDERS}) JOIN shows USING (event_id)", views.shows, lambda: links.provider_rank(links.classify_provider(url())))
column("provider_label", f"SELECT event_id, {LABEL} AS value FROM ({PROVIDERS}) JOIN shows USING (event_id)", views.shows, lambda: links.provider_label(links.classify_provider(url())))
column("ticket_id_from_url", "SELECT event_id, CASE WHEN ticket_url IS NOT NULL THEN event_id::VARCHAR END AS value FROM shows", views.shows, lambda: links.ticket_id_from_url(url()))
column("url_from_js_open", "SELECT event_id, ticket_url AS value FROM shows", views.shows, lambda: links.url_from_js_open(F.concat(F.lit("javascript:window.open('"), url(), F.lit("', '_blank')"))))

VENUE_NAMES = ("Revolution Hall - Portland", "Roseland Theater", "The Get Down Music Venue", "Holocene", "Wonder Ballroom", "McMenamins Historic Edgefield Manor")
CANON = ("Revolution Hall", "Roseland Theater", "The Get Down", "Holocene", "Wonder Ballroom", "McMenamins Edgefield")
NORM_VENUE = ("revolution hall", "roseland", "the get down", "holocene", "wonder ballroom", "mcmenamins edgefield")
VENUE_TIER = ("mid", "large", "small", "small", "mid", "large")


def pick(values: tuple) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], (event_id % {len(values)})::INTEGER + 1)"


def with_venue(spark, sf):
    name = F.get(F.array(*[F.lit(v) for v in VENUE_NAMES]), (F.col("event_id") % len(VENUE_NAMES)).cast("int"))
    return views.shows(spark, sf).withColumn("venue", name)


canon = lambda: venues.canonicalize_venue(F.col("venue"))
column("canonicalize_venue", f"SELECT event_id, {pick(CANON)} AS value FROM shows", with_venue, canon)
column("normalize_venue", f"SELECT event_id, {pick(NORM_VENUE)} AS value FROM shows", with_venue, lambda: venues.normalize_venue(canon()))
column("venue_size", f"SELECT event_id, {pick(VENUE_TIER)} AS value FROM shows", with_venue, lambda: venues.venue_size(canon()))
column("show_key", f"SELECT event_id, {pick(NORM_VENUE)} || '|' || date || '|' || {NORM.format('headliner')} AS value FROM shows", with_venue, lambda: F.concat_ws("|", *[venues.show_key(F.col("venue"), F.col("date"), F.col("headliner"))[k].cast("string") for k in ("venue_key", "show_date", "headliner_key")]))
column("travel_minutes", "SELECT event_id, round_even(event_id % 5000 / 60.0::DOUBLE, 0)::INTEGER AS value FROM shows", views.shows, lambda: venues.travel_minutes(F.col("event_id") % 5000))
column("travel_miles", "SELECT event_id, round((event_id % 50000) / 1609.34::DOUBLE, 1) AS value FROM shows", views.shows, lambda: venues.travel_miles(F.col("event_id") % 50000))
column("distance_band", "SELECT event_id, CASE WHEN event_id % 60 <= 10 THEN 'close' WHEN event_id % 60 <= 30 THEN 'near' ELSE 'far' END AS value FROM shows", views.shows, lambda: venues.distance_band(F.col("event_id") % 60))
INFER = f"""CASE WHEN date_diff('day', this, DATE '{AS_OF}') <= 90 THEN this ELSE this + INTERVAL 1 YEAR END::DATE AS value FROM (
    SELECT event_id, make_date(2001, month(date), least(day(date), 28)) AS this FROM shows)"""
month, day = (lambda: F.month("date")), (lambda: F.least(F.day("date"), F.lit(28)))
column("infer_year_date", f"SELECT event_id, {INFER}", views.shows, lambda: times.infer_year_date(month(), day(), as_of()))
column("month_to_num", "SELECT event_id, month(date)::INTEGER AS value FROM shows", views.shows, lambda: times.month_to_num(F.date_format("date", "MMMM")))
column("parse_month_day", f"SELECT event_id, {INFER}", views.shows, lambda: times.parse_month_day(F.concat(F.lit("Tue, "), F.date_format("date", "MMM"), F.lit(" "), day().cast("string")), as_of()))
column("parse_numeric_md", f"SELECT event_id, {INFER}", views.shows, lambda: times.parse_numeric_md(F.concat(F.lit("Sun "), month().cast("string"), F.lit(" / "), day().cast("string")), as_of()))
column("parse_full_date", "SELECT event_id, date AS value FROM shows", views.shows, lambda: times.parse_full_date(F.concat(F.date_format("date", "EEEE, MMMM d"), F.when(F.day("date").isin(1, 21, 31), "st, ").when(F.day("date").isin(2, 22), "nd, ").otherwise("th, "), F.year("date").cast("string")), as_of()))
H24 = "lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0')"
hour12 = lambda h: F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12).cast("int")
hh, mm = (lambda: F.col("event_id") % 24), (lambda: F.col("event_id") % 60)
half = lambda: F.when(hh() < 12, "am").otherwise("PM")
column("to_24h", f"SELECT event_id, {H24} AS value FROM shows", views.shows, lambda: times.to_24h(hour12(hh()), mm().cast("int"), half()))
column("format_time_12h", "SELECT event_id, CASE WHEN show_time IS NOT NULL THEN ((event_id % 13 + 9) % 12 + 1) || ':15 ' || CASE WHEN event_id % 13 + 10 < 12 THEN 'AM' ELSE 'PM' END END AS value FROM shows", views.shows, lambda: times.format_time_12h(F.col("show_time")))
clock12 = lambda: F.concat(hour12(hh()).cast("string"), F.lit(":"), F.lpad(mm().cast("string"), 2, "0"), F.lit(" "), half())
column(
    "doors_show_times",
    f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN '19:00/' || {H24} WHEN 1 THEN '-/' || {H24} ELSE {H24} || '/-' END AS value FROM shows",
    views.shows,
    lambda: (lambda t: F.concat(F.coalesce(t["doors"], F.lit("-")), F.lit("/"), F.coalesce(t["show"], F.lit("-"))))(
        times.doors_show_times(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Doors: 7PM, Show at "), clock12())).when(F.col("event_id") % 3 == 1, F.concat(F.lit("from "), clock12())).otherwise(F.concat(F.lit("doors open "), clock12())))
    ),
)
column("split_billing", "SELECT event_id, headliner || '/' || array_to_string(openers, '+') AS value FROM shows", views.shows, lambda: (lambda b: F.concat(b["headliner"], F.lit("/"), F.array_join(b["openers"], "+")))(times.split_billing(F.array_join(F.concat(F.array("headliner"), F.col("openers")), " • "))))
EPOCH = "(epoch(date)::BIGINT + coalesce(substr(coalesce(show_time, doors_time), 1, 2)::BIGINT, 0) * 3600 + coalesce(substr(coalesce(show_time, doors_time), 4, 2)::BIGINT, 0) * 60)"
column("show_epoch", f"SELECT event_id, {EPOCH} AS value FROM shows", views.shows, lambda: times.show_epoch(F.col("date"), F.col("show_time"), F.col("doors_time")))


@query("""SELECT event_id, '{"headliner":"' || headliner || '","date":"' || date || '"}' AS value FROM shows""", "change_detail")
def change_detail(spark, sf):
    none = views.shows(spark, sf).limit(0).select("source", "source_id")
    made = captures.new_event(views.shows(spark, sf), none, ref())
    return made.select(F.col("event_source_id").cast("long").alias("event_id"), F.col("change_detail").alias("value"))
