"""JSON payloads to typed rows.  Schemas are given, never inferred; what doesn't parse becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmatch.functions.times import rest_of, unescape_html
from gigmatch.operators.history import valid_plays

#: Columns of a normalised show; times of day are ``HH:mm`` strings.
RAW_EVENT = (
    "source", "source_id", "headliner", "openers", "date", "doors_time", "show_time", "venue", "on_sale_date", "ticket_url",
)
_PLAYS = """recenttracks struct<track: array<struct<
    artist: struct<`#text`: string, mbid: string>, album: struct<`#text`: string>, name: string,
    date: struct<uts: string>, `@attr`: struct<nowplaying: string>>>>"""
_LISTING = """_embedded struct<events: array<struct<
    id: string, name: string, url: string,
    dates: struct<start: struct<localDate: string, localTime: string>>,
    sales: struct<public: struct<startDateTime: string>>,
    _embedded: struct<venues: array<struct<name: string>>, attractions: array<struct<name: string>>>>>>"""


def raw_event(**columns: Column) -> list[Column]:
    """The columns of RAW_EVENT in order; those not given are null (openers: empty)."""
    types = {"openers": "array<string>", "date": "date", "on_sale_date": "date"}
    columns.setdefault("openers", F.array())
    return [columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RAW_EVENT]


def clock(text: Column) -> Column:
    """``HH:mm`` from the first two parts of a time; null if they are no time."""
    part = lambda i: F.get(F.split(text, ":"), F.lit(i)).try_cast("int")
    h, m = part(0), part(1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h.between(0, 23) & m.between(0, 59), F.concat(two(h), F.lit(":"), two(m)))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def parse_play_history(raw: DataFrame) -> DataFrame:
    """Pages of a listening history (``raw_json``) to plays."""
    page = raw.select(F.from_json("raw_json", _PLAYS).alias("j"))
    track = page.select(F.explode("j.recenttracks.track").alias("t"))
    parsed = track.select(
        F.col("t.@attr.nowplaying").alias("now_playing"),
        F.col("t.date.uts").try_cast("long").alias("uts"),
        F.col("t.artist.#text").alias("artist_name"),
        F.col("t.name").alias("track_name"),
        F.col("t.album.#text").alias("album_name"),
    )
    return valid_plays(parsed)


def parse_ticketing_json(raw: DataFrame, source: str) -> DataFrame:
    """Nested listings (``raw_json``) to shows: the first named attraction is the headliner, the others open."""
    event = raw.select(F.explode(F.from_json("raw_json", _LISTING)["_embedded"]["events"]).alias("e"))
    acts = F.filter(F.transform(F.col("e._embedded.attractions"), lambda a: a["name"]), lambda n: filled(n))
    acts = F.coalesce(acts, F.array().cast("array<string>"))
    rows = event.filter(filled(F.col("e.id")) & filled(F.col("e.name")) & filled(F.col("e.dates.start.localDate"))).select("e", acts.alias("acts"))
    venue = F.nullif(F.get(F.col("e._embedded.venues"), F.lit(0))["name"], F.lit(""))
    return rows.select(*raw_event(
        source=F.lit(source),
        source_id=F.col("e.id"),
        headliner=F.coalesce(F.get("acts", F.lit(0)), F.col("e.name")),
        openers=rest_of(F.col("acts")),
        date=F.try_to_date(F.col("e.dates.start.localDate"), "yyyy-MM-dd"),
        show_time=clock(F.col("e.dates.start.localTime")),
        venue=F.coalesce(venue, F.lit("Unknown Venue")),
        on_sale_date=F.try_to_date(F.substring("e.sales.public.startDateTime", 1, 10), "yyyy-MM-dd"),
        ticket_url=F.col("e.url"),
    )).filter("date IS NOT NULL")


def parse_flat_events_json(raw: DataFrame, source: str, venue: str) -> DataFrame:
    """Flat listings (``events[]`` with start_date, title, id, url) to shows; cancelled ones are dropped."""
    schema = "events array<struct<start_date: string, title: string, id: string, url: string>>"
    event = raw.select(F.explode(F.from_json("raw_json", schema)["events"]).alias("e"))
    title = F.trim(unescape_html(F.col("e.title")))
    start = F.split(F.col("e.start_date"), " ")
    rows = event.select("e", title.alias("title"), F.get(start, F.lit(0)).alias("day"), F.get(start, F.lit(1)).alias("time"))
    rows = rows.filter(filled(F.col("title")) & filled(F.col("e.id")) & ~F.lower("title").contains("cancel"))
    return rows.select(*raw_event(
        source=F.lit(source), source_id=F.col("e.id"), headliner=F.col("title"),
        date=F.try_to_date("day", "yyyy-MM-dd"), show_time=clock(F.col("time")), venue=F.lit(venue), ticket_url=F.col("e.url"),
    )).filter("date IS NOT NULL")


def parse_artist_tags(raw: DataFrame) -> DataFrame:
    """(artist, tag, weight) from tag lists (``raw_json``); a count that is no number weighs 0."""
    schema = "toptags struct<tag: array<struct<name: string, count: string>>, `@attr`: struct<artist: string>>"
    page = raw.select(F.from_json("raw_json", schema)["toptags"].alias("t"))
    tags = page.select(F.col("t.@attr.artist").alias("artist"), F.explode("t.tag").alias("g"))
    weight = F.coalesce(F.col("g.count").try_cast("double"), F.lit(0.0))
    return tags.filter(filled(F.col("g.name"))).select("artist", F.col("g.name").alias("tag"), weight.alias("weight"))


def parse_top_tracks(raw: DataFrame) -> DataFrame:
    """(artist, rank, track) in the order of the list, from 1; tracks without a name are skipped."""
    schema = "toptracks struct<track: array<struct<name: string>>, `@attr`: struct<artist: string>>"
    page = raw.select(F.from_json("raw_json", schema)["toptracks"].alias("t"))
    names = F.filter(F.transform("t.track", lambda t: t["name"]), lambda n: filled(n))
    rows = page.select(F.col("t.@attr.artist").alias("artist"), F.posexplode(names).alias("pos", "track"))
    return rows.select("artist", (F.col("pos") + 1).alias("rank"), "track")


def parse_track_candidates(raw: DataFrame) -> DataFrame:
    """(request_id, uri, name, artists, popularity) from search results (``request_id``, ``raw_json``)."""
    schema = "tracks struct<items: array<struct<uri: string, name: string, artists: array<struct<name: string>>, popularity: int>>>"
    rows = raw.select("request_id", F.explode(F.from_json("raw_json", schema)["tracks"]["items"]).alias("i"))
    artists = F.array_join(F.transform("i.artists", lambda a: a["name"]), ", ")
    return rows.select("request_id", F.col("i.uri").alias("uri"), F.col("i.name").alias("name"), artists.alias("artists"), F.col("i.popularity").alias("popularity"))
