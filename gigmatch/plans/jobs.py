"""Composite jobs: what users of the library call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmatch.functions import links, scoring
from gigmatch.functions.names import MATCH_THRESHOLD, REVIEW_FLOOR, artist_key, track_match_score
from gigmatch.operators import captures, history, resolution, shows, upserts
from gigmatch.operators.tracks import track_candidates
from gigmatch.sources.json_feeds import parse_play_history
from gigmatch.sources.shared import freed, materialise

TRACK_THRESHOLD, TRACK_LIMIT = 0.6, 5
PLAY_KEY = ["scrobbled_at", "artist_name", "track_name"]
EVENT_UPDATES = ["openers", "doors_time", "show_time", "ticket_url", "ticket_provider", "last_seen"]


def ingest_history(raw_json: DataFrame, stored_plays: DataFrame, stored_artists: DataFrame, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(plays, artist names) after adding the new plays of raw pages; running it twice changes nothing."""
    incoming = history.since_filter(parse_play_history(raw_json), since=since)
    plays = upserts.upsert_insert_ignore(stored_plays, incoming.select(*stored_plays.columns), PLAY_KEY)
    names = incoming.select(F.col("artist_name").alias("raw_name")).distinct()
    return plays, upserts.upsert_insert_ignore(stored_artists, names, ["raw_name"])


def ingest_events(raw_events: DataFrame, stored_events: DataFrame, previous: DataFrame, counts: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Events, changes and health after one capture of all sources.

    ``previous`` are the shows of each source's capture before, ``counts`` its runs so far.
    """
    fresh = raw_events.withColumns({"ticket_provider": links.classify_provider(F.col("ticket_url")), "first_seen": as_of, "last_seen": as_of})
    fresh = resolution.last_write_wins(fresh, ["source", "source_id"], [F.asc("headliner")])
    now = raw_events.withColumn("captured_at", as_of)
    runs = counts.unionByName(captures.source_counts(now))
    return {
        "events": upserts.upsert_update(stored_events, fresh.select(*stored_events.columns), ["source", "source_id"], EVENT_UPDATES),
        "changes": captures.snapshot_diff(fresh, previous, as_of),
        "health": captures.source_health(runs).filter(F.col("captured_at") == as_of),
    }


def resolve_events(
    events: DataFrame, artists: DataFrame, fuzzy: bool = True, mbids: DataFrame | None = None, threshold: float = MATCH_THRESHOLD, floor: float = REVIEW_FLOOR
) -> tuple[DataFrame, DataFrame]:
    """(matches, unmatched): one row per show and performer, the last billed name wins; names that match nothing are kept.

    A name is tried by its identifier (``mbids``: name, event_mbid), then by its normal form, then by similarity; the
    first that knows it decides.
    """
    names = resolution.event_artist_names(events)
    steps = [] if mbids is None else [lambda rest: resolution.resolve_mbid(rest.join(mbids.dropDuplicates(["name"]), "name"), artists)]
    steps += [lambda rest: resolution.resolve_exact(rest, artists)]
    steps += [lambda rest: resolution.resolve_fuzzy(rest, artists, threshold, floor)] if fuzzy else []
    rest, parts = names.select("name").distinct(), []
    for step in steps:
        parts.append(step(rest))
        rest = rest.join(parts[-1].select("name"), "name", "left_anti")
    found = reduce(DataFrame.unionByName, parts)
    linked = names.join(found, "name")
    rows = linked.select("event_id", "artist_id", F.col("name").alias("matched_name"), "match_type", "confidence", "status", "pos")
    unmatched = names.join(rest, "name", "left_semi").select("event_id", "pos", "name")
    return resolution.last_write_wins(rows, ["event_id", "artist_id"], ["pos"]).drop("pos"), unmatched


def score_shows(plays: DataFrame, artists: DataFrame, tags: DataFrame, matches: DataFrame, version: str, ref: Column, half_life: float = scoring.HALF_LIFE_DAYS, by: list[str] = []) -> DataFrame:
    """Scores of all matched shows: signals once per performer, best one per show.

    Per listener if ``by`` is given: for the matched performers that a listener has played or that share a tag with the
    listener's taste.  All others have the same score for everyone, that of no taste, and no row.
    """
    keyed = history.plays_with_artist(plays, artists, by)
    rows = history.tag_rows(artists, tags)
    who = shows.matched_only(matches).join(artists.select("artist_id", artist_key(F.col("mbid"), F.col("raw_name")).alias("key")), "artist_id")
    who = who.select("event_id", "artist_id", "key")
    if by:
        with freed(who.sparkSession):
            who = materialise(who, "scores-performers")
    matched = who.select("key").distinct()
    signals = scoring.score_terms(history.signals(keyed, rows, matched, ref, half_life, by=by), version).drop(*scoring.TERMS)
    if by:
        with freed(who.sparkSession):
            return shows.best_score_by_group(who, materialise(signals, "scores-signals"), by)
    return shows.best_score_per_event(who.join(signals, "key").drop("key"), by)


def build_digest(events: DataFrame, scores: DataFrame, matches: DataFrame, artists: DataFrame, version: str = scoring.DIGEST_VERSION) -> DataFrame:
    return shows.digest_order(shows.digest_join(events, scores, matches, artists, version))


def build_show_feed(events: DataFrame, scores: DataFrame, matches: DataFrame, artists: DataFrame, tags: DataFrame, travel: DataFrame, as_of: Column, version: str = scoring.FEED_VERSION, limit: int = shows.FEED_LIMIT) -> DataFrame:
    """The merged feed of upcoming shows, best first."""
    joined = shows.feed_join(events, scores, matches, artists, version, as_of)
    near = shows.venue_travel(events.select("venue"), travel)
    rows = shows.feed_rows(joined, shows.top_genres(tags), near, as_of)
    merged = shows.merge_shows(rows.withColumn("ord", F.col("event_id"))).drop("ord")
    return shows.feed_order(merged, limit)


def resolve_tracks(requests: DataFrame, catalog: DataFrame, threshold: float = TRACK_THRESHOLD, limit: int = TRACK_LIMIT) -> DataFrame:
    """Requests (artist_name, track_name) with the best track of a catalogue (uri, name, artists) and all candidates.

    Candidates are the catalogue's tracks of the same performer, and those that share rare words with the request
    (``tracks.track_candidates``).  Names without Latin letters are compared as they are.
    """
    pairs = track_candidates(requests, catalog)
    score = track_match_score(F.col("artist_name"), F.col("track_name"), F.col("artists"), F.col("name"))
    ranked = shows.rank_candidates(pairs.withColumn("match_score", score), ["artist_name", "track_name"], limit)
    listed = F.array_sort(F.collect_list(F.struct("rank", "uri", "name", "match_score")))
    found = ranked.groupBy("artist_name", "track_name").agg(listed.alias("candidates"))
    best = F.get("candidates", F.lit(0))
    all_rows = requests.select("artist_name", "track_name").join(found, ["artist_name", "track_name"], "left")
    return all_rows.select("artist_name", "track_name", F.when(best["match_score"] >= threshold, best["uri"]).alias("chosen_uri"), "candidates")


def build_playlist(scores: DataFrame, matches: DataFrame, artists: DataFrame, plays: DataFrame, top_tracks: DataFrame, catalog: DataFrame, version: str = scoring.FEED_VERSION, limit: int = shows.PLAYLIST_LIMIT) -> DataFrame:
    """The discovery playlist: rank, performer, track and URI (null where no track is close enough)."""
    candidates = shows.candidate_artists(matches, scores, artists, version)
    counts = history.play_counts(plays, artists).select("artist_id", F.col("n").alias("plays"))
    chosen = shows.select_artists(candidates.join(counts, "artist_id"), limit)
    first = shows.tracks_per_artist(top_tracks).select(F.col("artist_name").alias("raw_name"), "track_name")
    wanted = materialise(chosen.join(first, "raw_name"), "playlist-wanted")  # a playlist's rows, read by several steps
    resolved = resolve_tracks(wanted.select(F.col("raw_name").alias("artist_name"), "track_name"), catalog)
    uris = resolved.select(F.col("artist_name").alias("raw_name"), F.col("chosen_uri").alias("uri"))
    return wanted.join(uris, "raw_name").select("rank", "artist_id", "raw_name", "track_name", "score", "plays", "under_explored", "uri")


def explain_show(events: DataFrame, scores: DataFrame, matches: DataFrame, artists: DataFrame) -> DataFrame:
    """(event_id, scoring_version, term, value, matched): every term and the total of every version, long form."""
    named = shows.matched_only(matches).join(artists.select("artist_id", "raw_name"), "artist_id")
    line = F.format_string("%s [%s, %.3f]", "raw_name", "match_type", "confidence")
    who = named.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("matched"))
    columns = [*(f"{t}_score" for t in scoring.TERMS), "score_total"]
    terms = F.array(*[F.struct(F.lit(c.removesuffix("_score") if c != "score_total" else "TOTAL").alias("term"), F.col(c).alias("value")) for c in columns])
    long = events.select("event_id").join(scores, "event_id").select("event_id", "scoring_version", F.explode(terms).alias("t"))
    return long.join(who, "event_id", "left").select("event_id", "scoring_version", "t.term", "t.value", F.coalesce("matched", F.lit("")).alias("matched"))


def pipeline_health(ledger: DataFrame) -> DataFrame:
    return captures.latest_run(ledger).select("stage_name", "status", "started_at", "seconds", "error_message").orderBy("stage_name")
