"""Table operators on small tables worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gigmatch.operators import captures, history, resolution, shows, upserts
from gigmatch.plans import jobs
from gigmatch.sources import files, html_feeds, json_feeds

def ref():
    return F.lit("2026-07-01").cast("timestamp")



def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def world(spark):
    """Three performers and three shows; the last show names nobody known."""
    artists = spark.createDataFrame([(1, "Mt. Joy", "m1"), (2, "Built to Spill", None), (3, "Wilco", "m3")], "artist_id long, raw_name string, mbid string")
    plays = spark.createDataFrame(
        [(1, "Mt. Joy", "a", day("2026-06-30")), (1, "Mt. Joy", "b", day("2026-06-29 23:00")), (1, "Mt. Joy", "c", day("2026-06-29 22:00")), (2, "Built to Spill", "d", day("2026-06-29"))],
        "artist_id long, artist_name string, track_name string, scrobbled_at timestamp",
    )
    tags = spark.createDataFrame([(1, "indie", 100.0), (2, "indie", 80.0), (2, "rock", 60.0), (3, "country", 50.0)], "artist_id long, tag string, weight double")
    events = spark.createDataFrame(
        [
            (1, "s", "e1", "Mount Joy", ["Wilco"], dt.date(2026, 8, 1), None, "20:00", "Hall", "https://www.etix.com/p/1/"),
            (2, "s", "e2", "Built To Spill!", [], dt.date(2026, 8, 2), None, None, "Hall", None),
            (3, "s", "e3", "Nobody Known At All", None, dt.date(2026, 8, 3), None, None, "Hall", None),
        ],
        "event_id long, source string, source_id string, headliner string, openers array<string>, date date, doors_time string, show_time string, venue string, ticket_url string",
    )
    return artists, plays, tags, events


def test_affinity(spark, world):
    artists, plays, _, _ = world
    rows = history.decayed_affinity(history.plays_with_artist(plays, artists), ref())
    got = {r.key: (r.weight, r.play_count, r.raw_name) for r in rows.collect()}
    days = [1.0, 1 + 1 / 24, 1 + 2 / 24]
    assert got["m1"] == (round(sum(2 ** (-d / 56) for d in days), 6), 3, "Mt. Joy")
    assert got["Built to Spill"][0] == round(2 ** (-2 / 56), 6)


def test_resolution_bands(spark, world):
    artists, _, _, events = world
    matches, unmatched = jobs.resolve_events(events, artists)
    got = {(r.event_id, r.artist_id): (r.match_type, r.status) for r in matches.collect()}
    assert got == {(1, 1): ("fuzzy", "matched"), (1, 3): ("exact", "matched"), (2, 2): ("exact", "matched")}
    assert [r.name for r in unmatched.collect()] == ["Nobody Known At All"]


def test_resolution_by_identifier_and_thresholds(spark, world):
    artists, _, _, events = world
    mbids = spark.createDataFrame([("Nobody Known At All", "m3"), ("Mount Joy", "unknown"), ("Wilco", "m1")], "name string, event_mbid string")
    matches, unmatched = jobs.resolve_events(events, artists, mbids=mbids)
    got = {(r.event_id, r.artist_id): (r.matched_name, r.match_type) for r in matches.collect()}
    assert got == {(1, 1): ("Wilco", "mbid"), (2, 2): ("Built To Spill!", "exact"), (3, 3): ("Nobody Known At All", "mbid")}
    assert unmatched.count() == 0
    status = lambda **k: {r.event_id: r.status for r in jobs.resolve_events(events, artists, **k)[0].filter("match_type = 'fuzzy'").collect()}
    assert status() == {1: "matched"} and status(threshold=0.95) == {1: "review"} and status(threshold=0.95, floor=0.9) == {}


def test_jdbc_matrix(spark):
    url = "jdbc:derby:memory:travel;create=true"
    spark.createDataFrame([(1, "Hall"), (2, "Room")], "venue_id long, name string").write.option("createTableColumnTypes", "name VARCHAR(64)").jdbc(url, "venue")
    spark.createDataFrame([(1, "home", 600, 1609), (2, "away", 60, 10)], "venue_id long, cell_id string, base_seconds int, base_meters int").write.option("createTableColumnTypes", "cell_id VARCHAR(64)").jdbc(url, "matrix")
    assert [tuple(r) for r in shows.read_jdbc_tables(spark, url, "venue", "matrix", "home").collect()] == [(1, "Hall", 10, 1.0)]


def test_snapshots_of_a_large_source_are_several_values(spark):
    rows = spark.range(500).select(
        F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("H").alias("headliner"), F.array().cast("array<string>").alias("openers"),
        F.lit("2026-01-01").cast("date").alias("date"), *[F.lit(None).cast("string").alias(c) for c in ("doors_time", "show_time", "venue")],
        F.lit(None).cast("date").alias("on_sale_date"), F.lit(None).cast("string").alias("ticket_url"),
    )
    made = files.snapshot_rows(rows, ref(), 50)
    assert made.count() == 10 and made.agg(F.max("event_count")).first()[0] < 100
    assert files.parse_snapshots(made).select("source_id").distinct().count() == 500


def test_names_without_latin_letters_match_nothing(spark):
    artists = spark.createDataFrame([(1, "東京", None)], "artist_id long, raw_name string, mbid string")
    asked = spark.createDataFrame([("大阪",)], "name string")
    assert resolution.resolve_exact(asked, artists).count() == 0
    assert resolution.resolve_exact(asked, artists, match_empty_norm=True).count() == 1


@pytest.mark.parametrize("version", ["exact-match-v1", "discovery-v1"])
def test_digest(spark, world, version):
    artists, plays, tags, events = world
    matches, _ = jobs.resolve_events(events, artists)
    scores = jobs.score_shows(plays, artists, tags, matches, version, ref())
    digest = jobs.build_digest(events, scores, matches, artists, version).collect()
    assert [r.source_id for r in digest] == (["e1", "e2"] if version == "exact-match-v1" else [digest[0].source_id, digest[1].source_id])
    assert "e3" not in {r.source_id for r in digest}
    for r in digest:
        assert r.score_total == pytest.approx(r.taste_score + r.adjacency_score + r.discovery_score + r.recency_score + r.distance_score, abs=2e-6)
    if version == "exact-match-v1":
        assert digest[0].score_total == pytest.approx(sum(2 ** (-d / 56) for d in (1, 1 + 1 / 24, 1 + 2 / 24)), abs=1e-5)
        assert digest[0].matched_artists == ["Mt. Joy", "Wilco"]


def test_light_artist_outranks_heavy_one_only_for_discovery(spark):
    artists = spark.createDataFrame([(1, "Heavy", None), (2, "Light", None)], "artist_id long, raw_name string, mbid string")
    rows = [(1, "Heavy", f"t{i}", day("2026-06-30") - dt.timedelta(hours=i)) for i in range(50)] + [(2, "Light", "x", day("2026-06-30"))]
    plays = spark.createDataFrame(rows, "artist_id long, artist_name string, track_name string, scrobbled_at timestamp")
    tags = spark.createDataFrame([(a, t, w) for a in (1, 2) for t, w in (("indie rock", 100.0), ("indie", 80.0))], "artist_id long, tag string, weight double")
    matches = spark.createDataFrame([(10, 1, "matched"), (20, 2, "matched")], "event_id long, artist_id long, status string")
    best = lambda v: max(jobs.score_shows(plays, artists, tags, matches, v, ref()).collect(), key=lambda r: r.score_total).event_id
    assert (best("exact-match-v1"), best("discovery-v1")) == (10, 20)


def test_upserts_twice_change_nothing(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    incoming = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (None, "e", 2)], "k long, v string, n int")
    once = upserts.upsert_update(stored, incoming, ["k"], ["n"])
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows == sorted([(1, "a", 1), (2, "b", 2), (3, "d", 2), (None, "e", 2)], key=str)
    assert sorted(map(tuple, upserts.upsert_update(once, incoming, ["k"], ["n"]).collect()), key=str) == rows
    added = upserts.upsert_insert_ignore(stored, incoming.dropna(), ["k"])
    assert sorted(r.v for r in added.collect()) == ["a", "b", "d"]
    assert upserts.new_rows(incoming.dropna(), added, ["k"]).count() == 0


def test_unresolved_queue_counts_attempts(spark):
    failed = spark.createDataFrame([("x", "no_match")], "raw_name string, failure_reason string")
    empty = spark.createDataFrame([], "raw_name string, failure_reason string, attempt_count long, first_failed_at timestamp, last_attempted_at timestamp")
    first = upserts.unresolved_queue(empty, failed, ref())
    again = upserts.unresolved_queue(first, failed, F.lit("2026-07-02").cast("timestamp")).first()
    assert (again.attempt_count, again.first_failed_at, again.last_attempted_at) == (2, day("2026-07-01"), day("2026-07-02"))


def test_snapshot_diff(spark):
    schema = "source string, source_id string, headliner string, date date, openers array<string>"
    prev = spark.createDataFrame([("s", "1", "A", dt.date(2026, 1, 1), ["x"]), ("s", "9", "Gone", dt.date(2026, 1, 1), [])], schema)
    curr = spark.createDataFrame([("s", "1", "A", dt.date(2026, 1, 1), ["x", "y", "z"]), ("s", "2", "B", dt.date(2026, 1, 2), ["q"])], schema)
    got = sorted((r.event_source_id, r.change_type, r.change_detail) for r in captures.snapshot_diff(curr, prev, ref()).collect())
    assert got == [("1", "opener_added", '{"opener":"y"}'), ("1", "opener_added", '{"opener":"z"}'), ("2", "new_event", '{"headliner":"B","date":"2026-01-02"}')]
    assert captures.opener_added(curr, prev, ref(), one_per_event=True).count() == 1
    assert captures.snapshot_diff(curr, curr, ref()).count() == 0


def test_source_health(spark):
    counts = [100, 100, 100, 49, 50, 0, 100]
    rows = [("s", dt.date(2026, 1, i + 1), n) for i, n in enumerate(counts)]
    got = captures.source_health(spark.createDataFrame(rows, "source string, captured_at date, n long")).orderBy("captured_at").collect()
    assert [r.anomaly_flag for r in got] == [False, False, False, True, False, True, False]
    assert got[-1].trailing_counts == counts and got[-2].last_success_at == dt.date(2026, 1, 5)


def test_merge_prefers_direct_links(spark):
    rows = [
        (1, "a", "Band", "Aladdin Theater", dt.date(2026, 7, 4), "https://www.ticketmaster.com/1", 50, 1),
        (2, "b", "BAND!", "Aladdin", dt.date(2026, 7, 4), "https://www.etix.com/2", None, 2),
        (3, "b", "Band", "Aladdin", dt.date(2026, 7, 5), None, None, 3),
    ]
    feed = spark.createDataFrame(rows, "event_id long, source string, headliner string, venue string, date date, ticket_url string, score_total int, ord long")
    got = {r.date.day: (r.event_id, r.ticket_provider, r.ticket_url, r.listings) for r in shows.merge_shows(feed).collect()}
    assert got == {4: (1, "etix", "https://www.etix.com/2", 2), 5: (3, "none", None, 1)}


def test_playlist_share(spark):
    plan = spark.createDataFrame([(1, True, "u1"), (2, True, None), (3, False, "u3"), (3, False, "u3")], "artist_id long, under_explored boolean, uri string")
    got = shows.plan_summary(plan).first()
    assert (got.track_count, got.resolved_count) == (4, 3) and got.under_explored_pct == pytest.approx(2 / 3)
    assert shows.under_explored_pct(plan.limit(0)).first().share == 0.0


def test_parsers_drop_what_is_broken(spark):
    raw = lambda s: spark.createDataFrame([(s,), ("not json",), (None,)], "raw_json string")
    page = '{"recenttracks": {"track": [{"artist": {"#text": " A "}, "name": "t", "album": {"#text": ""}, "date": {"uts": "60"}}, {"artist": {"#text": "A"}, "name": "now", "@attr": {"nowplaying": "true"}}, {"artist": {"#text": "A"}, "name": "bad", "date": {"uts": "x"}}]}}'
    assert [tuple(r) for r in json_feeds.parse_play_history(raw(page)).collect()] == [(day("1970-01-01 00:01"), "A", "t", None)]
    flat = '{"events": [{"start_date": "2026-06-20 25:00:00", "title": "A &amp; B", "id": 7, "url": "u"}, {"start_date": "nope", "title": "x", "id": 8}, {"start_date": "2026-06-20", "title": "Cancelled!", "id": 9}]}'
    got = json_feeds.parse_flat_events_json(raw(flat), "s", "v").collect()
    assert [(r.source_id, r.headliner, r.show_time) for r in got] == [("7", "A & B", None)]


def test_cards(spark):
    spec = html_feeds.CardSpec("s", html_feeds.Select("div", "ev", take="data-id"), html_feeds.Select("h3"), html_feeds.Select("time"), html_feeds.Select("a", take="href"), venue="Hall")
    html = '<div class="ev big" data-id="1"><h3>A &amp; Co | B<br></h3><time>Tue, Jun 23</time><p><a href="u1">x</a></div><div class="ev"><h3>no link</h3><time>Jun 1</time></div><div class="ev" data-id="1"><h3>again</h3><time>Jun 2</time><a href="u">y</a></div>'
    pages = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = html_feeds.extract_card_events(pages, spec, F.lit("2026-06-20").cast("date")).collect()
    assert [(r.source_id, r.headliner, r.openers, str(r.date), r.venue) for r in got] == [("1", "A & Co", ["B"], "2026-06-23", "Hall")]


def test_writers(spark, tmp_path):
    digest = spark.createDataFrame(
        [(1, "s", "1", "A", "Hall", dt.date(2026, 7, 4), 1.5, ["X"], None, 1.5, 0.0, 0.0, 0.0, 0.0)],
        "event_id long, source string, source_id string, headliner string, venue string, date date, score_total double, matched_artists array<string>, ticket_url string, taste_score double, adjacency_score double, discovery_score double, recency_score double, distance_score double",
    )
    for kind in ("json", "text", "ics"):
        files.write_digest(digest, kind, str(tmp_path / kind))
    assert spark.read.json(str(tmp_path / "json")).first().headliner == "A"
    assert "A @ Hall [X]" in spark.read.text(str(tmp_path / "text")).first().value
    lines = [r.value for r in spark.read.text(str(tmp_path / "ics")).collect()]
    assert "BEGIN:VCALENDAR" in lines and "SUMMARY:A @ Hall" in lines
    raw = spark.createDataFrame([("s", "1", "A", ["B"], dt.date(2026, 7, 4), None, "20:00", "Hall", None, None)], "source string, source_id string, headliner string, openers array<string>, date date, doors_time string, show_time string, venue string, on_sale_date date, ticket_url string")
    files.write_snapshot(raw, ref(), str(tmp_path / "snap"))
    assert files.read_snapshots(spark, str(tmp_path / "snap")).first().headliner == "A"


def test_cards_below_elements_left_open():
    spec = html_feeds.CardSpec("s", html_feeds.Select("div", "ev"), html_feeds.Select("h3"), html_feeds.Select("time"), html_feeds.Select("a", take="href"))
    page = '<div class="ev"><h3>Big <b>Band</b> live</h3><time>Jun 3</time><a href="u1">x</a></div>'
    assert html_feeds.cards("<p>" * 5000 + page, spec) == html_feeds.cards(page, spec) == [("u1", "Big Band live", "Jun 3", "Jun 3", "", "u1")]
