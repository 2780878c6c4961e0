"""Tracks by blocks of rare tokens, venues by automata, a travel matrix in ranges: against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gigmatch.functions import names as name_functions
from gigmatch.functions.names import ratio
from gigmatch.operators import shows, tracks, travel
from gigmatch.plans import jobs

REQUEST, TRACK = "artist_name string, track_name string", "uri string, name string, artists string"


def test_names_without_latin_letters_are_told_apart(spark):
    catalog = spark.createDataFrame([("u1", "桜", "東京"), ("u2", "海", "大阪"), ("u3", "Песня", "Группа"), ("u4", "Song", "Band")], TRACK)
    wanted = spark.createDataFrame([("東京", "桜"), ("大阪", "海"), ("大阪", "桜桜桜桜"), ("группа", "ПЕСНЯ"), ("Band", "song!"), ("無名", "無題"), ("", ""), (None, "x")], REQUEST)
    got = {(r.artist_name, r.track_name): r.chosen_uri for r in jobs.resolve_tracks(wanted, catalog).collect()}
    assert got[("東京", "桜")] == "u1" and got[("大阪", "海")] == "u2" and got[("группа", "ПЕСНЯ")] == "u3" and got[("Band", "song!")] == "u4"
    assert got[("大阪", "桜桜桜桜")] is None and got[("無名", "無題")] is None and got[("", "")] is None


def spelled(rng, text):
    text = list(text)
    for _ in range(rng.randint(0, 2)):
        text[rng.randrange(len(text))] = rng.choice("abcdefghij ")
    return "".join(text)


@pytest.mark.parametrize("many", [5, 500])
def test_recall_against_all_pairs(spark, many):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    title = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"u{i:04d}", title(rng.randint(1, 4)), "the " + title(rng.randint(1, 3))) for i in range(1500)]
    rows += [(f"h{i:04d}", "love " + title(1), "the band") for i in range(300)]  # hot tokens
    asked = [(spelled(rng, a), spelled(rng, t)) for _, t, a in rng.sample(rows, 200)]
    catalog, wanted = spark.createDataFrame(rows, TRACK), spark.createDataFrame(asked, REQUEST)
    candidates = tracks.track_candidates(wanted, catalog, many=many)
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    score = lambda q, r: round(0.5 * ratio(norm(q[0]), norm(r[2])) + 0.5 * ratio(norm(q[1]), norm(r[1])), 6)
    found = {}
    for r in candidates.collect():
        found.setdefault((r.artist_name, r.track_name), []).append(score((r.artist_name, r.track_name), (r.uri, r.name, r.artists)))
    best = {q: max(score(q, r) for r in rows) for q in set(asked)}
    worth = [q for q, s in best.items() if s >= jobs.TRACK_THRESHOLD]
    hit = [q for q in worth if max(found.get(q, [0])) == best[q]]
    print(len(hit), len(worth), sum(map(len, found.values())))
    assert len(hit) >= 0.9 * len(worth) and sum(map(len, found.values())) < 0.1 * len(asked) * len(rows)


def test_similarity_of_bare_names(spark):
    df = spark.createDataFrame([("東京", "東京", 1.0), ("東京", "大阪", 0.0), ("東京", "tokyo", 0.0), ("A b", "a-B!", 1.0), (None, "x", None)], "a string, b string, want double")
    got = df.select("want", name_functions.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.want for r in got] == [r.s for r in got]


@pytest.mark.parametrize("patterns, part", [(3, 4), (20_000, 20_000)])
def test_containment_both_ways(spark, monkeypatch, patterns, part):
    monkeypatch.setattr(travel, "PATTERNS", patterns)
    monkeypatch.setattr(travel, "PART", part)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(1, n))).strip() or "b"
    asked, known = sorted({word(7) for _ in range(40)}), [(word(7), i) for i in rng.sample(range(1000), 60)]
    got = travel.first_containing(spark.createDataFrame([(v,) for v in asked], "v string"), spark.createDataFrame(known, "k string, venue_id long"))
    want = {v: min(i for k, i in known if k in v or v in k) for v in asked if any(k in v or v in k for k, _ in known)}
    assert {r.v: r.venue_id for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_venues_by_their_normal_names(spark):
    asked = spark.createDataFrame([("Revolution Hall - Portland",), ("Hall",), ("",), (None,), ("Elsewhere",)], "venue string")
    table = spark.createDataFrame([(2, "Revolution Hall", 9, 1.0), (1, "Old Revolution Hall Annex", 5, 2.0), (3, "", 1, 1.0), (4, None, 1, 1.0)], "venue_id int, name string, minutes int, miles double")
    got = {r.venue: r.minutes for r in shows.venue_travel(asked, table).collect()}
    assert got["Hall"] == 5 and "" not in got and None not in got and "Elsewhere" not in got
    empty = shows.venue_travel(asked, table.limit(0))
    assert empty.count() == 0


def test_matrix_is_read_in_ranges_of_the_home_cell(spark):
    url = "jdbc:derby:memory:ranges;create=true"
    spark.range(1, 101).selectExpr("id AS venue_id", "concat('v', id) AS name").write.option("createTableColumnTypes", "name VARCHAR(64)").jdbc(url, "venue")
    cells = spark.range(1, 101).selectExpr("id AS venue_id", "explode(array('home', 'far')) AS cell_id", "cast(id * 60 AS int) AS base_seconds", "cast(id AS int) AS base_meters")
    cells.write.option("createTableColumnTypes", "cell_id VARCHAR(64)").jdbc(url, "matrix")
    got = shows.read_jdbc_tables(spark, url, "venue", "matrix", "home", partitions=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(CELL_ID,home)" in plan or "EqualTo(cell_id,home)" in plan
    assert "numPartitions=4" in plan and {r.minutes for r in got.collect()} == set(range(1, 101))
    assert shows.read_jdbc_tables(spark, url, "venue", "matrix", "no'where").count() == 0


def test_similarity_from_sql(spark):
    name_functions.register_similarity(spark)
    df = spark.createDataFrame([("Mt. Joy", "Mount Joy"), ("  A-b ", "a B"), (None, "x"), ("東京", "x")], "a string, b string")
    df.createOrReplaceTempView("named")
    got = [r.s for r in spark.sql("SELECT similarity(a, b) AS s FROM named").collect()]
    assert got == [r.s for r in df.select(name_functions.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
