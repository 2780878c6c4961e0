"""Column expressions on literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gigmatch.functions import links, names, scoring, times, venues

def today():
    return F.lit("2026-06-20").cast("date")



def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "event, taste, ratio, threshold",
    [
        ("Mount Joy", "Mt. Joy", 0.8, 0.75),
        ("The War on Drugs", "War on Drugs", 0.857143, 0.92),
        ("Modest Mouse", "Modern Baseball", 0.518519, 0.75),
        ("Death Cab", "Death Cab for Cutie", 0.642857, 0.92),
        ("The Strike", "The Strokes", 0.857143, 0.90),
        ("The Verve Pipe", "The Verve", 0.782609, 0.92),
    ],
)
def test_similarity_and_threshold(spark, event, taste, ratio, threshold):
    got = spark.range(1).select(
        F.round(names.similarity(F.lit(event), F.lit(taste)), 6).alias("r"), names.match_threshold(F.lit(event), F.lit(taste)).alias("t")
    ).first()
    assert (got.r, got.t) == (ratio, threshold)


def test_names(spark):
    assert value(spark, names.normalize_name(F.lit("  AC/DC!! & Friends "))) == "ac dc friends"
    assert value(spark, names.normalize_name(F.lit("Ñandú Üñ"))) == "and"
    assert value(spark, names.artist_key(F.lit(""), F.lit("x"))) == "x"
    assert value(spark, names.match_status(F.lit(0.5499999), F.lit(0.75))) is None
    assert value(spark, names.match_status(F.lit(0.7499999), F.lit(0.75))) == "matched"


def test_scoring(spark):
    assert value(spark, scoring.recency_signal(F.lit(-3.0))) == 1.0
    assert value(spark, scoring.saturate(F.lit(5.0), 5.0)) == 0.5
    assert value(spark, scoring.score_to_100(F.lit(None).cast("double"))) is None
    assert value(spark, scoring.score_to_100(F.lit(0.025))) == 2
    assert value(spark, scoring.score_class(F.lit(70))) == "hi"
    with pytest.raises(KeyError):
        scoring.config("none")


@pytest.mark.parametrize(
    "url, provider",
    [
        (None, "none"), ("", "none"), ("not a url", "none"), ("https://www.etix.com/x", "etix"), ("//dice.fm/e", "dice"),
        ("https://a_b.example.org/", "venue"), ("https://u:p@www.TicketMaster.com:443/p", "ticketmaster"), ("https://www.songkick.com", "songkick"),
    ],
)
def test_provider(spark, url, provider):
    assert value(spark, links.classify_provider(F.lit(url).cast("string"))) == provider


def test_ranks(spark):
    ranks = [value(spark, links.provider_rank(F.lit(p))) for p in ("etix", "venue", "livenation", "songkick", "none")]
    assert ranks == [100, 60, 20, 10, 0]
    assert value(spark, links.provider_label(F.lit(None).cast("string"))) == "Tickets"
    assert value(spark, links.ticket_id_from_url(F.lit("https://x/e/1"))) == "https://x/e/1"


@pytest.mark.parametrize(
    "text, date",
    [("Tue, Jun 23", "2026-06-23"), ("January 5", "2027-01-05"), ("Apr 1", "2026-04-01"), ("Feb 30", None), ("soon", None)],
)
def test_month_day(spark, text, date):
    got = value(spark, times.parse_month_day(F.lit(text), today()))
    assert got == (dt.date.fromisoformat(date) if date else None)


def test_dates(spark):
    assert value(spark, times.parse_full_date(F.lit("Tue, June 23rd, 2026"), today())) == dt.date(2026, 6, 23)
    assert value(spark, times.parse_full_date(F.lit("Tuesday, March 2nd, 2027"), today())) == dt.date(2027, 3, 2)
    assert value(spark, times.parse_numeric_md(F.lit("Sun 6/21"), today())) == dt.date(2026, 6, 21)
    assert value(spark, times.month_to_num(F.lit("JUNE"))) == 6


@pytest.mark.parametrize(
    "text, doors, show",
    [
        ("Doors 7PM / Show 8:30 PM", "19:00", "20:30"), ("Doors: 6PM", "18:00", None), ("music at 12am", None, "00:00"),
        ("5pm doors, 6:30pm show", None, "17:00"), ("tba", None, None),
    ],
)
def test_clock(spark, text, doors, show):
    got = value(spark, times.doors_show_times(F.lit(text)))
    assert (got.doors, got.show) == (doors, show)


@pytest.mark.parametrize("time, shown", [("00:05", "12:05 AM"), ("12:00", "12:00 PM"), ("19:30", "7:30 PM"), (None, None)])
def test_shown_time(spark, time, shown):
    assert value(spark, times.format_time_12h(F.lit(time).cast("string"))) == shown


def test_entities(spark):
    assert value(spark, times.unescape_html(F.lit("Rock &#8217;n&#x27; Roll &amp; &quot;Soul&quot; &# &#zz;"))) == "Rock ’n' Roll & \"Soul\" &# &#zz;"


@pytest.mark.parametrize(
    "text, plain", [("&#38;lt;b&#62; caf&eacute; &copy;", "&lt;b> café ©"), ("&amp;amp;", "&amp;"), (None, None), ("", ""), ("a & b &nosuch;", "a & b &nosuch;")]
)
def test_entities_are_decoded_once(spark, text, plain):
    assert value(spark, times.unescape_html(F.lit(text).cast("string"))) == plain


def test_all_openers_stay(spark):
    got = value(spark, times.split_billing(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1500)), lambda i: i.cast("string")), " • ")))
    assert got.headliner == "0" and got.openers == [str(i) for i in range(1, 1501)]
    assert value(spark, times.split_billing(F.lit("")))["openers"] == []


def test_venues(spark):
    assert value(spark, venues.canonicalize_venue(F.lit(" Revolution Hall - Portland "))) == "Revolution Hall"
    assert value(spark, venues.venue_size(F.lit("The Aladdin Theater"))) == "mid"
    assert value(spark, venues.venue_size(F.lit("nowhere"))) == "mid"
    assert value(spark, venues.distance_band(F.lit(None).cast("int"))) is None
