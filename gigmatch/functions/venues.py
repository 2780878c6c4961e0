"""Venue names, sizes and travel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gigmatch.functions.names import normalize_name

#: Spellings of one venue, by lower-case name.
CANONICAL = {
    "revolution hall - portland": "Revolution Hall",
    "mcmenamins historic edgefield manor": "McMenamins Edgefield",
    "the get down music venue": "The Get Down",
    "mcmenamins edgefield amphitheatre": "Edgefield Amphitheater",
}
#: Phrases that don't tell venues apart, deleted in this order.
NOISE = ("music venue", "theater", "theatre", "- portland", "mcmenamins historic", "manor", "and hotel")
#: Parts of names by tier; the first in this order that is part of the name decides, else "mid".
SIZES = {
    "large": (
        "moda center", "veterans memorial coliseum", "arlene schnitzer", "keller auditorium", "edgefield amphitheater",
        "mcmenamins edgefield", "roseland theater", "crystal ballroom", "newmark theatre",
    ),
    "mid": (
        "revolution hall", "wonder ballroom", "hawthorne theatre", "aladdin theater", "star theater", "lola's room",
        "dante's", "polaris hall", "bossanova", "alberta rose",
    ),
    "small": (
        "mississippi studios", "holocene", "white eagle", "al's den", "show bar", "jack london", "the get down",
        "blue diamond", "laurelthirst", "kenton club", "starday tavern", "no fun bar", "spare room",
        "blackberry hall", "kelly's olympian",
    ),
}
TIER_LABELS = {"large": "Large Venues", "mid": "Mid-Size Venues", "small": "Bars & Small Rooms"}
CLOSE_MINUTES, NEAR_MINUTES = 10, 30
METERS_PER_MILE = 1609.34


def canonicalize_venue(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(name))), name)


def normalize_venue(name: Column) -> Column:
    return F.trim(reduce(lambda c, phrase: F.replace(c, F.lit(phrase), F.lit("")), NOISE, F.lower(name)))


def show_key(venue: Column, date: Column, headliner: Column) -> Column:
    """What two listings of one show have in common."""
    return F.struct(
        normalize_name(normalize_venue(canonicalize_venue(venue))).alias("venue_key"),
        date.alias("show_date"),
        normalize_name(headliner).alias("headliner_key"),
    )


def venue_size(name: Column) -> Column:
    low = F.lower(name)
    pairs = [(part, tier) for tier, parts in SIZES.items() for part in parts]
    out = F.when(low.contains(pairs[0][0]), pairs[0][1])
    for part, tier in pairs[1:]:
        out = out.when(low.contains(part), tier)
    return out.otherwise("mid")


def travel_minutes(seconds: Column) -> Column:
    return F.bround(seconds / 60).cast("int")


def travel_miles(meters: Column) -> Column:
    return F.bround(meters / METERS_PER_MILE, 1)


def distance_band(minutes: Column) -> Column:
    return F.when(minutes <= CLOSE_MINUTES, "close").when(minutes <= NEAR_MINUTES, "near").when(minutes.isNotNull(), "far")
