"""Performer names: normal form, match thresholds, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MATCH_THRESHOLD, REVIEW_FLOOR = 0.75, 0.55
#: Bars for pairs whose characters agree for structural reasons: one name's words are part of the other's; both
#: come down to a single word.
SUBSET_BAR, SINGLE_WORD_BAR = 0.92, 0.90
ARTICLES = ("the", "a", "an")


def normalize_name(name: Column) -> Column:
    """Lower case; every run of characters other than a-z and 0-9 becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def _words(name: Column) -> Column:
    return F.filter(F.split(normalize_name(name), " "), lambda w: w != "")


def distinctive_tokens(name: Column) -> Column:
    return F.filter(_words(name), lambda w: ~w.isin(*ARTICLES))


def match_threshold(event_name: Column, taste_name: Column, base: float = MATCH_THRESHOLD) -> Column:
    """What a fuzzy pair's confidence must reach; only the first structural case that holds raises it."""
    a, b = F.array_distinct(_words(event_name)), F.array_distinct(_words(taste_name))
    within = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y))
    single = (F.size(distinctive_tokens(event_name)) == 1) & (F.size(distinctive_tokens(taste_name)) == 1)
    return (
        F.when(within(a, b) | within(b, a), F.lit(max(base, SUBSET_BAR)))
        .when(single, F.lit(max(base, SINGLE_WORD_BAR)))
        .otherwise(F.lit(base))
    )


def match_status(confidence: Column, threshold: Column, floor: float = REVIEW_FLOOR) -> Column:
    """The floor sees the confidence as it is, the threshold sees it rounded to six digits; null: no link."""
    rounded = F.round(confidence, 6)
    return F.when(confidence >= floor, F.when(rounded >= threshold, "matched").otherwise("review"))


def artist_key(mbid: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(mbid, F.lit("")), name)


def ratio(event: str, taste: str) -> float:
    """Share of matching characters of two normalised strings; the order of the arguments matters."""
    return SequenceMatcher(None, event, taste).ratio()


def _ratios(event: pd.Series, taste: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(event, taste)], dtype="float64")


def similarity(event: Column, taste: Column) -> Column:
    """The one place where strings are compared in Python, a batch at a time."""
    return F.pandas_udf(_ratios, "double")(normalize_name(event), normalize_name(taste))


def register_similarity(spark: SparkSession, name: str = "similarity") -> None:
    """Makes the ratio of two normal forms callable from SQL: ``name(event, taste)``."""

    def ratios(event: pd.Series, taste: pd.Series) -> pd.Series:
        plain = lambda names: names.str.lower().str.replace("[^a-z0-9]+", " ", regex=True).str.strip(" ")
        return _ratios(plain(event), plain(taste))

    spark.udf.register(name, F.pandas_udf(ratios, "double"))


def _plain_ratios(event: pd.Series, taste: pd.Series) -> pd.Series:
    return _ratios(event.str.lower().str.strip(), taste.str.lower().str.strip())


def name_similarity(event: Column, taste: Column) -> Column:
    """``similarity``; where a name has no Latin letters or digits, that of the names as they are but for case."""
    bare = (normalize_name(event) == "") | (normalize_name(taste) == "")
    return F.when(bare, F.pandas_udf(_plain_ratios, "double")(event, taste)).otherwise(similarity(event, taste))


def track_match_score(artist: Column, track: Column, cand_artist: Column, cand_track: Column) -> Column:
    return F.round(name_similarity(artist, cand_artist) * 0.5 + name_similarity(track, cand_track) * 0.5, 6)
