"""Signals of a show and their weighted, versioned terms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 56.0
DAY_MICROS = 86_400_000_000.0
TERMS = ("taste", "adjacency", "discovery", "recency", "distance")


@dataclass(frozen=True)
class ScoringConfig:
    """Weights by term; ``saturation`` bounds taste below 1."""

    weights: Mapping[str, float]
    saturation: float | None = None


#: Weights by version.
CONFIGS: dict[str, ScoringConfig] = {
    "exact-match-v1": ScoringConfig({"taste": 1.0}),
    "discovery-v1": ScoringConfig({"taste": 0.5, "adjacency": 0.5, "discovery": 2.0, "recency": 0.3}, 5.0),
}
DIGEST_VERSION, FEED_VERSION = "exact-match-v1", "discovery-v1"


def config(version: str) -> ScoringConfig:
    if version not in CONFIGS:
        raise KeyError(f"no scoring version {version!r}")
    return CONFIGS[version]


def days_since(ts: Column, ref: Column) -> Column:
    return (F.unix_micros(ref) - F.unix_micros(ts)) / F.lit(DAY_MICROS)


def decay_weight(ts: Column, ref: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halves every ``half_life`` days; plays after ``ref`` weigh more than 1."""
    return F.pow(F.lit(2.0), -days_since(ts, ref) / F.lit(half_life))


def recency_signal(days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(days, F.lit(0.0)) / F.lit(half_life))


def discovery_signal(adjacency: Column, plays: Column) -> Column:
    return adjacency / (F.lit(1.0) + plays)


def saturate(taste: Column, k: float | None) -> Column:
    return taste if k is None else F.when(taste > 0, taste / (taste + F.lit(k))).otherwise(F.lit(0.0))


def score_terms(signals: DataFrame, version: str) -> DataFrame:
    """``signals`` plus <term>_score for the five terms, their rounded sum score_total, and scoring_version."""
    chosen = config(version)
    value = {t: F.col(t) for t in TERMS} | {"taste": saturate(F.col("taste"), chosen.saturation)}
    terms = {f"{t}_score": F.round(value[t] * F.lit(chosen.weights.get(t, 0.0)), 6) for t in TERMS}
    scored = signals.withColumns(terms)
    total = sum((F.col(f"{t}_score") for t in TERMS[1:]), F.col(f"{TERMS[0]}_score"))
    return scored.withColumns({"score_total": F.round(total, 6), "scoring_version": F.lit(version)})


def ab_diff(signals: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Totals of two versions on the same signals, and b less a for each term and in total."""
    extra = [c for c in signals.columns if c not in TERMS]
    names = [f"{t}_score" for t in TERMS] + ["score_total"]
    a = score_terms(signals, version_a).withColumnsRenamed({n: f"a_{n}" for n in names})
    both = score_terms(a, version_b)
    deltas = [F.round(F.col(n) - F.col(f"a_{n}"), 6).alias(f"{n.removesuffix('_score')}_delta") for n in names[:-1]]
    return both.select(
        *extra,
        F.lit(version_a).alias("version_a"),
        F.lit(version_b).alias("version_b"),
        F.col("a_score_total").alias("total_a"),
        F.col("score_total").alias("total_b"),
        *deltas,
        F.round(F.col("score_total") - F.col("a_score_total"), 6).alias("total_delta"),
    )


def score_to_100(total: Column) -> Column:
    return F.when(total.isNotNull(), F.least(F.lit(100), F.bround(total * 100).cast("int")))


def score_class(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 70, "hi").when(score >= 40, "md").otherwise("lo")


def under_explored(plays: Column, max_plays: int = 25) -> Column:
    return plays <= max_plays
