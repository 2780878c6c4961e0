"""Venue names that hold a known name or lie in one, by automata of many patterns.

Names of one side are dealt into blocks, each an automaton; the names of the other side run through it once, whatever
the number of patterns.  It is done both ways, and each pair of a block and a part is one task.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmatch.sources.shared import materialise

#: Patterns of an automaton, and names of a part that run through it.
PATTERNS, PART = 20_000, 20_000
_FIRST = "v string, venue_id {0}"


def _automaton(patterns: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def _rows(first: dict[str, int]) -> pd.DataFrame:
    return pd.DataFrame({"v": pd.Series(list(first), dtype="object"), "venue_id": pd.Series(list(first.values()), dtype="int64")})


def _known_in_asked(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The lowest id of the known names that lie in each asked one."""
    first: dict[str, int] = {}
    if len(asked) and len(known):
        ids = known.groupby("k")["venue_id"].min().to_dict()
        made = _automaton(list(ids))
        for v in asked["v"]:
            found = [ids[k] for _, k in made.iter(v)]
            if found:
                first[v] = min(found)
    return _rows(first)


def _asked_in_known(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The lowest id of the known names that each asked one lies in."""
    first: dict[str, int] = defaultdict(lambda: 1 << 63)
    if len(asked) and len(known):
        made = _automaton(asked["v"].tolist())
        for k, i in zip(known["k"], known["venue_id"]):
            for _, v in made.iter(k):
                first[v] = min(first[v], int(i))
    return _rows(dict(first))


def first_containing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(v, venue_id): for each of ``asked`` (v: distinct, not empty) the lowest ``venue_id`` of ``known`` (k, venue_id) whose
    name is in it or holds it."""
    asked, known = materialise(asked, "travel-asked"), materialise(known.select("k", F.col("venue_id").cast("long").alias("venue_id")), "travel-known")
    n, m = asked.count(), known.count()
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    found = []
    for blocks, parts, of_known, compare in (
        (-(-m // PATTERNS) or 1, -(-n // PART) or 1, True, _known_in_asked),
        (-(-n // PATTERNS) or 1, -(-m // PART) or 1, False, _asked_in_known),
    ):
        k, v = ("block", "part") if of_known else ("part", "block")
        sizes = {"block": blocks, "part": parts}
        left = asked.select("v", own("v", sizes[v]).alias(v), every(sizes[k]).alias(k))
        right = known.select("k", "venue_id", own("k", sizes[k]).alias(k), every(sizes[v]).alias(v))
        keys = ["block", "part"]
        found.append(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, _FIRST.format("long")))
    return found[0].unionByName(found[1]).groupBy("v").agg(F.min("venue_id").alias("venue_id"))
