"""The most similar known name for each asked one, by a positional q-gram index of blocks of known names.

Names are compared by the characters M that matching blocks cover, over both lengths L: the ratio is 2 M / L.  None of
these filters loses a pair whose ratio reaches s, so that M >= s L / 2:

* characters: M is at most the characters in common, and at most the shorter length;
* count: between two blocks a character of either name is unmatched, so there are at most L - 2 M + 1 blocks, and the
  names share at least M - (Q - 1)(L - 2 M + 1) q-grams;
* prefix: of the asked name's q-grams, one more than may be missing must have a hit, so only its rarest are looked up;
* position: a block's place in the two names differs by at most L - 2 M.

The q-gram filters need an s well above the floor.  So there are two rounds: in each block the name that shares most of
the rarest q-grams is compared first; the best of all blocks is the s of the second round.  Asked names that are like
nothing known go by their characters alone there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmatch.functions.names import ratio
from gigmatch.sources.shared import materialise

#: Characters of a q-gram, how many of the rarest name the first candidate, and names of a block and of a part.
Q, RAREST = 3, 4
KNOWN_BLOCK, ASKED_PART = 4000, 2000


def grams(name: str) -> list[str]:
    return [name[i : i + Q] for i in range(len(name) - Q + 1)]


class Index:
    """Known names in the order of their ids, their characters and the places of their q-grams."""

    def __init__(self, names: list[str], ids: list[int]) -> None:
        self.names, self.ids, self.compared = names, ids, 0
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        self.letters = np.zeros((len(names), len(self.alphabet)), np.int32)
        codes: dict[str, int] = {}
        code, owner, place = [], [], []
        for i, name in enumerate(names):
            for c, n in Counter(name).items():
                self.letters[i, self.alphabet[c]] = n
            for at, g in enumerate(grams(name)):
                code.append(codes.setdefault(g, len(codes)))
                owner.append(i)
                place.append(at)
        order = np.argsort(np.array(code, np.int64), kind="stable")
        self.codes, self.owner, self.place = codes, np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.ends = np.cumsum(np.bincount(np.array(code, np.int64), minlength=len(codes)))

    def _posting(self, gram: str) -> slice:
        code = self.codes.get(gram)
        if code is None:
            return slice(0, 0)
        return slice(int(self.ends[code - 1]) if code else 0, int(self.ends[code]))

    def _ratio(self, asked: str, i: int) -> float:
        self.compared += 1
        return ratio(asked, self.names[i])

    def first(self, asked: str) -> tuple[int, float]:
        """The name that shares most of the rarest q-grams, and its ratio; (-1, 0) if none shares any."""
        found = sorted((p.stop - p.start, p.start, p.stop) for p in map(self._posting, set(grams(asked))) if p.stop > p.start)
        if not found:
            return -1, 0.0
        votes = np.bincount(np.concatenate([self.owner[a:b] for _, a, b in found[:RAREST]]), minlength=len(self.names))
        best = int(np.argmax(votes * 1000 - np.minimum(np.abs(self.lengths - len(asked)), 999)))
        return best, self._ratio(asked, best)

    def _candidates(self, asked: str, least: float) -> np.ndarray:
        """Names that may reach ``least``, by length, prefix and position."""
        n = len(asked)
        allowed = np.minimum(self.lengths, n) * 2 >= least * (self.lengths + n) - 1e-9
        if not allowed.any():
            return np.flatnonzero(allowed)
        shared = self._shared(n, int(self.lengths[allowed].min()), least)
        mine = grams(asked)
        if shared < 1:
            return np.flatnonzero(allowed)
        if shared > len(mine):
            return np.zeros(0, np.int64)
        shift = int((n + int(self.lengths[allowed].max())) * (1 - least) + 1e-9)
        found = sorted(((p.stop - p.start, at, p) for at, p in ((at, self._posting(g)) for at, g in enumerate(mine))), key=lambda x: x[:2])
        hits = [self.owner[p][np.abs(self.place[p] - at) <= shift] for _, at, p in found[: len(mine) - shared + 1]]
        some = np.unique(np.concatenate(hits))
        return some[allowed[some]]

    @staticmethod
    def _shared(n: int, m: int, least: float) -> int:
        """Fewest q-grams in common of names of these lengths; not less for a longer name once it is 1 or more."""
        both = n + m
        matched = int(np.ceil(least * both / 2 - 1e-9))
        return matched - (Q - 1) * (both - 2 * matched + 1)

    def better(self, asked: str, least: float, score: float, best_id: int) -> tuple[int, float]:
        """The name above ``score``, or equal to it with a lower id than ``best_id``, of greatest ratio; (-1, 0) if none is.

        ``least``: no ratio below it counts.
        """
        bar = max(least, score)
        at = self._candidates(asked, bar)
        if not len(at):
            return -1, 0.0
        mine = np.zeros(len(self.alphabet), np.int32)
        for c, n in Counter(asked).items():
            if c in self.alphabet:
                mine[self.alphabet[c]] = n
        bound = 2 * np.minimum(self.letters[at], mine).sum(1) / (self.lengths[at] + len(asked))
        own, best = Counter(grams(asked)), -1
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] < bar:
                break
            i = int(at[j])
            if bound[j] == bar and score >= bar and self.ids[i] >= best_id:
                continue
            if (own & Counter(grams(self.names[i]))).total() < self._shared(len(asked), int(self.lengths[i]), bar):
                continue
            value = self._ratio(asked, i)
            if value >= least and (value > score or (value == score and self.ids[i] < best_id)):
                best, score, best_id = i, value, self.ids[i]
                bar = max(least, score)
        return (best, score) if best >= 0 else (-1, 0.0)


_PAIR = "norm string, known string, artist_id long, score double, compared long"


def _rows(index: Index, found: list[tuple[str, int, float]]) -> pd.DataFrame:
    """One row per find, and one without a name for the comparisons of the block."""
    rows = [(n, index.names[i], index.ids[i], s, 0) for n, i, s in found if i >= 0]
    rows.append((None, None, 0, 0.0, index.compared))
    frame = pd.DataFrame(rows, columns=["norm", "known", "artist_id", "score", "compared"])
    return frame.astype({"artist_id": "int64", "score": "float64", "compared": "int64"})


def _indexed(there: pd.DataFrame) -> Index:
    there = there.sort_values("artist_id")
    return Index(there["known"].tolist(), there["artist_id"].tolist())


def _first(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
    index = _indexed(there)
    return _rows(index, [(n, *index.first(n)) for n in asked["norm"]] if len(there) else [])


def _second(floor: float):
    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        index = _indexed(there)
        rows = zip(asked["norm"], asked["score"], asked["artist_id"])
        return _rows(index, [(n, *index.better(n, floor, s, i)) for n, s, i in rows] if len(there) else [])

    return run


def most_similar(forms: DataFrame, known: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(norm, known, score) of the known name of greatest ratio for each of ``forms`` (norm), none below ``floor``, and a
    row with how many pairs were ``compared``.

    ``known``: known, artist_id; of equal ratios the lowest id counts.  Both sides are dealt by a hash; each block of
    known names meets each part of the asked ones in a task of its own.
    """
    forms, known = materialise(forms, "fuzzy-forms"), materialise(known, "fuzzy-names")
    blocks, parts = (max(-(-t.count() // n), 1) for t, n in ((known, KNOWN_BLOCK), (forms, ASKED_PART)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    keys = ["block", "part"]

    def met(asked: DataFrame, compare) -> DataFrame:
        left = asked.select("*", own("norm", parts).alias("part"), every(blocks).alias("block"))
        right = known.select("known", "artist_id", own("known", blocks).alias("block"), every(parts).alias("part"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, _PAIR)

    one = F.max_by(F.struct("known", "artist_id", "score"), F.struct(F.col("score"), -F.col("artist_id"))).alias("b")
    first = materialise(met(forms, _first), "fuzzy-first")
    seeds = first.filter("norm is not null").groupBy(F.col("norm").alias("n")).agg(one)
    started = forms.join(seeds, F.col("norm") == F.col("n"), "left").select("norm", "b.known", F.coalesce("b.artist_id", F.lit(0)).alias("artist_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
    started = materialise(started, "fuzzy-started")
    second = materialise(met(started.select("norm", "artist_id", "score"), _second(floor)), "fuzzy-second")
    both = second.filter("norm is not null").select("norm", "known", "artist_id", "score").unionByName(started.filter(F.col("known").isNotNull() & (F.col("score") >= floor)))
    best = both.groupBy("norm").agg(one).select("norm", "b.known", "b.score")
    counts = first.select("compared").unionByName(second.select("compared"))
    return best, counts.agg(F.sum("compared").alias("compared"))
