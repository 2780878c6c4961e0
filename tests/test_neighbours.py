"""The top-k similarity join against all pairs, and how many pairs it compares."""

import math
from collections import defaultdict

import numpy as np
import pytest

from gigmatch.operators import history, neighbours


def brute(rows, k, targets=None, include_self=False):
    vectors = defaultdict(dict)
    for key, tag, w in rows:
        vectors[key][tag] = w
    norm = {x: math.sqrt(sum(w * w for w in v.values())) for x, v in vectors.items()}
    out = []
    for x in vectors if targets is None else targets:
        found = []
        for y in vectors:
            if norm.get(x) and norm[y] and (include_self or x != y):
                s = round(sum(w * vectors[y].get(t, 0) for t, w in vectors[x].items()) / (norm[x] * norm[y]), 6)
                if s > 0:
                    found.append((-s, y))
        out += [(x, y, -s, i) for i, (s, y) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def make(seed, n, tags, each, zipf=1.3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for t in set((rng.zipf(zipf, each) % tags).tolist()):
            rows.append((f"k{i:05d}", f"t{t}", float(rng.integers(1, 5) * 10)))
    return rows


SCHEMA = "key string, tag string, weight double"


@pytest.mark.parametrize("seed, n, tags, each, small, block", [(1, 120, 30, 4, 10, 7), (2, 150, 8, 2, 3, 16), (3, 90, 40, 6, 1000, 8), (4, 150, 3, 1, 0, 5)])
def test_equal_to_all_pairs(spark, seed, n, tags, each, small, block):
    rows = make(seed, n, tags, each)
    got, _ = neighbours.neighbour_search(spark.createDataFrame(rows, SCHEMA), 5, small=small, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_targets_self_and_odd_vectors(spark):
    rows = make(5, 60, 6, 2) + [("zero", "t1", 0.0), ("alone", "own", 3.0), ("minus", "t0", -4.0), ("minus", "t1", 2.0)]
    odd = rows + [(None, "t0", 1.0)]
    df = spark.createDataFrame(odd, SCHEMA)
    wanted = spark.createDataFrame([("k00001",), ("zero",), ("alone",), ("nobody",), ("minus",)], "key string")
    for include_self in (False, True):
        got, _ = neighbours.neighbour_search(df, 4, wanted, include_self, small=5, block=8)
        assert sorted(map(tuple, got.collect())) == brute(rows, 4, ["k00001", "zero", "alone", "minus"], include_self)
    assert neighbours.neighbour_search(df.limit(0), 4)[0].count() == 0
    assert sorted(map(tuple, history.nearest_neighbors(df, 3).collect())) == brute(rows, 3)


@pytest.mark.parametrize("others", [0, 1])
def test_one_tag_on_100_000_keys(spark, others):
    """All keys share one tag: alone, or beside two tags of some forty keys each."""
    n, rng = 100_000, np.random.default_rng(7)
    rows = [(f"k{i:06d}", "rock", float(w)) for i, w in enumerate(rng.integers(1, 100, n))]
    if others:
        rows += [(f"k{i:06d}", f"own{t}", float(rng.integers(1, 100))) for i in range(n) for t in set(rng.integers(0, 5000, 2).tolist())]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "tag", "weight"]), SCHEMA).repartition(8)
    got, compared = neighbours.neighbour_search(df, 10)
    rows_found, pairs = got.count(), {r.step: r.pairs for r in compared.collect()}
    print(pairs)
    assert rows_found == 10 * n and sum(pairs.values()) < 0.05 * n * n
    if not others:
        first = [r.neighbor for r in got.filter("key = 'k000500'").orderBy("rank").collect()]
        assert first == [f"k{i:06d}" for i in range(10)]
