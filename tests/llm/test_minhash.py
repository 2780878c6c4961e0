import re

import duckdb
import numpy as np
import pytest

from gigmatch.llm import minhash
from gigmatch.llm.minhash import minhash_duplicates


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[top(i)] = min(doc_id, lowest.get(top(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = lowest.get(top(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def near_copies(seed, groups, copies, length):
    """Texts at and around the threshold: chains of edits, so that some meet only through others."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 400, length)]
        for _ in range(copies):
            for _ in range(int(rng.integers(0, max(length // 15, 2)))):
                base = list(base)
                base[int(rng.integers(0, length))] = f"w{rng.integers(0, 400)}"
            rows.append((at, " ".join(base)))
            at += 1
    return rows


def test_every_coordinate_fills_and_agreement_is_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 5000):
        shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a = np.concatenate([shared, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])
        b = np.concatenate([shared, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])
        first, second, both = minhash.sketches([a]), minhash.sketches([b]), minhash.sketches([a, b])
        assert (first < np.iinfo(np.uint64).max).all() and (both == np.concatenate([first, second])).all()
        similarity = n / (n + 2 * (n // 4))
        assert abs((first == second).mean() - similarity) < 0.15


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies(1, 8, 12, 60) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(2, 6, 10, 9))]
    rows += [(2000, "one"), (2001, "ONE"), (2002, "one two"), (2003, "two one"), (2004, "a a a a"), (2005, "a\ta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(minhash_duplicates(df)) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert collected(minhash_duplicates(odd)) == brute(rows)
    assert minhash_duplicates(none).count() == 0


def test_query_and_sql(spark, sf1):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf1}/documents.parquet").collect()]
    got = collected(minhash.op13_fast_sketch_minhash(spark, sf1))
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf1}/documents.parquet'")
    assert sorted(con.execute(minhash.SQL).fetchall(), key=str) == got
