import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gigmatch.llm import phrases


def pieces_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least, first=2000, longest=5):
    """Rows as the query returns them, by counting all n-grams in dictionaries."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        there = {p: c for p, c in f[lang].items() if len(p) > 1 and c >= least}
        found = []
        for p, a in there.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and c >= a and inside(q) for q, c in there.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((score, a, " ".join(p), f[lang][p[:k]], f[lang][p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(found[:first], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_index_enumerates_all_ngrams_with_counts(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 6, 400)
    if seed == 3:
        ids[100:220] = 2  # ties longer than the order's depth
    index = phrases.Index(ids, 5)
    expected = lambda m: Counter(tuple(ids[i : i + m]) for i in range(len(ids) - m + 1) if (ids[i : i + m] > 0).all())
    found = index.words()
    for m, side in ((2, 0), (3, 1), (4, 0), (5, 1)):
        found = index.extend(*found, side, None)
        assert dict(zip(map(tuple, found[0].tolist()), found[2].tolist())) == expected(m)


def test_only_allowed_pairs():
    ids = np.array([1, 2, 3, 0, 1, 2, 2, 3, 1])
    index = phrases.Index(ids, 3)
    allowed = np.array([1 << 32 | 2, 2 << 32 | 3])
    two = index.extend(*index.words(), 0, allowed)
    assert sorted(map(tuple, two[0].tolist())) == [(1, 2), (2, 3)]
    three = index.extend(*two, 1, allowed)
    assert three[0].tolist() == [[1, 2, 3]] and three[2].tolist() == [1]
    assert not len(index.extend(*index.words(), 0, np.zeros(0, np.int64))[2])


def test_packing_of_ids():
    ids = np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert (phrases.unpacked(phrases.packed(ids)) == ids).all()


@pytest.mark.parametrize("size, tables", [(40, (1 << 18, 1 << 20)), (1 << 20, (1 << 18, 1 << 20)), (40, (1 << 18, 0)), (40, (0, 0))])
def test_by_brute_force(spark, size, tables):
    rng = np.random.default_rng(5)
    names = [*"abcdefgh", "É", "Ü|x"]
    rows = []
    for i in range(60):
        words = [names[min(int(x), 9)] for x in rng.exponential(2.5, 60)]
        text = " ".join(w + rng.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for w in words)
        rows.append((["en", "de", None][i % 3], text + (" the same passage here again" if i % 2 else "")))
    rows += [("fr", None), (None, ""), ("one", "one"), ("en", ". , ;")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for first in (2000, 5):
        assert collected(phrases.collocations(df, least=6, first=first, size=size, table_words=tables[0], table_pairs=tables[1])) == brute(rows, 6, first)


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert collected(phrases.collocations(odd, least=3)) == brute(rows, 3)
    assert phrases.collocations(none).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 7 * 10**18, 3)], "a long, n long, l long, r long")
    from pyspark.sql import functions as F

    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (wide("a") * F.lit(10**6).cast("decimal(19,0)")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    got = df.select(phrases._whole(top, wide("l") * wide("r")).alias("x")).first().x
    assert got == 9 * 10**18 * 10**6 * 1000 // (7 * 10**18 * 3)


def test_query_and_sql(spark, sf1):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf1}/documents.parquet").collect()]
    got = collected(phrases.op12_fm_index_phrases(spark, sf1))
    assert got == brute(docs, 100)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf1}/documents.parquet'")
    assert sorted(con.execute(phrases.SQL).fetchall()) == got
