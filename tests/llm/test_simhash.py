import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from gigmatch.llm import simhash
from gigmatch.llm.components import components


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(prints):
    """Smallest place reachable over links of at most 4 bits, by comparing all pairs."""
    prints, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_documents(spark, sf1):
    rows = sorted(simhash.op6_golay_simhash(spark, sf1).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{sf1}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert [r.fingerprint for r in rows[::20]] == [f"{brute_print(d.text):016x}" for d in docs[::20]]
    assert [r.component_id for r in rows] == [docs[i].doc_id for i in roots([int(r.fingerprint, 16) for r in rows])]


def test_codewords_survive_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    for errors in (1, 2):
        noisy = words.copy()
        for i in range(len(noisy)):
            for b in rng.choice(23, errors, replace=False):
                noisy[i] ^= 1 << int(b)
        assert all(set(a) & set(b) for a, b in zip(simhash.golay_keys(words), simhash.golay_keys(noisy)))


@pytest.mark.parametrize("errors", [0, 1, 2, 3, 4])
def test_every_link_shares_a_key(errors):
    rng = np.random.default_rng(errors)
    prints = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    noisy = prints.copy()
    for i in range(len(noisy)):
        for b in rng.choice(64, errors, replace=False):
            noisy[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (set(zip(k.tolist(), o.tolist())) for k, o in map(simhash.join_keys, (prints, noisy)))
    assert {o for _, o in a & b} == set(range(4000))


@pytest.mark.parametrize("block", [3, 2048])
def test_clusters_and_long_runs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    prints = []
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(25):
            p = int(centre)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    mine = [found.get(p - (1 << 64) if p >> 63 else p, p) for p in prints]
    want = roots(prints)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got[3] == got[4] == got[5] == ("0" * 16, 3)
    assert got[1][1] == got[2][1] == got[8][1] == 1 and got[None][1] in (1, 3)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def wide_sets(texts):
    words = [t.lower().split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]


@pytest.mark.parametrize("block", [4, 1024])
def test_similar_texts_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "TEXTS", block)
    rng = np.random.default_rng(3)
    texts = []
    for size in (40, 120, 400, 1600):
        for _ in range(4):
            base = [f"w{int(x)}" for x in rng.integers(0, 5000, size)]
            texts.append(" ".join(base))
            for _ in range(5):
                words = list(base)
                for at in rng.choice(size, int(rng.integers(1, max(size // 25, 2))), replace=False):
                    words[int(at)] = f"z{int(rng.integers(0, 10**9))}"
                texts.append(" ".join(words))
    sets, parent = wide_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    missed = 0
    for i, mine in enumerate(sets):
        for j in range(i):
            near = int(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() <= 4
            alike = len(mine & sets[j]) / len(mine | sets[j]) >= 0.8
            missed += alike and not near
            if alike or near:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert missed > 10  # pairs that the fingerprints' radius leaves out
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(got.values()))


def test_rows_without_an_id_or_with_the_same_one(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(50))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (7, text(4)), (None, text(5)), (9, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in simhash.keep_one(docs).collect()}
    assert kept == {(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (9, text(5))}
