"""The q-gram index against all pairs, and how many pairs it compares."""

import random

import pytest

from gigmatch.functions.names import ratio
from gigmatch.operators import fuzzy, resolution
from gigmatch.plans import catalogue, views


def brute(asked, known, floor):
    """(asked, known, ratio): greatest ratio, then lowest id; ``known``: {name: id}."""
    out = []
    for a in asked:
        score, _, name = max((ratio(a, k), -i, k) for k, i in known.items())
        if score >= floor:
            out.append((a, name, score))
    return sorted(out)


def word(rng, letters, longest):
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).strip() or "a"


def changed(rng, name, letters):
    name = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(name) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            name.insert(at, rng.choice(letters))
        elif name:
            at = min(at, len(name) - 1)
            if kind == 1:
                name[at] = rng.choice(letters)
            else:
                del name[at]
    return "".join(name) or "a"


@pytest.mark.parametrize("letters, longest", [("ab ", 9), ("abcdefgh ", 14), ("abcdefghijklmnopqrstuvwxyz0123 ", 40)])
def test_index_never_changes_the_winner(letters, longest):
    rng = random.Random(longest)
    known = {k: i for i, k in enumerate(dict.fromkeys(word(rng, letters, longest) for _ in range(150)))}
    index = fuzzy.Index(list(known), list(known.values()))
    asked = [word(rng, letters, longest) for _ in range(80)] + [changed(rng, rng.choice(list(known)), letters) for _ in range(120)]
    for a in asked:
        (best, score), want = index.better(a, 0.55, 0.0, 0), brute([a], known, 0.55)
        assert ([(a, index.names[best], score)] if best >= 0 else []) == want
        first, value = index.first(a)
        if first >= 0:
            best, score = index.better(a, 0.55, value, known[index.names[first]])
            found = (a, index.names[best], score) if best >= 0 else (a, index.names[first], value)
            assert ([found] if found[2] >= 0.55 else []) == want


@pytest.mark.parametrize("block, part", [(7, 11), (4000, 2000)])
def test_blocks_equal_all_pairs(spark, monkeypatch, block, part):
    monkeypatch.setattr(fuzzy, "KNOWN_BLOCK", block)
    monkeypatch.setattr(fuzzy, "ASKED_PART", part)
    rng = random.Random(6)
    known = {k: i for i, k in enumerate(dict.fromkeys(word(rng, "abcde ", 12) for _ in range(60)))}
    asked = list(dict.fromkeys(changed(rng, rng.choice(list(known)), "abcdefg ") for _ in range(40)))
    forms, names = spark.createDataFrame([(a,) for a in asked], "norm string"), spark.createDataFrame(list(known.items()), "known string, artist_id long")
    got, _ = fuzzy.most_similar(forms, names, 0.55)
    assert sorted(map(tuple, got.collect())) == brute(asked, known, 0.55)
    assert fuzzy.most_similar(forms.limit(0), names, 0.55)[0].count() == 0
    assert fuzzy.most_similar(forms, names.limit(0), 0.55)[0].count() == 0


def test_query_compares_few_pairs_and_equals_all(spark):
    sf = "/root/testdata/sf0.001"
    asked = {r.norm for r in catalogue.dirty(spark, sf).select(catalogue.names.normalize_name(catalogue.F.col("name")).alias("norm")).collect()} - {""}
    known = {}
    for r in views.artists(spark, sf).select("artist_id", catalogue.names.normalize_name(catalogue.F.col("raw_name")).alias("k")).orderBy("artist_id").collect():
        known.setdefault(r.k, r.artist_id)
    got = resolution.resolve_fuzzy(catalogue.dirty(spark, sf), views.artists(spark, sf))
    want = {a: (known[k], round(s, 6)) for a, k, s in brute(sorted(asked), known, 0.55)}
    named = got.select(catalogue.names.normalize_name(catalogue.F.col("name")).alias("norm"), "artist_id", "confidence").distinct().collect()
    assert {r.norm: (r.artist_id, r.confidence) for r in named} == want
    forms, names = spark.createDataFrame([(a,) for a in sorted(asked)], "norm string"), spark.createDataFrame(list(known.items()), "known string, artist_id long")
    compared = fuzzy.most_similar(forms, names, 0.55)[1].first().compared
    print(compared, len(asked) * len(known))
    assert compared < 0.01 * len(asked) * len(known)
