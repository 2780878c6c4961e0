import zlib

import numpy as np
import pytest

from gigmatch.llm import language


def test_held_out_accuracy(spark, sf1):
    got = language.op4_bloom_language_id(spark, sf1).toPandas()
    docs = spark.read.parquet(f"{sf1}/documents.parquet").toPandas().merge(got, on="doc_id")
    assert len(docs) == len(got)
    assert (docs.held_out == docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (docs[docs.held_out].lang == docs[docs.held_out].lang_pred).mean() > 0.97
    assert docs.score.between(0, 1).all()


def test_odd_rows(odd, none):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert [got[i] for i in (3, 4, 5, 10)] == [("und", 0.0)] * 4
    assert got[1][0] == "en" and len(language.identify(odd).collect()) == odd.count()
    assert language.identify(none).count() == 0
    untold = language.predict(odd, language.build_filters({})).collect()
    assert {r.lang_pred for r in untold} == {"und"}


def test_filters_contain_what_was_entered():
    rng = np.random.default_rng(4)
    entries = {f"l{k:02d}": rng.integers(0, 1 << 63, 300, dtype=np.uint64) for k in range(11)}
    filters = language.build_filters(entries)
    assert filters.masks.shape[1] == 2
    for k, name in enumerate(filters.languages):
        held = np.full(300, 255, np.uint8)
        for at in filters.slots(entries[name]):
            held &= filters.masks[at, k // 8]
        assert ((held >> (k % 8)) & 1).all()
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    held = np.full(20_000, 255, np.uint8)
    for at in filters.slots(other):
        held &= filters.masks[at, 0]
    assert (held & 1).mean() == pytest.approx(filters.chance[0], abs=0.003)


def test_grams_belong_to_their_text():
    one, two = language.grams(["abc de"])[0], language.grams(["xyz", "abc de"])
    assert sorted(one) == sorted(two[0][two[1] == 1])
    assert len(language.grams(["", "12"])[0]) == 0
