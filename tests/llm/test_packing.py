import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gigmatch.llm import packing


def check(rows, capacity):
    """Sequences are full without gaps or overlaps and within the capacity; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark, sf1):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.op10_pattern_packing(spark, sf1).collect()
    n = check(rows, 4096)
    assert n <= math.ceil(sum(r.length for r in rows) / 4096) + 2
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    docs = spark.read.parquet(f"{sf1}/documents.parquet").collect()
    assert set(by) == {d.doc_id for d in docs}
    for d in docs[::25]:
        ids = np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(math.ceil(len(ids) / 4096)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length == min(4096, len(ids) - r.start) and zlib.crc32(part.tobytes()) == r.ids_crc32


def test_odd_rows(odd, none):
    rows = packing.pack_documents(odd, capacity=64).collect()
    check(rows, 64)
    assert sum(r.doc_id is None for r in rows) >= 2 and sum(r.doc_id == 2 and r.piece == 0 for r in rows) == 2
    assert [(r.length, r.start) for r in rows if r.doc_id == 3] == [(1, 0)]
    assert sum(r.length for r in rows if r.doc_id == 6) == 30_000 * 4 + 1
    assert packing.pack_documents(none).count() == 0


def test_ids_round_trip(odd):
    whole = packing.token_pieces(odd.filter("doc_id = 9"), capacity=4, ids=True).orderBy("piece").collect()
    ids = [i for r in whole for i in r.ids]
    assert ids[-1] == 1 and len(ids) == sum(r.length for r in whole)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 300))
    counts = rng.integers(0, 1 + 10 ** int(rng.integers(1, 5)), capacity + 1) * (rng.random(capacity + 1) < 0.5)
    counts[0] = 0
    used = np.zeros_like(counts)
    for held, repeats in packing.plan(counts):
        assert sum(k * v for k, v in held.items()) <= capacity
        for length, each in held.items():
            used[length] += each * repeats
    assert (used == counts).all()
    total = sum(r for _, r in packing.plan(counts))
    assert total <= sum(r for _, r in packing.best_fit(counts, capacity)) * 1.02 + 2


def test_fit_finds_exact_patterns():
    counts = np.zeros(101, np.int64)
    counts[60], counts[40], counts[50] = 30, 30, 10
    patterns = packing.candidate_patterns(counts)
    assert {(60, 40, 0, 0), (50, 50, 0, 0)} <= set(map(tuple, patterns.tolist()))
    x = dict(zip(map(tuple, patterns.tolist()), packing.fit_repeats(patterns, counts.astype(float))))
    assert x[(60, 40, 0, 0)] == pytest.approx(30, abs=0.5) and x[(50, 50, 0, 0)] == pytest.approx(5, abs=0.5)


def test_equal_lengths_over_many_partitions(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(30).cast("long").alias("length"))
    rows = packing.pack(pieces, 100).collect()
    assert check(rows, 100) == math.ceil(5000 / 3)


def test_new_plain_words_cost_less_than_the_whole_tokenizer():
    import time

    coder = packing.Encoder(packing.default_vocabulary())
    letters = "etaoinshrdlucmfwypvbgkqjxz\u00e9\u00fc"
    found = list(dict.fromkeys("".join(letters[(i * 7 + k * (i % 89 + 1)) % 28] for k in range(4 + i % 9)) + letters[i // 28 % 28] + letters[i // 784 % 28] for i in range(20_000)))
    text, times = " ".join(found), {"words": [], "whole": []}
    for _ in range(3):
        coder._forget()
        start = time.process_time()
        got = coder.encode([text])[0].tolist()
        times["words"].append(time.process_time() - start)
        start = time.process_time()
        whole = [i for k in range(0, len(found), 4096) for i in coder.tokenizer.encode(" ".join(found[k : k + 4096]), add_special_tokens=False).ids]
        times["whole"].append(time.process_time() - start)
        assert got == whole
    assert min(times["words"]) < 0.85 * min(times["whole"]), times
