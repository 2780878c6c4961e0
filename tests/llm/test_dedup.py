import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gigmatch.llm import common, exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[norm(text)]
        known = [i for i in ids if i is not None]
        out.append((doc_id, min(known, default=None), len(ids), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.crc32(n) % 3])
@pytest.mark.parametrize("files, few", [(1, 1000), (1000, 0)])
def test_odd_rows(odd, digest, files, few, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    got = exact_dedup.exact_dedup(odd.repartition(3), digest, files).collect()
    want, groups = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first(odd, none):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    _, groups = brute([(r.doc_id, r.text) for r in odd.collect()])
    rows = kept.collect()
    assert len(rows) == groups and sorted(r.doc_id for r in rows if r.doc_id in (1, 2, 3, 4, 5, 8)) == [1, 3, 5]
    assert exact_dedup.keep_first(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (0, "b"), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, exact_dedup.keep_first(df).collect()))
    assert kept == [(0, "b"), (1, "a"), (3, "c")]


def test_documents(spark, sf1):
    docs = spark.read.parquet(f"{sf1}/documents.parquet")
    got = exact_dedup.op7_streaming_exact_dedup(spark, sf1).collect()
    want, groups = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.crc32(n) % 3])
def test_two_runs_on_one_state_equal_one_run_over_both(spark, tmp_path, digest):
    """The second run's files hold copies of the first one's texts, some under smaller ids."""
    first = [(i, f"text  {i % 7}") for i in range(10, 40)] + [(None, "none"), (4, None)]
    second = [(i, f"text {i % 9}") for i in range(0, 20)] + [(99, "none"), (3, ""), (5, "new")]
    place = lambda name, rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    a, b, state = place("first files", first), place("second", second), f"file://{tmp_path}/state"
    before = exact_dedup.dedup_files(spark, [a], state, digest).collect()
    want, groups = brute(first)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in before), key=str) == want and sum(r.kept for r in before) == groups
    want, groups = brute(first + second)
    for paths in ([b], [a, b]):  # a run that is repeated changes nothing
        after = exact_dedup.dedup_files(spark, paths, state, digest).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in after), key=str) == want
        assert sum(r.kept for r in after) == groups and len({(r.path, r.place) for r in after}) == len(after)


def test_only_files_with_hits_are_read_again(spark, tmp_path, monkeypatch):
    for name, rows in (("a", [(1, "x"), (2, "y")]), ("b", [(3, "x"), (4, "z")]), ("c", [(5, "v"), (6, "w")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
    read = []
    real = exact_dedup.only_rows
    monkeypatch.setattr(exact_dedup, "only_rows", lambda rows, *a: read.append(sorted(f.split("/")[-2] for f in rows.inputFiles() if f"{tmp_path}/" in f and "state" not in f)) or real(rows, *a))
    exact_dedup.dedup_files(spark, [str(tmp_path / x) for x in "abc"], f"file://{tmp_path}/state").collect()
    assert read == [["a", "b"]]


def test_the_session_stays_as_it_was(spark, odd):
    before = spark.conf.getAll
    exact_dedup.exact_dedup(odd).count()
    assert {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}
