import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gigmatch.llm import hilbert


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (3, 3)])
def test_curve_is_continuous(spark, dims, bits):
    names = [f"d{i}" for i in range(dims)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{n} int" for n in names))
    rows = cells.select(*names, hilbert.hilbert_index([F.col(n) for n in names], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (dims * bits)))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_documents(spark, sf1):
    rows = hilbert.op5_hilbert_sharding(spark, sf1).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf1}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)


def test_odd_rows(odd, none, tmp_path):
    dims = {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")}
    got = hilbert.hilbert_shards(odd, dims, [F.col("doc_id")], shards=40)
    rows = got.collect()
    assert got.columns == [*(c for c in odd.columns if c != "shard"), "hilbert", "shard", "slot"]
    assert len(rows) == odd.count() and max(Counter(r.shard for r in rows).values()) == 1
    assert hilbert.hilbert_shards(none, dims, [F.col("doc_id")]).count() == 0
    three = hilbert.hilbert_shards(odd, dims, [F.col("doc_id")], shards=3)
    manifest = hilbert.write_shards(three, str(tmp_path / "out"), ["n_chars"])
    assert sum(r.rows for r in manifest.collect()) == odd.count() and manifest.count() == 3


def test_shards_prune_every_dimension(spark):
    rows = spark.range(4096).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    got = hilbert.hilbert_shards(rows, {"a": F.col("a"), "b": F.col("b")}, [F.col("a")], shards=64)
    width = got.groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")).agg(F.avg("a"), F.avg("b")).first()
    assert max(width) < 24  # a sort by one column alone leaves the other at 63


def test_strings_that_begin_alike_get_cells_of_their_own(spark):
    rows = spark.range(800).select(F.concat(F.lit("https://site"), F.col("id") % 8).alias("s"))
    cells = hilbert.quantise(rows, {"s": F.col("s")}, 5).select("s", "_cell_s").distinct().collect()
    assert len(cells) == len({r._cell_s for r in cells}) == 8
    order = [r._cell_s for r in sorted(cells, key=lambda r: r.s)]
    assert order == sorted(order) and order[-1] == 31


def test_many_strings_share_cells_evenly(spark):
    often = spark.range(3000).select(F.lit("https://site0500").alias("s"))
    rows = often.unionByName(spark.range(6000).select(F.format_string("https://site%04d", F.col("id") % 1000).alias("s")))
    cells = hilbert.quantise(rows, {"s": F.col("s")}, 4).select("s", F.col("_cell_s").alias("c")).collect()
    by = Counter(r.c for r in cells)
    assert len({r.c for r in cells if r.s == "https://site0500"}) == 1
    assert len(by) >= 9 and sorted(by.values())[-2] <= 9000 / 15 * 1.6
    values = sorted({(r.s, r.c) for r in cells})
    assert [c for _, c in values] == sorted(c for _, c in values)
