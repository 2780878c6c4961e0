"""Near-duplicate documents: MinHash by fast similarity sketching, banding and exact verification.

A set's sketch has SIZE coordinates and is filled in rounds.  In each of the first SIZE rounds every element is thrown
into one bin by a hash of that round; in each of SIZE more rounds all elements meet one bin, in order.  A bin keeps its
smallest value, a round's number before a hash, so earlier rounds win, and a set stops after the round that fills its
last bin: SIZE log SIZE elements are thrown about, or all of them once, and no bin can stay empty.  Two sets agree in a
coordinate with the probability of their Jaccard similarity, and their agreement is as concentrated as if coordinates
were drawn without replacement.

Sets that agree in all coordinates of a band are candidates; links are confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import bounded, documents, materialise, narrow, only_rows, slices, with_rows
from gigmatch.llm.components import components
from gigmatch.llm.workers import lean

#: Words per shingle, and the least similarity of linked sets, in percent.
SHINGLE, PERCENT = 2, 80
#: Bands and coordinates in each: two sets of similarity 0.8 share no band with probability 2e-7.
BANDS, BAND = 40, 5
SIZE = BANDS * BAND
#: Sets of one band that a task compares at once; longer ones are compared in pairs of blocks.
BLOCK = 1024
#: Characters of texts whose shingles are held at once.
CHARACTERS = 500_000

_rng = np.random.default_rng(13)
_ROUND = _rng.integers(0, 1 << 63, 2 * SIZE, dtype=np.uint64)
_WEIGHT = _rng.integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str) -> np.ndarray:
    """128-bit hashes of a text's distinct 2-word shingles as rows of two numbers, sorted; all its words if it has
    fewer, none if it has none.  Only A-Z are lowered and only ASCII white space parts words."""
    from xxhash import xxh3_128_digest

    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros((0, 2), np.uint64)
    pairs = {a + b" " + b for a, b in zip(found, found[1:])} or {found[0]}
    rows = np.frombuffer(b"".join(map(xxh3_128_digest, pairs)), np.uint64).reshape(-1, 2)
    return rows[np.argsort(rows[:, 0])]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SIZE coordinates for each of ``sets`` (distinct numbers, none empty)."""
    n = len(sets)
    out = np.full(n * SIZE, np.iinfo(np.uint64).max, np.uint64)
    if not n:
        return out.reshape(0, SIZE)
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    for number in range(2 * SIZE):
        h = _mixed(items ^ _ROUND[number])
        if number < SIZE:
            bins = ((h >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        else:
            bins = number - SIZE
        np.minimum.at(out, owner * SIZE + bins, np.uint64(number) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
        empty = (out.reshape(n, SIZE) == np.iinfo(np.uint64).max).any(1)
        if not empty.any():
            break
        on = empty[owner]
        if not on.all():
            items, owner = items[on], owner[on]
    return out.reshape(n, SIZE)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key per row and band of its coordinates."""
    mixed = _mixed(sketch).reshape(-1, BANDS, BAND)
    return _mixed((mixed * _WEIGHT).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def add_sketches(rows: DataFrame) -> DataFrame:
    """doc_id, size and digest of the shingle set (null if empty), band keys and _row for every row of ``rows`` (of ``with_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts], CHARACTERS):
                sets = [shingle_set(t) for t in texts[a:b]]
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(sketches([s[:, 0] for s in some])).tolist())
                ids, at = (batch.column(c).slice(a, b - a) for c in ("doc_id", "_row"))
                columns = [
                    ids, at, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", "size", "digest", "keys"])

    read = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "_row")
    return read.mapInArrow(lean(run), "doc_id long, _row long, size long, digest binary, keys array<long>")


def _near(mine: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of ``sets`` link with ``mine``, in whole numbers (all sorted, distinct, not empty)."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= PERCENT * (len(mine) + sizes - both)


def _near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (x, hub, mine, there) whose two sets link, as (x, hub)."""
    for batch in batches:
        hubs = batch.column("hub").to_numpy()
        mine, there = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("mine", "there"))
        good = np.zeros(len(hubs), bool)
        order = np.argsort(hubs, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
            if len(rows):
                good[rows] = _near(there[rows[0]], [mine[i] for i in rows])
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("x", "hub")], ["x", "hub"])


def _across(left: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of one band that nothing connects yet (cls, root, set), as (u, v); enough to connect them."""
    out = []
    if len(left) and len(whole):
        classes, sets = whole["cls"].to_numpy(np.int64), [np.frombuffer(v, np.uint64) for v in whole["set"]]
        roots = whole["root"].to_numpy(np.int64)
        parent = {r: r for r in [*roots.tolist(), *left["root"].tolist()]}

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        for x, r, v in zip(left["cls"].tolist(), left["root"].tolist(), left["set"]):
            other = np.flatnonzero(roots != r)
            if not len(other):
                continue
            good = _near(np.frombuffer(v, np.uint64), [sets[i] for i in other])
            for i in other[good].tolist():
                a, b = top(r), top(int(roots[i]))
                if a != b:
                    parent[a] = b
                    out.append((x, int(classes[i])))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def set_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): pairs of ``classes`` (cls: the _row of one text, keys: its bands) whose sets link, enough to connect all.

    A band's sets are compared with its smallest one, the hub, so that a large group of near copies costs one
    comparison a copy.  What that leaves unconnected to the hub is then compared with all of its band, in pairs of
    blocks, wherever the two aren't connected yet: no pair that shares a band stays undecided.  Bands of the same sets
    count once.  Texts are read where they lie, one row of each class.
    """
    banded = classes.select("cls", F.explode("keys").alias("key"))
    mixed = F.xxhash64("cls")
    marks = [F.count(F.lit(1)).alias("n"), F.sum(mixed.bitwiseAND(F.lit((1 << 31) - 1))).alias("total"), F.bit_xor(mixed).alias("odd")]
    groups = banded.groupBy("key").agg(*marks, F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
    once = groups.groupBy("n", "total", "odd", "low", "high").agg(F.min("key").alias("band"))
    once = materialise(once.select("band", "n", F.col("low").alias("hub")), "minhash-bands")
    members = banded.join(bounded(once), F.col("key") == F.col("band")).select("band", "n", "hub", "cls")
    members = materialise(members, "minhash-members")

    wanted = members.select(F.col("cls").alias("_row")).distinct()
    texts = only_rows(narrow(rows, "text"), wanted, "minhash-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(shingle_set(t)[:, 0]).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.binary())], ["c", "set"])

    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "_row")
    cut = materialise(texts.mapInArrow(lean(sets), "c long, set binary"), "minhash-sets")

    # A hub of many sets meets them in blocks.
    pairs = members.filter("cls <> hub").select(F.col("cls").alias("x"), "hub").distinct()
    load = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(load, "hub").select("x", "hub", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
    asked = asked.join(cut.select(F.col("c").alias("x"), F.col("set").alias("mine")), "x")
    hubs = load.join(cut.select(F.col("c").alias("hub"), F.col("set").alias("there")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "there")
    met = asked.join(hubs, ["hub", "block"]).select("x", "hub", "mine", "there")
    near = materialise(met.mapInArrow(lean(_near_hub), "x long, hub long").select(F.col("x").alias("u"), F.col("hub").alias("v")), "minhash-near")

    # In bands of two all pairs are decided now.
    known = materialise(components(near), "minhash-known")
    open_ = members.filter("n > 2").join(known, F.col("cls") == F.col("node"), "left").select("band", "hub", "cls", F.coalesce("root", "cls").alias("root"))
    open_ = materialise(open_, "minhash-open")
    tops = open_.filter("cls = hub").select("band", F.col("root").alias("top"))
    far = materialise(open_.join(tops, "band").filter("root <> top").select("band", "cls", "root"), "minhash-far")
    if far.isEmpty():
        return near
    few = far.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"))
    most = open_.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    counts = materialise(few.join(most, "band"), "minhash-blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    left = far.join(counts, "band").select("band", "cls", "root", own("m").alias("i"), every("k").alias("j"))
    whole = open_.join(counts, "band").select("band", "cls", "root", every("m").alias("i"), own("k").alias("j"))
    block = ["band", "i", "j"]
    own_set, other_set = (cut.select(F.col("c").alias(f"{name}_c"), F.col("set").alias(f"{name}_set")) for name in ("own", "other"))
    left = left.join(own_set, F.col("cls") == F.col("own_c")).select(*block, "cls", "root", F.col("own_set").alias("set")).repartition(*block)
    whole = whole.join(other_set, F.col("cls") == F.col("other_c")).select(*block, "cls", "root", F.col("other_set").alias("set")).repartition(*block)
    return near.unionByName(left.groupBy(*block).cogroup(whole.groupBy(*block)).applyInPandas(_across, "u long, v long"))


def minhash_duplicates(docs: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable) and kept for every row of ``docs``.

    Rows whose texts' sets of 2-word shingles are at least 80 % alike link, a text of one word with its like.  Null and
    empty texts have no shingles and link with nothing, not even with each other: their component is their own id.
    Rows with a null id take part; their component is null if no id is reachable, and they are never kept.  Rows that
    share an id count each by its text.  An empty table gives an empty result; further columns, whatever their
    names, are not read.  ``stored``: ``docs`` reads files and repeats none of their rows; else a copy is written.

    Links are confirmed on 64-bit hashes of whole sets; equal sets are known by 128-bit digests of 128-bit hashes.
    """
    rows = with_rows(docs.select("doc_id", "text"), "minhash-rows", stored)
    found = materialise(add_sketches(rows), "minhash-sketches")
    classes = found.filter("size > 0").groupBy("digest").agg(F.min("_row").alias("cls"), F.min("doc_id").alias("least"), F.any_value("keys").alias("keys"))
    classes = materialise(classes, "minhash-classes")
    linked = components(set_links(rows, classes))
    rooted = classes.select("digest", "cls", "least").join(linked, F.col("cls") == F.col("node"), "left")
    rooted = rooted.select("digest", "least", F.coalesce("root", "cls").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(rooted.join(lowest, "root").select(F.col("digest").alias("d"), "component"), "minhash-components")
    joined = found.select("doc_id", "size", "digest").join(named, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13_fast_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(documents(spark, sf_dir).select("doc_id", "text"), stored=True)


#: All pairs that share a shingle, counted; then every node reachable.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
kinds AS (SELECT list_sort(s) AS s, min(doc_id) AS k FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS (SELECT k, len(s) AS n, unnest(s) AS x FROM kinds),
links AS (
  SELECT a.k AS u, b.k AS v FROM items a JOIN items b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT k AS a, k AS b FROM kinds UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
lowest AS (SELECT a AS k, min(b) AS component FROM reach GROUP BY a),
named AS (SELECT list_sort(s) AS s, doc_id FROM sets)
SELECT s.doc_id, z.n AS n_shingles, CASE WHEN z.n = 0 THEN s.doc_id ELSE l.component END AS component_id,
  coalesce(s.doc_id = CASE WHEN z.n = 0 THEN s.doc_id ELSE l.component END, false) AS kept
FROM named s JOIN sizes z USING (doc_id) LEFT JOIN kinds USING (s) LEFT JOIN lowest l ON l.k = kinds.k
"""
