"""Near-duplicate documents: SimHash fingerprints joined by Golay-code fuzzy hashing.

A fingerprint's 64 bits are two segments of 23 bits and one of 18.  The perfect binary Golay code of length 23 has a
codeword within 3 bits of every word, and any two words at most 2 bits apart have a codeword that is within 4 bits
of both: a segment's codewords within 4 bits (1 or 6 of them) are keys that survive 2 errors.  Pigeonholing at most
four errors over the segments, and over their halves, shows which exact parts and which codewords must agree; each
case is one family of join keys of at least 30 bits.  Pairs that meet under a key are verified by their distance.

That radius links few texts of a high Jaccard similarity.  With ``similar`` given, texts whose sets of 5-word
shingles reach it link as well: candidates share a band of MinHash values, and their sets are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import apart, bounded, documents, drop_rows, materialise, narrow, only_rows, slices, with_rows
from gigmatch.llm.components import components
from gigmatch.llm.workers import lean

#: Words per shingle, hash seed, and differing bits at which fingerprints still link.
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Fingerprints of one key that a task compares at once; longer runs are compared in pairs of blocks.
BLOCK = 2048
#: Texts whose sets of so many words a shingle reach this Jaccard similarity are near copies for the pipeline.
WIDE_SHINGLE, SIMILAR = 5, 0.8
#: Bands and MinHash values in each: two texts of similarity 0.8 share no band with probability 2e-5.
BANDS, BAND = 36, 6
#: Texts of one band that a task compares at once, as sets of shingles.
TEXTS = 1024
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Lowest bit and width of the segments.
A, B, C = (41, 23), (18, 23), (0, 18)
#: Halves of the segments.
A1, A2, B1, B2, C1, C2 = (41, 12), (53, 11), (18, 12), (30, 11), (0, 9), (9, 9)
#: Families of keys: (exact parts, segments by codeword).  With errors (a, b, c), a + b + c <= 4:
#: the first six hold if a, b or c is 0 (then one of the others is at most 2); if none is, the errors are 1, 1, 1 or
#: a 2 and two 1s, two segments have an exact half each, and the third is within 2.
FAMILIES = (
    [((x,), (y,)) for x, y in ((B, A), (A, B), (C, A), (C, B), (A, C), (B, C))]
    + [(halves, (C,)) for halves in product((A1, A2), (B1, B2))]
    + [(halves, (A,)) for halves in product((B1, B2), (C1, C2))]
    + [(halves, (B,)) for halves in product((A1, A2), (C1, C2))]
)

_TABLES: list[np.ndarray] = []


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial: their syndromes."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def nearest_codeword() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the one error pattern of at most 3 bits, and how many bits it has."""
    if not _TABLES:
        patterns = [sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)]
        patterns = np.array(patterns, np.int64)
        errors, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
        at = _remainder(patterns)
        errors[at], weight[at] = patterns, np.bitwise_count(patterns)
        _TABLES.extend((errors, weight))
    return _TABLES[0], _TABLES[1]


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six indices (0 to 4095) per 23-bit word: of all codewords within 4 bits, repeated where there are fewer.

    At distance 2 or less from a codeword it is the only one within 4.  At distance 3, the others are found by
    changing each further bit and decoding: four such changes lead to each.
    """
    errors, weight = nearest_codeword()
    syndrome = _remainder(words)
    first = words ^ errors[syndrome]
    out = np.repeat(first[:, None], 6, 1)
    far = np.flatnonzero(weight[syndrome] == 3)
    if len(far):
        flips = words[far][:, None] ^ (1 << np.arange(23, dtype=np.int64))
        others = np.sort(flips ^ errors[_remainder(flips)], 1)
        fresh = np.concatenate([np.ones((len(far), 1), bool), others[:, 1:] != others[:, :-1]], 1)
        out[far] = others[fresh].reshape(-1, 6)
    return out >> 11


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint) of all families, each pair once; prints: uint64."""

    def part(where: tuple[int, int]) -> np.ndarray:
        return (prints >> np.uint64(where[0]) & np.uint64((1 << where[1]) - 1)).astype(np.int64)

    codes = {s: golay_keys(part(s)) for s in (A, B, C)}
    keys, owners = [], []
    for number, (exact, (segment,)) in enumerate(FAMILIES):
        base = np.full(len(prints), number, np.int64)
        for where in exact:
            base = base << where[1] | part(where)
        got = base[:, None] << 12 | codes[segment]
        new = np.ones(got.shape, bool)
        got = np.sort(got, 1)
        new[:, 1:] = got[:, 1:] != got[:, :-1]
        keys.append(got[new])
        owners.append(np.nonzero(new)[0])
    return np.concatenate(keys), np.concatenate(owners)


def fingerprint(text: str) -> int:
    """SimHash of the shingles of a text's words; 0 if it has none."""
    return int(fingerprints([text])[0])


def fingerprints(texts: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= SHINGLE:
            hashes.append(xxh64_intdigest(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        hashes.extend([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())])
        counts[i] = len(starts)
    some = np.flatnonzero(counts)
    out = np.zeros(len(texts), np.uint64)
    if not len(some):
        return out
    table = np.array(hashes, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    for bit in range(64):
        ones = np.add.reduceat((table >> np.uint64(bit) & np.uint64(1)).astype(np.int64), first)
        out[some] |= np.where(ones * 2 > counts[some], np.uint64(1) << np.uint64(bit), np.uint64(0))
    return out


def wide_shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; of all its words if it has fewer, none if it has none."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= WIDE_SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-WIDE_SHINGLE] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[WIDE_SHINGLE - 1 :].tolist())], np.uint64))


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """One key per band of each set's MinHash values; none for an empty set."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 31, BANDS * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 1 << 32, BANDS * BAND, dtype=np.uint32)
    mixers = rng.integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    some = [i for i, x in enumerate(sets) if len(x)]
    out: list[list[int]] = [[] for _ in sets]
    if not some:
        return out
    flat = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
    lows = np.stack([np.minimum.reduceat((flat ^ m) * f, first) for f, m in zip(factors, masks)], 1)
    keys = (lows.astype(np.uint64).reshape(-1, BANDS, BAND) * mixers).sum(2, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    keys = keys * mixers[:, 0] + np.arange(BANDS, dtype=np.uint64)
    for i, k in zip(some, keys.view(np.int64).tolist()):
        out[i] = k
    return out


def add_bands(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint, a hash of the text, its band keys and _row for every row of ``rows`` (of ``with_rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], 500_000):
                prints = pa.array(fingerprints(texts[a:b]).view(np.int64))
                keys = pa.array(band_keys([wide_shingles(t) for t in texts[a:b]]), pa.list_(pa.int64()))
                ids, tids, at = (batch.column(c).slice(a, b - a) for c in ("doc_id", "tid", "_row"))
                yield pa.RecordBatch.from_arrays([ids, prints, tids, keys, at], ["doc_id", "print", "tid", "keys", "_row"])

    read = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "_row")
    return read.withColumn("tid", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, print long, tid long, keys array<long>, _row long")


def _sizes_in_common(mine: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``sets`` (sorted, distinct, not empty) shares with ``mine`` (the same)."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    sizes = np.array([len(x) for x in sets])
    return np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _jaccard(mine: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    both = _sizes_in_common(mine, sets)
    return both / (len(mine) + np.array([len(x) for x in sets]) - both)


def _near_hub(similar: float):
    """Pairs (x, hub) whose sets reach ``similar``, from rows (x, hub, mine, there) with both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column("hub").to_numpy()
            mine, there = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("mine", "there"))
            good = np.zeros(len(hubs), bool)
            order = np.argsort(hubs, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
                if len(rows):
                    good[rows] = _jaccard(there[rows[0]], [mine[i] for i in rows]) >= similar
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("x", "hub")], ["x", "hub"])

    return run


def _with_rest(similar: float):
    """Links (u, v) between the texts of a group that its hub didn't reach and all of its texts, enough to connect them."""

    def run(left: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(whole):
            tids, sets = whole["tid"].to_numpy(np.int64), [np.frombuffer(v, np.uint64) for v in whole["shingles"]]
            parent = {t: t for t in [*tids.tolist(), *left["tid"].tolist()]}

            def root(t: int) -> int:
                while parent[t] != t:
                    parent[t] = t = parent[parent[t]]
                return t

            for t, v in zip(left["tid"].tolist(), left["shingles"]):
                for other in tids[_jaccard(np.frombuffer(v, np.uint64), sets) >= similar].tolist():
                    if (a := root(t)) != (b := root(other)):
                        parent[a] = b
                        out.append((t, other))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def similar_links(numbered: DataFrame, banded: DataFrame, similar: float) -> DataFrame:
    """(u, v): pairs of fingerprints whose texts' sets of 5-word shingles reach ``similar``, enough to connect them all.

    ``banded`` is the materialised ``add_bands`` of ``numbered`` (of ``with_rows``).  A band's texts are compared with
    one of them, its hub, first, so a large group of copies costs one comparison a copy.  Then those that aren't near
    the hub are compared with all of their band, in pairs of blocks: no pair that shares a band stays undecided.
    Bands of the same texts count once.  Texts are read where they lie, one row of each; what is shuffled are sets of
    shingles, once for each hub of a text.
    """
    rows = banded.select("tid", "print", F.explode("keys").alias("key"))
    mixed = F.xxhash64("tid")
    marks = [F.count(F.lit(1)).alias("n"), F.sum(mixed.bitwiseAND(F.lit((1 << 31) - 1))).alias("total"), F.bit_xor(mixed).alias("odd")]
    groups = rows.groupBy("key").agg(*marks, F.min("tid").alias("low"), F.max("tid").alias("high")).filter("low <> high")
    once = groups.groupBy("n", "total", "odd", "low", "high").agg(F.min("key").alias("run"))
    once = materialise(once.select("run", F.col("low").alias("hub")), "simhash-bands")
    some = bounded(once)
    members = rows.join(some, rows["key"] == some["run"]).select("key", "tid", "hub").distinct()
    members = materialise(members, "simhash-members")

    wanted = members.select(F.col("tid").alias("want")).distinct()
    one = banded.join(wanted, banded["tid"] == wanted["want"], "left_semi").groupBy("tid").agg(F.min("_row").alias("_row"))
    texts = only_rows(narrow(numbered, "text"), one.select("_row"), "simhash-wanted")
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(found, pa.binary())], ["t", "shingles"])

    cut = materialise(texts.select("tid", "text").mapInArrow(lean(sets), "t long, shingles binary"), "simhash-sets")

    # A hub of many texts meets them in blocks.
    pairs = members.filter("tid <> hub").select(F.col("tid").alias("x"), "hub").distinct()
    load = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("blocks"))
    asked = pairs.join(load, "hub").select("x", "hub", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
    asked = asked.join(cut.select(F.col("t").alias("x"), F.col("shingles").alias("mine")), "x")
    hubs = load.join(cut.select(F.col("t").alias("hub"), F.col("shingles").alias("there")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "there")
    met = asked.join(hubs, ["hub", "block"]).select("x", "hub", "mine", "there")
    near = materialise(met.mapInArrow(lean(_near_hub(similar)), "x long, hub long"), "simhash-near")

    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    far = members.filter("tid <> hub").join(near.withColumnRenamed("x", "tid"), ["tid", "hub"], "left_anti").select("key", "tid")
    far = far.join(sizes.filter("n > 2"), "key").select("key", "tid", "n")
    far = materialise(far, "simhash-far")
    links_found = near.select(F.col("x").alias("u"), F.col("hub").alias("v"))
    if not far.isEmpty():
        counts = far.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("m"), F.ceil(F.max("n") / TEXTS).cast("int").alias("k"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("tid"), F.col(c)).cast("int")
        left = far.select("key", "tid").join(counts, "key").select("key", "tid", own("m").alias("i"), every("k").alias("j"))
        whole = members.select("key", "tid").join(counts, "key").select("key", "tid", every("m").alias("i"), own("k").alias("j"))
        for_left, for_whole = (cut.select(F.col("t").alias("tid"), F.col("shingles").alias(name)) for name in ("own_set", "set"))
        left = left.join(for_left, "tid").select("key", "i", "j", "tid", F.col("own_set").alias("shingles")).repartition("key", "i", "j")
        whole = whole.join(for_whole, "tid").select("key", "i", "j", "tid", F.col("set").alias("shingles")).repartition("key", "i", "j")
        block = ["key", "i", "j"]
        links_found = links_found.unionByName(left.groupBy(*block).cogroup(whole.groupBy(*block)).applyInPandas(_with_rest(similar), "u long, v long"))

    prints = banded.join(wanted, banded["tid"] == wanted["want"], "left_semi").select("tid", "print").distinct()
    prints = materialise(prints, "simhash-tids")
    first, second = (prints.select(F.col("tid").alias(t), F.col("print").alias(p)) for t, p in (("u", "a"), ("v", "b")))
    return links_found.join(first, "u").join(second, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [fingerprints(texts[a:b]) for a, b in slices([len(t) for t in texts], 500_000)]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, print long")


def _links(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: as many components, without all the pairs."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= MOST_BITS)
        for j in (near + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def _same_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links (a, b) with key null; rows of some runs are passed on with their key instead.

    These are runs beyond BLOCK, and a partition's first and last run, which may go on in the partitions beside it.
    A run may go on in the next batch; at most BLOCK rows are held back for it.
    """

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "a", "b"])

    held_key, held = None, np.zeros(0, np.int64)
    passing = False  # rows of the current run are passed on

    def close() -> list[tuple]:
        distinct = np.unique(held)
        return [] if passing else [(None, int(distinct[i]), int(distinct[j])) for i, j in _links(distinct.view(np.uint64))]

    for batch in batches:
        key, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "print"))
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(first[1:], len(key))
        rows: list[tuple] = []
        # Runs of one row inside the batch have no partner; the first may go on, and the last stays open.
        open_runs = (ends - first > 1) | (first == 0) | (ends == len(key))
        for at, end in zip(first[open_runs], ends[open_runs]):
            if held_key is None or key[at] != held_key:
                if len(held) > 1:
                    rows += close()
                passing = held_key is None
                held_key, held = int(key[at]), np.zeros(0, np.int64)
            held = np.concatenate([held, value[at:end]])
            if passing or len(held) > BLOCK:
                rows += [(held_key, int(v), None) for v in held]
                held, passing = np.zeros(0, np.int64), True
        yield emit(rows)
    yield emit([(held_key, int(v), None) for v in held])


def _blocks(long: DataFrame) -> DataFrame:
    """Links within runs passed on: a run is dealt into blocks by a hash, and each pair of blocks is one group.

    A group holds about twice BLOCK rows and gives a spanning forest of its links.
    """
    sizes = long.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("key").alias("run"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = long.join(sizes, long["key"] == sizes["run"]).select(
        "key", F.col("a").alias("print"), "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("own")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("key", "print", "own", other.alias("other")).select(
        "key", "print", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(rows["print"].to_numpy(np.int64))
        found = _links(prints.view(np.uint64))
        return pd.DataFrame({"u": [prints[i] for i, _ in found], "v": [prints[j] for _, j in found]}, dtype="int64")

    # Dealt by all three columns: the join's shuffle by key alone would put all blocks of a run into one task.
    dealt = pairs.repartition("key", "low", "high")
    return dealt.groupBy("key", "low", "high").applyInPandas(run, "u long, v long")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): enough pairs of fingerprints at most 4 bits apart to connect all that such pairs connect.

    ``prints`` has the distinct fingerprints.  No pair of distinct fingerprints that link is left unconnected.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy(zero_copy_only=False)
            for start in range(0, len(values), 5_000):
                part = values[start : start + 5_000]
                key, owner = join_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[owner])], ["key", "print"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("print").repartition(parts, "print")  # a small table that a hundredfold of keys comes from
    keys = dealt.mapInArrow(lean(keyed), "key long, print long")
    # Dealt by ranges of key and fingerprint: a run too long for one task is cut.
    met = keys.repartitionByRange(parts, "key", "print").sortWithinPartitions("key", "print").mapInArrow(lean(_same_key), "key long, a long, b long")
    met = materialise(met, "simhash-met")
    direct = met.filter(F.col("key").isNull()).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    long = met.filter(F.col("key").isNotNull()).select("key", "a")
    return direct if long.isEmpty() else direct.unionByName(_blocks(long)).distinct()


def near_duplicates(docs: DataFrame, similar: float | None = SIMILAR, stored: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row of ``docs``.

    Fingerprints at most 4 bits apart link, and, unless ``similar`` is None, texts whose similarity reaches it.
    Texts without words have fingerprint zero and link like any other.  Rows with a null id get the component of
    their fingerprint; it is null if no id is reachable.  An empty table gives an empty result; further columns,
    whatever their names, are not read.
    """
    if similar is None:
        return _grouped(materialise(add_fingerprints(docs), "simhash-prints"))
    return _similar(with_rows(docs.select("doc_id", "text"), "simhash-rows", stored), similar)


def _similar(rows: DataFrame, similar: float) -> DataFrame:
    prints = materialise(add_bands(rows), "simhash-prints")
    return _grouped(prints, similar_links(rows, prints, similar))


def _grouped(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Components over the fingerprints' own links and ``more`` of them."""
    classes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linking = links(classes)
    found = components(linking if more is None else linking.unionByName(more))
    rooted = found.join(classes, found["node"] == classes["print"]).select("node", "root", "least")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    linked = rooted.join(lowest, "root").select(F.col("node").alias("linked"), "component")
    by_print = classes.join(linked, classes["print"] == linked["linked"], "left").select(
        F.col("print").alias("p"), F.coalesce("component", "least").alias("component_id")
    )
    by_print = materialise(by_print, "simhash-components")
    return prints.join(by_print, prints["print"] == by_print["p"], "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


@apart
def keep_one(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they were.

    The smallest doc_id stays, null ids last; rows are told apart by their places, not by their ids.  ``stored``:
    ``docs`` reads files and repeats no row of them; else a copy is written.
    """
    rows = with_rows(docs, "simhash-rows", stored)
    by_row = _similar(narrow(rows.withColumn("doc_id", F.col("_row")), "doc_id", "text"), SIMILAR)
    found = by_row.select(F.col("doc_id").alias("r"), "component_id")
    found = found.join(rows.select("_row", F.col("doc_id").cast("long").alias("id")), found["r"] == F.col("_row"))
    found = materialise(found.select("r", "id", "component_id"), "simhash-found")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r"))
    groups = found.groupBy("component_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = bounded(materialise(groups.select(F.col("component_id").alias("c"), F.col("first.r").alias("stays")), "simhash-stays"))
    gone = found.join(groups, found["component_id"] == groups["c"]).filter("r <> stays").select(F.col("r").alias("_row"))
    return drop_rows(rows, gone, "simhash-gone")


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), similar=None)
