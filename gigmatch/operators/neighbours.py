"""Exact top-k cosine neighbours of sparse vectors, without forming all pairs that share a frequent tag.

Tags are taken by rising frequency.  All pairs that share a tag of at most SMALL keys are compared inside the groups of
those tags.  A pair without such a tag is decided by its frequent tags alone.  For these, keys are ordered by their
frequent tags and cut into blocks of BLOCK; a block knows, for every tag, its largest weight, and the largest norm that
frequent tags leave to one of its keys.  Two products bound what a key of one block can have in common with a key of
another: that of the norms, and that of the weights summed over shared tags.  Each block is first compared with itself
and with the blocks that lead its heaviest tags; the k-th neighbours found so far are then a bar, and only pairs of
blocks whose bound reaches it are compared.  Ties are in the bar too, by the smallest key of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmatch.sources.shared import bounded, materialise

#: Keys of a tag that are compared as one group, and keys of a block.
SMALL, BLOCK = 256, 256
#: Tags of a block whose leading blocks are compared with it first.
LEADS = 3
#: Similarities are ranked by six digits; bounds allow for half of the last one, and for what sums may differ by.
HALF, SLACK = 5e-7, 1e-7

_SIDE = "keys array<{0}>, tags array<array<string>>, units array<array<double>>"


class _Side:
    """Keys and their vectors, flattened."""

    def __init__(self, keys: pa.Array, tags: pa.ListArray, units: pa.ListArray) -> None:
        self.keys, self.n = keys, len(keys)
        self.tags, self.units = tags.flatten(), units.flatten().to_numpy(zero_copy_only=False)
        self.rows = pc.list_parent_indices(tags).to_numpy(zero_copy_only=False)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers for the same values of two arrays."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def nearest(x: _Side, y: _Side, k: int, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, similarity): at least the k best of ``y`` above 0 for each of ``x``, ties by key.

    Ranks follow six digits; what lies within rounding of two of them is given as well.
    """
    xc, yc = _codes(x.tags, y.tags)
    n_tags = int(max(xc.max(initial=-1), yc.max(initial=-1))) + 1
    shared = (np.bincount(xc, minlength=n_tags) > 0) & (np.bincount(yc, minlength=n_tags) > 0)
    place = np.cumsum(shared) - 1
    dense = []
    for side, codes in ((x, xc), (y, yc)):
        table, on = np.zeros((side.n, int(shared.sum()))), shared[codes]
        np.add.at(table, (side.rows[on], place[codes[on]]), side.units[on])
        dense.append(table)
    found = dense[0] @ dense[1].T
    if not include_self:
        xk, yk = _codes(x.keys, y.keys)
        found[xk[:, None] == yk[None, :]] = 0
    scaled = found * 1e6 + 0.5
    digits = np.floor(scaled).astype(np.int64)
    unsure = np.abs(scaled - np.rint(scaled)) < 1e-3
    rank = np.empty(y.n, np.int64)
    rank[pc.sort_indices(y.keys).to_numpy()] = np.arange(y.n)
    order = digits * y.n + (y.n - 1 - rank)[None, :]
    good = unsure & (found > 0)
    if k < y.n:
        top = np.argpartition(-order, k - 1, axis=1)[:, :k]
        np.put_along_axis(good, top, True, axis=1)
    else:
        good[:] = True
    a, b = np.nonzero(good & (found > 0))
    return a, b, found[a, b]


def _within(k: int, include_self: bool, kind: str):
    """The best of each group of keys that share a tag."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, asked = group.column("key").combine_chunks(), group.column("asked").combine_chunks()
        tags, units = group.column("tags").combine_chunks(), group.column("units").combine_chunks()
        x = _Side(key.filter(asked), tags.filter(asked), units.filter(asked))
        if not x.n:
            return pa.table({"key": key[:0], "neighbor": key[:0], "raw": pa.array([], pa.float64())})
        a, b, s = nearest(x, _Side(key, tags, units), k, include_self)
        return pa.table({"key": x.keys.take(pa.array(a)), "neighbor": key.take(pa.array(b)), "raw": pa.array(s)})

    return run


def _between(k: int, include_self: bool):
    """The best of the right block for each key asked of the left one; a row is a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c: batch.column(c)[i].values
                asked = one("asked")
                x = _Side(*[one(c).filter(asked) for c in ("keys", "tags", "units")])
                y = _Side(*[one(f"other_{c}") for c in ("keys", "tags", "units")])
                a, b, s = nearest(x, y, k, include_self)
                yield pa.RecordBatch.from_arrays([x.keys.take(pa.array(a)), y.keys.take(pa.array(b)), pa.array(s)], ["key", "neighbor", "raw"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(key, neighbor, similarity, rank): the k best of pairs that may repeat."""
    once = found.groupBy("key", "neighbor").agg(F.round(F.max("raw"), 6).alias("similarity")).filter("similarity > 0")
    order = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbor")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _vectors(vectors: DataFrame, targets: DataFrame | None, small: int) -> DataFrame:
    """key, asked, tags and their units (weights over the norm), and ``hot``: the tags of more than ``small`` keys, rarest first."""
    v = vectors.filter("key is not null")
    norms = v.groupBy(F.col("key").alias("k")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).filter("norm > 0")
    df = v.filter("tag is not null and weight <> 0").groupBy(F.col("tag").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    rows = v.filter("tag is not null and weight <> 0").join(norms, F.col("key") == F.col("k")).join(df, F.col("tag") == F.col("t"))
    one = F.struct("df", "tag", (F.col("weight") / F.col("norm")).alias("unit"))
    grouped = rows.select("key", one.alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("v"))
    if targets is None:
        grouped = grouped.withColumn("asked", F.lit(True))
    else:
        wanted = targets.select(F.col("key").alias("w")).distinct()
        grouped = grouped.join(wanted, F.col("key") == F.col("w"), "left").withColumn("asked", F.col("w").isNotNull())
    hot = F.filter("v", lambda x: x["df"] > small)
    rare = F.filter("v", lambda x: (x["df"] <= small) & (x["df"] > 1))
    return grouped.select("key", "asked", F.col("v.tag").alias("tags"), F.col("v.unit").alias("units"), hot.alias("hot"), F.transform(rare, lambda x: x["tag"]).alias("rare"))


def _blocks(hot: DataFrame, block: int) -> DataFrame:
    """``hot`` with a block number: runs of keys in the order of their frequent tags, the heaviest first."""
    spark = hot.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.array_join("hot.tag", "\x01").alias("pattern"), F.round(F.col("hot")[0]["unit"], 3).alias("first")]
    marked = hot.select("*", *order)
    by = ["pattern", F.desc("first"), "key"]
    dealt = marked.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    number = F.shiftright(place, 33) * F.lit(1 << 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / block)
    return materialise(dealt.select("key", "asked", "tags", "units", "hot", number.cast("long").alias("block")), "neighbours-blocks")


def neighbour_search(vectors: DataFrame, top_n: int, targets: DataFrame | None = None, include_self: bool = False, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(neighbours, compared): (key, neighbor, similarity, rank), and how many pairs of keys were compared, by ``step``."""
    kind = dict(vectors.dtypes)["key"]
    schema = f"key {kind}, neighbor {kind}, raw double"
    v = materialise(_vectors(vectors, targets, small), "neighbours-vectors")
    if include_self:
        alone = v.filter("asked").select("key", F.col("key").alias("neighbor"), F.lit(1.0).alias("raw"))

    rare = v.select(F.explode("rare").alias("tag"), "key", "asked", "tags", "units")
    groups = rare.groupBy("tag").applyInArrow(_within(top_n, include_self, kind), schema)
    found = [materialise(groups, "neighbours-rare")]
    sizes = rare.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("m"))
    compared = [sizes.select(F.lit("rare").alias("step"), (F.col("n") * F.col("m")).alias("pairs"))]
    if include_self:
        found.append(alone)

    hot = v.filter(F.size("hot") > 0)
    if not hot.isEmpty():
        cut = _blocks(hot, block)
        collected = lambda c: F.transform("rows", lambda r: r[c]).alias(c if c != "key" else "keys")
        rows = F.array_sort(F.collect_list(F.struct("key", "asked", "tags", "units"))).alias("rows")
        whole = cut.groupBy("block").agg(rows).select("block", *[collected(c) for c in ("key", "asked", "tags", "units")])
        whole = materialise(whole, "neighbours-whole")
        each = cut.select("block", F.explode("hot").alias("x")).select("block", "x.tag", F.abs("x.unit").alias("unit"))
        tops = materialise(each.groupBy("block", "tag").agg(F.max("unit").alias("most")), "neighbours-tops")
        norm = F.sqrt(F.aggregate("hot", F.lit(0.0), lambda s, x: s + x["unit"] * x["unit"]))
        sums = cut.withColumn("norm", norm).groupBy("block").agg(F.max("norm").alias("norm"), F.min("key").alias("low"), F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("m"))
        sums = materialise(sums, "neighbours-sums")

        # First each block with itself and with the leaders of its heaviest tags.
        lows = tops.join(sums.select(F.col("block").alias("b"), "low"), F.col("block") == F.col("b"))
        leader = lows.groupBy(F.col("tag").alias("t")).agg(F.min_by("block", F.struct(-F.col("most"), "low")).alias("other"))
        heavy = tops.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("most"), "tag"))).filter(F.col("place") <= LEADS)
        asked = sums.filter("m > 0").select("block")
        first = asked.select("block", F.col("block").alias("other")).unionByName(heavy.join(asked, "block").join(leader, F.col("tag") == F.col("t")).select("block", "other")).distinct()
        first = materialise(first, "neighbours-first")
        other = lambda: whole.select(F.col("block").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("keys", "tags", "units")])
        met = lambda pairs: pairs.join(whole, "block").join(other(), "other").drop("block", "other").mapInArrow(_between(top_n, include_self), schema)
        found.append(materialise(met(first), "neighbours-leading"))

        # The bar: the k-th neighbour so far of every key, the lowest of a block.
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.unionByName(more)
        last = _ranked(so_far, top_n).filter(F.col("rank") == top_n).select(F.col("key").alias("k"), "similarity", "neighbor")
        bars = cut.filter("asked").select("block", "key").join(last, F.col("key") == F.col("k"), "left")
        bars = bars.groupBy("block").agg(F.min(F.coalesce("similarity", F.lit(0.0))).alias("bar"), F.max("neighbor").alias("last"))
        left = materialise(bars.join(sums.select("block", F.col("norm").alias("left_norm"), "m"), "block"), "neighbours-bars")
        right = sums.select(F.col("block").alias("other"), F.col("norm").alias("right_norm"), "low", "n")
        a, b = tops.select("block", "tag", F.col("most").alias("u")), tops.select(F.col("block").alias("other"), "tag", F.col("most").alias("w"))
        sums_of = a.join(b, "tag").groupBy("block", "other").agg(F.sum(F.col("u") * F.col("w")).alias("bound"))
        pairs = sums_of.join(bounded(left), "block").join(bounded(materialise(right, "neighbours-right")), "other")
        bound = F.least("bound", F.col("left_norm") * F.col("right_norm"))
        reach = (bound >= F.col("bar") + HALF - SLACK) | ((bound >= F.col("bar") - HALF - SLACK) & (F.col("low") < F.coalesce("last", "low")))
        rest = pairs.filter((bound > 0) & reach).select("block", "other").join(first, ["block", "other"], "left_anti")
        rest = materialise(rest, "neighbours-rest")
        found.append(met(rest))
        n, m = sums.select(F.col("block").alias("other"), "n"), sums.select("block", "m")
        for step, table in (("leading", first), ("bounded", rest)):
            compared.append(table.join(m, "block").join(n, "other").select(F.lit(step).alias("step"), (F.col("n") * F.col("m")).alias("pairs")))

    everything, counted = found[0], compared[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    for more in compared[1:]:
        counted = counted.unionByName(more)
    return _ranked(everything, top_n), counted.groupBy("step").agg(F.sum("pairs").alias("pairs"))
