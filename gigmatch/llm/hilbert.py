"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a grid, rows are sorted by the index of their cell on a Hilbert curve
through that grid, and the sorted run is cut into shards of equal row counts.  Neighbours on the curve are
neighbours in every dimension, so each shard covers narrow ranges of all of them and a reader can skip shards by
the minima and maxima of any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.llm.common import documents, global_rank, with_rank

SHARDS = 24


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell given by one integer of ``bits`` bits per dimension.

    From the highest bit down, the corner of the cube is turned into the frame of the current sub-curve (an entry
    corner and a main direction), its place in Gray code order is appended to the index, and the frame of that
    sub-cube is composed with the current one.
    """
    n = len(cells)
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    place = [gray.index(i) for i in range(size)]
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    flip = [((i ^ (i + 1)).bit_length() - 1) for i in range(size)]  # trailing ones of i
    turn = [0] + [(flip[i - 1] if i % 2 == 0 else flip[i]) % n for i in range(1, size)]
    rotate_right = [[((v >> s) | (v << (n - s))) & (size - 1) for v in range(size)] for s in range(n)]
    rotate_left = [[((v << s) | (v >> (n - s))) & (size - 1) for v in range(size)] for s in range(n)]
    right, left = _ints(sum(rotate_right, [])), _ints(sum(rotate_left, []))
    at = lambda table, i: F.get(table, i)

    def corner(level: Column) -> Column:
        out = F.lit(0)
        for j, cell in enumerate(cells):
            bit = F.call_function("shiftright", cell, level).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, j))
        return out

    def step(state: Column, level: Column) -> Column:
        shift = (state["d"] + F.lit(1)) % F.lit(n)
        turned = at(right, shift * F.lit(size) + corner(level).bitwiseXOR(state["e"]))
        w = at(_ints(place), turned)
        return F.struct(
            (state["h"] * F.lit(size) + w.cast("long")).alias("h"),
            state["e"].bitwiseXOR(at(left, shift * F.lit(size) + at(_ints(entry), w))).alias("e"),
            ((state["d"] + at(_ints(turn), w) + F.lit(1)) % F.lit(n)).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(_ints(list(range(bits - 1, -1, -1))), start, step, lambda s: s["h"])


def string_cuts(df: DataFrame, name: str, bins: int) -> list[str]:
    """Smallest values of at most ``bins`` bins: whole strings, cut so that each bin holds about as many rows.

    Values are counted first, so a frequent one is one row; cumulative counts run within ranges of values.  With no
    more values than bins each gets its own.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(counts, ["v"], "hilbert-values")
    if (values := ranked.count()) <= bins:
        return [r["v"] for r in ranked.select("v").collect()] if values else []
    whole = ranked.groupBy("_pid").agg(F.sum("n").alias("in"))  # one row per range partition
    before = whole.select("_pid", F.sum("in").over(Window.orderBy("_pid")).alias("upto"), F.sum("in").over(Window.partitionBy()).alias("all"), "in")
    here = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    at = ranked.join(F.broadcast(before), "_pid").withColumn("start", F.col("upto") - F.col("in") + F.coalesce(F.sum("n").over(here), F.lit(0)))
    share = lambda c: F.floor(c * bins / F.col("all"))
    first = at.filter((F.col("start") == 0) | (share(F.col("start")) > share(F.col("start") - 1)) | (share(F.col("start") + F.col("n") - 1) > share(F.col("start"))))
    return sorted((r["v"] for r in first.select("v").collect()), key=lambda v: v.encode())[: 2 * bins]


def quantise(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """Adds ``_cell_<name>`` in 0 .. 2^bits - 1: bin 0 for null, the others cut at quantiles over all rows.

    Few bins are spread over the whole range, so that each dimension counts from the first turn of the curve.  The
    cut points are a few per cell and dimension, whatever the input; strings are compared whole.
    """
    kinds = _types(df, dims)
    wide = df.select("*", *[(c if t == "string" else c.cast("double")).alias(f"_code_{k}") for (k, c), t in zip(dims.items(), kinds)])
    bins = (1 << bits) - 1
    shares = [i / bins for i in range(1, bins)]
    numbers = [k for k, t in zip(dims, kinds) if t != "string"]
    cuts: dict[str, list] = {k: string_cuts(wide, f"_code_{k}", bins) for k, t in zip(dims, kinds) if t == "string"}
    if numbers:
        found = wide.agg(*[F.percentile_approx(f"_code_{k}", shares, 10_000).alias(k) for k in numbers], *[F.min(f"_code_{k}").alias(f"_min_{k}") for k in numbers]).first()
        cuts |= {k: sorted({found[f"_min_{k}"], *(found[k] or [])} - {None}) for k in numbers}

    def bin_of(name: str) -> Column:
        code, edges = F.col(f"_code_{name}"), cuts[name]
        if not edges:
            return F.lit(0)
        above = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= code))
        return F.when(code.isNull(), F.lit(0)).otherwise(F.floor(above * bins / len(edges)).cast("int"))

    return wide.select("*", *[bin_of(k).alias(f"_cell_{k}") for k in dims])


def _types(df: DataFrame, dims: dict[str, Column]) -> list[str]:
    return [f.dataType.simpleString() for f in df.select(*[c.alias(k) for k, c in dims.items()]).schema]


def hilbert_shards(df: DataFrame, dims: dict[str, Column], ties: list[Column], shards: int = SHARDS, bits: int = 5) -> DataFrame:
    """``df`` with hilbert, shard and slot; columns of these names that it has are replaced.

    Law ``rows``: shard sizes differ by one at most.  ``ties`` order the rows of one cell (rows equal in all of them
    are alike, so any order serves).  Null dimensions fall in bin 0; fewer rows than shards leave shards empty; an
    empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    tied = [f"_tie_{i}" for i in range(len(ties))]
    wide = quantise(df, dims, bits)
    index = hilbert_index([F.col(f"_cell_{k}") for k in dims], bits)
    wide = wide.select(*names, index.alias("_hilbert"), *[c.alias(t) for c, t in zip(ties, tied)])
    ranked = global_rank(wide, ["_hilbert", *tied], "hilbert")
    shard = F.expr(f"_rank * {shards} div _total")
    placed = ranked.select(*names, "_hilbert", "_rank", "_total", shard.alias("_shard"))
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    return placed.select(
        *names,
        F.col("_hilbert").alias("hilbert"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - first).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, stats: list[str]) -> DataFrame:
    """Write one folder per shard and a manifest of minima and maxima for pruning.

    Rows are dealt by ranges of the curve, so a large shard is written by several tasks, each file a run of its slots.
    """
    spark = sharded.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    ranges = [f(c).alias(f"{n}_{c}") for c in stats for n, f in (("min", F.min), ("max", F.max))]
    data.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ranges).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by language, source and size; size is UTF-8 bytes (null: none) plus 8."""
    body = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        "lang",
        "source",
    )
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")}
    out = hilbert_shards(docs, dims, [F.col("text_crc32"), F.col("doc_id")])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
