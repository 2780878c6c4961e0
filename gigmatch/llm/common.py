"""Helpers shared by the training-data operators: shared-folder tables, safe broadcasts, row bitmaps, total orders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Right sides of at most this many (narrow) rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000
#: Bits of one of Spark's bitmaps (4 KB each), and how many bitmaps one broadcast may hold (64 MB).
BITS, BITMAPS = 32_768, 16_384
#: How many files one broadcast may name.
FILES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A session that names none gets a temporary one if it runs on one machine (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gigmatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if a count shows that it is small, else as it is.

    Without the hint Spark joins it by a shuffle on both sides, which adaptive execution may split.
    """
    return F.broadcast(df) if df.count() <= limit else df


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % modulus


def with_rank(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Materialise ``df`` in the total order of ``order`` with ``_pid`` (range partition) and ``_pos`` (place in it).

    Rows are dealt by range, so a run of equal leading keys is cut by the later ones and no partition has to
    take a whole group.  Positions are stored with the rows: they can't change when something is computed again.
    """
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(ordered.select("*", F.spark_partition_id().alias("_pid"), place.alias("_pos")), name)


def partition_offsets(ranked: DataFrame, size: Column | None = None) -> DataFrame:
    """One row per range partition: rows before it (``_before``) and in all (``_total``), or sums of ``size`` instead.

    The window runs over one row per partition, never over the data.
    """
    sizes = ranked.groupBy("_pid").agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        F.col("_pid").alias("_opid"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``_rank`` (from 0, gapless, in the order of ``order``) and ``_total`` without a one-task window."""
    ranked = with_rank(df, order, name)
    offsets = partition_offsets(ranked)
    joined = ranked.join(F.broadcast(offsets), F.col("_pid") == F.col("_opid"))
    return joined.withColumn("_rank", F.col("_before") + F.col("_pos"))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``most`` (one item at least)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for every row, written so that it can't change."""
    return materialise(docs.select("*", F.monotonically_increasing_id().alias("_row")), name)


def file_ranks(files: DataFrame, name: str) -> DataFrame:
    """``files`` (_file, …; one row per file) by range partitions of paths, with ``_pid`` and ``_pos``; none grows beyond ``FILES``."""
    files = materialise(files, f"{name}-list")
    return with_rank(files, ["_file"], name, 2 * files.count() // FILES + 1)


def file_numbers(files: DataFrame, first: int = 0) -> DataFrame:
    """(_file, _number) of the distinct paths in ``files`` (_file), in order from ``first``; one row per file."""
    ranked = file_ranks(files.select("_file").distinct(), "file-ranks")
    joined = ranked.join(F.broadcast(partition_offsets(ranked)), F.col("_pid") == F.col("_opid"))
    return materialise(joined.select("_file", (F.col("_before") + F.col("_pos") + F.lit(first)).cast("long").alias("_number")), "files")


def file_starts(found: DataFrame) -> DataFrame:
    """(_file, _first): how many places the files before have, by order of paths; only places are read, no column."""
    ranked = file_ranks(found.groupBy("_file").agg((F.max("_at") + F.lit(1)).alias("_n")), "file-ranks")
    within = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    joined = ranked.join(F.broadcast(partition_offsets(ranked, F.col("_n"))), F.col("_pid") == F.col("_opid"))
    return materialise(joined.select("_file", before.cast("long").alias("_first")), "files")


def beside_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``found`` (_file) whose file is in ``files`` (_file, …; materialised, one row per file), with its columns.

    At most ``FILES`` files are broadcast at once: more are cut into ranges of paths, and each range reads its own
    files only, as Spark leaves out files by their path.
    """
    if files.count() <= FILES:
        return found.join(F.broadcast(files), "_file")
    ranked = global_rank(files.select("_file"), ["_file"], "file-cuts")
    cuts = sorted(r["_file"] for r in ranked.filter(F.col("_rank") % FILES == 0).select("_file").collect())  # one per range
    parts = []
    for low, high in zip([None, *cuts[1:]], [*cuts[1:], None]):
        own = F.lit(True) if low is None else F.col("_file") >= low
        own = own if high is None else own & (F.col("_file") < high)
        parts.append(found.filter(own).join(F.broadcast(files.filter(own)), "_file"))
    return reduce(DataFrame.unionByName, parts)


def placed(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``_file`` and ``_at``: the file that each row is read from and its place there; None if that isn't known."""
    if "_metadata" in docs.columns:
        return None
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None


def row_number(number: Column, at: Column) -> Column:
    return F.shiftleft(number, 33).bitwiseOR(at)


def with_rows(docs: DataFrame, name: str, stored: bool = False) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for every row that each scan gives it again.

    ``stored`` says that ``docs`` reads files and repeats none of their rows: a row's number is then its place in its
    file after the rows of all files before, ``_file`` is the path, and nothing is written but the list of files.
    Otherwise a numbered copy is written.
    """
    found = placed(docs) if stored else None
    if found is None:
        return numbered(docs, name)
    return beside_files(found, file_starts(found)).select(*docs.columns, (F.col("_first") + F.col("_at")).alias("_row"), "_file")


def narrow(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``rows`` (of ``with_rows``) and what tells its rows apart."""
    return rows.select(*columns, *[c for c in ("_row", "_file") if c in rows.columns])


def bitmaps(rows: DataFrame, name: str, by: list[str] = []) -> DataFrame:
    """(…, _bucket, _bits): the numbers ``_row`` of ``rows`` as bitmaps, written once; 4 KB for 32,768 consecutive numbers."""
    at = F.col("_row") + F.lit(1)  # these functions number from 1
    marked = rows.select(*by, F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_place"))
    return materialise(marked.groupBy(*by, "_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits")), name)


def has_bit(bits: Column, row: Column) -> Column:
    """Whether a bitmap of the row's bucket holds it; false without a bitmap."""
    place = F.bitmap_bit_position(row + F.lit(1))
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def _ranges(rows: DataFrame, cuts: list[int]) -> list[Column]:
    """Conditions that cut ``rows`` into ranges of ``_row``, each true for its own rows only and telling Spark which files to read.

    Files of a table that lies where it was are told by their paths, from a scan that reads no column; in a numbered
    copy Parquet's own minima and maxima of ``_row`` tell.
    """
    edges = [-1, *cuts, 1 << 62]
    own = [(F.col("_row") >= low) & (F.col("_row") < high) for low, high in zip(edges, edges[1:])]
    if "_file" not in rows.columns:
        return own
    held = rows.groupBy("_file").agg(F.min("_row").alias("low"), F.max("_row").alias("high"))
    part = lambda c: sum((F.when(F.col(c) >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    spread = held.select("_file", F.explode(F.sequence(part("low"), part("high"))).alias("part"))
    paths = {r["part"]: r for r in spread.groupBy("part").agg(F.min("_file").alias("low"), F.max("_file").alias("high")).collect()}  # one row per range
    return [own[i] & F.col("_file").between(r["low"], r["high"]) for i, r in sorted(paths.items())]


def marked(rows: DataFrame, bits: DataFrame, columns: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep`` of ``rows`` (of ``with_rows``) beside the bitmaps ``columns`` of its bucket (null where there are none).

    Only bitmaps are broadcast, an eighth of a byte per row and column, and no row of ``rows`` is ever shuffled: beyond
    ``BITMAPS`` of them the row numbers are cut into ranges, each joined with its own bitmaps.  A range of numbers is
    a range of files and opens no other, so all ranges together read the table once, and again only the files
    that a cut goes through: at most one a range.
    """

    def join(part: DataFrame, own: DataFrame) -> DataFrame:
        wide = part.withColumn("_at_bucket", F.bitmap_bucket_number(F.col("_row") + F.lit(1)))
        return keep(wide.join(F.broadcast(own), F.col("_at_bucket") == F.col("_bucket"), "left").drop("_at_bucket", "_bucket"))

    most = max(BITMAPS // len(columns), 1)
    n = bits.count()
    if n <= most:
        return join(rows, bits)
    ranked = global_rank(bits.select("_bucket"), ["_bucket"], "bucket-ranks")
    firsts = sorted(r["_bucket"] for r in ranked.filter(F.col("_rank") % most == 0).select("_bucket").collect())[1:]  # one per range
    parts = []
    for i, own in enumerate(_ranges(rows, [(b - 1) * BITS for b in firsts])):
        held = F.lit(True) if i == 0 else F.col("_bucket") >= firsts[i - 1]
        held = held if i == len(firsts) else held & (F.col("_bucket") < firsts[i])
        parts.append(join(rows.filter(own), bits.filter(held)))
    return reduce(DataFrame.unionByName, parts)


def drop_rows(rows: DataFrame, dropped: DataFrame, name: str = "gone") -> DataFrame:
    """``rows`` (of ``with_rows``) without those whose number is in ``dropped`` (_row), and without ``_row`` and ``_file``."""
    gone = bitmaps(dropped, name)
    return marked(rows, gone, ["_bits"], lambda df: df.filter(~has_bit(F.col("_bits"), F.col("_row"))).drop("_bits", "_row", "_file"))


def only_rows(rows: DataFrame, wanted: DataFrame, name: str = "wanted") -> DataFrame:
    """The ``rows`` (of ``with_rows``) whose number is in ``wanted`` (_row), without ``_file``."""
    some = bitmaps(wanted, name)
    return marked(rows, some, ["_bits"], lambda df: df.filter(has_bit(F.col("_bits"), F.col("_row"))).drop("_bits", "_file"))


#: Columns of ``documents``; helpers have other names.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` (docs, …) for tables with further columns of any name: it sees them under names that clash with nothing."""

    def run(docs: DataFrame, *args, **more) -> DataFrame:
        names = docs.columns
        away = {c: f"further_{i}_{uuid.uuid4().hex}" for i, c in enumerate(names) if c not in COLUMNS}
        if not away:
            return stage(docs, *args, **more)
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        kept = stage(docs.select(*[quoted(c).alias(away.get(c, c)) for c in names]), *args, **more)
        return kept.select(*[F.col(away.get(c, c)).alias(c) for c in names])

    run.__doc__, run.__name__ = stage.__doc__, stage.__name__
    return run


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
