"""Exact deduplication by a stateful stream.

The keyed state of a streaming aggregation (RocksDB on the executors' disks, snapshots in the shared folder, no
watermark and so no expiry) holds for each digest the stable identifier and content locator of the row that stays,
and how many rows had that digest.  A locator is a number made of the row's file and its place there.  A digest alone
never decides: the locators of all rows whose digest was hit lead back to their texts, whose full bytes are compared;
groups whose bytes differ are split by their bytes.

``exact_dedup`` takes a table and a state of its own; ``dedup_files`` adds files to a state that lives on.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.llm.common import apart, beside_files, bounded, documents, drop_rows, file_numbers, materialise, narrow, new_dir, only_rows, placed, row_number, with_rows

SPACES = r"[\x20\x09-\x0D]+"
#: Disk-backed state; without allocating files ahead, which costs megabytes for each partition however small, and with
#: one bound for the buffers and caches of all stores of an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
LOG = "doc_id bigint, digest string, text_sha256 string, locator bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keeper() -> Column:
    """Smallest doc_id first, null ids last, repeated ids in the order of their places."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))


def _state_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep their state on disk; the caller's own settings stay as they are."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in STATE_STORE.items():  # not all of them are listed as modifiable
        session.conf.set(key, value)
    return session


def stream_state(spark: SparkSession, log_dir: str, index_dir: str, checkpoint: str, files_per_trigger: int) -> DataFrame:
    """Run what is new in the digest log through the keyed state; returns digest, keeper and group size of all digests.

    Each micro-batch writes its changed keys to a folder of its own, so a batch that is run again after a failure
    replaces itself.  Keepers only get smaller and sizes only larger: the last state is their minimum and maximum.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index_dir}/batch={batch_id}")

    stream = _state_session(spark).readStream.schema(f"{LOG}, run int").option("maxFilesPerTrigger", files_per_trigger).parquet(log_dir)
    kept = stream.groupBy("digest").agg(_keeper().alias("keeper"), F.count(F.lit(1)).alias("size"))
    query = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    keeper = "keeper struct<no_id: boolean, doc_id: bigint, locator: bigint>"
    index = spark.read.schema(f"digest string, {keeper}, size bigint, batch int").parquet(index_dir)
    return index.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("size").alias("size"))


def _write_log(rows: DataFrame, digest: Callable[[Column], Column], path: str) -> None:
    """The digest log of ``rows`` (doc_id, text, _row)."""
    norm = rows.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.col("_row").alias("locator"))
    with_digest = norm.select("doc_id", digest(F.col("norm")).cast("string").alias("digest"), sha256(F.col("norm")).alias("text_sha256"), "locator")
    with_digest.write.mode("overwrite").parquet(path)


def _decisions(spark: SparkSession, log: DataFrame, state: DataFrame, digest: Callable[[Column], Column], texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per row of ``log``; ``texts`` gives the rows (text, _row) that locators (_row) lead to.

    Joins are on narrow columns; only texts whose digest was hit, copies collapsed, are ever shuffled.
    """
    groups = state.filter("size > 1").select("digest", F.col("keeper.no_id").alias("no_id"), F.col("keeper.doc_id").alias("first_id"), F.col("keeper.locator").alias("first"), "size")
    groups = bounded(materialise(groups, "dedup-groups"))
    hits = log.join(groups.select("digest"), "digest").select(F.col("locator").alias("_row"))

    # Full bytes of every hit: partial minima and maxima collapse copies before the shuffle, however many there are.
    found = texts(hits).select(normalised(F.col("text")).alias("norm"), "_row")
    hashed = found.select("norm", digest(F.col("norm")).cast("string").alias("digest"))
    differing = hashed.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high")
    collided = materialise(differing.select("digest"), "dedup-collided")

    clear = collided.isEmpty()
    some = None if clear else bounded(collided)
    by_digest = groups if clear else groups.join(some, "digest", "left_anti")
    alone = log if clear else log.join(some, "digest", "left_anti")
    decided = alone.join(by_digest, "digest", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("locator") == F.col("first"), F.lit(True)).alias("kept"),
        "text_sha256",
        "locator",
    )
    if clear:
        return decided
    # Texts under one digest are told apart by their SHA-256 and, in that group, by their bytes.
    unclear = log.join(some, "digest")
    bodies = found.select(F.col("_row").alias("locator"), "norm")
    whole = unclear.join(bodies, "locator").select("doc_id", "norm", "text_sha256", "locator")
    same = Window.partitionBy("text_sha256", "norm")
    first = same.orderBy(F.col("doc_id").asc_nulls_last(), "locator")
    split = whole.select(
        "doc_id",
        F.min("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
        "text_sha256",
        "locator",
    )
    return decided.unionByName(split)


def _decide(rows: DataFrame, digest: Callable[[Column], Column], files_per_trigger: int) -> DataFrame:
    """Decisions on ``rows`` (doc_id, text, _row of ``with_rows``) from a state of their own."""
    spark = rows.sparkSession
    base = new_dir(spark, "dedup")
    _write_log(rows, digest, f"{base}/log/run=0")
    log = spark.read.schema(LOG).parquet(f"{base}/log/run=0")
    if log.isEmpty():
        return log.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "locator")
    state = stream_state(spark, f"{base}/log", f"{base}/index", f"{base}/checkpoint", files_per_trigger)
    return _decisions(spark, log, state, digest, lambda hits: only_rows(narrow(rows, "text"), hits, "dedup-hits"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000, stored: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept and text_sha256.

    Null text counts as empty.  Of equal texts the smallest doc_id stays (null ids last); of repeated rows with the
    same id and text exactly one is kept.  An empty table gives an empty result; further columns, whatever their
    names, are not read.  ``digest`` can be exchanged: a weak one costs time, never correctness.  ``stored``: ``docs``
    reads files and repeats no row of them, so locators lead into those files; else into a copy.
    """
    rows = with_rows(docs.select("doc_id", "text"), "dedup-rows", stored)
    return _decide(rows, digest, files_per_trigger).drop("locator")


def _stored(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def dedup_files(spark: SparkSession, paths: list[str], folder: str, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 1000) -> DataFrame:
    """Add the Parquet files (doc_id, text) under ``paths`` to the state in ``folder``; decisions on all documents so far.

    ``folder`` is shared by driver and executors and keeps, over all runs, the list of files, the digest log, the
    stream's state and its index.  Files that it knows are left out, so a run may be repeated, after a failure too;
    files must not change afterwards.  The rows are those of ``exact_dedup`` over all files, with ``path`` and
    ``place`` of each row.  Only files that hold rows of a hit digest are read again.
    """
    known = _stored(spark, "_file string, _number bigint, run int", f"{folder}/files")
    held = known.agg(F.max("_number").alias("n"), F.max("run").alias("run")).first()
    found = placed(spark.read.parquet(*paths).select("doc_id", "text"))
    unseen = found.select("_file").distinct().join(known.select("_file"), "_file", "left_anti")  # paths only
    run = 0 if held["run"] is None else held["run"] + 1
    numbers = file_numbers(unseen, 0 if held["n"] is None else held["n"] + 1)
    if not numbers.isEmpty():
        rows = beside_files(found, numbers).select("doc_id", "text", row_number(F.col("_number"), F.col("_at")).alias("_row"))
        _write_log(rows, digest, f"{folder}/log/run={run}")
        numbers.write.mode("overwrite").parquet(f"{folder}/files/run={run}")  # from here on the run counts
    log = spark.read.schema(f"{LOG}, run int").parquet(f"{folder}/log").drop("run")
    files = spark.read.schema("_file string, _number bigint, run int").parquet(f"{folder}/files").drop("run")
    near = bounded(files)  # for joins of narrow tables
    log = log.withColumn("_number", F.shiftright("locator", 33)).join(near, "_number", "left_semi").drop("_number")  # not of a run that failed
    state = stream_state(spark, f"{folder}/log", f"{folder}/index", f"{folder}/checkpoint", files_per_trigger)

    def texts(hits: DataFrame) -> DataFrame:
        hits = materialise(hits, "dedup-hits")
        named = hits.select(F.shiftright("_row", 33).alias("_number")).distinct().join(near, "_number")
        holding = sorted(unquote(r["_file"]) for r in named.select("_file").collect())  # file names only
        if not holding:
            return spark.createDataFrame([], "text string, _row bigint")
        there = beside_files(placed(spark.read.parquet(*holding).select("text")), files)
        return only_rows(there.select("text", row_number(F.col("_number"), F.col("_at")).alias("_row"), "_file"), hits, "dedup-hit-bits")

    decided = _decisions(spark, log, state, digest, texts)
    where = decided.withColumn("_number", F.shiftright("locator", 33)).join(near, "_number")
    return where.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", F.col("_file").alias("path"), F.col("locator").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


@apart
def keep_first(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were; rows are told apart by their places."""
    rows = with_rows(docs, "dedup-rows", stored)
    found = _decide(narrow(rows, "doc_id", "text"), sha256, 1000)
    return drop_rows(rows, found.filter(~F.col("kept")).select(F.col("locator").alias("_row")), "dedup-gone")


def op7_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), stored=True)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
