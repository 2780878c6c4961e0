"""Streaming twins: drained, each gives the rows of its batch operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gigmatch.functions.scoring import DAY_MICROS, HALF_LIFE_DAYS, days_since, decay_weight
from gigmatch.operators.captures import DROP_SHARE, LEAST_RUNS, TRAILING_RUNS, anomaly
from gigmatch.sources.shared import freed, shared_dir  # noqa: F401
from gigmatch.sources.stored import StoredTable, insert_ignore


#: Half-lives of one landmark of decayed sums: weights within it stay below 2^100.
SPAN = 100.0
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def _drain_on_disk(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """``drain`` with keyed state on disk; the session's choice of a store is as before afterwards."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        drain(stream, "update", checkpoint, each)
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def stream_plays(stream: DataFrame, key: list[str], watermark: str = "30 days", ts: str = "scrobbled_at") -> DataFrame:
    """Plays once per key; repeats within the watermark are dropped, and rows later than it are never seen."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def sink_plays(stream: DataFrame, table: StoredTable, checkpoint: str, watermark: str = "30 days", ts: str = "scrobbled_at") -> None:
    """``stream_plays`` into a stored table, each batch exactly once.

    A batch adds the plays whose key isn't stored; its number is noted below ``checkpoint`` when it is done.  A batch
    that comes again is skipped if it is noted, and adds only what is missing if it broke off before.
    """
    once = stream_plays(stream, table.key, watermark, ts)
    drain(once, "append", checkpoint, lambda batch, number: insert_batch(table, batch, number, f"{checkpoint}/applied"))


def insert_batch(table: StoredTable, batch: DataFrame, number: int, applied: str) -> int:
    """Adds a numbered batch to ``table`` unless ``applied`` notes it; how many rows were added."""
    spark = batch.sparkSession
    noted = spark.createDataFrame([], "number bigint, added bigint")
    try:
        noted = spark.read.schema(noted.schema).parquet(applied)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if not noted.filter(F.col("number") == number).isEmpty():
        return 0
    added = insert_ignore(table, batch)
    spark.createDataFrame([(number, added)], noted.schema).coalesce(1).write.mode("append").parquet(applied)
    return added


def _landmark(ts: Column, epoch: Column, half_life: float, span: float) -> Column:
    return F.floor(-days_since(ts, epoch) / F.lit(half_life * span))


def _landmark_time(number: Column, epoch: Column, half_life: float, span: float) -> Column:
    return F.timestamp_micros((F.unix_micros(epoch) + number * F.lit(half_life * span * DAY_MICROS)).cast("long"))


def stream_affinity(stream: DataFrame, epoch: Column, half_life: float = HALF_LIFE_DAYS, by: list[str] = [], span: float = SPAN) -> DataFrame:
    """(…, key, landmark, weight, play_count): decayed sums, each relative to its landmark.

    Landmarks lie ``span`` half-lives apart, from ``epoch`` on in both directions, and move on with the plays: no sum
    overflows, however far the epoch lies back.  Sums of parts of the plays add up to those of all.
    """
    number = _landmark(F.col("scrobbled_at"), epoch, half_life, span)
    weight = F.sum(decay_weight(F.col("scrobbled_at"), _landmark_time(F.col("landmark"), epoch, half_life, span), half_life))
    rows = stream.withColumn("landmark", number)
    return rows.groupBy(*by, "key", "landmark").agg(weight.alias("weight"), F.count(F.lit(1)).alias("play_count"))


def sink_affinity(stream: DataFrame, epoch: Column, out: str, checkpoint: str, half_life: float = HALF_LIFE_DAYS, by: list[str] = [], span: float = SPAN) -> None:
    """Keep ``stream_affinity`` below ``out``: a batch writes the sums of its own plays, and replaces its own folder.

    No state is kept, so a batch costs what its plays cost, however many keys came before.
    """

    def write(batch: DataFrame, number: int) -> None:
        with freed(batch.sparkSession):
            stream_affinity(batch, epoch, half_life, by, span).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(stream, "append", checkpoint, write)


def read_affinity(spark: SparkSession, out: str, epoch: Column, ref: Column, half_life: float = HALF_LIFE_DAYS, by: list[str] = [], span: float = SPAN) -> DataFrame:
    """(…, key, weight, play_count) as of ``ref``: every batch's sums, moved from their landmarks by one factor, added up."""
    moved = F.col("weight") * decay_weight(_landmark_time(F.col("landmark"), epoch, half_life, span), ref, half_life)
    rows = spark.read.parquet(out).select(*by, "key", moved.alias("weight"), "play_count")
    return rows.groupBy(*by, "key").agg(F.round(F.sum("weight"), 6).alias("weight"), F.sum("play_count").alias("play_count"))


CHANGE = "source string, captured_at date, source_id string, change_type string, opener string"


class _CaptureDiff(StatefulProcessor):
    """State of a source: its last two captures' days, and of each show the last capture that lists it and its openers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shows = handle.getMapState("shows", "source_id string", "captured_at date, openers array<string>")
        self.runs = handle.getValueState("runs", "last date, before date")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, before = self.runs.get() if self.runs.exists() else (None, None)
        known: dict[str, tuple] = {}
        out = []
        for day, shows in pd.concat(list(rows)).sort_values(["captured_at", "source_id"], kind="stable").groupby("captured_at", sort=True):
            if last is not None and day < last:
                raise ValueError(f"capture {day} of {key[0]} came after {last}")
            if day != last:
                last, before = day, last
            for show, openers in zip(shows["source_id"], shows["openers"]):
                openers = list(dict.fromkeys(openers)) if openers is not None else []
                then = known.get(show) or (self.shows.getValue((show,)) if self.shows.containsKey((show,)) else None)
                if then is None or then[0] != before:
                    out.append((key[0], day, show, "new_event", ""))
                else:
                    out += [(key[0], day, show, "opener_added", o) for o in openers if o not in set(then[1])]
                known[show] = (day, openers)
        for show, state in known.items():
            self.shows.updateValue((show,), state)
        self.runs.update((last, before))
        yield pd.DataFrame(out, columns=["source", "captured_at", "source_id", "change_type", "opener"])

    def close(self) -> None:
        pass


def stream_snapshot_diff(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write changes of each capture against the one before of its source, as captures arrive in order.

    Each micro-batch holds whole captures.  The last openers of every show are a map per source in state on disk, of
    which a capture touches its own shows; sources that don't arrive cost nothing.  A show that left out a capture is
    new again.  A batch that runs again replaces its own folder.
    """
    rows = stream.select("source", "captured_at", "source_id", "openers")
    changes = rows.groupBy("source").transformWithStateInPandas(_CaptureDiff(), CHANGE, "Update", "None")
    _drain_on_disk(changes, checkpoint, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/changes/batch={i}"))


def diff_all(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Changes of every capture in ``rows`` against the one before (source, captured_at, event_source_id, kind, opener)."""
    runs = rows.select("source", "captured_at").distinct()
    runs = runs.withColumn("before", F.lag("captured_at").over(Window.partitionBy("source").orderBy("captured_at")))
    if wanted is not None:
        runs = runs.join(wanted.select("source", "captured_at").distinct(), ["source", "captured_at"], "left_semi")
    curr = rows.join(runs, ["source", "captured_at"])
    prev = rows.select("source", F.col("captured_at").alias("before"), "source_id", F.col("openers").alias("then"))
    both = curr.join(prev, ["source", "before", "source_id"], "left")
    new = both.filter(F.col("then").isNull()).select("source", "captured_at", "source_id", F.lit("new_event").alias("change_type"), F.lit("").alias("opener"))
    added = both.filter(F.col("then").isNotNull()).select("source", "captured_at", "source_id", F.lit("opener_added").alias("change_type"), F.explode(F.array_except("openers", "then")).alias("opener"))
    return new.unionByName(added)


def stream_source_health(stream: DataFrame, out: str, checkpoint: str, window: int = TRAILING_RUNS, drop: float = DROP_SHARE, least: int = LEAST_RUNS) -> None:
    """Write the health of each run (source, captured_at, n) as runs of a source arrive in order.

    The state of a source is its last ``window`` counts and its last success, whatever the number of runs so far.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, good = state.get if state.exists else ("", None)
        counts = [int(n) for n in held.split(",") if n]
        rows = []
        for run in pd.concat(list(frames)).sort_values("captured_at").itertuples():
            mean, n = (sum(counts) / len(counts) if counts else None), int(run.n)
            if n and not (len(counts) >= least and mean > 0 and n < mean * (1 - drop)):
                good = run.captured_at
            known, counts = len(counts), [*counts, n][-window:]
            rows.append((key[0], run.captured_at, good, n, counts, known, mean))
        state.update((",".join(map(str, counts)), good))
        yield pd.DataFrame(rows, columns=["source", "captured_at", "last_success_at", "last_event_count", "trailing_counts", "known", "mean"])

    schema = "source string, captured_at date, last_success_at date, last_event_count bigint, trailing_counts array<bigint>, known int, mean double"
    runs = stream.select("source", "captured_at", "n").groupBy("source")
    found = runs.applyInPandasWithState(step, schema, "counts string, last_success_at date", "append", GroupStateTimeout.NoTimeout)
    reason = anomaly(F.col("last_event_count"), F.col("known"), F.col("mean"), drop, least)
    judged = found.withColumn("anomaly_reason", reason).withColumn("anomaly_flag", F.col("anomaly_reason").isNotNull()).drop("known", "mean")
    drain(judged, "append", checkpoint, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/health/batch={i}"))
