"""Tables on disk that are upserted by rewriting only the partitions that change.

A table is parquet, partitioned by one column that follows from the key (a play's day, a show's source).  An upsert
reads the partitions of the incoming rows alone, by pruning at run time, finds out which of them change, and overwrites
those; a second run with the same rows changes no file.  A lost executor costs tasks; a partition is replaced when the
whole job has been written.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.operators import upserts
from gigmatch.sources.shared import bounded, materialise


@dataclass(frozen=True)
class StoredTable:
    """``schema`` lists the columns besides the partition's, ``key`` those that are unique together.

    ``of`` gives the partition ``by`` (of type ``kind``) from the key's columns; rows for which it is null lie in ``rest``.
    """

    path: str
    schema: str
    key: list[str] = field(default_factory=list)
    by: str = "day"
    of: str = "to_date(scrobbled_at)"
    kind: str = "date"
    rest: str = "date'0001-01-01'"

    def columns(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.schema).columns

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows with their partition; none if nothing was stored yet."""
        schema = f"{self.schema}, {self.by} {self.kind}"
        try:
            return spark.read.schema(schema).option("mergeSchema", "false").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def read_partitions(self, parts: DataFrame) -> DataFrame:
        """Rows of the partitions in ``parts`` (of ``partitions``); others aren't opened."""
        return self.read(parts.sparkSession).join(picked(parts), self.by, "left_semi")

    def placed(self, rows: DataFrame) -> DataFrame:
        part = F.coalesce(F.expr(self.of), F.expr(self.rest)).cast(self.kind)
        return rows.withColumn(self.by, part)

    def replace(self, rows: DataFrame) -> None:
        """``rows`` (with ``by``) in the place of all that their partitions held; few files each, more for large ones."""
        rows.hint("rebalance", self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)


def partitions(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The partitions of ``rows``, written once."""
    return materialise(rows.select(*by).distinct().withColumn("wanted", F.lit(1)), name)


def picked(parts: DataFrame) -> DataFrame:
    """``parts`` as the side of a join that prunes a scan at run time: Spark does so beside a filter only."""
    return bounded(parts.filter("wanted = 1").drop("wanted"))


def insert_ignore(table: StoredTable, incoming: DataFrame) -> int:
    """Adds the incoming rows whose key isn't stored, and says how many; stored rows stay as they are.

    Of incoming rows that share a key the first in the order of their other columns counts (nulls last).
    """
    columns = table.columns(incoming.sparkSession)
    staged = materialise(table.placed(upserts.first_of_key(incoming.select(*columns), table.key)), "stored-incoming")
    there = table.read_partitions(partitions(staged, [table.by], "stored-parts"))
    on = [table.by, *table.key]
    known = there.select(*[F.col(c).alias(f"_{c}") for c in on])
    same = reduce(lambda a, b: a & b, [F.col(table.by) == F.col(f"_{table.by}"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in table.key]])
    fresh = materialise(staged.join(known, same, "left_anti"), "stored-fresh")
    added = fresh.count()
    if added:
        kept = table.read_partitions(partitions(fresh, [table.by], "stored-changed"))
        table.replace(kept.unionByName(fresh))
    return added


def update(table: StoredTable, incoming: DataFrame, columns: list[str], when: dict[str, Column] | None = None) -> int:
    """Inserts the rows of new keys and overwrites ``columns`` of stored ones; says how many rows are new or differ.

    ``when`` holds a column's update back where its condition is false, as in ``upserts.upsert_update``.  Of incoming
    rows that share a key the first in the order of their other columns counts (nulls last).
    """
    names = table.columns(incoming.sparkSession)
    staged = materialise(table.placed(upserts.first_of_key(incoming.select(*names), table.key)), "stored-incoming")
    there = table.read_partitions(partitions(staged, [table.by], "stored-parts"))
    merged = materialise(upserts.merged(there, staged, [table.by, *table.key], columns, when), "stored-merged")
    changed = merged.filter("_changed")
    n = changed.count()
    if n:
        parts = partitions(changed, [table.by], "stored-changed")
        table.replace(merged.join(picked(parts), table.by, "left_semi").select(*names, table.by))
    return n
