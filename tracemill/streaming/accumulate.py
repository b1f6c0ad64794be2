"""A keyed table that grows by micro-batches: the latest row of each key, and a log of the batches applied."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path

_LOG = "batch long, version long, parts array<string>"


class LatestTable:
    """The latest row of each key, in a folder of the shared store.

    A batch writes only its own rows, reduced to one a key, under a fresh name, and then
    a line of the log that names all parts of the new version. What has no line in the
    log is not part of the table, and a batch whose number the log has is not applied
    again, so a batch that is replayed, or run twice after a loss, changes nothing. Every
    ``compact`` versions the parts become one. Reading takes the greatest ``order`` of each
    key over the parts; ties are taken by the later version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str, compact: int = 8) -> None:
        self.spark, self.path, self.keys, self.order, self.compact = spark, path.rstrip("/"), keys, order, compact
        self.schema = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
        try:
            self.log()
        except AnalysisException:  # no such folder: the log begins with a version without parts
            self._note(-1, 0, [])

    def _note(self, batch: int, version: int, parts: list[str]) -> None:
        line = self.spark.createDataFrame([(batch, version, parts)], _LOG)
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        """batch, version, parts: a row for each batch applied, the first without a batch."""
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")

    def _last(self) -> tuple[int, list[str]]:
        row = self.log().orderBy(F.desc("version"), F.desc("batch")).first()
        return row.version, list(row.parts)

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(self.order, "_version"))
        return rows.groupBy(*self.keys).agg(best.alias("_r")).select(*self.keys, "_r.*").select(*self.schema.fieldNames())

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in parts])

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Merge a batch by its number; a function for ``foreachBatch``."""
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return
        version, parts = self._last()
        at = shared_path(self.spark, "latest")
        self._latest(rows.withColumn("_version", F.lit(version + 1).cast("long"))).write.parquet(at)
        parts = [*parts, at]
        if len(parts) >= self.compact:
            whole = shared_path(self.spark, "latest")
            self._latest(self._read(parts)).write.parquet(whole)
            parts = [whole]
        self._note(batch, version + 1, parts)

    def read(self) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self._read(self._last()[1])).drop("_version")


def accumulate(source: DataFrame, keys: list[str], order: str, path: str, checkpoint: str | None = None) -> LatestTable:
    """Merge what a stream has now into the table at ``path``; the stream's own checkpoint keeps its place."""
    spark = source.sparkSession
    table = LatestTable(spark, path, source.schema, keys, order)
    query = source.writeStream.option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/stream").trigger(availableNow=True).foreachBatch(table.apply).start()
    query.awaitTermination()
    return table
