"""A table of newest rows by key that a stream keeps up to date by its changes.

A micro-batch brings the keys that changed. They are written as a delta, by hash bucket of the key; nothing else is
touched. When a bucket's deltas hold more than a share of its base, that bucket alone is merged into a new version of
its base. So what is written stays in proportion to what changed, whatever the number of keys. A reader takes the
newest committed base of every bucket and the deltas after it.

A repeated batch overwrites its own delta and its own version, and a version counts once its commit row is written, so
a restart leaves no half-written state behind. Superseded versions and merged deltas are removed after the commit.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hazeline.session import remove_path


class KeyedTable:
    """Newest row per key below ``path``; ``share`` of a bucket's base, or ``least`` rows, wait in deltas at most."""

    def __init__(self, spark: SparkSession, path: str, key: str = "sensor_id", buckets: int = 64, share: float = 0.25,
                 least: int = 10_000):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.share, self.least = buckets, share, least

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if any(text in str(error) for text in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                return None
            raise

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _bases(self) -> dict[int, int]:
        """The newest committed version of each bucket that has one: at most one entry per bucket."""
        commits = self._read("commits")
        if commits is None:
            return {}
        newest = commits.groupBy("bucket").agg(F.max("version").alias("version"))
        return {r["bucket"]: r["version"] for r in newest.collect()}

    def _current(self, bases: dict[int, int], among: Column | None = None) -> DataFrame | None:
        """Base rows (batch -1) and later deltas of all buckets, or of those that ``among`` accepts."""
        parts = []
        base, delta = self._read("base"), self._read("delta")
        if base is not None and bases:
            chosen = F.struct("version", "bucket").isin([F.struct(F.lit(v), F.lit(b)) for b, v in bases.items()])
            parts.append(base.where(chosen).drop("version").withColumn("batch", F.lit(-1).cast("long")))
        if delta is not None:
            since = F.lit(-1)
            for bucket, version in bases.items():
                since = F.when(F.col("bucket") == bucket, version).otherwise(since)
            parts.append(delta.where(F.col("batch") > since).withColumn("batch", F.col("batch").cast("long")))
        if not parts:
            return None
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out if among is None else out.where(among)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "batch")]
        return (rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
                .select(self.key, "_row.*"))

    def read(self, schema: StructType | None = None) -> DataFrame:
        """One row per key, the newest. While there is no row yet: no rows of ``schema``, or an error without it."""
        rows = self._current(self._bases())
        if rows is None and schema is not None:
            return self.spark.createDataFrame([], schema)
        if rows is None:
            raise FileNotFoundError(f"no row has been written below {self.path}")
        return self._newest(rows).drop("bucket")

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Take in the changed rows of one micro-batch, each key once."""
        delta = f"{self.path}/delta/batch={batch_id}"
        changed.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(delta)
        bases = self._bases()
        rows = self._current(bases)
        if rows is None:
            return
        sizes = rows.groupBy("bucket").agg(F.count_if(F.col("batch") < 0).alias("base"), F.count_if(F.col("batch") >= 0).alias("waiting"))
        full = F.col("waiting") > F.greatest(F.lit(self.least), F.col("base") * self.share)
        due = sorted(r["bucket"] for r in sizes.where(full).collect())
        if due:
            self._merge(due, bases, batch_id)

    def _merge(self, due: list[int], bases: dict[int, int], batch_id: int) -> None:
        merged = self._newest(self._current(bases, F.col("bucket").isin(due)))
        base = f"{self.path}/base/version={batch_id}"
        merged.repartition(len(due), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(base)
        commit = self.spark.createDataFrame([(b,) for b in due], "bucket int")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={batch_id}")
        self._remove_superseded(self._bases())

    def _remove_superseded(self, bases: dict[int, int]) -> None:
        """Base buckets of older versions, and deltas that every bucket's base holds; a few folder names."""
        base, delta = self._read("base"), self._read("delta")
        for r in base.select("version", "bucket").distinct().collect():
            if r["version"] < bases.get(r["bucket"], -1):
                remove_path(self.spark, f"{self.path}/base/version={r['version']}/bucket={r['bucket']}")
        if delta is not None:
            for r in delta.select("batch", "bucket").distinct().collect():
                if r["batch"] <= bases.get(r["bucket"], -1):
                    remove_path(self.spark, f"{self.path}/delta/batch={r['batch']}/bucket={r['bucket']}")


def run_updates(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Process everything available in update mode: each micro-batch hands over the keys that changed."""
    (stream.writeStream.outputMode("update").foreachBatch(table.write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
