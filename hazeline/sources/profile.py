"""What is in the archive: summary and structure of its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazeline.sources.archive import MARKER, Archive

# Delimiters tried.
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


def archive_summary(archive: Archive, latest: int = 5) -> DataFrame:
    """One row with file count, total size, years, the last files by name, and the sensor metadata."""
    files = archive.inventory()
    totals = files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1 << 30), 2).alias("total_size_gb"),
        # years are a handful of small numbers
        F.sort_array(F.collect_set("year")).alias("years"))
    newest = files.orderBy(F.desc("filename")).limit(latest)
    last_files = newest.agg(F.sort_array(F.collect_list(F.struct("filename", "size_mb"))).alias("f")).scalar()
    out = totals.withColumn("latest_files", last_files).withColumn("data_directory", F.lit(archive.data_dir))
    try:
        sensors = archive.sensors()
    except FileNotFoundError:
        return out.withColumn("sensor_count", F.lit(None).cast("long")) \
                  .withColumn("sensor_columns", F.lit(None).cast("array<string>"))
    return (out.withColumn("sensor_count", sensors.agg(F.count(F.lit(1))).scalar())
               .withColumn("sensor_columns", F.array(*[F.lit(c) for c in sensors.columns])))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("_block")
    ).where((F.trim("value") != "") & (F.trim("value") != MARKER))


def structure_profile(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: lines, cells per line, consistency, cells per delimiter, encoding.

    ``filled`` counts non-empty comma-separated cells of a line. ``rows_after_skip`` are the data lines
    with no more cells than the header, the first line of the file.
    """
    cells = {name: F.size(F.split("value", d if d != "|" else r"\|")) for name, d in DELIMITERS.items()}
    filled = F.size(F.filter(F.split("value", ","), lambda c: F.trim(c) != ""))
    lines = _lines(spark, paths).withColumn("_line", F.monotonically_increasing_id())
    # first by file and line width, so the second step sees a few rows per file
    widths = lines.groupBy("filename", "size_bytes", cells["comma"].alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(filled).alias("min_filled"), F.max(filled).alias("max_filled"),
        *[agg(n).alias(f"{name}_{label}_cells") for name, n in cells.items()
          for label, agg in (("min", F.min), ("max", F.max))],
        F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"), _first_line())
    per_file = widths.groupBy("filename", "size_bytes").agg(
        F.sum("n").alias("lines"), F.min("min_filled").alias("min_filled"), F.max("max_filled").alias("max_filled"),
        *[agg(f"{name}_{label}_cells").alias(f"{name}_{label}_cells") for name in DELIMITERS
          for label, agg in (("min", F.min), ("max", F.max))],
        F.bool_and("valid_utf8").alias("valid_utf8"), F.min("first").alias("first"))
    per_file = per_file.withColumn("header", F.col("first.value")).drop("first")
    best = F.greatest(*[F.struct(F.col(f"{n}_min_cells").alias("cells"), F.lit(n).alias("name")) for n in DELIMITERS])
    header_width = per_file.select("filename", F.size(F.split("header", ",")).alias("_hw"))
    kept = widths.join(header_width, "filename").groupBy("filename").agg(
        (F.coalesce(F.sum(F.when(F.col("_w") <= F.col("_hw"), F.col("n"))), F.lit(0)) - 1).alias("rows_after_skip"))
    return (per_file.withColumn("inconsistent", F.col("min_filled") != F.col("max_filled"))
                    .withColumn("delimiter", F.when(best["cells"] > 1, best["name"]))
                    .withColumn("encoding", F.when(F.col("valid_utf8"), "utf-8").otherwise("latin1"))
                    .join(kept, "filename"))


def _first_line():
    """The earliest line of a group by block and position, a mergeable minimum."""
    return F.min(F.struct(F.col("_block").alias("block"), F.col("_line").alias("line"),
                          F.col("value").alias("value"))).alias("first")


def column_castability(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Per file and column position, the header cell and how many data cells read as numbers."""
    lines = _lines(spark, paths).withColumn("_line", F.monotonically_increasing_id())
    pattern = r"\|" if delimiter == "|" else delimiter
    number = F.trim("cell").try_cast("double")
    cells = lines.select("filename", F.posexplode(F.split("value", pattern)).alias("position", "cell"))
    stats = cells.groupBy("filename", "position").agg(
        F.count_if(F.trim("cell") != "").alias("cells"), F.count_if(number.isNotNull()).alias("numeric_cells"))
    # the first line is the header: its own cells are taken off again, on one row per file and column
    header = (lines.groupBy("filename").agg(_first_line())
              .select("filename", F.posexplode(F.split("first.value", pattern)).alias("position", "column"))
              .withColumn("_n", (F.trim("column") != "").cast("int"))
              .withColumn("_num", F.trim("column").try_cast("double").isNotNull().cast("int")))
    out = stats.join(header, ["filename", "position"], "left")
    return out.select("filename", "position", "column",
                      (F.col("cells") - F.coalesce("_n", F.lit(0))).alias("cells"),
                      (F.col("numeric_cells") - F.coalesce("_num", F.lit(0))).alias("numeric_cells")
                      ).withColumn("castable", F.col("numeric_cells") > 0)
