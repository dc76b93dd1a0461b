"""Writing results (S16-S18) and the partitioned measurement table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hazeline.session import materialized

# Fixed value: a task of an archive writer is given at least so many rows.
LEAST_ROWS = 10_000


def write_measurements(df: DataFrame, path: str, partitions: Sequence[str] = ("year", "month"),
                       mode: str = "overwrite") -> None:
    """Parquet partitioned by period; the rebalance hint splits big months and merges small ones.

    Overwriting replaces the periods that ``df`` holds and leaves all others as they are.
    """
    (df.hint("rebalance", *partitions).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The ingested table; filters on year and month prune directories."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result table as Parquet."""
    df.write.mode(mode).parquet(path)


def write_report(lines: DataFrame, path: str, order: Sequence[str] = ("section", "line_no"),
                 mode: str = "overwrite") -> None:
    """Report lines as text files; a range sort keeps the lines in order across the part files."""
    lines.orderBy(*order).select(F.coalesce("text", F.lit("")).alias("value")).write.mode(mode).text(path)


def _csv_cell(df: DataFrame, name: str):
    text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    if df.schema[name].dataType.simpleString() != "string":
        return text
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"]'), quoted).otherwise(text)


def write_archive(df: DataFrame, measurements_dir: str, forms: Sequence[Sequence[str]], ts: str = "timestamp",
                  rows_per_file: int = 1_000_000) -> None:
    """Readings as a monthly CSV archive with marker and header lines, which ``Archive`` reads back.

    Each month becomes a folder of part files named like the monthly file; months take the column lists of ``forms``
    in turn. A large month is dealt to several tasks, and tasks are numbered along the rows of all months, so a task sorts
    and writes less than twice ``rows_per_file`` rows however many there are. Header lines are rows of their own, without
    time, which sort before the others. Line breaks in text columns are not supported by the archive format.
    """
    year, month = F.year(ts), F.month(ts)
    rows = df.where(F.col(ts).isNotNull()).withColumn("_month", year * 12 + month)
    counts = rows.groupBy("_month").agg(F.count(F.lit(1)).alias("_n"), F.format_string(
        "measurements_%04d_%02d.csv", F.min(year), F.min(month)).alias("file"))
    # one row per month: a side of known, small size
    months = materialized(counts.withColumn("_parts", F.ceil(F.col("_n") / rows_per_file)).withColumn("_before", F.coalesce(
        F.sum("_n").over(W.orderBy("_month").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "months")
    total = months.agg(F.sum("_n")).first()[0] or 0
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min(rows_per_file, max(LEAST_ROWS, -(-total // shuffles)))

    def by_form(texts):
        form = F.pmod("_month", F.lit(len(forms)))
        return F.coalesce(*[F.when(form == i, text) for i, text in enumerate(texts)])

    def dealt(source, piece, time, texts):
        task = F.floor((F.col("_before") + piece * F.floor(F.col("_n") / F.col("_parts"))) / width).cast("int")
        return source.select(task.alias("_task"), F.coalesce("file", F.lit("")).alias("file"), time.alias("_ts"),
                             by_form(texts).alias("value"))

    lines = dealt(rows.join(F.broadcast(months), "_month"),
                  F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_parts")), F.col(ts),
                  [F.concat_ws(",", *[_csv_cell(df, c) for c in form]) for form in forms])
    heads = dealt(months.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))), F.col("_piece"),
                  F.lit(None).cast(df.schema[ts].dataType), [F.lit("SET\n" + ",".join(form)) for form in forms]).distinct()
    (lines.unionByName(heads).repartitionById(max(1, -(-total // width)), F.col("_task"))
     .sortWithinPartitions("file", "_ts", "value").select("file", "value").write.partitionBy("file").text(measurements_dir))
