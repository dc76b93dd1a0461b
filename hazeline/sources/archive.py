"""Monthly CSV archives with a leading ``SET`` line.

Files may differ in header. One pass over the lines finds the header of every file; the headers are a table that meets
the lines of its file in a join, and each line's cells are picked by name from the positions in that table. So a scan
takes the same number of jobs whatever the number of files, and nothing but the file listing and the distinct column
names reaches the driver. A month may be one file or, as ``write_archive`` leaves it, a folder of part files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hazeline.functions import constants as K
from hazeline.functions.columns import align_key, parse_time, quoted, resolve_value
from hazeline.functions.numeric import null_if_nan
from hazeline.operators.filters import drop_negative, only_sensors, pm25_parameter_only, since, valid_readings, year_span
from hazeline.operators.joins import MAX_BROADCAST_ROWS, attach
from hazeline.operators.latest import keep_first
from hazeline.session import materialized

FILE_PATTERN = "{measurements_,file=measurements_}*.csv"
_PART_OF_MONTH = r"(/(?:file=)?measurements_[^/]*\.csv)/[^/]*$"
_PERIOD = r"^measurements_([0-9]+)_([0-9]+)\.csv$"
MARKER = "SET"
ON_BAD = ("fail_file", "skip_row", "permissive")
# A first line whose cells all start like this is a header.
HEADER_CELL = re.compile(r"^(date|sensor|pm|time)")
# a comma outside double quotes
_UNQUOTED_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_NUMBER_COLUMNS = {"latitude", "longitude", "altitude", "temperature", "humidity", "pressure"}
_NUMBER_FORM = re.compile(r"^(pm|p)[0-9]", re.I)
_KEY_COLUMNS = {"sensor_id", "id"}


def _month_of(path: Column) -> Column:
    """The monthly file that a path is, or is a part of."""
    return F.regexp_replace(path, _PART_OF_MONTH, "$1")


def _file_name(path: Column) -> Column:
    """The name of a monthly file, without the ``file=`` of a partition folder."""
    return F.regexp_extract(path, "(?:file=)?([^/]+)$", 1)


def file_inventory(spark: SparkSession, measurements_dir: str) -> DataFrame:
    """One row per file named like a measurement file; year and month are NULL when not in the name."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = listed.load(f"{measurements_dir}/{FILE_PATTERN}").select("path", "length")
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        try:  # a folder without such files has none; no folder is an error
            files = listed.load(measurements_dir).select("path", "length").where(F.lit(False))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                raise FileNotFoundError(f"measurements directory not found: {measurements_dir}") from missing
            raise
    months = files.groupBy(_month_of(F.col("path")).alias("path")).agg(F.sum("length").alias("length"))
    name = _file_name(F.col("path"))
    return months.select(
        name.alias("filename"),
        F.regexp_extract(name, _PERIOD, 1).try_cast("int").alias("year"),
        F.regexp_extract(name, _PERIOD, 2).try_cast("int").alias("month"),
        "path", "length", F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), F.lit(True).alias("exists"))


def select_files(inventory: DataFrame, first: int, last: int, months: Iterable[int] | None = None) -> DataFrame:
    """Files of the year range and months, by name only."""
    chosen = inventory.where(F.col("year").between(first, last) & F.col("month").isNotNull())
    return chosen if months is None else chosen.where(F.col("month").isin(list(months)))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their part file and place: block, then a number that grows within the block."""
    return spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', ""))


def file_headers(spark: SparkSession, paths: Sequence[str], allow_headerless: bool = False) -> DataFrame:
    """One row per part file, ``_part``, its ``cells`` and whether a header line is ``present``.

    The header is the first line that is neither blank nor a marker. Each task keeps the least such line of a file by
    (block, place in the block), so one row per file and task is shuffled. With ``allow_headerless`` a first line of
    which some cell does not begin like a header and some cell is a number is data: columns are called ``col_i``.
    """
    return _headers(_lines(spark, paths), allow_headerless)


def _headers(lines: DataFrame, allow_headerless: bool) -> DataFrame:
    text = F.trim(F.regexp_replace("value", "\ufeff", ""))
    lines = lines.withColumn("_text", text).where((F.col("_text") != "") & (F.col("_text") != MARKER))
    firsts = lines.groupBy("_part").agg(F.min_by("_text", F.struct("_block", "_line")).alias("_text"))
    cells = F.col("cells")
    headless = F.lit(False)
    if allow_headerless:
        headless = (~F.forall(cells, lambda c: c.rlike(HEADER_CELL.pattern))
                    & F.exists(cells, lambda c: c.rlike("^[-+0-9.eE]+$")))
    numbered = F.transform(cells, lambda c, i: F.concat(F.lit("col_"), i.cast("string")))
    return (firsts.select("_part", _cells(F.col("_text")).alias("cells")).withColumn("present", ~headless)
            .withColumn("cells", F.when(F.col("present"), cells).otherwise(numbered)))


def read_header(spark: SparkSession, path: str, allow_headerless: bool = False) -> tuple[tuple[str, ...], bool]:
    """Column names of one file and whether a header line is present."""
    found = file_headers(spark, [path], allow_headerless).first()
    return (tuple(found["cells"]), found["present"]) if found else ((), False)


def _token_count(line: Column) -> Column:
    plain = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) + 1
    return F.when(F.contains(line, F.lit('"')), F.size(F.split(line, _UNQUOTED_COMMA))).otherwise(plain)


def _typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast what is known to be numeric, and leave every other column as text.

    Ids go straight to long, so that no digit is lost; ``12.0`` is read as 12. Unreadable cells and NaN become NULL.
    """
    def cast(name: str) -> Column:
        text = quoted(name)
        if name in _KEY_COLUMNS:
            whole = F.regexp_extract(text, r"^\s*([-+]?[0-9]+)(?:\.0*)?\s*$", 1)
            return whole.try_cast("long").alias(name)
        if name in _NUMBER_COLUMNS or _NUMBER_FORM.match(name):
            return null_if_nan(text.try_cast("double")).alias(name)
        return text
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[cast(c) for c in columns], *kept)


def first_lines_per_file(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` data lines of each file, in file order (block offset, then position in the block)."""
    place = W.partitionBy("_file").orderBy("_part", "_block", "_line")
    return lines.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= n).drop("_rn")


def _column_names(headers: DataFrame) -> list[str]:
    """Distinct names in order of their first place in any header; spellings that differ in case are one."""
    named = headers.select(F.posexplode("cells").alias("at", "name")).where("name <> ''")
    first = named.groupBy(F.lower("name").alias("plain")).agg(F.min(F.struct("at", "name")).alias("first"))
    return [r["name"] for r in first.select("first.at", "first.name").orderBy("at", "name").collect()]


def _with_forms(lines: DataFrame, headers: DataFrame, names: Sequence[str]) -> DataFrame:
    """Data lines with their monthly file and its period, the width of its header and the place of every name in it
    (-1: not there). All of that is found once for each part file, not for each line.

    Blank lines, markers and header lines, however spaced or quoted, go.
    """
    def bare(text: Column) -> Column:
        return F.lower(F.regexp_replace(text, r'[\s"\x{FEFF}]', ""))

    plain = F.transform("cells", F.lower)
    file = _month_of(F.col("_part"))
    forms = headers.select(
        "_part", file.alias("_file"), *[F.regexp_extract(_file_name(file), _PERIOD, i).try_cast("int").alias(n)
                                        for i, n in ((1, "_year"), (2, "_month"))], F.size("cells").alias("_width"), F.when(F.col("present"), bare(F.array_join("cells", ","))).alias("_header"),
        F.array(*[F.array_position(plain, n.lower()).cast("int") - 1 for n in names]).alias("_at"))
    body = F.trim("value")
    rows = lines.where((body != "") & (body != MARKER)).join(forms, "_part")
    return rows.where(F.col("_header").isNull() | (bare(F.col("value")) != F.col("_header"))).drop("_header")


def _parsed(rows: DataFrame, names: Sequence[str], width: int) -> DataFrame:
    """``_file`` and its period, ``_too_long`` and a text column per name, each cell picked from where its file has it.

    The cells come out of a generator, below which no filter on them is pushed: a line is taken apart once, however
    often its cells are tested and read.
    """
    raw = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    cells = F.transform(F.array(raw), lambda r: F.array(*[r.getField(f"c{i}") for i in range(width)]))
    picked = F.transform(cells, lambda c: F.struct(*[F.get(c, F.get("_at", F.lit(k))).alias(n) for k, n in enumerate(names)]))
    rows = rows.withColumn("_too_long", _token_count(F.col("value")) > F.col("_width"))
    return rows.select("_file", "_year", "_month", "_too_long", F.inline(picked))


def scan_csv(spark: SparkSession, paths: Sequence[str], on_bad: str = "fail_file", nrows_per_file: int | None = None,
             sample: float | None = None, seed: int = 7, allow_headerless: bool = False) -> DataFrame:
    """Parse archive files; short rows are padded with NULL.

    A row is bad when it has more cells than the header. ``fail_file`` drops every row of a file with
    a bad row or an unreadable timestamp, ``skip_row`` drops the bad rows, ``permissive`` cuts the
    extra cells. The headers are found in a pass of their own and written once; they are joined to the lines like any
    table, so Spark broadcasts them while they are small. The result keeps ``_file``.
    """
    return _scanned(spark, paths, on_bad, nrows_per_file, sample, seed, allow_headerless).drop("_year", "_month")


def _scanned(spark: SparkSession, paths: Sequence[str], on_bad: str = "fail_file", nrows_per_file: int | None = None,
             sample: float | None = None, seed: int = 7, allow_headerless: bool = False) -> DataFrame:
    """As ``scan_csv``, with ``_year`` and ``_month`` from the name of the file."""
    if on_bad not in ON_BAD:
        raise ValueError(f"unknown on_bad: {on_bad}; expected one of {ON_BAD}")
    paths = list(paths)
    lines = _lines(spark, paths) if paths else None
    headers = materialized(_headers(lines, allow_headerless), "headers") if paths else None
    names = _column_names(headers) if paths else []
    if not names:
        return spark.createDataFrame([], "_file string, _year int, _month int, timestamp string, sensor_id long, pm25 double")
    width = headers.agg(F.max(F.size("cells"))).first()[0]
    lines = _with_forms(lines, headers, names)
    if sample:
        lines = lines.sample(fraction=sample, seed=seed)
    if nrows_per_file is not None:
        lines = first_lines_per_file(lines, nrows_per_file)
    rows = _parsed(lines, names, width)
    if on_bad == "skip_row":
        rows = rows.where(~F.col("_too_long"))
    elif on_bad == "fail_file":
        bad = F.col("_too_long")
        if "timestamp" in names:
            stamp = F.col("timestamp")
            bad = bad | (stamp.isNotNull() & F.try_to_timestamp(stamp).isNull())
        rejected = rows.where(bad).select("_file").distinct()
        # never more rows than files were listed, so the size of this side is known
        small = len(paths) <= MAX_BROADCAST_ROWS
        rows = rows.join(F.broadcast(rejected) if small else rejected, "_file", "left_anti")
    return _typed(rows.drop("_too_long"), names)


def rejected_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Which files ``fail_file`` leaves out, with the number of offending rows."""
    whole = scan_csv(spark, paths, on_bad="permissive")
    kept = scan_csv(spark, paths, on_bad="fail_file")
    names = whole.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(kept.select("_file").distinct(), "_file", "left_anti").withColumnRenamed("_file", "path")


def _with_period(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.col("_year")).withColumn("month", F.col("_month")).drop("_file", "_year", "_month")


def scan_hourly_snapshot(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Landed hourly files: marker line optional, ``datetime`` added, value copied to ``pm25``."""
    raw = scan_csv(spark, paths, on_bad="permissive").drop("_file")
    if "timestamp" in raw.columns:
        raw = raw.withColumn("datetime", F.try_to_timestamp("timestamp"))
    return resolve_value(raw, "canonical", keep_source=True)


class Archive:
    """A data directory: ``measurements/measurements_YYYY_MM.csv`` and ``sensors.csv``."""

    def __init__(self, spark: SparkSession, data_dir: str, station_kind: str = "auto"):
        """``station_kind``: "long" or "string" fix the type of station ids; "auto" looks whether all are numbers."""
        if station_kind not in ("auto", "long", "string"):
            raise ValueError(f"unknown station kind: {station_kind}")
        self.spark, self.station_kind = spark, station_kind
        self.data_dir = data_dir.rstrip("/")
        self.measurements_dir = f"{self.data_dir}/measurements"
        self.sensors_file = f"{self.data_dir}/sensors.csv"

    def inventory(self) -> DataFrame:
        return file_inventory(self.spark, self.measurements_dir)

    def _paths(self, first: int, last: int, months, inventory: DataFrame | None = None) -> list[str]:
        """File names of the period: a listing of one entry per month, not data."""
        chosen = select_files(self.inventory() if inventory is None else inventory, first, last, months).orderBy("year", "month")
        return [r["path"] for r in chosen.select("path").collect()]

    def sensors(self, variant: str = "canonical") -> DataFrame:
        """Sensor metadata under its standard names; the legacy form keeps one row per sensor."""
        try:
            raw = self.spark.read.option("header", True).csv(self.sensors_file)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                raise FileNotFoundError(f"sensors file not found: {self.sensors_file}") from err
            raise
        typed = _typed(raw, raw.columns)
        if "station_id" in typed.columns and self.station_kind != "string":
            whole = quoted("station_id").try_cast("long")
            text = typed.where(whole.isNull() & quoted("station_id").isNotNull())  # such as "ST-1"
            if self.station_kind == "long" or text.isEmpty():
                typed = typed.withColumn("station_id", whole)
        if variant == "legacy":
            if "sensor_id" in typed.columns:
                typed = keep_first(typed, ["sensor_id"], [c for c in typed.columns if c != "sensor_id"])
            else:
                typed = typed.dropDuplicates()
        renames = {k: v for k, v in K.SENSOR_RENAMES[variant].items() if k in typed.columns}
        return typed.withColumnsRenamed(renames)

    def measurements(self, start_year: int, end_year: int | None = None, months: Sequence[int] | None = None,
                     sensors: Sequence[int] | None = None, nrows_per_file: int | None = None,
                     on_bad: str = "fail_file") -> DataFrame:
        """Rows of the months asked for, with year, month, datetime, date and hour.

        ``months=[]`` selects none. The first-rows limit applies before the sensor filter.
        """
        last = start_year if end_year is None else end_year
        files = self.inventory()
        if files.isEmpty():
            raise FileNotFoundError(f"no measurement files in {self.measurements_dir}")
        paths = self._paths(start_year, last, months, files)
        rows = _with_period(_scanned(self.spark, paths, on_bad, nrows_per_file))
        # files with an unreadable time are already out; a strict cast could still be run on them early
        return only_sensors(parse_time(rows, strict=False), sensors)

    def measurements_legacy(self, start_year: int, end_year: int | None = None, months: Sequence[int] | None = None,
                            sensors: Sequence[int] | None = None, sample: float | None = None, seed: int = 7,
                            ordered: bool = True) -> DataFrame:
        """S3: as S2 with a random row sample; sorted by date; ``months=[]`` means all; no file is an error."""
        last = start_year if end_year is None else end_year
        paths = self._paths(start_year, last, months or None)
        if not paths:
            raise ValueError(f"no measurement files for {start_year}-{last}")
        rows = scan_csv(self.spark, paths, "fail_file", sample=sample, seed=seed).drop("_file")
        rows = only_sensors(parse_time(rows, "legacy", strict=False), sensors)
        return rows.orderBy("date", "sensor_id") if ordered and "date" in rows.columns else rows

    def measurements_tolerant(self, start_year: int, end_year: int | None = None,
                              months: Sequence[int] | None = None, nrows_per_file: int | None = None) -> DataFrame:
        """Bad rows are skipped, unreadable times become NULL, files without header get ``col_i`` names."""
        last = start_year if end_year is None else end_year
        paths = self._paths(start_year, last, months)
        rows = _scanned(self.spark, paths, "skip_row", nrows_per_file, allow_headerless=True)
        return parse_time(_with_period(rows), "tolerant")

    def quick_sample(self, year: int = 2025, month: int = 1, nrows: int = 10_000) -> DataFrame:
        """The first rows of one month."""
        return self.measurements_tolerant(year, year, [month], nrows)

    def recent(self, days: int = 30, as_of=None, ordered: bool = True) -> DataFrame:
        """The last ``days`` days up to ``as_of`` (default: now), from the files of all months they touch."""
        end = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
        files = self.inventory().where(F.col("year").isNotNull() & F.col("month").isNotNull())
        if files.isEmpty():
            raise ValueError("no measurement files found")
        month = F.make_date("year", "month", F.lit(1))
        touched = files.where(month.between(F.trunc(end - F.make_dt_interval(F.lit(days)), "month"), F.to_date(end)))
        paths = [r["path"] for r in touched.orderBy("year", "month").select("path").collect()]
        if not paths:  # the columns of the newest file, without rows
            newest = files.orderBy(F.desc("year"), F.desc("month")).select("path").head(1)
            paths = [r["path"] for r in newest]
        rows = parse_time(scan_csv(self.spark, paths, "fail_file").drop("_file"), "legacy", strict=False)
        if "date" in rows.columns:
            rows = since(rows, end, days)
        return rows.orderBy("date", "sensor_id") if ordered and "date" in rows.columns else rows

    def pm25(self, years=2025, months: Sequence[int] | None = None, sensors: Sequence[int] | None = None,
             sample_size: int | None = None, include_metadata: bool = True, mode: str = "first",
             on_bad: str = "fail_file", strict_keys: bool = True) -> DataFrame:
        """Q9: standard PM2.5 rows, valid readings only, joined to the sensor metadata.

        P6: with metadata a valid reading or a sensor without a whole number as its id is an error, as joining them
        would hide it; ``strict_keys=False`` keeps such readings, without metadata.
        """
        first, last = year_span(years)
        rows = resolve_value(self.measurements(first, last, months, sensors, sample_size, on_bad), "canonical", mode)
        if "pm25" not in rows.columns:
            return rows
        rows = valid_readings(rows)
        if not include_metadata or "sensor_id" not in rows.columns:
            return rows
        known = self.sensors()
        if strict_keys:
            rows, known = align_key(rows), align_key(known)
        return attach(rows, known)

    def pm25_legacy(self, years=2025, include_metadata: bool = True, clean_negative: bool = True,
                    how: str = "left") -> DataFrame:
        """Q16: the older data set: parameter filter, optional drop of negatives, string keys."""
        first, last = year_span(years)
        rows = self.measurements_legacy(first, last, ordered=False)
        found = next((c for c in K.VALUE_COLUMNS["legacy"] if c in rows.columns), None)
        if found is None:
            return rows
        if "parameter" in rows.columns:
            rows = pm25_parameter_only(rows)
        rows = resolve_value(rows, "legacy")
        if clean_negative:
            rows = drop_negative(rows)
        if not include_metadata or "sensor_id" not in rows.columns:
            return rows
        text_key = F.col("sensor_id").cast("string")
        return attach(rows.withColumn("sensor_id", text_key),
                      self.sensors("legacy").withColumn("sensor_id", text_key), how=how)

    def pm25_tolerant(self, years=2025, sample_size: int | None = None) -> DataFrame:
        """Q17: the tolerant scan with valid PM2.5 readings."""
        first, last = year_span(years)
        rows = resolve_value(self.measurements_tolerant(first, last, nrows_per_file=sample_size), "tolerant")
        return valid_readings(rows) if "pm25" in rows.columns else rows

    def ingest(self, years, path: str, months: Sequence[int] | None = None, on_bad: str = "fail_file") -> None:
        """One pass from CSV to Parquet partitioned by year and month; later queries prune and push down."""
        from hazeline.sources.sinks import write_measurements

        first, last = year_span(years)
        rows = resolve_value(self.measurements(first, last, months, on_bad=on_bad), "canonical")
        write_measurements(rows, path)
