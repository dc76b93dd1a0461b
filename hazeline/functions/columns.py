"""Picking and preparing the columns of a measurement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hazeline.functions import constants as K


def quoted(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col(f"`{name}`")


def find_value_column(columns, variant: str = "canonical") -> str | None:
    """First candidate present; the tolerant list also takes any name containing ``pm25``."""
    for name in K.VALUE_COLUMNS[variant]:
        if name in columns:
            return name
    if variant == "tolerant":
        return next((c for c in columns if "pm25" in c.lower()), None)
    return None


def resolve_value(df: DataFrame, variant: str = "canonical", mode: str = "first", keep_source: bool = False) -> DataFrame:
    """Give the PM2.5 column its standard name ``pm25``.

    ``first`` uses only the first candidate present, as the archive loader does; ``coalesce``
    falls back row by row to the later candidates. Without any candidate the frame is unchanged.
    ``keep_source`` copies instead of renaming (S14).
    """
    source = find_value_column(df.columns, variant)
    if source is None:
        return df
    if mode == "coalesce":
        present = [c for c in K.VALUE_COLUMNS[variant] if c in df.columns] or [source]
        merged = df.withColumn("_value", F.coalesce(*[quoted(c) for c in present]))
        return merged.drop(*present).withColumnRenamed("_value", "pm25")
    if mode != "first":
        raise ValueError(f"unknown mode: {mode}")
    if source == "pm25":
        return df
    if keep_source:
        return df.withColumn("pm25", quoted(source))
    return df.drop("pm25").withColumnRenamed(source, "pm25")


def detect_value_column(df: DataFrame) -> str:
    """First column that looks like PM2.5 and does not mention 10."""
    for name in df.columns:
        plain = name.lower().strip()
        if K.VALUE_NAME_EXCLUDED not in plain and any(f in plain for f in K.VALUE_NAME_FRAGMENTS):
            return name
    raise ValueError(f"no PM2.5 column among {df.columns}")


def parse_time(df: DataFrame, variant: str = "canonical", strict: bool = True) -> DataFrame:
    """Parse the time column.

    canonical: ``timestamp`` -> ``datetime`` plus ``date`` and ``hour``, strict;
    legacy: ``date`` in place, else ``timestamp`` -> ``date`` with the source dropped, strict;
    tolerant: first of the candidate names -> ``date``, unparsable becomes NULL, source dropped.
    ``strict=False`` turns unparsable into NULL in every form.
    """
    def parsed(name: str) -> Column:
        return F.col(name).cast("timestamp") if strict else F.try_to_timestamp(F.col(name).cast("string"))

    if variant == "canonical":
        if "timestamp" not in df.columns:
            return df
        return with_calendar(df.withColumn("datetime", parsed("timestamp")))
    if variant == "legacy":
        if "date" in df.columns:
            return df.withColumn("date", parsed("date"))
        if "timestamp" in df.columns:
            return df.withColumn("date", parsed("timestamp")).drop("timestamp")
        return df
    if variant == "tolerant":
        for name in K.TIME_COLUMNS_TOLERANT:
            if name in df.columns:
                out = df.withColumn("date", F.try_to_timestamp(F.col(name).cast("string")))
                return out if name == "date" else out.drop(name)
        return df
    raise ValueError(f"unknown variant: {variant}")


def with_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """``date`` and ``hour`` of a timestamp."""
    return df.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts))


def align_key(df: DataFrame, key: str = "sensor_id", kind: str = "int") -> DataFrame:
    """Key as bigint (a missing or non-numeric key is an error) or as string (legacy)."""
    if kind == "str":
        return df.withColumn(key, F.col(key).cast("string"))
    if kind != "int":
        raise ValueError(f"unknown key kind: {kind}")
    strict = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"missing {key}")).cast("long"))
    return df.withColumn(key, strict.otherwise(F.col(key).cast("long")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
