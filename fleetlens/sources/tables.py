"""Partitioned tables: scans with pruning, schema checks, partition listings."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import day_floor


def partition_day(year: str = "year", month: str = "month", day: str = "day") -> Column:
    return F.make_date(F.col(year).try_cast("int"), F.col(month).try_cast("int"), F.col(day).try_cast("int"))


def from_day(df: DataFrame, low: dt.date | None, partitions: tuple[str, str, str] = ("year", "month", "day")) -> DataFrame:
    """Rows stored below the day ``low`` or a later one; all rows without ``low``.

    The condition is on partition columns only, so files of older days are not opened. Rows without a day stay.
    Frames without these columns are cut by their ``partition_date``, or not at all.
    """
    if low is None:
        return df
    if set(partitions) <= set(df.columns):
        day = partition_day(*partitions)
    elif "partition_date" in df.columns:
        day = F.col("partition_date")
    else:
        return df
    return df.filter(day.isNull() | (day >= F.lit(low)))


def read_silver(spark: SparkSession, base: str, category: str, module: str, schema: str | None = None) -> DataFrame | None:
    """Rows of one (category, module); absent data gives an empty frame, or None without a schema."""
    try:
        df = spark.read.option("basePath", base).option("mergeSchema", "true").parquet(f"{base}/category={category}/module={module}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if schema else None
    return df.withColumn("partition_date", partition_day())


def read_event_module(spark: SparkSession, base: str, module: str) -> DataFrame | None:
    """Mapped audit events of one module; every file must carry ``extras``."""
    df = read_silver(spark, base, "event_mapping", module)
    if df is None or "extras" in df.columns:
        return df
    # Only on failure: name the files, reading footers one by one.
    bad = [f for f in df.inputFiles() if "extras" not in spark.read.parquet(f).columns]
    raise ValueError(f"module {module}: no 'extras' column in {bad}; columns={df.columns}")


def load_gold(spark: SparkSession, path: str, as_of, retention_days: int = 90) -> DataFrame:
    """A fact table without partitions older than ``retention_days``; 0 keeps everything.

    The condition uses partition columns only, so old partitions are never opened.
    """
    if retention_days < 0:
        raise ValueError("retention_days must be positive, or 0 to keep everything")
    df = spark.read.parquet(path)
    if retention_days == 0:
        return df
    day = partition_day("p_year", "p_month", "p_day")
    return df.filter(day.isNull() | (day >= F.lit(day_floor(as_of) - dt.timedelta(days=retention_days))))


def align_append(target: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` below ``target`` in the target's columns; missing ones are null."""
    return target.unionByName(df.select(*[c for c in df.columns if c in target.columns]), allowMissingColumns=True)


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


_LAYERS = "raw|silver|raw_errors|silver_fail"


def partition_index(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct partitions named in file paths; paths without category and module are left out."""
    part = lambda key: F.nullif(F.regexp_extract(column, rf"/{key}=([^/]+)", 1), F.lit(""))
    keys = ["category", "module", "instance_name", "year", "month", "day"]
    layer = F.nullif(F.regexp_extract(column, rf"(?:^|/)({_LAYERS})/", 1), F.lit(""))
    out = paths.select(layer.alias("layer"), *[part(k).alias(k) for k in keys])
    return out.filter("layer IS NOT NULL AND category IS NOT NULL AND module IS NOT NULL").distinct()


def latest_partitions(files: DataFrame, n: int | None, as_of, *, min_age_days: int = 0, filters: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The newest ``n`` partitions (all with None) that are old enough and have something to compact.

    ``files`` has one row per file: the partition columns, ``file`` and, where known,
    ``compacted``. Each partition comes with its files, their number and how many of them are
    not compacted yet; partitions whose files are all compacted are left out.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    rows = files
    for name, value in (filters or {}).items():
        rows = rows.filter(F.col(name) == value)
    cutoff = F.lit(day_floor(as_of) - dt.timedelta(days=min_age_days))
    keys = keys or ["category", "module", "instance_name", "year", "month", "day"]
    eligible = rows.withColumn("partition_date", partition_day()).filter(F.col("partition_date") < cutoff)
    loose = ~F.col("compacted") if "compacted" in files.columns else F.lit(True)
    counted = eligible.groupBy(*keys, "partition_date").agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if(loose).alias("loose_files"), F.array_sort(F.collect_list("file")).alias("files")
    )
    order = [F.col("partition_date").desc(), *[F.col(k).desc() for k in keys]]
    ranked = counted.filter("loose_files > 0").orderBy(*order)
    return ranked if n is None else ranked.limit(n)
