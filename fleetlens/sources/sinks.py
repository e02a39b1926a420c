"""Writing tables: single files, incremental partitions, watermarks, compaction reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import as_timestamp, day_floor, ts_lit
from fleetlens.sources.tables import partition_day

FACT_PARTITIONS = ["instance_name", "p_year", "p_month", "p_day"]
DAY_PARTITIONS = FACT_PARTITIONS[1:]
SILVER_PARTITIONS = ["category", "module", "instance_name", "year", "month", "day"]
MAX_ROWS_PER_FILE = 100_000  # fixed value: output chunk of a compacted partition


def write_single(df: DataFrame, path: str) -> None:
    """Overwrite a base or dimension table, in one file if it is small.

    The rows meet in a shuffle, so what comes before it keeps its tasks; a table larger
    than a partition's advisory size is split over several files.
    """
    df.hint("rebalance").write.mode("overwrite").parquet(path)


def with_fact_partitions(df: DataFrame, time_column: str) -> DataFrame:
    """Add partition columns that cannot collide with a fact's own ``day``."""
    moment = F.col(time_column).cast("timestamp")
    return df.withColumns({"p_year": F.year(moment), "p_month": F.month(moment), "p_day": F.dayofmonth(moment)})


def write_silver(df: DataFrame, base: str, category: str, module: str, time_column: str = "timestamp") -> None:
    """Add rows to a (category, module) of the normalised layer, below the day of their own time.

    Reads from a day on (:func:`fleetlens.sources.tables.from_day`) rely on this layout.
    """
    moment = F.col(time_column).cast("timestamp")
    parts = {name: F.date_format(moment, pattern) for name, pattern in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))}
    rows = df.withColumns({"category": F.lit(category), "module": F.lit(module), **parts})
    rows.hint("rebalance", *SILVER_PARTITIONS[2:]).write.mode("append").partitionBy(*SILVER_PARTITIONS).parquet(base)


def write_fact_partitions(df: DataFrame, path: str, time_column: str, since: str | None = None) -> None:
    """Rewrite every (instance, day) that has a row at or after ``since``, completely.

    Older rows of a touched day are written again with it, so the day stays whole. Where ``since`` is the
    start of a day, every row from it on belongs to a touched day, and ``df`` is evaluated once.
    Rows are rebalanced rather than hashed on the partition: a day that holds most of
    the rows is split over several tasks and files.
    """
    moment = F.col(time_column).cast("timestamp")
    rows = with_fact_partitions(df.filter(F.col("instance_name").isNotNull() & moment.isNotNull()), time_column)
    if since is not None:
        # No touched day starts before the day of ``since``: both reads are pruned to it.
        low, day = as_timestamp(since), as_timestamp(day_floor(since))
        rows = rows.filter(moment >= ts_lit(day))
        if low != day:
            touched = rows.filter(moment >= ts_lit(low)).select(*FACT_PARTITIONS).distinct()
            rows = rows.join(touched, FACT_PARTITIONS, "left_semi")
    (
        rows.hint("rebalance", *FACT_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*FACT_PARTITIONS)
        .parquet(path)
    )


# --- watermarks ------------------------------------------------------------------------

_STATE = "table_name string, watermark string"


def files_at(spark: SparkSession, path: str):
    """Hadoop's view of a folder, which is where Spark's own reads and writes go."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a state folder; one that was cut off has no success marker."""
    fs, folder = files_at(spark, path)
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(done(p, "_SUCCESS")))


def read_watermarks(spark: SparkSession, path: str) -> dict[str, str]:
    """Committed watermark per fact; nothing committed yet gives an empty mapping."""
    versions = complete_versions(spark, path)
    if not versions:
        return {}
    rows = spark.read.schema(_STATE).json(f"{path}/version={versions[-1]}")
    return {r.table_name: r.watermark for r in rows.collect()}  # one row per fact table


def incremental_boundary(watermarks: dict[str, str], table: str, lookback_days: int = 3) -> str | None:
    """Where an incremental build starts; None asks for a full rebuild."""
    value = watermarks.get(table)
    try:
        moment = as_timestamp(value.replace("Z", "+00:00")) if value else None
    except ValueError:
        return None
    if moment is None:
        return None
    return (moment - dt.timedelta(days=max(0, lookback_days))).isoformat(sep=" ")


def watermark_of(df: DataFrame, time_column: str, table: str) -> DataFrame:
    newest = F.max(F.col(time_column).cast("timestamp")).cast("string")
    return df.agg(newest.alias("watermark")).select(F.lit(table).alias("table_name"), "watermark")


def commit_watermarks(spark: SparkSession, path: str, facts: dict[str, tuple[DataFrame, str]], *, failures: int = 0) -> bool:
    """Add the newest time of every fact to the state, only after a run without failures.

    Facts that are not in this call, or are empty, keep what they had. The state is written as
    a new version, and the highest complete version counts, so a job that dies while
    committing leaves the state before it.
    """
    if failures:
        return False
    state = read_watermarks(spark, path)
    for table, (df, time_column) in facts.items():
        newest = watermark_of(df, time_column, table).first().watermark
        if newest is not None:
            state[table] = newest
    if state:
        versions = complete_versions(spark, path)
        rows = spark.createDataFrame(sorted(state.items()), _STATE)
        # A version that was cut off is written again.
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/version={versions[-1] + 1 if versions else 1}")
    return True


# --- compaction -----------------------------------------------------------------------------

COMPACTED = "compacted-"
OUTCOME = (
    "partition string, partition_date date, files_read int, raw_rows long, written_rows long, files_written int, "
    "files_deleted int, status string, message string"
)


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Collapse identical rows. A hash aggregate: copies meet map-side first."""
    return df.dropDuplicates()


def _old_partitions(df: DataFrame, as_of, age_days: int) -> DataFrame:
    cutoff = F.lit(day_floor(as_of) - dt.timedelta(days=age_days))
    return df.filter(partition_day() < cutoff)


def compaction_audit(df: DataFrame, keys: list[str], as_of, age_days: int = 1) -> DataFrame:
    """Files, rows and rows after deduplication per eligible partition."""
    content = list(df.columns)
    old = _old_partitions(df.withColumn("_file", F.col("_metadata.file_path")), as_of, age_days)
    # Copies of a row meet map-side, so a partition full of repeats shrinks before the shuffle.
    copies = old.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"))
    rows = copies.groupBy(*keys).agg(F.sum("_n").alias("raw_rows"), F.count(F.lit(1)).alias("rows_after_drop_duplicates"))
    # Partition columns and file names only: no data column is read for this part.
    files = old.select(*keys, "_file").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("files_read"))
    return rows.join(files, keys).withColumn("run_date", F.lit(day_floor(as_of)))


def partition_files(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per data file of a partitioned table: keys as written, file, whether it is compacted."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    value = lambda key: F.nullif(F.regexp_extract("path", rf"/{key}=([^/]+)", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select(*[value(k).alias(k) for k in keys], F.col("path").alias("file"), name.startswith(COMPACTED).alias("compacted"))


def compaction_summary(outcome: DataFrame) -> DataFrame:
    """Totals of a run over its outcome rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return outcome.agg(
        F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("status") == "compacted").alias("compacted"), F.count_if(F.col("status") != "compacted").alias("failed"),
        *[total(c) for c in ("files_read", "raw_rows", "written_rows", "files_written", "files_deleted")],
    )
