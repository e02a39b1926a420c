"""Audit log files and changed-since selection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import as_timestamp, ts_lit
from fleetlens.functions.casts import cast_datetime

# Fields of an audit line that the processors read.
AUDIT_SCHEMA = (
    "timestamp string, topic string, "
    "message struct<msgType:string,msgTypeBase:string,authSource:string,authUser:string,authVia:array<string>,"
    "login:string,user:string,projectKey:string,scenarioId:string,jobId:string>, "
    "mdc struct<user:string>"
)


def read_audit_json(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, modified_after: str | None = None) -> DataFrame:
    """Newline-delimited audit JSON (gzip included) with an explicit schema."""
    reader = spark.read.schema(schema)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.json(path)


def select_files_since(spark: SparkSession, path: str, cursor, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Rows at or after the cursor, from the files modified since then and the newest one before.

    A log file is written until the next one begins, so the newest older file, however old, may end with rows
    after the cursor; files before it cannot. Files are listed once for its name, and no other older one is opened.
    """
    low = as_timestamp(cursor)
    # strictly later than the millisecond before the cursor
    newer = read_audit_json(spark, path, schema, (low - dt.timedelta(milliseconds=1)).isoformat(timespec="milliseconds"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    older = listed.filter(F.col("modificationTime") < ts_lit(low)).agg(F.max(F.struct("modificationTime", "path")).alias("file")).first().file
    rows = newer if older is None else newer.unionByName(read_audit_json(spark, older.path, schema))
    return filter_since(rows, cursor)


def filter_since(df: DataFrame, cursor, observe: Observation | None = None) -> DataFrame:
    """Parse times, drop unreadable ones and rows before the cursor.

    ``observe`` receives how many rows were dropped for each reason, in the same pass.
    """
    parsed = df.withColumn("_ts", cast_datetime("timestamp", dict(df.dtypes)["timestamp"]))
    low = ts_lit(as_timestamp(cursor))
    if observe is not None:
        parsed = parsed.observe(
            observe,
            F.count(F.lit(1)).alias("rows_read"),
            F.count_if(F.col("_ts").isNull()).alias("rows_invalid_timestamp"),
            F.count_if(F.col("_ts") < low).alias("rows_before_cursor"),
        )
    return parsed.filter(F.col("_ts") >= low).withColumn("timestamp", F.col("_ts")).drop("_ts")


def timestamp_column(columns: list[str]) -> str | None:
    """First ``lastModifiedOn`` column, else the first ``createdOn`` one."""
    for mark in ("lastModifiedOn", "createdOn"):
        for name in columns:
            if mark in name:
                return name
    return None


def select_changed_since(df: DataFrame, since) -> DataFrame:
    """Rows changed since a moment, by the detected time column.

    Times before 2000 count as missing. When no row has a usable time everything is
    kept; that check is a small action which stops at the first usable row.
    """
    column = timestamp_column(df.columns)
    if column is None:
        return df
    moment = cast_datetime(f"`{column}`", dict(df.dtypes)[column])
    usable = F.when(moment >= F.lit(dt.date(2000, 1, 1)).cast("timestamp"), moment)
    rows = df.withColumn("_ts", usable)
    if rows.filter("_ts IS NOT NULL").isEmpty():
        return df
    return rows.filter(F.col("_ts") >= ts_lit(as_timestamp(since))).drop("_ts")


def select_changed_projects(df: DataFrame, since, version: str = "versionTag_lastModifiedOn", creation: str = "creationTag_lastModifiedOn") -> DataFrame:
    """Projects changed since a moment; without any time a project is kept."""
    floor = F.lit(dt.date(2015, 1, 1)).cast("timestamp")
    dtypes = dict(df.dtypes)

    def clamped(name: str) -> Column:
        moment = cast_datetime(name, dtypes[name])
        return F.when(moment.isNotNull(), F.greatest(moment, floor))

    present = [clamped(c) for c in (version, creation) if c in df.columns]
    changed = F.coalesce(*present) if present else F.lit(None).cast("timestamp")
    return df.filter(changed.isNull() | (changed >= ts_lit(as_timestamp(since))))
