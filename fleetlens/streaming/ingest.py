"""Streaming ingest with the same operators as the batch path.

All streams run with ``availableNow`` and a checkpoint, so a run processes what is new
and stops; the checkpoint moves only when a micro-batch has been written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.casts import cast_datetime
from fleetlens.operators.activity import user_activity_daily, user_activity_hourly
from fleetlens.operators.normalize import map_events, normalize_silver, prepare_audit
from fleetlens.plans.contracts import union_contract
from fleetlens.sources.audit import AUDIT_SCHEMA
from fleetlens.sources.sinks import DAY_PARTITIONS, FACT_PARTITIONS, files_at, with_fact_partitions
from fleetlens.streaming import partials

SILVER_PARTITIONS = [*FACT_PARTITIONS, "batch_id"]


def stream_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, max_files: int = 1000) -> DataFrame:
    """New audit files as a stream, times parsed, rows without a time left out."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    return raw.withColumn("timestamp", cast_datetime("timestamp")).filter("timestamp IS NOT NULL")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is available to a parquet table and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def for_each_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def store_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store a micro-batch day first; a retry replaces what it wrote before.

    The batch id is the last partition level, so a day's files lie together and can be compacted like any
    other partition. Nothing that is stored already is read or listed.
    """
    rows = with_fact_partitions(batch, "timestamp").withColumn("batch_id", F.lit(batch_id))
    rows.hint("rebalance", *FACT_PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SILVER_PARTITIONS).parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything stored so far: no inference, partition values as text."""
    kept = T.StructType([f for f in schema.fields if f.name not in SILVER_PARTITIONS])
    for name in SILVER_PARTITIONS:
        kept.add(name, "string")
    return spark.read.schema(kept).parquet(path)


LISTED_DAYS = 400  # above so many days, a join finds them and not a list


def _on_days(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows of the touched days: the days prune partitions, the join keeps the exact keys.

    A missing instance or time is a key like any other. A partition cannot tell an empty
    instance from a missing one, so the two are one key.
    """
    days = [tuple(r) for r in touched.select(*DAY_PARTITIONS).distinct().limit(LISTED_DAYS + 1).collect()]
    if len(days) <= LISTED_DAYS:
        wanted = F.concat_ws("-", *DAY_PARTITIONS).isin(["-".join(d) for d in days if None not in d])
        if any(None in d for d in days):
            wanted = wanted | F.col("p_year").isNull()
        stored = stored.filter(wanted)
    keys = touched.select(*[F.nullif(c, F.lit("")).alias(f"_{c}") for c in FACT_PARTITIONS]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACT_PARTITIONS]
    return stored.join(keys, reduce(lambda x, y: x & y, same), "left_semi")


# --- hourly counts: partial aggregates per micro-batch ------------------------------------------------

HOURS = "instance_name string, timestamp timestamp, login string, project_key string, viewing_actions_count long, developing_actions_count long"


def add_hours(rows: DataFrame) -> DataFrame:
    """Counts of several batches as one: they add up, in any order and grouping."""
    counts = ["viewing_actions_count", "developing_actions_count"]
    return rows.groupBy("instance_name", "timestamp", "login", "project_key").agg(*[F.sum(c).alias(c) for c in counts])


def hourly_activity_writer(silver: str, fact: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer over a flattened audit stream: append to silver, and store the batch's own counts.

    A batch reads nothing but itself, so its cost follows the batch and not the days it touches. Rows of any
    age count, in any order and batch size; a retried batch replaces its counts. Rows without a time are
    stored and belong to no hour; an empty instance is a missing one. Read with :func:`read_hours`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, silver)
        rows = batch.withColumn("instance_name", F.nullif("instance_name", F.lit("")))
        partials.write_part(user_activity_hourly(rows), fact, partials.Part(batch_id, batch_id), "timestamp")

    return write


def read_hours(spark: SparkSession, fact: str, days: str | None = None) -> DataFrame:
    """Hourly counts of all batches; ``days`` is a condition on p_year, p_month and p_day that prunes files."""
    return partials.read_parts(spark, fact, HOURS, add_hours, days)


def fold_hours(spark: SparkSession, fact: str, width: int = partials.FOLD) -> int:
    """Merge the counts of older batches, ``width`` at a time; what readers see stays the same."""
    return partials.fold(spark, fact, HOURS, add_hours, "timestamp", width)


# --- late data: a change log of touched days ----------------------------------------------------------


def _log(silver: str) -> str:
    return f"{silver}/_touched"  # names that begin so are no data to Spark


def touched_days_writer(silver: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: append to silver and log the (instance, day) keys that got rows.

    The log of a batch is written before its rows: a batch that stops between has a day rebuilt for nothing,
    never one forgotten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keys = with_fact_partitions(batch, "timestamp").select(*[F.col(c).cast("string") for c in FACT_PARTITIONS]).distinct()
        keys.coalesce(1).write.mode("overwrite").parquet(f"{_log(silver)}/batch={batch_id}")
        store_batch(batch, batch_id, silver)

    return write


def rebuild_touched(
    spark: SparkSession, silver: str, schema: T.StructType, fact: str, build: Callable[[DataFrame], DataFrame] | None = None, time_column: str = "day"
) -> list[str]:
    """Rebuild every logged (instance, day) of ``fact`` from silver, once, then clear what was read of the log.

    Rebuilt days are overwritten whole and depend only on what silver holds, so rows of any age count. A run
    that stops before the log is cleared rebuilds the same days again. Rows without a time belong to no day;
    rows without an instance are built like those of any other. Returns the log entries done.
    """
    make = build or (lambda rows: user_activity_daily(user_activity_hourly(rows)))
    fs, folder = files_at(spark, _log(silver))
    if not fs.exists(folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    entries = [f"{_log(silver)}/{n}" for n in names if fs.exists(place(f"{_log(silver)}/{n}/_SUCCESS"))]
    if not entries:
        return []
    keys = spark.read.schema(", ".join(f"{c} string" for c in FACT_PARTITIONS)).parquet(*entries).filter("p_year IS NOT NULL").distinct()
    days = make(_on_days(read_batches(spark, silver, schema), keys).drop("batch_id"))
    out = with_fact_partitions(days, time_column).hint("rebalance", *FACT_PARTITIONS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FACT_PARTITIONS).parquet(fact)
    for entry in entries:
        fs.delete(place(entry), True)
    return entries


def run_late_data(
    stream: DataFrame, silver: str, fact: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] | None = None, time_column: str = "day"
) -> StreamingQuery:
    """Store whatever is available, then rebuild the days it touched, and those a stopped run left in the log."""
    query = for_each_available(stream, touched_days_writer(silver), checkpoint)
    rebuild_touched(stream.sparkSession, silver, stream.schema, fact, build, time_column)
    return query


# --- deduplication: keyed state -----------------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def first_deliveries(stream: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first delivery of every event of a stream, however late a copy comes.

    The keys seen so far are state in RocksDB, dealt by key over the tasks: on local disk between batches, in
    the checkpoint as a change log. A batch looks its own keys up and reads no stored rows. Missing keys are
    equal to each other. ``within`` (as ``7 days``) forgets keys that old, for sources that bound their delay.
    """
    for name, value in STATE_CONF.items():
        stream.sparkSession.conf.set(name, value)
    if within is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(keys)


def store_first_deliveries(stream: DataFrame, keys: list[str], store: str, checkpoint: str) -> StreamingQuery:
    """Append the first delivery of whatever is available to a table, and stop."""
    return run_available(first_deliveries(stream, keys), store, checkpoint)


def route_writer(path: str, columns: tuple[str, ...] = ("instance_name", "run_ts")) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: rows to their module partition, rows failing checks to quarantine.

    One write: ``target`` (silver or quarantine) is the first partition level, so the source is
    read and parsed once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        valid = F.coalesce(F.col("extras").isNull() | F.try_parse_json("extras").isNotNull(), F.lit(True))
        for name in columns:
            valid = valid & F.col(name).isNotNull()
        rows = batch.withColumns({"target": F.when(valid, "silver").otherwise("quarantine"), "batch_id": F.lit(batch_id)})
        keys = ["target", "module", "batch_id"]
        rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    return write


def normalized_audit(stream: DataFrame, mapping: DataFrame, required: list[str], run_ts: Column) -> DataFrame:
    """An audit stream as typed silver rows: flattened, mapped to a category, normalised.

    Adds ``module``, the category under which :func:`route_writer` stores a row. Works on
    batch frames alike.
    """
    flat = flatten_stream(stream)
    mapped = map_events(flat.drop("date"), mapping)
    rows = normalize_silver(mapped.withColumn("run_ts", run_ts), union_contract(required, ["activity_category"]))
    return rows.withColumn("module", F.lower("activity_category"))


def ingest_audit(spark: SparkSession, source: str, silver: str, checkpoint: str, mapping: DataFrame, required: list[str], run_ts: Column, *, schema: str = AUDIT_SCHEMA, max_files: int = 1000) -> StreamingQuery:
    """Raw audit files to routed silver: whatever is new since the checkpoint, once."""
    rows = normalized_audit(stream_audit(spark, source, schema, max_files), mapping, required, run_ts)
    return for_each_available(rows, route_writer(silver), checkpoint)


def flatten_stream(stream: DataFrame, instance_column: str = "instance_name") -> DataFrame:
    """:func:`prepare_audit` for lines that name their instance."""
    return prepare_audit(stream, F.col(instance_column))
