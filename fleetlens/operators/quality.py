"""One-pass quality reports over facts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(name: str = "rows_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def quality_user_activity(daily: DataFrame) -> DataFrame:
    """Size, users, sums and day range of a daily activity fact (with projects if present)."""
    developing = F.coalesce("developing_actions_count", F.lit(0))
    viewing = F.coalesce("viewing_actions_count", F.lit(0))
    extra = {"distinct_projects": "project_key"} if "project_key" in daily.columns else {}
    keys = ["login_norm", *extra.values()]
    # Reduce to the identity grain before counting distinct values of two columns.
    grain = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(viewing).alias("_v"),
        F.sum(developing).alias("_d"),
        F.count_if(developing > 0).alias("_w"),
        F.min("day").alias("_lo"),
        F.max("day").alias("_hi"),
    )
    return grain.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_count"),
        F.count_distinct("login_norm").alias("distinct_users"),
        *[F.count_distinct(c).alias(name) for name, c in extra.items()],
        F.sum("_v").alias("viewing_actions"),
        F.sum("_d").alias("developing_actions"),
        F.sum("_w").alias("rows_with_developing"),
        F.min("_lo").alias("min_day"),
        F.max("_hi").alias("max_day"),
    )


def quality_license(fact: DataFrame) -> DataFrame:
    """Duplicate keys, negative availability, impossible or non-numeric values, date range."""
    keys = ["instance_name", "snapshot_date", "license_profile"]
    entitled, used = F.col("entitled_count"), F.col("assigned_count")
    flags = {
        "negative_available_rows": entitled.isNotNull() & (F.col("available_count") < 0),
        "invalid_null_utilization_rows": (entitled.isNull() | (entitled == 0)) & F.col("utilization_pct").isNotNull(),
        "non_numeric_entitled_rows": entitled.isNotNull() & entitled.cast("string").try_cast("long").isNull(),
        "non_numeric_assigned_rows": used.isNotNull() & used.cast("string").try_cast("long").isNull(),
    }
    grain = fact.groupBy(*keys).agg(_n("_n"), *[F.count_if(c).alias(name) for name, c in flags.items()])
    return grain.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_keys"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in flags],
        F.min("snapshot_date").alias("min_snapshot_date"),
        F.max("snapshot_date").alias("max_snapshot_date"),
    )


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Name, row count and column list of a table."""
    return df.agg(_n("row_count")).select(
        F.lit(name).alias("table_name"),
        (F.col("row_count") > 0).alias("has_rows"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def table_sample(df: DataFrame, rows: int = 3) -> DataFrame:
    """A few rows for a human to look at; the only place the library samples."""
    return df.limit(rows)
