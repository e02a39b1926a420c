"""Development activity: enriched events, 30-day views and drill-downs.

All queries read the enriched event frame, filter on time first, and aggregate once.
``limit`` applies only where the result is a ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import since_days
from fleetlens.functions.rollup import count_with_distincts, top_n
from fleetlens.functions.text import as_col, canonical, has_text
from fleetlens.plans.dims import dim_capability, dim_event_class

UNCATEGORIZED = "Uncategorized"
UNCLASSIFIED = "unclassified"


def _enrich(events: DataFrame, capability: DataFrame, event_class: DataFrame, key) -> DataFrame:
    # One row per key on the dimension side, so the joins keep the row count; whether a
    # dimension is broadcast follows from its size.
    cap = capability.select(key("activity_category").alias("_cat"), "capability", "capability_label", "category_label")
    cls = event_class.select(key("msgtype").alias("_msg"), "activity_class", "is_meaningful_activity")
    joined = (
        events.withColumns({"_cat": key("activity_category"), "_msg": key("msgtype")})
        .join(cap, "_cat", "left")
        .join(cls, "_msg", "left")
    )
    return joined.select(
        "timestamp",
        "instance_name",
        "login",
        "project_key",
        "msgtype",
        F.col("msgtypebase").alias("base_tag"),
        *[c for c in ("activity_origin", "authsource", "has_scenario_marker", "has_job_marker", "activity_origin_evidence") if c in events.columns],
        F.coalesce("category_label", "activity_category").alias("activity_category"),
        F.coalesce("capability_label", "capability", F.lit(UNCATEGORIZED)).alias("capability"),
        F.coalesce("activity_class", F.lit(UNCLASSIFIED)).alias("activity_class"),
        F.coalesce("is_meaningful_activity", F.lit(False)).alias("is_meaningful_activity"),
        has_text("login").alias("is_user_attributed"),
    )


def dev_activity_enriched(spark: SparkSession, events: DataFrame, capability=None, event_class=None) -> DataFrame:
    """Development events with category, capability and activity class; row preserving."""
    return _enrich(events, capability or dim_capability(spark), event_class or dim_event_class(spark), canonical)


def dev_source_fallback(spark: SparkSession, events: DataFrame, enriched: DataFrame | None = None, capability=None, event_class=None) -> DataFrame:
    """The enriched frame, or the events joined on plain lower-case keys when it is missing or empty."""
    if enriched is not None and not enriched.isEmpty():
        return enriched
    plain = lambda name: F.lower(F.trim(as_col(name)))
    return _enrich(events, capability or dim_capability(spark), event_class or dim_event_class(spark), plain)


# --- 30-day views -----------------------------------------------------------


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).cast("long").alias(name)


def _windowed_rollup(enriched: DataFrame, keys: list[str], as_of, days: int, condition: Column) -> DataFrame:
    """Events and users in the window per key; keys seen only outside it show zero."""
    recent = F.coalesce(since_days("timestamp", as_of, days) & condition, F.lit(False))
    return enriched.groupBy(*keys).agg(
        _count_if(recent, "event_count_30d"),
        F.count_distinct(F.when(recent & has_text("login"), F.col("login"))).alias("active_users_30d"),
    )


def capability_30d(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _windowed_rollup(enriched, ["capability"], as_of, days, F.col("is_meaningful_activity"))


def capability_daily(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(F.to_date("timestamp").alias("day"), "capability").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_distinct("login").alias("active_users")
    )


def category_30d(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _windowed_rollup(enriched, ["capability", "activity_category"], as_of, days, F.col("is_meaningful_activity"))


def tag_30d(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = F.coalesce(since_days("timestamp", as_of, days), F.lit(False))
    return enriched.groupBy("capability", "activity_category", "base_tag").agg(
        _count_if(recent, "event_count_30d"),
        F.count_distinct(F.when(recent, F.col("login"))).alias("active_users_30d"),
    )


def top_users_30d(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Builders of the window: meaningful events, active days and capabilities touched."""
    rows = enriched.filter(since_days("timestamp", as_of, days) & F.col("is_meaningful_activity") & has_text("login"))
    rows = rows.withColumn("day", F.to_date("timestamp"))
    return count_with_distincts(
        rows,
        ["login"],
        {"active_days_30d": "day", "capabilities_touched_30d": "capability"},
        events="event_count_30d",
    )


def unmapped_categories_30d(events: DataFrame, capability: DataFrame, as_of, days: int = 30, *, normalized: bool = False) -> DataFrame:
    """Categories without a capability. Compares the stored spelling unless ``normalized``."""
    key = canonical if normalized else as_col
    known = capability.select(key("activity_category").alias("_cat"))
    missing = events.withColumn("_cat", key("activity_category")).join(known, "_cat", "left_anti")
    recent = F.coalesce(since_days("timestamp", as_of, days), F.lit(False))
    return missing.groupBy("activity_category").agg(
        _count_if(recent, "event_count_30d"),
        F.count_distinct(F.when(recent, F.col("login"))).alias("active_users_30d"),
    )


def unclassified_events_30d(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    rows = enriched.filter(since_days("timestamp", as_of, days) & (F.col("activity_class") == UNCLASSIFIED))
    return rows.groupBy("msgtype", "base_tag", "activity_category").agg(
        F.count(F.lit(1)).alias("event_count_30d"),
        F.count_distinct("login").alias("distinct_users_30d"),
        _count_if(~has_text("login"), "unattributed_events_30d"),
    )


# --- drill-downs --------------------------------------------------------------


def _window(enriched: DataFrame, as_of, days: int, where: Column | None = None) -> DataFrame:
    rows = enriched.filter(since_days("timestamp", as_of, days))
    return rows if where is None else rows.filter(where)


def _counts(rows: DataFrame, label: Column | str) -> DataFrame:
    return rows.groupBy(as_col(label).alias("label")).agg(F.count(F.lit(1)).alias("value"))


def _ranking(rows: DataFrame, label: Column | str, limit: int) -> DataFrame:
    return top_n(_counts(rows, label), [F.col("value").desc(), F.col("label").asc_nulls_last()], limit)


def _day() -> Column:
    return F.to_date("timestamp").cast("string")


def dev_daily(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days), _day())


def dev_by_capability(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days), "capability")


def dev_by_category(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days), F.concat_ws(" / ", "capability", "activity_category"))


def dev_top_users(enriched: DataFrame, as_of, days: int = 30, limit: int = 50) -> DataFrame:
    return _ranking(_window(enriched, as_of, days), "login", limit)


def _of_capability(capability: str) -> Column:
    return F.col("capability") == capability


def capability_summary(enriched: DataFrame, capability: str, as_of, days: int = 30) -> DataFrame:
    rows = _window(enriched, as_of, days, _of_capability(capability))
    return count_with_distincts(rows, [], {"users": "login", "projects": "project_key", "instances": "instance_name"})


def capability_events_daily(enriched: DataFrame, capability: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_capability(capability)), _day())


def capability_categories(enriched: DataFrame, capability: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_capability(capability)), "activity_category")


def capability_tags(enriched: DataFrame, capability: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_capability(capability)), "base_tag")


def capability_top_users(enriched: DataFrame, capability: str, as_of, days: int = 30, limit: int = 50) -> DataFrame:
    return _ranking(_window(enriched, as_of, days, _of_capability(capability)), "login", limit)


def capability_top_projects(enriched: DataFrame, capability: str, as_of, days: int = 30, limit: int = 50) -> DataFrame:
    label = F.concat_ws(" :: ", "instance_name", "project_key")
    return _ranking(_window(enriched, as_of, days, _of_capability(capability)), label, limit)


def _of_login(login: str) -> Column:
    return F.col("login") == login


def user_dev_summary(enriched: DataFrame, login: str, as_of, days: int = 30) -> DataFrame:
    rows = _window(enriched, as_of, days, _of_login(login))
    return count_with_distincts(rows, [], {"projects": "project_key", "instances": "instance_name"})


def user_dev_daily(enriched: DataFrame, login: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_login(login)), _day())


def user_dev_capabilities(enriched: DataFrame, login: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_login(login)), "capability")


def user_dev_categories(enriched: DataFrame, login: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_login(login)), "activity_category")


def user_dev_tags(enriched: DataFrame, login: str, as_of, days: int = 30) -> DataFrame:
    return _counts(_window(enriched, as_of, days, _of_login(login)), "base_tag")


# --- process usage --------------------------------------------------------------


def usage_summary(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    distinct = {
        "active_capabilities": "capability",
        "active_users": "login",
        "active_projects": "project_key",
        "active_instances": "instance_name",
    }
    return count_with_distincts(_window(enriched, as_of, days), [], distinct)


def usage_by_capability(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    distinct = {"active_users": "login", "projects": "project_key", "instances": "instance_name"}
    out = count_with_distincts(_window(enriched, as_of, days), ["capability"], distinct, events="value")
    return out.withColumnRenamed("capability", "label")


def usage_daily(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return dev_daily(enriched, as_of, days)


def _usage_distinct(enriched: DataFrame, column: str, as_of, days: int) -> DataFrame:
    rows = _window(enriched, as_of, days)
    return rows.groupBy(F.col("capability").alias("label")).agg(F.count_distinct(column).alias("value"))


def usage_users(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _usage_distinct(enriched, "login", as_of, days)


def usage_projects(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _usage_distinct(enriched, "project_key", as_of, days)


def usage_instances(enriched: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _usage_distinct(enriched, "instance_name", as_of, days)
