"""Licence capacity questions over snapshots and the utilisation fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calendar import day_floor, positive
from fleetlens.functions.entitlement import license_filter, license_group, normalize_profile
from fleetlens.functions.rollup import latest
from fleetlens.functions.text import has_text, null_if_blank
from fleetlens.operators.latest import latest_users
from fleetlens.operators.licences import profile_or_unknown, utilization_pct


def current_users(users: DataFrame, instance: str | None = None) -> DataFrame:
    """Newest record per (instance, login) with profile, its key and its group."""
    profile = profile_or_unknown("users_userprofile")
    return latest_users(users, instance).withColumns(
        {
            "user_profile": profile,
            "profile_norm": normalize_profile(profile),
            "license_group": license_group(profile),
            "enabled": F.coalesce(F.col("users_enabled") == "True", F.lit(False)),
        }
    )


def enabled_by_group_profile(users: DataFrame, instance: str | None = None) -> DataFrame:
    """Enabled people per (group, profile); combinations without any are left out."""
    enabled = current_users(users, instance).filter("enabled")
    return enabled.groupBy("license_group", F.col("user_profile").alias("profile"), "profile_norm").agg(
        F.count_distinct("login_norm").alias("enabled_users")
    )


def _limits_in_scope(max_licenses: DataFrame, users: DataFrame, instance: str | None) -> DataFrame:
    """Numeric limits of instances that report at least one account."""
    scope = users.filter(has_text("users_login"))
    if instance:
        scope = scope.filter(F.col("instance_name") == instance)
    limits = max_licenses.select(
        "instance_name",
        profile_or_unknown("license_profile").alias("profile"),
        normalize_profile("license_profile").alias("profile_norm"),
        F.col("max_licenses").try_cast("long").alias("max_licenses"),
        "run_ts",
    ).filter(F.col("max_licenses").isNotNull())
    return limits.join(scope.select("instance_name").distinct(), "instance_name", "left_semi")


def _most_common_limit(limits: DataFrame) -> DataFrame:
    counted = limits.groupBy("profile_norm", "profile", "max_licenses").agg(
        F.count(F.lit(1)).alias("instance_count"), F.max("run_ts").alias("license_snapshot_ts")
    )
    order = [F.col("instance_count").desc(), F.col("max_licenses").desc(), F.col("profile").asc()]
    return latest(counted, ["profile_norm"], order)


def representative_max(max_licenses: DataFrame, users: DataFrame, instance: str | None = None) -> DataFrame:
    """Most frequent limit per normalised profile (then the largest, then by name)."""
    return _most_common_limit(_limits_in_scope(max_licenses, users, instance)).select(
        "profile_norm", F.col("profile").alias("profile_from_max"), "max_licenses", "instance_count"
    )


# --- status summary -----------------------------------------------------------

# Status fields that are summarised, and the ones holding booleans.
STATUS_FIELDS = [
    "license_kind", "has_license", "valid", "expired", "community", "fallback_profile", "expires_on",
    "licensee_company", "licensee_name", "standard_offer", "emitted_by", "emitted_on",
]
BOOLEAN_FIELDS = {"valid", "expired", "has_license", "community"}
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]


def _display(field: str) -> Column:
    text = null_if_blank(F.col(field).cast("string"))
    if field in BOOLEAN_FIELDS:
        low = F.lower(text)
        return F.when(low.isin(TRUE_WORDS), "True").when(low.isin(FALSE_WORDS), "False").otherwise(text)
    if field == "expires_on":
        number = text.try_cast("long")
        seconds = F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number)
        return F.when(text.rlike("^[0-9]+$"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(text)
    if field == "emitted_on":
        return F.when(
            text.rlike("^[0-9]{8}$"),
            F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
        ).otherwise(text)
    return text


def _unpivot(status: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), col.alias("value")) for name, col in columns.items()])
    return status.select(F.explode(pairs).alias("p")).select("p.field", "p.value").filter("value IS NOT NULL")


def license_status_summary(status: DataFrame, as_of, instance: str | None = None) -> DataFrame:
    """Most common value per status field, enabled features, and days to expiry.

    Rows are (kind, field, value, count) with kind ``field``, ``feature`` or ``days_left``.
    """
    if instance:
        status = status.filter(F.col("instance_name") == instance)
    fields = _unpivot(status, {f: _display(f) for f in STATUS_FIELDS if f in status.columns})
    counted = fields.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    common = latest(counted, ["field"], [F.col("count").desc(), F.col("value").asc()])
    days_left = common.filter(F.col("field") == "expires_on").select(
        F.lit("days_left").alias("kind"),
        F.lit("days_left").alias("field"),
        F.date_diff(F.col("value").try_cast("date"), F.lit(day_floor(as_of))).cast("string").alias("value"),
        "count",
    )
    out = common.select(F.lit("field").alias("kind"), "field", "value", "count").unionByName(
        days_left.filter("value IS NOT NULL")
    )
    features = [c for c in status.columns if c.startswith("feature_")]
    if features:
        truthy = {
            c: F.when(F.lower(F.trim(F.col(c).cast("string"))).isin([*TRUE_WORDS, "enabled"]), F.lit("True"))
            for c in features
        }
        enabled = _unpivot(status, truthy).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
        out = out.unionByName(enabled.select(F.lit("feature").alias("kind"), "field", "value", "count"))
    return out


# --- utilisation fact -----------------------------------------------------------


def _fact_scope(fact: DataFrame, instance: str | None, profile: str | None, filter_name: str | None) -> DataFrame:
    rows = fact.filter(license_filter("license_profile", filter_name))
    if instance:
        rows = rows.filter(F.col("instance_name") == instance)
    if profile:
        rows = rows.filter(F.col("license_profile") == profile)
    return rows


def license_latest(fact: DataFrame, *, instance=None, profile=None, filter_name=None) -> DataFrame:
    """Newest utilisation row of every (instance, profile) series."""
    rows = _fact_scope(fact, instance, profile, filter_name)
    newest = latest(
        rows,
        ["instance_name", "license_profile"],
        [F.col("snapshot_date").desc_nulls_last(), F.col("run_ts").desc_nulls_last()],
    )
    return newest.withColumn("license_group", license_group("license_profile"))


def license_history(fact: DataFrame, days: int = 180, *, instance=None, profile=None, filter_name=None) -> DataFrame:
    """Rows within ``days`` of each series' own last date.

    As in the utilisation report, the scope decides which series are listed while the
    history of a listed series is taken from the whole fact.
    """
    days = positive(days, "days")
    bounds = (
        _fact_scope(fact, instance, profile, filter_name)
        .groupBy(F.col("instance_name").alias("_i"), F.col("license_profile").alias("_p"))
        .agg(F.max("snapshot_date").alias("_last"))
    )
    same = F.col("instance_name").eqNullSafe(F.col("_i")) & F.col("license_profile").eqNullSafe(F.col("_p"))
    recent = fact.join(bounds, same).filter(F.col("snapshot_date") >= F.date_sub("_last", days))
    return recent.drop("_i", "_p", "_last").withColumn("license_group", license_group("license_profile"))


def license_coverage(fact: DataFrame, days: int = 180, **scope) -> DataFrame:
    series = F.concat_ws("|", "instance_name", F.coalesce("license_profile", F.lit("UNKNOWN")))
    return license_history(fact, days, **scope).agg(
        F.min("snapshot_date").alias("history_start_date"),
        F.max("snapshot_date").alias("history_end_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(series).alias("series_count"),
    )


# --- current snapshots ------------------------------------------------------------


def _current_limits(max_licenses: DataFrame, users: DataFrame, instance: str | None, filter_name: str | None) -> DataFrame:
    order = [F.col("max_licenses").desc_nulls_last(), F.col("profile").asc(), F.col("run_ts").desc()]
    newest = latest(_limits_in_scope(max_licenses, users, instance), ["instance_name", "profile_norm"], order)
    return newest.filter(license_filter("profile", filter_name))


def _balance(used: Column, entitled: Column) -> list[Column]:
    return [
        used.alias("assigned_count"),
        entitled.alias("entitled_count"),
        (entitled - used).alias("available_count"),
        F.when(entitled > 0, utilization_pct(used, entitled)).alias("utilization_pct"),
    ]


def _balance_by_instance(people: DataFrame, limits: DataFrame) -> DataFrame:
    used = people.groupBy(
        F.col("instance_name").alias("_ui"), F.col("user_profile").alias("_up"), F.col("profile_norm").alias("_un"), F.col("license_group").alias("_ug")
    ).agg(F.count(F.lit(1)).alias("_used"), F.max("run_ts").alias("user_snapshot_ts"))
    same = F.col("_ui").eqNullSafe(F.col("instance_name")) & F.col("_un").eqNullSafe(F.col("profile_norm"))
    joined = used.join(limits, same, "full")
    return joined.select(
        F.coalesce("_ui", "instance_name").alias("instance_name"),
        F.coalesce("_ug", license_group("profile")).alias("license_group"),
        F.coalesce("_up", "profile").alias("license_profile"),
        F.coalesce("_un", "profile_norm").alias("profile_norm"),
        *_balance(F.coalesce("_used", F.lit(0)), F.col("max_licenses")),
        "user_snapshot_ts",
        F.col("run_ts").alias("license_snapshot_ts"),
    )


def current_license_by_instance(users: DataFrame, max_licenses: DataFrame, *, instance=None, filter_name=None) -> DataFrame:
    """Assigned against entitled licences per (instance, profile), both sides kept."""
    people = current_users(users, instance).filter(F.col("enabled") & license_filter("user_profile", filter_name))
    limits = _current_limits(max_licenses, users, instance, filter_name)
    return _balance_by_instance(people, limits)


def current_license_by_profile(users: DataFrame, max_licenses: DataFrame, *, instance=None, filter_name=None) -> DataFrame:
    """Fleet-wide balance per profile, with the per-instance rows nested.

    Capacity is the representative limit, not a sum. The nested list has one element
    per instance, so it is as long as the fleet is wide.
    """
    people = current_users(users, instance).filter(F.col("enabled") & license_filter("user_profile", filter_name))
    current = _current_limits(max_licenses, users, instance, filter_name)
    used = people.groupBy(F.col("user_profile").alias("_up"), F.col("profile_norm").alias("_un"), F.col("license_group").alias("_ug")).agg(
        F.count_distinct("login_norm").alias("_used"),
        F.count_distinct("instance_name").alias("_instances"),
        F.max("run_ts").alias("user_snapshot_ts"),
    )
    limits = _most_common_limit(current)
    joined = used.join(limits, F.col("_un").eqNullSafe(F.col("profile_norm")), "full")
    rows = joined.select(
        F.coalesce("_ug", license_group("profile")).alias("license_group"),
        F.coalesce("_up", "profile").alias("license_profile"),
        F.coalesce("_un", "profile_norm").alias("profile_norm"),
        *_balance(F.coalesce("_used", F.lit(0)), F.col("max_licenses")),
        F.coalesce("_instances", F.lit(0)).alias("contributing_instance_count"),
        F.col("profile").alias("entitlement_profile"),
        F.col("instance_count").alias("max_licenses_instance_count"),
        "user_snapshot_ts",
        "license_snapshot_ts",
    )
    nested = (
        _balance_by_instance(people, current)
        .groupBy("profile_norm")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("instance_name", "assigned_count", "entitled_count", "available_count", "utilization_pct"))
            ).alias("instances")
        )
    )
    return rows.join(nested, "profile_norm", "left")
