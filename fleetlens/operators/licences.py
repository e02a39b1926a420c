"""Licence entitlement and utilisation facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rollup import latest
from fleetlens.functions.text import first_text, has_text, login_norm
from fleetlens.plans.dims import LICENSE_PROFILES

UNKNOWN_PROFILE = "UNKNOWN"


def profile_or_unknown(*columns: Column | str) -> Column:
    return F.coalesce(first_text(*columns), F.lit(UNKNOWN_PROFILE))


def _run() -> Column:
    return F.col("run_ts").try_cast("timestamp")


def _recent_first(df: DataFrame) -> list[Column]:
    order = [F.col("run_ts").desc_nulls_last()]
    return order + ([F.col("partition_date").desc_nulls_last()] if "partition_date" in df.columns else [])


def license_utilization_daily(max_licenses: DataFrame, users: DataFrame) -> DataFrame:
    """Entitled, assigned and available licences per (day, instance, profile).

    Both snapshot streams are first reduced to their newest record per day, so the
    join runs at profile grain whatever the snapshot frequency.
    """
    limits = max_licenses.filter(has_text("instance_name") & _run().isNotNull()).withColumns(
        {
            "run_ts": _run(),
            "snapshot_date": F.to_date(_run()),
            "license_profile": profile_or_unknown("license_profile"),
            "entitled_count": F.col("max_licenses").try_cast("long"),
        }
    )
    entitled = latest(
        limits,
        ["instance_name", "snapshot_date", "license_profile"],
        [*_recent_first(limits), F.col("entitled_count").desc_nulls_last()],
    ).select("snapshot_date", "instance_name", "license_profile", "entitled_count", F.col("run_ts").alias("_limit_ts"))

    accounts = users.filter(has_text("instance_name") & has_text("users_login") & _run().isNotNull()).withColumns(
        {
            "run_ts": _run(),
            "snapshot_date": F.to_date(_run()),
            "login_norm": login_norm("users_login"),
            "license_profile": profile_or_unknown("users_resultinguserprofile", "users_userprofile"),
        }
    )
    assigned = (
        latest(
            accounts,
            ["instance_name", "snapshot_date", "login_norm"],
            [
                *_recent_first(accounts),
                F.col("license_profile").asc(),
                F.coalesce(F.trim("users_enabled"), F.lit("")).desc(),
            ],
        )
        .groupBy("snapshot_date", "instance_name", "license_profile")
        # One row per login is left, so counting enabled rows counts distinct logins.
        .agg(
            F.count_if(F.col("users_enabled") == "True").alias("assigned_count"),
            F.max("run_ts").alias("_user_ts"),
        )
    )
    joined = entitled.join(assigned, ["snapshot_date", "instance_name", "license_profile"], "full")
    used = F.coalesce("assigned_count", F.lit(0))
    return joined.select(
        "snapshot_date",
        "instance_name",
        "license_profile",
        "entitled_count",
        used.alias("assigned_count"),
        (F.col("entitled_count") - used).alias("available_count"),
        utilization_pct(used, F.col("entitled_count")).alias("utilization_pct"),
        F.greatest("_limit_ts", "_user_ts").alias("run_ts"),
    )


def utilization_pct(used: Column, entitled: Column) -> Column:
    """Percentage used; null when nothing is entitled."""
    return F.when(entitled != 0, used.cast("double") / entitled.cast("double") * 100.0)


def license_limits_wide(status: DataFrame, max_licenses: DataFrame, profiles: list[str] = LICENSE_PROFILES) -> DataFrame:
    """One row per instance with a column per known main and sub-licence profile."""
    labels = [(p, f"max_licenses_{p.lower()}") for p in map(str.upper, profiles)]
    labels += [(f"SUBLICENSE_{p.upper()}", f"sublicense_{p.lower()}") for p in profiles]
    limits = max_licenses.select(
        "instance_name", "license_profile", F.col("max_licenses").try_cast("long").alias("limit")
    )
    # The pivot values are known, so Spark needs no extra pass to discover them.
    wide = limits.groupBy("instance_name").pivot("license_profile", [k for k, _ in labels]).agg(F.max("limit"))
    wide = wide.select("instance_name", *[F.col(f"`{k}`").alias(name) for k, name in labels])
    return status.join(wide, "instance_name", "left")


def addon_flags(addons: DataFrame) -> DataFrame:
    """Whether an add-on is enabled on any instance."""
    enabled = F.coalesce(F.col("addon_enabled").try_cast("boolean"), F.lit(False))
    return addons.groupBy("addon_key").agg(F.bool_or(enabled).alias("enabled_any_instance"))
