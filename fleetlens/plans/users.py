"""People and adoption: directory, KPIs, active users, segments, retention, risk.

Activity facts hold one row per (day, instance, login). Queries reduce them to the
login (or month and login) grain first and join accounts afterwards, so joins and
distinct counts run on people rather than on events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.calendar import (
    add_months,
    day_floor,
    explode_months,
    explode_periods,
    month_spine,
    month_start,
    period_bounds,
    period_of,
    period_spine,
    positive,
    window_predicate,
)
from fleetlens.functions.entitlement import LICENSE_GROUPS, license_filter, license_group
from fleetlens.functions.rollup import latest, merge_single_rows, top_n
from fleetlens.functions.text import first_text, has_text, login_norm, null_if_blank
from fleetlens.operators.latest import latest_users
from fleetlens.plans.licences import current_users

LICENSE_CREATOR, LICENSE_CONSUMER = "license_creator", "license_consumer"


def _in_instance(df: DataFrame, instance: str | None) -> DataFrame:
    return df.filter(F.col("instance_name") == instance) if instance else df


def _ts(day: dt.date) -> Column:
    return F.lit(day).cast("timestamp")


# --- views ------------------------------------------------------------------------


def users_directory(users: DataFrame, hub_instances: list[str] | None = None) -> DataFrame:
    """One record per login across the fleet: newest run, hub instances first."""
    rows = users.filter(has_text("users_login")).select(
        "instance_name",
        F.col("users_login").alias("login"),
        login_norm("users_login").alias("login_norm"),
        F.col("users_displayname").alias("display_name"),
        F.col("users_email").alias("email"),
        (F.col("users_enabled") == "True").alias("enabled"),
        F.col("users_userprofile").alias("user_profile"),
        F.col("users_groups").alias("group_names"),
        "run_ts",
    )
    is_hub = F.col("instance_name").isin(hub_instances or [])
    order = [F.col("run_ts").desc_nulls_last(), is_hub.desc(), F.col("instance_name").asc(), F.col("login").asc()]
    return latest(rows, ["login_norm"], order)


def developing_ratio_daily(daily: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("developing_actions_count").cast("double"), F.col("viewing_actions_count").cast("double"))
    return daily.select(
        "day", "instance_name", "login", "viewing_actions_count", "developing_actions_count", ratio.alias("developing_ratio")
    )


def formal_mau_enriched(mau_daily: DataFrame, users: DataFrame, daily: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Daily opens of enabled, non-trial accounts outside the vendor's mail domain."""
    mail = F.lower(F.trim(F.coalesce("users_email", F.lit(""))))
    people = latest_users(users).filter(
        (F.col("users_enabled") == "True")
        & (F.coalesce("users_trialstatus_exists", F.lit("False")) != "True")
        & ~mail.rlike(rf"@{vendor}(\.[^@\s]+)+$")
    )
    behaviour = daily.select(
        "day", "instance_name", "login_norm", "viewing_actions_count", "developing_actions_count", "last_activity_at"
    )
    # The account side has one row per key, so a semi join keeps the row count.
    rows = mau_daily.join(people.select("instance_name", "login_norm"), ["instance_name", "login_norm"], "left_semi")
    return rows.join(behaviour, ["day", "instance_name", "login_norm"], "left").select(
        "day",
        "instance_name",
        "login_norm",
        "login",
        "application_open_count",
        "last_application_open_at",
        F.coalesce("viewing_actions_count", F.lit(0)).alias("consuming_actions_count"),
        F.coalesce("viewing_actions_count", F.lit(0)).alias("viewing_actions_count"),
        F.coalesce("developing_actions_count", F.lit(0)).alias("developing_actions_count"),
        "last_activity_at",
    )


# --- leaderboard --------------------------------------------------------------------


def leaderboard(
    daily: DataFrame,
    users: DataFrame,
    as_of,
    *,
    days: int | None = 30,
    months: int | None = None,
    instance: str | None = None,
    activity_filter: str = LICENSE_CREATOR,
    limit: int = 50,
) -> DataFrame:
    """Top people by viewing and by developing actions, with directory details."""
    rows = _in_instance(daily.filter(window_predicate("last_activity_at", as_of, months=months, days=days)), instance)
    people = rows.groupBy("login_norm").agg(
        F.sum("viewing_actions_count").alias("viewing"),
        F.sum("developing_actions_count").alias("developing"),
        F.max("last_activity_at").alias("last_activity_at"),
        F.count_distinct("instance_name").alias("instances"),
    )
    directory = users_directory(users).select("login_norm", "display_name", "email", "user_profile", "enabled")
    by_profile = activity_filter == LICENSE_CONSUMER
    if by_profile:
        outside = ~F.coalesce(F.upper(F.trim("user_profile")), F.lit("")).isin(LICENSE_GROUPS[LICENSE_CONSUMER])
        people = people.filter("viewing > 0").join(directory, "login_norm", "left").filter(outside)
    else:
        people = people.filter("developing > 0")

    boards = [
        top_n(people.withColumns({"metric": F.lit(m), "value": F.col(m)}), [F.col(m).desc_nulls_last(), F.col("login_norm").asc()], limit)
        for m in ("viewing", "developing")
    ]
    ranked = boards[0].unionByName(boards[1])
    if not by_profile:  # only the ranked rows need directory details
        ranked = ranked.join(directory, "login_norm", "left")
    return ranked.select(
        "metric", F.col("login_norm").alias("login"), "display_name", "email", "user_profile", "enabled",
        "value", "viewing", "developing", "instances", "last_activity_at",
    )


# --- KPIs ------------------------------------------------------------------------------


def _windows(as_of) -> dict[str, dt.date]:
    today = day_floor(as_of)
    return {
        "30d": today - dt.timedelta(days=30),
        "90d": today - dt.timedelta(days=90),
        "6m": add_months(today, -6),
        "12m": add_months(today, -12),
    }


def _windowed_activity(daily: DataFrame, keys: list[str], as_of) -> DataFrame:
    """Total and windowed sums of both metrics per key, in one aggregation."""
    measures = []
    for metric in ("viewing", "developing"):
        column = F.col(f"{metric}_actions_count")
        measures.append(F.sum(column).alias(f"total_{metric}"))
        for name, start in _windows(as_of).items():
            inside = F.when(F.col("last_activity_at") >= _ts(start), column).otherwise(0)
            measures.append(F.sum(inside).alias(f"{metric}_{name}"))
    return daily.groupBy(*keys).agg(*measures)


def _pos(column: str) -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def _active(window: str) -> Column:
    return _pos(f"viewing_{window}") | _pos(f"developing_{window}")


def _viewer_only_6m() -> Column:
    return _pos("viewing_6m") & ~_pos("developing_6m")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def user_kpis(
    users: DataFrame,
    daily: DataFrame,
    as_of,
    *,
    instance: str | None = None,
    filter_name: str | None = None,
    dedupe_totals: bool = False,
) -> DataFrame:
    """Fleet KPIs in one row.

    Activity is summed per login over all instances while accounts are per instance, so
    action totals count a person once per account; ``dedupe_totals`` counts them once.
    """
    people = current_users(users, instance)
    flags = {"no_consumer": license_filter("users_userprofile", filter_name)}
    for group, label in (("creator", "Creator"), ("consumer", "Consumer"), ("admin", "Admin"), ("other", "Other")):
        flags[f"license_{group}"] = license_group("users_userprofile") == f"{label} Licenses"
    # One row per login carrying flags: every filtered distinct count below becomes a
    # plain conditional count.
    logins = people.groupBy("login_norm").agg(
        F.count(F.lit(1)).alias("_accounts"),
        F.bool_or("enabled").alias("_on"),
        *[F.bool_or(F.col("enabled") & cond).alias(f"_{name}") for name, cond in flags.items()],
    )
    rows = logins.join(_windowed_activity(daily, ["login_norm"], as_of), "login_norm", "left")
    copies = F.lit(1) if dedupe_totals else F.col("_accounts")
    on = F.col("_on")
    windows = list(_windows(as_of))
    counts = {
        "enabled_users": on,
        **{f"enabled_users_{name}": F.col(f"_{name}") for name in flags},
        "viewing_users": on & _pos("total_viewing"),
        "developing_users": on & _pos("total_developing"),
        **{f"active_users_{w}": on & _active(w) for w in windows},
        **{f"developing_users_{w}": on & _pos(f"developing_{w}") for w in windows},
        "viewer_only_users_6m": on & _viewer_only_6m(),
    }
    totals = rows.agg(
        *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        F.coalesce(F.sum(F.col("total_viewing") * copies), F.lit(0)).alias("total_viewing_actions"),
        F.coalesce(F.sum(F.col("total_developing") * copies), F.lit(0)).alias("total_developing_actions"),
    )
    enabled = F.col("enabled_users")
    actions = F.col("total_viewing_actions") + F.col("total_developing_actions")
    totals = totals.withColumns(
        {
            **{f"inactive_users_{w}": F.greatest(F.lit(0), enabled - F.col(f"active_users_{w}")) for w in windows},
            **{f"active_rate_{w}": _rate(F.col(f"active_users_{w}"), enabled) for w in windows},
            **{f"contributor_rate_{w}": _rate(F.col(f"developing_users_{w}"), enabled) for w in windows},
            "developing_action_share": _rate(F.col("total_developing_actions"), actions),
        }
    )
    history = _in_instance(daily, instance).agg(
        F.min("day").alias("activity_history_start"), F.max("day").alias("activity_history_end")
    )
    return merge_single_rows(totals, history)


def _kpis_by(users, daily, as_of, key: Column, name: str, counts: dict[str, Column], instance, filter_name) -> DataFrame:
    people = latest_users(users, instance).filter(license_filter("users_userprofile", filter_name))
    activity = _windowed_activity(_in_instance(daily, instance), ["instance_name", "login_norm"], as_of)
    on = F.coalesce(F.col("users_enabled") == "True", F.lit(False))
    joined = people.join(activity, ["instance_name", "login_norm"], "left")
    logins = joined.groupBy(key.alias(name), "login_norm").agg(
        *[F.bool_or(on & cond).alias(column) for column, cond in counts.items()]
    )
    return logins.groupBy(name).agg(*[F.count_if(column).alias(column) for column in counts])


def _window_counts(*windows: str) -> dict[str, Column]:
    counts = {"enabled_users": F.lit(True)}
    for w in windows:
        counts[f"active_users_{w}"] = _active(w)
        counts[f"developing_users_{w}"] = _pos(f"developing_{w}")
    return counts


def kpis_by_profile(users, daily, as_of, *, instance=None, filter_name=None) -> DataFrame:
    key = F.coalesce(F.trim("users_userprofile"), F.lit("UNKNOWN"))
    return _kpis_by(users, daily, as_of, key, "profile", _window_counts("30d", "90d", "6m"), instance, filter_name)


def kpis_by_license_group(users, daily, as_of, *, instance=None, filter_name=None) -> DataFrame:
    key = license_group("users_userprofile")
    return _kpis_by(users, daily, as_of, key, "license_group", _window_counts("30d", "90d", "6m"), instance, filter_name)


def kpis_by_instance(users, daily, as_of, *, instance=None, filter_name=None) -> DataFrame:
    counts = {
        "enabled_users": F.lit(True),
        "viewing_users": _pos("viewing_6m"),
        "developing_users": _pos("developing_6m"),
        "active_users_6m": _active("6m"),
        "viewer_only_users_6m": _viewer_only_6m(),
    }
    out = _kpis_by(users, daily, as_of, F.col("instance_name"), "instance_name", counts, instance, filter_name)
    enabled, active = F.col("enabled_users"), F.col("active_users_6m")
    return out.withColumns(
        {
            "inactive_users_6m": F.greatest(F.lit(0), enabled - active),
            "active_rate_6m": _rate(active, enabled),
            "contributor_rate_6m": _rate(F.col("developing_users"), enabled),
        }
    )


# --- directory ---------------------------------------------------------------------------


def _directory_records(users: DataFrame) -> DataFrame:
    profile = first_text("users_resultinguserprofile", "users_userprofile")
    return latest_users(users).select(
        "instance_name",
        F.trim("users_login").alias("login"),
        "login_norm",
        null_if_blank("users_displayname").alias("display_name"),
        null_if_blank("users_email").alias("email"),
        (F.col("users_enabled") == "True").alias("enabled"),
        profile.alias("user_profile"),
        license_group(profile).alias("license_group"),
        "run_ts",
    )


def directory_facets(users: DataFrame, instance: str | None = None) -> DataFrame:
    """Filter values of the directory as (facet_type, value) rows."""
    rows = _in_instance(_directory_records(users), instance)
    groups = rows.select(F.lit("license_group").alias("facet_type"), F.col("license_group").alias("value")).distinct()
    profile = F.coalesce("user_profile", F.lit("UNKNOWN"))
    profiles = rows.select(F.lit("license_profile").alias("facet_type"), profile.alias("value")).distinct()
    return groups.unionByName(profiles)


def _directory_order(sort: str) -> list[Column]:
    name, login, seen = F.lower("display_name"), F.col("login_norm"), F.col("latest_activity_at")
    orders = {
        "display_name_asc": [name.asc(), login.asc()],
        "display_name_desc": [name.desc(), login.asc()],
        "login_asc": [login.asc()],
        "login_desc": [login.desc()],
        "activity_desc": [seen.desc_nulls_last(), name.asc(), login.asc()],
        "activity_asc": [seen.asc_nulls_last(), name.asc(), login.asc()],
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}; expected one of {sorted(orders)}")
    return orders[sort]


def _joined_set(column: Column | str) -> Column:
    # One login has at most one record per instance, so these sets stay small.
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def directory_matches(
    users: DataFrame,
    daily: DataFrame,
    *,
    q: str | None = None,
    status: str = "all",
    group: str | None = None,
    profile: str | None = None,
    instance: str | None = None,
) -> DataFrame:
    """Every login with at least one matching record, summarised over its records."""
    if status not in ("all", "enabled", "disabled"):
        raise ValueError(f"unknown account status {status!r}")
    records = _in_instance(_directory_records(users), instance)
    hit = F.lit(True)
    if q:
        pattern = q.lower()
        texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("display_name", "login_norm", "email")]
        hit = hit & (texts[0].contains(pattern) | texts[1].contains(pattern) | texts[2].contains(pattern))
    if status != "all":
        hit = hit & F.coalesce(F.col("enabled") == (status == "enabled"), F.lit(False))
    if group:
        hit = hit & (F.col("license_group") == group)
    if profile:
        hit = hit & (F.coalesce("user_profile", F.lit("UNKNOWN")) == profile)

    # A login is listed when any of its records matches; its summary covers all of
    # them. Carrying the match as a flag avoids joining the records with themselves.
    grouped = records.groupBy("login_norm").agg(
        F.bool_or(hit).alias("_match"),
        F.max("display_name").alias("_name"),
        F.max("login").alias("representative_login"),
        F.max("email").alias("email"),
        F.count(F.lit(1)).alias("instance_count"),
        _joined_set("instance_name").alias("instances"),
        _joined_set(F.coalesce("user_profile", F.lit("UNKNOWN"))).alias("license_profiles"),
        _joined_set("license_group").alias("license_groups"),
        F.count_if("enabled").alias("_on"),
        F.count_if(F.col("enabled") == F.lit(False)).alias("_off"),
        F.count_if(F.col("enabled").isNull()).alias("_unknown"),
    )
    seen = _in_instance(daily, instance).groupBy("login_norm").agg(F.max("last_activity_at").alias("latest_activity_at"))
    on, off, unknown = F.col("_on") > 0, F.col("_off") > 0, F.col("_unknown") > 0
    label = (
        F.when(on & ~off & ~unknown, "Enabled")
        .when(off & ~on & ~unknown, "Disabled")
        .when(unknown & ~on & ~off, "Unknown")
        .otherwise("Mixed")
    )
    return grouped.filter("_match").join(seen, "login_norm", "left").select(
        "login_norm",
        F.coalesce("_name", "representative_login", "login_norm").alias("display_name"),
        "representative_login",
        "email",
        "instance_count",
        "instances",
        "license_profiles",
        "license_groups",
        label.alias("account_status"),
        "latest_activity_at",
    )


def directory(users: DataFrame, daily: DataFrame, *, sort: str = "display_name_asc", limit: int = 25, offset: int = 0, **filters) -> DataFrame:
    """One page of :func:`directory_matches`."""
    return top_n(directory_matches(users, daily, **filters), _directory_order(sort), positive(limit, "limit"), offset)


# --- one person -----------------------------------------------------------------------------


def _person(df: DataFrame, login: str, as_of, days, months, instance) -> DataFrame:
    rows = df.filter(F.col("login_norm") == login.strip().lower())
    return _in_instance(rows.filter(window_predicate("last_activity_at", as_of, months=months, days=days)), instance)


def user_detail_summary(project_daily: DataFrame, login: str, as_of, *, days=30, months=None, instance=None) -> DataFrame:
    totals = _person(project_daily, login, as_of, days, months, instance).agg(
        F.coalesce(F.sum("viewing_actions_count"), F.lit(0)).alias("viewing"),
        F.coalesce(F.sum("developing_actions_count"), F.lit(0)).alias("developing"),
        F.max("last_activity_at").alias("last_activity_at"),
        F.count_distinct("instance_name").alias("instances"),
        F.count_distinct("project_key").alias("projects"),
    )
    viewing, developing = F.col("viewing"), F.col("developing")
    total = viewing + developing
    mode = (
        F.when(developing > viewing, "developer")
        .when(viewing > developing, "viewer")
        .when(total > 0, "balanced")
        .otherwise("inactive")
    )
    return totals.withColumns(
        {
            "total_actions": total,
            "activity_mode": mode,
            "developing_share": _rate(developing, total),
            "viewing_share": _rate(viewing, total),
        }
    )


def _group_list(column: str) -> Column:
    """Group names from a JSON (or quoted) list, or a single plain name."""
    text = null_if_blank(column)
    parsed = F.from_json(text, "array<string>")
    cleaned = F.filter(F.transform(parsed, F.trim), lambda g: g != "")
    is_list = text.startswith("[") & parsed.isNotNull()
    return F.when(is_list, cleaned).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def user_detail_instances(users: DataFrame, login: str, instance: str | None = None) -> DataFrame:
    """Newest record per instance for one login; ``is_best`` marks the most complete one."""
    mine = users.filter(login_norm("users_login") == login.strip().lower())
    boolean = F.lower(F.trim(F.col("users_enabled").cast("string")))
    records = latest_users(mine, instance).select(
        "instance_name",
        F.col("users_login").alias("login"),
        "login_norm",
        F.col("users_displayname").alias("display_name"),
        F.col("users_email").alias("email"),
        first_text("users_resultinguserprofile", "users_userprofile").alias("user_profile"),
        F.when(boolean.isin("true", "1", "1.0"), F.lit(True)).when(boolean.isin("false", "0", "0.0"), F.lit(False)).alias("enabled"),
        *[
            F.col(c).alias(c.removeprefix("users_"))
            for c in (
                "users_sourcetype", "users_creationdate", "users_lastsuccessfullogin", "users_lastfailedlogin",
                "users_lastsessionactivity", "users_first_commit_date", "users_last_commit_date",
            )
            if c in users.columns
        ],
        _group_list("users_groups").alias("groups"),
        "run_ts",
        "partition_date",
    )
    completeness = [
        has_text("display_name").desc(),
        has_text("email").desc(),
        has_text("user_profile").desc(),
        F.col("enabled").isNotNull().desc(),
        F.col("run_ts").desc_nulls_last(),
        F.col("partition_date").desc_nulls_last(),
        F.col("instance_name").desc(),
    ]
    rank = F.row_number().over(Window.partitionBy("login_norm").orderBy(*completeness))
    return records.withColumn("is_best", rank == 1)


def _sums(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy(label).agg(
        F.sum("viewing_actions_count").alias("viewing"), F.sum("developing_actions_count").alias("developing")
    )


def user_daily(daily: DataFrame, login: str, as_of, *, days=30, months=None, instance=None) -> DataFrame:
    return _sums(_person(daily, login, as_of, days, months, instance), F.col("day"))


def user_monthly(daily: DataFrame, login: str, as_of, *, days=30, months=None, instance=None) -> DataFrame:
    month = F.trunc("last_activity_at", "month").alias("month")
    return _sums(_person(daily, login, as_of, days, months, instance), month)


def user_top_projects(project_daily: DataFrame, login: str, as_of, *, days=30, months=None, instance=None, limit=10) -> DataFrame:
    rows = _person(project_daily, login, as_of, days, months, instance)
    totals = rows.groupBy("instance_name", "project_key").agg(
        F.sum("viewing_actions_count").alias("viewing"),
        F.sum("developing_actions_count").alias("developing"),
        F.max("last_activity_at").alias("last_activity_at"),
    )
    order = [F.col("developing").desc_nulls_last(), F.col("viewing").desc_nulls_last(), F.col("instance_name").asc(), F.col("project_key").asc()]
    return top_n(totals, order, positive(limit, "limit"))


# --- active users over calendar months and periods ---------------------------------------------


def _eligible(users: DataFrame, activity_filter: str | None) -> DataFrame:
    people = latest_users(users).filter(
        (F.col("users_enabled") == "True") & license_filter("users_userprofile", activity_filter)
    )
    return people.select("instance_name", "login_norm")


def _presence(activity: DataFrame, moment: str, bucket: Column, name: str, low: dt.date, high: dt.date, instance) -> DataFrame:
    """Distinct (bucket, instance, login) between two days: one small row per person."""
    rows = _in_instance(activity, instance).filter((F.col(moment) >= _ts(low)) & (F.col(moment) < _ts(high)))
    return rows.select(bucket.alias(name), "instance_name", "login_norm").distinct()


def _instances(users: DataFrame, instance: str | None) -> DataFrame:
    return _in_instance(users, instance).filter("instance_name IS NOT NULL").select("instance_name").distinct()


def _headcount(present: DataFrame, keys: list[str], spine: DataFrame) -> DataFrame:
    counted = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_users"))
    return spine.join(counted, keys, "left").withColumn("active_users", F.coalesce("active_users", F.lit(0)))


def _monthly_presence(activity, moment, as_of, months, instance) -> DataFrame:
    low, high = month_start(as_of, months - 1), month_start(as_of, -1)
    bucket = F.trunc(moment, "month")
    return _presence(activity, moment, bucket, "month_start", low, high, instance)


def active_monthly(spark: SparkSession, daily, users, as_of, *, months=3, activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    """Active (instance, login) pairs per calendar month, months without activity included."""
    present = _monthly_presence(daily, "last_activity_at", as_of, months, instance)
    present = present.join(_eligible(users, activity_filter), ["instance_name", "login_norm"], "left_semi")
    return _headcount(present, ["month_start"], month_spine(spark, as_of, months))


def active_monthly_by_instance(daily, users, as_of, *, months=3, activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    """As :func:`active_monthly` on a dense month by instance grid."""
    present = _monthly_presence(daily, "last_activity_at", as_of, months, instance)
    present = present.join(_eligible(users, activity_filter), ["instance_name", "login_norm"], "left_semi")
    grid = explode_months(_instances(users, instance), as_of, months)
    return _headcount(present, ["month_start", "instance_name"], grid)


def _period_presence(activity, moment, as_of, period, instance) -> DataFrame:
    # Periods tile the calendar, so the period of a moment is a truncation: the range
    # join becomes an equality on the truncated day. The cutoff is a plain filter.
    low = period_bounds(as_of, period)[0][0]
    high = day_floor(as_of) + dt.timedelta(days=1)
    return _presence(activity, moment, period_of(moment, period), "period_start", low, high, instance)


def adoption_observed(spark, daily, users, as_of, *, period="monthly", activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    present = _period_presence(daily, "last_activity_at", as_of, period, instance)
    present = present.join(_eligible(users, activity_filter), ["instance_name", "login_norm"], "left_semi")
    return _headcount(present, ["period_start"], period_spine(spark, as_of, period))


def adoption_observed_by_instance(daily, users, as_of, *, period="monthly", activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    present = _period_presence(daily, "last_activity_at", as_of, period, instance)
    present = present.join(_eligible(users, activity_filter), ["instance_name", "login_norm"], "left_semi")
    grid = explode_periods(_instances(users, instance), as_of, period)
    return _headcount(present, ["period_start", "instance_name"], grid)


def adoption_extent(daily: DataFrame, as_of, instance: str | None = None) -> DataFrame:
    cutoff = _ts(day_floor(as_of) + dt.timedelta(days=1))
    return _in_instance(daily, instance).filter(F.col("last_activity_at") < cutoff).agg(
        F.min("last_activity_at").alias("first_observation"), F.max("last_activity_at").alias("last_observation")
    )


def adoption_formal(spark, formal: DataFrame, as_of, *, period="monthly", instance=None) -> DataFrame:
    """Formal active users per period over the enriched daily opens."""
    present = _period_presence(formal, "last_application_open_at", as_of, period, instance)
    return _headcount(present, ["period_start"], period_spine(spark, as_of, period))


def adoption_formal_by_instance(formal: DataFrame, users: DataFrame, as_of, *, period="monthly", instance=None) -> DataFrame:
    present = _period_presence(formal, "last_application_open_at", as_of, period, instance)
    return _headcount(present, ["period_start", "instance_name"], explode_periods(_instances(users, instance), as_of, period))


def _profile_split(present: DataFrame, users: DataFrame, by_instance: bool) -> DataFrame:
    profiles = current_users(users).select("instance_name", "login_norm", "license_group", "user_profile")
    people = present.select("instance_name", "login_norm").join(profiles, ["instance_name", "login_norm"])
    keys = (["instance_name"] if by_instance else []) + ["license_group", "user_profile"]
    return people.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_users"))


def _current_period_presence(formal, as_of, period, instance) -> DataFrame:
    low = period_bounds(as_of, period)[-1][0]
    high = day_floor(as_of) + dt.timedelta(days=1)
    moment = "last_application_open_at"
    return _presence(formal, moment, period_of(moment, period), "period_start", low, high, instance)


def adoption_formal_by_profile(formal, users, as_of, *, period="monthly", instance=None, by_instance=False) -> DataFrame:
    """Formal active users of the current period by licence group and profile."""
    return _profile_split(_current_period_presence(formal, as_of, period, instance), users, by_instance)


def formal_mau_monthly(spark, formal: DataFrame, as_of, *, months=3, instance=None) -> DataFrame:
    present = _monthly_presence(formal, "last_application_open_at", as_of, months, instance)
    return _headcount(present, ["month_start"], month_spine(spark, as_of, months))


def formal_mau_monthly_by_instance(formal, users, as_of, *, months=3, instance=None) -> DataFrame:
    present = _monthly_presence(formal, "last_application_open_at", as_of, months, instance)
    return _headcount(present, ["month_start", "instance_name"], explode_months(_instances(users, instance), as_of, months))


def formal_mau_monthly_by_profile(formal, users, as_of, *, instance=None, by_instance=False) -> DataFrame:
    """Profile split of the current calendar month."""
    return _profile_split(_monthly_presence(formal, "last_application_open_at", as_of, 1, instance), users, by_instance)


# --- behaviour -------------------------------------------------------------------------------------


def segments(users, daily, as_of, *, days=30, months=None, activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    """How enabled people use the platform in the window, in one row."""
    people = current_users(users, instance)
    if activity_filter == LICENSE_CONSUMER:
        people = people.filter(license_filter("users_userprofile", "no_consumer"))
    logins = people.groupBy("login_norm").agg(F.bool_or("enabled").alias("_on")).filter("_on")
    rows = _in_instance(daily.filter(window_predicate("last_activity_at", as_of, months=months, days=days)), instance)
    activity = rows.groupBy("login_norm").agg(
        F.sum("viewing_actions_count").alias("_v"), F.sum("developing_actions_count").alias("_d")
    )
    v, d = F.coalesce("_v", F.lit(0)), F.coalesce("_d", F.lit(0))
    counts = {
        "viewer_only_users": (v > 0) & (d == 0),
        "developer_only_users": (d > 0) & (v == 0),
        "mixed_users": (v > 0) & (d > 0),
        "viewer_dominant_users": (v > d) & (d > 0),
        "developer_dominant_users": (d > v) & (v > 0),
        "balanced_mixed_users": (v == d) & (v > 0),
    }
    out = logins.join(activity, "login_norm", "left").agg(
        F.count(F.lit(1)).alias("enabled_users"), *[F.count_if(c).alias(name) for name, c in counts.items()]
    )
    used = F.col("viewer_only_users") + F.col("developer_only_users") + F.col("mixed_users")
    return out.withColumn("inactive_users", F.greatest(F.lit(0), F.col("enabled_users") - used))


def stickiness(spark, daily, users, as_of, *, months=6, activity_filter=LICENSE_CREATOR, instance=None) -> DataFrame:
    """Per month: active people split into retained, reactivated and new, and the active rate.

    Eligibility uses every account record that was ever enabled, not only the newest.
    """
    months = positive(months, "months")
    ever = users.filter(
        has_text("users_login") & (F.col("users_enabled") == "True") & license_filter("users_userprofile", activity_filter)
    ).select("instance_name", login_norm("users_login").alias("login_norm"))
    scoped = _in_instance(ever, instance)
    enabled = explode_months(scoped.agg(F.count_distinct("login_norm").alias("enabled_users")), as_of, months)

    present = _monthly_presence(daily, "last_activity_at", as_of, months, instance)
    present = present.join(ever, ["instance_name", "login_norm"], "left_semi").select("month_start", "login_norm").distinct()
    # One row per login and month, so the window is small for every key.
    previous = F.lag("month_start").over(Window.partitionBy("login_norm").orderBy("month_start"))
    prior_month = F.add_months("month_start", -1)
    monthly = present.withColumn("_prev", previous).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("active_users"),
        F.count_if(F.col("_prev") == prior_month).alias("retained_users"),
        F.count_if(F.col("_prev") < prior_month).alias("reactivated_users"),
        F.count_if(F.col("_prev").isNull()).alias("new_active_users"),
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("active_users", "retained_users", "reactivated_users", "new_active_users")]
    out = enabled.join(monthly, "month_start", "left").select("month_start", "enabled_users", *filled)
    return out.withColumn("active_rate", _rate(F.col("active_users"), F.col("enabled_users")))


# --- creator risk -----------------------------------------------------------------------------------------

RISK_MONTHS, RISK_RATIO, RISK_PAGE = 6, 0.05, 10


def _creators(users, daily, as_of, instance) -> DataFrame:
    people = current_users(users, instance).filter(
        F.col("enabled") & (license_group(F.col("user_profile")) == "Creator Licenses")
    )
    start = _ts(add_months(day_floor(as_of), -RISK_MONTHS))

    def inside(metric: str) -> Column:
        return F.sum(F.when(F.col("last_activity_at") >= start, F.col(f"{metric}_actions_count")).otherwise(0)).alias(f"{metric}_6m")

    activity = _in_instance(daily, instance).groupBy("instance_name", "login_norm").agg(
        inside("viewing"), inside("developing"), F.max("last_activity_at").alias("last_activity_at")
    )
    rows = people.join(activity, ["instance_name", "login_norm"], "left").select(
        "instance_name",
        F.trim("users_login").alias("login"),
        "login_norm",
        F.coalesce(F.trim("users_displayname"), F.trim("users_login")).alias("display_name"),
        "user_profile",
        F.coalesce("viewing_6m", F.lit(0)).alias("viewing_6m"),
        F.coalesce("developing_6m", F.lit(0)).alias("developing_6m"),
        "last_activity_at",
    )
    return rows.withColumn(
        "developing_to_viewing_ratio", F.try_divide(F.col("developing_6m").cast("double"), F.col("viewing_6m").cast("double"))
    )


def _is_delinquent() -> Column:
    return (F.col("viewing_6m") == 0) & (F.col("developing_6m") == 0)


def _is_underutilized() -> Column:
    return F.coalesce(F.col("developing_to_viewing_ratio") < RISK_RATIO, F.lit(False))


def creator_risk(users, daily, as_of, kind: str, *, instance=None, page: int = 1, page_size: int | None = RISK_PAGE) -> DataFrame:
    """One page of creator-licence accounts without activity or hardly developing; all of them without a page size."""
    rows = _creators(users, daily, as_of, instance)
    if kind == "delinquent":
        rows = rows.filter(_is_delinquent()).drop("developing_to_viewing_ratio")
        order = [F.col("last_activity_at").desc_nulls_last()]
    elif kind == "underutilized":
        rows = rows.filter(_is_underutilized())
        order = [F.col("developing_to_viewing_ratio").asc(), F.col("viewing_6m").desc()]
    else:
        raise ValueError(f"unknown risk {kind!r}")
    order += [F.col("display_name").asc_nulls_last(), F.col("login").asc(), F.col("instance_name").asc()]
    if page_size is None:
        if page != 1:
            raise ValueError("without a page size there is one page")
        return rows.orderBy(*order)
    return top_n(rows, order, page_size, (positive(page, "page") - 1) * page_size)


def creator_risk_totals(users, daily, as_of, *, instance=None) -> DataFrame:
    return _creators(users, daily, as_of, instance).agg(
        F.count_if(_is_delinquent()).alias("delinquent_rows"), F.count_if(_is_underutilized()).alias("underutilized_rows")
    )
