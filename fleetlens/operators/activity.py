"""User activity facts: hourly counts from audit rows and their daily rollups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import has_text, login_norm
from fleetlens.plans.dims import ACTION_WORDS, MUTATING_BASES, REMOVE_WORDS

# Source columns in order of preference.
LOGIN_COLUMNS = ["message_login", "message_user", "message_authUser", "mdc_user", "login"]
PROJECT_COLUMNS = ["message_project_key", "message_projectKey", "project_key", "projectKey"]
MSGTYPE_COLUMNS = ["message_msgType", "message_msgtype", "msgType", "msgtype"]
MSGBASE_COLUMNS = ["message_msgTypeBase", "message_msgtypebase", "msgTypeBase", "msgtypebase"]
UI_SOURCE = "USER_FROM_UI"
OPEN_EVENT = "application-open"


def first_column(df: DataFrame, candidates: list[str]) -> Column | None:
    """First non-empty value among the candidate columns the frame has, per row.

    Choosing per row, not per batch, keeps the result independent of partitioning.
    """
    present = [F.when(F.length(F.col(c).cast("string")) > 0, F.col(c)) for c in candidates if c in df.columns]
    return F.coalesce(*present) if present else None


def _words(words: list[str]) -> str:
    return "(?i)" + "|".join(re.escape(w) for w in words)


def is_developing(msgtype: Column, base: Column | None = None) -> Column:
    """A mutating verb base, or action wording without any read-only wording."""
    text = F.coalesce(msgtype.cast("string"), F.lit(""))
    wording = text.rlike(_words(ACTION_WORDS)) & ~text.rlike(_words(REMOVE_WORDS))
    if base is None:
        return wording
    return F.coalesce(F.lower(base), F.lit("")).isin(MUTATING_BASES) | wording


def ui_events(flat: DataFrame) -> DataFrame:
    """Interactive audit rows: generic topic, no scenario or job, UI source, a login.

    Adds ``login_value`` and ``hour``; works on batch and streaming frames alike.
    """
    rows = flat
    if "topic" in flat.columns:
        rows = rows.filter(F.col("topic") == "generic")
    for marker in ("message_scenarioId", "message_jobId"):
        if marker in flat.columns:
            rows = rows.filter(F.col(marker).isNull())
    if "message_authSource" in flat.columns:
        rows = rows.filter(F.col("message_authSource") == UI_SOURCE)
    login = first_column(flat, LOGIN_COLUMNS)
    if login is None:
        raise ValueError(f"no login column; expected one of {LOGIN_COLUMNS}")
    moment = F.col("timestamp").cast("timestamp")
    return (
        rows.withColumn("login_value", login.cast("string"))
        .withColumn("hour", F.date_trunc("hour", moment))
        .filter((F.length("login_value") > 0) & F.col("hour").isNotNull())
    )


def with_activity_flags(rows: DataFrame) -> DataFrame:
    msgtype = first_column(rows, MSGTYPE_COLUMNS)
    if msgtype is None:
        raise ValueError(f"no message type column; expected one of {MSGTYPE_COLUMNS}")
    project = first_column(rows, PROJECT_COLUMNS)
    return rows.withColumns(
        {
            "activity_project": F.lit(None).cast("string") if project is None else project,
            "developing": is_developing(msgtype, first_column(rows, MSGBASE_COLUMNS)).cast("long"),
        }
    )


def user_activity_hourly(flat: DataFrame) -> DataFrame:
    """Viewing and developing actions per (instance, hour, login, project or null)."""
    rows = with_activity_flags(ui_events(flat))
    return rows.groupBy(
        "instance_name",
        F.col("hour").alias("timestamp"),
        F.col("login_value").alias("login"),
        F.col("activity_project").alias("project_key"),
    ).agg(
        F.count(F.lit(1)).alias("viewing_actions_count"),
        F.sum("developing").alias("developing_actions_count"),
    )


def formal_mau_hourly(flat: DataFrame) -> DataFrame:
    """Application-open events per (instance, hour, login)."""
    msgtype = first_column(flat, MSGTYPE_COLUMNS)
    rows = ui_events(flat).filter(F.lower(F.regexp_replace(msgtype, r"^\s+|\s+$", "")) == OPEN_EVENT)
    return rows.groupBy(
        "instance_name", F.col("hour").alias("timestamp"), F.col("login_value").alias("login")
    ).agg(F.count(F.lit(1)).alias("application_open_count"))


def _daily(hourly: DataFrame, keys: list[str], measures: list[Column], since) -> DataFrame:
    rows = hourly.filter(F.col("timestamp").isNotNull() & has_text("login"))
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(str(since)).cast("timestamp"))
    return rows.groupBy(
        F.to_date("timestamp").alias("day"), "instance_name", login_norm("login").alias("login_norm"), *keys
    ).agg(F.min(F.trim("login")).alias("login"), *measures)


def _activity_measures() -> list[Column]:
    return [
        F.coalesce(F.sum("viewing_actions_count"), F.lit(0)).alias("viewing_actions_count"),
        F.coalesce(F.sum("developing_actions_count"), F.lit(0)).alias("developing_actions_count"),
        F.max("timestamp").alias("last_activity_at"),
    ]


def user_activity_daily(hourly: DataFrame, since: str | None = None) -> DataFrame:
    """One row per (day, instance, login). ``since`` bounds the build to late data."""
    return _daily(hourly, [], _activity_measures(), since)


def user_activity_project_daily(hourly: DataFrame, since: str | None = None) -> DataFrame:
    """As :func:`user_activity_daily` per project; rows without a project are left out."""
    return _daily(hourly.filter(has_text("project_key")), ["project_key"], _activity_measures(), since)


def formal_mau_daily(hourly: DataFrame) -> DataFrame:
    opens = F.col("application_open_count").try_cast("long")
    measures = [
        F.coalesce(F.sum(opens), F.lit(0)).alias("application_open_count"),
        F.max("timestamp").alias("last_application_open_at"),
    ]
    return _daily(hourly, [], measures, None)
