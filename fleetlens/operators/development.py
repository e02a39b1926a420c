"""Development activity events and where they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import first_text
from fleetlens.plans.dims import DEVELOPMENT_MODULES


def _text_of(df: DataFrame, *names: str) -> Column:
    present = [n for n in names if n in df.columns]
    return first_text(*present) if present else F.lit(None).cast("string")


def activity_origin(authsource: Column, authvia: Column, scenario: Column, job: Column) -> dict[str, Column]:
    """Origin of an event and the evidence for it; the first matching rule wins.

    Explicit or ticket markers of automation come first, then the key or UI source,
    unless the call chain carries a ticket or macro of unknown meaning.
    """
    via = F.coalesce(F.lower(authvia), F.lit(""))
    source = F.coalesce(F.upper(authsource), F.lit(""))
    via_scenario = via.contains("scenario-run:") | via.contains("scenario=")
    via_job = via.contains("ticket:job:")
    known_ticket = via_job | via.contains("ticket:jupyter:") | via.contains("ticket:code studio")
    opaque = (via.contains("ticket:") & ~known_ticket) | via.contains("macro")
    api_key = (source == "PERSONAL_API_KEY") & ~opaque
    direct = (source == "USER_FROM_UI") & ~opaque

    rules = [
        (scenario.isNotNull(), "scenario_automation", "explicit_scenario_marker"),
        (via_scenario, "scenario_automation", "authvia_scenario"),
        (job.isNotNull(), "job_automation", "explicit_job_marker"),
        (via_job, "job_automation", "authvia_ticket_job"),
        (api_key, "api_activity", "personal_api_key"),
        (direct, "direct_ui_user", "ui_no_automation_marker"),
    ]
    origin, evidence = F.lit("unknown_or_other"), F.lit("unclassified")
    for condition, origin_name, evidence_name in reversed(rules):
        origin = F.when(condition, origin_name).otherwise(origin)
        evidence = F.when(condition, evidence_name).otherwise(evidence)
    return {
        "activity_origin": origin,
        "activity_origin_evidence": evidence,
        "has_scenario_marker": scenario.isNotNull() | via_scenario,
        "has_job_marker": job.isNotNull() | via_job,
    }


def dev_activity_events(silver: DataFrame, modules: list[str] | None = DEVELOPMENT_MODULES) -> DataFrame:
    """Events of the development modules with their origin.

    ``silver`` is one frame over all modules; the module list becomes a partition
    filter instead of one scan per module. ``modules=None`` keeps every row.
    """
    rows = silver
    if modules is not None and "module" in silver.columns:
        rows = rows.filter(F.col("module").isin(modules))
    times = [F.col(c) for c in ("timestamp", "date") if c in silver.columns]
    moment = F.coalesce(*times).try_cast("timestamp") if times else F.lit(None).cast("timestamp")
    source = _text_of(silver, "authsource")
    origin = activity_origin(
        source,
        _text_of(silver, "authvia"),
        _text_of(silver, "scenarioid", "smartscenarioid"),
        _text_of(silver, "jobid"),
    )
    return rows.select(
        moment.alias("timestamp"),
        "instance_name",
        F.col("authuser").alias("login"),
        "msgtype",
        "msgtypebase",
        "activity_category",
        "project_key",
        "callpath",
        origin["activity_origin"].alias("activity_origin"),
        source.alias("authsource"),
        origin["has_scenario_marker"].alias("has_scenario_marker"),
        origin["has_job_marker"].alias("has_job_marker"),
        origin["activity_origin_evidence"].alias("activity_origin_evidence"),
        F.col("run_ts").try_cast("timestamp").alias("run_timestamp"),
    )

