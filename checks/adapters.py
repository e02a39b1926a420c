"""Project the driver tables onto the shapes the library consumes.

Each adapter is one SELECT over a whole driver table, written once and rendered for
Spark and for the checking engine; the few functions that differ are in ``_D``.
Nothing is filtered out: modulo arithmetic only picks spellings and labels.
"""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import configure

AS_OF = dt.datetime(2024, 1, 31)
TASK_ROWS = 100_000  # driver rows of one task where a table is spread

_D = {
    "spark": {
        "quote": "`",
        # The JSON is read by a generator: a filter on what follows from ``k`` stays above it. Pushed below the
        # shuffle of the events, it would read the JSON again for each of its mentions of ``k``.
        "events": "(SELECT *, inline(array(named_struct('k', CAST(get_json_object(props, '$.k') AS INT)))) FROM events)",
        "json_k": "k",
        "epoch": lambda e: f"timestamp_seconds({e})",
        "explode": lambda *xs: f"explode(array({', '.join(xs)}))",
        "date": lambda e: f"CAST({e} AS DATE)",
    },
    "duckdb": {
        "quote": '"',
        "events": "events",
        "json_k": "CAST(json_extract_string(props, '$.k') AS INT)",
        "epoch": lambda e: f"make_timestamp(CAST(({e}) AS BIGINT) * 1000000)",
        "explode": lambda *xs: f"unnest([{', '.join(xs)}])",
        "date": lambda e: f"CAST({e} AS DATE)",
    },
}


def _text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


def audit_sql(engine: str) -> str:
    """Audit events after flattening: login spellings, origin markers, odd categories."""
    k = _D[engine]["json_k"]
    return f"""
SELECT event_id, date_trunc('second', ts) AS timestamp,
  concat('inst_', {_text('user_id % 3')}) AS instance_name,
  CASE WHEN event_id % 50 = 0 THEN NULL
       WHEN event_id % 7 = 0 THEN concat('  User', {_text('user_id')}, ' ')
       WHEN event_id % 5 = 0 THEN concat('USER', {_text('user_id')})
       ELSE concat('user', {_text('user_id')}) END AS authuser,
  CASE event_type WHEN 'signup' THEN 'application-open' WHEN 'purchase' THEN 'recipe-save'
       WHEN 'view' THEN 'sql-query-fetch' WHEN 'click' THEN 'SQL Notebook-Execute'
       ELSE 'mystery-event' END AS msgtype,
  CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'read'
       WHEN 'click' THEN 'action' ELSE 'other' END AS msgtypebase,
  CASE event_id % 6 WHEN 0 THEN 'DATASET' WHEN 1 THEN 'Visual Recipes' WHEN 2 THEN 'coding'
       WHEN 3 THEN 'mlops' WHEN 4 THEN 'genai-llm' ELSE 'zz_unmapped' END AS activity_category,
  CASE event_id % 4 WHEN 0 THEN 'PERSONAL_API_KEY' WHEN 1 THEN NULL ELSE 'USER_FROM_UI' END AS authsource,
  CASE event_id % 9 WHEN 0 THEN 'scenario=P1.daily run' WHEN 1 THEN 'ticket:job:P2.build'
       WHEN 2 THEN 'ticket:jupyter:P3.nb' WHEN 3 THEN 'macro runner' WHEN 4 THEN 'ticket:other:x'
       ELSE '' END AS authvia,
  CASE WHEN event_id % 31 = 0 THEN 'NIGHTLY' WHEN event_id % 2 = 0 THEN ' ' ELSE NULL END AS scenarioid,
  CASE WHEN event_id % 37 = 0 THEN 'BUILD_7' ELSE NULL END AS jobid,
  CASE WHEN {k} % 10 = 0 THEN NULL ELSE concat('P', {_text(f'{k} % 10')}) END AS project_key,
  CASE WHEN event_id % 3 = 0 THEN '/api/projects/x' ELSE NULL END AS callpath,
  props AS extras,
  user_id * 2 + {k} AS obj,
  date_trunc('second', ts) + INTERVAL 1 DAY AS run_ts
FROM {_D[engine]["events"]}"""


def audit_flat_sql(engine: str) -> str:
    """Audit lines with the flattened ``message_*`` columns the hourly processors read."""
    k = _D[engine]["json_k"]
    return f"""
SELECT event_id, date_trunc('second', ts) AS timestamp,
  CASE WHEN event_id % 13 = 0 THEN 'client' ELSE 'generic' END AS topic,
  concat('inst_', {_text('user_id % 3')}) AS instance_name,
  CASE WHEN user_id % 10 = 2 AND event_type IN ('purchase', 'click') THEN 'project-list'
       WHEN event_type = 'signup' THEN 'application-open' WHEN event_type = 'purchase' THEN 'recipe-save'
       WHEN event_type = 'view' THEN 'dataset-read-meta' WHEN event_type = 'click' THEN 'Webapp-Publish'
       ELSE ' Application-Open ' END AS message_msgType,
  CASE CASE WHEN user_id % 10 = 2 THEN 'view' ELSE event_type END WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'SAVE' WHEN 'view' THEN 'read'
       WHEN 'click' THEN NULL ELSE 'open' END AS message_msgTypeBase,
  CASE WHEN event_id % 5 = 0 THEN 'PERSONAL_API_KEY' ELSE 'USER_FROM_UI' END AS message_authSource,
  CASE WHEN event_id % 40 = 0 THEN '' WHEN event_id % 41 = 0 THEN NULL
       WHEN event_id % 3 = 0 THEN concat(' USER', {_text('user_id')})
       ELSE concat('user', {_text('user_id')}) END AS message_authUser,
  CASE WHEN {k} % 10 = 0 THEN NULL WHEN {k} % 10 = 9 THEN ' '
       ELSE concat('P', {_text(f'{k} % 10')}) END AS message_projectKey,
  CASE WHEN event_id % 29 = 0 THEN 'NIGHTLY' ELSE NULL END AS message_scenarioId,
  CASE WHEN event_id % 23 = 0 THEN 'BUILD_7' ELSE NULL END AS message_jobId
FROM {_D[engine]["events"]}"""


def users_sql(engine: str) -> str:
    """Two snapshots of every account, on one or two instances."""
    explode = _D[engine]["explode"]
    home, away = f"concat('inst_', {_text('user_id % 3')})", f"concat('inst_', {_text('(user_id + 1) % 3')})"
    early, late = "TIMESTAMP '2024-01-15 06:00:00'", "TIMESTAMP '2024-01-30 18:00:00'"
    return f"""
SELECT user_id, instance_name,
  CASE WHEN user_id % 6 = 0 THEN concat(' USER', {_text('user_id')}, ' ') ELSE concat('User', {_text('user_id')}) END AS users_login,
  CASE WHEN user_id % 10 = 0 THEN ' ' ELSE concat('Name ', {_text('user_id')}) END AS users_displayname,
  CASE WHEN user_id % 9 = 0 THEN concat('u', {_text('user_id')}, '@vendor.com')
       WHEN user_id % 9 = 1 THEN NULL ELSE concat('u', {_text('user_id')}, '@example.org') END AS users_email,
  CASE WHEN user_id % 13 = 0 THEN NULL WHEN user_id % 8 = 0 THEN 'False' ELSE 'True' END AS users_enabled,
  CASE WHEN run_ts < {late} THEN 'READER'
       WHEN user_id % 5 = 0 THEN 'DESIGNER' WHEN user_id % 5 = 1 THEN 'READER' WHEN user_id % 5 = 2 THEN 'FULL_DESIGNER'
       WHEN user_id % 5 = 3 THEN 'PLATFORM_ADMIN' ELSE ' Custom_X ' END AS users_userprofile,
  CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN NULL ELSE 'FULL_DESIGNER' END AS users_resultinguserprofile,
  CASE WHEN user_id % 2 = 0 THEN '["builders", "all"]' ELSE '["all"]' END AS users_groups,
  CASE WHEN user_id % 3 = 0 THEN 'LDAP' ELSE 'LOCAL' END AS users_sourcetype,
  CASE WHEN user_id % 11 = 0 THEN 'True' ELSE 'False' END AS users_trialstatus_exists,
  '2023-06-01 08:00:00' AS users_creationdate,
  run_ts AS users_lastsessionactivity,
  run_ts, {_D[engine]['date']('run_ts')} AS partition_date
FROM (
  SELECT user_id, instance_name, {explode(early, late)} AS run_ts
  FROM (
    SELECT user_id, {explode(home, f'CASE WHEN user_id % 4 = 0 THEN {away} ELSE NULL END')} AS instance_name
    FROM (SELECT DISTINCT user_id FROM events) u
  ) i
) s
WHERE instance_name IS NOT NULL"""


def max_licenses_sql(engine: str) -> str:
    """Daily entitlement snapshots: several runs per day, zero, text and blank values."""
    run = _D[engine]["epoch"]("1704067200 + CAST(floor(c_custkey / 45) AS BIGINT) % 30 * 86400 + c_custkey % 45 * 600")
    return f"""
SELECT c_custkey, instance_name, license_profile, max_licenses, run_ts, {_D[engine]['date']('run_ts')} AS partition_date
FROM (SELECT c_custkey, concat('inst_', {_text('c_custkey % 3')}) AS instance_name,
  CASE c_custkey % 7 WHEN 0 THEN 'DESIGNER' WHEN 1 THEN 'READER' WHEN 2 THEN 'FULL_DESIGNER'
       WHEN 3 THEN 'PLATFORM_ADMIN' WHEN 4 THEN 'Full Designer' WHEN 5 THEN 'SUBLICENSE_READER' ELSE ' ' END AS license_profile,
  CASE WHEN c_custkey % 11 = 0 THEN 'unlimited' WHEN c_custkey % 17 = 0 THEN '0'
       ELSE {_text('c_custkey % 40 + 1')} END AS max_licenses,
  {run} AS run_ts FROM customer) c"""


def inventory_sql(engine: str) -> str:
    """Four snapshots of every object; some objects exist in two projects."""
    obj = "CAST(floor(p_partkey / 4) AS BIGINT)"
    run = _D[engine]["epoch"]("1704067200 + p_partkey % 4 * 604800 + p_partkey")
    ms = _text("1702857600000 + obj % 40 * 86400000")
    sec = _text("1702857600 + obj % 40 * 86400")
    return f"""
SELECT obj, instance_name, project_key, object_key, object_name, object_subtype, owner_login,
  created_text, updated_text, extras, run_ts, {_D[engine]['date']('run_ts')} AS partition_date
FROM (SELECT obj, concat('inst_', {_text('obj % 3')}) AS instance_name,
  CASE WHEN obj % 7 = 0 AND p_partkey % 4 = 3 THEN 'P_ALT' ELSE concat('P', {_text('obj % 10')}) END AS project_key,
  CASE WHEN obj % 11 = 5 THEN concat('gone', {_text('obj')}) ELSE concat('obj', {_text('obj')}) END AS object_key,
  CASE WHEN obj % 13 = 0 THEN ' ' WHEN obj % 13 = 1 THEN 'Demo' ELSE p_name END AS object_name,
  CASE WHEN obj % 8 = 0 THEN NULL ELSE p_brand END AS object_subtype,
  CASE WHEN obj % 9 = 0 THEN NULL ELSE concat('user', {_text('obj % 150')}) END AS owner_login,
  CASE obj % 4 WHEN 0 THEN {ms} WHEN 1 THEN {sec} WHEN 2 THEN '2024-01-02 03:04:05' ELSE 'unknown' END AS created_text,
  CASE WHEN obj % 5 = 0 THEN NULL ELSE {sec} END AS updated_text,
  CASE obj % 3 WHEN 0 THEN concat('{{"description": " about ', {_text('obj')}, ' "}}')
       WHEN 1 THEN concat('{{"meta_description": "note ', {_text('obj')}, '"}}') ELSE NULL END AS extras,
  {run} AS run_ts, p_partkey
FROM (SELECT *, {obj} AS obj FROM part) p) q"""


def object_silver_sql(engine: str) -> str:
    """Routed audit events carrying object identifiers; every event is delivered twice."""
    explode = _D[engine]["explode"]
    return f"""
SELECT event_id, timestamp,
  CASE WHEN event_id % 19 = 0 THEN concat('INST_', {_text('obj % 3')}) ELSE concat('inst_', {_text('obj % 3')}) END AS instance_name,
  CASE obj % 6 WHEN 0 THEN 'datasets' WHEN 1 THEN 'visual_recipes' WHEN 2 THEN 'apis' WHEN 3 THEN 'webapps'
       WHEN 4 THEN 'charts_dashboard' ELSE 'application_designer' END AS module,
  CASE WHEN event_id % 50 = 0 THEN ' ' ELSE authuser END AS authuser,
  CASE WHEN event_id % 100 = 0 THEN 'fallback_user' ELSE NULL END AS {_D[engine]['quote']}user{_D[engine]['quote']},
  CASE WHEN event_id % 43 = 0 THEN 'application-open' ELSE msgtype END AS msgtype,
  CASE WHEN copy = 1 THEN upper(activity_category) ELSE activity_category END AS activity_category,
  CASE WHEN obj % 10 = 0 THEN NULL WHEN event_id % 17 = 0 THEN concat(' p', {_text('obj % 10')}, ' ')
       ELSE concat('P', {_text('obj % 10')}) END AS project_key,
  concat('obj', {_text('obj')}) AS datasetname,
  concat('obj', {_text('obj')}) AS recipename,
  CASE event_id % 3 WHEN 0 THEN concat('obj', {_text('obj')}) ELSE NULL END AS webappid,
  CASE event_id % 3 WHEN 1 THEN concat('obj', {_text('obj')}) ELSE ' ' END AS webappid_source_call,
  CASE WHEN obj % 12 < 6 THEN concat('obj', {_text('obj')}) ELSE NULL END AS dashboardid,
  CASE WHEN event_id % 2 = 0 THEN concat('obj', {_text('obj')}) ELSE NULL END AS insightid,
  CASE WHEN event_id % 61 = 0 THEN '{{serviceId}}' ELSE concat('obj', {_text('obj')}) END AS serviceid,
  CASE WHEN event_id % 2 = 0 THEN concat('obj', {_text('obj')}) ELSE '' END AS applicationid,
  CASE WHEN event_id % 2 = 0 THEN '10.0.0.1' ELSE NULL END AS clientip,
  CASE WHEN event_id % 3 = 0 THEN '10.0.0.2' ELSE NULL END AS originalip,
  concat('{{"webappid": "obj', {_text('obj')}, '", "insightId": "obj', {_text('obj')}, '", "appId": "obj', {_text('obj')}, '"}}') AS extras,
  CASE WHEN copy = 1 THEN run_ts + INTERVAL 1 DAY ELSE run_ts END AS run_ts
FROM (SELECT *, {explode('0', '1')} AS copy FROM audit) c"""


def license_payload_sql(engine: str) -> str:
    """Licensing status payloads as JSON text, in the nested and the flat spelling."""
    run = _D[engine]["epoch"]("1706000000 + s_suppkey * 60")
    n = _text("s_suppkey % 50")
    content = f"""concat('"licenseContent":{{"instanceId":"i', {_text('s_suppkey')}, '","licenseKind":"',
    CASE WHEN s_suppkey % 3 = 0 THEN 'TRIAL' ELSE 'ENTERPRISE' END, '","licenseId":"L', {_text('s_suppkey')},
    '","licensee":{{"company":"', s_name, '","name":"admin"}},"properties":{{"standardOffer":"o1","emittedBy":"x","emittedOn":"20240105",',
    '"addons.stories":"', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'no' END, '","addons.advancedGovern":"1",',
    '"maxReaders":"', {n}, '","maxAIConsumers":"unlimited","users.profiles.DESIGNER.max":"', {n}, '"}}}}')"""
    limits = f"""CASE WHEN s_suppkey % 2 = 0 THEN concat(',"profileLimits":{{"READER":{{"licensed":{{"profile":"READER","licensedLimit":"', {n},
    '"}}}},"odd":{{"profile":"FULL_DESIGNER","licensed":{{"licensedLimit":"unlimited"}}}},"DESIGNER":{{}}}}') ELSE '' END"""
    sub = f"""CASE WHEN s_suppkey % 5 = 0 THEN concat(',"sublicense":{{"profileLimits":{{"READER":"', {n}, '"}}}}') ELSE '' END"""
    return f"""
SELECT s_suppkey, concat('inst_', {_text('s_suppkey')}) AS instance_name, {run} AS run_ts,
  concat('{{"base":{{"hasLicense":true,"valid":', CASE WHEN s_suppkey % 7 = 0 THEN 'false' ELSE 'true' END,
    ',"expired":false,"community":false,"fallbackProfile":"READER","expiresOn":"1735689600000",',
    {content}, {limits}, {sub}, '}}}}') AS payload
FROM supplier"""


def standards_sql(engine: str) -> str:
    """Project check reports as JSON text, two checks each."""
    return f"""
SELECT o_orderkey, concat('inst_', {_text('o_orderkey % 3')}) AS instance_name,
  concat('P', {_text('o_custkey % 10')}) AS project_key,
  concat('{{"scope":"project","startTime":"2024-01-05T00:00:00Z","totalDurationMs":', {_text('o_orderkey % 900')},
    ',"bundleChecksRunInfo":{{"c_doc":{{"check":{{"id":"doc","name":"Documentation","description":" Has docs ","tags":["doc","core"]}},',
    '"result":{{"status":"', CASE WHEN o_orderkey % 4 = 0 THEN 'ERROR' ELSE 'SUCCESS' END, '","severity":', {_text('o_orderkey % 5')},
    ',"message":" m ","score":"', {_text('o_orderkey % 11')}, '"}},"expandedCheckParams":{{"limit":"3"}},"durationMs":5}},',
    '"c_own":{{"check":{{"label":"Owner"}},"result":{{"status":"NOT_APPLICABLE"}}}}}}}}') AS payload
FROM orders"""


ADAPTERS = {
    "audit": (audit_sql, ["events"]),
    "audit_flat": (audit_flat_sql, ["events"]),
    "users": (users_sql, ["events"]),
    "max_licenses": (max_licenses_sql, ["customer"]),
    "inventory": (inventory_sql, ["part"]),
    "object_silver": (object_silver_sql, ["audit"]),
    "license_payload": (license_payload_sql, ["supplier"]),
    "standards": (standards_sql, ["orders"]),
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Driver timestamps carry no zone; they are UTC.
    return df.select([F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table dealt by its key over tasks of ``TASK_ROWS`` rows.

    The driver files have few row groups. Its rows are narrow, and hashing them needs no sort as a
    round-robin does; tasks stay small, so what is sorted in one of them fits its memory at any size.
    """
    df = driver_table(spark, sf_dir, name)
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, df.columns[0])


def adapted(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Adapter output as a DataFrame (lazy; nothing is cached or collected)."""
    build, sources = ADAPTERS[name]
    table = spread_table if spread else driver_table
    frames = {s: adapted(spark, sf_dir, s, spread) if s in ADAPTERS else table(spark, sf_dir, s) for s in sources}
    text = build("spark").replace("{", "{{").replace("}", "}}")
    for source in sources:
        for lead in ("FROM", "JOIN"):
            for end in (" ", ")", "\n", ""):
                token = f"{lead} {source}{end}"
                if end or text.endswith(token):
                    text = text.replace(token, f"{lead} {{{source}}} AS {source}{end}" if end != "" else f"{lead} {{{source}}} AS {source}")
    return spark.sql(text, **frames)


@cache
def duckdb_sql(name: str) -> str:
    return ADAPTERS[name][0]("duckdb").strip()
