"""Activity facts, development activity and process usage."""

from __future__ import annotations

from checks.adapters import AS_OF
from checks.oracle import CTES, RECENT, blank_null, canon, in_list, sql
from checks.sources import Sources
from fleetlens.operators import activity
from fleetlens.plans import development as dev
from fleetlens.plans import dims

CAPABILITY, LOGIN = "Data Engineering", "user7"

# --- facts ---------------------------------------------------------------------

_ACTION, _REMOVE = "|".join(dims.ACTION_WORDS), "|".join(dims.REMOVE_WORDS)
CTES["ui_rows"] = """
SELECT instance_name, date_trunc('hour', timestamp) AS hour, message_authUser AS login,
  CASE WHEN length(message_projectKey) > 0 THEN message_projectKey END AS project_key,
  message_msgType AS msgtype, message_msgTypeBase AS base
FROM audit_flat
WHERE topic = 'generic' AND message_scenarioId IS NULL AND message_jobId IS NULL
  AND message_authSource = 'USER_FROM_UI' AND length(message_authUser) > 0"""
CTES["hourly"] = f"""
SELECT instance_name, hour AS timestamp, login, project_key, count(*) AS viewing_actions_count,
  count(*) FILTER (WHERE lower(coalesce(base, '')) IN {in_list(dims.MUTATING_BASES)}
    OR (regexp_matches(lower(msgtype), '{_ACTION}') AND NOT regexp_matches(lower(msgtype), '{_REMOVE}'))) AS developing_actions_count
FROM ui_rows GROUP BY ALL"""
CTES["mau_hourly"] = """
SELECT instance_name, hour AS timestamp, login, count(*) AS application_open_count
FROM ui_rows WHERE lower(trim(msgtype)) = 'application-open' GROUP BY ALL"""


def _daily(source: str, keys: str, measures: str, where: str = "TRUE") -> str:
    return f"""
SELECT CAST(timestamp AS DATE) AS day, instance_name, lower(trim(login)) AS login_norm, {keys}
  min(trim(login)) AS login, {measures}
FROM {source} WHERE trim(login) <> '' AND {where} GROUP BY ALL"""


_SUMS = """CAST(sum(viewing_actions_count) AS BIGINT) AS viewing_actions_count,
  CAST(sum(developing_actions_count) AS BIGINT) AS developing_actions_count, max(timestamp) AS last_activity_at"""
CTES["daily"] = _daily("hourly", "", _SUMS)
CTES["project_daily"] = _daily("hourly", "project_key,", _SUMS, "trim(project_key) <> ''")
CTES["mau_daily"] = _daily(
    "mau_hourly", "", "CAST(sum(application_open_count) AS BIGINT) AS application_open_count, max(timestamp) AS last_application_open_at"
)

CTES["dev_marked"] = f"""
SELECT *, lower(coalesce(authvia, '')) AS via, upper(coalesce(authsource, '')) AS src,
  trim(coalesce(scenarioid, '')) <> '' AS xs, trim(coalesce(jobid, '')) <> '' AS xj
FROM audit"""
CTES["dev_events"] = f"""
SELECT timestamp, instance_name, authuser AS login, msgtype, msgtypebase, activity_category, project_key, callpath,
  CASE WHEN xs OR vs THEN 'scenario_automation' WHEN xj OR vj THEN 'job_automation'
       WHEN src = 'PERSONAL_API_KEY' AND NOT opaque THEN 'api_activity'
       WHEN src = 'USER_FROM_UI' AND NOT opaque THEN 'direct_ui_user' ELSE 'unknown_or_other' END AS activity_origin,
  {blank_null('authsource')} AS authsource, xs OR vs AS has_scenario_marker, xj OR vj AS has_job_marker,
  CASE WHEN xs THEN 'explicit_scenario_marker' WHEN vs THEN 'authvia_scenario' WHEN xj THEN 'explicit_job_marker'
       WHEN vj THEN 'authvia_ticket_job' WHEN src = 'PERSONAL_API_KEY' AND NOT opaque THEN 'personal_api_key'
       WHEN src = 'USER_FROM_UI' AND NOT opaque THEN 'ui_no_automation_marker' ELSE 'unclassified' END AS activity_origin_evidence,
  run_ts AS run_timestamp
FROM (SELECT *, via LIKE '%scenario-run:%' OR via LIKE '%scenario=%' AS vs, via LIKE '%ticket:job:%' AS vj,
  (via LIKE '%ticket:%' AND via NOT LIKE '%ticket:job:%' AND via NOT LIKE '%ticket:jupyter:%' AND via NOT LIKE '%ticket:code studio%')
    OR via LIKE '%macro%' AS opaque FROM dev_marked) m"""


def _enriched(key) -> str:
    return f"""
SELECT e.timestamp, e.instance_name, e.login, e.project_key, e.msgtype, e.msgtypebase AS base_tag, e.activity_origin, e.authsource,
  e.has_scenario_marker, e.has_job_marker, e.activity_origin_evidence,
  coalesce(m.category_label, e.activity_category) AS activity_category,
  coalesce(m.capability_label, 'Uncategorized') AS capability,
  coalesce(c.activity_class, 'unclassified') AS activity_class,
  coalesce(c.is_meaningful_activity, FALSE) AS is_meaningful_activity,
  trim(coalesce(e.login, '')) <> '' AS is_user_attributed
FROM dev_events e LEFT JOIN d_capability m ON {key('m.activity_category')} = {key('e.activity_category')}
LEFT JOIN d_event_class c ON {key('c.msgtype')} = {key('e.msgtype')}"""


CTES["enriched"] = _enriched(canon)

# --- registered queries --------------------------------------------------------------


def _rank(label: str, where: str, n: int = 50) -> str:
    return f"""SELECT {label} AS label, count(*) AS value FROM enriched WHERE {RECENT} AND {where}
GROUP BY ALL ORDER BY value DESC, label ASC NULLS LAST LIMIT {n}"""


def _count(label: str, where: str = "TRUE") -> str:
    return f"SELECT {label} AS label, count(*) AS value FROM enriched WHERE {RECENT} AND {where} GROUP BY ALL"


_DAY = "CAST(CAST(timestamp AS DATE) AS VARCHAR)"
_CAP, _USR = f"capability = '{CAPABILITY}'", f"login = '{LOGIN}'"
_HAS = "trim(coalesce(login, '')) <> ''"


def _thirty(keys: str, cond: str, users: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (WHERE {RECENT} AND {cond}) AS event_count_30d,
  count(DISTINCT login) FILTER (WHERE {RECENT} AND {cond} AND {users}) AS active_users_30d FROM enriched GROUP BY ALL"""


CASES = {
    "user_activity_hourly": (lambda s: s.compute("hourly"), "SELECT * FROM hourly"),
    "formal_mau_hourly": (lambda s: s.compute("mau_hourly"), "SELECT * FROM mau_hourly"),
    "user_activity_daily": (lambda s: s.compute("daily"), "SELECT * FROM daily"),
    "user_activity_daily_since": (
        lambda s: activity.user_activity_daily(s.hourly, since="2024-01-20"),
        "SELECT * FROM daily WHERE day >= DATE '2024-01-20'",
    ),
    "user_activity_project_daily": (lambda s: s.compute("project_daily"), "SELECT * FROM project_daily"),
    "formal_mau_daily": (lambda s: s.compute("mau_daily"), "SELECT * FROM mau_daily"),
    "dev_activity_events": (lambda s: s.compute("dev_events"), "SELECT * FROM dev_events"),
    "dim_capability": (
        lambda s: dims.dim_capability(s.spark)
        .join(s.audit.groupBy(dev.canonical("activity_category").alias("activity_category")).agg(dev.F.count("*").alias("events")), "activity_category"),
        f"""SELECT d.*, a.events FROM d_capability d JOIN (SELECT {canon('activity_category')} AS activity_category, count(*) AS events
FROM audit GROUP BY ALL) a USING (activity_category)""",
    ),
    "dim_event_class": (
        lambda s: dims.dim_event_class(s.spark).withColumn("key", dev.canonical("msgtype"))
        .join(s.audit.groupBy(dev.canonical("msgtype").alias("key")).agg(dev.F.count("*").alias("events")), "key"),
        f"""SELECT {canon('d.msgtype')} AS key, d.*, a.events FROM d_event_class d JOIN (SELECT {canon('msgtype')} AS k, count(*) AS events
FROM audit GROUP BY ALL) a ON a.k = {canon('d.msgtype')}""",
    ),
    "dev_activity_enriched": (lambda s: s.compute("enriched"), "SELECT * FROM enriched"),
    "capability_30d": (
        lambda s: dev.capability_30d(s.enriched, AS_OF),
        _thirty("capability", "is_meaningful_activity", _HAS),
    ),
    "capability_daily": (
        lambda s: dev.capability_daily(s.enriched),
        """SELECT CAST(timestamp AS DATE) AS day, capability, count(*) AS event_count,
  count(DISTINCT login) AS active_users FROM enriched GROUP BY ALL""",
    ),
    "category_30d": (
        lambda s: dev.category_30d(s.enriched, AS_OF),
        _thirty("capability, activity_category", "is_meaningful_activity", _HAS),
    ),
    "tag_30d": (
        lambda s: dev.tag_30d(s.enriched, AS_OF),
        _thirty("capability, activity_category, base_tag", "TRUE", "TRUE"),
    ),
    "top_users_30d": (
        lambda s: dev.top_users_30d(s.enriched, AS_OF),
        f"""SELECT login, count(*) AS event_count_30d, count(DISTINCT CAST(timestamp AS DATE)) AS active_days_30d,
  count(DISTINCT capability) AS capabilities_touched_30d FROM enriched
WHERE {RECENT} AND is_meaningful_activity AND {_HAS} GROUP BY ALL""",
    ),
    "unmapped_categories_30d": (
        lambda s: dev.unmapped_categories_30d(s.dev_events, dims.dim_capability(s.spark), AS_OF),
        f"""SELECT activity_category, count(*) FILTER (WHERE {RECENT}) AS event_count_30d,
  count(DISTINCT login) FILTER (WHERE {RECENT}) AS active_users_30d FROM dev_events e
WHERE NOT EXISTS (SELECT 1 FROM d_capability m WHERE m.activity_category = e.activity_category) GROUP BY ALL""",
    ),
    "unclassified_events_30d": (
        lambda s: dev.unclassified_events_30d(s.enriched, AS_OF),
        f"""SELECT msgtype, base_tag, activity_category, count(*) AS event_count_30d, count(DISTINCT login) AS distinct_users_30d,
  count(*) FILTER (WHERE NOT ({_HAS})) AS unattributed_events_30d
FROM enriched WHERE {RECENT} AND activity_class = 'unclassified' GROUP BY ALL""",
    ),
    "dev_daily": (lambda s: dev.dev_daily(s.enriched, AS_OF), _count(_DAY)),
    "dev_by_capability": (lambda s: dev.dev_by_capability(s.enriched, AS_OF), _count("capability")),
    "dev_by_category": (
        lambda s: dev.dev_by_category(s.enriched, AS_OF),
        _count("concat_ws(' / ', capability, activity_category)"),
    ),
    "dev_top_users": (lambda s: dev.dev_top_users(s.enriched, AS_OF), _rank("login", "TRUE")),
    "capability_summary": (
        lambda s: dev.capability_summary(s.enriched, CAPABILITY, AS_OF),
        f"""SELECT count(*) AS events, count(DISTINCT login) AS users, count(DISTINCT project_key) AS projects,
  count(DISTINCT instance_name) AS instances FROM enriched WHERE {RECENT} AND {_CAP}""",
    ),
    "capability_events_daily": (
        lambda s: dev.capability_events_daily(s.enriched, CAPABILITY, AS_OF),
        _count(_DAY, _CAP),
    ),
    "capability_categories": (
        lambda s: dev.capability_categories(s.enriched, CAPABILITY, AS_OF),
        _count("activity_category", _CAP),
    ),
    "capability_tags": (lambda s: dev.capability_tags(s.enriched, CAPABILITY, AS_OF), _count("base_tag", _CAP)),
    "capability_top_users": (lambda s: dev.capability_top_users(s.enriched, CAPABILITY, AS_OF), _rank("login", _CAP)),
    "capability_top_projects": (
        lambda s: dev.capability_top_projects(s.enriched, CAPABILITY, AS_OF),
        _rank("concat_ws(' :: ', instance_name, project_key)", _CAP),
    ),
    "user_dev_summary": (
        lambda s: dev.user_dev_summary(s.enriched, LOGIN, AS_OF),
        f"""SELECT count(*) AS events, count(DISTINCT project_key) AS projects, count(DISTINCT instance_name) AS instances
FROM enriched WHERE {RECENT} AND {_USR}""",
    ),
    "user_dev_daily": (lambda s: dev.user_dev_daily(s.enriched, LOGIN, AS_OF), _count(_DAY, _USR)),
    "user_dev_capabilities": (lambda s: dev.user_dev_capabilities(s.enriched, LOGIN, AS_OF), _count("capability", _USR)),
    "user_dev_categories": (lambda s: dev.user_dev_categories(s.enriched, LOGIN, AS_OF), _count("activity_category", _USR)),
    "user_dev_tags": (lambda s: dev.user_dev_tags(s.enriched, LOGIN, AS_OF), _count("base_tag", _USR)),
    "usage_summary": (
        lambda s: dev.usage_summary(s.enriched, AS_OF),
        f"""SELECT count(*) AS events, count(DISTINCT capability) AS active_capabilities, count(DISTINCT login) AS active_users,
  count(DISTINCT project_key) AS active_projects, count(DISTINCT instance_name) AS active_instances FROM enriched WHERE {RECENT}""",
    ),
    "usage_by_capability": (
        lambda s: dev.usage_by_capability(s.enriched, AS_OF),
        f"""SELECT capability AS label, count(*) AS value, count(DISTINCT login) AS active_users,
  count(DISTINCT project_key) AS projects, count(DISTINCT instance_name) AS instances FROM enriched WHERE {RECENT} GROUP BY ALL""",
    ),
    "usage_daily": (lambda s: dev.usage_daily(s.enriched, AS_OF), _count(_DAY)),
    "usage_users": (
        lambda s: dev.usage_users(s.enriched, AS_OF),
        f"SELECT capability AS label, count(DISTINCT login) AS value FROM enriched WHERE {RECENT} GROUP BY ALL",
    ),
    "usage_projects": (
        lambda s: dev.usage_projects(s.enriched, AS_OF),
        f"SELECT capability AS label, count(DISTINCT project_key) AS value FROM enriched WHERE {RECENT} GROUP BY ALL",
    ),
    "usage_instances": (
        lambda s: dev.usage_instances(s.enriched, AS_OF),
        f"SELECT capability AS label, count(DISTINCT instance_name) AS value FROM enriched WHERE {RECENT} GROUP BY ALL",
    ),
    "dev_source_fallback": (
        lambda s: dev.dev_source_fallback(s.spark, s.dev_events, s.enriched.filter("capability = 'no such capability'")),
        _enriched(lambda c: f"lower(trim({c}))"),
    ),
}

QUERIES = {name: (lambda spark, d, fn=fn: fn(Sources(spark, d))) for name, (fn, _) in CASES.items()}
ORACLE = {name: sql(text) for name, (_, text) in CASES.items() if text}
