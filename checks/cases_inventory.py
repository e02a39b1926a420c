"""Object activity, inventories, catalogues and product consumption."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from checks.adapters import AS_OF
from checks.oracle import CTES, RECENT, blank_null, canon, in_list, sql
from checks.sources import INVENTORY_COLUMNS, Sources
from fleetlens.functions.casts import epoch_or_iso_ts
from fleetlens.functions.text import path_segment
from fleetlens.operators import objects
from fleetlens.operators.latest import latest_by_partition
from fleetlens.plans import consumption as con
from fleetlens.plans import dims
from fleetlens.plans import inventory as inv


def _md5(*parts: str) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()


# Identities that exist at every scale factor.
PRODUCT = _md5("inst_1", "P8", "dashboard", "obj28")
ASSET = _md5("inst_0", "P6", "dataset", "obj36")

# --- object events -------------------------------------------------------------------

_J = "json_extract_string(extras, '$.{}')"
CTES["obj_all"] = f"""
SELECT * FROM (
SELECT timestamp, instance_name, coalesce({blank_null('authuser')}, {blank_null('"user"')}) AS login, msgtype AS event_name,
  o.activity_category AS event_category, m.capability AS canonical_capability, project_key, object_type,
  CASE WHEN object_type IN ('dataset', 'recipe') OR object_key NOT LIKE '{{%}}' THEN object_key END AS object_key,
  coalesce(clientip, originalip) AS ip_address, extras AS details_json, run_ts AS run_timestamp
FROM (SELECT *, CASE module WHEN 'datasets' THEN 'dataset' WHEN 'visual_recipes' THEN 'recipe' WHEN 'apis' THEN 'api_service'
    WHEN 'webapps' THEN 'web_application' WHEN 'charts_dashboard' THEN CASE WHEN dashboardid IS NOT NULL THEN 'dashboard' ELSE 'insight' END
    ELSE 'application' END AS object_type,
  CASE module WHEN 'datasets' THEN {blank_null('datasetname')} WHEN 'visual_recipes' THEN {blank_null('recipename')}
    WHEN 'apis' THEN {blank_null('serviceid')}
    WHEN 'webapps' THEN coalesce({blank_null('webappid')}, {blank_null('webappid_source_call')}, {_J.format('webappid')})
    WHEN 'charts_dashboard' THEN coalesce(dashboardid, insightid, {_J.format('insightId')})
    ELSE coalesce({blank_null('applicationid')}, {_J.format('appId')}) END AS object_key FROM object_silver) o
LEFT JOIN d_capability m ON {canon('m.activity_category')} = {canon('o.activity_category')}
WHERE NOT (module = 'application_designer' AND msgtype = 'application-open')) x
WHERE login IS NOT NULL AND object_key IS NOT NULL"""
CTES["obj_events"] = f"""
SELECT *, object_key AS object_name FROM obj_all QUALIFY row_number() OVER (PARTITION BY timestamp, instance_name, lower(trim(login)), event_name,
  {canon('event_category')}, project_key, object_type, object_key, ip_address, details_json
  ORDER BY run_timestamp DESC, event_category, login) = 1"""

# --- indexes ----------------------------------------------------------------------------


def _time(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '[0-9]{{13}}') THEN make_timestamp(try_cast({c} AS BIGINT) * 1000)
  WHEN regexp_full_match({c}, '[0-9]{{10}}') THEN make_timestamp(try_cast({c} AS BIGINT) * 1000000) ELSE try_cast({c} AS TIMESTAMP) END"""


_NEW = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY run_ts DESC, partition_date DESC) = 1"
CTES["inv_typed"] = f"SELECT *, {_time('created_text')} AS created_at, {_time('updated_text')} AS updated_at FROM inventory"
CTES["inv_latest"] = "SELECT * FROM inv_typed " + _NEW.format("instance_name, project_key, object_key")
CTES["inv_apps"] = "SELECT * FROM inv_typed " + _NEW.format("instance_name, object_key")
CTES["inv_projects"] = "SELECT * FROM inv_typed " + _NEW.format("instance_name, project_key")


def _metadata_sql(name: str) -> str:
    """The projection of one inventory, by the fixture column behind each source column."""
    spec, sources = inv.METADATA[name], INVENTORY_COLUMNS[name]
    column = lambda names: f"coalesce({', '.join([*(sources[n] for n in names if n in sources), 'CAST(NULL AS VARCHAR)'])})"
    typed_ = {"created_text": "created_at", "updated_text": "updated_at"}
    parts = ["instance_name", "project_key"]
    for out, names in spec.columns.items():
        value = column(names)
        parts.append(f"{blank_null(value)} AS {out}" if out == "owner_login" and len(names) > 1 else f"{value} AS {out}")
    parts += [f"{typed_[sources[src]] if src in sources else 'CAST(NULL AS TIMESTAMP)'} AS {out}" for out, src in spec.times.items()]
    table = {"projects": "inv_projects", "apps": "inv_apps"}.get(name, "inv_latest")
    where = "" if spec.project == "project_key" else " WHERE project_key IS NOT NULL"
    return f"SELECT {', '.join(parts)}, extras AS details_json FROM {table}{where}"


def _idx(kind: str, prefix: str, table: str = "inv_latest", **over: str) -> str:
    cols = {"key": "object_key", "name": "object_name", "subtype": "object_subtype", "owner": "owner_login", "mod": "owner_login",
            "created": "created_at", "updated": "updated_at"} | over
    return f"""SELECT instance_name, project_key, '{kind}' AS {prefix}_type, {cols['key']} AS {prefix}_key, {cols['name']} AS {prefix}_name,
  {cols['subtype']} AS {prefix}_subtype, {cols['owner']} AS owner_login, {cols['mod']} AS last_modified_by_login,
  {cols['created']} AS created_at, {cols['updated']} AS updated_at FROM {table}"""


_NONE, _NOTIME = "CAST(NULL AS VARCHAR)", "CAST(NULL AS TIMESTAMP)"
CTES["a_index"] = " UNION ALL ".join([
    _idx("project", "object", "inv_projects", key="project_key", name="project_key", subtype=_NONE),
    _idx("dataset", "object", name="coalesce(object_name, object_key)"),
    _idx("recipe", "object", name="object_key"),
    _idx("scenario", "object"),
    _idx("sql_notebook", "object", subtype="coalesce(object_subtype, owner_login, object_key)", owner=_NONE, mod=_NONE),
])
CTES["p_index"] = " UNION ALL ".join(
    [_idx(t, "product") for t in ("agent_tool", "api_service", "insight", "web_application")]
    + [
        _idx("dashboard", "product", subtype=_NONE),
        _idx("saved_model", "product", subtype="coalesce(object_subtype, object_key)", owner=_NONE, mod=_NONE),
        _idx("application", "product", "inv_apps", owner=_NONE, mod=_NONE, created=_NOTIME, updated=_NOTIME),
    ]
)


def _activity(kind: str, where: str) -> str:
    return f"""SELECT instance_name, project_key, object_type AS {kind}_type, object_key AS {kind}_key, count(*) FILTER (WHERE {RECENT}) AS activity_30d,
  count(DISTINCT login) FILTER (WHERE {RECENT}) AS active_users_30d, max(timestamp) AS last_activity_at FROM obj_events WHERE {where} GROUP BY ALL"""


CTES["a_activity"] = _activity("object", "object_key IS NOT NULL")
CTES["p_activity"] = _activity("product", f"object_type IN {in_list(dims.PRODUCT_TYPES)}")


def _catalog(kind: str, id_name: str, index: str, activity: str) -> str:
    keys = ["instance_name", "project_key", f"{kind}_type", f"{kind}_key"]
    on = " AND ".join(f"i.{k} = a.{k}" for k in keys)
    return f"""SELECT i.*, coalesce(a.activity_30d, 0) AS activity_30d, coalesce(a.active_users_30d, 0) AS active_users_30d, a.last_activity_at,
  md5(concat_ws('|', {', '.join('i.' + k for k in keys)})) AS {id_name} FROM {index} i LEFT JOIN {activity} a ON {on}"""


CTES["a_catalog"] = _catalog("object", "asset_id", "a_index", "a_activity")
CTES["p_catalog"] = f"""
SELECT c.*, p.project_key AS project_name FROM ({_catalog('product', 'product_id', 'p_index', 'p_activity')}) c
LEFT JOIN inv_projects p ON p.instance_name = c.instance_name AND p.project_key = c.project_key"""

_HAS = "(CASE WHEN trim(coalesce({}, '')) <> '' THEN 1 ELSE 0 END)"
_NN = "(CASE WHEN {} IS NOT NULL THEN 1 ELSE 0 END)"
_FIVE = " + ".join([_HAS.format(c) for c in ("object_name", "object_key", "owner_login")] + [_NN.format(c) for c in ("created_at", "updated_at")])
_FOUR = " + ".join([_HAS.format(c) for c in ("object_name", "object_key", "owner_login")] + [_NN.format("updated_at")])
_TYPED = f"WHEN object_type IN ('dataset', 'recipe', 'scenario') THEN ({_FIVE} + {_HAS.format('object_subtype')}) * 100.0::DOUBLE / 6"
_LIST_SCORE = f"CASE {_TYPED} WHEN object_type = 'project' THEN ({_FIVE}) * 100.0::DOUBLE / 5 ELSE ({_FOUR}) * 100.0::DOUBLE / 4 END"
_SUM_SCORE = f"CASE {_TYPED} ELSE ({_FIVE}) * 100.0::DOUBLE / 5 END"
_PSIX = " + ".join([_HAS.format(c) for c in ("product_name", "product_key", "product_type", "owner_login")] + [_NN.format(c) for c in ("created_at", "updated_at")])
_PSCORE = f"({_PSIX}) * 100.0::DOUBLE / 6"
_STATUS = "CASE WHEN {s} >= 99.9 THEN 'complete' WHEN {s} >= 50 THEN 'partial' ELSE 'sparse' END"


def _listing(score: str, catalog: str, prefix: str, id_name: str, where: str, order: str, limit: int, offset: int) -> str:
    return f"""SELECT {id_name}, instance_name, project_key, {prefix}_type, {prefix}_key, {prefix}_name, {prefix}_subtype, owner_login, updated_at,
  activity_30d, round(sc, 1) AS metadata_score, {_STATUS.format(s='sc')} AS metadata_status
FROM (SELECT *, {score} AS sc FROM {catalog}) c WHERE {where} ORDER BY {order}, {id_name} LIMIT {limit} OFFSET {offset}"""


def _summary(score: str, kind: str, table: str) -> str:
    agg = f"""count(*) AS total_assets, count(*) FILTER (WHERE {_STATUS.format(s='sc')} = 'complete') AS complete_count,
  count(*) FILTER (WHERE {_STATUS.format(s='sc')} = 'partial') AS partial_count,
  count(*) FILTER (WHERE {_STATUS.format(s='sc')} = 'sparse') AS sparse_count, round(sum(sc) / count(*), 1) AS avg_score"""
    base = f"FROM (SELECT {kind} AS label, round({score}, 1) AS sc FROM {table}) s"
    return f"SELECT label, {agg} {base} GROUP BY ALL UNION ALL SELECT NULL, {agg} {base}"


def _facet_rows(table: str, kind: str) -> str:
    parts = {"instances": "instance_name", "projects": "project_key", "types": kind, "owners": "owner_login"}
    return " UNION ".join(f"SELECT '{f}' AS facet, {c} AS value FROM {table} WHERE {c} IS NOT NULL" for f, c in parts.items())


def _describe(extras: str) -> str:
    return f"trim(coalesce(json_extract_string({extras}, '$.description'), json_extract_string({extras}, '$.meta_description')))"


_TYPE = "dashboard"
_TYPE_EVENTS = f"FROM obj_events WHERE {RECENT} AND object_type = '{_TYPE}'"


def _top(chart: str, label: str, source: str, n: int = 12) -> str:
    return f"(SELECT '{chart}' AS chart, {label} AS label, count(*) AS value {source} GROUP BY ALL ORDER BY value DESC, label NULLS LAST LIMIT {n})"


_TYPE_METRICS = " UNION ALL ".join([
    _top("owners", "owner_login", f"FROM p_catalog WHERE product_type = '{_TYPE}'"),
    f"(SELECT 'products' AS chart, product_name AS label, activity_30d AS value FROM p_catalog WHERE product_type = '{_TYPE}' ORDER BY value DESC, label NULLS LAST, product_id LIMIT 12)",
    f"(SELECT 'daily' AS chart, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS label, count(*) AS value {_TYPE_EVENTS} GROUP BY ALL)",
    _top("projects", "project_key", _TYPE_EVENTS),
    _top("instances", "instance_name", _TYPE_EVENTS),
])

# --- consumption ---------------------------------------------------------------------------

_NP = "lower(nullif(trim({}), ''))"
CTES["c_keys"] = f"""
SELECT lower(trim(instance_name)) AS i, lower(trim(product_type)) AS t, lower(trim(product_key)) AS k, {_NP.format('project_key')} AS p,
  product_id, product_name, owner_login FROM p_catalog WHERE product_type IN {in_list(dims.CONSUMPTION_TYPES)}"""
CTES["c_unique"] = """
SELECT i, t, k, min(product_id) AS product_id, min(product_name) AS product_name, min(owner_login) AS owner_login FROM c_keys
GROUP BY i, t, k HAVING count(DISTINCT product_id) = 1"""


def _matched(days: str) -> str:
    return f"""
SELECT e.*, coalesce(x.product_id, f.product_id) AS product_id,
  CASE WHEN x.product_id IS NOT NULL THEN 'exact' WHEN f.product_id IS NOT NULL THEN 'fallback' ELSE 'unmatched' END AS match_type,
  CASE WHEN x.product_id IS NOT NULL THEN x.product_name ELSE f.product_name END AS product_name,
  CASE WHEN x.product_id IS NOT NULL THEN x.owner_login ELSE f.owner_login END AS owner_login
FROM (SELECT * FROM obj_events WHERE {days} AND object_type IN {in_list(dims.CONSUMPTION_TYPES)}) e
LEFT JOIN c_keys x ON x.i = lower(trim(e.instance_name)) AND x.t = e.object_type AND x.k = lower(e.object_key)
  AND x.p IS NOT DISTINCT FROM {_NP.format('e.project_key')}
LEFT JOIN c_unique f ON f.i = lower(trim(e.instance_name)) AND f.t = e.object_type AND f.k = lower(e.object_key)"""


CTES["c_tagged"] = _matched(RECENT)
CTES["c_matched"] = "SELECT * FROM c_tagged WHERE product_id IS NOT NULL"
CTES["c_products"] = "SELECT product_id, count(*) AS n, count(DISTINCT login) AS u FROM c_matched GROUP BY ALL"
CTES["c_users"] = """
SELECT login, count(*) AS n, count(DISTINCT concat_ws('|', instance_name, coalesce(project_key, ''), object_type, object_key)) AS p
FROM c_matched GROUP BY ALL"""
CTES["c_totals"] = "SELECT count(*) AS events, count(DISTINCT login) AS active_users, count(DISTINCT product_id) AS active_products FROM c_matched"
CTES["c_rollup"] = """
SELECT avg(u) AS avg_users_per_product, count(*) FILTER (WHERE u >= 2) AS collaborative_products, count(*) FILTER (WHERE u = 1) AS single_user_products,
  count(*) FILTER (WHERE u >= 2 AND n < 5) AS multi_user_light_products, count(*) FILTER (WHERE n >= 5) AS repeat_products,
  count(*) FILTER (WHERE u >= 2 AND n >= 5) AS adopted_products, max(n) AS top_product_events, max(n) AS top1_product_events,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT n FROM c_products ORDER BY n DESC, product_id LIMIT 5) t) AS top5_product_events
FROM c_products"""
_SCORE = """0.25 * (least(u / 5 * 100.0, 100.0) + least(n / 5 * 100.0, 100.0) + least(u / 2 * 100.0, 100.0) + greatest(0.0, 100.0 - n / greatest(n, 10) * 100.0))"""
_TYPE_ROLL = "max_users_on_product, active_products, adoption_count, active_users, events"
_NAME = "CASE WHEN length(trim({c})) >= 5 AND lower(trim({c})) NOT IN ('view', 'demo', 'test', 'dash', 'prez') THEN trim({c}) END"

CTES["l_events"] = f"""
SELECT *, CAST(timestamp AS DATE) AS day FROM obj_events
WHERE timestamp >= TIMESTAMP '2023-01-31' AND object_type IN {in_list(dims.CONSUMPTION_TYPES)}"""
_SAME = "e2.instance_name = d.instance_name AND e2.project_key IS NOT DISTINCT FROM d.project_key AND e2.object_type = d.object_type AND e2.object_key = d.object_key"
CTES["l_days"] = f"""
SELECT d.*, (SELECT count(DISTINCT e2.login) FROM l_events e2 WHERE {_SAME} AND e2.day <= d.day) AS users_so_far,
  (SELECT count(*) FROM l_events e2 WHERE {_SAME} AND e2.day <= d.day) AS events_so_far
FROM (SELECT instance_name, project_key, object_type, object_key, day, min(timestamp) AS first_at FROM l_events GROUP BY ALL) d"""
CTES["l_spans"] = f"""
SELECT *, date_diff('day', CAST(created_at AS DATE), CAST(first_consumption_at AS DATE)) AS d1,
  date_diff('day', CAST(created_at AS DATE), multi_user_at) AS d2, date_diff('day', CAST(created_at AS DATE), repeat_use_at) AS d3
FROM (SELECT p.product_id, p.created_at, min(d.first_at) AS first_consumption_at, min(CASE WHEN users_so_far >= 2 THEN day END) AS multi_user_at,
  min(CASE WHEN events_so_far >= 5 THEN day END) AS repeat_use_at
FROM l_days d JOIN p_catalog p ON p.instance_name = d.instance_name AND p.project_key IS NOT DISTINCT FROM d.project_key
  AND p.product_type = d.object_type AND p.product_key = d.object_key GROUP BY ALL) f"""

CTES["one_product"] = f"""
SELECT e.* FROM obj_events e JOIN (SELECT * FROM p_catalog WHERE product_id = '{PRODUCT}') p ON p.instance_name = e.instance_name
  AND p.project_key IS NOT DISTINCT FROM e.project_key AND p.product_type = e.object_type AND p.product_key = e.object_key
WHERE {RECENT.replace('timestamp >=', 'e.timestamp >=')}"""


def catalog_details(s: Sources, kind: str):
    rows = latest_by_partition(s.inventory, ["project_key", "object_key"])
    return rows.select("instance_name", "project_key", F.lit(kind).alias("object_type"), "object_key", "extras")


def registry_counts(s: Sources):
    counts = s.product_index.groupBy("product_type").agg(F.count("*").alias("products"))
    return inv.products_registry(s.spark).select("product_type", "source_table").join(counts, "product_type")


CASES = {
    "object_activity_events": (lambda s: s.compute("object_events"), "SELECT * FROM obj_events"),
    "object_identity": (
        lambda s: objects.with_object_identity(s.object_silver).select("event_id", "run_ts", "module", "object_type", "object_key"),
        f"""SELECT event_id, run_ts, module, object_type, CASE WHEN object_type IN ('dataset', 'recipe') OR k NOT LIKE '{{%}}' THEN k END AS object_key FROM (
SELECT *, CASE module WHEN 'datasets' THEN 'dataset' WHEN 'visual_recipes' THEN 'recipe' WHEN 'apis' THEN 'api_service' WHEN 'webapps' THEN 'web_application'
  WHEN 'charts_dashboard' THEN CASE WHEN dashboardid IS NOT NULL THEN 'dashboard' ELSE 'insight' END ELSE 'application' END AS object_type,
  CASE module WHEN 'datasets' THEN datasetname WHEN 'visual_recipes' THEN recipename WHEN 'apis' THEN serviceid
  WHEN 'webapps' THEN coalesce({blank_null('webappid')}, {blank_null('webappid_source_call')}, {_J.format('webappid')})
  WHEN 'charts_dashboard' THEN coalesce(dashboardid, insightid, {_J.format('insightId')}) ELSE coalesce({blank_null('applicationid')}, {_J.format('appId')}) END AS k
FROM object_silver) o""",
    ),
    "path_segment": (
        lambda s: s.table("pages").select("page_id", path_segment("url", "/page/").alias("segment"), path_segment(F.concat("url", F.lit("/objects/a#x?y")), "/objects/").alias("object")),
        """SELECT page_id, nullif(trim(split_part(split_part(split_part(split_part(url, '?', 1), '#', 1), '/page/', 2), '/', 1)), '') AS segment,
  CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN NULL ELSE 'a' END AS object FROM pages""",
    ),
    "latest_by_partition": (
        lambda s: latest_by_partition(s.inventory, ["project_key", "object_key"]),
        "SELECT * EXCLUDE (created_at, updated_at) FROM inv_latest",
    ),
    "asset_activity_30d": (lambda s: inv.asset_activity_30d(s.object_events, AS_OF), "SELECT * FROM a_activity"),
    "product_activity_30d": (lambda s: inv.product_activity_30d(s.object_events, AS_OF), "SELECT * FROM p_activity"),
    "product_activity_30d_static": (
        lambda s: inv.product_activity_30d(s.object_events, AS_OF, dims.STATIC_PRODUCT_TYPES),
        f"SELECT * FROM p_activity WHERE product_type IN {in_list(dims.STATIC_PRODUCT_TYPES)}",
    ),
    "asset_index": (lambda s: s.compute("asset_index"), "SELECT * FROM a_index"),
    "product_index": (lambda s: s.compute("product_index"), "SELECT * FROM p_index"),
    "products_registry": (
        registry_counts,
        """SELECT product_type, CASE product_type WHEN 'web_application' THEN 'webapps' WHEN 'application' THEN 'apps' ELSE product_type || 's' END AS source_table,
  count(*) AS products FROM p_index GROUP BY ALL""",
    ),
    "epoch_or_iso_ts": (
        lambda s: s.inventory.select("obj", "run_ts", epoch_or_iso_ts("created_text").alias("created_at"), epoch_or_iso_ts("updated_text").alias("updated_at")),
        "SELECT obj, run_ts, created_at, updated_at FROM inv_typed",
    ),
    **{f"metadata_{name}": (lambda s, name=name: s.metadata_of(name), _metadata_sql(name)) for name in inv.METADATA},
    "build_catalog": (lambda s: s.compute("asset_catalog"), "SELECT * FROM a_catalog"),
    "products_catalog": (lambda s: s.compute("catalog"), "SELECT * FROM p_catalog"),
    "products_by_type": (lambda s: inv.products_by_type(s.catalog), "SELECT product_type, count(*) AS product_count FROM p_catalog GROUP BY ALL"),
    "object_activity_source": (
        lambda s: inv.object_activity_source(s.spark, None, s.audit),
        """SELECT timestamp, instance_name, authuser AS login, project_key, 'project' AS object_type, project_key AS object_key FROM audit""",
    ),
    "empty_optional_inventory": (
        lambda s: inv.empty_optional_inventory(s.spark, None, "instance_name string, object_key string").unionByName(
            inv.empty_optional_inventory(s.spark, s.inventory.select("instance_name", "object_key"), "instance_name string, object_key string")
        ),
        "SELECT instance_name, object_key FROM inventory",
    ),
    "match_products": (
        lambda s: con.match_products(con.eligible_events(s.object_events, AS_OF), s.catalog, salts=8),
        "SELECT * FROM c_tagged",
    ),
    "consumption_totals": (lambda s: con.consumption_totals(s.matched), "SELECT * FROM c_totals"),
    "consumption_totals_filtered": (
        lambda s: con.consumption_totals(
            con.matched_consumption(s.object_events, s.catalog, AS_OF, days=14, q="OBJ1", types=["dashboard", "web_application"], instances=["inst_1", "inst_2"], owner_is="User31")
        ),
        """SELECT count(*) AS events, count(DISTINCT login) AS active_users, count(DISTINCT product_id) AS active_products FROM c_matched
WHERE timestamp >= TIMESTAMP '2024-01-17' AND object_type IN ('dashboard', 'web_application') AND instance_name IN ('inst_1', 'inst_2')
  AND lower(owner_login) = 'user31' AND (lower(coalesce(product_name, object_key)) LIKE '%obj1%' OR lower(object_key) LIKE '%obj1%')""",
    ),
    "product_rollups": (lambda s: con.product_rollups(s.matched), "SELECT * FROM c_rollup"),
    "user_rollups": (
        lambda s: con.user_rollups(s.matched),
        """SELECT avg(p) AS avg_products_per_user, max(p) AS top_user_products, max(n) AS top1_user_events,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT n FROM c_users ORDER BY n DESC, login LIMIT 5) t) AS top5_user_events FROM c_users""",
    ),
    "maturity": (
        lambda s: con.maturity(con.consumption_totals(s.matched), con.product_rollups(s.matched)),
        """SELECT *, CASE WHEN maturity_score >= 75 THEN 'scaled' WHEN maturity_score >= 45 THEN 'growing' ELSE 'nascent' END AS maturity_tier
FROM (SELECT round(b * 0.3 + r * 0.3 + c * 0.2 + k * 0.2, 1) AS maturity_score, round(b, 1) AS breadth, round(r, 1) AS repeat,
  round(c, 1) AS collaboration, round(k, 1) AS concentration, active_users, adopted_products
FROM (SELECT *, least(active_products / 25.0::DOUBLE * 100, 100) AS b, least(repeat_products / active_products * 100, 100) AS r,
  least(collaborative_products / active_products * 100, 100) AS c,
  greatest(0, (1 - (top5_product_events / events * 0.6::DOUBLE + top1_product_events / events * 0.4::DOUBLE)) * 100) AS k FROM c_totals CROSS JOIN c_rollup) x) y""",
    ),
    "consumption_daily": (
        lambda s: con.consumption_daily(s.matched),
        "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS label, count(*) AS value FROM c_matched GROUP BY ALL",
    ),
    "consumption_by_type": (
        lambda s: con.consumption_by_type(s.spark, s.matched),
        f"""SELECT s.label, {', '.join(f'coalesce(r.{c}, 0) AS {c}' for c in _TYPE_ROLL.split(', '))},
  coalesce(avg_users_per_product, 0) AS avg_users_per_product, coalesce(avg_maturity_score, 0) AS avg_maturity_score, coalesce(max_maturity_score, 0) AS max_maturity_score
FROM (VALUES {', '.join(f"('{t}')" for t in dims.CONSUMPTION_TYPES)}) AS s(label) LEFT JOIN (
SELECT object_type, CAST(sum(n) AS BIGINT) AS events, count(*) AS active_products, avg(u) AS avg_users_per_product, max(u) AS max_users_on_product,
  count(*) FILTER (WHERE u >= 2 AND n >= 5) AS adoption_count, avg({_SCORE}) AS avg_maturity_score, max({_SCORE}) AS max_maturity_score,
  any_value(au) AS active_users
FROM (SELECT object_type, product_id, count(*) AS n, count(DISTINCT login) AS u FROM c_matched GROUP BY ALL) p
JOIN (SELECT object_type AS ot, count(DISTINCT login) AS au FROM c_matched GROUP BY ALL) q ON q.ot = p.object_type GROUP BY object_type) r ON r.object_type = s.label""",
    ),
    "top_products": (
        lambda s: con.top_products(s.matched, s.catalog),
        f"""SELECT product_id, instance_name, project_key, product_type, product_key, events, active_users, last_activity_at,
  coalesce({_NAME.format(c='own_name')}, {_NAME.format(c='lent_name')}, {blank_null('own_name')}, {blank_null('lent_name')}, product_key) AS product_name,
  coalesce({blank_null('own_owner')}, {blank_null('lent_owner')}) AS owner_login
FROM (SELECT *, {', '.join(
            f"(SELECT min({c}) FROM p_catalog c WHERE (c.instance_name, c.product_type, c.product_key) = (t.instance_name, t.product_type, t.product_key) AND c.project_key IS NOT DISTINCT FROM t.project_key) AS own_{n}, "
            f"CASE WHEN project_key IS NULL THEN (SELECT CASE WHEN count(*) = 1 THEN min({c}) END FROM p_catalog c WHERE (c.instance_name, c.product_type, c.product_key) = (t.instance_name, t.product_type, t.product_key)) END AS lent_{n}"
            for n, c in (('name', 'product_name'), ('owner', 'owner_login')))}
  FROM (SELECT product_id, instance_name, project_key, object_type AS product_type, object_key AS product_key, count(*) AS events, count(DISTINCT login) AS active_users, max(timestamp) AS last_activity_at
    FROM c_matched GROUP BY product_id, instance_name, project_key, object_type, object_key QUALIFY row_number() OVER (ORDER BY count(*) DESC, max(timestamp) DESC, instance_name, project_key NULLS LAST, object_type, object_key) <= 50) t) x""",
    ),
    "consumption_facets": (
        lambda s: con.consumption_facets(s.object_events, s.catalog),
        f"""SELECT facet, value FROM ({' UNION '.join(
            f"SELECT '{f}' AS facet, {c} AS value FROM obj_events WHERE object_type IN {in_list(dims.CONSUMPTION_TYPES)}"
            for f, c in {'instances': 'instance_name', 'projects': 'project_key', 'types': 'object_type'}.items())}
UNION SELECT 'owners', owner_login FROM p_catalog) f WHERE value IS NOT NULL""",
    ),
    "product_detail": (
        lambda s: con.product_detail(s.object_events, s.catalog, PRODUCT, AS_OF),
        f"""SELECT *, CASE WHEN maturity_score >= 75 THEN 'scaled' WHEN maturity_score >= 45 THEN 'growing' ELSE 'emerging' END AS maturity_tier
FROM (SELECT *, round((breadth_score + repeat_score + collaboration_score + concentration_score) / 4, 1) AS maturity_score FROM (
SELECT p.product_id, p.instance_name, p.project_key, p.product_type, p.product_key, p.product_name, p.owner_login, p.product_subtype, p.created_at, p.updated_at,
  n AS events, u AS active_users, l AS last_event_at, n >= 5 AS repeat_use, u >= 2 AS collaborative,
  CASE WHEN u = 1 THEN 'Tier 1 · 1 user' WHEN u >= 2 AND n < 5 THEN 'Tier 2 · 2+ users, <5 events' WHEN u >= 2 THEN 'Tier 3 · 2+ users, 5+ events' ELSE 'Unclassified' END AS adoption_tier,
  round(least(u / 5, 1) * 100, 1) AS breadth_score, round(least(n / 5, 1) * 100, 1) AS repeat_score, round(least(u / 2, 1) * 100, 1) AS collaboration_score,
  round(CASE WHEN n > 0 THEN greatest(0.0::DOUBLE, 100 - n / greatest(n, 10) * 100) ELSE 0.0::DOUBLE END, 1) AS concentration_score
FROM (SELECT * FROM p_catalog WHERE product_id = '{PRODUCT}') p, (SELECT count(*) AS n, count(DISTINCT login) AS u, max(timestamp) AS l FROM one_product) t) a) b""",
    ),
    "product_detail_daily": (
        lambda s: con.product_detail_daily(s.object_events, s.catalog, PRODUCT, AS_OF),
        "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS label, count(*) AS value FROM one_product GROUP BY ALL",
    ),
    "product_detail_users": (
        lambda s: con.product_detail_users(s.object_events, s.catalog, PRODUCT, AS_OF),
        "SELECT login AS label, count(*) AS value FROM one_product GROUP BY ALL ORDER BY value DESC, label LIMIT 25",
    ),
    "product_durations": (
        lambda s: con.product_durations(s.object_events, s.catalog, AS_OF),
        """SELECT product_id, created_at, first_consumption_at, multi_user_at, repeat_use_at, CAST(d1 AS INTEGER) AS days_to_first_consumption,
  CAST(d2 AS INTEGER) AS days_to_multi_user, CAST(d3 AS INTEGER) AS days_to_repeat_use FROM l_spans""",
    ),
    "lifecycle": (
        lambda s: con.lifecycle(s.object_events, s.catalog, AS_OF),
        f"""SELECT count(*) AS products_with_created_at, count(first_consumption_at) AS products_with_first_consumption, count(multi_user_at) AS products_with_multi_user,
  count(repeat_use_at) AS products_with_repeat_use, {', '.join(f'CAST(median({d}) FILTER (WHERE {d} >= 0) AS DOUBLE) AS median_days_to_{n}, avg({d}) FILTER (WHERE {d} >= 0) AS avg_days_to_{n}'
            for d, n in (('d1', 'first_consumption'), ('d2', 'multi_user'), ('d3', 'repeat_use')))} FROM l_spans""",
    ),
    "match_diagnostics": (
        lambda s: con.match_diagnostics(s.object_events, s.catalog, AS_OF),
        """SELECT count(*) AS eligible_events, count(*) FILTER (WHERE match_type = 'exact') AS exact_matches, count(*) FILTER (WHERE match_type = 'fallback') AS fallback_matches,
  count(product_id) AS matched_events, count(*) FILTER (WHERE product_id IS NULL) AS unmatched_events FROM c_tagged""",
    ),
    "unmatched_by_type": (
        lambda s: con.unmatched_by_type(s.object_events, s.catalog, AS_OF),
        "SELECT object_type AS label, count(*) AS events FROM c_tagged WHERE product_id IS NULL GROUP BY ALL",
    ),
    "unmatched_sample": (
        lambda s: con.unmatched_sample(s.object_events, s.catalog, AS_OF),
        """SELECT DISTINCT instance_name, project_key, object_type, object_key FROM c_tagged WHERE product_id IS NULL
ORDER BY instance_name, project_key NULLS LAST, object_type, object_key LIMIT 20""",
    ),
    "assets": (
        lambda s: inv.assets(s.asset_catalog, q="obj1", types=["dataset", "recipe", "sql_notebook"], owner="USER", sort="completeness_desc", limit=25, offset=5),
        _listing(_LIST_SCORE, "a_catalog", "object", "asset_id",
                 """object_type IN ('dataset', 'recipe', 'sql_notebook') AND lower(owner_login) LIKE '%user%' AND (lower(object_name) LIKE '%obj1%'
  OR lower(object_key) LIKE '%obj1%' OR lower(project_key) LIKE '%obj1%' OR lower(owner_login) LIKE '%obj1%')""", "sc DESC, updated_at DESC NULLS LAST", 25, 5),
    ),
    "asset_completeness": (
        lambda s: s.asset_index.select("instance_name", "project_key", "object_type", "object_key", inv.asset_completeness().alias("score"), inv.metadata_status(inv.asset_completeness()).alias("status")),
        f"SELECT instance_name, project_key, object_type, object_key, {_LIST_SCORE} AS score, {_STATUS.format(s='(' + _LIST_SCORE + ')')} AS status FROM a_index",
    ),
    "asset_metadata_summary": (lambda s: inv.asset_metadata_summary(s.asset_index), _summary(_SUM_SCORE, "object_type", "a_index")),
    "asset_facets": (lambda s: inv.asset_facets(s.asset_index), _facet_rows("a_index", "object_type")),
    "asset_detail": (
        lambda s: inv.asset_detail(s.asset_catalog, s.object_events, ASSET, catalog_details(s, "dataset")),
        f"""SELECT asset_id, c.instance_name, c.project_key, object_type, c.object_key, c.object_name, c.owner_login, c.updated_at,
  (SELECT count(*) FROM obj_events e WHERE e.object_type = c.object_type AND e.object_key = c.object_key AND e.project_key = c.project_key) AS events_all_time,
  {_describe('i.extras')} AS description
FROM a_catalog c LEFT JOIN inv_latest i ON i.instance_name = c.instance_name AND i.project_key = c.project_key AND i.object_key = c.object_key WHERE asset_id = '{ASSET}'""",
    ),
    "asset_related": (
        lambda s: inv.asset_related(s.asset_catalog, s.object_events, ASSET),
        f"""SELECT e.instance_name, e.project_key, count(*) AS event_count FROM obj_events e JOIN (SELECT * FROM a_catalog WHERE asset_id = '{ASSET}') c
ON e.object_type = c.object_type AND e.object_key = c.object_key AND e.project_key = c.project_key GROUP BY ALL""",
    ),
    "products": (
        lambda s: inv.products(s.catalog, q="obj", projects=["P1", "P2", "P3"], status="partial", sort="activity_desc", limit=40),
        _listing(_PSCORE, "p_catalog", "product", "product_id",
                 "project_key IN ('P1', 'P2', 'P3') AND sc >= 50 AND sc < 99.9 AND (lower(product_name) LIKE '%obj%' OR lower(product_key) LIKE '%obj%')",
                 "activity_30d DESC, updated_at DESC NULLS LAST", 40, 0),
    ),
    "product_completeness": (
        lambda s: s.catalog.select("product_id", inv.product_completeness().alias("score")),
        f"SELECT product_id, {_PSCORE} AS score FROM p_catalog",
    ),
    "product_metadata_summary": (lambda s: inv.product_metadata_summary(s.catalog), _summary(_PSCORE, "product_type", "p_catalog")),
    "product_facets": (lambda s: inv.product_facets(s.catalog), _facet_rows("p_catalog", "product_type")),
    "product_info": (
        lambda s: inv.product_info(s.catalog, s.object_events, PRODUCT, catalog_details(s, "dashboard")),
        f"""SELECT product_id, c.instance_name, c.project_key, product_type, product_key, product_name, c.owner_login, c.updated_at, activity_30d,
  (SELECT count(*) FROM obj_events e WHERE e.object_type = c.product_type AND e.object_key = c.product_key AND e.project_key = c.project_key) AS events_all_time,
  {_describe('i.extras')} AS description
FROM p_catalog c LEFT JOIN inv_latest i ON i.instance_name = c.instance_name AND i.project_key = c.project_key AND i.object_key = c.product_key WHERE product_id = '{PRODUCT}'""",
    ),
    "product_related": (
        lambda s: inv.product_related(s.catalog, s.object_events, PRODUCT),
        f"""SELECT e.instance_name, e.project_key, count(*) AS event_count FROM obj_events e JOIN (SELECT * FROM p_catalog WHERE product_id = '{PRODUCT}') c
ON e.object_type = c.product_type AND e.object_key = c.product_key AND e.project_key = c.project_key GROUP BY ALL""",
    ),
    "type_kpis": (
        lambda s: inv.type_kpis(s.catalog, s.object_events, _TYPE, AS_OF),
        f"""SELECT *, (SELECT count(*) {_TYPE_EVENTS}) AS events, (SELECT count(DISTINCT login) {_TYPE_EVENTS}) AS active_users_30d FROM (
SELECT count(*) AS total_products, count(*) FILTER (WHERE activity_30d > 0) AS active_products_30d, CAST(sum(activity_30d) AS BIGINT) AS events_30d,
  max(last_activity_at) AS last_activity_at FROM p_catalog WHERE product_type = '{_TYPE}') k""",
    ),
    "type_metrics": (lambda s: inv.type_metrics(s.catalog, s.object_events, _TYPE, AS_OF), _TYPE_METRICS),
    "products_by_project": (lambda s: inv.products_by_project(s.catalog), "SELECT project_key AS label, count(*) AS value FROM p_catalog GROUP BY ALL"),
    "products_by_instance": (lambda s: inv.products_by_instance(s.catalog), "SELECT instance_name AS label, count(*) AS value FROM p_catalog GROUP BY ALL"),
    "products_over_time": (
        lambda s: inv.products_over_time(s.catalog),
        """SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS value FROM p_catalog GROUP BY ALL ORDER BY month DESC NULLS LAST LIMIT 12""",
    ),
    "type_top_owners": (
        lambda s: inv.type_top_owners(s.catalog, _TYPE),
        f"SELECT owner_login AS label, count(*) AS value FROM p_catalog WHERE product_type = '{_TYPE}' GROUP BY ALL ORDER BY value DESC, label NULLS LAST LIMIT 20",
    ),
}

QUERIES = {name: (lambda spark, d, fn=fn: fn(Sources(spark, d))) for name, (fn, _) in CASES.items()}
ORACLE = {name: sql(text) for name, (_, text) in CASES.items() if text}
