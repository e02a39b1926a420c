"""Latest-state tables over append-only snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rollup import latest
from fleetlens.functions.text import login_norm

# Identity columns of every inventory, besides the instance.
INVENTORY_KEYS = {
    "apps": ["apps_appid"],
    "clusters": ["clusters_id"],
    "code_env_usages": ["envname", "envlang"],
    "code_envs": ["envname", "envlang"],
    "groups": ["groups_name"],
    "license_addon": ["addon_key"],
    "license_max": ["license_profile"],
    "license_status": [],
    "llms": ["llms_id"],
    "plugins": ["plugins_id"],
    "projects": ["project_key"],
    "users": ["users_login"],
    "workspaces": ["workspacekey"],
    "agent_tools": ["project_key", "agent_tools_id"],
    "analyses": ["project_key", "analyses_analysisid"],
    "api_services": ["project_key", "api_services_id"],
    "dashboards": ["project_key", "dashboards_id"],
    "datasets": ["project_key", "datasets_name"],
    "insights": ["project_key", "insights_id"],
    "knowledge_banks": ["project_key", "knowledge_banks_id"],
    "managed_folders": ["project_key", "managed_folders_id"],
    "recipes": ["project_key", "recipes_name"],
    "retrieval_augmented_llms": ["project_key", "retrieval_augmented_llms_id"],
    "saved_models": ["project_key", "saved_models_id"],
    "scenarios": ["project_key", "scenarios_id"],
    "sql_notebooks": ["project_key", "sql_notebooks_id"],
    "webapps": ["project_key", "webapps_id"],
}


def latest_by_partition(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Newest row per (instance, keys): latest run, then latest partition day.

    ``tie_break`` columns (ascending) make the choice repeatable when both are equal.
    """
    order = [F.col("run_ts").desc_nulls_last()]
    if "partition_date" in df.columns:
        order.append(F.col("partition_date").desc_nulls_last())
    order += [F.col(c).asc_nulls_last() for c in tie_break]
    return latest(df, ["instance_name", *keys], order)


def latest_inventory(df: DataFrame, inventory: str, tie_break: Sequence[str] = ()) -> DataFrame:
    return latest_by_partition(df, INVENTORY_KEYS[inventory], tie_break)


def latest_users(users: DataFrame, instance: str | None = None) -> DataFrame:
    """Newest account record per (instance, normalised login), with ``login_norm`` added."""
    rows = users.withColumn("login_norm", login_norm("users_login")).filter(F.length("login_norm") > 0)
    if instance:
        rows = rows.filter(F.col("instance_name") == instance)
    optional = [c for c in ("partition_date", "users_lastsessionactivity") if c in users.columns]
    order = [F.col(c).desc_nulls_last() for c in ("run_ts", *optional)]
    return latest(rows, ["instance_name", "login_norm"], [*order, F.trim("users_login").asc()])
