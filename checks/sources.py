"""Lazily built library frames over the adapted driver tables."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import AS_OF, adapted, driver_table
from fleetlens.session import configure
from fleetlens.sources.scratch import new_path
from fleetlens.operators import activity, development, licences, objects
from fleetlens.operators.latest import latest_inventory
from fleetlens.plans import consumption, inventory
from fleetlens.plans import development as dev_plans
from fleetlens.plans import users as user_plans

_WRITTEN: dict[str, str] = {}
_LOCKS: dict[str, threading.Lock] = {}
_GUARD = threading.Lock()


class stored:
    """A table of the pipeline: written once per session, then read back.

    Serving queries read stored tables, as they do in production; this keeps their
    plans small. Queries that exercise the build itself use :meth:`Sources.compute`.
    """

    def __init__(self, build: Callable[[Sources], DataFrame]):
        self.build = build

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, sources, owner=None):
        return self if sources is None else sources.read_stored(self.name, self.build)


class Sources:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def read_stored(self, name: str, build: Callable[[Sources], DataFrame]) -> DataFrame:
        source = hashlib.md5(self.sf_dir.encode()).hexdigest()[:10]
        key = f"{self.spark.sparkContext.applicationId}/{source}/{name}"
        with _GUARD:
            lock = _LOCKS.setdefault(key, threading.Lock())
        with lock:
            if key not in _WRITTEN:
                path = new_path(self.spark, f"{source}/{name}")
                # Written as built: the narrow driver rows were dealt over tasks before (see ``spread``),
                # so no wide row is shuffled or sorted only to be stored.
                build(self).write.parquet(path)
                _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def compute(self, name: str) -> DataFrame:
        """Build a stored table from its stored inputs, without reading the stored copy."""
        return getattr(type(self), name).build(self)

    def table(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.sf_dir, name)

    def adapted(self, name: str) -> DataFrame:
        return adapted(self.spark, self.sf_dir, name)

    def spread(self, name: str) -> DataFrame:
        """An adapted table whose driver rows are dealt over tasks of bounded size."""
        return adapted(self.spark, self.sf_dir, name, spread=True)

    @stored
    def audit(self) -> DataFrame:
        return self.spread("audit")

    @stored
    def audit_flat(self) -> DataFrame:
        return self.spread("audit_flat")

    @stored
    def users(self) -> DataFrame:
        return self.adapted("users")

    @stored
    def dev_events(self) -> DataFrame:
        return development.dev_activity_events(self.audit)

    @stored
    def enriched(self) -> DataFrame:
        return dev_plans.dev_activity_enriched(self.spark, self.dev_events)

    @stored
    def hourly(self) -> DataFrame:
        return activity.user_activity_hourly(self.audit_flat)

    @stored
    def mau_hourly(self) -> DataFrame:
        return activity.formal_mau_hourly(self.audit_flat)

    @stored
    def daily(self) -> DataFrame:
        return activity.user_activity_daily(self.hourly)

    @stored
    def project_daily(self) -> DataFrame:
        return activity.user_activity_project_daily(self.hourly)

    @stored
    def mau_daily(self) -> DataFrame:
        return activity.formal_mau_daily(self.mau_hourly)

    @stored
    def max_licenses(self) -> DataFrame:
        return self.spread("max_licenses")

    @stored
    def max_latest(self) -> DataFrame:
        return latest_inventory(self.max_licenses, "license_max", ["c_custkey"])

    @stored
    def license_fact(self) -> DataFrame:
        return licences.license_utilization_daily(self.max_licenses, self.users)

    @stored
    def formal(self) -> DataFrame:
        return user_plans.formal_mau_enriched(self.mau_daily, self.users, self.daily)

    @property
    def object_silver(self) -> DataFrame:
        # A row-wise view of the driver rows, wider and longer than they are: cheaper made again than stored.
        return self.spread("object_silver")

    @stored
    def object_events(self) -> DataFrame:
        return objects.object_activity_events(self.spark, self.object_silver)

    @stored
    def inventory(self) -> DataFrame:
        return self.spread("inventory")

    def inventory_of(self, name: str) -> DataFrame:
        """The snapshots under the source column names of one inventory."""
        values = INVENTORY_COLUMNS[name]
        base = ["instance_name", "project_key", "extras", "run_ts", "partition_date"]
        return self.inventory.select(*base, *[F.col(src).alias(out) for out, src in values.items()])

    def metadata_of(self, name: str) -> DataFrame:
        return inventory.metadata(latest_inventory(self.inventory_of(name), name), name)

    @cached_property
    def asset_tables(self) -> dict[str, DataFrame]:
        raw = ("sql_notebooks", "managed_folders")
        tables = {n: latest_inventory(self.inventory_of(n), n) for n in raw}
        return {**tables, **{n: self.metadata_of(n) for n in ("projects", "datasets", "recipes", "scenarios")}}

    @cached_property
    def product_tables(self) -> dict[str, DataFrame]:
        names = ("agent_tools", "api_services", "dashboards", "insights", "saved_models", "webapps", "apps")
        return {n: self.metadata_of(n) for n in names}

    @stored
    def asset_index(self) -> DataFrame:
        return inventory.asset_index(self.spark, self.asset_tables)

    @stored
    def product_index(self) -> DataFrame:
        return inventory.product_index(self.spark, self.product_tables)

    @stored
    def asset_catalog(self) -> DataFrame:
        return inventory.build_catalog(self.asset_index, inventory.asset_activity_30d(self.object_events, AS_OF))

    @stored
    def catalog(self) -> DataFrame:
        activity_ = inventory.product_activity_30d(self.object_events, AS_OF)
        return inventory.products_catalog(self.product_index, activity_, self.metadata_of("projects"))

    @stored
    def matched(self) -> DataFrame:
        return consumption.matched_consumption(self.object_events, self.catalog, AS_OF)


def _owned_columns(prefix: str, key: str = "id", **extra: str) -> dict[str, str]:
    columns = {f"{prefix}_{key}": "object_key", f"{prefix}_name": "object_name", f"{prefix}_type": "object_subtype"}
    columns |= {f"{prefix}_owner": "owner_login", f"{prefix}_lastmodifiedby_login": "owner_login"}
    columns |= {f"{prefix}_createdon": "created_text", f"{prefix}_lastmodifiedon": "updated_text"}
    return columns | extra


def _tag_columns(prefix: str, **extra: str) -> dict[str, str]:
    return {
        f"{prefix}_name": "object_key",
        f"{prefix}_type": "object_subtype",
        f"{prefix}_versiontag_lastmodifiedby_login": "owner_login",
        f"{prefix}_creationtag_lastmodifiedon": "created_text",
        f"{prefix}_versiontag_lastmodifiedon": "updated_text",
    } | extra


INVENTORY_COLUMNS = {
    "projects": _tag_columns("projects", projects_name="project_key", projects_ownerlogin="owner_login", projects_projecttype="object_subtype"),
    "datasets": _tag_columns("datasets", datasets_smartname="object_name"),
    "recipes": _tag_columns("recipes"),
    "scenarios": _owned_columns("scenarios", scenarios_runasuser="owner_login"),
    "sql_notebooks": {
        "sql_notebooks_id": "object_key",
        "sql_notebooks_name": "object_name",
        "sql_notebooks_language": "object_subtype",
        "sql_notebooks_connectiondisplayname": "owner_login",
        "sql_notebooks_connection": "object_key",
        "sql_notebooks_createdon": "created_text",
        "sql_notebooks_lastmodifiedon": "updated_text",
    },
    # One expected column is missing, so the index leaves this type out.
    "managed_folders": {"managed_folders_id": "object_key", "managed_folders_name": "object_name"},
    "dashboards": _owned_columns("dashboards"),
    "insights": _owned_columns("insights"),
    "api_services": _owned_columns("api_services"),
    "agent_tools": _owned_columns("agent_tools"),
    "saved_models": _owned_columns("saved_models", saved_models_backendtype="object_key", saved_models_predictiontype="object_key"),
    "webapps": _owned_columns("webapps", webapps_createdby_login="owner_login"),
    "retrieval_augmented_llms": {
        "retrieval_augmented_llms_id": "object_key",
        "retrieval_augmented_llms_activeversion": "object_subtype",
        "retrieval_augmented_llms_createdon": "created_text",
        "retrieval_augmented_llms_lastmodifiedon": "updated_text",
    },
    "apps": {"apps_appid": "object_key", "apps_label": "object_name", "apps_origin": "object_subtype", "apps_originprojectkey": "project_key"},
}


def stored_path(s: Sources, name: str, write: Callable[[str], None]) -> str:
    """Path of files written once per session by ``write``."""
    key = f"{s.spark.sparkContext.applicationId}/{hashlib.md5(s.sf_dir.encode()).hexdigest()[:10]}/files/{name}"
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.Lock())
    with lock:
        if key not in _WRITTEN:
            path = new_path(s.spark, name)
            write(path)
            _WRITTEN[key] = path
    return _WRITTEN[key]
