"""Object activity: which object an audit event touched, deduplicated across deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.rollup import latest
from fleetlens.functions.text import canonical, clean_identifier, first_text, null_if_blank
from fleetlens.plans.dims import OBJECT_MODULES, dim_capability

# Per module the object type, native key columns and keys inside extras.
OBJECT_SOURCES = [
    (["datasets", "dataset"], "dataset", ["datasetname"], []),
    (["visual_recipes", "misc_recipes", "prepare"], "recipe", ["recipename"], []),
    (["webapps"], "web_application", ["webappid", "webappid_source_call"], ["webappid"]),
    (["charts_dashboard"], "insight", ["insightid", "dashboardinsightid"], ["insightId", "insightid", "dashboardInsightId"]),
    (["apis"], "api_service", ["serviceid", "apiserviceid"], ["serviceId", "apiServiceId", "apiserviceid", "serviceid"]),
    (["application_designer"], "application", ["applicationid", "appid"], ["applicationId", "applicationid", "appId", "appid"]),
]
PLAIN_TYPES = {"dataset", "recipe"}  # names are taken as they are, placeholders included
DASHBOARD_MODULE, APPLICATION_MODULE, OPEN_EVENT = "charts_dashboard", "application_designer", "application-open"


def _present(df: DataFrame, names: list[str]) -> list[Column]:
    return [null_if_blank(n) for n in names if n in df.columns]


def with_object_identity(df: DataFrame) -> DataFrame:
    """Add ``object_type`` and ``object_key`` from the ``module`` and identifiers of an event.

    Modules without an object rule use the module name as type and have no key. The
    JSON in ``extras`` is parsed at most once per row.
    """
    module = F.col("module")
    rows = df
    if "extras" in df.columns:
        # Only where the native columns name no object is the JSON read.
        needed: Column = F.lit(False)
        for modules, _, natives, paths in OBJECT_SOURCES:
            if paths:
                named = _present(df, natives + (["dashboardid"] if DASHBOARD_MODULE in modules else []))
                needed = needed | (module.isin(modules) & F.coalesce(*named, F.lit(None).cast("string")).isNull())
        parsed = F.from_json(F.col("extras").cast("string"), "map<string,string>")
        rows = rows.withColumn("_extras", F.when(needed, parsed))
    nothing = F.lit(None).cast("string")
    kind, key, cleaned = module, nothing, []
    for modules, name, natives, paths in OBJECT_SOURCES:
        found = _present(df, natives)
        if "extras" in df.columns:
            found += [null_if_blank(F.try_element_at("_extras", F.lit(p))) for p in paths]
        label: Column = F.lit(name)
        if DASHBOARD_MODULE in modules:
            dashboard = _present(df, ["dashboardid"])
            if dashboard:
                found = dashboard + found
                label = F.when(dashboard[0].isNotNull(), "dashboard").otherwise(label)
        here = module.isin(modules)
        kind = F.when(here, label).otherwise(kind)
        key = F.when(here, F.coalesce(*found, nothing)).otherwise(key)
        if name not in PLAIN_TYPES:
            cleaned += modules
    # Emitting the pair through a generator keeps later filters on the key above it;
    # pushed below, they would repeat the whole rule (and the JSON parse) per mention.
    pair = F.inline(F.array(F.struct(kind.alias("object_type"), key.alias("_key"))))
    rows = rows.select(*df.columns, pair)
    tidy = F.when(module.isin(cleaned), clean_identifier("_key")).otherwise(F.col("_key"))
    return rows.withColumn("object_key", tidy).drop("_key")


def _object_rows(silver: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """Attributed events with their object, as narrow as they can be compared."""
    wanted = modules or [*OBJECT_MODULES, "dataset"]
    login = first_text(*[c for c in ("authuser", "user") if c in silver.columns])
    known = [m for names, *_ in OBJECT_SOURCES for m in names]
    ips = [F.col(c).cast("string") for c in ("clientip", "originalip") if c in silver.columns]
    times = [F.col(c) for c in ("timestamp", "date") if c in silver.columns]
    nothing = F.lit(None).cast("string")
    rows = with_object_identity(silver.filter(F.col("module").isin(wanted))).select(
        F.coalesce(*times).try_cast("timestamp").alias("timestamp"),
        "instance_name",
        login.alias("login"),
        F.col("msgtype").alias("event_name"),
        F.col("activity_category").alias("event_category"),
        "project_key",
        "object_type",
        "object_key",
        F.coalesce(*ips, nothing).alias("ip_address"),
        (F.col("extras").cast("string") if "extras" in silver.columns else nothing).alias("details_json"),
        F.col("run_ts").try_cast("timestamp").alias("run_timestamp"),
        "module",
    )
    rows = rows.filter(F.col("login").isNotNull() & (F.col("object_key").isNotNull() | ~F.col("module").isin(known)))
    # Opening an application is use of the platform, not of the application object.
    return rows.filter((F.col("module") != APPLICATION_MODULE) | (F.col("event_name") != OPEN_EVENT)).drop("module")


def _capabilities(spark: SparkSession, capability: DataFrame | None) -> DataFrame:
    table = dim_capability(spark) if capability is None else capability
    return table.select(canonical("activity_category").alias("_cat"), F.col("capability").alias("canonical_capability"))


def _described(rows: DataFrame, caps: DataFrame) -> DataFrame:
    joined = rows.withColumn("_cat", canonical("event_category")).join(caps, "_cat", "left")
    return joined.withColumn("object_name", F.col("object_key")).drop("_cat")


def object_events(spark: SparkSession, silver: DataFrame, capability: DataFrame | None = None, modules: list[str] | None = None) -> DataFrame:
    """Attributed events with their object, before deduplication."""
    return _described(_object_rows(silver, modules), _capabilities(spark, capability))


def dedupe_object_events(events: DataFrame) -> DataFrame:
    """Keep the newest delivery of an event; spelling of login and category is ignored."""
    keys = [
        "timestamp",
        "instance_name",
        F.lower(F.trim(F.coalesce("login", F.lit("")))),
        "event_name",
        canonical(F.coalesce("event_category", F.lit(""))),
        "project_key",
        "object_type",
        "object_key",
        "ip_address",
        "details_json",
    ]
    order = [F.col("run_timestamp").desc_nulls_last(), F.col("event_category").asc_nulls_last(), F.col("login").asc()]
    return latest(events, keys, order)


def object_activity_events(spark: SparkSession, silver: DataFrame, capability: DataFrame | None = None) -> DataFrame:
    """Attributed events with their object, each once.

    What follows from other columns is added after the deduplication, so it is not shuffled with the rows.
    """
    caps = _capabilities(spark, capability).groupBy("_cat").agg(F.min("canonical_capability").alias("canonical_capability"))
    return _described(dedupe_object_events(_object_rows(silver)), caps)
