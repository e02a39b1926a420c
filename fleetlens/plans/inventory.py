"""Asset and product inventories: metadata, indexes, catalogues, completeness, details."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from fleetlens.functions.calendar import since_days
from fleetlens.functions.casts import epoch_or_iso_ts
from fleetlens.functions.rollup import merge_single_rows, top_n
from fleetlens.functions.text import as_col, has_text, null_if_blank, row_id
from fleetlens.plans.dims import PRODUCT_TYPES, literal_table

# --- metadata projections --------------------------------------------------------------


@dataclass(frozen=True)
class Metadata:
    """Readable projection of one inventory: output column -> source columns in order."""

    columns: dict[str, list[str]]
    times: dict[str, str] = field(default_factory=dict)
    project: str = "project_key"


def _tagged(prefix: str, noun: str, **extra: list[str]) -> Metadata:
    columns = {f"{noun}_{k}": v for k, v in extra.items()}
    columns[f"{noun}_last_modified_by_login"] = [f"{prefix}_versiontag_lastmodifiedby_login"]
    times = {
        f"{noun}_created_at": f"{prefix}_creationtag_lastmodifiedon",
        f"{noun}_updated_at": f"{prefix}_versiontag_lastmodifiedon",
    }
    return Metadata(columns, times)


def _owned(key: str, name: str, kind: list[str], owner: list[str], modified: list[str], created: str = "", updated: str = "", project: str = "project_key") -> Metadata:
    columns = {"key": [key], "name": [name], "subtype": kind, "owner_login": owner, "last_modified_by_login": modified}
    times = {"created_at": created, "updated_at": updated}
    return Metadata(columns, times, project)


# Source column names of each inventory.
METADATA = {
    "projects": _tagged("projects", "project", name=["projects_name"], owner_login=["projects_ownerlogin"], type=["projects_projecttype"]),
    "datasets": _tagged("datasets", "dataset", name=["datasets_name"], smart_name=["datasets_smartname"], type=["datasets_type"]),
    "recipes": _tagged("recipes", "recipe", name=["recipes_name"], type=["recipes_type"]),
    "scenarios": Metadata(
        {
            "scenario_id": ["scenarios_id"],
            "scenario_name": ["scenarios_name"],
            "scenario_type": ["scenarios_type"],
            "scenario_run_as_login": ["scenarios_runasuser"],
        },
        {"scenario_created_at": "scenarios_createdon", "scenario_updated_at": "scenarios_lastmodifiedon"},
    ),
    "dashboards": _owned("dashboards_id", "dashboards_name", [], ["dashboards_owner"], ["dashboards_lastmodifiedby_login"], "dashboards_createdon", "dashboards_lastmodifiedon"),
    "webapps": _owned("webapps_id", "webapps_name", ["webapps_type"], ["webapps_createdby_login", "webapps_lastmodifiedby_login"], ["webapps_lastmodifiedby_login"], "webapps_createdon", "webapps_lastmodifiedon"),
    "insights": _owned("insights_id", "insights_name", ["insights_type"], ["insights_owner"], ["insights_lastmodifiedby_login"], "insights_createdon", "insights_lastmodifiedon"),
    "api_services": _owned("api_services_id", "api_services_name", ["api_services_type"], ["api_services_owner"], ["api_services_lastmodifiedby_login"], "api_services_createdon", "api_services_lastmodifiedon"),
    "agent_tools": _owned("agent_tools_id", "agent_tools_name", ["agent_tools_type"], ["agent_tools_owner"], ["agent_tools_lastmodifiedby_login"], "agent_tools_createdon", "agent_tools_lastmodifiedon"),
    "saved_models": _owned("saved_models_id", "saved_models_name", ["saved_models_type", "saved_models_backendtype", "saved_models_predictiontype"], [], [], "saved_models_createdon", "saved_models_lastmodifiedon"),
    "retrieval_augmented_llms": _owned("retrieval_augmented_llms_id", "retrieval_augmented_llms_id", ["retrieval_augmented_llms_activeversion"], [], [], "retrieval_augmented_llms_createdon", "retrieval_augmented_llms_lastmodifiedon"),
    "apps": _owned("apps_appid", "apps_label", ["apps_origin"], [], [], project="apps_originprojectkey"),
}


def _first(df: DataFrame, names: list[str]) -> Column:
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def metadata(df: DataFrame, inventory: str) -> DataFrame:
    """Projection of the latest rows of an inventory, times typed."""
    spec = METADATA[inventory]
    times = [
        (epoch_or_iso_ts(src) if src in df.columns else F.lit(None).cast("timestamp")).alias(name)
        for name, src in spec.times.items()
    ]
    rows = df if spec.project == "project_key" else df.filter(F.col(spec.project).isNotNull())
    details = [F.col("extras").cast("string").alias("details_json")] if "extras" in df.columns else []
    return rows.select(
        "instance_name",
        F.col(spec.project).alias("project_key"),
        *[(first_owner(rows, v) if k == "owner_login" else _first(rows, v)).alias(k) for k, v in spec.columns.items()],
        *times,
        *details,
    )


def first_owner(df: DataFrame, names: list[str]) -> Column:
    """Owner columns in order, skipping blank ones when there is a choice."""
    if len(names) < 2:
        return _first(df, names)
    return F.coalesce(*[null_if_blank(n) for n in names if n in df.columns], F.lit(None).cast("string"))


def empty_optional_inventory(spark: SparkSession, df: DataFrame | None, schema: str, *, failed: bool = False) -> DataFrame:
    """``df`` if present, else an empty frame of the expected shape.

    A source that exists but could not be read is an error, not an absence.
    """
    if failed:
        raise RuntimeError("optional inventory exists but could not be read")
    return spark.createDataFrame([], schema) if df is None else df


# --- indexes ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TypeSpec:
    """Where a catalogue type comes from; every field lists columns in order of preference."""

    source: str
    key: list[str]
    name: list[str]
    subtype: list[str]
    owner: list[str]
    modified_by: list[str]
    created: str | None
    updated: str | None


def _noun(source: str, noun: str, key: list[str], name: list[str], owner: str) -> TypeSpec:
    modified = f"{noun}_run_as_login" if noun == "scenario" else f"{noun}_last_modified_by_login"
    return TypeSpec(source, key, name, [] if noun == "project" else [f"{noun}_type"], [owner], [modified], f"{noun}_created_at", f"{noun}_updated_at")


ASSET_TYPES = {
    "analysis": TypeSpec("analyses", ["analyses_analysisid"], ["analyses_analysisname"], ["analyses_inputdataset"], [], [], None, None),
    "project": _noun("projects", "project", ["project_key"], ["project_name"], "project_owner_login"),
    "dataset": _noun("datasets", "dataset", ["dataset_name"], ["dataset_smart_name", "dataset_name"], "dataset_last_modified_by_login"),
    "knowledge_bank": TypeSpec(
        "knowledge_banks", ["knowledge_banks_id"], ["knowledge_banks_name"],
        ["knowledge_banks_retrievertype", "knowledge_banks_vectorstoretype", "knowledge_banks_embeddingllmid"],
        ["knowledge_banks_creationtag_lastmodifiedby_login"], ["knowledge_banks_versiontag_lastmodifiedby_login"],
        "knowledge_banks_creationtag_lastmodifiedon", "knowledge_banks_versiontag_lastmodifiedon",
    ),
    "managed_folder": TypeSpec("managed_folders", ["managed_folders_id"], ["managed_folders_name"], ["managed_folders_type", "managed_folders_params_connection"], [], [], None, None),
    "recipe": _noun("recipes", "recipe", ["recipe_name"], ["recipe_name"], "recipe_last_modified_by_login"),
    "scenario": _noun("scenarios", "scenario", ["scenario_id"], ["scenario_name"], "scenario_run_as_login"),
    "sql_notebook": TypeSpec(
        "sql_notebooks", ["sql_notebooks_id"], ["sql_notebooks_name"],
        ["sql_notebooks_language", "sql_notebooks_connectiondisplayname", "sql_notebooks_connection"],
        [], [], "sql_notebooks_createdon", "sql_notebooks_lastmodifiedon",
    ),
}


def _product(source: str) -> TypeSpec:
    return TypeSpec(source, ["key"], ["name"], ["subtype"], ["owner_login"], ["last_modified_by_login"], "created_at", "updated_at")


PRODUCT_SOURCES = {
    "agent_tool": "agent_tools",
    "api_service": "api_services",
    "api_endpoint": "api_endpoints",
    "agent": "agents",
    "dashboard": "dashboards",
    "insight": "insights",
    "retrieval_augmented_llm": "retrieval_augmented_llms",
    "saved_model": "saved_models",
    "web_application": "webapps",
    "application": "apps",
}
PRODUCT_SPECS = {name: _product(source) for name, source in PRODUCT_SOURCES.items()}

INDEX_COLUMNS = ["key", "name", "subtype", "owner_login", "last_modified_by_login", "created_at", "updated_at"]


def _moment(df: DataFrame, name: str | None) -> Column:
    """A time column; one that metadata has typed before is not turned into text and read again."""
    if name is None:
        return F.lit(None).cast("timestamp")
    return F.col(name) if df.schema[name].dataType == TimestampType() else epoch_or_iso_ts(name)


def _branch(df: DataFrame, kind: str, spec: TypeSpec, prefix: str) -> DataFrame:
    texts = [spec.key, spec.name, spec.subtype, spec.owner, spec.modified_by]
    columns = [_first(df, names) for names in texts]
    columns += [_moment(df, c) for c in (spec.created, spec.updated)]
    named = [c.alias(f"{prefix}_{n}" if n in ("key", "name", "subtype") else n) for c, n in zip(columns, INDEX_COLUMNS, strict=True)]
    return df.select("instance_name", "project_key", F.lit(kind).alias(f"{prefix}_type"), *named)


def _missing(df: DataFrame, spec: TypeSpec) -> list[str]:
    needed = {"instance_name", "project_key", *spec.key, *spec.name, *spec.subtype, *spec.owner, *spec.modified_by}
    return sorted((needed | {c for c in (spec.created, spec.updated) if c}) - set(df.columns))


def _index(spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, TypeSpec], prefix: str, where: dict[str, Column]) -> DataFrame:
    branches = []
    for kind, spec in specs.items():
        df = tables.get(spec.source)
        if df is None or _missing(df, spec):
            continue  # a type whose source is absent or incomplete is left out
        branches.append(_branch(df.filter(where[kind]) if kind in where else df, kind, spec, prefix))
    if not branches:
        text = ["instance_name", "project_key", f"{prefix}_type", *[f"{prefix}_{n}" for n in INDEX_COLUMNS[:3]], *INDEX_COLUMNS[3:5]]
        schema = ", ".join([*[f"{c} string" for c in text], "created_at timestamp", "updated_at timestamp"])
        return spark.createDataFrame([], schema)
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def skipped_types(spark: SparkSession, assets: dict[str, DataFrame], products: dict[str, DataFrame], types: Sequence[str] = tuple(PRODUCT_TYPES)) -> DataFrame:
    """Types that the indexes leave out, so that a caller can tell an incomplete catalogue: kind, type, source, reason."""
    rows = []
    for prefix, tables, specs in (("object", assets, ASSET_TYPES), ("product", products, {t: PRODUCT_SPECS[t] for t in types})):
        for kind, spec in specs.items():
            df = tables.get(spec.source)
            if df is None or _missing(df, spec):
                rows.append((prefix, kind, spec.source, "absent" if df is None else f"lacks {', '.join(_missing(df, spec))}"))
    return spark.createDataFrame(rows, "kind string, type string, source string, reason string")


def asset_index(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per asset over all typed inventories (independent of activity)."""
    return _index(spark, tables, ASSET_TYPES, "object", {})


def product_index(spark: SparkSession, tables: dict[str, DataFrame], types: Sequence[str] = tuple(PRODUCT_TYPES), where: dict[str, Column] | None = None) -> DataFrame:
    """One row per product; ``where`` narrows single types."""
    return _index(spark, tables, {t: PRODUCT_SPECS[t] for t in types}, "product", where or {})


def products_registry(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Product type to source and columns, as a table."""
    names = ["product_type", "source_table", "key_col", "name_col", "subtype_col", "owner_col", "last_modified_by_col", "created_at_col", "updated_at_col"]
    if rows is None:
        rows = [
            (t, s.source, s.key[0], s.name[0], s.subtype[0], s.owner[0], s.modified_by[0], s.created, s.updated)
            for t, s in PRODUCT_SPECS.items()
        ]
    kinds = [r[0] for r in rows]
    if len(set(kinds)) != len(kinds):
        raise ValueError("duplicate product type in registry")
    return literal_table(spark, dict.fromkeys(names, "string"), rows)


# --- activity and catalogues ---------------------------------------------------------------------


def asset_activity_30d(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Events and users in the window and last activity ever, per object."""
    recent = F.coalesce(since_days("timestamp", as_of, days), F.lit(False))
    rows = events.filter(F.col("object_type").isNotNull() & F.col("object_key").isNotNull())
    # Per-login counts first: the distinct count then runs on one row per person.
    keys = ["instance_name", "project_key", "object_type", "object_key"]
    grain = rows.groupBy(*keys, "login").agg(F.count_if(recent).alias("_n"), F.max("timestamp").alias("_last"))
    return grain.groupBy(*keys).agg(
        F.sum("_n").alias("activity_30d"),
        F.count_if((F.col("_n") > 0) & F.col("login").isNotNull()).alias("active_users_30d"),
        F.max("_last").alias("last_activity_at"),
    )


def product_activity_30d(events: DataFrame, as_of, types: Sequence[str] = tuple(PRODUCT_TYPES), days: int = 30) -> DataFrame:
    rows = events.filter(F.col("object_type").isin(list(types)))
    return asset_activity_30d(rows, as_of, days).withColumnsRenamed({"object_type": "product_type", "object_key": "product_key"})


def _with_activity(index: DataFrame, activity: DataFrame, prefix: str) -> DataFrame:
    keys = ["instance_name", "project_key", f"{prefix}_type", f"{prefix}_key"]
    joined = index.join(activity, keys, "left")
    return joined.withColumns(
        {
            "activity_30d": F.coalesce("activity_30d", F.lit(0)),
            "active_users_30d": F.coalesce("active_users_30d", F.lit(0)),
        }
    )


def build_catalog(index: DataFrame, activity: DataFrame) -> DataFrame:
    keys = ["instance_name", "project_key", "object_type", "object_key"]
    return _with_activity(index, activity, "object").withColumn("asset_id", row_id(*keys))


def products_catalog(index: DataFrame, activity: DataFrame, projects: DataFrame) -> DataFrame:
    keys = ["instance_name", "project_key", "product_type", "product_key"]
    names = projects.select("instance_name", "project_key", "project_name")
    out = _with_activity(index, activity, "product").withColumn("product_id", row_id(*keys))
    return out.join(names, ["instance_name", "project_key"], "left")


def object_activity_source(spark: SparkSession, curated: DataFrame | None, raw: DataFrame | None) -> DataFrame:
    """Curated object events, else raw events at project grain, else nothing."""
    if curated is not None:
        return curated
    schema = "timestamp timestamp, instance_name string, login string, project_key string, object_type string, object_key string"
    if raw is None:
        return spark.createDataFrame([], schema)
    return raw.select(
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
        "instance_name",
        F.col("authuser").alias("login"),
        "project_key",
        F.lit("project").alias("object_type"),
        F.col("project_key").alias("object_key"),
    )


# --- completeness ----------------------------------------------------------------------------------

COMPLETE, PARTIAL = 99.9, 50.0


def _score(parts: list[Column]) -> Column:
    filled = parts[0].cast("int")
    for part in parts[1:]:
        filled = filled + part.cast("int")
    return filled * 100.0 / len(parts)


def metadata_status(score: Column) -> Column:
    return F.when(score >= COMPLETE, "complete").when(score >= PARTIAL, "partial").otherwise("sparse")


def asset_completeness(style: str = "listing") -> Column:
    """Share of filled fields, 0 to 100.

    Datasets, recipes and scenarios also need a subtype. Other types are judged on four
    fields in listings and on the five project fields in summaries.
    """
    name, key, owner = (has_text(c) for c in ("object_name", "object_key", "owner_login"))
    created, updated = F.col("created_at").isNotNull(), F.col("updated_at").isNotNull()
    five = [name, key, owner, created, updated]
    typed = F.col("object_type").isin("dataset", "recipe", "scenario")
    other = _score([name, key, owner, updated]) if style == "listing" else _score(five)
    return (
        F.when(typed, _score([*five, has_text("object_subtype")]))
        .when(F.col("object_type") == "project", _score(five))
        .otherwise(other)
    )


def product_completeness() -> Column:
    texts = [has_text(c) for c in ("product_name", "product_key", "product_type", "owner_login")]
    return _score([*texts, F.col("created_at").isNotNull(), F.col("updated_at").isNotNull()])


def _owned_by(df: DataFrame, owner: str | None) -> DataFrame:
    return df.filter(F.lower(F.coalesce("owner_login", F.lit(""))) == owner.lower()) if owner else df


def _metadata_summary(rows: DataFrame, kind: str, score: Column) -> DataFrame:
    """Average score and status counts per type, plus one ``label IS NULL`` total row."""
    scored = rows.select(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("Unknown")).alias("label"), F.round(score, 1).alias("_s"))
    status = metadata_status(F.col("_s"))
    by_type = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.sum("_s").alias("_sum"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in ("complete", "partial", "sparse")],
    )
    counts = ["total_assets", "_sum", "complete_count", "partial_count", "sparse_count"]
    overall = by_type.agg(*[F.sum(c).alias(c) for c in counts]).select(F.lit(None).cast("string").alias("label"), *counts)
    average = F.round(F.col("_sum") / F.col("total_assets"), 1)
    return by_type.unionByName(overall).withColumn("avg_score", average).drop("_sum")


def asset_metadata_summary(index: DataFrame, owner: str | None = None) -> DataFrame:
    return _metadata_summary(_owned_by(index, owner), "object_type", asset_completeness("summary"))


def product_metadata_summary(catalog: DataFrame, owner: str | None = None) -> DataFrame:
    return _metadata_summary(_owned_by(catalog, owner), "product_type", product_completeness())


# --- listings -----------------------------------------------------------------------------------------


def _listing_order(sort: str, name: str, score: Column, id_column: str) -> list[Column]:
    updated = F.col("updated_at")
    orders = {
        "updated_desc": [updated.desc_nulls_last()],
        "updated_asc": [updated.asc_nulls_last()],
        "activity_desc": [F.col("activity_30d").desc_nulls_last(), updated.desc_nulls_last()],
        "completeness_desc": [score.desc(), updated.desc_nulls_last()],
        "completeness_asc": [score.asc(), updated.desc_nulls_last()],
        "name_asc": [F.col(name).asc_nulls_last()],
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}; expected one of {sorted(orders)}")
    return [*orders[sort], F.col(id_column).asc()]


def _listing(rows: DataFrame, score: Column, id_column: str, prefix: str, *, instances, projects, types, owner_is, status, sort, limit, offset) -> DataFrame:
    for column, wanted in (("instance_name", instances), ("project_key", projects), (f"{prefix}_type", types)):
        if wanted:
            rows = rows.filter(F.col(column).isin(list(wanted)))
    rows = _owned_by(rows, owner_is)
    rows = rows.withColumns({"_score": score, "metadata_status": metadata_status(score)})
    if status:
        if status not in ("complete", "partial", "sparse"):
            raise ValueError(f"unknown completeness status {status!r}")
        rows = rows.filter(F.col("metadata_status") == status)
    page = top_n(rows, _listing_order(sort, f"{prefix}_name", F.col("_score"), id_column), limit, offset)
    return page.select(
        id_column, "instance_name", "project_key", f"{prefix}_type", f"{prefix}_key", f"{prefix}_name", f"{prefix}_subtype",
        "owner_login", "updated_at", "activity_30d", F.round("_score", 1).alias("metadata_score"), "metadata_status",
    )


def _like(column: str, text: str) -> Column:
    return F.coalesce(F.lower(F.col(column)).contains(text.lower()), F.lit(False))


def assets(catalog: DataFrame, *, q=None, instances=None, projects=None, types=None, owner=None, owner_is=None, status=None, sort="updated_desc", limit=25, offset=0) -> DataFrame:
    """One page of the asset catalogue."""
    rows = catalog
    if q:
        hit = _like("object_name", q)
        for column in ("object_key", "project_key", "instance_name", "owner_login"):
            hit = hit | _like(column, q)
        rows = rows.filter(hit)
    if owner:
        rows = rows.filter(_like("owner_login", owner))
    return _listing(rows, asset_completeness(), "asset_id", "object", instances=instances, projects=projects, types=types, owner_is=owner_is, status=status, sort=sort, limit=limit, offset=offset)


def products(catalog: DataFrame, *, q=None, instances=None, projects=None, types=None, owner=None, owner_is=None, status=None, sort="updated_desc", limit=25, offset=0) -> DataFrame:
    """One page of the product catalogue."""
    rows = catalog
    if q:
        rows = rows.filter(_like("product_name", q) | _like("product_key", q))
    if owner:
        rows = rows.filter(F.col("owner_login") == owner)
    return _listing(rows, product_completeness(), "product_id", "product", instances=instances, projects=projects, types=types, owner_is=owner_is, status=status, sort=sort, limit=limit, offset=offset)


def _facets(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct values per facet as (facet, value) rows, so that long facets stay distributed."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in columns.items()])
    return rows.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value IS NOT NULL").distinct()


def asset_facets(index: DataFrame, owner: str | None = None) -> DataFrame:
    columns = {"instances": "instance_name", "projects": "project_key", "types": "object_type", "owners": "owner_login"}
    return _facets(_owned_by(index, owner), columns)


def product_facets(catalog: DataFrame, owner: str | None = None) -> DataFrame:
    columns = {"instances": "instance_name", "projects": "project_key", "types": "product_type", "owners": "owner_login"}
    return _facets(_owned_by(catalog, owner), columns)


# --- one object -------------------------------------------------------------------------------------------

# Keys searched for a description, in order.
DESCRIPTION_KEYS = ["description", "desc", "short_description", "shortDescription"]


def description_from_json(extras: Column | str) -> Column:
    """Description text in a JSON object: known keys first, else any key naming a description."""
    payload = F.from_json(as_col(extras), "map<string,string>")
    known = [null_if_blank(payload[k]) for k in DESCRIPTION_KEYS]
    named = F.map_values(F.map_filter(payload, lambda k, v: F.lower(k).contains("description") & (F.trim(v) != "")))
    return F.coalesce(*known, F.trim(F.get(named, 0)))


def _object_events(events: DataFrame, item: DataFrame) -> DataFrame:
    """Events on the object of a one-row frame (any project when it has none)."""
    # ``item`` is limited to one row, so this broadcast has a proven size.
    target = F.broadcast(item.select(F.col("_id"), F.col("_type"), F.col("_key"), null_if_blank("project_key").alias("_project")))
    same = (F.col("object_type") == F.col("_type")) & (F.col("object_key") == F.col("_key"))
    return events.join(target, same & (F.col("_project").isNull() | (F.col("_project") == F.col("project_key"))))


def _one(rows: DataFrame, id_column: str, wanted: str, prefix: str, owner: str | None) -> DataFrame:
    # Where an id repeats, the smallest row stands for it.
    hit = _owned_by(rows, owner).filter(F.col(id_column) == wanted).orderBy("instance_name", "project_key", f"{prefix}_type", f"{prefix}_key").limit(1)
    return hit.withColumns({"_id": F.col(id_column), "_type": F.col(f"{prefix}_type"), "_key": F.col(f"{prefix}_key")})


def _detail(item: DataFrame, events: DataFrame, details: DataFrame | None, keep: list[str]) -> DataFrame:
    usage = _object_events(events, item).groupBy("_id").agg(F.count(F.lit(1)).alias("events_all_time"))
    out = item.join(usage, "_id", "left").withColumn("events_all_time", F.coalesce("events_all_time", F.lit(0)))
    description = F.lit(None).cast("string")
    if details is not None:
        # The item is one row: details are reduced to its own before any JSON is read.
        target = F.broadcast(item.select("_id", "_type", "_key", F.col("instance_name").alias("_i"), F.col("project_key").alias("_p")))
        same = (F.col("_i") == F.col("instance_name")) & F.col("_p").eqNullSafe(F.col("project_key"))
        own = details.join(target, same & (F.col("object_type") == F.col("_type")) & (F.col("object_key") == F.col("_key")))
        out = out.join(own.select("_id", description_from_json("extras").alias("_d")), "_id", "left")
        description = F.col("_d")
    return out.select(*keep, "events_all_time", description.alias("description")).limit(1)


def _related(item: DataFrame, events: DataFrame) -> DataFrame:
    hits = _object_events(events.select("object_type", "object_key", "project_key", "instance_name"), item)
    return hits.groupBy("instance_name", "project_key").agg(F.count(F.lit(1)).alias("event_count"))


def asset_detail(catalog: DataFrame, events: DataFrame, asset_id: str, details: DataFrame | None = None, owner: str | None = None) -> DataFrame:
    """One asset with its usage count and description.

    ``details`` holds (instance_name, project_key, object_type, object_key, extras).
    """
    keep = ["asset_id", "instance_name", "project_key", "object_type", "object_key", "object_name", "owner_login", "updated_at"]
    return _detail(_one(catalog, "asset_id", asset_id, "object", owner), events, details, keep)


def asset_related(catalog: DataFrame, events: DataFrame, asset_id: str, owner: str | None = None) -> DataFrame:
    """Where the object was used: events per (instance, project)."""
    return _related(_one(catalog, "asset_id", asset_id, "object", owner), events)


def product_info(catalog: DataFrame, events: DataFrame, product_id: str, details: DataFrame | None = None, owner: str | None = None) -> DataFrame:
    """One product with its usage count and description."""
    keep = ["product_id", "instance_name", "project_key", "product_type", "product_key", "product_name", "owner_login", "updated_at", "activity_30d"]
    return _detail(_one(catalog, "product_id", product_id, "product", owner), events, details, keep)


def product_related(catalog: DataFrame, events: DataFrame, product_id: str, owner: str | None = None) -> DataFrame:
    return _related(_one(catalog, "product_id", product_id, "product", owner), events)


# --- product overview ---------------------------------------------------------------------------------------


def _count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("value"))


def _top(counts: DataFrame, n: int) -> DataFrame:
    return top_n(counts, [F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last()], n)


def products_by_type(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("product_type").agg(F.count(F.lit(1)).alias("product_count"))


def products_by_project(catalog: DataFrame) -> DataFrame:
    return _count_by(catalog, "project_key")


def products_by_instance(catalog: DataFrame, product_type: str | None = None) -> DataFrame:
    return _count_by(catalog.filter(F.col("product_type") == product_type) if product_type else catalog, "instance_name")


def products_over_time(catalog: DataFrame, months: int = 12) -> DataFrame:
    """Products per creation month, newest months only, oldest first."""
    counts = catalog.groupBy(F.trunc("created_at", "month").alias("month")).agg(F.count(F.lit(1)).alias("value"))
    return top_n(counts, [F.col("month").desc_nulls_last()], months).orderBy(F.col("month").asc_nulls_first())


def type_top_owners(catalog: DataFrame, product_type: str, limit: int = 20) -> DataFrame:
    return _top(_count_by(catalog.filter(F.col("product_type") == product_type), "owner_login"), limit)


def type_kpis(catalog: DataFrame, events: DataFrame, product_type: str, as_of, days: int = 30, owner: str | None = None) -> DataFrame:
    """Product count, active products, events and users of one type, in one row."""
    mine = _owned_by(catalog.filter(F.col("product_type") == product_type), owner)
    kpis = mine.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("activity_30d") > 0).alias("active_products_30d"),
        F.coalesce(F.sum("activity_30d"), F.lit(0)).alias("events_30d"),
        F.max("last_activity_at").alias("last_activity_at"),
    )
    recent = _type_events(events, product_type, as_of, days)
    totals = recent.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("login").alias("active_users_30d"))


    return merge_single_rows(kpis, totals)


def _type_events(events: DataFrame, product_type: str, as_of, days: int) -> DataFrame:
    return events.filter(since_days("timestamp", as_of, days) & (F.col("object_type") == product_type))


def type_metrics(catalog: DataFrame, events: DataFrame, product_type: str, as_of, days: int = 30, owner: str | None = None, limit: int = 12) -> DataFrame:
    """All charts of one product type as (chart, label, value) rows."""
    mine = _owned_by(catalog.filter(F.col("product_type") == product_type), owner)
    recent = _type_events(events, product_type, as_of, days)
    by_events = mine.select(F.col("product_name").alias("label"), F.col("activity_30d").alias("value"), "product_id")
    order = [F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last(), F.col("product_id").asc()]
    charts = {
        "owners": _top(_count_by(mine, "owner_login"), limit),
        "products": top_n(by_events, order, limit).select("label", "value"),
        "daily": recent.groupBy(F.to_date("timestamp").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value")),
        "projects": _top(_count_by(recent, "project_key"), limit),
        "instances": _top(_count_by(recent, "instance_name"), limit),
    }
    out = None
    for name, frame in charts.items():
        part = frame.select(F.lit(name).alias("chart"), "label", "value")
        out = part if out is None else out.unionByName(part)
    return out
