"""From raw audit lines and payloads to the normalised layer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.casts import cast_boolean, cast_datetime, cast_epoch_strict, cast_numeric, cast_string, epoch_divisor, epoch_in_unit
from fleetlens.functions.text import PLACEHOLDER, as_col, sanitize_name, strip_all
from fleetlens.plans import contracts

DROP_CATEGORY, DEFAULT_CATEGORY = "DROP_DELETE", "unclassified"
GENERIC_TOPIC = "generic"


# --- audit lines -----------------------------------------------------------------------


def prepare_audit(df: DataFrame, instance: str | Column) -> DataFrame:
    """Generic audit rows with ``message`` flattened to ``message_*`` and the event date."""
    rows = df.filter(F.col("topic") == GENERIC_TOPIC) if "topic" in df.columns else df
    fields = df.schema["message"].dataType.names if "message" in df.columns else []
    flat = [F.col(f"message.{f}").alias(f"message_{f}") for f in fields]
    kept = [c for c in df.columns if c not in ("message", "mdc", "instance_name")]
    name = F.lit(instance) if isinstance(instance, str) else instance
    return rows.select(*kept, *flat, F.to_date("timestamp").alias("date"), name.alias("instance_name"))


def authvia_source(authvia: Column | str) -> tuple[Column, Column]:
    """(project key, web app id) named by the call chain; the first matching marker wins."""
    text = as_col(authvia)
    web = "ticket:Standard webapp backend:"
    rest = F.regexp_replace(text, f"{web} ", "")
    has_dot = rest.contains(".")
    project = F.when(text.contains("scenario="), F.regexp_extract(text, r"scenario=([^ .]*)", 1))
    webapp = F.lit(None).cast("string")
    for marker in ("ticket:python_trigger:", web, "ticket:jupyter:", "ticket:job:"):
        if marker == web:
            project = project.when(text.contains(web), F.when(has_dot, F.substring_index(rest, ".", 1)))
            remainder = F.regexp_extract(rest, r"^[^.]*\.([^,]*)", 1)
            earlier = text.contains("scenario=") | text.contains("ticket:python_trigger:")
            webapp = F.when(text.contains(web) & ~earlier & has_dot, remainder)
        else:
            project = project.when(text.contains(marker), F.substring_index(F.regexp_replace(text, marker, ""), ".", 1))
    clean = lambda c: F.nullif(F.regexp_replace(strip_all(c), PLACEHOLDER, ""), F.lit(""))
    return clean(project), clean(webapp)


def authvia_text(df: DataFrame, column: str = "authvia") -> Column:
    """The call chain as text: lists joined with a comma, missing as empty text."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        value = F.array_join(value.cast("array<string>"), ", ")
    return F.coalesce(value.cast("string"), F.lit(""))


def map_events(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the category of each message type and infer project and web app from the call chain.

    The mapping join carries no hint: Catalyst broadcasts it when its size allows.
    """
    rows = df.filter(F.col("topic") == GENERIC_TOPIC) if "topic" in df.columns else df
    rows = rows.filter(F.length(strip_all("message_msgType")) > 0)
    extra = [c for c in mapping.columns if c == "message_msgType" or c not in df.columns]
    joined = rows.join(mapping.select(*extra), "message_msgType", "left")
    joined = joined.filter(~F.col("activity_category").eqNullSafe(F.lit(DROP_CATEGORY)))
    names: dict[str, str] = {}
    for column in joined.columns:
        names.setdefault(column.lower().replace("message_", ""), column)
    out = joined.select(*[F.col(src).alias(name) for name, src in names.items()])
    out = out.withColumn("activity_category", F.coalesce(F.lower("activity_category"), F.lit(DEFAULT_CATEGORY)))
    if "authvia" not in out.columns:
        return out
    out = out.withColumn("authvia", authvia_text(out))
    project, webapp = authvia_source("authvia")
    for name, found in (("project_key_source_call", project), ("webappid_source_call", webapp)):
        out = out.withColumn(name, F.coalesce(F.col(name), found) if name in out.columns else found)
    return out


def webapp_ids(extras: Column | str) -> tuple[Column, Column]:
    """(project key, web app id) in JSON extras, looking one level into JSON-in-JSON."""
    outer = as_col(extras)
    inner = F.get_json_object(outer, "$.extras")

    def pick(key: str) -> Column:
        value = F.coalesce(F.get_json_object(outer, f"$.{key}"), F.get_json_object(inner, f"$.{key}"))
        return F.nullif(F.regexp_replace(strip_all(value), PLACEHOLDER, ""), F.lit(""))

    return pick("projectkey"), pick("webappid")


# --- shaping ------------------------------------------------------------------------------


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def canonical_project_key(df: DataFrame) -> DataFrame:
    """Rename the project key variant that is present to ``project_key``."""
    if "project_key" in df.columns:
        return df
    if "projectkey" in df.columns:
        return df.withColumnRenamed("projectkey", "project_key")
    variants = [c for c in df.columns if c.endswith("_projectkey")]
    if not variants:
        return df
    chosen = "project_projectkey" if "project_projectkey" in variants else variants[0]
    return df.withColumnRenamed(chosen, "project_key")


def pack_extras(df: DataFrame, columns: list[str]) -> Column:
    """Non-null values of ``columns`` as a JSON object, null when there is none."""
    if not columns:
        return F.lit(None).cast("string")
    # to_json leaves null fields out.
    return F.nullif(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), F.lit("{}"))


def extras_to_json(value: Column | str) -> Column:
    """Keep JSON text as it is; wrap other text as ``{"_value": text}``; blank becomes null."""
    text = F.nullif(strip_all(value), F.lit(""))
    wrapped = F.to_json(F.struct(text.alias("_value")))
    return F.when(text.isNotNull(), F.when(F.try_parse_json(text).isNotNull(), text).otherwise(wrapped))


def typed(name: str, dtype: str, column: Column | None = None) -> Column:
    """Column cast by its name, as in the contract lists."""
    value = F.col(f"`{name}`") if column is None else column
    if name == "run_ts" or name in contracts.DATETIME_COLUMNS:
        return cast_datetime(value, dtype).alias(name)
    if name in contracts.NUMERIC_COLUMNS:
        return cast_numeric(value).alias(name)
    if name in contracts.BOOLEAN_COLUMNS:
        return cast_boolean(value).alias(name)
    return cast_string(value, upper=name in contracts.UPPER_COLUMNS).alias(name)


def normalize_silver(df: DataFrame, required: list[str], *, instance: str | Column | None = None, run_ts: str | Column | None = None) -> DataFrame:
    """Contract columns typed by name, everything else packed into ``extras``.

    Missing contract columns are null. One projection, no shuffle.
    """
    out = canonical_project_key(sanitize_columns(df))
    for name, value in (("instance_name", instance), ("run_ts", run_ts)):
        if value is not None:
            out = out.withColumn(name, F.lit(value) if isinstance(value, str) else value)
    contract = [c for c in required if c not in ("instance_name", "run_ts", "extras")]
    dtypes = dict(out.dtypes)
    rest = [c for c in out.columns if c not in {*contract, "instance_name", "run_ts"}]
    packed = pack_extras(out, rest)

    def column(name: str) -> Column:
        if name in dtypes:
            return typed(name, dtypes[name])
        return typed(name, "string", F.lit(None).cast("string"))

    return out.select(*[column(c) for c in ("instance_name", *contract, "run_ts")], packed.alias("extras"))


def normalize_module(
    df: DataFrame,
    category: str,
    module: str,
    registry: contracts.Contracts,
    *,
    base: tuple[str, str] | None = None,
    variant: str | None = None,
    instance: str | Column | None = None,
    run_ts: str | Column | None = None,
) -> DataFrame:
    """:func:`normalize_silver` with the contract of (category, module); without one everything goes to extras."""
    required = registry.required(category, module, base=base, variant=variant)
    return normalize_silver(df, required or [], instance=instance, run_ts=run_ts)


def cast_datetime_columns(df: DataFrame, columns: Sequence[str], groups: Sequence[str], *, mixed: bool = False) -> DataFrame:
    """UTC timestamps floored to the second, with one epoch unit per column and group of rows.

    ``groups`` names what was delivered together, such as instance and file. Two passes:
    counts per group give the unit of each column (by its median, :func:`epoch_divisor`),
    and the rows are cast with it. A text column where any text of the group reads as a
    timestamp has no epochs: its digits give null, or with ``mixed`` a timestamp by their
    length. With ``mixed`` and no readable text, every all-digit text goes by its length,
    and a length that is not known gives null. Values outside the clock's range, junk and
    null give null; columns that ``df`` lacks are passed over; a group may hold any share
    of the rows, as only its counts are aggregated. :func:`cast_datetime` decides per row.
    """
    dtypes = dict(df.dtypes)
    present = [c for c in columns if c in dtypes]
    clock = {c for c in present if dtypes[c] in ("timestamp", "timestamp_ntz", "date")}
    loose = [c for c in present if c not in clock]
    if not loose:
        return df.withColumns({c: cast_datetime(f"`{c}`", dtypes[c]) for c in present}) if present else df
    is_text = {c: dtypes[c] == "string" for c in loose}
    column = lambda c: F.col(f"`{c}`")
    number = {c: cast_numeric(column(c)) if is_text[c] else column(c).cast("double") for c in loose}
    digits = {c: strip_all(column(c)).rlike(r"^[+-]?\d+$") if is_text[c] else F.lit(False) for c in loose}
    read = {c: F.when(~digits[c], F.date_trunc("second", strip_all(column(c)).try_cast("timestamp"))) if is_text[c] else F.lit(None).cast("timestamp") for c in loose}
    aside = {c: f"_unit_{i}_{len(df.columns)}" for i, c in enumerate(loose)}
    units = df.groupBy(*[column(g).alias(f"_group_{i}") for i, g in enumerate(groups)]).agg(
        *[F.struct(epoch_divisor(number[c]).alias("divisor"), (F.count(read[c]) > 0).alias("readable")).alias(aside[c]) for c in loose]
    )
    same = [column(g).eqNullSafe(F.col(f"_group_{i}")) for i, g in enumerate(groups)]
    joined = df.join(units, reduce(and_, same), "left")
    out = {}
    for c in loose:
        readable, divisor = F.col(f"{aside[c]}.readable"), F.col(f"{aside[c]}.divisor")
        whole = strip_all(column(c)).try_cast("long") if is_text[c] else column(c).cast("long") if dtypes[c] in ("tinyint", "smallint", "int", "bigint") else F.lit(None).cast("long")
        by_unit = epoch_in_unit(number[c], whole, divisor)
        by_length = F.when(digits[c], cast_epoch_strict(column(c), on_error="null"))
        if not is_text[c]:
            out[c] = by_unit
        elif mixed:
            out[c] = F.coalesce(read[c], by_length, F.when(~readable & ~digits[c], by_unit))
        else:
            out[c] = F.coalesce(read[c], F.when(~readable, by_unit))
    return joined.withColumns(out | {c: cast_datetime(f"`{c}`", dtypes[c]) for c in clock}).select(*[column(c) for c in df.columns])


def dq_check(df: DataFrame, keys: list[str] | None = None, required: tuple[str, ...] = ("instance_name", "run_ts")) -> DataFrame:
    """Row count, nulls in required columns and unreadable extras, per partition key.

    ``errors`` lists what is wrong and ``ok`` is true when nothing is. Every row is checked.
    """
    lowered = [c.lower() for c in df.columns]
    static = ["duplicate_columns"] if len(set(lowered)) < len(lowered) else []
    static += ["empty_column_name"] if "" in lowered else []
    static += [f"missing_column:{c}" for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    measures = [F.count(F.lit(1)).alias("row_count")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in present]
    bad = F.lit(False)
    if "extras" in df.columns:
        bad = F.col("extras").isNotNull() & F.try_parse_json("extras").isNull()
    measures.append(F.count_if(bad).alias("extras_not_json"))
    report = df.groupBy(*(keys or [])).agg(*measures)
    problems = [F.when(F.col("row_count") == 0, F.lit("empty_dataframe"))]
    problems += [F.when(F.col(f"nulls_{c}") > 0, F.concat(F.lit(f"nulls_in:{c}:"), F.col(f"nulls_{c}").cast("string"))) for c in present]
    problems.append(F.when(F.col("extras_not_json") > 0, F.concat(F.lit("extras_not_json:"), F.col("extras_not_json").cast("string"))))
    errors = F.array_compact(F.array(*[F.lit(e) for e in static], *problems))
    return report.withColumn("errors", F.array_join(errors, ";")).withColumn("ok", F.col("errors") == "")


def flatten_payload(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows of a payload: list of objects, or objects by name (the key fills ``name``)."""
    kind = df.schema[column].dataType
    others = [c for c in df.columns if c != column]
    if isinstance(kind, T.MapType):
        rows = df.select(*others, F.explode(column).alias("_name", "_v"))
        fields = kind.valueType.names
        name = F.coalesce(F.col("_v.name"), F.col("_name")) if "name" in fields else F.col("_name")
        picked = [F.col(f"_v.`{f}`").alias(f"{prefix}{f}") for f in fields if f != "name"]
        return rows.select(*others, name.alias(f"{prefix}name"), *picked)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        rows = df.select(*others, F.explode(column).alias("_v"))
        return rows.select(*others, *[F.col(f"_v.`{f}`").alias(f"{prefix}{f}") for f in kind.elementType.names])
    return df.withColumnRenamed(column, prefix.rstrip("_"))


def apply_rule(df: DataFrame, *, drop: list[str] = (), rename: dict[str, str] | None = None, fillna: dict | None = None, cast: dict[str, str] | None = None) -> DataFrame:
    """Declarative clean-up; failed casts become null."""
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    fill = {c: v for c, v in (fillna or {}).items() if c in out.columns}
    out = out.fillna(fill) if fill else out
    kinds = {"Int64": "long", "float64": "double"}
    casts = {c: F.col(c).try_cast(kinds.get(t, t)) for c, t in (cast or {}).items() if c in out.columns}
    return out.withColumns(casts) if casts else out


def enrich_users(users: DataFrame, activity: DataFrame | None = None, commits: DataFrame | None = None) -> DataFrame:
    """Accounts with their activity columns and first and last commit time."""
    out = users
    if activity is not None:
        out = out.join(activity, "login", "left")
    if commits is not None:
        # Reduced to one row per author before the join.
        spans = commits.filter(F.col("author").isNotNull()).groupBy(F.col("author").alias("login")).agg(
            F.timestamp_millis(F.min("timestamp")).alias("first_commit_date"), F.timestamp_millis(F.max("timestamp")).alias("last_commit_date")
        )
        out = out.join(spans, "login", "left")
    return out


# --- historic exports ------------------------------------------------------------------------

# Canonical column -> name inside message or clientEvent.
HISTORY_FIELDS = {
    "message_msgType": "msgType",
    "message_msgTypeBase": "msgTypeBase",
    "message_authSource": "authSource",
    "message_authUser": "authUser",
    "message_projectKey": "projectKey",
}


def _nonblank(column: str) -> Column:
    value = F.col(f"`{column}`")
    return F.when(F.length(strip_all(value)) > 0, value.cast("string"))


def normalize_history(df: DataFrame) -> DataFrame:
    """Historic export rows in the shape of live audit rows; blank text counts as missing."""
    out = df
    for struct in ("message", "clientEvent"):
        if struct in df.columns and isinstance(df.schema[struct].dataType, T.StructType):
            for f in df.schema[struct].dataType.names:
                name = f"{struct}_{f}"
                flat = F.col(f"{struct}.`{f}`").cast("string")
                out = out.withColumn(name, F.coalesce(_nonblank(name), flat) if name in out.columns else flat)

    def fill(target: str, sources: list[str]) -> None:
        nonlocal out
        present = [_nonblank(c) for c in dict.fromkeys([target, *sources]) if c in out.columns]
        out = out.withColumn(target, F.coalesce(*present) if present else F.lit(None).cast("string"))

    for column in [c for c in out.columns if c.startswith("clientEvent_")]:
        fill(f"message_{column.removeprefix('clientEvent_')}", [column])
    fill("topic", ["clientEvent_auditTopic", "message_auditTopic", "auditTopic"])
    if "serverTimestamp" in out.columns:
        moment = F.col("serverTimestamp")
        out = out.withColumn("timestamp", F.coalesce("timestamp", moment) if "timestamp" in out.columns else moment)
    for target, name in HISTORY_FIELDS.items():
        fill(target, [f"clientEvent_{name}", name, name.lower()])
    return out


# Raw columns dropped after mapping, and columns merged from several sources.
HISTORY_DROPS = ["clientevent", "message", "mdc", "servertimestamp", "origaddress"]
HISTORY_MERGES = {
    "msgtypebase": ["msgtypebase_x", "msgtypebase_y"],
    "msgtype": ["msgtype", "clientevent_msgtype"],
    "audittopic": ["audittopic", "clientevent_audittopic"],
    "authsource": ["authsource", "clientevent_authsource"],
    "authuser": ["authuser", "clientevent_authuser"],
    "project_key": ["project_key", "projectkey", "clientevent_projectkey"],
}


def cleanup_history(df: DataFrame) -> DataFrame:
    """Merge duplicated sources of a column and drop raw remains."""
    merged = {}
    for target, sources in HISTORY_MERGES.items():
        present = [F.col(c) for c in sources if c in df.columns]
        if present:
            merged[target] = F.coalesce(*present)
    out = df.withColumns(merged) if merged else df
    stale = [c for c in out.columns if c.lower() in HISTORY_DROPS or c.lower().startswith("clientevent_")]
    return out.drop(*stale, "msgtypebase_x", "msgtypebase_y")


def filter_event_range(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows of a date range; with year and month partitions the months are pruned first."""
    if start and end and end < start:
        raise ValueError(f"end {end} is before start {start}")
    out = df
    if {"year", "month"} <= set(df.columns):
        index = F.col("year").try_cast("int") * 12 + F.col("month").try_cast("int")
        for day, keep in ((start, lambda m: index >= m), (end, lambda m: index <= m)):
            if day:
                out = out.filter(index.isNull() | keep(day.year * 12 + day.month))
    if start:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("timestamp") < F.lit(end + dt.timedelta(days=1)).cast("timestamp"))
    return out


# --- replay and extras -------------------------------------------------------------------------


JSON_OBJECT = "map<string,variant>"


def split_readable(df: DataFrame, column: str = "extras") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text is an object or missing, and rows where it is anything else."""
    parsed = F.from_json(column, JSON_OBJECT)
    readable = F.col(column).isNull() | (F.try_parse_json(column).isNotNull() & parsed.isNotNull())
    flagged = df.withColumn("_readable", readable)
    return flagged.filter("_readable").drop("_readable"), flagged.filter("NOT _readable").drop("_readable")


def _merged_objects(first: Column, second: Column) -> Column:
    """JSON text of two objects together, null when both are empty; keys are distinct."""
    none = F.from_json(F.lit("{}"), JSON_OBJECT)
    both = F.map_concat(F.coalesce(first, none), F.coalesce(second, none))
    return F.when(F.size(both) > 0, F.to_json(both))


def replay_event_mapping(silver: DataFrame, mapping: DataFrame, extras_keys: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classify stored rows again: unpack extras (columns win), map, normalise, re-route.

    Returns the rows, with ``module`` (the new category) for a partitioned write, and the
    stored rows whose extras cannot be read. Every key that is not lifted stays in extras
    with its JSON type.
    """
    readable, rejected = split_readable(silver)
    lifted = [k for k in extras_keys if k not in silver.columns]
    rows = readable.withColumn("_extras", F.from_json("extras", JSON_OBJECT))
    rows = rows.withColumns({k: F.try_element_at("_extras", F.lit(k)).cast("string") for k in lifted})
    known = F.array(*[F.lit(k) for k in sorted({*lifted, *silver.columns})])
    left_over = F.map_filter("_extras", lambda k, v: ~F.array_contains(known, k))
    rows = rows.withColumns({"message_msgType": F.col("msgtype"), "x_rest": F.to_json(left_over)})
    mapped = map_events(rows.drop("msgtype", "msgtypebase", "activity_category", "extras", "_extras"), mapping)
    out = normalize_silver(mapped, [*required, "x_rest"])
    packed, rest = F.from_json("extras", JSON_OBJECT), F.from_json("x_rest", JSON_OBJECT)
    only_rest = F.map_filter(rest, lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(packed), F.array().cast("array<string>")), k))
    out = out.withColumn("extras", _merged_objects(packed, only_rest)).drop("x_rest")
    return out.withColumn("module", F.lower("activity_category")), rejected


def merge_extras_checked(df: DataFrame, keys: list[str], partition: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Lift extras into null or missing columns; what disagrees comes second.

    A row is in conflict when extras cannot be read, hold a key named ``extras``, or hold another
    value than a populated column. With ``partition`` columns, every row of a partition that
    has a conflict is rejected, so a partition is merged whole or not at all. Keys that are
    not lifted stay in extras with their JSON type.
    """
    readable = F.col("extras").isNull() | (F.try_parse_json("extras").isNotNull() & F.from_json("extras", JSON_OBJECT).isNotNull())
    rows = df.withColumns({"_readable": readable, "_x": F.from_json("extras", JSON_OBJECT)})
    dtypes = dict(df.dtypes)
    conflict = ~F.col("_readable") | F.array_contains(F.coalesce(F.map_keys("_x"), F.array().cast("array<string>")), "extras")
    merged = {}
    for k in keys:
        value = F.try_element_at("_x", F.lit(k)).cast("string")
        if k in dtypes:
            conflict = conflict | F.coalesce(F.col(k).cast("string") != value, F.lit(False))
            value = F.coalesce(F.col(k), value.try_cast(dtypes[k]))
        merged[k] = value
    rest = F.map_filter("_x", lambda k, v: ~F.array_contains(F.array(*[F.lit(k) for k in keys]), k))
    merged["extras"] = F.when(F.size(rest) > 0, F.to_json(rest))
    flagged = rows.withColumn("_conflict", conflict)
    if partition:
        # One flag per partition; the flags are few, the rows are not moved by a window.
        bad = flagged.groupBy(*partition).agg(F.max("_conflict").alias("_any"))
        bad = bad.select(*[F.col(c).alias(f"_p_{c}") for c in partition], "_any")
        same = [flagged[c].eqNullSafe(bad[f"_p_{c}"]) for c in partition]
        joined = flagged.join(bad, reduce(lambda x, y: x & y, same))
        flagged = joined.withColumn("_conflict", F.col("_any")).drop("_any", *[f"_p_{c}" for c in partition])
    good = flagged.filter(~F.col("_conflict")).withColumns(merged).drop("_x", "_conflict", "_readable")
    return good, flagged.filter("_conflict").drop("_x", "_conflict", "_readable")


def assert_casts_survived(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per typed column, how many populated inputs its cast would lose; one pass."""
    lost = {c: F.count_if((F.length(strip_all(c)) > 0) & typed(c, dict(df.dtypes)[c]).isNull()) for c in columns}
    row = df.agg(*[v.alias(c) for c, v in lost.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("lost_rows")) for c in columns])
    return row.select(F.explode(pairs).alias("p")).select("p.*").withColumn("ok", F.col("lost_rows") == 0)
