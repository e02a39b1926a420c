"""Nested JSON payloads to flat rows: licensing status, limits, add-ons, check reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rollup import latest
from fleetlens.functions.text import strip_all

_BASE = "$.base"
_CONTENT = "$.base.licenseContent"
# Flat column -> path in the payload.
STATUS_PATHS = {
    "instance_id": f"{_CONTENT}.instanceId",
    "license_kind": f"{_CONTENT}.licenseKind",
    "license_id": f"{_CONTENT}.licenseId",
    "has_license": f"{_BASE}.hasLicense",
    "valid": f"{_BASE}.valid",
    "expired": f"{_BASE}.expired",
    "community": f"{_BASE}.community",
    "fallback_profile": f"{_BASE}.fallbackProfile",
    "expires_on": f"{_BASE}.expiresOn",
    "licensee_company": f"{_CONTENT}.licensee.company",
    "licensee_name": f"{_CONTENT}.licensee.name",
    "standard_offer": f"{_CONTENT}.properties.standardOffer",
    "emitted_by": f"{_CONTENT}.properties.emittedBy",
    "emitted_on": f"{_CONTENT}.properties.emittedOn",
}
# Limit keys whose profile is not simply the upper-cased words.
CAMEL_PROFILES = {
    "FULL_DESIGNERS": "FULL_DESIGNER",
    "ADVANCED_ANALYTICS_DESIGNERS": "ADVANCED_ANALYTICS_DESIGNER",
    "DATA_DESIGNERS": "DATA_DESIGNER",
    "GOVERNANCE_MANAGERS": "GOVERNANCE_MANAGER",
    "READERS": "READER",
    "TECHNICAL_ACCOUNTS": "TECHNICAL_ACCOUNT",
}


def license_status(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Licensing status payload as flat columns next to the other columns."""
    others = [c for c in df.columns if c != payload]
    return df.select(*others, *[F.get_json_object(payload, path).alias(name) for name, path in STATUS_PATHS.items()])


def _int(value: Column) -> Column:
    """Whole number in text; "unlimited" and anything unreadable become null."""
    return value.cast("string").try_cast("long")


def _camel_profile(key: Column) -> Column:
    words = F.ltrim(F.regexp_replace(F.regexp_replace(key, "^max", ""), "([A-Z])", " $1"))
    name = F.upper(F.regexp_replace(words, " ", "_"))
    known = F.create_map(*[F.lit(v) for pair in CAMEL_PROFILES.items() for v in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def license_limits(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(profile, limit) rows of each payload; the first mention of a profile wins.

    Profile limits are used when present, else the two spellings of limit properties;
    sub-licence limits follow with their own prefix.
    """
    others = [c for c in df.columns if c != payload]
    limit_type = "map<string,struct<profile:string,licensed:struct<profile:string,licensedLimit:string>>>"
    props = F.from_json(F.get_json_object(payload, f"{_CONTENT}.properties"), "map<string,string>")
    parsed = df.select(
        *others,
        F.from_json(F.get_json_object(payload, f"{_BASE}.profileLimits"), limit_type).alias("_limits"),
        props.alias("_props"),
        F.from_json(F.get_json_object(payload, f"{_BASE}.sublicense.profileLimits"), "map<string,string>").alias("_sub"),
    )

    def rows(column: str, order: int, where: Column | None = None) -> DataFrame:
        source = parsed if where is None else parsed.filter(where)
        return source.select(*others, F.lit(order).alias("_order"), F.posexplode(column).alias("_pos", "_k", "_v"))

    has_limits = F.coalesce(F.size("_limits") > 0, F.lit(False))
    main = rows("_limits", 0, has_limits).select(
        *others, "_order", "_pos",
        F.coalesce("_v.licensed.profile", "_v.profile", "_k").alias("license_profile"), _int(F.col("_v.licensed.licensedLimit")).alias("max_licenses"),
    )
    flat = rows("_props", 1, ~has_limits)
    dotted = F.col("_k").startswith("users.profiles.") & F.col("_k").endswith(".max")
    profile = F.when(F.col("_k").startswith("max"), _camel_profile(F.col("_k"))).when(
        dotted, F.regexp_replace(F.regexp_replace("_k", r"^users\.profiles\.", ""), r"\.max$", "")
    )
    order = F.when(dotted, 2).otherwise(1)
    props_rows = flat.select(*others, order.alias("_order"), "_pos", profile.alias("license_profile"), _int(F.col("_v")).alias("max_licenses"))
    sub = rows("_sub", 3).select(
        *others, "_order", "_pos", F.concat(F.lit("SUBLICENSE_"), strip_all("_k")).alias("license_profile"), _int(F.col("_v")).alias("max_licenses")
    )
    every = main.unionByName(props_rows).unionByName(sub).withColumn("license_profile", strip_all("license_profile"))
    every = every.filter(F.length("license_profile") > 0)
    return latest(every, [*others, "license_profile"], [F.col("_order").asc(), F.col("_pos").asc()]).drop("_order", "_pos")


def license_addons(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(add-on key, enabled) rows of each payload."""
    others = [c for c in df.columns if c != payload]
    props = F.from_json(F.get_json_object(payload, f"{_CONTENT}.properties"), "map<string,string>")
    rows = df.select(*others, F.explode(F.map_filter(props, lambda k, v: k.startswith("addons."))).alias("_k", "_v"))
    text = F.lower(strip_all("_v"))
    enabled = F.when(text.isin("true", "1", "yes", "y"), F.lit(True)).when(text.isin("false", "0", "no", "n"), F.lit(False))
    return rows.select(*others, F.regexp_replace("_k", r"^addons\.", "").alias("addon_key"), enabled.alias("addon_enabled"))


_CHECK_TYPE = (
    "map<string,struct<check:struct<id:string,checkId:string,name:string,label:string,description:string,"
    "shortDescription:string,tags:array<string>,categories:array<string>>,result:map<string,variant>,"
    "expandedCheckParams:string,durationMs:double>>"
)


def _text(*values: Column | str) -> Column:
    return F.coalesce(*[F.nullif(strip_all(v), F.lit("")) for v in values])


def standards_checks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per check of each report."""
    others = [c for c in df.columns if c != payload]
    checks = F.from_json(F.get_json_object(payload, "$.bundleChecksRunInfo"), _CHECK_TYPE)
    rows = df.select(*others, F.explode(checks).alias("_id", "_e"))
    result = F.col("_e.result")
    text_of = lambda key: F.try_element_at(result, F.lit(key)).cast("string")
    # Types are kept; nulls, blank text and empty lists or objects say nothing and go.
    says = lambda v: F.coalesce(~v.cast("string").isin("", "[]", "{}"), F.lit(False))
    details = F.map_filter(result, lambda k, v: ~k.isin("status", "severity", "message") & says(v))
    stable = _text("_id", "_e.check.id", "_e.check.checkId", F.lit("unknown_check"))
    return rows.select(
        *others,
        stable.alias("check_id"),
        F.coalesce(_text("_e.check.name", "_e.check.label"), stable).alias("name"),
        F.coalesce(_text("_e.check.description", "_e.check.shortDescription"), F.lit("")).alias("description"),
        F.array_join(F.coalesce("_e.check.tags", "_e.check.categories"), ",").alias("tags"),
        text_of("severity").try_cast("double").alias("severity"),
        F.coalesce(strip_all(text_of("status")), F.lit("")).alias("status"),
        F.coalesce(strip_all(text_of("message")), F.lit("")).alias("message"),
        F.when(F.size(details) > 0, F.to_json(details)).alias("details"),
        F.col("_e.expandedCheckParams").alias("parameters"),
        F.col("_e.durationMs").alias("duration_ms"),
    )


