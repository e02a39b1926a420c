"""Product consumption: match events to the catalogue, then roll up.

A single product, login or day may hold a large share of all events. Every rollup
therefore starts from :func:`consumption_grain`, which counts events per (object,
login, day) map-side; the later aggregations run on those counts, matching on one row per object. Only
:func:`match_products` on raw events keeps one row per event, and it can split its hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.calendar import positive, since_days
from fleetlens.functions.rollup import merge_single_rows, top_n
from fleetlens.functions.text import as_col, has_text, login_norm, null_if_blank
from fleetlens.plans.dims import CONSUMPTION_TYPES, literal_table

OBJECT_KEYS = ["instance_name", "project_key", "object_type", "object_key"]
REPEAT_EVENTS, SHARED_USERS = 5, 2  # fixed values: repeat use and collaboration start here
HOT_KEYS, HOT_ROWS, SPREAD = 1_000, 10_000, 1_000  # keys that may be split, events that make one hot, places for rows without a lookup


# --- matching -------------------------------------------------------------------------


def eligible_events(
    events: DataFrame,
    as_of,
    days: int = 30,
    *,
    types: Sequence[str] | None = None,
    instances: Sequence[str] | None = None,
    projects: Sequence[str] | None = None,
) -> DataFrame:
    """Recent events on supported product types that carry an object key."""
    rows = events.filter(
        since_days("timestamp", as_of, positive(days, "days"))
        & F.col("object_type").isin(list(types or CONSUMPTION_TYPES))
        & has_text("object_key")
    )
    if instances:
        rows = rows.filter(F.col("instance_name").isin(list(instances)))
    if projects:
        rows = rows.filter(F.col("project_key").isin(list(projects)))
    return rows


def consumption_grain(events: DataFrame) -> DataFrame:
    """Event counts per (object, login, day)."""
    return events.groupBy(*OBJECT_KEYS, "login", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


def object_counts(events: DataFrame) -> DataFrame:
    """Event counts per object: all that matching needs to know, and few rows beside the grain."""
    return events.groupBy(*OBJECT_KEYS).agg(F.count(F.lit(1)).alias("events"))


def _project_norm(column: str = "project_key") -> Column:
    return F.lower(null_if_blank(column))


def _catalog_keys(catalog: DataFrame, types: Sequence[str] | None) -> DataFrame:
    rows = catalog.filter(F.col("product_type").isin(list(types or CONSUMPTION_TYPES)) & has_text("product_key"))
    return rows.select(
        login_norm("instance_name").alias("_i"),
        login_norm("product_type").alias("_t"),
        login_norm("product_key").alias("_k"),
        _project_norm().alias("_p"),
        "product_id",
        "product_name",
        "owner_login",
    )


def _hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The keys with the most rows: any other key holds less than a thousandth of all rows.

    At most ``HOT_KEYS`` rows of a few strings, so the table may be broadcast at any scale.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows)
    return counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("_hot"))


def match_products(
    events: DataFrame, catalog: DataFrame, *, types: Sequence[str] | None = None, salts: int = 8, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Tag each row with its product: exact identity, else a unique key without the project.

    Adds ``product_id``, ``match_type`` (exact, fallback, unmatched) and the product's
    name and owner. The first join looks the full identity up, one catalogue row per
    identity; the second looks what is left up in one row per key, and has a product
    only where the key names a single one. No cell grows with the projects of a key. With
    ``salts`` above 1 the events are counted per key first, and the catalogue rows of keys
    with ``hot_rows`` events or more are copied once per salt; events are never copied.
    Rows that no lookup can match (a null key, a product found before) are spread, so
    they do not meet in one task. Of catalogue rows with one identity the smallest
    product_id counts, so the number of events stays.
    """
    keys = ["_i", "_t", "_k"]
    project_key = lambda column: F.coalesce(F.concat(F.lit("p:"), column), F.lit("none"))
    known = _catalog_keys(catalog, types).withColumn("_pk", project_key(F.col("_p")))
    exact = known.groupBy(*keys, "_pk").agg(F.min(F.struct("product_id", "product_name", "owner_login")).alias("_exact"))
    loose = known.groupBy(*keys).agg(
        F.min("product_id").alias("product_id"), F.max("product_id").alias("_high"), F.min("product_name").alias("product_name"), F.min("owner_login").alias("owner_login")
    )
    loose = loose.filter(F.col("product_id") == F.col("_high")).select(*keys, F.struct("product_id", "product_name", "owner_login").alias("_fallback"))
    rows = events.withColumns({"_i": login_norm("instance_name"), "_t": login_norm("object_type"), "_k": login_norm("object_key")})
    # Deterministic, so a recomputed task sends its rows to the same place.
    draw = F.xxhash64(*events.columns)
    salt, copies = F.lit(0), F.array(F.lit(0))
    if salts > 1:
        hot = _hot_keys(rows, keys, hot_rows)
        rows, exact, loose = (side.join(F.broadcast(hot), keys, "left") for side in (rows, exact, loose))
        salt = F.when(F.col("_hot"), F.pmod(draw, F.lit(salts)).cast("int")).otherwise(0)
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(copies)
    exact, loose = (side.withColumn("_salt", F.explode(copies)).drop("_hot") for side in (exact, loose))
    # Salts below 0 meet no catalogue row.
    apart = (-1 - F.pmod(draw, F.lit(SPREAD))).cast("int")
    no_key = F.col("_i").isNull() | F.col("_t").isNull() | F.col("_k").isNull()
    rows = rows.withColumns({"_pk": project_key(_project_norm()), "_salt": F.when(no_key, apart).otherwise(salt)})
    is_exact, is_fallback = F.col("_exact.product_id").isNotNull(), F.col("_fallback.product_id").isNotNull()
    found = rows.join(exact, [*keys, "_pk", "_salt"], "left").withColumn("_salt", F.when(is_exact, apart).otherwise(F.col("_salt")))
    joined = found.join(loose, [*keys, "_salt"], "left")
    product = F.when(is_exact, F.col("_exact")).otherwise(F.col("_fallback"))
    return joined.withColumn("_product", product).select(
        *events.columns,
        F.col("_product.product_id").alias("product_id"),
        F.when(is_exact, "exact").when(is_fallback, "fallback").otherwise("unmatched").alias("match_type"),
        F.col("_product.product_name").alias("product_name"),
        F.col("_product.owner_login").alias("owner_login"),
    )


def matched_consumption(
    events: DataFrame,
    catalog: DataFrame,
    as_of,
    *,
    days: int = 30,
    q: str | None = None,
    owner: str | None = None,
    owner_is: str | None = None,
    types: Sequence[str] | None = None,
    instances: Sequence[str] | None = None,
    projects: Sequence[str] | None = None,
) -> DataFrame:
    """Matched consumption grain under the page filters; the input of every rollup below.

    A product follows from the object alone, so objects are matched and the grain is shuffled once for
    it, in its own columns. A matched object has an instance, type and key; its project may be null.
    """
    eligible = eligible_events(events, as_of, days, types=types, instances=instances, projects=projects)
    matched = match_products(object_counts(eligible), catalog, types=types, salts=1).filter(F.col("product_id").isNotNull()).drop("events")
    found = matched.withColumnsRenamed({k: f"_{k}" for k in OBJECT_KEYS})
    same = F.col("project_key").eqNullSafe(F.col("_project_key"))
    for key in ("instance_name", "object_type", "object_key"):
        same = same & (F.col(key) == F.col(f"_{key}"))
    rows = consumption_grain(eligible).join(found, same).drop(*[f"_{k}" for k in OBJECT_KEYS])
    if q:
        text = q.lower()
        named = F.lower(F.coalesce("product_name", "object_key")).contains(text)
        rows = rows.filter(named | F.lower("object_key").contains(text))
    if owner:
        rows = rows.filter(F.col("owner_login") == owner)
    if owner_is:
        rows = rows.filter(F.lower(F.coalesce("owner_login", F.lit(""))) == owner_is.lower())
    return rows


# --- rollups ----------------------------------------------------------------------------


def consumption_totals(matched: DataFrame) -> DataFrame:
    pairs = matched.groupBy("product_id", "login").agg(F.sum("events").alias("_n"))
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events"),
        F.count_distinct("login").alias("active_users"),
        F.count_distinct("product_id").alias("active_products"),
    )


def _per_product(matched: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Events and distinct logins per product: one row per (product, login), then per product."""
    pairs = matched.groupBy(*keys, "login").agg(F.sum("events").alias("_n"))
    return pairs.groupBy(*keys).agg(F.sum("_n").alias("events"), F.count("login").alias("active_users"))


def _top_shares(stats: DataFrame, key: str, prefix: str) -> DataFrame:
    """Events of the largest one and five rows, from a five-row ranking."""
    top = top_n(stats.select(key, "events"), [F.col("events").desc(), F.col(key).asc_nulls_last()], 5)
    return top.agg(
        F.coalesce(F.max("events"), F.lit(0)).alias(f"top1_{prefix}_events"),
        F.coalesce(F.sum("events"), F.lit(0)).alias(f"top5_{prefix}_events"),
    )


def product_rollups(matched: DataFrame) -> DataFrame:
    stats = _per_product(matched)
    users, events = F.col("active_users"), F.col("events")
    shared, repeat = users >= SHARED_USERS, events >= REPEAT_EVENTS
    rollup = stats.agg(
        F.coalesce(F.avg(users), F.lit(0.0)).alias("avg_users_per_product"),
        F.count_if(shared).alias("collaborative_products"),
        F.count_if(users == 1).alias("single_user_products"),
        F.count_if(shared & ~repeat).alias("multi_user_light_products"),
        F.count_if(repeat).alias("repeat_products"),
        F.count_if(shared & repeat).alias("adopted_products"),
        F.coalesce(F.max(events), F.lit(0)).alias("top_product_events"),
    )
    return merge_single_rows(rollup, _top_shares(stats, "product_id", "product"))


def user_rollups(matched: DataFrame) -> DataFrame:
    objects = [F.col("instance_name"), F.coalesce("project_key", F.lit("")).alias("project_key"), F.col("object_type"), F.col("object_key")]
    pairs = matched.groupBy("login", *objects).agg(F.sum("events").alias("_n"))
    stats = pairs.groupBy("login").agg(F.sum("_n").alias("events"), F.count(F.lit(1)).alias("active_products"))
    rollup = stats.agg(
        F.coalesce(F.avg("active_products"), F.lit(0.0)).alias("avg_products_per_user"),
        F.coalesce(F.max("active_products"), F.lit(0)).alias("top_user_products"),
    )
    return merge_single_rows(rollup, _top_shares(stats, "login", "user"))


def _tier(score: Column, lowest: str) -> Column:
    return F.when(score >= 75, "scaled").when(score >= 45, "growing").otherwise(lowest)


def _capped(value: Column) -> Column:
    return F.least(value, F.lit(100.0))


def maturity(totals: DataFrame, products: DataFrame) -> DataFrame:
    """Portfolio maturity from the two one-row rollups: breadth, repeat, collaboration, concentration."""
    row = merge_single_rows(totals, products)
    active, events = F.col("active_products"), F.col("events")
    share = lambda column: F.coalesce(F.try_divide(F.col(column), active), F.lit(0.0)) * 100.0
    top1 = F.least(F.col("top1_product_events") / F.greatest(events, F.lit(1)), F.lit(1.0))
    top5 = F.least(F.col("top5_product_events") / F.greatest(events, F.lit(1)), F.lit(1.0))
    parts = {
        "breadth": _capped(active / 25.0 * 100.0),
        "repeat": _capped(share("repeat_products")),
        "collaboration": _capped(share("collaborative_products")),
        "concentration": F.when(events > 0, F.greatest(F.lit(0.0), (1.0 - (top5 * 0.6 + top1 * 0.4)) * 100.0)).otherwise(0.0),
    }
    weights = {"breadth": 0.3, "repeat": 0.3, "collaboration": 0.2, "concentration": 0.2}
    total = sum((parts[name] * weight for name, weight in weights.items()), F.lit(0.0))
    scored = row.select(
        F.round(total, 1).alias("maturity_score"),
        *[F.round(part, 1).alias(name) for name, part in parts.items()],
        "active_users",
        "adopted_products",
    )
    return scored.withColumn("maturity_tier", _tier(F.col("maturity_score"), "nascent"))


def consumption_daily(matched: DataFrame) -> DataFrame:
    return matched.groupBy(F.col("day").cast("string").alias("label")).agg(F.sum("events").alias("value"))


def _product_scores(users: Column, events: Column) -> dict[str, Column]:
    """Single-product maturity parts, each 0 to 100."""
    return {
        "breadth_score": _capped(users / 5.0 * 100.0),
        "repeat_score": _capped(events / 5.0 * 100.0),
        "collaboration_score": _capped(users / 2.0 * 100.0),
        "concentration_score": F.greatest(F.lit(0.0), 100.0 - events / F.greatest(events, F.lit(10)) * 100.0),
    }


def consumption_by_type(spark: SparkSession, matched: DataFrame, types: Sequence[str] = tuple(CONSUMPTION_TYPES)) -> DataFrame:
    """Rollup per supported type, types without activity included."""
    stats = _per_product(matched, ["object_type", "product_id"])
    users, events = F.col("active_users"), F.col("events")
    score = sum((part * 0.25 for part in _product_scores(users, events).values()), F.lit(0.0))
    per_type = stats.groupBy("object_type").agg(
        F.sum("events").alias("events"),
        F.count(F.lit(1)).alias("active_products"),
        F.avg(users).alias("avg_users_per_product"),
        F.max(users).alias("max_users_on_product"),
        F.count_if((users >= SHARED_USERS) & (events >= REPEAT_EVENTS)).alias("adoption_count"),
        F.avg(score).alias("avg_maturity_score"),
        F.max(score).alias("max_maturity_score"),
    )
    people = matched.groupBy("object_type").agg(F.count_distinct("login").alias("active_users"))
    spine = literal_table(spark, {"object_type": "string"}, [(t,) for t in types])
    joined = spine.join(per_type, "object_type", "left").join(people, "object_type", "left")
    measures = [c for c in joined.columns if c != "object_type"]
    return joined.select(F.col("object_type").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])


# Product names that say nothing, and the shortest name that says something.
LOW_SIGNAL_NAMES = ["view", "demo", "test", "dash", "prez"]
MIN_NAME_LENGTH = 5


def high_signal_name(name: Column | str) -> Column:
    text = F.trim(as_col(name))
    return F.when((F.length(text) >= MIN_NAME_LENGTH) & ~F.lower(text).isin(LOW_SIGNAL_NAMES), text)


def top_products(matched: DataFrame, catalog: DataFrame, limit: int = 50) -> DataFrame:
    """Most used objects with a readable name and owner."""
    pairs = matched.groupBy("product_id", *OBJECT_KEYS, "login").agg(F.sum("events").alias("_n"), F.max("last_at").alias("_last"))
    used = pairs.groupBy("product_id", *OBJECT_KEYS).agg(
        F.sum("_n").alias("events"), F.count("login").alias("active_users"), F.max("_last").alias("last_activity_at")
    )
    order = [F.col("events").desc(), F.col("last_activity_at").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in OBJECT_KEYS]]
    top = top_n(used, order, limit)
    # Names are looked up for the ranked rows only: the catalogue is cut down before the joins.
    keys = ["instance_name", "object_type", "object_key"]
    renamed = catalog.withColumnsRenamed({"product_type": "object_type", "product_key": "object_key"}).select(
        *OBJECT_KEYS, F.col("product_name").alias("_name"), F.col("owner_login").alias("_owner")
    )
    near = renamed.join(top.select(*keys).distinct(), keys, "left_semi")
    single = (
        near.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_name1"), F.min("_owner").alias("_owner1"))
        .filter("_n = 1")
        .drop("_n")
    )
    exact = near.select(*[F.col(k).alias(f"_{k}") for k in OBJECT_KEYS], "_name", "_owner")
    same = F.col("project_key").eqNullSafe(F.col("_project_key"))
    for key in keys:
        same = same & (F.col(key) == F.col(f"_{key}"))
    named = top.join(exact, same, "left").join(single, keys, "left")
    loose = F.col("project_key").isNull()  # only objects without a project may borrow a name
    return named.select(
        "product_id",
        "instance_name",
        "project_key",
        F.col("object_type").alias("product_type"),
        F.col("object_key").alias("product_key"),
        F.coalesce(
            high_signal_name("_name"),
            F.when(loose, high_signal_name("_name1")),
            null_if_blank("_name"),
            F.when(loose, null_if_blank("_name1")),
            "object_key",
        ).alias("product_name"),
        F.coalesce(null_if_blank("_owner"), F.when(loose, null_if_blank("_owner1"))).alias("owner_login"),
        "events",
        "active_users",
        "last_activity_at",
    )


def consumption_facets(events: DataFrame, catalog: DataFrame, owner_is: str | None = None) -> DataFrame:
    """Filter values as (facet, value) rows; a person's own view comes from the catalogue."""
    types = list(CONSUMPTION_TYPES)
    if owner_is:
        catalog = catalog.filter(F.lower(F.coalesce("owner_login", F.lit(""))) == owner_is.lower())
        rows = catalog.filter(F.col("product_type").isin(types) & has_text("product_key")).withColumn("object_type", F.col("product_type"))
    else:
        rows = events.filter(F.col("object_type").isin(types) & has_text("object_key"))
    columns = {"instances": "instance_name", "projects": "project_key", "types": "object_type"}
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in columns.items()])
    used = rows.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
    owners = catalog.select(F.lit("owners").alias("facet"), F.col("owner_login").alias("value"))
    return used.unionByName(owners).filter("value IS NOT NULL").distinct()


# --- one product -----------------------------------------------------------------------------


def _product_events(events: DataFrame, catalog: DataFrame, product_id: str, as_of, days: int, owner_is: str | None) -> tuple[DataFrame, DataFrame]:
    product = catalog.filter(F.col("product_id") == product_id)
    if owner_is:
        product = product.filter(F.lower(F.coalesce("owner_login", F.lit(""))) == owner_is.lower())
    # Where an id repeats, the smallest row stands for it.
    product = product.orderBy("instance_name", "project_key", "product_type", "product_key", "owner_login", "product_name").limit(1)
    target = product.select(
        F.col("instance_name").alias("_i"), F.col("project_key").alias("_p"), F.col("product_type").alias("_t"), F.col("product_key").alias("_k"), "product_id"
    )
    same = (
        (F.col("instance_name") == F.col("_i"))
        & F.col("project_key").eqNullSafe(F.col("_p"))
        & (F.col("object_type") == F.col("_t"))
        & (F.col("object_key") == F.col("_k"))
    )
    recent = events.filter(since_days("timestamp", as_of, days))
    # A single catalogue row: broadcasting it turns the lookup into a filter.
    return product, recent.join(F.broadcast(target), same)


def product_detail(events: DataFrame, catalog: DataFrame, product_id: str, as_of, days: int = 30, owner_is: str | None = None) -> DataFrame:
    """Usage, adoption tier and maturity of one product, in one row."""
    product, rows = _product_events(events, catalog, product_id, as_of, days, owner_is)
    totals = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("login").alias("active_users"), F.max("timestamp").alias("last_event_at")
    )
    row = product.join(totals, "product_id", "left").withColumns(
        {"events": F.coalesce("events", F.lit(0)), "active_users": F.coalesce("active_users", F.lit(0))}
    )
    users, events_n = F.col("active_users"), F.col("events")
    scores = {name: F.round(F.when(events_n > 0, part).otherwise(0.0), 1) for name, part in _product_scores(users, events_n).items()}
    scores["breadth_score"] = F.round(F.when(users > 0, F.least(users / 5.0, F.lit(1.0)) * 100.0).otherwise(0.0), 1)
    scores["collaboration_score"] = F.round(F.when(users >= SHARED_USERS, 100.0).otherwise(users / 2.0 * 100.0), 1)
    row = row.withColumns(scores)
    total = F.round(sum((F.col(name) for name in scores), F.lit(0.0)) / len(scores), 1)
    adoption = (
        F.when(users == 1, "Tier 1 · 1 user")
        .when((users >= SHARED_USERS) & (events_n < REPEAT_EVENTS), "Tier 2 · 2+ users, <5 events")
        .when(users >= SHARED_USERS, "Tier 3 · 2+ users, 5+ events")
        .otherwise("Unclassified")
    )
    return row.withColumn("maturity_score", total).select(
        "product_id", "instance_name", "project_key", "product_type", "product_key", "product_name", "owner_login",
        "product_subtype", "created_at", "updated_at", "events", "active_users", "last_event_at",
        (events_n >= REPEAT_EVENTS).alias("repeat_use"),
        (users >= SHARED_USERS).alias("collaborative"),
        adoption.alias("adoption_tier"),
        *scores,
        "maturity_score",
        _tier(F.col("maturity_score"), "emerging").alias("maturity_tier"),
    )


def product_detail_daily(events, catalog, product_id: str, as_of, days: int = 30) -> DataFrame:
    _, rows = _product_events(events, catalog, product_id, as_of, days, None)
    return rows.groupBy(F.to_date("timestamp").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value"))


def product_detail_users(events, catalog, product_id: str, as_of, days: int = 30, limit: int = 25) -> DataFrame:
    _, rows = _product_events(events, catalog, product_id, as_of, days, None)
    counts = rows.groupBy(F.col("login").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return top_n(counts, [F.col("value").desc(), F.col("label").asc_nulls_last()], limit)


# --- lifecycle -------------------------------------------------------------------------------


def product_milestones(grain: DataFrame) -> DataFrame:
    """First use, first day with two people and first day with five events, per object.

    Distinct people so far is a running sum of people seen for the first time, so the
    window runs over days of one object (a few hundred rows) and never over events.
    """
    first_seen = grain.filter(F.col("login").isNotNull()).groupBy(*OBJECT_KEYS, "login").agg(F.min("day").alias("day"))
    arrivals = first_seen.select(*OBJECT_KEYS, "day", F.lit(1).cast("long").alias("new_users"))
    volume = grain.select(*OBJECT_KEYS, "day", "events", "first_at")
    days = (
        volume.unionByName(arrivals, allowMissingColumns=True)
        .groupBy(*OBJECT_KEYS, "day")
        .agg(F.sum("events").alias("_n"), F.coalesce(F.sum("new_users"), F.lit(0)).alias("_u"), F.min("first_at").alias("_first"))
    )
    so_far = Window.partitionBy(*OBJECT_KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = days.withColumns({"_users": F.sum("_u").over(so_far), "_events": F.sum("_n").over(so_far)})
    return running.groupBy(*OBJECT_KEYS).agg(
        F.min("_first").alias("first_consumption_at"),
        F.min(F.when(F.col("_users") >= SHARED_USERS, F.col("day"))).alias("multi_user_at"),
        F.min(F.when(F.col("_events") >= REPEAT_EVENTS, F.col("day"))).alias("repeat_use_at"),
    )


def product_durations(events: DataFrame, catalog: DataFrame, as_of, days: int = 365, *, types=None, instances=None, projects=None, owner_is=None) -> DataFrame:
    """Days from creation to each milestone for every consumed catalogue product."""
    grain = consumption_grain(eligible_events(events, as_of, days, types=types, instances=instances, projects=projects))
    known = catalog.filter(F.col("product_type").isin(list(types or CONSUMPTION_TYPES)) & has_text("product_key"))
    if owner_is:
        known = known.filter(F.lower(F.coalesce("owner_login", F.lit(""))) == owner_is.lower())
    items = known.select(
        F.col("instance_name").alias("_i"), F.col("project_key").alias("_p"), F.col("product_type").alias("_t"), F.col("product_key").alias("_k"),
        "product_id", "created_at",
    )
    same = (
        (F.col("instance_name") == F.col("_i"))
        & F.col("project_key").eqNullSafe(F.col("_p"))
        & (F.col("object_type") == F.col("_t"))
        & (F.col("object_key") == F.col("_k"))
    )
    rows = product_milestones(grain).join(items, same)
    created = F.to_date("created_at")
    return rows.select(
        "product_id",
        "created_at",
        "first_consumption_at",
        "multi_user_at",
        "repeat_use_at",
        F.date_diff(F.to_date("first_consumption_at"), created).alias("days_to_first_consumption"),
        F.date_diff("multi_user_at", created).alias("days_to_multi_user"),
        F.date_diff("repeat_use_at", created).alias("days_to_repeat_use"),
    )


def lifecycle(events: DataFrame, catalog: DataFrame, as_of, days: int = 365, **filters) -> DataFrame:
    """Milestone counts with median and mean days to reach them (negative spans left out)."""
    rows = product_durations(events, catalog, as_of, days, **filters)
    columns = []
    for name in ("first_consumption", "multi_user", "repeat_use"):
        span = F.when(F.col(f"days_to_{name}") >= 0, F.col(f"days_to_{name}"))
        # The exact median keeps one counter per distinct number of days.
        columns += [F.median(span).alias(f"median_days_to_{name}"), F.avg(span).alias(f"avg_days_to_{name}")]
    return rows.agg(
        F.count(F.lit(1)).alias("products_with_created_at"),
        F.count("first_consumption_at").alias("products_with_first_consumption"),
        F.count("multi_user_at").alias("products_with_multi_user"),
        F.count("repeat_use_at").alias("products_with_repeat_use"),
        *columns,
    )


# --- diagnostics --------------------------------------------------------------------------------


def match_diagnostics(events: DataFrame, catalog: DataFrame, as_of, days: int = 30, **scope) -> DataFrame:
    """How many eligible events match, by kind, in one row."""
    counts = object_counts(eligible_events(events, as_of, days, **scope))
    by_kind = match_products(counts, catalog, salts=1).groupBy("match_type").agg(F.sum("events").alias("_n"))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("match_type").isin(list(kinds)), F.col("_n"))), F.lit(0))
    return by_kind.agg(
        of("exact", "fallback", "unmatched").alias("eligible_events"),
        of("exact").alias("exact_matches"),
        of("fallback").alias("fallback_matches"),
        of("exact", "fallback").alias("matched_events"),
        of("unmatched").alias("unmatched_events"),
    )


def unmatched_by_type(events: DataFrame, catalog: DataFrame, as_of, days: int = 30, **scope) -> DataFrame:
    counts = object_counts(eligible_events(events, as_of, days, **scope))
    rows = match_products(counts, catalog, salts=1).filter(F.col("match_type") == "unmatched")
    return rows.groupBy(F.col("object_type").alias("label")).agg(F.sum("events").alias("events"))


def unmatched_sample(events: DataFrame, catalog: DataFrame, as_of, days: int = 30, limit: int = 20, **scope) -> DataFrame:
    """A few unmatched identities for a human to look at, in a repeatable order."""
    counts = object_counts(eligible_events(events, as_of, days, **scope))
    rows = match_products(counts, catalog, salts=1).filter(F.col("match_type") == "unmatched").select(*OBJECT_KEYS)
    return top_n(rows, [F.col(k).asc_nulls_last() for k in OBJECT_KEYS], limit)
