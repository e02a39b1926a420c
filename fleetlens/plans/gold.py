"""Build the curated tables in dependency order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.calendar import day_floor
from fleetlens.operators import activity, development, licences, objects
from fleetlens.operators.latest import INVENTORY_KEYS, latest_inventory
from fleetlens.plans import dims
from fleetlens.sources import sinks
from fleetlens.sources.tables import from_day

BUILT_TOGETHER = 4  # fixed value: tables that are written at the same time


@dataclass(frozen=True)
class TableSpec:
    """One curated table: its builder takes the tables built so far."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    depends_on: list[str] = field(default_factory=list)
    order: int = 0
    time_column: str | None = None  # of a fact: written by day, with a watermark
    required: bool = True  # a failure stops the commit of watermarks
    since: Callable[[dict[str, DataFrame], dt.date], DataFrame] | None = None  # of a fact: its rows from a day on, read from that day on


def build_order(specs: list[TableSpec]) -> list[TableSpec]:
    """Dependencies first; ties by (order, name). Duplicates and cycles are errors."""
    by_name = {s.name: s for s in specs}
    if len(by_name) != len(specs):
        raise ValueError("duplicate table name")
    done: list[TableSpec] = []
    names: set[str] = set()
    while len(done) < len(specs):
        ready = [s for s in specs if s.name not in names and set(s.depends_on) <= names]
        if not ready:
            raise ValueError(f"unresolved dependencies: {sorted(by_name.keys() - names)}")
        for spec in sorted(ready, key=lambda s: (s.order, s.name)):
            done.append(spec)
            names.add(spec.name)
    return done


def build_gold(
    specs: list[TableSpec],
    write: Callable[[str, DataFrame], DataFrame],
    low: Callable[[str], dt.date | None] = lambda name: None,
    threaded: Callable[[Callable], Callable] = lambda build: build,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Build and ``write`` every table; a failed table skips its dependants and is recorded.

    A fact that has a day in ``low`` and knows how is built from that day on. ``BUILT_TOGETHER`` tables are
    written at the same time, each once all it depends on is; most leave cores idle on their own.
    ``threaded`` prepares the builder for a thread (Spark's properties of the caller).
    """
    ordered = build_order(specs)
    tables: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}

    def built(spec: TableSpec, ready: dict[str, DataFrame]) -> DataFrame:
        day = low(spec.name) if spec.since else None
        return write(spec.name, spec.build(ready) if day is None else spec.since(ready, day))

    waiting, begun = list(ordered), {}
    with ThreadPoolExecutor(BUILT_TOGETHER) as pool:
        while waiting or begun:
            for spec in list(waiting):
                missing = [d for d in spec.depends_on if d in failed]
                if missing:
                    failed[spec.name] = f"skipped, needs {missing}"
                elif not set(spec.depends_on) <= tables.keys():
                    continue
                else:
                    begun[pool.submit(threaded(built), spec, dict(tables))] = spec
                waiting.remove(spec)
            for done in wait(begun, return_when=FIRST_COMPLETED).done:
                name = begun.pop(done).name
                try:
                    tables[name] = done.result()
                except Exception as exc:  # recorded; other tables may still be built
                    failed[name] = repr(exc)
    names = [s.name for s in ordered]
    return {n: tables[n] for n in names if n in tables}, {n: failed[n] for n in names if n in failed}


@dataclass
class GoldRun:
    tables: dict[str, DataFrame]
    failed: dict[str, str]
    committed: bool
    low: dict[str, dt.date | None] = field(default_factory=dict)  # of each fact: the day it was built from, None if whole


# Base tables a dashboard cannot do without; the others may fail without holding back the facts.
REQUIRED_BASE = ("users", "license_max")


def gold_specs(spark: SparkSession, silver: dict[str, DataFrame]) -> list[TableSpec]:
    """All curated tables that ``silver`` has the sources of.

    ``silver`` maps an inventory's name to its snapshots, and ``audit_flat`` (flattened audit
    rows), ``dev_events`` (mapped events) and ``object_events`` (module rows) to the event sources.
    """

    def base(name: str) -> TableSpec:
        return TableSpec(f"base_{name}", lambda t: latest_inventory(silver[name], name), required=name in REQUIRED_BASE)

    def fact(name: str, build: Callable[..., DataFrame], time_column: str, depends_on: list[str] = [], required: bool = True) -> TableSpec:  # noqa: B006
        return TableSpec(name, lambda t: build(t, None), depends_on, 2, time_column, required, since=build)

    def events(name: str, low: dt.date | None) -> DataFrame:
        return from_day(silver[name], low)

    def hours(t: dict[str, DataFrame], low: dt.date | None) -> DataFrame:
        return from_day(t["fact_user_activity_hourly"], low, tuple(sinks.DAY_PARTITIONS))

    specs = [base(name) for name in INVENTORY_KEYS if name in silver]
    specs += [
        TableSpec("dim_capability", lambda t: dims.dim_capability(spark), order=1),
        TableSpec("dim_event_class", lambda t: dims.dim_event_class(spark), order=1),
    ]
    if "audit_flat" in silver:
        specs += [
            fact("fact_user_activity_hourly", lambda t, low: activity.user_activity_hourly(events("audit_flat", low)), "timestamp"),
            fact("fact_user_activity_daily", lambda t, low: activity.user_activity_daily(hours(t, low)), "last_activity_at", ["fact_user_activity_hourly"]),
            fact("fact_user_activity_project_daily", lambda t, low: activity.user_activity_project_daily(hours(t, low)), "last_activity_at", ["fact_user_activity_hourly"]),
            fact("fact_formal_mau_daily", lambda t, low: activity.formal_mau_daily(activity.formal_mau_hourly(events("audit_flat", low))), "last_application_open_at"),
        ]
    if "dev_events" in silver:
        specs.append(fact("fact_dev_activity_events", lambda t, low: development.dev_activity_events(events("dev_events", low)), "timestamp"))
    if "object_events" in silver:
        build = lambda t, low: objects.object_activity_events(spark, events("object_events", low), t["dim_capability"])
        specs.append(fact("fact_object_activity_events", build, "timestamp", ["dim_capability"], required=False))
    if {"license_max", "users"} <= silver.keys():
        build = lambda t, low: licences.license_utilization_daily(events("license_max", low), events("users", low))
        specs.append(fact("fact_license_utilization_daily", build, "snapshot_date"))
    return specs


def publish(spark: SparkSession, specs: list[TableSpec], root: str, lookback_days: int = 3) -> GoldRun:
    """Build all tables below ``root``: facts from their watermark on, the rest whole.

    A watermark less the lookback gives the first day of a fact's build. Sources and facts that a fact is
    made of are read from that day's partitions on, and the days from it on are replaced.
    Watermarks are committed last and only if no required table failed, so a failed run is
    repeated from where the last good one ended.
    """
    by_name = {s.name: s for s in specs}
    state = f"{root}/_state"
    marks = sinks.read_watermarks(spark, state)
    columns: dict[str, list[str]] = {}

    def low(name: str) -> dt.date | None:
        boundary = sinks.incremental_boundary(marks, name, lookback_days) if by_name[name].time_column else None
        return None if boundary is None else day_floor(boundary)

    def write(name: str, df: DataFrame) -> DataFrame:
        path, spec, columns[name] = f"{root}/{name}", by_name[name], df.columns
        if spec.time_column is None:
            sinks.write_single(df, path)
            return spark.read.schema(df.schema).parquet(path)
        day = low(name)
        sinks.write_fact_partitions(df, path, spec.time_column, day and f"{day} 00:00:00")
        # With its partition columns, so that a fact built from it opens only the days it needs.
        return spark.read.schema(sinks.with_fact_partitions(df, spec.time_column).schema).parquet(path)

    tables, failed = build_gold(specs, write, low, lambda build: inheritable_thread_target(spark)(build))
    stopped = sum(by_name[name].required for name in failed)
    lows = {s.name: low(s.name) for s in specs if s.time_column}
    facts = {name: (from_day(tables[name], day, tuple(sinks.DAY_PARTITIONS)), by_name[name].time_column) for name, day in lows.items() if name in tables}
    committed = sinks.commit_watermarks(spark, state, facts, failures=stopped)
    return GoldRun({name: table.select(*columns[name]) for name, table in tables.items()}, failed, committed, lows)
