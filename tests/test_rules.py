"""Edge cases of single rules on small seeded frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import calendar, casts, entitlement, text
from fleetlens.functions.rollup import count_with_distincts, merge_single_rows
from fleetlens.operators import development, licences, normalize
from fleetlens.operators.latest import latest_by_partition
from fleetlens.plans import dims, gold, inventory
from fleetlens.sources import sinks, snapshots, tables
from fleetlens.sources.scratch import new_path


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    "value, expected",
    [("  Visual Recipes ", "visual_recipes"), ("a - b", "a_b"), ("A__b", "a_b"), (None, None)],
)
def test_canonical(spark, value, expected):
    assert one(spark, text.canonical(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [(" {id} ", None), ("  ", None), (" a ", "a"), ("{a}b", "{a}b"), (None, None)])
def test_clean_identifier(spark, value, expected):
    assert one(spark, text.clean_identifier(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1704067200", dt.datetime(2024, 1, 1)),
        ("1704067200999", dt.datetime(2024, 1, 1)),
        ("1704067200999999", dt.datetime(2024, 1, 1)),
        ("1704067200999999999", dt.datetime(2024, 1, 1)),
        ("2024-01-01 00:00:00.9", dt.datetime(2024, 1, 1)),
        ("nonsense", None),
        ("", None),
    ],
)
def test_cast_datetime(spark, value, expected):
    assert one(spark, casts.cast_datetime(F.lit(value))) == expected


def test_strict_epoch_rejects_other_lengths(spark):
    with pytest.raises(Exception, match="unsupported epoch length"):
        one(spark, casts.cast_epoch_strict(F.lit("123")))
    assert one(spark, casts.cast_epoch_strict(F.lit("123"), on_error="null")) is None


@pytest.mark.parametrize("value, expected", [("True", True), ("0", False), ("yes", None), (None, None)])
def test_cast_boolean(spark, value, expected):
    assert one(spark, casts.cast_boolean(F.lit(value).cast("string"))) is expected


@pytest.mark.parametrize(
    "source, via, scenario, job, origin",
    [
        ("USER_FROM_UI", "ticket:job:P.x", "S", "J", "scenario_automation"),
        ("PERSONAL_API_KEY", "scenario=P.x", None, "J", "scenario_automation"),
        ("USER_FROM_UI", None, None, "J", "job_automation"),
        ("personal_api_key", "ticket:jupyter:P.x", None, None, "api_activity"),
        ("USER_FROM_UI", "ticket:unknown", None, None, "unknown_or_other"),
        ("USER_FROM_UI", "Macro run", None, None, "unknown_or_other"),
        ("USER_FROM_UI", None, None, None, "direct_ui_user"),
        (None, None, None, None, "unknown_or_other"),
    ],
)
def test_origin_precedence(spark, source, via, scenario, job, origin):
    columns = [F.lit(v).cast("string") for v in (source, via, scenario, job)]
    assert one(spark, development.activity_origin(*columns)["activity_origin"]) == origin


@pytest.mark.parametrize(
    "via, project, webapp",
    [
        ("x scenario=PROJ.daily now", "PROJ", None),
        ("ticket:Standard webapp backend: P9.w1, other", "P9", "w1"),
        ("ticket:Standard webapp backend: nodot", None, None),
        ("ticket:job:{p}.x", None, None),
        ("", None, None),
    ],
)
def test_authvia(spark, via, project, webapp):
    found = normalize.authvia_source(F.lit(via))
    assert (one(spark, found[0]), one(spark, found[1])) == (project, webapp)


def test_license_vocabulary(spark):
    assert one(spark, entitlement.license_group(F.lit(" reader "))) == "Consumer Licenses"
    assert one(spark, entitlement.license_group(F.lit(None).cast("string"))) == "Other Licenses"
    assert one(spark, entitlement.license_filter(F.lit("x"), "no such filter")) is True
    assert one(spark, entitlement.normalize_profile(F.lit("Full-Designer 2"))) == "FULLDESIGNER2"


def test_license_day_uses_newest_snapshot(spark):
    limits = spark.sql(
        "SELECT * FROM VALUES ('a','P','5',TIMESTAMP'2024-01-01 01:00:00'), ('a','P','7',TIMESTAMP'2024-01-01 09:00:00'),"
        "('a','Q','0',TIMESTAMP'2024-01-01 01:00:00'), ('a','R',NULL,TIMESTAMP'2024-01-01 01:00:00') t(instance_name,license_profile,max_licenses,run_ts)"
    )
    users = spark.sql(
        "SELECT * FROM VALUES ('a','u1','True','P',NULL,TIMESTAMP'2024-01-01 02:00:00'), ('a','U1 ','False','P',NULL,TIMESTAMP'2024-01-01 01:00:00'),"
        "('a','u2','True','Z','Q',TIMESTAMP'2024-01-01 02:00:00') t(instance_name,users_login,users_enabled,users_userprofile,users_resultinguserprofile,run_ts)"
    )
    rows = {r.license_profile: r for r in licences.license_utilization_daily(limits, users).collect()}
    assert (rows["P"].entitled_count, rows["P"].assigned_count, rows["P"].available_count) == (7, 1, 6)
    assert rows["Q"].utilization_pct is None and rows["Q"].available_count == -1
    assert rows["R"].entitled_count is None and rows["R"].assigned_count == 0


def test_calendar_edges():
    assert calendar.add_months(dt.date(2024, 3, 31), -1) == dt.date(2024, 2, 29)
    assert calendar.add_months(dt.date(2024, 1, 15), -1) == dt.date(2023, 12, 15)
    assert calendar.period_bounds("2024-01-01", "weekly")[-1] == (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
    assert calendar.period_bounds("2024-02-29", "quarterly")[0] == (dt.date(2023, 4, 1), dt.date(2023, 7, 1))
    assert len(calendar.period_bounds("2024-02-29", "monthly")) == 3


def test_description_priority(spark):
    text_ = '{"meta_description": "m", "desc": " d ", "description": " "}'
    assert one(spark, inventory.description_from_json(F.lit(text_))) == "d"
    assert one(spark, inventory.description_from_json(F.lit("not json"))) is None


def test_duplicate_configuration_is_an_error(spark):
    with pytest.raises(ValueError, match="duplicate"):
        dims.dim_event_class(spark, [("a-b", "x", True), ("A b", "y", False)])
    with pytest.raises(ValueError, match="duplicate"):
        inventory.products_registry(spark, [("a",) * 9, ("a",) * 9])


def test_build_order():
    spec = lambda name, *deps, order=0: gold.TableSpec(name, lambda t: None, list(deps), order)
    assert [s.name for s in gold.build_order([spec("b", "a"), spec("z"), spec("a", order=1)])] == ["z", "a", "b"]
    with pytest.raises(ValueError, match="unresolved"):
        gold.build_order([spec("a", "b"), spec("b", "a")])
    with pytest.raises(ValueError, match="duplicate"):
        gold.build_order([spec("a"), spec("a")])


def test_failed_table_skips_its_dependants():
    def fail(tables_):
        raise RuntimeError("boom")

    specs = [gold.TableSpec("a", fail), gold.TableSpec("b", lambda t: "b", ["a"]), gold.TableSpec("c", lambda t: "c")]
    built, failed = gold.build_gold(specs, lambda name, df: df)
    assert built == {"c": "c"} and set(failed) == {"a", "b"}


def test_incremental_write_replaces_whole_days(spark):
    path = new_path(spark, "fact")
    first = spark.sql("SELECT * FROM VALUES ('a',TIMESTAMP'2024-01-01 01:00:00',1),('a',TIMESTAMP'2024-01-02 01:00:00',1),(NULL,TIMESTAMP'2024-01-02 01:00:00',9) t(instance_name,ts,v)")
    sinks.write_fact_partitions(first, path, "ts")
    again = spark.sql("SELECT * FROM VALUES ('a',TIMESTAMP'2024-01-01 01:00:00',5),('a',TIMESTAMP'2024-01-02 01:00:00',6),('a',TIMESTAMP'2024-01-02 23:00:00',7) t(instance_name,ts,v)")
    sinks.write_fact_partitions(again, path, "ts", "2024-01-02 12:00:00")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 6, 7]
    kept = tables.load_gold(spark, path, "2024-01-03", retention_days=1)
    assert sorted(r.v for r in kept.collect()) == [6, 7]
    with pytest.raises(ValueError):
        tables.load_gold(spark, path, "2024-01-03", retention_days=-1)


def test_watermarks_are_kept_back_after_a_failure(spark):
    path = new_path(spark, "state")
    fact = spark.sql("SELECT TIMESTAMP'2024-01-05 10:00:00' AS ts")
    assert sinks.read_watermarks(spark, path) == {}
    assert not sinks.commit_watermarks(spark, path, {"f": (fact, "ts")}, failures=1)
    assert sinks.read_watermarks(spark, path) == {}
    assert sinks.commit_watermarks(spark, path, {"f": (fact, "ts")})
    assert sinks.incremental_boundary(sinks.read_watermarks(spark, path), "f") == "2024-01-02 10:00:00"
    assert sinks.incremental_boundary({"f": "junk"}, "f") is None


def test_watermarks_merge_and_survive_a_cut_off_version(spark):
    path = new_path(spark, "state")
    fact = lambda day: spark.sql(f"SELECT TIMESTAMP'2024-01-{day} 10:00:00' AS ts")
    sinks.commit_watermarks(spark, path, {"a": (fact("05"), "ts"), "b": (fact("06"), "ts")})
    sinks.commit_watermarks(spark, path, {"a": (fact("07"), "ts"), "b": (fact("06").limit(0), "ts")})
    assert sinks.read_watermarks(spark, path) == {"a": "2024-01-07 10:00:00", "b": "2024-01-06 10:00:00"}
    # a version that was never finished has no success marker and does not count
    spark.sql("SELECT 'a' AS table_name, 'junk' AS watermark").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{path}/version=3")
    assert sinks.read_watermarks(spark, path)["a"] == "2024-01-07 10:00:00"
    sinks.commit_watermarks(spark, path, {"b": (fact("08"), "ts")})
    assert sinks.read_watermarks(spark, path) == {"a": "2024-01-07 10:00:00", "b": "2024-01-08 10:00:00"}


COMPACT_KEYS = ["category", "module", "instance_name", "year", "month", "day"]


def _small_silver(spark, path, values):
    rows = ", ".join(f"({v}, 'c', 'm', '007', '2024', '01', '02')" for v in values)
    spark.sql(f"SELECT * FROM VALUES {rows} t(v, category, module, instance_name, year, month, day)").coalesce(1).write.mode("append").partitionBy(*COMPACT_KEYS).parquet(path)


def test_compaction_keeps_a_file_that_arrives_meanwhile(spark, monkeypatch):
    path = new_path(spark, "compact")
    for values in ((1, 2), (2, 3)):
        _small_silver(spark, path, values)
    dedupe = snapshots.dedupe_exact

    def late(df):
        _small_silver(spark, path, (9,))  # lands after the files of this run were chosen
        return dedupe(df)

    monkeypatch.setattr(snapshots, "dedupe_exact", late)
    first = snapshots.compact_partitions(spark, path, new_path(spark, "staging"), COMPACT_KEYS, "2024-02-01").collect()
    monkeypatch.undo()
    assert [(r.status, r.files_read, r.raw_rows, r.written_rows, r.files_deleted) for r in first] == [("compacted", 2, 4, 3, 2)]
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3, 9]
    run = lambda: snapshots.compact_partitions(spark, path, new_path(spark, "staging"), COMPACT_KEYS, "2024-02-01").collect()
    assert [(r.files_read, r.written_rows) for r in run()] == [(2, 4)]
    assert run() == []
    folders = {f.rsplit("/", 1)[0].split(path.removeprefix("file:"))[-1] for f in spark.read.parquet(path).inputFiles()}
    assert folders == {"/category=c/module=m/instance_name=007/year=2024/month=01/day=02"}


def test_nothing_is_clamped(spark):
    assert calendar.month_spine(spark, "2024-01-31", 36).count() == 36
    for value in (0, -3):
        with pytest.raises(ValueError, match="positive"):
            calendar.month_spine(spark, "2024-01-31", value)
        with pytest.raises(ValueError, match="positive"):
            calendar.window_predicate("x", "2024-01-31", days=value)


def test_plans_with_large_sides(spark, sources):
    """With broadcast by size off: two lookups for the products, the bounded table of hot keys alone is broadcast, and details are read for one item."""
    from checks.adapters import AS_OF
    from fleetlens.plans import consumption

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = consumption.eligible_events(sources.object_events, AS_OF)
        plan = consumption.match_products(events, sources.catalog)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "collect_list" not in plan and plan.count("BroadcastHashJoin") == 3 and plan.count("TakeOrderedAndProject(limit=1000") >= 1
        asset = inventory.asset_detail(sources.asset_catalog, sources.object_events, "x", sources.inventory.withColumn("object_type", F.lit("dataset")))._jdf.queryExecution().executedPlan().toString()
        assert asset.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_skipped_types_are_named(spark, sources):
    found = {(r.type, r.reason) for r in inventory.skipped_types(spark, sources.asset_tables, sources.product_tables).collect()}
    assert ("knowledge_bank", "absent") in found and ("managed_folder", "lacks managed_folders_params_connection, managed_folders_type") in found
    assert "dataset" not in {t for t, _ in found} and len(found) == 6


def test_contracts(spark):
    from fleetlens.plans.contracts import Contracts

    registry = Contracts({("a", "m", None): ["x", "y"], ("a", "m", "v"): ["y", "z"], ("a", "w", None): []})
    assert registry.required("a", "m") == ["x", "y"]
    assert registry.required("a", "n", base=("a", "m"), variant="v") == ["x", "y", "z"]
    assert registry.required("a", "n", base=("q", "m"), variant="v") is None
    assert registry.required("a", "w") == [] and registry.required("b", "m") is None


def test_gold_run_keeps_watermarks_back(spark):
    root = new_path(spark, "gold")
    fact = gold.TableSpec("f", lambda t: spark.sql("SELECT 'a' AS instance_name, TIMESTAMP'2024-01-05 10:00:00' AS ts"), time_column="ts")
    optional, needed = (gold.TableSpec(n, lambda t: spark.sql("SELECT * FROM no_such_table"), required=r) for n, r in (("o", False), ("r", True)))
    run = gold.publish(spark, [fact, needed], root)
    assert not run.committed and set(run.failed) == {"r"} and sinks.read_watermarks(spark, f"{root}/_state") == {}
    run = gold.publish(spark, [fact, optional], root)
    assert run.committed and set(run.failed) == {"o"} and sinks.read_watermarks(spark, f"{root}/_state") == {"f": "2024-01-05 10:00:00"}


def test_silver_reads(spark):
    base = new_path(spark, "silver")
    assert tables.read_silver(spark, base, "c", "m") is None
    spark.sql("SELECT 1 AS a, 2024 AS year, 1 AS month, 2 AS day, 'event_mapping' AS category, 'm' AS module").write.partitionBy("category", "module", "year", "month", "day").parquet(base)
    assert tables.read_silver(spark, base, "event_mapping", "m").first().partition_date == dt.date(2024, 1, 2)
    with pytest.raises(ValueError, match="no 'extras'"):
        tables.read_event_module(spark, base, "m")


def test_latest_is_idempotent(sources):
    once = latest_by_partition(sources.inventory, ["project_key", "object_key"])
    assert sorted(map(str, latest_by_partition(once, ["project_key", "object_key"]).collect())) == sorted(map(str, once.collect()))


def test_count_helpers(spark):
    df = spark.sql("SELECT * FROM VALUES ('a','x','1'),('a','x',NULL),('a','y','1'),('b',NULL,'2') t(k,u,p)")
    rows = {r.k: (r.events, r.users, r.projects) for r in count_with_distincts(df, ["k"], {"users": "u", "projects": "p"}).collect()}
    assert rows == {"a": (3, 2, 1), "b": (1, 0, 1)}
    merged = merge_single_rows(spark.sql("SELECT 1 AS a"), spark.sql("SELECT 'x' AS b")).first()
    assert (merged.a, merged.b) == (1, "x")
