"""Cases of the third round of findings."""

import threading

from pyspark.sql import functions as F

from checks import adapters, cases_silver, registry
from checks.adapters import AS_OF
from fleetlens.operators import objects
from fleetlens.plans import consumption, dims, gold, inventory, users
from fleetlens.session import configure
from fleetlens.sources import snapshots
from fleetlens.sources.scratch import new_path


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_underutilized_accounts_are_not_cut_to_a_page(spark, sf_dir, sources):
    query = registry.merged("QUERIES")["creator_risk_underutilized"]
    assert "GlobalLimit" not in _plan(query(spark, sf_dir))
    listed = users.creator_risk(sources.users, sources.daily, AS_OF, "delinquent", page_size=None)
    assert listed.count() == users.creator_risk_totals(sources.users, sources.daily, AS_OF).first().delinquent_rows


def test_stored_tables_are_dealt_before_they_widen(spark, sf_dir, sources, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 20)
    rows = sources.table("events").count()
    assert sources.spread("audit").rdd.getNumPartitions() >= rows // 20  # tasks grow with the rows
    for name in ("object_events", "audit", "inventory"):
        plan = _plan(sources.compute(name))
        assert "Repartition " not in plan and "RepartitionByExpression [" in plan
    # Deliveries come from the driver rows, not from a stored copy of them.
    assert "props" in _plan(sources.compute("object_events"))


def test_events_are_deduplicated_before_they_are_described(sources):
    plan = _plan(sources.compute("object_events"))
    assert plan.index("Join LeftOuter") < plan.index("Window [")  # the capability is joined above the window


def test_a_repeated_category_of_a_dimension_repeats_no_event(spark, sources):
    caps = dims.dim_capability(spark)
    twice = caps.unionByName(caps.withColumn("capability", F.lit("zz")))
    silver = sources.object_silver
    once = objects.object_activity_events(spark, silver, twice)
    same = objects.object_activity_events(spark, silver, caps)
    assert once.exceptAll(same).isEmpty() and same.exceptAll(once).isEmpty()


def test_json_names_an_object_only_where_the_columns_do_not(spark):
    rows = [
        ("webapps", " ", None, '{"webappid": "w"}'),
        ("webapps", "own", None, '{"webappid": "w"}'),
        ("charts_dashboard", None, "d", '{"insightId": "i"}'),
        ("charts_dashboard", None, None, '{"insightId": "i"}'),
        ("datasets", None, None, '{"webappid": "w"}'),
    ]
    silver = spark.createDataFrame(rows, "module string, webappid string, dashboardid string, extras string")
    found = [(r.object_type, r.object_key) for r in objects.with_object_identity(silver).collect()]
    assert found == [("web_application", "w"), ("web_application", "own"), ("dashboard", "d"), ("insight", "i"), ("dataset", None)]


def test_json_lines_are_dealt_without_a_sort(sources):
    rows = cases_silver.dealt_lines(sources, 2)
    assert "RepartitionByExpression [event_id" in _plan(rows) and rows.rdd.getNumPartitions() == 4
    assert rows.count() == 2 * sources.audit_flat.count()


def test_compaction_stages_steps_together_and_commits_them_one_by_one(spark, monkeypatch):
    keys, path = ["module", "year", "month", "day"], new_path(spark, "table")
    for _ in range(2):
        rows = spark.range(12).selectExpr("id", "'m' AS module", "'2024' AS year", "'01' AS month", "lpad(id % 3 + 1, 2, '0') AS day")
        rows.coalesce(1).write.mode("append").partitionBy(*keys).parquet(path)
    met, stage, step, committed = threading.Barrier(3), snapshots.stage_step, snapshots.compact_step, []

    def staged(*args):
        met.wait(60)  # passes only if all three are at work
        return stage(*args)

    def commit(*args):
        committed.append((threading.current_thread() is threading.main_thread(), args[4][0].date.day))
        return step(*args)

    monkeypatch.setattr(snapshots, "BATCH_PARTITIONS", 1)
    monkeypatch.setattr(snapshots, "stage_step", staged)
    monkeypatch.setattr(snapshots, "compact_step", commit)
    outcome = snapshots.compact_partitions(spark, path, new_path(spark, "staging"), keys, "2024-02-01").collect()
    assert committed == [(True, 3), (True, 2), (True, 1)]
    assert [(r.status, r.files_read, r.raw_rows, r.written_rows) for r in outcome] == [("compacted", 2, 8, 4)] * 3
    assert sorted(r.id for r in snapshots.read_snapshot(spark, path, keys, "id long").collect()) == list(range(12))


def test_products_are_matched_once_per_object(sources, monkeypatch):
    real, given = consumption.match_products, []

    def match(rows, *args, **kwargs):
        given.append(rows)
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(consumption, "match_products", match)
    events = sources.object_events
    matched = consumption.matched_consumption(events, sources.catalog, AS_OF)
    consumption.match_diagnostics(events, sources.catalog, AS_OF)
    consumption.unmatched_by_type(events, sources.catalog, AS_OF)
    consumption.unmatched_sample(events, sources.catalog, AS_OF)
    keys = consumption.OBJECT_KEYS
    assert [rows.columns for rows in given] == [[*keys, "events"]] * 4  # no login and no day is carried through the lookups
    # The same rows as if each row of the grain had been matched, objects without a project included.
    grain = consumption.consumption_grain(consumption.eligible_events(events, AS_OF))
    each = real(grain, sources.catalog, salts=1).filter("product_id IS NOT NULL")
    assert matched.columns == each.columns and matched.filter("project_key IS NULL").count() > 0
    assert matched.exceptAll(each).isEmpty() and each.exceptAll(matched).isEmpty()


def test_the_json_of_an_event_is_read_once(sources):
    # Filters on what follows from it used to be pushed below the shuffle, with one parse per mention.
    for name in ("object_events", "audit", "audit_flat"):
        assert _plan(sources.compute(name)).count("get_json_object") == 1


def test_long_generated_methods_are_not_interpreted(spark):
    other = spark.newSession()
    configure(other)
    assert int(other.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000  # HotSpot compiles no longer ones


def test_typed_times_are_not_read_from_text_again(spark):
    names = ["instance_name", "project_key", "key", "name", "subtype", "owner_login", "last_modified_by_login", "created_at", "updated_at"]
    row = spark.createDataFrame([tuple(names)], names)
    typed = row.withColumns({c: F.timestamp_millis(F.lit(1702857600123) + F.length("key")) for c in ("created_at", "updated_at")})
    spec = inventory.PRODUCT_SPECS["dashboard"]
    assert "RLIKE" in _plan(inventory._branch(row, "dashboard", spec, "product"))
    out = inventory._branch(typed, "dashboard", spec, "product")
    assert "RLIKE" not in _plan(out) and out.first().created_at == typed.first().created_at


def test_gold_tables_are_written_together_and_after_what_they_need():
    met, seen = threading.Barrier(3), {}

    def build(name):
        def run(tables):
            if name in ("a", "b", "c"):
                met.wait(60)  # passes only if all three are at work
            seen[name] = sorted(tables)
            if name == "b":
                raise RuntimeError("boom")
            return name

        return run

    specs = [gold.TableSpec(n, build(n), needs) for n, needs in (("a", []), ("b", []), ("c", []), ("d", ["a", "c"]), ("e", ["b"]), ("f", ["e"]))]
    built, failed = gold.build_gold(specs, lambda name, df: df)
    assert list(built.items()) == [("a", "a"), ("c", "c"), ("d", "d")] and list(failed) == ["b", "e", "f"]
    assert {"a", "c"} <= set(seen["d"]) and not {"e", "f"} & seen.keys()
