"""Relations between operators, brute-force checks under skew, and plan shapes."""

import random

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.adapters import AS_OF
from fleetlens.functions.rollup import latest
from fleetlens.plans import consumption as con
from fleetlens.plans import development as dev


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_preserves_rows(sources):
    assert sources.compute("enriched").count() == sources.dev_events.count() == sources.audit.count()


def test_parts_add_up(sources):
    total = con.consumption_totals(sources.matched).first().events
    assert total == con.consumption_daily(sources.matched).agg(F.sum("value")).first()[0]
    assert total == con.consumption_by_type(sources.spark, sources.matched).agg(F.sum("events")).first()[0]
    diagnostics = con.match_diagnostics(sources.object_events, sources.catalog, AS_OF).first()
    assert diagnostics.matched_events == total == diagnostics.exact_matches + diagnostics.fallback_matches
    assert diagnostics.eligible_events == diagnostics.matched_events + diagnostics.unmatched_events


def test_salting_changes_nothing(sources):
    events = con.eligible_events(sources.object_events, AS_OF)
    plain, salted, split = (con.match_products(events, sources.catalog, salts=n, hot_rows=least) for n, least in ((1, 1), (7, 10_000), (7, 5)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect())) == sorted(map(str, split.collect()))


def test_a_key_of_many_projects(spark):
    """One key with 100 000 projects and a third of the events, null keys and blank projects, against Python."""
    many = 100_000
    products = spark.range(many).select(
        F.concat(F.lit("id"), "id").alias("product_id"), F.lit("i").alias("instance_name"), F.concat(F.lit("P"), "id").alias("project_key"),
        F.lit("dashboard").alias("product_type"), F.lit("hot").alias("product_key"), F.lit("n").alias("product_name"), F.lit("o").alias("owner_login"),
    )
    lone = products.limit(1).withColumns({"product_id": F.lit("lone"), "project_key": F.lit(None).cast("string"), "product_key": F.lit("cold")})
    third = F.col("id") % 3
    events = spark.range(30_000).select(
        F.col("id").alias("n"), F.when(third < 2, F.lit("I ")).alias("instance_name"), F.concat(F.lit("p"), (F.col("id") * 7).cast("string")).alias("project_key"),
        F.lit("dashboard").alias("object_type"), F.when(third == 0, "hot").otherwise("cold").alias("object_key"),
    )
    for options in ({"salts": 1}, {"salts": 4, "hot_rows": 100}):
        matched = con.match_products(events, products.unionByName(lone), **options)
        expected = {}
        for n in range(30_000):
            kind, product = ("exact", f"id{7 * n}") if n % 3 == 0 and 7 * n < many else ("fallback", "lone") if n % 3 == 1 else ("unmatched", None)
            expected[n] = (kind, product)
        assert {r.n: (r.match_type, r.product_id) for r in matched.collect()} == expected and matched.count() == 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Object events where one object and one login hold most rows."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{rng.randrange(40)}"
        login = "service" if rng.random() < 0.5 else f"u{rng.randrange(25)}"
        rows.append((f"2024-01-{rng.randrange(1, 30):02d} {rng.randrange(24):02d}:00:00", "i", rng.choice(["P", None]), "dashboard", key, login))
    df = spark.createDataFrame(rows, "ts string, instance_name string, project_key string, object_type string, object_key string, login string")
    return rows, df.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")


def test_milestones_against_brute_force(skewed):
    rows, df = skewed
    expected = {}
    for ident in {r[1:5] for r in rows}:
        mine = sorted((r[0], r[5]) for r in rows if r[1:5] == ident)
        days = sorted({t[:10] for t, _ in mine})
        upto = {d: [(t, u) for t, u in mine if t[:10] <= d] for d in days}
        multi = next((d for d in days if len({u for _, u in upto[d]}) >= 2), None)
        repeat = next((d for d in days if len(upto[d]) >= 5), None)
        expected[ident] = (mine[0][0], multi, repeat)
    got = {
        (r.instance_name, r.project_key, r.object_type, r.object_key): (str(r.first_consumption_at), r.multi_user_at and str(r.multi_user_at), r.repeat_use_at and str(r.repeat_use_at))
        for r in con.product_milestones(con.consumption_grain(df)).collect()
    }
    assert got == expected


def test_matching_against_brute_force(spark, skewed):
    rows, df = skewed
    products = [("i", "P", "hot"), ("i", "P", "k1"), ("i", "Q", "k1"), ("i", None, "k2"), ("I ", " p ", "k3")]
    catalog = spark.createDataFrame(
        [(f"id{n}", i, p, "dashboard", k, k, None) for n, (i, p, k) in enumerate(products)],
        "product_id string, instance_name string, project_key string, product_type string, product_key string, product_name string, owner_login string",
    )
    norm = lambda v: (v or "").strip().lower() or None
    counts: dict = {}
    for _, inst, project, _, key, _ in rows:
        exact = [n for n, (i, p, k) in enumerate(products) if (norm(i), norm(p), norm(k)) == (norm(inst), norm(project), norm(key))]
        loose = [n for n, (i, p, k) in enumerate(products) if (norm(i), norm(k)) == (norm(inst), norm(key))]
        kind = "exact" if exact else "fallback" if len(loose) == 1 else "unmatched"
        found = exact or (loose if len(loose) == 1 else [None])
        counts[(kind, found[0])] = counts.get((kind, found[0]), 0) + 1
    got = {(r.match_type, r.product_id and int(r.product_id[2:])): r.n for r in con.match_products(df, catalog, salts=4).groupBy("match_type", "product_id").agg(F.count("*").alias("n")).collect()}
    assert got == counts


def test_latest_limits_groups_before_the_shuffle(sources):
    plan = plan_of(latest(sources.inventory, ["object_key"], [F.col("run_ts").desc()]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(sources):
    plan = sources.enriched.transform(lambda e: dev.dev_by_capability(e, AS_OF))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,capability:string>" in plan


def test_rankings_do_not_sort_everything(sources):
    assert "TakeOrderedAndProject" in plan_of(dev.dev_top_users(sources.enriched, AS_OF))


ONLINE = ["development", "users", "inventory"]


@pytest.mark.parametrize("name", [n for g in ONLINE for n in __import__(f"checks.cases_{g}", fromlist=["QUERIES"]).QUERIES])
def test_no_cross_or_nested_loop_join(spark, sf_dir, name):
    plan = plan_of(registry.merged("QUERIES")[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan  # no Python worker anywhere


def test_one_unit_per_column_against_medians(spark):
    """Groups of mixed magnitudes, even and odd in number, junk, nulls, a null group, long and double columns."""
    from statistics import median

    from fleetlens.operators.normalize import cast_datetime_columns

    rng, rows = random.Random(3), []
    for group in range(40):
        scales = rng.sample([1, 10**3, 10**6, 10**9], rng.randrange(1, 4))
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), group or None, rng.choice([None, rng.randrange(10**9, 2 * 10**9) * rng.choice(scales) + rng.choice([0, 0, 1])])))
    df = spark.createDataFrame([(n, g, v, v and float(v), f" {v} " if v else "junk") for n, g, v in rows], "n int, g int, a long, b double, c string")
    expected = {}
    for n, group, value in rows:
        values = [float(v) for _, g, v in rows if g == group and v is not None]
        middle = median(values) if values else 10**12
        unit = 10**9 if middle >= 1e18 else 10**6 if middle >= 1e15 else 10**3 if middle >= 1e12 else 1
        expected[n] = None if value is None or value / unit > 9_223_372_036 else value // unit
    out = cast_datetime_columns(df, ["a", "b", "c", "absent"], ["g"])
    assert out.columns == df.columns
    seconds = out.select("n", *[F.unix_timestamp(c).alias(c) for c in "abc"]).collect()
    assert {r.n: r.a for r in seconds} == expected == {r.n: r.c for r in seconds}
    assert all(r.b == expected[r.n] for r in seconds if rows[r.n][2] is None or rows[r.n][2] < 2**53)
    assert cast_datetime_columns(df.limit(0), ["a", "c"], ["g"]).count() == 0


def test_readable_texts_leave_no_epochs(spark):
    from fleetlens.operators.normalize import cast_datetime_columns

    df = spark.createDataFrame([(1, "2024-01-01 10:00:00.7"), (1, "1704103200"), (1, "17041032"), (1, ""), (2, "1704103200000"), (2, "17"), (2, "x")], "g int, t string")
    texts = lambda mixed: [str(r.t) for r in cast_datetime_columns(df.coalesce(1), ["t"], ["g"], mixed=mixed).select("g", F.col("t").cast("string")).orderBy("g", F.desc("t")).collect()]
    # The median of 17 and 1704103200000 is below 10^12, so group 2 counts seconds and the larger one is out of range.
    assert texts(False) == ["2024-01-01 10:00:00", "None", "None", "None", "1970-01-01 00:00:17", "None", "None"]
    assert texts(True) == ["2024-01-01 10:00:00", "2024-01-01 10:00:00", "None", "None", "2024-01-01 10:00:00", "None", "None"]
