"""Incremental builds read the days they need; files are chosen by their place in the log."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from fleetlens.plans import gold
from fleetlens.sources import audit, sinks, tables
from fleetlens.sources.scratch import new_path

FLAT = "id long, instance_name string, timestamp timestamp, topic string, message_authSource string, message_authUser string, message_msgType string, message_projectKey string"


def audit_rows(spark, days):
    rows = [
        (i, f"i{i % 2}", dt.datetime(2024, 3, day, i % 24), "generic", "USER_FROM_UI", f"u{i % 5}", "application-open" if i % 4 == 0 else "save", f"P{i % 3}")
        for day in days
        for i in range(48)
    ]
    return spark.createDataFrame(rows, FLAT)


def texts(frame):
    return sorted(str(r) for r in frame.select(sorted(frame.columns)).collect())


def local(path):
    return path.removeprefix("file:")


def test_second_run_opens_the_lookback_only(spark):
    base, root, whole = (new_path(spark, n) for n in ("silver", "gold", "gold"))
    silver = lambda: {"audit_flat": tables.read_silver(spark, base, "audit", "flat")}
    sinks.write_silver(audit_rows(spark, range(1, 11)), base, "audit", "flat")
    first = gold.publish(spark, gold.gold_specs(spark, silver()), root)
    assert first.committed and set(first.low.values()) == {None}
    sinks.write_silver(audit_rows(spark, [11, 12]), base, "audit", "flat")
    # files of days before the lookback become unreadable, in silver and in the facts that others are made of
    old = [p for day in range(1, 7) for p in glob.glob(f"{local(base)}/**/day={day:02d}/*.parquet", recursive=True)]
    old += [p for day in range(1, 7) for p in glob.glob(f"{local(root)}/fact_user_activity_hourly/**/p_day={day}/*.parquet", recursive=True)]
    kept = {p: open(p, "rb").read() for p in old}
    specs = gold.gold_specs(spark, silver())  # the schema comes from footers
    for p in old:
        with open(p, "wb") as f:
            f.write(b"junk")
        crc = os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    run = gold.publish(spark, specs, root)
    assert run.committed and not run.failed and set(run.low.values()) == {dt.date(2024, 3, 7)}
    for p, data in kept.items():
        with open(p, "wb") as f:
            f.write(data)
    full = gold.publish(spark, gold.gold_specs(spark, silver()), whole)
    for name, table in full.tables.items():
        assert texts(spark.read.parquet(f"{root}/{name}").select(table.columns)) == texts(table), name


def test_days_prune_the_scan(spark):
    base = new_path(spark, "silver")
    sinks.write_silver(audit_rows(spark, [1, 2, 3]), base, "audit", "flat")
    specs = {s.name: s for s in gold.gold_specs(spark, {"audit_flat": tables.read_silver(spark, base, "audit", "flat")})}
    plan = specs["fact_user_activity_hourly"].since({}, dt.date(2024, 3, 2))._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "make_date" in filters and "year" in filters and "day" in filters
    days = tables.from_day(tables.read_silver(spark, base, "audit", "flat"), dt.date(2024, 3, 2)).select("partition_date").distinct().collect()
    assert {r.partition_date.day for r in days} == {2, 3}


def test_late_rows_within_the_lookback_are_counted(spark):
    base, root = new_path(spark, "silver"), new_path(spark, "gold")
    silver = lambda: {"audit_flat": tables.read_silver(spark, base, "audit", "flat")}
    sinks.write_silver(audit_rows(spark, [1, 5]), base, "audit", "flat")
    gold.publish(spark, gold.gold_specs(spark, silver()), root)
    sinks.write_silver(audit_rows(spark, [3]), base, "audit", "flat")
    run = gold.publish(spark, gold.gold_specs(spark, silver()), root)
    full = gold.publish(spark, gold.gold_specs(spark, silver()), new_path(spark, "gold"))
    assert run.low["fact_user_activity_daily"] == dt.date(2024, 3, 2)
    for name, table in full.tables.items():
        assert texts(run.tables[name]) == texts(table), name


def test_boundary_file(spark):
    path = new_path(spark, "audit")
    fs, folder = sinks.files_at(spark, path)
    known = set()
    for day, names in (("2024-01-01", ["old"]), ("2024-01-17", ["boundary"]), ("2024-01-25", ["new", "newer"])):
        for name in names:
            spark.range(1).select(F.lit("2024-01-21 00:00:00").alias("timestamp"), F.lit(name).alias("topic")).coalesce(1).write.mode("append").json(path)
        for status in fs.listStatus(folder):
            if status.getPath().getName() not in known:
                fs.setTimes(status.getPath(), int(dt.datetime.fromisoformat(f"{day}T00:00:00+00:00").timestamp() * 1000), -1)
                known.add(status.getPath().getName())
    read = lambda cursor: sorted(r.topic for r in audit.select_files_since(spark, path, cursor).collect())
    assert read("2024-01-20") == ["boundary", "new", "newer"]
    assert read("2024-01-10") == ["boundary", "new", "newer", "old"]
    assert read("2023-12-01") == ["boundary", "new", "newer", "old"]
    # a file of the cursor's own moment is not an older one
    spark.range(1).select(F.lit("2024-02-21 00:00:00").alias("timestamp"), F.lit("x").alias("topic")).coalesce(1).write.mode("append").json(path)
    assert read("2024-02-20") == ["x"]
