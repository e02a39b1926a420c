"""Compaction: readers see the files before a run or after it, whatever a run has got done when it stops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import snapshots
from fleetlens.sources.scratch import new_path

KEYS = ["category", "module", "instance_name", "year", "month", "day"]
SCHEMA = "v int"


def add(spark, path, values, day="02", instance="a b+c"):
    rows = ", ".join(f"({v}, 'c', 'm', '{instance}', '2024', '01', '{day}')" for v in values)
    spark.sql(f"SELECT * FROM VALUES {rows} t(v, category, module, instance_name, year, month, day)").coalesce(1).write.mode("append").partitionBy(*KEYS).parquet(path)


def compact(spark, path, **more):
    return snapshots.compact_partitions(spark, path, new_path(spark, "staging"), KEYS, "2024-02-01", schema=SCHEMA, **more).collect()


def seen(spark, path):
    return sorted(r.v for r in snapshots.read_snapshot(spark, path, KEYS, SCHEMA).collect())


class Stopped(Exception):
    pass


@pytest.fixture
def table(spark):
    path = new_path(spark, "table")
    for day in ("02", "03"):
        for values in ((1, 2), (2, 3)):
            add(spark, path, values, day)
    return path


BEFORE, AFTER = [1, 1, 2, 2, 2, 2, 3, 3], [1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("step, stops, sees", [(1, "before", BEFORE), (1, "after", BEFORE), (2, "before", BEFORE), (2, "after", AFTER), (3, "before", AFTER), (3, "after", AFTER)])
def test_readers_see_old_or_new_whenever_a_run_stops(spark, table, monkeypatch, step, stops, sees):
    """A run writes the manifest three times: pending, the commit, and done."""
    real, written = snapshots.write_manifest, []

    def write(*args, **kwargs):
        written.append(1)
        if len(written) == step and stops == "before":
            raise Stopped
        out = real(*args, **kwargs)
        if len(written) == step:
            raise Stopped
        return out

    monkeypatch.setattr(snapshots, "write_manifest", write)
    with pytest.raises(Stopped):
        compact(spark, table)
    monkeypatch.undo()
    assert seen(spark, table) == sees
    snapshots.recover(spark, table, KEYS)
    state = snapshots.read_manifest(spark, table)
    assert (state.pending, state.replaced) == ((), ()) and seen(spark, table) == sees
    compact(spark, table)
    assert seen(spark, table) == AFTER == sorted(r.v for r in spark.read.parquet(table).collect())


def test_a_reader_that_lists_during_a_commit_lists_again(spark, table, monkeypatch):
    real, calls = snapshots.read_manifest, []

    def read(session, path):
        out = real(session, path)
        calls.append(out.version)
        if len(calls) == 1:  # a whole run passes between this look and the listing
            monkeypatch.undo()
            compact(spark, table)
            monkeypatch.setattr(snapshots, "read_manifest", read)
        return out

    monkeypatch.setattr(snapshots, "read_manifest", read)
    assert seen(spark, table) == AFTER and len(calls) == 4


def test_files_of_different_content_keep_their_sources(spark, table, monkeypatch):
    monkeypatch.setattr(snapshots, "dedupe_exact", lambda df: df.dropDuplicates().withColumn("v", F.when(F.col("day") == "03", F.col("v") + 1).otherwise(F.col("v")).cast("int")))
    found = {r.partition.rsplit("=", 1)[1]: (r.status, r.files_written, r.files_deleted) for r in compact(spark, table)}
    assert found == {"02": ("compacted", 1, 2), "03": ("failed", 0, 0)}
    assert seen(spark, table) == [1, 1, 2, 2, 2, 3, 3]


def test_a_lone_file_is_compacted_once(spark):
    path = new_path(spark, "table")
    add(spark, path, (1, 1, 1, 2))
    assert [(r.files_read, r.raw_rows, r.written_rows) for r in compact(spark, path)] == [(1, 4, 2)]
    assert seen(spark, path) == [1, 2] and compact(spark, path) == []


def test_many_partitions_in_steps(spark, monkeypatch):
    path = new_path(spark, "table")
    for _ in range(2):
        rows = spark.range(90).select((F.col("id") % 3).cast("int").alias("v"), F.lit("c").alias("category"), F.lit("m").alias("module"), F.concat(F.lit("i"), F.col("id") % 9).alias("instance_name"),
                                      F.lit("2024").alias("year"), F.lit("01").alias("month"), F.lpad((F.col("id") % 10 + 1).cast("string"), 2, "0").alias("day"))
        rows.repartition(3).write.mode("append").partitionBy(*KEYS).parquet(path)
    whole = sorted({tuple(r) for r in snapshots.read_snapshot(spark, path, KEYS, SCHEMA).collect()})
    steps, real = [], snapshots.compact_step
    monkeypatch.setattr(snapshots, "compact_step", lambda *a: steps.append(len(a[4])) or real(*a))
    monkeypatch.setattr(snapshots, "LISTED_TOGETHER", 16)
    monkeypatch.setattr(snapshots, "BATCH_PARTITIONS", 40)
    met = snapshots.Scan()
    outcome = compact(spark, path, scan=met)
    assert steps == [40, 40, 10] and len(outcome) == 90 and {r.status for r in outcome} == {"compacted"}
    assert met.listed_folders == 90 and met.eligible == met.seen == sum(r.files_read for r in outcome)
    assert sorted(tuple(r) for r in snapshots.read_snapshot(spark, path, KEYS, SCHEMA).collect()) == whole


def test_listing_goes_no_further_than_asked(spark, table):
    for day in range(4, 29):
        add(spark, table, (1,), f"{day:02d}", instance="z")
    met = snapshots.Scan()
    found = list(snapshots.newest_partitions(spark, table, KEYS, "2024-01-28", 3, min_age_days=1, scan=met))
    assert [p.date.day for p in found] == [26, 25, 24] and met.listed_folders == 8
    assert (met.seen, met.too_recent, met.compacted, met.eligible) == (5, 2, 0, 3)
    assert [p.values[2] for p in snapshots.newest_partitions(spark, table, KEYS, "2024-02-01", 5, filters={"instance_name": "a b+c"})] == ["a b+c"] * 2
    assert next(snapshots.day_folders(spark, table, KEYS)).date == dt.date(2024, 1, 28)
    with pytest.raises(ValueError):
        next(snapshots.newest_partitions(spark, table, KEYS, "2024-02-01", 0))
