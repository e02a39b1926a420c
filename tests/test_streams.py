"""Streams: any order, batch size and delay gives the batch result; a retried batch counts once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.activity import user_activity_daily, user_activity_hourly
from fleetlens.sources.scratch import new_path
from fleetlens.streaming import ingest, partials


@pytest.fixture(scope="module")
def events(spark):
    """400 events over ten days; some without time, instance or with an empty one."""
    return spark.createDataFrame(
        [
            (
                i, {0: None, 1: "", 2: "007"}.get(i % 7, "b"),
                None if i % 50 == 3 else dt.datetime(2024, 3, 1) - dt.timedelta(days=i % 10, hours=i % 5),
                "generic", "USER_FROM_UI", f"u{i % 3}", "view",
            )
            for i in range(400)
        ],
        "id long, instance_name string, timestamp timestamp, topic string, message_authSource string, message_authUser string, message_msgType string",
    )


def expected(events):
    hourly = user_activity_hourly(events.withColumn("instance_name", F.nullif("instance_name", F.lit(""))))
    return hourly, user_activity_daily(hourly)


def texts(frame, columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


def as_stream(spark, parts, schema):
    """A stream that gives one part per micro-batch."""
    path = new_path(spark, "source")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 7])
def test_hours_are_added_up_and_folded(spark, events, batches):
    silver, fact = new_path(spark, "silver"), new_path(spark, "fact")
    write = ingest.hourly_activity_writer(silver, fact)
    hourly, _ = expected(events)
    for number in range(batches):
        part = events.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == number)
        for _ in range(2):  # a retried batch changes nothing
            write(part, number)
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)
    folds = ingest.fold_hours(spark, fact, width=2)
    assert folds == (0 if batches == 1 else 4)
    counted = partials.parts(spark, fact)
    assert max(p.last for p in counted) == batches - 1 and len(counted) <= 3
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)
    day = ingest.read_hours(spark, fact, "p_year = '2024' AND p_month = '2' AND p_day = '25'")
    assert {r.timestamp.date() for r in day.collect()} == {dt.date(2024, 2, 25)}
    # the newest batch is tried again after the fold
    write(events.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == batches - 1), batches - 1)
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)
    assert ingest.read_batches(spark, silver, events.schema).count() == 400


def test_a_fold_that_stops_counts_each_batch_once(spark, events, monkeypatch):
    silver, fact = new_path(spark, "silver"), new_path(spark, "fact")
    write = ingest.hourly_activity_writer(silver, fact)
    hourly, _ = expected(events)
    for number in range(3):
        write(events.filter(F.col("id") % 3 == number), number)
    real = partials.write_part
    # stops before the fold is complete: the marker is missing
    def cut_off(rows, store, part, time_column):
        real(rows, store, part, time_column)
        fs, marker = partials.files_at(spark, f"{store}/{part.folder}/_SUCCESS")
        fs.delete(marker, False)
        raise RuntimeError("stopped")

    monkeypatch.setattr(partials, "write_part", cut_off)
    with pytest.raises(RuntimeError):
        ingest.fold_hours(spark, fact, width=2)
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)
    monkeypatch.undo()
    # stops before the folded parts are deleted
    monkeypatch.setattr(partials, "clean", lambda *_: 0)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(partials, "write_part", lambda *a: (real(*a), (_ for _ in ()).throw(RuntimeError("stopped"))))
        with pytest.raises(RuntimeError):
            ingest.fold_hours(spark, fact, width=2)
    assert len(partials._complete(spark, fact)) == 4 and len(partials.parts(spark, fact)) == 2
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)
    monkeypatch.undo()
    assert partials.clean(spark, fact) == 2
    assert texts(ingest.read_hours(spark, fact), hourly.columns) == texts(hourly, hourly.columns)


def test_an_hourly_batch_reads_only_itself(spark, events, monkeypatch):
    silver, fact = new_path(spark, "silver"), new_path(spark, "fact")
    write = ingest.hourly_activity_writer(silver, fact)
    write(events, 0)
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("a batch read what is stored")))
    write(events.filter("id < 10"), 1)


def test_touched_days_are_rebuilt_once_and_survive_a_stop(spark, events, monkeypatch):
    silver, fact = new_path(spark, "silver"), new_path(spark, "fact")
    _, daily = expected(events)
    parts = [events.filter(F.col("id") % 4 == n) for n in range(4)]
    write = ingest.touched_days_writer(silver)
    write(parts[0], 0)
    write(parts[0], 0)
    # stopped between batches: nothing is rebuilt yet, the log stays
    write(parts[1], 1)
    assert not ingest.files_at(spark, fact)[0].exists(ingest.files_at(spark, fact)[1])
    builds = []

    def build(rows):
        builds.append(rows)
        return user_activity_daily(user_activity_hourly(rows))

    for number in (2, 3):
        write(parts[number], number)
    assert len(ingest.rebuild_touched(spark, silver, events.schema, fact, build)) == 4 and len(builds) == 1
    assert texts(spark.read.parquet(fact), daily.columns) == texts(daily, daily.columns)
    assert ingest.rebuild_touched(spark, silver, events.schema, fact, build) == [] and len(builds) == 1
    # a row years late touches its day alone
    late = events.filter("id = 4").withColumn("timestamp", F.lit("2020-01-01 05:00:00").cast("timestamp"))
    write(late, 4)
    monkeypatch.setattr(ingest, "LISTED_DAYS", 0)  # found by join and not by list
    ingest.rebuild_touched(spark, silver, events.schema, fact, build)
    both = expected(events.unionByName(late))[1]
    assert texts(spark.read.parquet(fact), daily.columns) == texts(both, daily.columns)


def test_a_stream_of_late_data(spark, events):
    silver, fact, checkpoint = (new_path(spark, n) for n in ("silver", "fact", "checkpoint"))
    _, daily = expected(events)
    stream = as_stream(spark, [events.filter(F.col("id") % 3 == n) for n in range(3)], events.schema)
    for _ in range(2):  # the second run has nothing to do
        ingest.run_late_data(stream, silver, fact, checkpoint)
    assert texts(spark.read.parquet(fact), daily.columns) == texts(daily, daily.columns)


def test_first_deliveries_at_any_delay(spark, events):
    """Twenty batches over the same days, every event delivered in three of them; missing keys are one key."""
    keyed = events.withColumn("key", F.when(F.col("id") % 40 != 5, F.col("id"))).select("key", "timestamp", "instance_name")
    parts = [keyed.filter(F.pmod(F.xxhash64("key"), F.lit(10)) == n) for n in range(10)]
    rounds = [a.unionByName(b) for a, b in zip(parts, parts[1:] + parts[:1])] + parts[::-1]
    store, checkpoint = new_path(spark, "store"), new_path(spark, "checkpoint")
    query = ingest.store_first_deliveries(as_stream(spark, rounds, keyed.schema), ["key"], store, checkpoint)
    keys = [r.key for r in spark.read.schema(keyed.schema).parquet(store).collect()]
    assert sorted(keys, key=str) == sorted({None, *range(400)} - set(range(5, 400, 40)), key=str)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 20 and sum(p["numInputRows"] for p in progress) == 1200
    state = progress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] == 391 and any("rocksdb" in name for name in state["customMetrics"])
    # a restart goes on from the state
    ingest.store_first_deliveries(as_stream(spark, parts[:1], keyed.schema), ["key"], new_path(spark, "store"), new_path(spark, "checkpoint"))


def test_first_deliveries_within_a_bound(spark, events):
    rows = events.filter("timestamp IS NOT NULL").select("id", "timestamp")
    store = new_path(spark, "store")
    stream = as_stream(spark, [rows, rows], rows.schema)
    ingest.run_available(ingest.first_deliveries(stream, ["id"], "30 days"), store, new_path(spark, "checkpoint"))
    assert spark.read.schema(rows.schema).parquet(store).count() == rows.count()
