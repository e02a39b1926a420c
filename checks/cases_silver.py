"""Normalisation, payloads, storage and streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from checks import cases_inventory, cases_users  # noqa: F401  (define shared sub-queries)
from checks.adapters import AS_OF
from checks.oracle import CTES, blank_null, sql
from checks.sources import INVENTORY_COLUMNS, Sources, stored_path
from fleetlens.functions import casts
from fleetlens.operators import activity, normalize, payloads
from fleetlens.operators.latest import INVENTORY_KEYS
from fleetlens.operators.licences import addon_flags
from fleetlens.plans import gold, licences
from fleetlens.plans.contracts import Contracts
from fleetlens.plans.dims import literal_table
from fleetlens.sources import audit as audit_src
from fleetlens.sources import sinks, snapshots, tables
from fleetlens.sources.scratch import new_path
from fleetlens.streaming import ingest

JSON_SCHEMA = audit_src.AUDIT_SCHEMA + ", instance_name string, event_id long"

# --- inputs ------------------------------------------------------------------------------


def lines(s: Sources) -> DataFrame:
    """Audit rows in their nested form, before flattening."""
    fields = ["msgType", "msgTypeBase", "authSource", "authUser", "projectKey", "scenarioId", "jobId"]
    message = F.struct(*[F.col(f"message_{f}").alias(f) for f in fields])
    return s.audit_flat.select("event_id", F.col("timestamp").cast("string").alias("timestamp"), "topic", "instance_name", message.alias("message"))


def dealt_lines(s: Sources, copies: int = 1) -> DataFrame:
    """Lines dealt over four files by hash: a round-robin would sort the nested lines first, and spill them."""
    rows = lines(s).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return rows.repartition(4, "event_id", "copy").drop("copy")


def json_path(s: Sources, copies: int = 1) -> str:
    """The same rows as JSON files, written once per session."""
    return stored_path(s, f"audit_json_{copies}", lambda path: dealt_lines(s, copies).write.json(path))


def write_silver(s: Sources, path: str) -> None:
    rows = s.audit.select("event_id", "timestamp", "authuser", "instance_name", F.lower(F.regexp_replace("activity_category", "[ -]", "_")).alias("module"), "extras")
    rows = rows.withColumn("instance_name", F.when(F.col("instance_name") == "inst_1", "007").otherwise(F.col("instance_name")))
    parts = {name: F.date_format("timestamp", pattern) for name, pattern in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))}
    rows = rows.withColumns({"category": F.lit("event_mapping"), **parts})
    for mode in ("overwrite", "append"):
        rows.hint("rebalance", *SILVER_KEYS).write.mode(mode).partitionBy(*SILVER_KEYS).parquet(path)


def silver_path(s: Sources) -> str:
    """Mapped events as a partitioned silver table (every row stored twice, in two files)."""
    return stored_path(s, "silver", lambda path: write_silver(s, path))


SILVER_KEYS = ["category", "module", "instance_name", "year", "month", "day"]
CTES["sil"] = """SELECT event_id, timestamp, authuser, CASE instance_name WHEN 'inst_1' THEN '007' ELSE instance_name END AS instance_name, lower(replace(replace(activity_category, ' ', '_'), '-', '_')) AS module, extras,
  CAST(timestamp AS DATE) AS d FROM audit"""


def mapping(s: Sources) -> DataFrame:
    rows = [("recipe-save", "Visual_Recipes"), ("sql-query-fetch", "coding"), ("mystery-event", "DROP_DELETE"), ("application-open", None)]
    return literal_table(s.spark, {"message_msgType": "string", "activity_category": "string"}, rows)


def unmapped(s: Sources) -> DataFrame:
    return s.audit.select(
        "event_id", F.lit("generic").alias("topic"), "timestamp", F.col("msgtype").alias("message_msgType"), F.col("authuser").alias("message_authUser"),
        F.when(F.col("authvia") != "", F.split("authvia", " ")).alias("message_authVia"), "instance_name",
    )


def raw_columns(s: Sources) -> DataFrame:
    return s.audit.select(
        F.col("event_id").alias("Event Id"), F.col("timestamp").cast("string").alias("timestamp"), F.concat(F.lit(" "), "activity_category").alias("activity_category"),
        F.col("project_key").alias("dataset_projectKey"), F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "no").alias("enabled"),
        F.col("event_id").cast("string").alias("size"), F.col("authvia").alias("call-path"), F.col("jobid").alias("jobId"), "run_ts",
    )


CTES["t_history"] = """SELECT event_id, timestamp, message_msgType, message_msgTypeBase, message_authUser, message_projectKey FROM audit_flat"""


def history(s: Sources) -> DataFrame:
    blank = F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.col("message_msgType"))
    return s.audit_flat.select(
        "event_id", F.struct(blank.alias("msgType"), F.col("message_msgTypeBase").alias("msgTypeBase")).alias("message"),
        F.struct(F.col("message_msgType").alias("msgType"), F.col("message_authUser").alias("authUser"), F.lit("generic").alias("auditTopic")).alias("clientEvent"),
        F.col("timestamp").alias("serverTimestamp"), F.col("message_projectKey").alias("projectkey"),
    )


def limits_oracle() -> str:
    n = "CAST(s_suppkey % 50 AS BIGINT)"
    none = "CAST(NULL AS BIGINT)"
    even = [("READER", n), ("FULL_DESIGNER", none), ("DESIGNER", none)]
    odd = [("READER", n), ("A_I_CONSUMERS", none), ("DESIGNER", n)]
    parts = [f"SELECT s_suppkey, instance_name, run_ts, '{p}' AS license_profile, {v} AS max_licenses FROM license_payload WHERE s_suppkey % 2 = {r}" for r, rows in ((0, even), (1, odd)) for p, v in rows]
    parts.append(f"SELECT s_suppkey, instance_name, run_ts, 'SUBLICENSE_READER', {n} FROM license_payload WHERE s_suppkey % 5 = 0")
    return " UNION ALL ".join(parts)


def rich_extras() -> Column:
    """Extras with a number, a boolean, an object and a key nobody lists; some rows are broken."""
    k = F.get_json_object("extras", "$.k")
    text = F.concat(F.lit('{"k":"'), k, F.lit('","n":'), F.col("event_id").cast("string"), F.lit(',"b":true,"o":{"z":1}}'))
    return F.when(F.col("event_id") % 50 == 7, F.lit("{broken")).otherwise(text)


RICH_REST = """concat('{"n":', CAST(event_id AS VARCHAR), ',"b":true,"o":{"z":1}}')"""


def extras_rows(s: Sources) -> DataFrame:
    k = F.get_json_object("extras", "$.k")
    column = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 30 == 1, "conflict")
    return s.audit.select("event_id", (F.col("event_id") % 10).alias("part"), column.alias("k"), rich_extras().alias("extras"))


def merged_extras(s: Sources) -> DataFrame:
    good, rejected = normalize.merge_extras_checked(extras_rows(s), ["k"], ["part"])
    return good.withColumn("target", F.lit("merged")).unionByName(rejected.withColumn("target", F.lit("rejected")))


def replayed(s: Sources) -> DataFrame:
    silver = s.audit.select("event_id", "timestamp", "msgtype", "msgtypebase", "activity_category", "instance_name", "run_ts", rich_extras().alias("extras"))
    rows, rejected = normalize.replay_event_mapping(silver, mapping(s), ["k"], ["event_id", "timestamp", "msgtype", "activity_category", "k"])
    broken = rejected.select(F.col("event_id").cast("string").alias("event_id"), "extras")
    return rows.withColumn("target", F.lit("silver")).unionByName(broken.withColumn("target", F.lit("rejected")), allowMissingColumns=True)


# --- storage ------------------------------------------------------------------------------------


def written_fact(s: Sources, since: str | None) -> DataFrame:
    """Two rounds: an older state of the fact, then an incremental rewrite."""
    path = new_path(s.spark, "fact")
    stale = s.daily.withColumn("viewing_actions_count", F.lit(0).cast("long"))
    sinks.write_fact_partitions(stale, path, "last_activity_at")
    sinks.write_fact_partitions(s.daily, path, "last_activity_at", since)
    return s.spark.read.parquet(path).select("day", "instance_name", "login_norm", "viewing_actions_count")


def single(s: Sources) -> DataFrame:
    path = new_path(s.spark, "single")
    sinks.write_single(s.max_latest, path)
    return s.spark.read.parquet(path).select("instance_name", "license_profile", "max_licenses")


def csv_table(s: Sources) -> DataFrame:
    path = new_path(s.spark, "csv")
    s.table("nation").unionByName(s.table("supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"), F.lit(1).alias("n_regionkey"))).write.option("header", "true").csv(path)
    return tables.read_csv_table(s.spark, path)


def committed(s: Sources) -> DataFrame:
    """Two commits: the second has one of the facts and an empty one, and takes nothing away."""
    path = new_path(s.spark, "state")
    sinks.commit_watermarks(s.spark, path, {"daily": (s.daily.filter("day < DATE '2024-01-10'"), "last_activity_at"), "opens": (s.mau_daily, "last_application_open_at")})
    sinks.commit_watermarks(s.spark, path, {"daily": (s.daily, "last_activity_at"), "opens": (s.mau_daily.limit(0), "last_application_open_at")})
    sinks.commit_watermarks(s.spark, path, {"daily": (s.daily.limit(0), "last_activity_at")}, failures=1)
    return s.spark.createDataFrame(sorted(sinks.read_watermarks(s.spark, path).items()), "table_name string, watermark string")


def bounded(s: Sources) -> DataFrame:
    marks = {r.table_name: r.watermark for r in committed(s).collect()}
    low = sinks.incremental_boundary(marks, "daily")
    rows = s.daily.filter(F.col("last_activity_at") >= F.lit(low).cast("timestamp"))
    return rows.agg(F.lit(low).alias("boundary"), F.count("*").alias("rows_to_rebuild"))


COMPACT_AS_OF = dt.datetime(2024, 1, 20)


def compaction_runs(s: Sources) -> str:
    """A first run, a late file in an old partition and a run for it, and a run with nothing to do; once per session."""

    def write(root: str) -> None:
        path = f"{root}/table"
        write_silver(s, path)
        for number, mode in enumerate(("first", "late", "idle")):
            if mode == "late":
                late = s.spark.read.parquet(path).filter("day = '05' AND instance_name = '007' AND module = 'coding'")
                late.withColumn("event_id", -F.col("event_id")).write.mode("append").partitionBy(*SILVER_KEYS).parquet(path)
            run = snapshots.compact_partitions(s.spark, path, f"{root}/staging/{number}", SILVER_KEYS, COMPACT_AS_OF, 1)
            sinks.compaction_summary(run).drop("files_written").withColumn("run", F.lit(number)).write.mode("append").parquet(f"{root}/runs")

    return stored_path(s, "compaction", write)


def compacted(s: Sources) -> DataFrame:
    rows = snapshots.read_snapshot(s.spark, f"{compaction_runs(s)}/table", SILVER_KEYS, "event_id long, timestamp timestamp, authuser string, extras string")
    return rows.groupBy("module", "instance_name", "year", "month", "day").agg(F.count("*").alias("n"))


def scanned(s: Sources) -> DataFrame:
    """The newest partitions to compact, before and after a compaction, with what the listing met on its way to the last."""
    out = None
    for state, path in (("raw", silver_path(s)), ("compacted", f"{compaction_runs(s)}/table")):
        met = snapshots.Scan()
        found = list(snapshots.newest_partitions(s.spark, path, SILVER_KEYS, dt.datetime(2024, 1, 25), 7, min_age_days=2, filters={"module": "coding"}, scan=met))
        rows = [(state, i, p.values[2], p.date, len(p.files), len(p.loose), met.seen, met.too_recent, met.compacted, met.eligible) for i, p in enumerate(found)]
        kind = "state string, position int, instance_name string, partition_date date, file_count int, loose_files int, files_seen int, files_too_recent int, files_compacted int, files_eligible int"
        frame = s.spark.createDataFrame(rows, kind)
        out = frame if out is None else out.unionByName(frame)
    return out


def compaction_outcome(s: Sources) -> DataFrame:
    return s.spark.read.parquet(f"{compaction_runs(s)}/runs")


def observed(s: Sources) -> DataFrame:
    seen = Observation("since")
    rows = audit_src.read_audit_json(s.spark, json_path(s), JSON_SCHEMA)
    rows = rows.withColumn("timestamp", F.when(F.col("event_id") % 97 == 0, "junk").otherwise(F.col("timestamp")))
    kept = audit_src.filter_since(rows, "2024-01-15", seen).groupBy("instance_name").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))
    found = kept.collect()  # one row per instance; the counts are known after this pass
    frame = s.spark.createDataFrame(found, kept.schema)
    return frame.withColumns({name: F.lit(value) for name, value in seen.get.items()})


def aged_files(s: Sources) -> DataFrame:
    """Files of three ages: all rows in files ten days older than the cursor, which are not read; the first rows in
    one three days older, which is; the others in files after the cursor."""

    def write(path: str) -> None:
        split = "2024-01-22 12:00:00"
        fs, folder = sinks.files_at(s.spark, path)
        done: set[str] = set()
        for day, rows in (("2024-01-10", lines(s).repartition(3)), ("2024-01-17", lines(s).filter(F.col("timestamp") < split).coalesce(1)), (None, lines(s).filter(F.col("timestamp") >= split).repartition(2))):
            rows.write.mode("append").json(path)
            for status in fs.listStatus(folder):
                if status.getPath().getName() not in done and day:
                    fs.setTimes(status.getPath(), int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp() * 1000), -1)
                done.add(status.getPath().getName())

    return audit_src.select_files_since(s.spark, stored_path(s, "aged_json", write), "2024-01-20", JSON_SCHEMA).select("event_id", "timestamp")


def gold_build(s: Sources) -> DataFrame:
    specs = [
        gold.TableSpec("b_opens", lambda t: activity.formal_mau_daily(s.mau_hourly)),
        gold.TableSpec("a_daily", lambda t: activity.user_activity_daily(s.hourly), order=1),
        gold.TableSpec("ratio", lambda t: t["a_daily"].groupBy("instance_name").count(), ["a_daily", "b_opens"]),
    ]
    built, failed = gold.build_gold(specs, lambda name, df: df)
    assert not failed, failed
    rows = None
    for position, name in enumerate(built):
        part = built[name].agg(F.count("*").alias("row_count")).select(F.lit(position).alias("position"), F.lit(name).alias("table_name"), "row_count")
        rows = part if rows is None else rows.unionByName(part)
    return rows


GOLD_SPLIT = "2024-01-20 00:00:00"  # what the first build sees
GOLD_INVENTORIES = [n for n in INVENTORY_COLUMNS if all(k == "project_key" or k in INVENTORY_COLUMNS[n] for k in INVENTORY_KEYS[n])]
GOLD_EVENTS = {"audit_flat": "timestamp", "dev_events": "timestamp", "object_events": "timestamp", "license_max": "run_ts", "users": "run_ts"}


def content(df: DataFrame) -> list[Column]:
    """Number of rows and an order-free digest of their contents."""
    cells = [F.round(F.col(c) * 1000).cast("long") if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cells])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("row_count"), F.sum(digest).cast("string").alias("digest")]


def gold_tables(s: Sources) -> DataFrame:
    """The wired build, twice: over what happened before a day, then incrementally over everything."""
    root, base = new_path(s.spark, "gold"), new_path(s.spark, "gold-silver")
    frames = {"audit_flat": s.audit_flat, "dev_events": s.audit, "object_events": s.object_silver.withColumnRenamed("module", "source_module"), "license_max": s.max_licenses, "users": s.users}
    inventories = {name: s.inventory_of(name) for name in GOLD_INVENTORIES}
    for early in (True, False):
        for name, rows in frames.items():
            moment = F.col(GOLD_EVENTS[name])
            part = rows.filter(moment < GOLD_SPLIT) if early else rows.filter(moment >= GOLD_SPLIT)
            sinks.write_silver(part.drop("partition_date"), base, "gold", name, GOLD_EVENTS[name])
        silver = {name: tables.read_silver(s.spark, base, "gold", name).drop("category", "module") for name in frames}
        silver["object_events"] = silver["object_events"].withColumnRenamed("source_module", "module")
        run = gold.publish(s.spark, gold.gold_specs(s.spark, inventories | silver), root)
        assert not run.failed and run.committed and all((day is None) == early for day in run.low.values()), (run.failed, run.low)
    marks, out = sinks.read_watermarks(s.spark, f"{root}/_state"), None
    for name, table in run.tables.items():
        table = table.drop("year", "month", "day") if name == "base_license_max" or name == "base_users" else table
        row = table.agg(*content(table)).select(F.lit(name).alias("table_name"), "row_count", "digest", F.lit(marks.get(name)).cast("timestamp").alias("watermark"))
        out = row if out is None else out.unionByName(row)
    return out


GOLD_FACTS = {  # table: (view, time column, columns)
    "fact_user_activity_hourly": ("hourly", "timestamp", "instance_name login project_key timestamp viewing_actions_count developing_actions_count"),
    "fact_user_activity_daily": ("daily", "last_activity_at", "day instance_name login_norm login viewing_actions_count developing_actions_count last_activity_at"),
    "fact_user_activity_project_daily": ("project_daily", "last_activity_at", "day instance_name login_norm project_key login viewing_actions_count developing_actions_count last_activity_at"),
    "fact_formal_mau_daily": ("mau_daily", "last_application_open_at", "day instance_name login_norm login application_open_count last_application_open_at"),
    "fact_dev_activity_events": (
        "dev_events", "timestamp",
        "activity_category activity_origin activity_origin_evidence authsource callpath has_job_marker has_scenario_marker instance_name login msgtype msgtypebase project_key run_timestamp timestamp",
    ),
    "fact_object_activity_events": (
        "obj_events", "timestamp",
        "canonical_capability details_json event_category event_name instance_name ip_address login object_key object_name object_type project_key run_timestamp timestamp",
    ),
    "fact_license_utilization_daily": ("lic_fact", "snapshot_date", "assigned_count available_count entitled_count instance_name license_profile run_ts snapshot_date utilization_pct"),
}


def gold_oracle() -> str:
    """Rows, digest and watermark of every table the build writes, from the same definitions in SQL."""

    def newest(rows: str, keys: list[str]) -> str:
        return f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY instance_name, {', '.join(keys)} ORDER BY run_ts DESC) = 1"

    base = ["instance_name", "project_key", "extras", "run_ts", "partition_date"]
    contents = {}
    for name in GOLD_INVENTORIES:
        columns = [f"{source} AS {out}" for out, source in INVENTORY_COLUMNS[name].items()]
        contents[f"base_{name}"] = (newest(f"SELECT {', '.join(base + columns)} FROM inventory", INVENTORY_KEYS[name]), [*base, *INVENTORY_COLUMNS[name]])
    contents["base_license_max"] = (newest("SELECT * FROM max_licenses", ["license_profile"]), "c_custkey instance_name license_profile max_licenses partition_date run_ts".split())
    accounts = "displayname email enabled userprofile resultinguserprofile groups sourcetype trialstatus_exists creationdate lastsessionactivity login".split()
    contents["base_users"] = (newest("SELECT * FROM users", ["users_login"]), ["user_id", "instance_name", "run_ts", "partition_date", *[f"users_{c}" for c in accounts]])
    contents["dim_capability"] = ("SELECT * FROM d_capability", "activity_category capability capability_order category_order capability_label category_label is_dev_activity".split())
    contents["dim_event_class"] = ("SELECT * FROM d_event_class", ["msgtype", "activity_class", "is_meaningful_activity"])
    contents |= {name: (f"SELECT * FROM {view}", columns.split()) for name, (view, _, columns) in GOLD_FACTS.items()}
    parts = []
    for name, (rows, columns) in contents.items():
        cells = ["CAST(round(utilization_pct * 1000) AS BIGINT)" if c == "utilization_pct" else c for c in sorted(columns)]
        text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cells)
        mark = f"CAST(max({GOLD_FACTS[name][1]}) AS TIMESTAMP)" if name in GOLD_FACTS else "CAST(NULL AS TIMESTAMP)"
        digest = f"CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT)) AS VARCHAR)"
        parts.append(f"SELECT '{name}' AS table_name, count(*) AS row_count, {digest} AS digest, {mark} AS watermark FROM ({rows})")
    return "\nUNION ALL ".join(parts)


AUDIT_CONTRACT = ["event_id", "timestamp", "msgtype", "authuser"]


def ingested(s: Sources) -> DataFrame:
    silver = new_path(s.spark, "ingest")
    ingest.ingest_audit(
        s.spark, json_path(s), silver, new_path(s.spark, "checkpoint"), mapping(s), AUDIT_CONTRACT, F.to_timestamp(F.lit("2024-02-01")), schema=JSON_SCHEMA, max_files=2
    )
    return s.spark.read.parquet(silver).select("instance_name", *AUDIT_CONTRACT, "extras", "module", "target")


def contracts_of(s: Sources) -> Contracts:
    rows = [("audit", "usage", None, i, c) for i, c in enumerate(["event_id", "timestamp", "project_key"])]
    rows += [("audit", "usage", "genai", i, c) for i, c in enumerate(["timestamp", "enabled", "absent"])]
    return Contracts.read(literal_table(s.spark, {"category": "string", "module": "string", "variant": "string", "position": "int", "column_name": "string"}, rows))


_REST = "concat('{{', concat_ws(',', {parts}), '}}')"
_EXTRAS_VARIANT = _REST.format(parts="""'"activity_category":" ' || activity_category || '"', '"size":"' || event_id || '"', '"call_path":"' || authvia || '"', '"jobid":"' || jobid || '"'""")
_EXTRAS_ALL = _REST.format(
    parts="""'"event_id":' || event_id, '"timestamp":"' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '"', '"activity_category":" ' || activity_category || '"', '"project_key":"' || project_key || '"',
  '"enabled":"' || CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'no' END || '"', '"size":"' || event_id || '"', '"call_path":"' || authvia || '"', '"jobid":"' || jobid || '"'"""
)


# --- streaming --------------------------------------------------------------------------------------


def stream(s: Sources, copies: int = 1, files: int = 2) -> DataFrame:
    return ingest.stream_audit(s.spark, json_path(s, copies), JSON_SCHEMA, files)


def stream_table(s: Sources, df: DataFrame) -> DataFrame:
    out = new_path(s.spark, "stream")
    ingest.run_available(df, out, new_path(s.spark, "checkpoint"))
    return s.spark.read.schema(df.schema).parquet(out)


def late_data(s: Sources) -> DataFrame:
    silver, fact = new_path(s.spark, "silver"), new_path(s.spark, "fact")
    ingest.run_late_data(ingest.flatten_stream(stream(s)), silver, fact, new_path(s.spark, "checkpoint"))
    return s.spark.read.parquet(fact).drop("p_year", "p_month", "p_day")


def streamed_hours(s: Sources, files: int, width: int | None = None) -> DataFrame:
    silver, fact = new_path(s.spark, "silver"), new_path(s.spark, "fact")
    writer = ingest.hourly_activity_writer(silver, fact)
    ingest.for_each_available(ingest.flatten_stream(stream(s, files=files)), writer, new_path(s.spark, "checkpoint"))
    if width:
        assert ingest.fold_hours(s.spark, fact, width)
    return ingest.read_hours(s.spark, fact)


def streamed_once(s: Sources, files: int) -> DataFrame:
    store = new_path(s.spark, "store")
    rows = stream(s, copies=2, files=files).select("event_id", "timestamp", "instance_name")
    ingest.store_first_deliveries(rows, ["event_id"], store, new_path(s.spark, "checkpoint"))
    return s.spark.read.schema(rows.schema).parquet(store).select("event_id", "timestamp")


def routed(s: Sources) -> DataFrame:
    path = new_path(s.spark, "routed")
    rows = stream(s).select(
        "event_id", "timestamp", F.col("timestamp").alias("run_ts"), "instance_name", F.lower(F.trim("message.msgType")).alias("module"),
        F.when(F.col("event_id") % 17 == 0, "{broken").otherwise(F.to_json("message")).alias("extras"),
    )
    ingest.for_each_available(rows, ingest.route_writer(path), new_path(s.spark, "checkpoint"))
    return s.spark.read.parquet(path).groupBy("module", "target").agg(F.count("*").alias("n"))


_TS = "CASE WHEN {c} >= 1000000000000000000 THEN 1000000000 WHEN {c} >= 1000000000000000 THEN 1000000 WHEN {c} >= 1000000000000 THEN 1000 ELSE 1 END"


def epochs(s: Sources) -> DataFrame:
    sec = F.unix_timestamp("timestamp")
    scale = F.when(F.col("event_id") % 4 == 0, 1).when(F.col("event_id") % 4 == 1, 10**3).when(F.col("event_id") % 4 == 2, 10**6).otherwise(10**9).cast("long")
    return s.audit.select("event_id", "timestamp", (sec * scale).cast("string").alias("text"))


def unit_groups(s: Sources) -> DataFrame:
    """Epoch texts in five groups: one unit with some values of another, half and half, and dates with some epochs."""
    group, turn = F.col("event_id") % 5, F.floor(F.col("event_id") / 5) % 10
    scale = (
        F.when(group == 0, F.when(turn == 0, 10**3).otherwise(1)).when(group == 1, F.when(turn == 0, 1).otherwise(10**3))
        .when(group == 2, F.when(turn < 5, 1).otherwise(10**3)).when(group == 3, F.when(turn == 0, 10**9).otherwise(10**6))
        .when(turn == 0, 1)
    )
    text = F.coalesce((F.unix_timestamp("timestamp") * scale.cast("long")).cast("string"), F.col("timestamp").cast("string"))
    return s.audit.select("event_id", group.cast("int").alias("file_group"), text.alias("by_column"), text.alias("by_length"))


def datetime_by_column(s: Sources) -> DataFrame:
    rows = normalize.cast_datetime_columns(unit_groups(s), ["by_column"], ["file_group"])
    return normalize.cast_datetime_columns(rows, ["by_length", "absent"], ["file_group"], mixed=True)


CASES = {
    "prepare_audit": (
        lambda s: normalize.prepare_audit(lines(s).withColumn("timestamp", F.col("timestamp").cast("timestamp")), F.col("instance_name")),
        """SELECT event_id, timestamp, topic, message_msgType, message_msgTypeBase, message_authSource, message_authUser, message_projectKey, message_scenarioId, message_jobId,
  CAST(timestamp AS DATE) AS date, instance_name FROM audit_flat WHERE topic = 'generic'""",
    ),
    "map_events": (
        lambda s: normalize.map_events(unmapped(s), mapping(s)).drop("topic"),
        f"""SELECT msgtype, event_id, timestamp, authuser, replace(authvia, ' ', ', ') AS authvia, instance_name,
  CASE msgtype WHEN 'recipe-save' THEN 'visual_recipes' WHEN 'sql-query-fetch' THEN 'coding' ELSE 'unclassified' END AS activity_category,
  CASE event_id % 9 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' END AS project_key_source_call, CAST(NULL AS VARCHAR) AS webappid_source_call
FROM audit WHERE msgtype <> 'mystery-event'""",
    ),
    "authvia_source": (
        lambda s: s.audit.select("event_id", normalize.authvia_source(F.when(F.col("event_id") % 5 == 0, "ticket:Standard webapp backend: P9.w1, x").otherwise(F.col("authvia")))[0].alias("project"),
                                 normalize.authvia_source(F.when(F.col("event_id") % 5 == 0, "ticket:Standard webapp backend: P9.w1, x").otherwise(F.col("authvia")))[1].alias("webapp")),
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'P9' ELSE CASE event_id % 9 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' END END AS project,
  CASE WHEN event_id % 5 = 0 THEN 'w1' END AS webapp FROM audit""",
    ),
    "webapp_ids": (
        lambda s: s.audit.select("event_id", *[c.alias(n) for n, c in zip(("project", "webapp"), normalize.webapp_ids(
            F.to_json(F.struct(F.to_json(F.struct(F.lit("{p}").alias("projectkey"), F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("webappid"))).alias("extras"), F.col("project_key").alias("projectkey")))), strict=True)]),
        "SELECT event_id, project_key AS project, concat('w', CAST(event_id AS VARCHAR)) AS webapp FROM audit",
    ),
    "sanitize_columns": (
        lambda s: normalize.sanitize_columns(raw_columns(s)).select("event_id", "call_path", "jobid", "dataset_projectkey"),
        "SELECT event_id, authvia AS call_path, jobid, project_key AS dataset_projectkey FROM audit",
    ),
    "canonical_project_key": (
        lambda s: normalize.canonical_project_key(normalize.sanitize_columns(raw_columns(s))).select("event_id", "project_key"),
        "SELECT event_id, project_key FROM audit",
    ),
    "normalize_silver": (
        lambda s: normalize.normalize_silver(raw_columns(s), ["event_id", "timestamp", "activity_category", "project_key", "enabled", "size", "absent"], instance=" hub "),
        """SELECT 'hub' AS instance_name, CAST(event_id AS VARCHAR) AS event_id, timestamp, upper(trim(activity_category)) AS activity_category, project_key,
  CASE WHEN event_id % 3 = 0 THEN TRUE END AS enabled, CAST(event_id AS DOUBLE) AS size, CAST(NULL AS VARCHAR) AS absent, run_ts,
  concat('{"call_path":"', authvia, '"', CASE WHEN jobid IS NULL THEN '' ELSE concat(',"jobid":"', jobid, '"') END, '}') AS extras FROM audit""",
    ),
    "normalize_module": (
        lambda s: normalize.normalize_module(raw_columns(s), "audit", "llm", contracts_of(s), base=("audit", "usage"), variant="genai", instance=" hub "),
        f"""SELECT 'hub' AS instance_name, CAST(event_id AS VARCHAR) AS event_id, timestamp, project_key, CASE WHEN event_id % 3 = 0 THEN TRUE END AS enabled, CAST(NULL AS VARCHAR) AS absent, run_ts,
  {_EXTRAS_VARIANT} AS extras FROM audit""",
    ),
    "normalize_no_contract": (
        lambda s: normalize.normalize_module(raw_columns(s), "audit", "unknown", contracts_of(s), instance=" hub "),
        f"SELECT 'hub' AS instance_name, run_ts, {_EXTRAS_ALL} AS extras FROM audit",
    ),
    "pack_extras": (
        lambda s: s.audit.select("event_id", normalize.pack_extras(s.audit, ["callpath", "jobid"]).alias("packed"), normalize.extras_to_json("scenarioid").alias("wrapped"), normalize.extras_to_json("extras").alias("kept")),
        f"""SELECT event_id, CASE WHEN callpath IS NULL AND jobid IS NULL THEN NULL ELSE concat('{{', concat_ws(',', '"callpath":"' || callpath || '"', '"jobid":"' || jobid || '"'), '}}') END AS packed,
  CASE WHEN {blank_null('scenarioid')} IS NOT NULL THEN concat('{{"_value":"', scenarioid, '"}}') END AS wrapped, extras AS kept FROM audit""",
    ),
    "cast_datetime": (
        lambda s: epochs(s).select("event_id", casts.cast_datetime("text").alias("from_epoch"), casts.cast_datetime(F.concat(F.lit(" "), F.col("timestamp").cast("string"))).alias("from_text"), casts.cast_datetime(F.lit("junk")).alias("junk")),
        "SELECT event_id, timestamp AS from_epoch, timestamp AS from_text, CAST(NULL AS TIMESTAMP) AS junk FROM audit",
    ),
    "cast_datetime_by_column": (
        datetime_by_column,
        """SELECT * FROM (WITH v AS (
  SELECT event_id, CAST(event_id % 5 AS INTEGER) AS file_group, timestamp, epoch(timestamp)::BIGINT AS sec, (event_id // 5) % 10 AS turn FROM audit
), n AS (
  SELECT *, sec * CASE file_group WHEN 0 THEN CASE turn WHEN 0 THEN 1000 ELSE 1 END WHEN 1 THEN CASE turn WHEN 0 THEN 1 ELSE 1000 END WHEN 2 THEN CASE WHEN turn < 5 THEN 1 ELSE 1000 END
    WHEN 3 THEN CASE turn WHEN 0 THEN 1000000000 ELSE 1000000 END WHEN 4 THEN CASE turn WHEN 0 THEN 1 END END AS number FROM v
), m AS (SELECT file_group, median(number::DOUBLE) AS middle, count(*) > count(number) AS readable FROM n GROUP BY file_group
), u AS (SELECT *, CASE WHEN middle >= 1e18 THEN 1000000000 WHEN middle >= 1e15 THEN 1000000 WHEN middle >= 1e12 OR middle IS NULL THEN 1000 ELSE 1 END AS divisor FROM m)
SELECT event_id, file_group, CASE WHEN number IS NULL THEN timestamp WHEN readable OR number // divisor > 9223372036 THEN NULL ELSE make_timestamp((number // divisor) * 1000000) END AS by_column, timestamp AS by_length
FROM n JOIN u USING (file_group)) AS cast_rows""",
    ),
    "cast_epoch_strict": (
        lambda s: epochs(s).select("event_id", casts.cast_epoch_strict("text").alias("ts"), casts.cast_epoch_strict(F.substring("text", 1, 9), on_error="null").alias("short"), casts.epoch_strict_unsupported(F.substring("text", 1, 9)).alias("rejected")),
        "SELECT event_id, timestamp AS ts, CAST(NULL AS TIMESTAMP) AS short, TRUE AS rejected FROM audit",
    ),
    "cast_numeric": (
        lambda s: s.max_licenses.select(
            "c_custkey", casts.cast_numeric("max_licenses").alias("n"), casts.cast_numeric(F.concat("c_custkey", F.lit("d"))).alias("suffixed"), casts.cast_numeric(F.lit("NaN")).alias("nan"),
            casts.cast_numeric(F.concat(F.lit(" -"), "c_custkey", F.lit(".5e1 "))).alias("scientific"),
        ),
        "SELECT c_custkey, try_cast(max_licenses AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS suffixed, CAST(NULL AS DOUBLE) AS nan, -(c_custkey * 10 + 5)::DOUBLE AS scientific FROM max_licenses",
    ),
    "cast_boolean": (
        lambda s: s.users.select("users_login", "instance_name", "run_ts", casts.cast_boolean("users_enabled").alias("b"), casts.cast_boolean((F.col("user_id") % 3).cast("string")).alias("n")),
        "SELECT users_login, instance_name, run_ts, users_enabled = 'True' AS b, CASE user_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS n FROM users",
    ),
    "cast_string": (
        lambda s: s.users.select("instance_name", "run_ts", "users_login", casts.cast_string(F.concat(F.lit("\t"), "users_userprofile", F.lit("\n"))).alias("plain"), casts.cast_string("users_userprofile", upper=True).alias("upper")),
        "SELECT instance_name, run_ts, users_login, trim(users_userprofile) AS plain, upper(trim(users_userprofile)) AS upper FROM users",
    ),
    "dq_check": (
        lambda s: normalize.dq_check(s.audit.withColumns({"run_ts": F.when(F.col("event_id") % 11 != 0, F.col("run_ts")), "extras": F.when(F.col("event_id") % 13 == 0, "{x").otherwise(F.col("extras"))}), ["instance_name"], ("run_ts",)),
        """SELECT *, concat_ws(';', 'nulls_in:run_ts:' || nulls_run_ts, 'extras_not_json:' || extras_not_json) AS errors, FALSE AS ok FROM (
SELECT instance_name, count(*) AS row_count, count(*) FILTER (WHERE event_id % 11 = 0) AS nulls_run_ts, count(*) FILTER (WHERE event_id % 13 = 0) AS extras_not_json FROM audit GROUP BY ALL) d""",
    ),
    "flatten_payload": (
        lambda s: normalize.flatten_payload(s.audit.select("event_id", F.create_map("msgtype", F.struct(F.col("authuser").alias("owner"), F.lit(None).cast("string").alias("name"))).alias("p")), "p", "x_"),
        "SELECT event_id, msgtype AS x_name, authuser AS x_owner FROM audit",
    ),
    "apply_rule": (
        lambda s: normalize.apply_rule(s.max_licenses, drop=["partition_date", "run_ts", "nope"], rename={"max_licenses": "n"}, fillna={"license_profile": "x"}, cast={"n": "Int64"}),
        "SELECT c_custkey, instance_name, license_profile, try_cast(max_licenses AS BIGINT) AS n FROM max_licenses",
    ),
    "license_status": (
        lambda s: payloads.license_status(s.adapted("license_payload")).drop("run_ts"),
        """SELECT s_suppkey, instance_name, 'i' || s_suppkey AS instance_id, CASE WHEN s_suppkey % 3 = 0 THEN 'TRIAL' ELSE 'ENTERPRISE' END AS license_kind, 'L' || s_suppkey AS license_id,
  'true' AS has_license, CASE WHEN s_suppkey % 7 = 0 THEN 'false' ELSE 'true' END AS valid, 'false' AS expired, 'false' AS community, 'READER' AS fallback_profile, '1735689600000' AS expires_on,
  json_extract_string(payload, '$.base.licenseContent.licensee.company') AS licensee_company, 'admin' AS licensee_name, 'o1' AS standard_offer, 'x' AS emitted_by, '20240105' AS emitted_on FROM license_payload""",
    ),
    "license_limits": (lambda s: payloads.license_limits(s.adapted("license_payload")), limits_oracle()),
    "license_addons": (
        lambda s: payloads.license_addons(s.adapted("license_payload")).drop("run_ts"),
        """SELECT s_suppkey, instance_name, 'stories' AS addon_key, s_suppkey % 2 = 0 AS addon_enabled FROM license_payload
UNION ALL SELECT s_suppkey, instance_name, 'advancedGovern', TRUE FROM license_payload""",
    ),
    "addon_flags": (
        lambda s: addon_flags(payloads.license_addons(s.adapted("license_payload"))),
        "SELECT * FROM (VALUES ('stories', TRUE), ('advancedGovern', TRUE)) AS t(addon_key, enabled_any_instance) WHERE (SELECT count(*) FROM license_payload) > 0",
    ),
    "license_status_summary": (
        lambda s: licences.license_status_summary(payloads.license_status(s.adapted("license_payload")).withColumn("feature_x", F.when(F.col("s_suppkey") % 4 == 0, "yes")), AS_OF),
        """SELECT 'field' AS kind, f AS field, v AS value, (SELECT count(*) FROM license_payload) AS count FROM (VALUES ('has_license', 'True'), ('expired', 'False'), ('community', 'False'), ('fallback_profile', 'READER'),
  ('expires_on', '2025-01-01'), ('licensee_name', 'admin'), ('standard_offer', 'o1'), ('emitted_by', 'x'), ('emitted_on', '2024-01-05')) AS t(f, v)
UNION ALL SELECT * FROM (SELECT 'field', 'licensee_company', json_extract_string(payload, '$.base.licenseContent.licensee.company') AS v, count(*) AS n FROM license_payload GROUP BY ALL ORDER BY n DESC, v LIMIT 1) c
UNION ALL SELECT 'field', 'license_kind', 'ENTERPRISE', count(*) FROM license_payload WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'field', 'valid', 'True', count(*) FROM license_payload WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'days_left', 'days_left', '336', count(*) FROM license_payload UNION ALL SELECT 'feature', 'feature_x', 'True', count(*) FROM license_payload WHERE s_suppkey % 4 = 0""",
    ),
    "standards_checks": (
        lambda s: payloads.standards_checks(
            s.adapted("standards").withColumn("payload", F.regexp_replace("payload", r'"score":"?(\d+)"?', r'"score":$1,"ok":true,"list":[],"more":[1,"a"],"none":null,"blank":""'))
        ),
        """SELECT o_orderkey, instance_name, project_key, 'c_doc' AS check_id, 'Documentation' AS name, 'Has docs' AS description, 'doc,core' AS tags, CAST(o_orderkey % 5 AS DOUBLE) AS severity,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status, 'm' AS message, concat('{"score":', CAST(o_orderkey % 11 AS VARCHAR), ',"ok":true,"more":[1,"a"]}') AS details, '{"limit":"3"}' AS parameters, 5.0::DOUBLE AS duration_ms FROM standards
UNION ALL SELECT o_orderkey, instance_name, project_key, 'c_own', 'Owner', '', NULL, NULL, 'NOT_APPLICABLE', '', NULL, NULL, NULL FROM standards""",
    ),
    "enrich_users": (
        lambda s: normalize.enrich_users(
            s.audit.filter("authuser IS NOT NULL").select(F.col("authuser").alias("login")).distinct(), s.audit.groupBy(F.col("authuser").alias("login")).agg(F.count("*").alias("actions")),
            s.audit.select(F.col("authuser").alias("author"), F.unix_millis("timestamp").alias("timestamp"))),
        "SELECT authuser AS login, count(*) AS actions, min(timestamp) AS first_commit_date, max(timestamp) AS last_commit_date FROM audit WHERE authuser IS NOT NULL GROUP BY ALL",
    ),
    "normalize_history": (
        lambda s: normalize.normalize_history(history(s)).select("event_id", "topic", "timestamp", "message_msgType", "message_msgTypeBase", "message_authUser", "message_projectKey"),
        f"""SELECT event_id, 'generic' AS topic, timestamp, message_msgType, message_msgTypeBase, CASE WHEN trim(message_authUser) <> '' THEN message_authUser END AS message_authUser,
  CASE WHEN trim(message_projectKey) <> '' THEN message_projectKey END AS message_projectKey FROM t_history""",
    ),
    "cleanup_history": (
        lambda s: normalize.cleanup_history(s.audit.select("event_id", F.col("msgtypebase").alias("msgtypebase_y"), F.lit(None).cast("string").alias("msgtypebase_x"), F.lit("x").alias("mdc"), F.col("authuser").alias("clientevent_authuser"), F.col("project_key").alias("projectkey"))),
        "SELECT event_id, project_key AS projectkey, project_key, msgtypebase, authuser FROM audit",
    ),
    "filter_event_range": (
        lambda s: normalize.filter_event_range(s.audit.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")}), dt.date(2024, 1, 5), dt.date(2024, 1, 9)).select("event_id", "timestamp"),
        "SELECT event_id, timestamp FROM audit WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
    ),
    "replay_event_mapping": (
        replayed,
        f"""SELECT instance_name, CAST(event_id AS VARCHAR) AS event_id, timestamp, msgtype, upper(c) AS activity_category, json_extract_string(extras, '$.k') AS k, run_ts, {RICH_REST} AS extras, c AS module,
  'silver' AS target
FROM (SELECT *, CASE msgtype WHEN 'recipe-save' THEN 'visual_recipes' WHEN 'sql-query-fetch' THEN 'coding' ELSE 'unclassified' END AS c FROM audit WHERE msgtype <> 'mystery-event') a WHERE event_id % 50 <> 7
UNION ALL SELECT NULL, CAST(event_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, '{{broken', NULL, 'rejected' FROM audit WHERE event_id % 50 = 7""",
    ),
    "merge_extras_checked": (
        merged_extras,
        f"""SELECT event_id, event_id % 10 AS part, json_extract_string(extras, '$.k') AS k, {RICH_REST} AS extras, 'merged' AS target FROM audit WHERE event_id % 10 NOT IN (1, 7)
UNION ALL SELECT event_id, event_id % 10, CASE WHEN event_id % 3 = 0 THEN json_extract_string(extras, '$.k') WHEN event_id % 30 = 1 THEN 'conflict' END,
  CASE WHEN event_id % 50 = 7 THEN '{{broken' ELSE concat('{{"k":"', json_extract_string(extras, '$.k'), '",', substr({RICH_REST}, 2)) END, 'rejected' FROM audit WHERE event_id % 10 IN (1, 7)""",
    ),
    "assert_casts_survived": (
        lambda s: normalize.assert_casts_survived(s.max_licenses.select(F.col("max_licenses").alias("size"), F.col("license_profile").alias("enabled")), ["size", "enabled"]),
        """SELECT 'size' AS column_name, count(*) AS lost_rows, count(*) = 0 AS ok FROM max_licenses WHERE max_licenses = 'unlimited'
UNION ALL SELECT 'enabled', count(*), count(*) = 0 FROM max_licenses WHERE trim(license_profile) <> ''""",
    ),
    # --- storage ---
    "read_audit_json": (
        lambda s: audit_src.read_audit_json(s.spark, json_path(s), JSON_SCHEMA).select("event_id", "topic", "message.msgType", "message.authUser", "instance_name"),
        "SELECT event_id, topic, message_msgType AS msgType, message_authUser AS authUser, instance_name FROM audit_flat",
    ),
    "select_files_since": (
        aged_files,
        "SELECT event_id, timestamp FROM audit_flat WHERE timestamp >= TIMESTAMP '2024-01-20'",
    ),
    "filter_since": (
        observed,
        """SELECT instance_name, count(*) AS n, min(timestamp) AS first, (SELECT count(*) FROM audit_flat) AS rows_read, (SELECT count(*) FROM audit_flat WHERE event_id % 97 = 0) AS rows_invalid_timestamp,
  (SELECT count(*) FROM audit_flat WHERE event_id % 97 <> 0 AND timestamp < TIMESTAMP '2024-01-15') AS rows_before_cursor
FROM audit_flat WHERE timestamp >= TIMESTAMP '2024-01-15' AND event_id % 97 <> 0 GROUP BY ALL""",
    ),
    "read_silver": (
        lambda s: tables.read_silver(s.spark, silver_path(s), "event_mapping", "coding").groupBy("partition_date", "instance_name").agg(F.count("*").alias("n")),
        "SELECT d AS partition_date, instance_name, 2 * count(*) AS n FROM sil WHERE module = 'coding' GROUP BY ALL",
    ),
    "read_event_module": (
        lambda s: tables.read_event_module(s.spark, silver_path(s), "mlops").select("event_id", "extras", "partition_date").distinct(),
        "SELECT event_id, extras, d AS partition_date FROM sil WHERE module = 'mlops'",
    ),
    "load_gold": (
        lambda s: tables.load_gold(s.spark, stored_path(s, "gold_daily", lambda p: sinks.write_fact_partitions(s.daily, p, "last_activity_at")), AS_OF, 10).select("day", "instance_name", "login_norm"),
        "SELECT day, instance_name, login_norm FROM daily WHERE day >= DATE '2024-01-21'",
    ),
    "align_append": (
        lambda s: tables.align_append(s.daily.select("day", "login_norm", "login"), s.mau_daily.select("day", "login_norm", "application_open_count")),
        "SELECT day, login_norm, login FROM daily UNION ALL SELECT day, login_norm, NULL FROM mau_daily",
    ),
    "read_csv_table": (
        csv_table,
        "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name, 1 FROM supplier",
    ),
    "partition_index": (
        lambda s: tables.partition_index(s.spark.read.parquet(silver_path(s)).select(F.concat(F.lit("/silver"), F.regexp_extract(F.col("_metadata.file_path"), "(/category=.*)", 1)).alias("path"))),
        """SELECT DISTINCT 'silver' AS layer, 'event_mapping' AS category, module, instance_name, strftime(d, '%Y') AS year, strftime(d, '%m') AS month, strftime(d, '%d') AS day FROM sil""",
    ),
    "latest_partitions": (
        lambda s: tables.latest_partitions(sinks.partition_files(s.spark, silver_path(s), SILVER_KEYS), 7, dt.datetime(2024, 1, 25), min_age_days=2, filters={"module": "coding"}).select(
            "module", "instance_name", "partition_date", "file_count", "loose_files", F.size("files").alias("files")),
        """SELECT DISTINCT module, instance_name, d AS partition_date, 2::BIGINT AS file_count, 2::BIGINT AS loose_files, 2 AS files FROM sil WHERE module = 'coding' AND d < DATE '2024-01-23' ORDER BY d DESC, instance_name DESC LIMIT 7""",
    ),
    "newest_partitions": (
        scanned,
        """SELECT state, position, instance_name, d AS partition_date, 2 AS file_count, 2 AS loose_files, CAST(recent + 2 * count(*) OVER (PARTITION BY state) AS INTEGER) AS files_seen,
  recent AS files_too_recent, 0 AS files_compacted, CAST(2 * count(*) OVER (PARTITION BY state) AS INTEGER) AS files_eligible
FROM (SELECT *, CAST(row_number() OVER (ORDER BY d DESC, instance_name DESC) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT instance_name, d FROM sil WHERE module = 'coding' AND d < DATE '2024-01-23') o) p
CROSS JOIN (SELECT CAST(2 * count(DISTINCT (instance_name, d)) AS INTEGER) AS recent FROM sil WHERE module = 'coding' AND d >= DATE '2024-01-23') r
CROSS JOIN (VALUES ('raw'), ('compacted')) t(state) WHERE position < 7""",
    ),
    "write_single": (single, "SELECT instance_name, license_profile, max_licenses FROM max_latest"),
    "write_fact_partitions": (
        lambda s: written_fact(s, "2024-01-25"),
        "SELECT day, instance_name, login_norm, CASE WHEN day >= DATE '2024-01-25' THEN viewing_actions_count ELSE 0 END AS viewing_actions_count FROM daily",
    ),
    "incremental_boundary": (
        bounded,
        """SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS boundary, (SELECT count(*) FROM daily WHERE last_activity_at >= b) AS rows_to_rebuild
FROM (SELECT max(last_activity_at) - INTERVAL 3 DAY AS b FROM daily) w""",
    ),
    "commit_watermarks": (
        committed,
        """SELECT 'daily' AS table_name, strftime(max(last_activity_at), '%Y-%m-%d %H:%M:%S') AS watermark FROM daily
UNION ALL SELECT 'opens', strftime(max(last_application_open_at), '%Y-%m-%d %H:%M:%S') FROM mau_daily""",
    ),
    "compact_partitions": (
        compacted,
        """SELECT module, instance_name, strftime(d, '%Y') AS year, strftime(d, '%m') AS month, strftime(d, '%d') AS day,
  CASE WHEN d >= DATE '2024-01-19' OR d = DATE '2024-01-05' AND instance_name = '007' AND module = 'coding' THEN 2 ELSE 1 END * count(*) AS n FROM sil GROUP BY module, instance_name, d""",
    ),
    "compaction_outcome": (
        compaction_outcome,
        """SELECT 0 AS run, count(*) AS partitions, count(*) AS compacted, 0::BIGINT AS failed, 2 * count(*) AS files_read, CAST(2 * sum(n) AS BIGINT) AS raw_rows, CAST(sum(n) AS BIGINT) AS written_rows,
  2 * count(*) AS files_deleted FROM (SELECT module, instance_name, d, count(*) AS n FROM sil WHERE d < DATE '2024-01-19' GROUP BY ALL) p
UNION ALL SELECT 1, k, k, 0, 2 * k, CAST(2 * n AS BIGINT), CAST(2 * n AS BIGINT), 2 * k
FROM (SELECT count(DISTINCT d) AS k, count(*) AS n FROM sil WHERE d = DATE '2024-01-05' AND instance_name = '007' AND module = 'coding') l UNION ALL SELECT 2, 0, 0, 0, 0, 0, 0, 0""",
    ),
    "dedupe_exact": (
        lambda s: sinks.dedupe_exact(s.spark.read.parquet(silver_path(s))).select("event_id", "module"),
        "SELECT event_id, module FROM sil",
    ),
    "compaction_audit": (
        lambda s: sinks.compaction_audit(s.spark.read.parquet(silver_path(s)), ["module", "instance_name", "day"], COMPACT_AS_OF),
        """SELECT module, instance_name, strftime(d, '%d') AS day, 2::BIGINT AS files_read, 2 * count(*) AS raw_rows, count(*) AS rows_after_drop_duplicates, DATE '2024-01-20' AS run_date
FROM sil WHERE d < DATE '2024-01-19' GROUP BY module, instance_name, d""",
    ),
    "select_changed_since": (
        lambda s: audit_src.select_changed_since(s.inventory.select("obj", "run_ts", F.when(F.col("obj") % 3 > 0, F.col("updated_text")).otherwise("0").alias("x_lastModifiedOn")), "2024-01-10").select("obj", "run_ts"),
        "SELECT obj, run_ts FROM inventory WHERE obj % 3 > 0 AND make_timestamp(try_cast(updated_text AS BIGINT) * 1000000) >= TIMESTAMP '2024-01-10'",
    ),
    "select_changed_projects": (
        lambda s: audit_src.select_changed_projects(s.inventory.select("obj", "run_ts", F.col("updated_text").alias("v"), F.when(F.col("obj") % 2 == 0, "1000").alias("c")), "2024-01-10", "v", "c").select("obj", "run_ts"),
        """SELECT obj, run_ts FROM inventory WHERE CASE WHEN updated_text IS NULL THEN obj % 2 <> 0 ELSE make_timestamp(CAST(updated_text AS BIGINT) * 1000000) >= TIMESTAMP '2024-01-10' END""",
    ),
    "build_order": (
        gold_build,
        """SELECT 0 AS position, 'b_opens' AS table_name, count(*) AS row_count FROM mau_daily UNION ALL SELECT 1, 'a_daily', count(*) FROM daily
UNION ALL SELECT 2, 'ratio', count(DISTINCT instance_name) FROM daily""",
    ),
    "gold_build": (gold_tables, gold_oracle()),
    # --- streaming ---
    "ingest_audit": (
        ingested,
        """SELECT instance_name, CAST(event_id AS VARCHAR) AS event_id, timestamp, trim(message_msgType) AS msgtype, trim(message_authUser) AS authuser,
  concat('{', concat_ws(',', '"topic":"generic"', '"msgtypebase":"' || message_msgTypeBase || '"', '"authsource":"' || message_authSource || '"', '"authvia":""', '"project_key":"' || message_projectKey || '"',
    '"scenarioid":"' || message_scenarioId || '"', '"jobid":"' || message_jobId || '"'), '}') AS extras,
  CASE message_msgType WHEN 'recipe-save' THEN 'visual_recipes' WHEN 'sql-query-fetch' THEN 'coding' ELSE 'unclassified' END AS module, 'silver' AS target
FROM audit_flat WHERE topic = 'generic' AND length(trim(message_msgType)) > 0 AND message_msgType <> 'mystery-event'""",
    ),
    "stream_audit": (
        lambda s: stream_table(s, stream(s).select("event_id", "timestamp", "topic", "instance_name")),
        "SELECT event_id, timestamp, topic, instance_name FROM audit_flat",
    ),
    "stream_hourly_activity": (lambda s: streamed_hours(s, 1), "SELECT * FROM hourly"),
    "stream_hourly_activity_folded": (lambda s: streamed_hours(s, 1, 2), "SELECT * FROM hourly"),
    "stream_hourly_activity_one_batch": (lambda s: streamed_hours(s, 100), "SELECT * FROM hourly"),
    "late_data_lookback": (late_data, "SELECT * FROM daily"),
    "stream_dedupe": (lambda s: streamed_once(s, 1), "SELECT event_id, timestamp FROM audit_flat"),
    "stream_dedupe_one_batch": (lambda s: streamed_once(s, 100), "SELECT event_id, timestamp FROM audit_flat"),
    "stream_route": (
        routed,
        """SELECT lower(trim(message_msgType)) AS module, count(*) AS n, CASE WHEN event_id % 17 = 0 THEN 'quarantine' ELSE 'silver' END AS target FROM audit_flat GROUP BY ALL""",
    ),
}

QUERIES = {name: (lambda spark, d, fn=fn: fn(Sources(spark, d))) for name, (fn, _) in CASES.items()}
ORACLE = {name: sql(text) for name, (_, text) in CASES.items() if text}
