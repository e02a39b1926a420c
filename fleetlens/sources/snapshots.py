"""Compaction with snapshots: readers see the files before it or after it, never both.

A manifest beside the data says what a reader leaves out: files of a run that is not committed yet, and
files that a committed run has replaced and not deleted yet. It is empty when nothing is going on. Each
change is a new version of the manifest, and the highest complete version counts:

1. ``pending``: the run's name, before its first file is moved in;
2. ``replaced``: the files that were read, in the version that ends ``pending`` - the commit;
3. empty, when those files are deleted.

:func:`recover` ends what a stopped run began: it takes files of a pending run away, or deletes replaced ones.
"""

from __future__ import annotations

import datetime as dt
import heapq
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import day_floor
from fleetlens.sources.sinks import COMPACTED, MAX_ROWS_PER_FILE, OUTCOME, complete_versions, dedupe_exact, files_at

BATCH_PARTITIONS = 25  # fixed value: partitions that one step of a run compacts
STAGED_TOGETHER = 4  # fixed value: steps whose rows are staged and verified at the same time; they are committed one by one
LISTED_TOGETHER = 64  # day folders whose files are listed in one job
_MANIFEST = "kind string, value string"


# --- manifest -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    pending: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()  # files below the table's folder; at most those of one step of a run


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    versions = complete_versions(spark, f"{path}/_manifest")
    if not versions:
        return Manifest()
    rows = spark.read.schema(_MANIFEST).json(f"{path}/_manifest/version={versions[-1]}").collect()
    return Manifest(versions[-1], tuple(r.value for r in rows if r.kind == "pending"), tuple(r.value for r in rows if r.kind == "replaced"))


def write_manifest(spark: SparkSession, path: str, before: Manifest, pending: tuple[str, ...] = (), replaced: tuple[str, ...] = ()) -> Manifest:
    """The next version; older versions but the one before are deleted."""
    new = Manifest(before.version + 1, pending, replaced)
    rows = spark.createDataFrame([("pending", v) for v in pending] + [("replaced", v) for v in replaced], _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/version={new.version}")
    for version in complete_versions(spark, f"{path}/_manifest"):
        if version < before.version:
            fs, folder = files_at(spark, f"{path}/_manifest/version={version}")
            fs.delete(folder, True)
    return new


def _below(keys: list[str], column: str = "_metadata.file_path") -> Column:
    """A file's place below the table's folder: its partition levels and its name."""
    # file paths come as URLs, listings as plain text
    parts = F.split(F.url_decode(F.regexp_replace(column, r"\+", "%2B")), "/")
    return F.array_join(F.slice(parts, -len(keys) - 1, len(keys) + 1), "/")


def read_snapshot(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """A table under compaction. ``schema`` has its data columns; partition values are text.

    The files are listed between two looks at the manifest, and again if it changed meanwhile.
    """
    kinds = ", ".join(f"`{k}` string" for k in keys)
    while True:
        state = read_manifest(spark, path)
        rows = spark.read.schema(f"{schema}, {kinds}").parquet(path)
        if read_manifest(spark, path).version == state.version:
            break
    for run in state.pending:
        rows = rows.filter(~F.col("_metadata.file_name").startswith(f"{COMPACTED}{run}-"))
    return rows.filter(~_below(keys).isin(list(state.replaced))) if state.replaced else rows


# --- listing ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Partition:
    date: dt.date
    values: tuple[str, ...]
    folder: str
    files: tuple[str, ...] = ()

    @property
    def loose(self) -> list[str]:
        return [f for f in self.files if not f.rsplit("/", 1)[1].startswith(COMPACTED)]


@dataclass
class Scan:
    """What a listing met, in files: all, too recent, in partitions that are compacted, in eligible ones."""

    seen: int = 0
    too_recent: int = 0
    compacted: int = 0
    eligible: int = 0
    listed_folders: int = field(default=0, compare=False)


def _date(year: str, month: str, day: str) -> dt.date | None:
    try:
        return dt.date(int(year), int(month), int(day))
    except ValueError:
        return None


def day_folders(spark: SparkSession, path: str, keys: list[str], filters: dict[str, str] | None = None) -> Iterator[Partition]:
    """Day folders of a table, newest first. Years, months and days are listed as far as they are asked for.

    ``keys`` ends with year, month and day. Folders of no valid day are left out.
    """
    fs, root = files_at(spark, path)
    wanted = filters or {}

    def children(folder, key: str) -> list[tuple[str, object]]:
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder) if s.isDirectory()]
        found = [(unquote(n.removeprefix(f"{key}=")), p) for n, p in names if n.startswith(f"{key}=")]
        return [(value, p) for value, p in found if key not in wanted or wanted[key] == value]

    def days(folder, values: tuple[str, ...]) -> Iterator[Partition]:
        number = lambda child: int(child[0]) if child[0].isdigit() else -1
        for year, in_year in sorted(children(folder, keys[-3]), key=number, reverse=True):
            for month, in_month in sorted(children(in_year, keys[-2]), key=number, reverse=True):
                for day, place in sorted(children(in_month, keys[-1]), key=number, reverse=True):
                    date = _date(year, month, day)
                    if date is not None:
                        yield Partition(date, (*values, year, month, day), place.toString())

    if not fs.exists(root):
        return
    level = [((), root)]
    for key in keys[:-3]:
        level = [((*values, value), child) for values, folder in level for value, child in children(folder, key)]
    yield from heapq.merge(*[days(folder, values) for values, folder in level], key=lambda p: (p.date, p.values), reverse=True)


def _with_files(spark: SparkSession, found: list[Partition]) -> list[Partition]:
    """The data files of some day folders; Spark lists the folders in parallel."""
    if not found:
        return []
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([p.folder for p in found]).select("path").collect()
    files: dict[str, list[str]] = {}
    for row in listed:
        files.setdefault(row.path.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/"), []).append(row.path)
    own = lambda p: tuple(sorted(files.get(p.folder.split(":", 1)[-1].lstrip("/"), [])))
    return [Partition(p.date, p.values, p.folder, own(p)) for p in found]


def newest_partitions(
    spark: SparkSession, path: str, keys: list[str], as_of, n: int | None = None, *, min_age_days: int = 0, filters: dict[str, str] | None = None, scan: Scan | None = None
) -> Iterator[Partition]:
    """The newest ``n`` partitions that are old enough and have a file that is not compacted, newest first.

    Listing goes on only as far as they lie, some day folders at a time; ``scan`` counts what it met up to the last.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    counts, cutoff, given = scan or Scan(), day_floor(as_of) - dt.timedelta(days=min_age_days), 0
    folders = day_folders(spark, path, keys, filters)
    while chunk := list(islice(folders, LISTED_TOGETHER if n is None else min(LISTED_TOGETHER, max(8, 2 * (n - given))))):
        counts.listed_folders += len(chunk)
        for p in _with_files(spark, chunk):
            counts.seen += len(p.files)
            if p.date >= cutoff:
                counts.too_recent += len(p.files)
            elif not p.loose:
                counts.compacted += len(p.files)
            else:
                counts.eligible += len(p.files)
                given += 1
                yield p
                if given == n:
                    return


# --- compaction --------------------------------------------------------------------------------------


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)])


def contents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition: rows, distinct rows and the sum of their hashes. Equal where the same distinct rows are."""
    hashed = df.select(*keys, row_hash(df).alias("_h")).groupBy(*keys, "_h").agg(F.count("*").alias("_n"))
    return hashed.groupBy(*keys).agg(F.sum("_n").alias("raw"), F.count("*").alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("digest"))


def recover(spark: SparkSession, path: str, keys: list[str]) -> Manifest:
    """End what a stopped run began, so that the manifest is empty."""
    state = read_manifest(spark, path)
    if not state.pending and not state.replaced:
        return state
    fs, _ = files_at(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    for run in state.pending:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{COMPACTED}{run}-*").option("recursiveFileLookup", "true").load(path)
        for row in listed.select("path").collect():  # files of one step
            fs.delete(place(row.path), False)
    for name in state.replaced:
        fs.delete(place(f"{path}/{name}"), False)
    return write_manifest(spark, path, state)


@dataclass(frozen=True)
class Staged:
    """The staged rows of one step: contents of each partition before and after, and its new files."""

    before: dict[tuple, Row]
    after: dict[tuple, Row]
    files: dict[tuple, list[str]]


def stage_step(spark: SparkSession, path: str, staging: str, keys: list[str], chosen: list[Partition], schema: str | None) -> Staged:
    """Write the distinct rows of some partitions to ``staging`` and read them back. The table is not changed."""
    if schema is None:
        merged = spark.read.option("mergeSchema", "true").parquet(*[f for p in chosen for f in p.files])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema.fields if f.name not in keys)
    kinds = ", ".join(f"`{k}` string" for k in keys)
    rows = spark.read.schema(f"{schema}, {kinds}").option("basePath", path).parquet(*[f for p in chosen for f in p.files])
    dedupe_exact(rows).hint("rebalance", *keys).write.mode("overwrite").option("maxRecordsPerFile", MAX_ROWS_PER_FILE).partitionBy(*keys).parquet(staging)
    before, after = ({tuple(r)[: len(keys)]: r for r in contents(df, keys).collect()} for df in (rows, spark.read.schema(f"{schema}, {kinds}").parquet(staging)))
    moved: dict[tuple, list[str]] = {}
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(staging).select("path").collect():
        values = tuple(unquote(level.split("=", 1)[1]) for level in row.path.split("/")[-len(keys) - 1 : -1])
        moved.setdefault(values, []).append(row.path)
    return Staged(before, after, moved)


def compact_step(spark: SparkSession, path: str, staging: str, keys: list[str], chosen: list[Partition], schema: str | None, staged: Staged | None = None) -> list[tuple]:
    """Compact some partitions as one run, staged before or now; their outcome rows.

    A partition whose staged digest differs from that of the files it was made of keeps its
    files. A file that arrives meanwhile is not among the files read and stays.
    """
    staged = staged or stage_step(spark, path, staging, keys, chosen, schema)
    state, run = recover(spark, path, keys), uuid.uuid4().hex
    before, after, moved = staged.before, staged.after, staged.files

    def fits(p: Partition) -> bool:
        old, new = before.get(p.values), after.get(p.values)
        return old is not None and new is not None and (old.rows, old.digest) == (new.raw, new.digest) and new.raw == new.rows

    good = [p for p in chosen if fits(p)]
    fs, _ = files_at(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    if good:
        state = write_manifest(spark, path, state, pending=(run,))
        for p in good:
            for f in moved[p.values]:
                if not fs.rename(place(f), place(f"{p.folder}/{COMPACTED}{run}-{f.rsplit('/', 1)[1]}")):
                    raise RuntimeError(f"{f} could not be moved")  # the next run takes the others back
        names = tuple("/".join(f.split("/")[-len(keys) - 1 :]) for p in good for f in p.files)
        state = write_manifest(spark, path, state, replaced=names)
    deleted = {p.values: sum(bool(fs.delete(place(f), False)) for f in p.files) for p in good}
    left = tuple("/".join(f.split("/")[-len(keys) - 1 :]) for p in good for f in p.files if fs.exists(place(f)))
    if good:
        write_manifest(spark, path, state, replaced=left)
    outcome = []
    for p in chosen:
        old, new = before.get(p.values), after.get(p.values)
        counts = (len(p.files), old.raw if old else 0, new.raw if new else 0)
        label = "/".join(f"{k}={v}" for k, v in zip(keys, p.values))
        if p not in good:
            outcome.append((label, p.date, *counts, 0, 0, "failed", "staged rows do not fit the rows read"))
        else:
            status = ("compacted", "") if deleted[p.values] == len(p.files) else ("partial", "some source files could not be deleted")
            outcome.append((label, p.date, *counts, len(moved[p.values]), deleted[p.values], *status))
    return outcome


def compact_partitions(
    spark: SparkSession, path: str, staging: str, keys: list[str], as_of, age_days: int = 1, newest: int | None = None, schema: str | None = None, scan: Scan | None = None
) -> DataFrame:
    """Merge the files of old partitions and drop identical rows; one outcome row per partition.

    Every partition with a file that is not compacted yet is taken, a lone file too, or the ``newest`` of them.
    ``BATCH_PARTITIONS`` make a step. The rows of ``STAGED_TOGETHER`` steps are staged at the same time, so the
    many short jobs of a step do not leave a cluster idle; steps are committed one after the other, newest first,
    and the driver holds the file names of those steps only. ``schema``
    names the data columns; without it a step reads them from the footers of its files. Partition folders keep
    their names (``month=01``). Read the table with :func:`read_snapshot`; plain readers may see rows twice
    between the steps of a run.
    """
    if age_days < 1:
        raise ValueError("age_days must be at least 1")
    recover(spark, path, keys)
    found = newest_partitions(spark, path, keys, as_of, newest, min_age_days=age_days, scan=scan)
    outcome: list[tuple] = []
    begun: deque[tuple[str, list[Partition], Future[Staged]]] = deque()
    step, stage = 0, inheritable_thread_target(spark)(stage_step)
    with ThreadPoolExecutor(STAGED_TOGETHER) as pool:
        try:
            while True:
                while len(begun) < STAGED_TOGETHER and (chosen := list(islice(found, BATCH_PARTITIONS))):
                    place = f"{staging}/step={step}"
                    begun.append((place, chosen, pool.submit(stage, spark, path, place, keys, chosen, schema)))
                    step += 1
                if not begun:
                    break
                place, chosen, staged = begun.popleft()
                outcome += compact_step(spark, path, place, keys, chosen, schema, staged.result())
        finally:
            for *_, later in begun:
                later.cancel()  # only after an error
    return spark.createDataFrame(outcome, OUTCOME)
