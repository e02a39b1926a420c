"""A store of partial aggregates, one part per micro-batch, added up when it is read.

A part is a folder ``part=<first>-<last>`` that covers the batches first to last. A micro-batch writes
its own part and reads nothing; a batch that is tried again replaces its part. Folding merges
neighbouring parts into one that covers them all and deletes them afterwards. A part counts once its
success marker is there, and a part inside a wider complete one does not count, so readers see a batch
exactly once whatever a fold has got done when it stops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.sinks import DAY_PARTITIONS, files_at, with_fact_partitions

FOLD = 16  # parts of one level that are folded into the next


@dataclass(frozen=True, order=True)
class Part:
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"part={self.first}-{self.last}"

    def within(self, other: Part) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last


def _complete(spark: SparkSession, store: str) -> list[Part]:
    fs, folder = files_at(spark, store)
    if not fs.exists(folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [Part(*map(int, n.removeprefix("part=").split("-"))) for n in names if n.startswith("part=")]
    return sorted(p for p in found if fs.exists(place(f"{store}/{p.folder}/_SUCCESS")))


def parts(spark: SparkSession, store: str) -> list[Part]:
    """The parts that count: complete ones that lie in no wider complete one."""
    found = _complete(spark, store)
    return [p for p in found if not any(p.within(q) for q in found)]


def write_part(rows: DataFrame, store: str, part: Part, time_column: str) -> None:
    """Store rows of a batch, or of a fold, by day."""
    out = with_fact_partitions(rows, time_column).hint("rebalance", *DAY_PARTITIONS)
    out.write.mode("overwrite").partitionBy(*DAY_PARTITIONS).parquet(f"{store}/{part.folder}")


def _read(spark: SparkSession, store: str, chosen: list[Part], schema: str) -> DataFrame:
    if not chosen:
        return spark.createDataFrame([], schema)
    days = ", ".join(f"{c} string" for c in DAY_PARTITIONS)
    rows = spark.read.schema(f"{schema}, {days}").option("basePath", store)
    return rows.parquet(*[f"{store}/{p.folder}" for p in chosen]).drop("part")


def read_parts(spark: SparkSession, store: str, schema: str, merge: Callable[[DataFrame], DataFrame], days: str | None = None) -> DataFrame:
    """All batches added up by ``merge``; ``days`` is a condition on the partition columns."""
    rows = _read(spark, store, parts(spark, store), schema)
    return merge(rows.filter(days) if days else rows)


def fold(spark: SparkSession, store: str, schema: str, merge: Callable[[DataFrame], DataFrame], time_column: str, width: int = FOLD, newest: int | None = None) -> int:
    """Merge runs of ``width`` neighbouring parts of about equal width; returns how many folds were done.

    The newest batch may be tried again, so it is never folded: ``newest`` is its number, by default
    the highest stored. Folds of one level become the parts of the next, so a batch is written again
    once per level and the number of parts grows with the logarithm of the number of batches.
    """
    clean(spark, store)
    done = 0
    while True:
        counted = parts(spark, store)
        newest = max((p.last for p in counted), default=0) if newest is None else newest
        levels: dict[int, list[Part]] = {}
        for p in counted:
            if p.last < newest:
                level, size = 0, p.last - p.first + 1
                while size >= width:
                    level, size = level + 1, size // width
                levels.setdefault(level, []).append(p)
        # a level may lie behind a wider one only, so its parts are neighbours
        chosen = next((found[:width] for _, found in sorted(levels.items()) if len(found) >= width), None)
        if chosen is None:
            return done
        whole = Part(chosen[0].first, chosen[-1].last)
        write_part(merge(_read(spark, store, chosen, schema)), store, whole, time_column)
        clean(spark, store)
        done += 1


def clean(spark: SparkSession, store: str) -> int:
    """Delete parts that a wider complete one has replaced; returns their number."""
    found = _complete(spark, store)
    gone = [p for p in found if any(p.within(q) for q in found)]
    for p in gone:
        fs, folder = files_at(spark, f"{store}/{p.folder}")
        fs.delete(folder, True)
    return len(gone)
