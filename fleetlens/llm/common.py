"""Shared plumbing of the training-data operators: Arrow batches, stored steps, gapless ranks."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.sources.scratch import new_path

BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about a megabyte, so a worker's memory does not follow the row width.

    Workers also get this library's folder on their path, wherever the driver was started.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(frame: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write below ``spark.checkpoint.dir`` and read back.

    A reader takes up to a row group into memory, so wide rows are written in groups of ``group_rows``.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    writer = frame.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds (n + 1) of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kept_apart(frame: DataFrame, *needed: str) -> DataFrame:
    """All columns in one struct ``row``, so that no name clashes with an operator's own, beside the ``needed`` ones."""
    return frame.select(F.struct(*map(quoted, frame.columns)).alias("row"), *needed)


def bucket_of(columns: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def gapless(frame: DataFrame, groups: list[str], order: list[str], out: str, buckets: int = 4096) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large the group.

    A group is cut into hash buckets of ``order``; rows are numbered inside a bucket and
    shifted by the sizes of the buckets before it. Only bucket sizes are sorted per group.
    Rows that are equal in ``order`` share a bucket and get neighbouring numbers.
    """
    cut = frame.withColumn("_bucket", bucket_of([F.col(c) for c in order], buckets))
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = cut.withColumn("_row", F.row_number().over(inside) - 1)
    same = [numbered[k].eqNullSafe(starts[k]) for k in groups] + [numbered["_bucket"] == starts["_bucket"]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return numbered.join(starts, condition).select(
        *[numbered[c] for c in frame.columns], (F.col("_row") + F.col("_start")).cast("long").alias(out)
    )


# Rolling sums of byte values times powers of an odd base, modulo 2^64: the hash of any
# stretch of a batch is one subtraction and one multiplication.
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for slot, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, 1 << 16), base, np.uint64)
            grown[0] = 1
            _POWERS[slot] = np.multiply.accumulate(grown)
    return _POWERS[0], _POWERS[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end], length included, independent of the place."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each place on."""
    out = sums[width:] - sums[:-width]
    out *= _powers(len(sums))[1][: len(out)]
    return mix(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective finaliser that spreads every input bit."""
    x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LONG_WORD = 1024
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the data."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each data[start:end], eight bytes at a time.

    Every step mixes all bits of the one before, so words of a regular build do not meet, as they
    do under sums of powers modulo 2^64. Other words meet by chance only (2^-64 a pair).
    """
    sizes, eights = ends - starts, _eights(data)
    out = mix(sizes.astype(np.uint64), seed)
    lane, live = 0, np.flatnonzero(sizes <= LONG_WORD)
    while len(live):
        part = eights[starts[live] + lane] & _TAILS[np.minimum(sizes[live] - lane, 8)]
        out[live] = mix(out[live] * np.uint64(3) ^ part, seed)
        lane += 8
        live = live[sizes[live] > lane]
    for i in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=(seed & (1 << 64) - 1).to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether data[start:end] and other[first:last] are the same bytes, for each pair."""
    sizes, left, right = ends - starts, _eights(data), _eights(other)
    same = sizes == last - first
    lane, live = 0, np.flatnonzero(same & (sizes <= LONG_WORD))
    while len(live):
        part = (left[starts[live] + lane] ^ right[first[live] + lane]) & _TAILS[np.minimum(sizes[live] - lane, 8)]
        same[live[part != 0]] = False
        lane += 8
        live = live[(part == 0) & (sizes[live] > lane)]
    for i in np.flatnonzero(same & (sizes > LONG_WORD)):
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[first[i] : last[i]])
    return same


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of word bytes in lower-cased data; runs end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTE[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    heads = bounds[:-1][np.diff(bounds) > 0]
    first[heads] |= inside[1:-1][heads]
    tails = bounds[1:][np.diff(bounds) > 0] - 1
    last[tails] |= inside[1:-1][tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 for each pair, one after another."""
    sizes = sizes.astype(np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(total, dtype=np.int64)
