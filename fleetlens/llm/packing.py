"""Best-fit decreasing packing of documents into sequences of fixed length.

Pieces of one length are interchangeable, so the whole packing follows from how many pieces
there are of each length: at most ``capacity`` numbers, at any corpus size. Bins are planned
from these in runs of equal bins, longest pieces first, each piece into the tightest open bin,
which a segment tree over remaining capacities finds in logarithmic time. The plan is a list
of runs (length, first rank, bins, place); Spark numbers the pieces of each length without
gaps and looks every piece up in it. The packing is the one best-fit decreasing gives when it
sees all pieces in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, gapless, stored, texts
from fleetlens.llm.tokens import WordIds

CAPACITY = 2048


class CapacityTree:
    """Which remaining capacities have open bins; finds the smallest one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def mark(self, remaining: int, is_open: bool) -> None:
        node = self.leaves + remaining
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


@dataclass
class Plan:
    """Runs: ``per_bin`` pieces of ``length`` into each bin from ``bin`` on, from ``offset`` on."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    per_bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("length", "rank", "bin", "per_bin", "offset")}


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan bins for ``counts`` pieces of each length (1 to capacity)."""
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan, tree = Plan(), CapacityTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of equal bins (first, how many)

    def add(remaining: int, first: int, many: int) -> None:
        if remaining and many:
            groups.setdefault(remaining, []).append((first, many))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, many = capacity, -(-left // (capacity // length))
                first, plan.bins = plan.bins, plan.bins + many
            else:
                first, many = groups[remaining].pop()
            # A bin that still has room for this length stays the tightest: it is filled first.
            fill = remaining // length
            used = min(many, -(-left // fill))
            full = used if left >= used * fill else used - 1
            for start, bins, each in ((first, full, fill), (first + full, used - full, left - full * fill)):
                if bins:
                    for name, value in (("length", length), ("rank", rank), ("bin", start), ("per_bin", each), ("offset", capacity - remaining)):
                        getattr(plan, name).append(value)
                    rank, left = rank + bins * each, left - bins * each
                    add(remaining - each * length, start, bins)
            add(remaining, first + used, many - used)
            if remaining in groups and not groups[remaining]:
                del groups[remaining]
                tree.mark(remaining, False)
    return plan


def _encoded(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    ids = WordIds(path)
    for batch in batches:
        rows, piece, start, length, crc = [], [], [], [], []
        for row, text in enumerate(texts(batch.column("text"))):
            packed = memoryview(ids.encode(text) + b"\0\0\0\0")
            for number, at in enumerate(range(0, len(packed), 4 * capacity)):
                part = packed[at : at + 4 * capacity]
                rows.append(row)
                piece.append(number)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        kept = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
        for name, values, kind in (("piece", piece, pa.int32()), ("start", start, pa.int64()), ("length", length, pa.int64()), ("ids_crc32", crc, pa.int64())):
            kept = kept.append_column(name, pa.array(values, kind))
        yield kept


def _placed(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    runs = plan.value
    stride = int(runs["rank"].max(initial=0)) + 1
    order = np.lexsort((runs["rank"], runs["length"]))
    runs = {k: v[order] for k, v in runs.items()}
    keys = runs["length"].astype(object) * stride + runs["rank"] if stride > 1 << 50 else runs["length"] * stride + runs["rank"]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        run = np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), side="right") - 1
        inside = rank - runs["rank"][run]
        out = batch.drop_columns(["rank"])
        out = out.append_column("sequence_id", pa.array(runs["bin"][run] + inside // runs["per_bin"][run], pa.int64()))
        yield out.append_column("offset", pa.array(runs["offset"][run] + inside % runs["per_bin"][run] * length, pa.int64()))


def _schema(frame: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", " + more


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, each document closed by id 0."""
    bound_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(partial(_encoded, path=path, capacity=capacity), _schema(rows.drop("text"), "piece int, start long, length long, ids_crc32 long"))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` should be a stored table: it is read for the counts and for the places.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity).arrays())
    ranked = gapless(pieces, ["length"], order, "rank", buckets=256)
    return ranked.mapInArrow(partial(_placed, plan=plan), _schema(pieces, "sequence_id long, offset long"))


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut. Only doc_id and text are read. A null or
    empty text is the closing id alone, repeated rows are packed each, an empty table gives no
    rows. Of pieces of one length it is arbitrary, but repeatable, which goes where.
    """
    pieces = stored(token_pieces(documents, path, capacity), "token-pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
