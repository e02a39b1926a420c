"""Removal of repeated passages by bounded interval expansion on a Burrows-Wheeler transform.

Every byte is removed that lies in a string of ``least`` bytes which also starts elsewhere.

Each window of ``least`` bytes belongs to the piece around its smallest hashed gram (the
leftmost of equal ones). Equal windows have the same smallest gram at the same place, so they
meet under one anchor, and pieces of an anchor that occurs once are done. For the others the
distinct contents are brought together, a Burrows-Wheeler transform is built over a few hundred
kilobytes of them at a time, and suffix intervals are extended backwards breadth first, which
finds common prefix lengths by increasing value; it stops at ``least``. Neighbouring suffixes
whose length was not found by then share ``least`` bytes or more.

Anchors with very many distinct pieces are cut into blocks of windows, told apart by the bytes
all windows of the block share, so that no group grows with the number of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, gram_hashes, prefix_sums, ranges, stored, stretch_hash, utf8
from fleetlens.llm.suffixes import suffix_array

LEAST = 200
GRAM = 24
HOT_PIECES = 500
HOT_BLOCK = 16
CORE_PRIME = (1 << 59) - 55
BATCH = 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from running minima forwards and backwards in blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchored_pieces(column: pa.Array, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, place of the anchor in the piece, anchor, digest) of each piece."""
    data, bounds = utf8(column)
    windows = np.maximum(np.diff(bounds) - least + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = prefix_sums(data)
    grams = gram_hashes(sums, gram)
    # A gram's leading bits with its place behind them: the least of them is the leftmost smallest.
    mask = np.uint64((1 << max(22, len(grams).bit_length())) - 1)
    placed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    starts = ranges(bounds[:-1], windows)
    place = (sliding_least(placed, least - gram + 1) & mask).view(np.int64)[starts]
    breaks = np.ones(len(starts) + 1, bool)
    breaks[1:-1] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    edges = np.flatnonzero(breaks)
    first, many, place = starts[edges[:-1]], np.diff(edges), place[edges[:-1]]
    row = np.searchsorted(bounds, first, side="right") - 1
    return row, first - bounds[row], many, place - first, grams[place], stretch_hash(sums, first, first + many - 1 + least)


def repeated_windows(contents: list[bytes], weights: list[int], least: int = LEAST) -> list[np.ndarray]:
    """For each content whether the window from each place occurs twice, a content counting ``weight`` times."""
    sizes = np.array([len(c) for c in contents])
    heads = np.cumsum(sizes + 1) - sizes - 1
    # byte + 2; 1 ends a content, 0 ends all
    symbols = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int64)
    symbols[-1] = 0
    symbols[ranges(heads, sizes)] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 2
    n = len(symbols)
    packed, padded = np.zeros(n, np.int64), np.append(symbols, np.zeros(7, np.int64))
    for i in range(7):
        packed = packed << 9 | padded[i : i + n]
    order = suffix_array(packed, 7)
    bwt = symbols[order - 1].astype(np.uint16)
    back = np.empty(n, np.int64)  # the place of the suffix one symbol longer
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)  # boundaries whose common prefix is shorter than the level
    known[0] = known[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(least):
        size = high - low
        inside = ranges(low, size)
        longer = back[inside]
        owner = np.repeat(np.arange(len(size)), size)
        by = np.argsort(longer)
        longer, owner = longer[by], owner[by]
        fresh = np.ones(len(longer) + 1, bool)
        fresh[1:-1] = (np.diff(longer) != 1) | (np.diff(owner) != 0) | (np.diff(bwt[inside[by]].astype(np.int32)) != 0)
        edges = np.flatnonzero(fresh)
        low, high = longer[edges[:-1]], longer[edges[1:] - 1] + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(high):
            break
    class_ = np.empty(n, np.int64)
    class_[order] = np.cumsum(known[:n])
    own = np.maximum(sizes - least + 1, 0)
    classes = class_[ranges(heads, own)]
    count = np.bincount(classes, weights=np.repeat(np.array(weights), own))
    return np.split(count[classes] >= 2, np.cumsum(own)[:-1])


def _pieces(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, start, windows, lead, anchor, digest = anchored_pieces(batch.column("text"), least, gram)
        out = batch.select(["doc_id", "h"]).take(pa.array(row, pa.int64()))
        for name, values, kind in (("start", start, pa.int32()), ("windows", windows, pa.int16()), ("lead", lead, pa.int16())):
            out = out.append_column(name, pa.array(values, kind))
        for name, values in (("anchor", anchor), ("digest", digest)):
            out = out.append_column(name, pa.array(values.astype(np.uint64).view(np.int64), pa.int64()))
        yield out


def _contents(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted pieces; pieces of hot anchors as one part per block of windows."""
    names = ("anchor", "part", "digest", "many", "offset", "lead", "content")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for text, wanted in zip(texts, batch.column("wanted").to_pylist()):
            for w in wanted:
                content = text[w["start"] : w["start"] + w["windows"] - 1 + least]
                if not w["hot"]:
                    rows.append((w["anchor"], 0, w["digest"], w["many"], 0, w["lead"], content))
                    continue
                # Places of windows count from the first window that can have the anchor.
                first, at = least - gram - w["lead"], 0
                while at < w["windows"]:
                    block = (first + at) // HOT_BLOCK
                    end = min(w["windows"], (block + 1) * HOT_BLOCK - first)
                    core = content[(block + 1) * HOT_BLOCK - 1 - first : block * HOT_BLOCK - first + least]
                    part = int.from_bytes(core, "big") % CORE_PRIME * 16 + block + 1
                    rows.append((w["anchor"], part, w["digest"], w["many"], at, -1, content[at : end - 1 + least]))
                    at = end
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], list(names))


def _candidates(group: dict[bytes, list], least: int, gram: int) -> Iterator[tuple[bytes, list]]:
    """Contents of one anchor that can share a window with another one.

    A window has at least half of its bytes beside the anchor on one side of it, so contents
    that share a window agree on those bytes to the left or on those to the right. Nothing is
    asked of pieces that occur more than once: all their windows are repeated.
    """
    half = (least - gram) // 2
    sides: dict[tuple[int, bytes], list] = {}
    keys = {}
    for content, (weight, lead, owners) in group.items():
        if lead < 0:  # a part whose contents agree already
            own = [(2, b"")]
        else:
            own = [(side, part) for side, part in ((0, content[lead - half : lead + gram] if lead >= half else b""), (1, content[lead : lead + gram + half])) if len(part) == gram + half]
        keys[content] = own
        for key in own:
            entry = sides.setdefault(key, [0, False])
            entry[0] += weight
            entry[1] |= any(many == 1 for _, many, _ in owners)
    for content, own in keys.items():
        if any(sides[key][0] > 1 and sides[key][1] for key in own):
            yield content, group[content]


def _expanded(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, from, to): stretches of repeated windows in pieces that occur once."""
    held: list[tuple[int, bytes, list]] = []  # anchor, content, what has it
    group: dict[bytes, list] = {}  # content -> weight, place of the anchor, (digest, copies, offset)
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        found = repeated_windows([c for _, c, _ in held], [e[0] for _, _, e in held], least) if held else []
        for (anchor, _, (_, _, owners)), repeated in zip(held, found):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))).reshape(-1, 2).tolist()
            for digest, many, offset in owners:
                if many == 1:
                    out += [(anchor, digest, offset + a, offset + b) for a, b in edges]
        held.clear()
        kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["anchor", "digest", "first", "last"])

    def close() -> int:
        added = 0
        for content, entry in _candidates(group, least, gram):
            held.append((last[0], content, entry))
            added += len(content)
        group.clear()
        return added

    for batch in batches:
        for anchor, part, digest, many, offset, lead, content in zip(*(c.to_pylist() for c in batch.columns)):
            if (anchor, part) != last:
                if group:
                    size += close()
                if size >= BATCH:
                    yield flush()
                    size = 0
                last = (anchor, part)
            entry = group.setdefault(content, [0, lead, []])
            if (digest, many, offset) not in entry[2]:
                entry[0] += many
                entry[2].append((digest, many, offset))
    if group:
        close()
    yield flush()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        kept, spans = [], []
        for text, found in zip(texts, batch.column("found").to_pylist()):
            text, merged = text or b"", []
            for start, end in sorted((f["start"], f["end"]) for f in found or ()):
                if merged and start <= merged[-1]["end"]:
                    merged[-1]["end"] = max(end, merged[-1]["end"])
                else:
                    merged.append({"start": start, "end": end})
            cuts = [0, *(x for m in merged for x in (m["start"], m["end"])), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if merged else text)
            spans.append(merged)
        out = batch.select(["doc_id"]).append_column("n_bytes", pa.array([len(t or b"") for t in texts], pa.int64()))
        out = out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        yield out.append_column("kept", pa.array(kept, pa.binary()))


def remove_repeats(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the remaining bytes) of every document.

    Texts are UTF-8 bytes, read whole; a null text is empty, and a text under ``least`` bytes is
    kept. A string counts as repeated wherever its other start is, in the same document too, and
    in rows that repeat each other. What is repeated is judged on the input. Only doc_id and text
    are read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    pieces = rows.mapInArrow(
        partial(_pieces, least=least, gram=gram), f"doc_id {kind}, h long, start int, windows short, lead short, anchor long, digest long"
    )
    # Stored, so that the join reads two shuffles of its own and a hot anchor can be split.
    anchors = stored(pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    shared = stored(pieces.join(anchors, "anchor", "left_semi"), "repeated-anchors")

    source = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "start", "windows", "lead")).alias("s")
    distinct = stored(shared.groupBy("anchor", "digest").agg(source, F.count("*").alias("many")), "distinct-pieces")
    per_anchor = stored(distinct.groupBy("anchor").agg(F.count("*").alias("contents")).filter("contents > 1"), "contents-per-anchor")
    wanted = distinct.join(per_anchor, "anchor").select(
        F.col("s.doc_id").alias("_doc"), F.col("s.h").alias("_h"),
        F.struct("anchor", "digest", "many", "s.start", "s.windows", "s.lead", (F.col("contents") > HOT_PIECES).alias("hot")).alias("w"),
    )
    wanted = wanted.groupBy("_doc", "_h").agg(F.collect_list("w").alias("wanted"))
    sources = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["h"] == wanted["_h"])).select("text", "wanted")
    contents = sources.mapInArrow(
        partial(_contents, least=least, gram=gram), "anchor long, part long, digest long, many long, offset short, lead short, content binary"
    )
    grouped = contents.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")
    expanded = grouped.mapInArrow(partial(_expanded, least=least, gram=gram), "anchor long, digest long, first short, last short")
    whole = distinct.filter("many > 1").select("anchor", "digest", F.lit(0).cast("short").alias("first"), F.col("s.windows").alias("last"))
    found = stored(expanded.unionByName(whole), "repeated-windows")

    spans = shared.join(found, ["anchor", "digest"]).select(
        F.col("doc_id").alias("_doc"), F.col("h").alias("_h"),
        F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") - 1 + least).alias("end")).alias("span"),
    )
    spans = spans.groupBy("_doc", "_h").agg(F.collect_set("span").alias("found"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_doc"]) & (rows["h"] == spans["_h"]), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def report(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
