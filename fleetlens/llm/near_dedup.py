"""Near-duplicates by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it occurred
before. A sketch takes the ``DRAWN`` smallest labelled shingles under a seeded hash and keeps
them in text order, so it meets for texts that share shingles in the same order. Every text is
sketched. Texts of at most ``SHORT`` shingles, and those that can be near one, have exact keys in
addition: every choice of ``DRAWN`` among so many of their smallest labels that near texts have a
choice in common, since few labels give sketches too few ways to meet. Texts with a key in common are candidates and are verified by aligning
their shingle sequences inside the band the threshold allows: similarity is aligned shingles over
all shingles, 0.8 or more.

Equal sequences are one node. In each sketch bucket every node is first verified against the two
ends of the bucket, and links contract to components. Buckets that then still hold several
components are compared across components, in blocks of bounded size, until no unverified pair
across components is left; pairs inside a component can add nothing. Classes are therefore those
of all candidate pairs, and no bucket is cut off or emitted pair by pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import LOWER, bound_batches, kept_apart, mix, prefix_sums, ranges, stored, stretch_hash, utf8, word_bounds, word_codes
from fleetlens.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 16
DRAWN = 3
SHORT = 12
BLOCK_NODES = 1000


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and how many each row has; a text of fewer words is one shingle."""
    data, bounds = utf8(column)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, bounds)
    words = word_codes(data, starts, ends)
    per_row = np.bincount(rows, minlength=len(bounds) - 1).astype(np.int64)
    base = np.cumsum(per_row) - per_row
    counts = np.where(per_row > 0, np.maximum(per_row - width + 1, 1), 0)
    first = ranges(base, counts)
    last = np.minimum(first + width, np.repeat(base + per_row, counts))
    return stretch_hash(prefix_sums(words), first, last), counts


def labelled(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles told apart by their number among equals in the row."""
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = mix(hashes ^ mix(rows + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    fresh = np.append(True, own[order][1:] != own[order][:-1]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    number = np.zeros(len(order), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(hashes + number * np.uint64(0x9E3779B97F4A7C15))


def sketches(labels: np.ndarray, counts: np.ndarray, many: int = SKETCHES, drawn: int = DRAWN) -> np.ndarray:
    """Rows with shingles by sketches: hashes of the drawn labels in text order."""
    counts = counts[counts > 0]
    out = np.zeros((len(counts), many), np.uint64)
    if not len(counts):
        return out
    heads = np.cumsum(counts) - counts
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for seed in range(many):
        values = mix(labels, 0xA5A5A5A5 * (seed + 1))
        left = values.copy()
        for _ in range(drawn):
            limit = np.repeat(np.minimum.reduceat(left, heads), counts)
            left[left == limit] = top
        chosen = np.flatnonzero(values <= limit)
        sizes = np.minimum(counts, drawn)
        starts = np.cumsum(sizes) - sizes
        place = (np.arange(len(chosen)) - np.repeat(starts, sizes)).astype(np.uint64) if len(chosen) == sizes.sum() else None
        if place is None:  # equal hash values of different labels
            row = np.searchsorted(heads, chosen, side="right") - 1
            sizes = np.bincount(row, minlength=len(counts))
            starts = np.cumsum(sizes) - sizes
            place = (np.arange(len(chosen)) - starts[row]).astype(np.uint64)
        out[:, seed] = mix(np.add.reduceat(mix(labels[chosen] ^ mix(place + np.uint64(7))), starts), seed + 1)
    return out


def longest_partner(threshold: float, short: int = SHORT) -> int:
    """Most shingles of a text that can be near one of ``short``."""
    return int(short / threshold + 1e-9)


def exact_keys(labels: np.ndarray, counts: np.ndarray, threshold: float = THRESHOLD, drawn: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): rows of few shingles that can be near each other have a key in common.

    Near texts share at least ``least`` labels, the threshold's part of the longer one. The
    ``drawn`` smallest of these have ``least - drawn`` shared labels above them, so both texts
    have them among their n - least + drawn smallest. Labels are taken without their order,
    which an alignment keeps for shingles and not for the numbers of equal ones.
    """
    heads = np.cumsum(counts) - counts
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    least = lambda n: int(np.ceil(n * threshold - 1e-9))
    for n in range(1, longest_partner(threshold) + 1):
        own = np.flatnonzero(counts == n)
        if not len(own):
            continue
        smallest = np.sort(labels[heads[own][:, None] + np.arange(n)], axis=1)
        # A shorter text may share fewer labels than are drawn.
        for size in range(min(drawn, least(least(n))), min(drawn, least(n)) + 1):
            for chosen in combinations(range(n - least(n) + size), size):
                key = np.full(len(own), size, np.uint64)
                for place in chosen:
                    key = mix(key ^ smallest[:, place], 0x51ED270B)
                rows.append(own)
                keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def _digests(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128-bit digest of each row's shingle sequence."""
    heads = np.append(0, np.cumsum(counts)).tolist()
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(heads, heads[1:])]


def _sketched(batches: Iterator[pa.RecordBatch], width: int, many: int, drawn: int, threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, counts = shingles(batch.column("text"), width)
        labels = labelled(hashes, counts)
        rows, keys = exact_keys(labels, counts, threshold, drawn)
        drawings = sketches(labels, counts, many, drawn)
        rows = np.concatenate([rows, np.repeat(np.flatnonzero(counts), many)])
        keys = np.concatenate([keys, drawings.ravel()])[np.argsort(rows, kind="stable")].view(np.int64)
        bounds = np.append(0, np.cumsum(np.bincount(rows, minlength=len(counts)))).astype(np.int32)
        out = batch.select(["doc_id"])
        out = out.append_column("node", pa.array(_digests(hashes, counts), pa.binary()))
        out = out.append_column("n", pa.array(counts, pa.int64()))
        yield out.append_column("keys", pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys)))


def least_aligned(n: int, m: int, threshold: float) -> int:
    """Aligned shingles that texts of n and m shingles need."""
    return int(np.ceil((n + m) * threshold / (1 + threshold) - 1e-9))


def aligned_enough(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the longest common subsequence reaches the threshold, searched in a band.

    The band is the number of unaligned shingles the threshold allows; diagonals are followed
    outwards from the middle, each as far as it goes.
    """
    need = least_aligned(len(a), len(b), threshold)
    if min(len(a), len(b)) < need:
        return False
    band = len(a) + len(b) - 2 * need
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    n, m = len(a), len(b)
    if (Counter(a) & Counter(b)).total() + head + tail < need:
        return False
    reach = {1: 0}
    for edits in range(band + 1):
        for diagonal in range(-edits, edits + 1, 2):
            down = diagonal == -edits or (diagonal != edits and reach[diagonal - 1] < reach[diagonal + 1])
            x = reach[diagonal + 1] if down else reach[diagonal - 1] + 1
            y = x - diagonal
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[diagonal] = x
            if x >= n and y >= m:
                return True
    return False


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        keep = [aligned_enough(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(left, right)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of equal keys, which follow each other."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = [row[k] for k in keys]
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def cross_links(members: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links across the components of one bucket, one for each pair of components that has any."""
    sequences = [np.frombuffer(m["sequence"], np.uint32) for m in members]
    sizes = np.array([len(s) for s in sequences])
    root = {m["root"]: m["root"] for m in members}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = np.repeat(np.arange(len(members)), sizes)
    symbols = np.concatenate(sequences)
    order = np.argsort(symbols, kind="stable")
    symbols, owner = symbols[order], owner[order]
    largest = Counter(m["root"] for m in members).most_common(1)[0][0]
    out = []
    for i in (i for i, m in enumerate(members) if m["root"] != largest):
        own = np.unique(sequences[i])
        low, high = np.searchsorted(symbols, own, "left"), np.searchsorted(symbols, own, "right")
        shared = np.bincount(owner[ranges(low, high - low)], minlength=len(members))
        need = (sizes + sizes[i]) * threshold / (1 + threshold) - 1e-9
        able = np.flatnonzero((np.minimum(shared, sizes[i]) >= need) & (np.minimum(sizes, sizes[i]) >= need))
        for j in able[np.argsort(-shared[able], kind="stable")].tolist():
            x, y = find(members[i]["root"]), find(members[j]["root"])
            if x != y and aligned_enough(sequences[i], sequences[j], threshold):
                root[max(x, y)] = min(x, y)
                out.append((members[i]["node"], members[j]["node"]))
    return out


def _crossed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for members in _groups(batches, ["key", "low", "high"]):
        found = cross_links(members, threshold)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in zip(*found)], ["a", "b"])


def _with_sequences(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    left = sequences.select(F.col("node").alias("a"), F.col("sequence").alias("left"))
    right = sequences.select(F.col("node").alias("b"), F.col("sequence").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(documents: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, many: int = SKETCHES, drawn: int = DRAWN) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_shingles, kept.

    A class is a connected group of near-duplicates, class_id its smallest doc_id, and kept marks
    the one document of the class that stays: the one with that doc_id, or one of the rows that
    repeat it. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Texts
    of fewer than five words are near only if their words are equal; texts without words (null,
    empty) are near each other. Null doc_ids are numbered last in a class. Only doc_id and text
    are read; whole texts are; an empty table gives no rows.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketched = rows.mapInArrow(partial(_sketched, width=width, many=many, drawn=drawn, threshold=threshold), f"doc_id {kind}, node binary, n long, keys array<long>")
    # A number per row tells rows apart that repeat doc_id and words.
    sketched = stored(sketched.withColumn("_n", F.monotonically_increasing_id()), "order-sketches")

    members = sketched.select("node", F.explode("keys").alias("key")).distinct()
    # Tables of groups are stored before they are joined: then both sides of the join are plain
    # shuffles, and Spark can split a key that many rows share.
    ends = stored(members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high"), "bucket-ends")
    shared = stored(members.join(ends, "key"), "sketch-buckets")
    pairs = shared.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
    pairs = pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()

    wanted = shared.select("node").distinct()
    sources = sketched.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("s")).join(wanted, "node")
    sources = sources.select("node", F.col("s.doc_id").alias("_source"))
    texts = rows.join(sources, rows["doc_id"].eqNullSafe(sources["_source"])).select("node", "text")
    sequences = texts.mapInArrow(partial(_checked_sequences, width=width), "node binary, sequence binary")
    sequences = stored(sequences.dropDuplicates(["node"]), "shingle-sequences")

    links = stored(_with_sequences(pairs, sequences).mapInArrow(partial(_verified, threshold=threshold), "a binary, b binary"), "near-links")
    roots = components(links)
    more = _links_across(shared, roots, sequences, threshold)
    if not more.isEmpty():
        # The stars found so far stand for the links behind them.
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    placed = _rooted(sketched.select("doc_id", "node", "n", "_n"), roots)
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "_n")
    placed = stored(placed, "placed-documents")
    groups = stored(placed.groupBy("root").agg(F.min(one).alias("one"), F.count("*").alias("class_size")), "near-classes")
    each = placed.join(groups, "root")
    kept = F.col("_n") == F.col("one._n")
    return each.select("doc_id", F.col("one.doc_id").alias("class_id"), "class_size", F.col("n").alias("n_shingles"), kept.alias("kept"), F.col("node").alias("_node"))


def _links_across(shared: DataFrame, roots: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Links between components that meet in a bucket."""
    rooted = _rooted(shared.select("key", "node"), roots)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("many")).filter("x <> y")
    mixed = stored(mixed, "mixed-buckets")
    blocks = F.ceil(F.col("many") / BLOCK_NODES).cast("int")
    members = rooted.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root")
    sent = members.join(sequences, "node").select("key", "low", "high", "node", "root", "sequence")
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = sent.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return stored(grouped.mapInArrow(partial(_crossed, threshold=threshold), "a binary, b binary").distinct(), "cross-links")


def _checked_sequences(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sequences of the texts that are the node's, where a doc_id has several texts."""
    for batch in batches:
        hashes, counts = shingles(batch.column("text"), width)
        heads = np.append(0, np.cumsum(counts))
        symbols = (hashes >> np.uint64(32)).astype(np.uint32)
        nodes, rows, parts = batch.column("node").to_pylist(), [], []
        for i, digest in enumerate(_digests(hashes, counts)):
            if digest == nodes[i]:
                rows.append(digest)
                parts.append(symbols[heads[i] : heads[i + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(parts, pa.binary())], ["node", "sequence"])


def _nodes(width: int):
    @F.arrow_udf("binary")
    def nodes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_digests(*shingles(column, width)), pa.binary())

    return nodes


def keep_documents(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each class, with all its columns, whatever their names."""
    kept = classes(documents, width=width).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("_node").alias("keep_node"))
    marked = kept_apart(documents, "doc_id", _nodes(width)(F.col("text")).alias("node"))
    # Of rows that repeat doc_id and words a task sends one.
    first = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("doc_id"))
    marked = marked.withColumn("first", first).filter("first = 1")
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["keep_id"]) & (marked["node"] == kept["keep_node"]))
    return found.select("row.*")
