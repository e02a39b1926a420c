"""Benchmark decontamination with an FM-index per training shard.

Items are cut into windows of ten words (shorter items are one window). A task reads its
documents in shards of bounded size, writes each as a sequence of word symbols, builds an
FM-index over it and searches all windows backwards through the ranks of a wavelet tree;
sampled suffix positions give the places, and touching places merge into removal spans.
Words that occur in no item cannot be part of a hit, so they only separate; stretches between
them that are shorter than the shortest window are left out of the index.

The benchmark reaches the tasks in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark
is searched block after block while the documents stream through, so nothing larger than a
block is broadcast or held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, bound_batches, quoted, ranges, same_words, utf8, word_bounds, word_codes
from fleetlens.llm.suffixes import FMIndex

WINDOW = 10
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 4 << 20
SHARD_SYMBOLS = 1 << 20


@dataclass
class Block:
    """Windows of some items: the words in order of their hash, and per length the phrases and the items that have them.

    Words of a block have different hashes under its seed; ``data`` and ``bounds`` are their bytes.
    """

    vocabulary: np.ndarray
    phrases: dict[int, tuple[np.ndarray, list[list[str]]]]
    data: np.ndarray
    bounds: np.ndarray
    seed: int = 0


def item_words(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    items, size = [], 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    for row in named.toLocalIterator():
        words = item_words(row["text"])
        if words:
            items.append((row["item"], words))
            size += len(words)
        if size >= block_words:
            yield _block(items, window)
            items, size = [], 0
    if items:
        yield _block(items, window)


def _block(items: list[tuple[str, list[bytes]]], window: int) -> Block:
    words = sorted({w for _, own in items for w in own})
    data, bounds = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
    seed = 0
    while len(np.unique(hashes := word_codes(data, bounds[:-1], bounds[1:], seed))) < len(words):
        seed += 1
    by_hash = np.argsort(hashes)
    words = [words[i] for i in by_hash]
    symbol = {w: i + 1 for i, w in enumerate(words)}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, own in items:
        symbols = [symbol[w] for w in own]
        for at in range(max(1, len(symbols) - window + 1)):
            owners.setdefault(tuple(symbols[at : at + window]), set()).add(item)
    lengths = sorted({len(p) for p in owners})
    by_length = {n: [p for p in owners if len(p) == n] for n in lengths}
    phrases = {n: (np.array(p, np.int64), [sorted(owners[x]) for x in p]) for n, p in by_length.items()}
    return Block(hashes[by_hash], phrases, np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words])), seed)


class _Shard:
    """Batches of documents that share one index."""

    def __init__(self, block: Block):
        self.block = block
        self.shortest = min(block.phrases)
        # Most words are in no item: a small table of hash prefixes tells so at once.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[block.vocabulary >> np.uint64(44)] = True
        self.clear()

    def clear(self) -> None:
        self.batches, self.symbols, self.bytes, self.count = [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, bounds = utf8(batch.column("text"))
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, bounds)
        first, last = starts - bounds[rows], ends - bounds[rows]
        hashes = word_codes(data, starts, ends, self.block.seed)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.block.vocabulary, hashes[maybe]), len(self.block.vocabulary) - 1)
        known = self.block.vocabulary[place] == hashes[maybe]
        words, place = maybe[known], place[known]
        # Equal hashes are not yet equal words.
        known = same_words(data, starts[words], ends[words], self.block.data, self.block.bounds[place], self.block.bounds[place + 1])
        words, symbols = words[known], place[known] + 1
        # Stretches of known words in a row of one document, long enough to hold a window.
        breaks = np.ones(len(words) + 1, bool)
        breaks[1:-1] = (np.diff(words) != 1) | (np.diff(rows[words]) != 0)
        edges = np.flatnonzero(breaks)
        lengths = np.diff(edges)
        long = lengths >= self.shortest
        # One more place after each stretch, for the separator.
        taken = ranges(edges[:-1][long], lengths[long] + 1)
        ends = np.cumsum(lengths[long] + 1) - 1
        sequence = np.append(symbols, 0)[taken]
        sequence[ends] = 0
        word = np.append(words, 0)[taken]
        self.batches.append((batch, np.bincount(rows, minlength=len(batch)), word, rows[word] if len(rows) else word, first, last))
        self.symbols.append(sequence)
        self.bytes += batch.nbytes
        self.count += len(sequence)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.count >= SHARD_SYMBOLS

    def hits(self) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
        """Place in the sequence, length and items of each occurrence of a window."""
        places, lengths, owners, whose = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        sequence = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int64)
        if len(sequence):
            index = FMIndex(sequence)
            for length, (phrases, items) in self.block.phrases.items():
                low, high = index.search(phrases)
                found = high - low
                places.append(index.locate(ranges(low, found)))
                lengths.append(np.full(int(found.sum()), length))
                whose.append(np.repeat(np.arange(len(phrases)), found) + len(owners))
                owners += items
        return np.concatenate(places), np.concatenate(lengths), owners, np.concatenate(whose)

    def flush(self) -> Iterator[pa.RecordBatch]:
        place, length, owners, whose = self.hits()
        by = np.argsort(place, kind="stable")
        place, length, whose = place[by], length[by], whose[by]
        offset = 0
        for (batch, n_words, word, row, first, last), symbols in zip(self.batches, self.symbols):
            a, b = np.searchsorted(place, [offset, offset + len(symbols)])
            at = place[a:b] - offset
            offset += len(symbols)
            items, spans = batch.column("items").to_pylist(), batch.column("spans").to_pylist()
            found: dict[int, list] = {}
            for r, w, n, who in zip(row[at].tolist(), word[at].tolist(), length[a:b].tolist(), whose[a:b].tolist()):
                found.setdefault(r, []).append((w, n, who))
            base = np.append(0, np.cumsum(n_words))
            for r, hits in found.items():
                fresh = [(w - int(base[r]), w + n - int(base[r]), int(first[w]), int(last[w + n - 1])) for w, n, _ in hits]
                spans[r] = _merge(fresh + [tuple(s.values()) for s in spans[r]])
                items[r] = sorted(set(items[r]).union(*(owners[who] for who in {h[2] for h in hits})))
            out = batch.drop_columns(["n_words", "items", "spans"])
            kind = batch.schema.field("spans").type
            for name, values in (("n_words", pa.array(n_words, pa.int64())), ("items", pa.array(items, pa.list_(pa.string()))), ("spans", pa.array(spans, kind))):
                out = out.append_column(name, values)
            yield out
        self.clear()


def _merge(spans: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for w0, w1, b0, b1 in sorted(spans):
        if out and w0 <= out[-1][1]:
            out[-1][1], out[-1][3] = max(w1, out[-1][1]), max(b1, out[-1][3])
        else:
            out.append([w0, w1, b0, b1])
    return [dict(zip(("word_start", "word_end", "byte_start", "byte_end"), s)) for s in out]


def _searched(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    shard = _Shard(block.value)
    for batch in batches:
        shard.add(batch)
        if shard.full():
            yield from shard.flush()
    yield from shard.flush()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, text, n_words, items, spans) of each document: all its columns but the text as a struct, and the merged hits in words and bytes.

    Columns of any name may come along, since they stay inside ``row``. A null or empty text has no words; an item without words has no window; a null item_id is
    the item named "". Repeated rows are judged each, overlapping hits merge, hits end with
    their document. Texts of any length are read whole; a shard holds at least one document.
    Without items every document is clean, and an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    spans = F.array().cast("array<struct<word_start:int,word_end:int,byte_start:int,byte_end:int>>")
    # A struct holds at least one field, the text's place, for documents of one column.
    row = F.struct(*[quoted(c) if c != "text" else F.lit(None).cast("string").alias("text") for c in documents.columns])
    out = documents.select(row.alias("row"), F.col("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), spans.alias("spans"))
    blocks = list(map(spark.sparkContext.broadcast, benchmark_blocks(benchmark, window, block_words)))
    if not blocks:
        # Words are counted all the same: one phrase that no text can hold.
        blocks = [spark.sparkContext.broadcast(Block(np.zeros(1, np.uint64), {1 << 30: (np.zeros((0, 1), np.int64), [])}, np.zeros(0, np.uint8), np.zeros(2, np.int64)))]
    for block in blocks:
        out = out.mapInArrow(partial(_searched, block=block), out.schema)
    return out


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word_start"])
    return found.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        for row, cuts in enumerate(spans):
            if cuts:
                data, out, at = texts[row].encode(), [], 0
                for cut in cuts:
                    out.append(data[at : cut["byte_start"]])
                    at = cut["byte_end"]
                texts[row] = b"".join([*out, data[at:]]).decode()
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type)).drop_columns(["spans"])


def remove_spans(found: DataFrame) -> DataFrame:
    """The documents with their hits cut out of the text."""
    rows = found.select("row", "text", "spans")
    names = found.schema["row"].dataType.names
    inside = lambda name: F.col("row").getField(name).alias(name)
    return rows.mapInArrow(_cut, rows.drop("spans").schema).select(*["text" if n == "text" else inside(n) for n in names])
