"""Phrase collocations by relational mining of sorted occurrence relations.

The relation of length 1 holds every word occurrence, sorted by piece and position. A phrase of length
k + 1 is a merge join of the relation of length k with itself: two occurrences in one piece at adjacent
positions. Its groups are counted, groups below the least count fall away, and a semi-join keeps only the
occurrences of frequent groups before the next length is joined.

A relation is stored as slices of at most ``SLICE`` occurrences: the words in their order, the first word
of every piece, and the places that are still in the relation. A slice also carries the words that follow
its last own one, so both sides of every merge join lie in one row and nothing is shuffled but counts.
Its words are coded by the different ones, and the two sets of places are bits.
Words are numbers, 64-bit hashes that the word counts prove to be different for different words (if two
ever agree, the corpus is read again with another seed).

Groups are counted twice. First by a part of their hash, in compact form, which gives a bit table of
``BITS_A_GROUP`` bits for each group found frequent, ``MOST_BITS`` at most; it is all that is broadcast. Then
exactly, for the groups that the table lets pass. The same table is the semi-join. Where it lets a rare group
pass, the exact count removes the group again, and a phrase is never more frequent than its parts, so results
do not depend on the size of the table.

Defined results: a null text is empty, a null lang is ``und``, repeated rows count again, an empty table or
one without frequent phrases gives no rows, ties are ordered by count and then by the bytes of the phrase.
Other columns are ignored. Texts are read in windows, so memory follows the longest word and not the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import bound_batches, mix, stored

SLICE = 1 << 16  # occurrences in a row of a relation
GROUP_ROWS = 32  # rows of a relation that are written and read together
WINDOW = 1 << 22  # bytes of a text read at a time
GROUPED = 1 << 20  # occurrences counted together in a task
LONG = 256  # bytes of a word up to which words are hashed together
BITS_A_GROUP = 16
PROBES = 3  # bits of the table that a group sets: one rare group in 200 finds all of its own set
MOST_BITS = 1 << 28  # 32 MB
KEY = 48  # bits of a group's hash by which it is counted before its exact count
UNKNOWN = "und"

_BREAKS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that do not cut a word. A part may end inside a piece."""
    start = 0
    while len(data) - start > WINDOW:
        gaps = np.flatnonzero(_KIND[data[start : start + WINDOW]])
        if len(gaps):
            end = start + int(gaps[-1]) + 1
        else:  # one word fills the window
            rest = np.flatnonzero(_KIND[data[start:]])
            end = start + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def _words(data: np.ndarray) -> tuple[pa.Array, np.ndarray, bool]:
    """Words of a part, which of them begin a piece, and whether a piece ends after the last."""
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    breaks = np.append(0, np.cumsum(kind == 2))
    before = np.append(0, breaks[starts])
    first = before[1:] != before[:-1]
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    packed = np.ascontiguousarray(data[inside[1:-1]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return words, first, bool(breaks[-1] > before[-1])


def _numbers(lang: bytes, words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hash of each of some different words, eight bytes at a time; long words one by one."""
    out = np.full(len(words), xxhash.xxh3_64_intdigest(lang, seed), np.uint64)
    if not len(words):
        return out.view(np.int64)
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    sizes = np.diff(bounds)
    lane, live = 0, np.flatnonzero(sizes <= LONG)
    while len(live):
        part = data[bounds[live, None] + lane + np.arange(8)]
        part[np.arange(8) + lane >= sizes[live, None]] = 0
        out[live] = mix(out[live] * np.uint64(3) ^ part.view(np.uint64).ravel())
        lane += 8
        live = live[sizes[live] > lane]
    for i in np.flatnonzero(sizes > LONG):
        out[i] = xxhash.xxh3_64_intdigest(lang + b"\0" + data[bounds[i] : bounds[i + 1]].tobytes(), seed)
    return mix(out ^ sizes.astype(np.uint64)).view(np.int64)


def _hashed(lang: bytes, words: pa.Array, seed: int) -> np.ndarray:
    """The number of each word."""
    coded = words.dictionary_encode()
    return _numbers(lang, coded.dictionary, seed)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


_RELATION = "lang string, own int, words binary, codes binary, firsts binary, places binary"


def _code(different: int) -> type:
    return np.uint16 if different <= 1 << 16 else np.uint32


def _coded(words: np.ndarray) -> tuple[bytes, bytes]:
    """The different words, and which of them each occurrence is."""
    coded = pa.array(words).dictionary_encode()
    different = coded.dictionary.to_numpy()
    return different.tobytes(), coded.indices.to_numpy().astype(_code(len(different))).tobytes()


def _flags(places: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, bool)
    flags[places] = True
    return np.packbits(flags).tobytes()


class _Slices:
    """Gathers the occurrences of a task, per language, and cuts them into rows of a relation."""

    def __init__(self, ahead: int, frequent: Frequent):
        self.ahead, self.frequent, self.held = ahead, frequent, {}

    def add(self, lang: str, words: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = self.held.setdefault(lang, [[], [], 0])
        held[0].append(words)
        held[1].append(first)
        held[2] += len(words)
        if held[2] >= SLICE + self.ahead:
            yield from self.cut(lang, False)

    def cut(self, lang: str, last: bool) -> Iterator[pa.RecordBatch]:
        held = self.held[lang]
        words, first = (np.concatenate(h) for h in held[:2])
        start = 0
        while len(words) - start >= SLICE + self.ahead or (last and start < len(words)):
            part = slice(start, start + SLICE + self.ahead)
            own, every = min(SLICE, len(words) - start), np.arange(len(words[part]))
            places = every[self.frequent.holds(words[part], every)]
            packed = [*_coded(words[part]), np.packbits(first[part]).tobytes(), _flags(places, len(every))]
            columns = [pa.array([lang]), pa.array([own], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RELATION.split(", ")])
            start += own
        held[:] = [words[start:]], [first[start:]], len(words) - start


def _texts(documents: DataFrame) -> DataFrame:
    return documents.filter("text <> ''").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language's texts of a batch as lower-cased bytes, one piece break between two texts."""
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, parts in texts.items():
        yield lang, np.frombuffer("\n".join(parts).encode().translate(_LOWER), np.uint8)


def occurrences(documents: DataFrame, longest: int, seed: int, frequent: Frequent) -> DataFrame:
    """The relation of length 1: all words in their order, and the places of the frequent ones."""
    table = documents.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _Slices(longest - 1, table.value)
        for batch in batches:
            for lang, data in _by_lang(batch):
                begins = True  # a text begins a piece
                for part in _windows(data):
                    words, first, ended = _words(part)
                    if len(words):
                        first[0] |= begins
                        begins = ended
                        numbers = _hashed(lang.encode(), words, seed)
                        yield from slices.add(lang, numbers, first)
                    else:
                        begins |= ended
        for lang in slices.held:
            yield from slices.cut(lang, True)

    return _texts(documents).mapInArrow(read, _RELATION)


def word_counts(documents: DataFrame, seed: int) -> DataFrame:
    """(lang, word, w1, f) of all words; w1 is the number of the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in _by_lang(batch):
                for part in _windows(data):
                    counts = _words(part)[0].value_counts()
                    word = counts.field("values")
                    numbers = _numbers(lang.encode(), word, seed)
                    columns = [pa.array([lang] * len(word), pa.string()), word.cast(pa.large_string()).cast(pa.string()), pa.array(numbers), counts.field("counts")]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "w1", "f"])

    counted_ = _texts(documents).mapInArrow(count, "lang string, word string, w1 long, f long")
    return counted_.groupBy("lang", "word", "w1").agg(F.sum("f").alias("f"))


def _bit(words: list[np.ndarray], bits: int) -> np.ndarray:
    """The first ``bits`` bits of the hash of each group."""
    key = np.zeros(len(words[0]), np.uint64)
    for column in words:
        key = mix(key * np.uint64(31) + column.view(np.uint64) + np.uint64(1))
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _grams(words: np.ndarray, places: np.ndarray, k: int) -> list[np.ndarray]:
    return [words[places + i] for i in range(k)]


def _columns(k: int) -> list[str]:
    return [f"w{i + 1}" for i in range(k)]


def _power(least: float, low: int, high: int) -> int:
    """The exponent of the smallest power of two that is not below ``least``, within bounds."""
    return min(high, max(low, math.ceil(math.log2(max(1, least)))))


def _probed(keys: np.ndarray, probe: int, cut: int, power: int) -> np.ndarray:
    """The bit of a table of ``power`` bits that each key sets at a probe: in the part of its range, the first ``cut`` bits of the key."""
    inside = power - cut
    return (keys >> (KEY - cut) << inside) + (mix(keys.view(np.uint64), probe + 1) >> np.uint64(64 - inside)).astype(np.int64)


class Frequent:
    """Bit table of the groups of ``k`` words that may be frequent; it never stops a frequent one.

    Groups are counted by ``KEY`` bits of their hash: every task sends its sorted keys and counts as one row per
    range of keys, and one task adds up a range. How many keys are frequent gives the size of the table; then each
    key sets ``PROBES`` bits in its range's part of it. Exact counts follow for what passes.
    """

    def __init__(self, groups: DataFrame, k: int, least: int, total: int, words: bool = False):
        """``groups``: the relation of length k - 1, or with ``words`` a table (w1, f); ``total``: how many groups it may hold."""
        self.k = k
        self.cut = cut = _power(total * least / GROUPED, 0, MOST_BITS.bit_length() - 4)
        most = min(least, 255)

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if words:
                for batch in batches:
                    keys, at = np.unique(_bit([batch["w1"].to_numpy()], KEY), return_inverse=True)
                    yield keys, np.bincount(at, np.minimum(batch["f"].to_numpy(), most))
            else:
                for _, grams in _gathered(batches, k, None):
                    yield np.unique(_bit(grams, KEY), return_counts=True)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, sizes in counts(batches):
                bounds = np.append(0, np.searchsorted(keys, np.arange(1, (1 << cut) + 1) << (KEY - cut)))
                used = np.flatnonzero(np.diff(bounds))
                step = np.diff(keys, prepend=0)
                step[bounds[used]] = keys[bounds[used]]
                # the bytes of small steps lie together, so the shuffle's compression removes the high ones
                parts = [step[bounds[i] : bounds[i + 1]].view(np.uint8).reshape(-1, 8).T.tobytes() for i in used]
                sizes = np.minimum(sizes, most).astype(np.uint8)
                packed = [sizes[bounds[i] : bounds[i + 1]].tobytes() for i in used]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(parts, pa.binary()), pa.array(packed, pa.binary())], ["range", "keys", "counts"])

        def add_up(rows: pd.DataFrame) -> pd.DataFrame:
            range_ = int(rows["range"].iloc[0])
            keys = np.concatenate([np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()) for b in rows["keys"]])
            counts = np.frombuffer(b"".join(rows["counts"]), np.uint8).astype(np.int64)
            order = np.argsort(keys)
            keys = keys[order]
            fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            often = keys[fresh[np.add.reduceat(counts[order], fresh) >= most]]
            return pd.DataFrame({"range": [range_], "found": [len(often)], "keys": [often.tobytes()]})

        sent = groups.mapInArrow(send, "range long, keys binary, counts binary")
        ranges = stored(sent.groupBy("range").applyInPandas(add_up, "range long, found long, keys binary"), f"ranges-{k}", GROUP_ROWS)
        found = ranges.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
        self.power = power = _power(BITS_A_GROUP * found, max(16, cut + 3), MOST_BITS.bit_length() - 1)
        held = 1 << (power - cut)

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for range_, packed in zip(batch["range"].to_pylist(), batch["keys"].to_pylist()):
                    keys, table = np.frombuffer(packed, np.int64), np.zeros(held, bool)
                    for probe in range(PROBES):
                        table[_probed(keys, probe, cut, power) - range_ * held] = True
                    yield pa.RecordBatch.from_arrays([pa.array([range_]), pa.array([np.packbits(table).tobytes()], pa.binary())], ["range", "bits"])

        self.table = np.zeros((1 << power) // 8, np.uint8)
        for range_, packed in ranges.select("range", "keys").mapInArrow(set_bits, "range long, bits binary").toLocalIterator():
            self.table[range_ * held // 8 : (range_ + 1) * held // 8] = np.frombuffer(packed, np.uint8)

    def holds(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(places), bool), np.arange(len(places))
        keys = _bit(_grams(words, places, self.k), KEY)
        for probe in range(PROBES):
            bit = _probed(keys, probe, self.cut, self.power)
            passed = (self.table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
            keys, at = keys[passed], at[passed]
        out[at] = True
        return out


def _adjacent(places: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Merge join of a sorted relation of length k with itself: places that have a next one in the same piece."""
    joined = places[:-1][np.diff(places) == 1] if len(places) else places
    # the last word of the longer phrase lies k words on, and must not begin a piece
    inside = joined + k < len(first)
    joined = joined[inside]
    return joined[~first[joined + k]]


def _row(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    different, codes, firsts, places = (batch[c][row].as_buffer() for c in ("words", "codes", "firsts", "places"))
    different = np.frombuffer(different, np.int64)
    words = different[np.frombuffer(codes, _code(len(different)))]
    first, held = (np.unpackbits(np.frombuffer(b, np.uint8), count=len(words)).astype(bool) for b in (firsts, places))
    return words, first, np.flatnonzero(held)


def semi_joined(relation: DataFrame, frequent: Frequent) -> DataFrame:
    """The occurrences of frequent groups, joined from the relation of one word less."""
    table, k = relation.sparkSession.sparkContext.broadcast(frequent), frequent.k

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in range(batch.num_rows):
                words, first, places = _row(batch, row)
                places = _adjacent(places, first, k - 1)
                kept.append(_flags(places[table.value.holds(words, places)], len(words)))
            yield batch.set_column(batch.schema.get_field_index("places"), "places", pa.array(kept, pa.binary()))

    return relation.mapInArrow(keep, _RELATION)


def _gathered(batches: Iterator[pa.RecordBatch], k: int, table) -> Iterator[tuple[str, list[np.ndarray]]]:
    """The groups of k words of a task, ``GROUPED`` occurrences at a time: joined from the relation of k - 1 words.

    With a table, only groups that may be frequent.
    """
    held: dict[str, list[list[np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[tuple[str, list[np.ndarray]]]:
        for lang, grams in held.items():
            yield lang, [np.concatenate(column) for column in grams]
        held.clear()

    for batch in batches:
        for row in range(batch.num_rows):
            words, first, places = _row(batch, row)
            places = _adjacent(places, first, k - 1)
            places = places[places < batch["own"][row].as_py()]
            if table is not None:
                places = places[table.holds(words, places)]
            for column, found in zip(held.setdefault(batch["lang"][row].as_py(), [[] for _ in range(k)]), _grams(words, places, k)):
                column.append(found)
            size += len(places)
            if size >= GROUPED:
                yield from out()
                size = 0
    yield from out()


def counted(relation: DataFrame, k: int, least: int, frequent: Frequent) -> DataFrame:
    """(w1 .. wk, f) of the frequent phrases of k words, joined from the relation of length k - 1.

    A task sends what it counted as one row per range of the groups' hashes; one task adds up a range.
    """
    names, table = _columns(k), relation.sparkSession.sparkContext.broadcast(frequent)
    cut = frequent.cut

    def summed(words: list[np.ndarray], sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Different groups in the order of their hashes, and their counts."""
        order = np.argsort(_bit(words, 62), kind="stable")
        words, sizes = [c[order] for c in words], sizes[order]
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for column in words:
            fresh[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(fresh)
        return [c[at] for c in words], np.add.reduceat(sizes, at) if len(at) else sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _gathered(batches, k, table.value):
            words, sizes = summed(words, np.ones(len(words[0]), np.int64))
            bounds = np.append(0, np.searchsorted(_bit(words, 62), np.arange(1, (1 << cut) + 1) << (62 - cut)))
            used = np.flatnonzero(np.diff(bounds))
            packed = [pa.array([c[bounds[i] : bounds[i + 1]].tobytes() for i in used], pa.binary()) for c in (*words, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(used), *packed], ["range", *names, "f"])

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        # two groups of one hash may alternate between tasks' rows, so whole groups are ordered
        words = [np.frombuffer(b"".join(rows[c]), np.int64) for c in names]
        order = np.lexsort(words)
        words, sizes = summed([c[order] for c in words], np.frombuffer(b"".join(rows["f"]), np.int64)[order])
        often = sizes >= least
        return pd.DataFrame({**{c: w[often] for c, w in zip(names, words)}, "f": sizes[often]})

    # a word's number holds its language, so the numbers alone are the group
    sent = relation.mapInArrow(count, ", ".join(["range long", *[f"{c} binary" for c in names], "f binary"]))
    return sent.groupBy("range").applyInPandas(add_up, ", ".join([*[f"{c} long" for c in names], "f long"]))


def mined(documents: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Counts of all words, and the stored frequent phrases of 1 .. ``longest`` words."""
    bound_batches(documents.sparkSession)
    seed = 0
    while True:
        words = stored(word_counts(documents, seed), "word-counts")
        if words.groupBy("w1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    tables = [stored(words.filter(F.col("f") >= least), "frequent-1")]
    singles = Frequent(tables[0].select("w1", "f"), 1, least, max(1, tables[0].count()), words=True)
    relation = stored(occurrences(documents, longest, seed, singles), "occurrences-1", GROUP_ROWS)
    # at most so many phrases of one length can be frequent
    most = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0] / least
    for k in range(2, longest + 1):
        frequent = Frequent(relation, k, least, most)
        tables.append(stored(counted(relation, k, least, frequent), f"frequent-{k}"))
        if k < longest:
            relation = stored(semi_joined(relation, frequent), f"occurrences-{k}", GROUP_ROWS)
    return words, tables


def _scored(phrases: DataFrame, tables: list[DataFrame], k: int) -> DataFrame:
    """w1 .. wk, a, l, r, score of the cut that scores least, ties to the smallest first part."""
    names = _columns(k)
    out = phrases.withColumnRenamed("f", "a")
    for cut in range(1, k):
        for part, side, shift in ((cut, "l", 0), (k - cut, "r", cut)):
            counts = tables[part - 1].select(*[F.col(c).alias(f"{c}_{side}{cut}") for c in _columns(part)], F.col("f").alias(f"{side}{cut}"))
            on = [out[names[i + shift]] == counts[f"{c}_{side}{cut}"] for i, c in enumerate(_columns(part))]
            out = out.join(counts, on).drop(*[f"{c}_{side}{cut}" for c in _columns(part)])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = []
    for cut in range(1, k):
        out = out.withColumn(f"top{cut}", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn(f"low{cut}", wide(f"l{cut}") * wide(f"r{cut}"))
        cuts.append(F.struct(F.expr(f"top{cut} div low{cut}").alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    return out.withColumn("best", F.array_min(F.array(*cuts))).select(*names, "a", "best.l", "best.r", "best.score")


def _inside_longer(longer: DataFrame, k: int) -> DataFrame:
    """(w1 .. wk, longest_f): phrases of k words that lie in a phrase of k + 1 words, with the count of the most frequent."""
    parts = F.array(*[F.struct(*[F.col(f"w{i + shift + 1}").alias(c) for i, c in enumerate(_columns(k))]) for shift in (0, 1)])
    return longer.select(F.explode(parts).alias("part"), "f").select("part.*", "f").groupBy(*_columns(k)).agg(F.max("f").alias("longest_f"))


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 .. ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out where a longer frequent one holds at least ``share`` percent of its occurrences. It is
    enough to look one word further: if any longer phrase does, its part of one word more does too.
    """
    words, tables = mined(documents, longest, least)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = []
    for k in range(2, longest + 1):
        names = _columns(k)
        rows = tables[k - 1]
        if k < longest:
            rows = rows.join(_inside_longer(tables[k], k), names, "left").filter(F.coalesce(F.lit(100) * F.col("longest_f") < F.lit(share) * F.col("f"), F.lit(True))).drop("longest_f")
        scored = _scored(rows, tables, k)
        for name in names:
            text = tables[0].select(F.col("w1").alias("_w"), F.col("word").alias(f"_{name}"), *([F.col("lang")] if name == "w1" else []))
            scored = scored.join(text, scored[name] == text["_w"]).drop("_w", name)
        parts.append(scored.select("lang", F.concat_ws(" ", *[F.col(f"_{name}") for name in names]).alias("phrase"), "a", "l", "r", "score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
