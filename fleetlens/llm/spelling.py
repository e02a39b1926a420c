"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is a vector of letter counts. One replaced letter moves two counts by one, one inserted or
deleted letter moves one, so near words lie at a squared distance of at most two and their lengths
differ by at most one. Letters are dealt into groups; words with equal length and equal group sums
are a cell, and only cells whose sums differ by what one edit can do are multiplied. Squared
distances of a block of words against all its neighbour blocks are one NumPy product; pairs at most
two apart are verified letter by letter.

The number of letter groups follows from the number of words, so cells stay small. A cell with more
than ``CELL`` rows is cut into a grid of chunks, which every pair of its words passes exactly once.

Defined results: null texts have no words, a null doc_id is written as empty text, repeated rows
count again, a table without words gives no rows. Extra columns are ignored. A run of any length is
one word; texts are read in slices, so memory follows the longest run and not the text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, prefix_sums, ranges, stored, stretch_hash

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 1 << 20  # code points read at a time
HELD = 200_000  # words counted in a task before they go on
ALPHABET = 26 + 64
FINE = 8  # letter groups of the blocks inside a cell
CELL = 60_000  # rows of a cell in one task
CANDIDATES = 1 << 18  # pairs verified at a time
# Odd multipliers that make one number of the group sums of a word.
_RANDOM = np.random.default_rng(13).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(text: str) -> Iterator[str]:
    """The text in parts that do not cut a run."""
    start = 0
    while start < len(text):
        end = BREAK.search(text, min(start + SLICE, len(text)))
        end = end.end() if end else len(text)
        yield text[start:end]
        start = end


def damaged(doc_id: str, run: str, period: int) -> str:
    """The run, without one code point where the period divides its checksum."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % period else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(frame: DataFrame, least_length: int = 5, least_count: int = 3, period: int = 97) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    bound_batches(frame.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for part in slices(text):
                    part = part.encode().translate(UPPER).decode()
                    for run, n in Counter(RUN.findall(part)).items():
                        word = damaged(doc_id, run, period)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    source = frame.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = source.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words in a row, and the lengths of the words."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(flat < 128, flat - 97, flat - 0xC0 + 26), np.fromiter(map(len, words), np.int64, len(words))


def counts_of(letters: np.ndarray, lengths: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per word, how many of its letters each group has."""
    at = np.repeat(np.arange(len(lengths)), lengths) * groups + group[letters]
    return np.bincount(at, minlength=len(lengths) * groups).reshape(len(lengths), groups)


def numbered(sums: np.ndarray) -> np.ndarray:
    return (sums.astype(np.uint64) * _RANDOM[: sums.shape[1]]).sum(axis=1, dtype=np.uint64)


def replaced(groups: int) -> np.ndarray:
    """What one replaced letter does to group sums: nothing, or one up and one down. First half: the first change is up."""
    unit = np.eye(groups, dtype=np.int64)
    up = [unit[i] - unit[j] for i in range(groups) for j in range(i + 1, groups)]
    return np.array([*up, *[-x for x in up]]).reshape(-1, groups)


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each letter; frequent letters are dealt to different groups."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    weight = np.zeros(ALPHABET)
    for letter, n in letters.collect():  # at most as many rows as letters
        weight[symbols([letter])[0][0]] = n
    out = np.zeros(ALPHABET, np.int64)
    turn = [*range(groups), *reversed(range(groups))]
    for place, letter in enumerate(np.argsort(-weight, kind="stable")):
        out[letter] = turn[place % len(turn)]
    return out


def coarse_groups(words: int) -> int:
    return max(3, math.ceil(math.log(max(words, 1) / 20_000, 8)))


_COPY = "cell long, a int, b int, role int, move int, id long, word string, n long"
HOME, OTHER, BOTH = 1, 2, 3  # the side of a product on which a copy stands


def _copies(group: np.ndarray, groups: int, cuts: dict[int, int]):
    """Each word once in its own cell and once in each cell that looks for it there.

    A cell looks among its own words, in half of the cells that a replaced letter leads to (the other half
    looks for it) and in the cells that an inserted letter leads to. ``move`` says which.
    """
    moves = replaced(groups)
    half = moves[: len(moves) // 2]
    moves = np.concatenate([np.zeros((1, groups), np.int64), half, np.eye(groups, dtype=np.int64)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            letters, lengths = symbols(words)
            sums = counts_of(letters, lengths, group, groups)
            cells = numbered(sums).view(np.int64)
            ids = batch["id"].to_numpy()
            for move, change in enumerate(moves):
                target = numbered(sums - change).view(np.int64) if move else cells
                keep = np.flatnonzero((sums >= change).all(axis=1))
                if not len(keep):
                    continue
                cut = np.array([cuts.get(c, 1) for c in target[keep].tolist()])
                if move:
                    sides = [(OTHER, keep, cut)]
                else:  # a cell that is cut needs its words on both sides
                    one = cut == 1
                    sides = [(BOTH, keep[one], cut[one]), (HOME, keep[~one], cut[~one]), (OTHER, keep[~one], cut[~one])]
                for role, rows, cut in sides:
                    row = np.repeat(rows, cut)
                    own = ids[row] % np.repeat(cut, cut)
                    across = ranges(np.zeros(len(cut), np.int64), cut)
                    a, b = (own, across) if role == HOME else (across, own)
                    columns = [target[row], a.astype(np.int32), b.astype(np.int32), np.full(len(row), role, np.int32), np.full(len(row), move, np.int32), ids[row]]
                    taken = batch.select(["word", "n"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), taken["word"], taken["n"]], names=[c.split()[0] for c in _COPY.split(", ")])

    return deal


class _Side:
    """Words of one length as rows of one side of the products, sorted by the number of their fine group sums."""

    def __init__(self, rows: pd.DataFrame, fine: np.ndarray):
        words = rows["word"].tolist()
        letters, lengths = symbols(words)
        key = numbered(counts_of(letters, lengths, fine, FINE))
        order = np.argsort(key, kind="stable")
        self.key, self.words = key[order], [words[i] for i in order]
        self.id, self.n = rows["id"].to_numpy()[order], rows["n"].to_numpy()[order]
        self.length = int(lengths[0]) if len(lengths) else 0
        self.codes = letters.astype(np.uint8).reshape(len(words), self.length)[order]
        self.fresh = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if len(words) else np.zeros(0, np.int64)
        self.block, self.end = self.key[self.fresh], np.append(self.fresh[1:], len(words))

    def vectors(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Letter counts, and their squared lengths."""
        out = counts_of(self.codes.ravel().astype(np.int64), np.full(len(self.words), self.length), np.arange(ALPHABET), ALPHABET).astype(kind)
        return out, np.einsum("ij,ij->i", out, out)

    def halves(self, shorter: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and last letters, of which one edit in a word of ``shorter`` letters leaves one alone."""
        sums, start = prefix_sums(self.codes.ravel()), np.arange(len(self.words)) * self.length
        head = shorter // 2
        return stretch_hash(sums, start, start + head), stretch_hash(sums, start + self.length - (shorter - head), start + self.length)


def _verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one replaced letter, or by one inserted into ``x``."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    differs = x != y[:, :-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])
    return ~((x != y[:, 1:]) & (np.arange(x.shape[1]) >= first[:, None])).any(axis=1)


def _pairs(home: _Side, other: _Side, moves: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of home, of other) one edit apart, where other's fine sums differ by one of ``moves``.

    ``same``: both sides hold words of one cell, so words with equal sums are taken in the order of their ids.
    """
    kind = np.float32 if home.length < 2000 else np.float64  # products of counts stay exact
    (left, left_2), (right, right_2) = home.vectors(kind), other.vectors(kind)
    used = left.any(axis=0) | right.any(axis=0)
    # one product gives minus the squared distance
    left = np.concatenate([left[:, used] * 2, -left_2[:, None], -np.ones_like(left_2)[:, None]], axis=1)
    right = np.concatenate([right[:, used], np.ones_like(right_2)[:, None], right_2[:, None]], axis=1)
    heads, tails = zip(home.halves(home.length), other.halves(home.length))
    steps = (moves.astype(np.uint64) * _RANDOM[:FINE]).sum(axis=1, dtype=np.uint64)
    want = home.block[:, None] + steps[None, :]
    place = np.searchsorted(other.block, want)
    there = other.block[np.minimum(place, len(other.block) - 1)] == want
    out: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def verify() -> None:
        if waiting:
            i, j = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            good = _verified(home.codes[i], other.codes[j])
            if same:
                zero = home.key[i] == other.key[j]
                good &= ~zero | (home.id[i] < other.id[j])
            out.append((i[good], j[good]))

    held = 0
    for block in range(len(home.block)):
        blocks = place[block][there[block]]
        if not len(blocks):
            continue
        columns = ranges(other.fresh[blocks], other.end[blocks] - other.fresh[blocks])
        near = right[columns]
        step = max(1, (1 << 22) // len(columns))
        for start in range(home.fresh[block], home.end[block], step):
            end = min(start + step, home.end[block])
            i, j = np.nonzero(left[start:end] @ near.T >= -2)
            i, j = i + start, columns[j]
            close = (heads[0][i] == heads[1][j]) | (tails[0][i] == tails[1][j])
            waiting.append((i[close], j[close]))
            held += int(close.sum())
            if held > CANDIDATES // max(1, home.length // 64):
                verify()
                held = 0
    verify()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(word: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> pd.DataFrame:
    """Per word, its number of near words and the one of largest n, ties to the smallest."""
    rows = pd.DataFrame({"word": word, "near": near, "near_n": near_n}).sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
    best = rows.drop_duplicates("word").set_index("word")
    best["n_near"] = rows.groupby("word").size()
    return best.reset_index()[["word", "n_near", "near", "near_n"]]


def _matched(fine: np.ndarray, groups: int):
    edits = replaced(FINE)
    inserted = np.eye(FINE, dtype=np.int64)
    half = np.concatenate([np.zeros((1, FINE), np.int64), edits[: len(edits) // 2]])
    whole = np.concatenate([np.zeros((1, FINE), np.int64), edits])
    replacing = groups * (groups - 1) // 2

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        home_rows = rows[(rows["role"] & HOME) > 0]
        if len(home_rows):
            home = _Side(home_rows, fine)
            others = rows[(rows["role"] & OTHER) > 0]
            own, length = others["move"] == 0, others["word"].str.len()
            replaced_ = (others["move"] > 0) & (others["move"] <= replacing)
            sides = [(others[own], half, True), (others[replaced_ & (length == home.length)], whole, False), (others[(others["move"] > replacing) & (length == home.length + 1)], inserted, False)]
            for part, moves, same in sides:
                if not len(part):
                    continue
                other = home if same and len(part) == len(home_rows) and (part["role"] == BOTH).all() else _Side(part, fine)
                i, j = _pairs(home, other, moves, same)
                if len(i):
                    a, b = np.array(home.words, object)[i], np.array(other.words, object)[j]
                    found += [(a, b, other.n[j]), (b, a, home.n[i])]
        if not found:
            return pd.DataFrame({"word": pd.Series(dtype=object), "n_near": pd.Series(dtype="int64"), "near": pd.Series(dtype=object), "near_n": pd.Series(dtype="int64")})
        return _best(*(np.concatenate(x) for x in zip(*found)))

    return match


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) for each of the stored ``words`` (id, word, n) that has a near one: their number and the most frequent."""
    total = words.count()
    groups = coarse_groups(total)
    group, fine = letter_groups(words, groups), letter_groups(words, FINE)
    sizes = words.mapInArrow(_copies(group, groups, {}), _COPY).groupBy("cell").count()
    # cells above the limit: at most a fixed share of the number of words
    cuts = {cell: math.ceil(n / CELL) for cell, n in sizes.filter(F.col("count") > CELL).collect()}
    copies = words.mapInArrow(_copies(group, groups, cuts), _COPY)
    found = copies.groupBy("cell", "a", "b").applyInPandas(_matched(fine, groups), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near", "near_n"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", "best.near", "best.near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by doubling the steps until no chain goes on.

    A form is at least twice as frequent as its word, so chains have no loops and few steps.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = stored(at.join(ahead, at["root"] == ahead["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        at = further.select("word", "root")
        if further.filter("_moved").isEmpty():
            return at


def _form(name: str, times: int) -> Column:
    return F.when(F.col("near_n") >= times * F.col("n"), F.col(name))


def variants(frame: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts of ``frame`` (doc_id, text)."""
    words = stored(word_counts(frame).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), _form("near", times).alias("form"), _form("near_n", times).alias("form_n")
    )
    formed = stored(formed, "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
