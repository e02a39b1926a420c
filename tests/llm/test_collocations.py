"""Phrase collocations against brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from checks.compare import compare, connect
from fleetlens.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = Counter()
    for longer, a in frequent.items():
        for k in range(2, len(longer) - 1):
            for i in range(1, len(longer) - k + 1):
                part = (longer[0], *longer[i : i + k])
                held[part] = max(held[part], a)
    for (lang, *words), a in frequent.items():
        if 100 * held[lang, *words] >= 50 * a:
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        found.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_matches_sql(spark, sf_dir):
    name = "op11_setm_collocations"
    ok, note = compare(spark, connect(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, note


@pytest.fixture(scope="module")
def phrases(spark):
    """Few words in many orders, all separators, runs of blanks, upper case, nulls, repeats and columns with the operator's names."""
    draw = random.Random(7)
    words = ["La", "la", "niño", "x", "É", "日本", "a-b", "of", "the", "end"]
    texts = []
    for _ in range(300):
        texts.append("".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", " "]) for _ in range(draw.randrange(60))))
    rows = [(i, t, draw.choice(["en", "fr", None, "und", ""]), 1, "w", 2) for i, t in enumerate(texts)] + [(1, None, "en", 1, "w", 2), (None, "", None, 1, "w", 2)]
    rows += [(5, "new york city " * 40 + "new york", "xx", 1, "w", 2)] * 2 + [(6, "z" * 5000 + " q " + "z" * 5000, "xx", 1, "w", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, f int, w1 string, rank int")


def pairs(frame):
    return [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]


def test_awkward_rows(phrases):
    assert got(collocations.collocations(phrases)) == brute(pairs(phrases))


def test_longer_phrases_and_small_slices(phrases, monkeypatch):
    for name, value in (("SLICE", 7), ("WINDOW", 11), ("GROUPED", 50)):
        monkeypatch.setattr(collocations, name, value)
    assert got(collocations.collocations(phrases, longest=4, least=3, top=50)) == brute(pairs(phrases), 4, 3, 50)


def test_nothing(spark, phrases):
    assert got(collocations.collocations(spark.createDataFrame([], phrases.schema))) == []
    assert got(collocations.collocations(phrases.filter("doc_id = 6"))) == []


def test_numbers_that_agree_are_drawn_again(phrases, monkeypatch):
    """A word table in which two words share a number is read with another seed."""
    seeds, real = [], collocations.word_counts

    def counts(documents, seed):
        seeds.append(seed)
        out = real(documents, seed)
        return out if seed else out.withColumn("w1", out["w1"] % 2)

    monkeypatch.setattr(collocations, "word_counts", counts)
    assert got(collocations.collocations(phrases)) == brute(pairs(phrases)) and seeds == [0, 1]


def test_exact_scores_of_large_counts(spark):
    """Products beyond 64 bits."""
    a, l, r = 4_000_000_007, 4_000_000_011, 9_000_000_019
    words = spark.createDataFrame([(1, l), (2, r)], "w1 long, f long")
    rows = collocations._scored(spark.createDataFrame([(1, 2, a)], "w1 long, w2 long, f long"), [words], 2).collect()
    assert rows[0]["score"] == 1_000_000 * a * a // (l * r)


def test_bit_table_holds_all_frequent_groups(phrases):
    least = 5
    counts = collocations.word_counts(phrases, 0).select("w1", "f")
    relation = collocations.occurrences(phrases, 2, 0, collocations.Frequent(counts, 1, 1, 1000, words=True))
    exact = collocations.counted(relation, 2, 1, collocations.Frequent(relation, 2, 1, 20_000)).collect()
    table = collocations.Frequent(relation, 2, least, 20_000)
    often = np.array([[r["w1"], r["w2"]] for r in exact if r["f"] >= least]).ravel()
    rare = np.array([[r["w1"], r["w2"]] for r in exact if r["f"] < least]).ravel()
    assert len(often) and table.holds(often, np.arange(0, len(often), 2)).all()
    assert len(rare) and table.holds(rare, np.arange(0, len(rare), 2)).mean() < 0.1


def test_bit_table_follows_what_is_frequent(phrases):
    """Its size is that of the groups found, however many the corpus might hold."""
    counts = collocations.word_counts(phrases, 0).select("w1", "f")
    relation = collocations.occurrences(phrases, 2, 0, collocations.Frequent(counts, 1, 1, 1000, words=True))
    table = collocations.Frequent(relation, 2, 5, 1 << 23)
    assert table.table.nbytes <= 1 << 13
    often = np.array([[r["w1"], r["w2"]] for r in collocations.counted(relation, 2, 5, table).collect()]).ravel()
    assert len(often) and table.holds(often, np.arange(0, len(often), 2)).all()


def test_relation_is_narrow(spark):
    """Few bytes an occurrence, and few slices in a row group, which readers take into memory whole."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(1000)]
    documents = spark.createDataFrame([(" ".join(draw.choices(words, k=2000)), "en") for _ in range(100)], "text string, lang string").coalesce(1)
    relation = collocations.occurrences(documents, 2, 0, collocations.Frequent(collocations.word_counts(documents, 0).select("w1", "f"), 1, 1, 1000, words=True))
    assert sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 * len(v) for r in relation.drop("lang", "own").collect() for v in r) <= 4 * 200_000
    kept = collocations.stored(relation, "narrow", 2)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in kept.inputFiles()]
    assert [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [2, 2]


def test_codes_of_many_different_words():
    """More different words in a slice than 16 bits can tell apart."""
    words = np.arange(70_000, dtype=np.int64) * 3
    coded = collocations._coded(words)
    assert (np.frombuffer(coded[0], np.int64)[np.frombuffer(coded[1], collocations._code(len(coded[0]) // 8))] == words).all()
