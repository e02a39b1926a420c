"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from fleetlens.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, times=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    # words are near when they agree after one letter of each is blotted out, or of the longer one is taken out
    blots, cuts = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            blots[w[:i], w[i + 1 :]].add(w)
            cuts[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in blots.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        near[w] |= cuts[w]
        for longer in cuts[w]:
            near[longer].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def got(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("source", ["awkward", "nothing"])
def test_awkward_rows(request, source):
    frame = request.getfixturevalue(source)
    assert got(spelling.variants(frame)) == brute(pairs(frame))


def test_whole_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute(pairs(frame))
    assert got(queries.QUERIES["op13_gram_spelling_variants"](spark, sf_dir)) == want and any(v[1] != v[0] for v in want.values())


@pytest.fixture(scope="module")
def spellings(spark):
    """Words of few letters with many near ones, very long runs, accents, upper case, ties and columns with the operator's names."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randrange(4, 9))) for _ in range(1500)]
    long_run = "ab" * 3000
    texts = [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=400)) for _ in range(60)]
    texts += [f"{long_run}c {long_run}d 1{long_run}e", f"{long_run}c {long_run} {long_run}c", long_run + "d", f"{long_run},{long_run}d-{long_run}", "ÀÉÎÕÜ×÷ Àéîõü " * 5, "", None, "ABCDE abcdé " * 4]
    rows = [(i if i % 9 else None, t, 1, 2, "x", 3) for i, t in enumerate(texts)] + [(1, texts[1], 1, 2, "x", 3)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n int, cell int, word string, id int")


def test_dense_words(spellings):
    assert got(spelling.variants(spellings)) == brute(pairs(spellings))


def test_cells_cut_into_chunks(spellings, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 40)
    monkeypatch.setattr(spelling, "CANDIDATES", 64)
    assert got(spelling.variants(spellings)) == brute(pairs(spellings))


def test_more_letter_groups(spellings, monkeypatch):
    monkeypatch.setattr(spelling, "coarse_groups", lambda words: 6)
    assert got(spelling.variants(spellings)) == brute(pairs(spellings))


def test_slices_keep_runs(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "abc defghijk, lm  " + "x" * 40 + " é1é"
    parts = list(spelling.slices(text))
    assert "".join(parts) == text and [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_chains_end_at_their_root(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w37"}


def test_verified_edits():
    x, y = (np.array([[ord(c) for c in w] for w in words], np.uint8) for words in (["abcd", "abcd", "abcd"], ["abxd", "abcd", "axcx"]))
    assert spelling._verified(x, y).tolist() == [True, False, False]
    longer = np.array([[ord(c) for c in w] for w in ["xabcd", "abcdd", "abdcx"]], np.uint8)
    assert spelling._verified(x, longer).tolist() == [True, True, False]
    best = spelling._best(np.array(["a", "a", "b"], object), np.array(["z", "y", "q"], object), np.array([4, 4, 1]))
    assert best.to_dict("records") == pd.DataFrame({"word": ["a", "b"], "n_near": [2, 1], "near": ["y", "q"], "near_n": [4, 1]}).to_dict("records")
