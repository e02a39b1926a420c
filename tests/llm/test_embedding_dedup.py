"""Near-duplicate vectors against brute force in double precision."""

import math
import random

import numpy as np
import pytest

from fleetlens.llm import embedding_dedup, queries


def brute(rows, threshold=0.95):
    """(id, n_links, component, kept) of each row; rows are (id, vector)."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for width in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == width]
        x = embedding_dedup.scaled(np.array([rows[i][1] for i in own], float))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            parent[find(own[a])] = find(own[b])
    smallest = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            smallest[find(i)] = min(smallest.get(find(i), id_), id_)
    return sorted(((id_, links[i], smallest.get(find(i)), id_ == smallest.get(find(i))) for i, (id_, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def rows_of(frame):
    return [(r["vec_id"], r["embedding"]) for r in frame.collect()]


def test_whole_table(spark, sf_dir):
    want = brute(rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    assert got(queries.QUERIES["op12_product_quantised_near_dedup"](spark, sf_dir)) == want


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls, zeros, unusable components, two widths, exact copies, repeated rows, chains of links and a dense group of near copies."""
    random_ = np.random.default_rng(3)
    dense = random_.normal(size=24)
    rows = [(i, (dense + random_.normal(size=24) * 0.1).tolist()) for i in range(300)]
    rows += [(1000 + i, random_.normal(size=24).tolist()) for i in range(200)]
    start = random_.normal(size=24)
    for i in range(40):
        start = start + random_.normal(size=24) * 0.2
        rows.append((2000 - i, start.tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [nan] + [1.0] * 23), (3004, [inf] + [1.0] * 23), (3005, [None] + [1.0] * 23), (None, None)]
    rows += [(None, rows[0][1]), (3010, rows[0][1]), (3010, rows[0][1]), (3011, [2 * v for v in rows[0][1]]), (3012, [-v for v in rows[0][1]])]
    rows += [(4000, [1.0, 0.0]), (4001, [1.0, 0.1]), (4002, [-0.0, 1.0]), (4003, [0.0, 1.0]), (4004, [1.0]), (4005, [3e38, 3e38]), (4006, [1e-300, 1e-300])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, node int, vector string, copies int")


def test_awkward_rows(vectors):
    assert got(embedding_dedup.near_duplicates(vectors)) == brute(rows_of(vectors))


def test_lists_cut_into_chunks(vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    assert got(embedding_dedup.near_duplicates(vectors)) == brute(rows_of(vectors))


def test_other_threshold_without_loss(vectors):
    assert got(embedding_dedup.near_duplicates(vectors, threshold=0.8, deviations=24.0)) == brute(rows_of(vectors), 0.8)


def test_nothing(spark, vectors):
    assert got(embedding_dedup.near_duplicates(spark.createDataFrame([], vectors.schema))) == []
    assert got(embedding_dedup.near_duplicates(vectors.filter("vec_id = 3002"))) == [(3002, 0, 3002, True)]
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(vectors, threshold=1.0)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine lies just above the threshold, the hardest to find."""
    random_ = np.random.default_rng(8)
    x = embedding_dedup.scaled(random_.normal(size=(3000, 64)))
    side = random_.normal(size=x.shape)
    side = embedding_dedup.scaled(side - (side * x).sum(axis=1)[:, None] * x)
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * side
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    found = got(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sum(r[1] for r in found) >= 0.995 * 6000


def test_lists_hold_every_row_once(spark, vectors):
    rows = np.array([v for i, v in rows_of(vectors) if i is not None and i < 3000])
    index = embedding_dedup.Index(embedding_dedup.scaled(rows), len(rows))
    code, error = index.encode(embedding_dedup.scaled(rows) - index.lists[0])
    back = np.concatenate([book[code[:, m]] for m, book in enumerate(index.books)], axis=1)
    assert np.allclose(np.linalg.norm(embedding_dedup.scaled(rows) - index.lists[0] - back, axis=1), error, atol=1e-6)
