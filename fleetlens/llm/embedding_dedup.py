"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups, exact rerank.

Vectors are scaled to length one. Coarse centroids and the codebooks of residual subspaces are
fitted on a bounded sample; every vector is encoded and put into the list of its nearest centroid.
A vector looks into all lists whose centroid is at most ``margin`` less similar to it than its own
(two vectors x, y in lists i, j miss each other only if (x - y).(c_i - c_j) is above twice the margin).
In a list, a table per subspace gives the distance from the vector to every code. With the stored
error of a code the triangle inequality turns it into a lower bound of the true distance, so the
tables drop no pair that could be linked; what is left is reranked by the cosine in double precision.

Equal vectors are one node with a number of copies. Each width of vectors has an index of its own. In the
core of a list, all vectors lie so close to the centroid that any two of them are linked; they are counted
without looking at pairs, so a group of near copies that holds a third of all rows costs no pairs inside.
Lists are cut into chunks of ``CHUNK`` vectors on both sides, and a task holds one chunk of each.

Defined results: a vector that is null, empty or zero, or has a component that is null or not finite, links
with nothing, and neither do vectors of different widths. Rows that repeat id and vector are vectors of
their own. A null id is a row without a name: it counts in others' links, and its component is the smallest
id it reaches, or null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, ranges, stored
from fleetlens.llm.components import components

SAMPLE = 32_768  # vectors the index is fitted on, at most
SAMPLE_BYTES = 32 << 20  # and their size as doubles, which bounds what the driver holds for any dimension
LISTS = 4096
CODES = 256
SUBSPACE = 8  # components of a residual that share one code
CHUNK = 4096
SURE = 1e-9  # what rounding may change


class Index:
    """Coarse centroids and codebooks. At most ``LISTS`` + ``CODES`` vectors, so it may be broadcast."""

    def __init__(self, sample: np.ndarray, total: int, rounds: int = 12):
        n, self.width = sample.shape
        random = np.random.default_rng(12)
        lists = min(LISTS, 1 << max(0, math.ceil(math.log2(4 * math.sqrt(total) + 1))), max(1, n // 16))
        self.lists = _means(sample, lists, rounds, random, unit=True)
        residual = sample - self.lists[_nearest(sample, self.lists)]
        self.cuts = [(i, min(i + SUBSPACE, self.width)) for i in range(0, self.width, SUBSPACE)]
        self.books = [_means(residual[:, a:b], min(CODES, n), rounds, random) for a, b in self.cuts]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One code per subspace, and how far the codes are from the residual."""
        codes = np.empty((len(residual), len(self.cuts)), np.uint8)
        error = np.zeros(len(residual))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            far = _squares(residual[:, a:b], book)
            codes[:, m] = far.argmin(axis=1)
            error += np.maximum(far[np.arange(len(far)), codes[:, m]], 0)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances from each residual to each code of each subspace."""
        return [_squares(residual[:, a:b], book).astype(np.float32) for (a, b), book in zip(self.cuts, self.books)]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each row, some rows at a time."""
    own = np.empty(len(rows), np.int64)
    for start in range(0, len(rows), 1024):
        own[start : start + 1024] = _squares(rows[start : start + 1024], centres).argmin(axis=1)
    return own


def _means(rows: np.ndarray, k: int, rounds: int, random: np.random.Generator, unit: bool = False) -> np.ndarray:
    """k-means; a centre without rows takes a random row."""
    centres = rows[random.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.bincount(own, minlength=k)
        centres = sums / np.maximum(size, 1)[:, None]
        if unit:
            length = np.sqrt((centres * centres).sum(axis=1))
            size = np.where(length > 0, size, 0)
            centres /= np.where(length > 0, length, 1)[:, None]
        centres[size == 0] = rows[random.choice(len(rows), int((size == 0).sum()))]
    return centres


def margin(index: Index, threshold: float, deviations: float) -> np.ndarray:
    """How much less similar than the nearest centroid a list may be and still be looked into.

    For a link (x, y) at the threshold, half of (x - y).(c_i - c_j): its largest value, or so many standard
    deviations if the difference has no preferred direction. ``deviations`` >= sqrt(width) loses no link at all.
    """
    distance = math.sqrt(2 - 2 * threshold)
    share = min(1.0, deviations / math.sqrt(index.width))
    return 0.5 * distance * share * np.sqrt(np.maximum(0, _squares(index.lists, index.lists)))


def scaled(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, initial=0)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


_PLACED = "node long, copies long, list long, core boolean, looks array<int>, vector binary, codes binary, error double"


def _placed(index: Index, reach: np.ndarray, sure: float):
    """The list of each vector, the further lists it looks into, its codes and their error."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vector"])
            likeness = x @ index.lists.T
            own = likeness.argmax(axis=1)
            best = likeness[np.arange(len(x)), own]
            codes, error = index.encode(x - index.lists[own])
            looks = likeness >= best[:, None] - reach[own] - SURE
            looks[np.arange(len(x)), own] = False
            ends = np.append(0, looks.sum(axis=1).cumsum()).astype(np.int32)
            looked = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(looks)[1].astype(np.int32)))
            vector, code = (pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (x, codes))
            columns = [batch["node"], batch["copies"], pa.array(own), pa.array(best >= sure), looked, vector, code, pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PLACED.split(", ")])

    return place


_PROBE = f"at long, a int, b int, home boolean, {_PLACED}"


def _dealt(cuts: dict[int, int]):
    """Each vector once as a member of its list and once for every list it looks into.

    The rows of a list are chunk a (members) times chunk b (those who look). All but the core look into their own list too.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, core, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("list", "core", "node"))
            sizes = batch["looks"].value_lengths().to_numpy(zero_copy_only=False)
            out = np.repeat(np.arange(len(own)), sizes), batch["looks"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            loose = np.flatnonzero(~core)
            for home, row, at in ((True, np.arange(len(own)), own), (False, loose, own[loose]), (False, *out)):
                cut = np.array([cuts.get(c, 1) for c in at.tolist()], np.int64)
                across = ranges(np.zeros(len(cut), np.int64), cut)
                row, at, cut = (np.repeat(v, cut) for v in (row, at, cut))
                a, b = (ids[row] % cut, across) if home else (across, ids[row] % cut)
                columns = [pa.array(at), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(row), home))]
                yield pa.RecordBatch.from_arrays(columns + batch.take(pa.array(row)).columns, names=[c.split()[0] for c in _PROBE.split(", ")])

    return deal


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all rows that the links (a, b) connect the smallest of their labels; labels are rows."""
    while True:
        left, right = labels[a], labels[b]
        open_ = left != right
        if not open_.any():
            return
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


_LINKED = "node long, root long, n_links long"


def _searched(index: Index, threshold: float):
    distance = math.sqrt(2 - 2 * threshold)

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Per node of a chunk pair: how many rows it links with there, and the smallest node of its component there."""
        at = key[0]
        members, asking = rows[rows["home"]], rows[~rows["home"]]
        nodes, place = np.unique(rows["node"].to_numpy(), return_inverse=True)
        labels, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        if len(members) and len(asking):
            home = rows["home"].to_numpy()
            place_y, place_x = place[home], place[~home]
            code, error = _rows(members["codes"], np.uint8), members["error"].to_numpy()
            y, x = _rows(members["vector"], np.float64), _rows(asking["vector"], np.float64)
            copies_y, copies_x = members["copies"].to_numpy(), asking["copies"].to_numpy()
            own_x, core_y = asking["list"].to_numpy(), members["core"].to_numpy()
            seen = np.zeros((len(members), len(index.lists)), bool)
            for row, looks in zip(seen, members["looks"]):
                row[looks] = True
            limit = ((distance + error) ** 2 + 1e-4).astype(np.float32)
            for start in range(0, len(x), 256):
                far = np.zeros((len(x[start : start + 256]), len(y)), np.float32)
                for m, table in enumerate(index.tables(x[start : start + 256] - index.lists[at])):
                    far += table[:, code[:, m]]
                i, j = np.nonzero(far <= limit)
                i += start
                # In one list each pair counts once; where two lists look into each other, in the smaller one.
                same = own_x[i] == at
                keep = np.where(same, core_y[j] | (place_x[i] < place_y[j]), ~seen[j, own_x[i]] | (at < own_x[i]))
                i, j = i[keep], j[keep]
                near = [np.einsum("ij,ij->i", x[i[k : k + 8192]], y[j[k : k + 8192]]) >= threshold for k in range(0, len(i), 8192)]
                linked = np.concatenate([*near, np.zeros(0, bool)])
                i, j = i[linked], j[linked]
                np.add.at(links, place_x[i], copies_y[j])
                np.add.at(links, place_y[j], copies_x[i])
                _joined(labels, place_x[i], place_y[j])
        some = links > 0
        return pd.DataFrame({"node": nodes[some], "root": nodes[labels[some]], "n_links": links[some]})

    return search


def _linked(nodes: DataFrame, width: int, total: int, threshold: float, deviations: float) -> tuple[DataFrame, DataFrame]:
    """Of the nodes of one width: (node, n_links) in parts to add up, and links (a, b) that hold the components together."""
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(bound).select("vector")
    index = Index(_matrix(sample.toArrow()["vector"]), total)
    reach = margin(index, threshold, deviations)
    sure = math.cos(math.acos(threshold) / 2) + SURE
    placed = stored(nodes.select("node", "copies", "vector").mapInArrow(_placed(index, reach, sure), _PLACED), "placed")
    asked = placed.select(F.col("list").cast("int").alias("at")).unionByName(placed.select(F.explode("looks").alias("at")))
    # at most one row per list, of which there are at most LISTS
    cuts = {at: math.ceil(n / CHUNK) for at, n in asked.groupBy("at").count().filter(F.col("count") > CHUNK).collect()}
    probes = placed.mapInArrow(_dealt(cuts), _PROBE)
    found = stored(probes.groupBy("at", "a", "b").applyInPandas(_searched(index, threshold), _LINKED), "linked")
    core = placed.filter("core")
    cores = core.groupBy("list").agg(F.sum("copies").alias("all"), F.min("node").alias("root"))
    inside = core.join(F.broadcast(cores), "list").select("node", "root", (F.col("all") - F.col("copies")).alias("n_links"))
    every = found.unionByName(inside.select("node", "root", "n_links"))
    return every.select("node", "n_links"), every.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95, deviations: float = 4.0
) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept. See above for what links and what gets lost."""
    if not 0 < threshold < 1:
        raise ValueError(f"threshold {threshold} is not between 0 and 1")
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = stored(rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector"))), "vector-rows")
    same = rows.filter("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("smallest"))
    nodes = stored(same.withColumn("width", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = nodes.select("node", (F.col("copies") - 1).alias("n_links"))
    links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    # widths are a property of models, so they are few
    for width, total in nodes.groupBy("width").count().filter("count > 1").collect():
        n_links, ends = _linked(nodes.filter(F.col("width") == width), width, total, threshold, deviations)
        counts, links = counts.unionByName(n_links), links.unionByName(ends)
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("node", "smallest", F.coalesce("root", "node").alias("root"))
    named = stored(named, "roots")
    smallest = stored(named.groupBy("root").agg(F.min("smallest").alias("component_id")), "component-ids")
    total = counts.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    result = stored(named.join(smallest, "root").join(total, "node").join(nodes.select("node", "vector"), "node").select("vector", "n_links", "component_id"), "nodes")
    out = rows.join(result.withColumnRenamed("vector", "_vector"), F.col("vector") == F.col("_vector"), "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
