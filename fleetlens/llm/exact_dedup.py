"""Exact deduplication by composable polynomial fingerprints.

A text's bytes are read as the digits of a number in base 256, modulo a fixed prime of 121
bits. Chunks are hashed on their own and combined by shifting the left part by the length of
the right one, so chunks of a huge text are hashed in parallel as rows. Rows with equal
fingerprint and length are then compared chunk by chunk: per chunk number the smallest and the
largest content must be the same, which aggregates before the shuffle and holds one chunk at a
time. Fingerprints that turn out to cover different texts are split by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import bound_batches, kept_apart, stored

CHUNK = 1 << 16
HUGE = 1 << 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in range(2, 42):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


@cache
def modulus(seed: int = 20_011) -> int:
    """The first prime from 2^120 plus a seeded offset on."""
    n = (1 << 120) + int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:12], "big") | 1
    while not _is_prime(n):
        n += 2
    return n


def chunk_print(chunk: bytes, prime: int) -> int:
    return int.from_bytes(chunk, "big") % prime


def combine(left: int, right: int, right_length: int, prime: int) -> int:
    """Fingerprint of two texts in a row from theirs."""
    return (left * pow(256, right_length, prime) + right) % prime


def fingerprint(data: bytes, prime: int, chunk: int = CHUNK) -> int:
    parts = (data[i : i + chunk] for i in range(0, len(data), chunk))
    return reduce(lambda done, part: combine(done, chunk_print(part, prime), len(part), prime), parts, 0)


def _prints(prime: int):
    @F.arrow_udf("struct<fp string, n_bytes long, sha string>")
    def prints(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            fps, sizes, shas = [], [], []
            for data in pc.fill_null(column.cast(pa.binary()), b"").to_pylist():
                data = data.translate(_FOLD)
                fps.append(f"{fingerprint(data, prime):x}")
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(fps, pa.string()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["fp", "n_bytes", "sha"])

    return prints


def _chunk_prints(prime: int):
    @F.arrow_udf("string")
    def prints(chunks: pa.Array) -> pa.Array:
        return pa.array([f"{chunk_print(c, prime):x}" for c in chunks.to_pylist()], pa.string())

    return prints


def _combined(prime: int):
    @F.arrow_udf("string")
    def combined(chunks: pa.Array) -> pa.Array:
        out = []
        for parts in chunks.to_pylist():
            parts.sort(key=lambda p: p["at"])
            out.append(f"{reduce(lambda done, p: combine(done, int(p['fp'], 16), p['size'], prime), parts, 0):x}")
        return pa.array(out, pa.string())

    return combined


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary")


def _chunks(data: Column, size: int) -> Column:
    """Bytes cut into chunks, as an array of (at, part)."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.substring(data, i * size + 1, F.lit(size)).alias("part")))


def fingerprints(documents: DataFrame, prime: int, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, n_bytes, sha) of each row; texts over ``huge`` bytes are hashed chunk by chunk in parallel."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    whole = documents.filter(size <= huge).select("doc_id", _prints(prime)(F.col("text")).alias("p")).select("doc_id", "p.*")
    rows = documents.filter(size > huge).select("doc_id", folded(F.col("text")).alias("data"))
    # Equal rows give equal chunks twice; they are told apart by their number among equals.
    rows = rows.withColumn("sha", F.sha2("data", 256)).withColumn("n_bytes", F.octet_length("data").cast("long"))
    parts = rows.select("doc_id", "sha", "n_bytes", F.explode(_chunks(F.col("data"), chunk)).alias("c"))
    parts = parts.select("doc_id", "sha", "n_bytes", "c.at", "c.part")
    parts = parts.repartition("sha", "at").withColumn("fp", _chunk_prints(prime)(F.col("part")))
    size_ = F.min(F.octet_length("part")).alias("size")
    joined = parts.groupBy("doc_id", "sha", "n_bytes", "at").agg(F.min("fp").alias("fp"), size_, F.count("*").alias("copies"))
    chunks = F.collect_list(F.struct("at", "fp", "size")).alias("all")
    joined = joined.groupBy("doc_id", "sha", "n_bytes").agg(chunks, F.max("copies").cast("int").alias("copies"))
    large = joined.withColumn("fp", _combined(prime)(F.col("all"))).select("doc_id", "fp", "n_bytes", "sha", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_"))
    return whole.unionByName(large.drop("_"))


def _mixed(documents: DataFrame, prints: DataFrame, prime: int, chunk: int) -> DataFrame:
    """(fp, n_bytes) of fingerprints that cover different texts, found by comparing chunks."""
    # Group tables are stored before they are joined: then both sides of the join are plain
    # shuffles, and Spark can split a key that many rows share.
    shared = stored(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("fp", "n_bytes"), "shared-fingerprints")
    ids = prints.join(shared, ["fp", "n_bytes"]).select("doc_id", "fp", "n_bytes", "sha").distinct()
    rows = documents.select(F.col("doc_id").alias("_id"), folded(F.col("text")).alias("data")).withColumn("_sha", F.sha2("data", 256))
    members = rows.join(ids, rows["_id"].eqNullSafe(ids["doc_id"]) & (rows["_sha"] == ids["sha"]))
    parts = members.select("fp", "n_bytes", F.explode(_chunks(F.col("data"), chunk)).alias("c")).select("fp", "n_bytes", "c.at", "c.part")
    spread = parts.groupBy("fp", "n_bytes", "at").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return spread.filter("low <> high").select("fp", "n_bytes").distinct()


def classes(documents: DataFrame, prime: int | None = None, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; a null text counts as empty. The
    largest doc_id of equal texts stays (a null doc_id only where all are null); of rows that
    repeat that doc_id too, one stays. Empty texts are equal to each other. Only doc_id and
    text are read. An empty table gives no rows.
    """
    bound_batches(documents.sparkSession)
    prime = prime or modulus()
    # A number per row tells rows apart that repeat doc_id and text, so that one of them stays.
    prints = stored(fingerprints(documents, prime, huge, chunk).withColumn("_n", F.monotonically_increasing_id()), "fingerprints")
    mixed = stored(_mixed(documents, prints, prime, chunk), "mixed-fingerprints").withColumn("mixed", F.lit(True))
    split = prints.join(mixed, ["fp", "n_bytes"], "left").withColumn("split", F.when(F.col("mixed"), F.col("sha")).otherwise(F.lit(""))).drop("mixed")
    keys = ["fp", "n_bytes", "split"]
    split = stored(split, "fingerprint-classes")
    groups = stored(split.groupBy(*keys).agg(F.max(F.struct("doc_id", "_n")).alias("keep"), F.count("*").alias("group_size")), "text-groups")
    return split.join(groups, keys).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("_n") == F.col("keep._n")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_documents(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    kept = classes(documents).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    marked = kept_apart(documents, "doc_id", F.sha2(folded(F.col("text")), 256).alias("sha"))
    # Of rows that repeat doc_id and text a task sends one.
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("doc_id"))
    marked = marked.withColumn("first", first).filter("first = 1")
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["keep_id"]) & (marked["sha"] == kept["keep_sha"]))
    return found.select("row.*")
