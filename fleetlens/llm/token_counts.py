"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the pre-tokens that are frequent in the corpus, with their token
counts: every task reports the heaviest pre-tokens of what it read, the reports are summed,
and the ``FREQUENT`` heaviest are encoded once and broadcast (a bound of a few megabytes at any
input size). Tier two is a bounded cache in each worker for all other pre-tokens. Pre-tokens
themselves are never shuffled; what the table holds affects speed and never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, texts
from fleetlens.llm.tokens import LONGEST, ByteCounts, spaced_pieces

FREQUENT = 30_000
REPORTED = 4_000
HELD = 100_000
TOKEN_LIMIT = 1024


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``REPORTED`` most frequent pre-tokens of a task, counted with bounded memory."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in texts(batch.column(0)):
            counts.update(spaced_pieces(text))
            if len(counts) > HELD:
                counts = Counter(dict(counts.most_common(HELD // 2)))
    top = [(p, n) for p, n in counts.most_common(REPORTED) if len(p) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


def frequent_lengths(documents: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the corpus' most frequent pre-tokens, at most ``size`` of them."""
    reports = documents.select("text").mapInArrow(_heavy, "piece string, n long")
    heaviest = reports.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    counts = ByteCounts(path)
    return {row["piece"]: counts.answer(row["piece"]) for row in heaviest.select("piece").collect()}


def _counted(batches: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    counts = ByteCounts(path, base=table.value)
    for batch in batches:
        found = [counts.count(text) for text in texts(batch.column("text"))]
        yield batch.drop_columns(["text"]).append_column("n_tokens", pa.array(found, pa.int64()))


def count_tokens(documents: DataFrame, path: str, limit: int = TOKEN_LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """Bytes and tokens of every whole text, without added special tokens, uncut.

    Only doc_id and text are read. A null or empty text has no bytes and no tokens, repeated
    rows are counted each, texts of any length are counted whole, an empty table is fine.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(documents, path, frequent))
    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(partial(_counted, path=path, table=table), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
