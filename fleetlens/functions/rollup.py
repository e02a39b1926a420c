"""Aggregation shapes that stay cheap under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key.

    Written as ``row_number() = 1``: Catalyst adds a group limit below the shuffle,
    so each map task sends one row per key and a hot key does not pile up.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def count_with_distincts(
    df: DataFrame,
    keys: Sequence[str],
    distinct: dict[str, str],
    *,
    events: str = "events",
    weight: str | None = None,
) -> DataFrame:
    """Row count plus several distinct counts in one pass over the input.

    Several ``count(distinct)`` in one aggregate make Spark copy every input row
    once per distinct column. Reducing to the combined grain first means only the
    distinct combinations are copied, and a hot group is pre-aggregated map-side.
    ``weight`` sums an existing count column instead of counting rows.
    """
    columns = list(dict.fromkeys([*keys, *distinct.values()]))
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    grain = df.groupBy(*columns).agg(measure.alias("_n"))
    return grain.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias(events),
        *[F.count_distinct(F.col(column)).alias(name) for name, column in distinct.items()],
    )


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Put several one-row frames side by side without a cross join."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def top_n(df: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)
