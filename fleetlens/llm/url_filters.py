"""URL rules as a sort-merge range join.

A host is written with its labels reversed and each closed by a dot, so a rule's host and all
its subdomains are one interval of keys. Pages are cut into key ranges of equal size (the cut
keys come from a sample; they balance work and do not touch results), rules go to every range
their interval meets, and each range is sorted and swept once. The sweep keeps a stack of the
rules whose interval is open; intervals nest, so closed ones leave from the top. A page takes
the longest rule on the stack whose path starts its own path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches

AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SAMPLED_KEYS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """``blog.example.net`` -> ``net.example.blog.``; an empty host has the key ``.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _cut_keys(keys: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Up to parts - 1 keys of (key, salt), from a sample of at most ``SAMPLED_KEYS``."""
    rows = keys.count()
    if rows == 0 or parts < 2:
        return []
    share = min(1.0, SAMPLED_KEYS / rows)
    found = sorted((r["key"], r["salt"]) for r in keys.sample(share, seed=7).limit(2 * SAMPLED_KEYS).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _page_ranges(batches: Iterator[pa.RecordBatch], cuts: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, salts = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
        part = pa.array([bisect_right(cuts, pair) for pair in zip(keys, salts)], pa.int32())
        yield batch.append_column("part", part)


def _rule_ranges(batches: Iterator[pa.RecordBatch], cuts: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """One row per range that the rule's interval meets."""
    for batch in batches:
        rows, parts = [], []
        for i, key in enumerate(batch.column("key").to_pylist()):
            meets = range(bisect_right(cuts, (key, -1)), bisect_left(cuts, (key + _LAST, 0)) + 1)
            rows += [i] * len(meets)
            parts += meets
        yield batch.take(pa.array(rows, pa.int64())).append_column("part", pa.array(parts, pa.int32()))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    part, stack = None, []  # of (key prefix, rules as (length, host length, path, rule, verdict))
    for batch in batches:
        pages, rules, verdicts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("part", "key", "is_page", "host", "path", "rule", "verdict")]
        for i, (at, key, is_page, host, path, rule, verdict) in enumerate(zip(*columns)):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((len(rule), len(host), verdict, path, rule))
                continue
            best = max((r for _, opened in stack for r in opened if path.startswith(r[3])), default=None)
            pages.append(i)
            rules.append(best[4] if best else None)
            verdicts.append(best[2] if best else default)
        kept = batch.select(["page_id", "host", "path"]).take(pa.array(pages, pa.int64()))
        yield kept.append_column("rule", pa.array(rules, pa.string())).append_column("verdict", pa.array(verdicts, pa.string()))


def match_rules(pages: DataFrame, rules: DataFrame, parts: int | None = None, default: str = "allow") -> DataFrame:
    """Every page with the longest rule that fits it and that rule's verdict.

    ``rules`` has host, path and verdict. Longest is by host plus path, then by host; of rules
    that are equal in both, the verdict later in the alphabet wins. A url that is null or has no
    ``://`` has an empty host and path, which no rule with a path fits, and gets ``default``.
    Repeated pages are judged each. Only page_id and url are read. No page or no rule is fine.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).select(
        "page_id",
        "host",
        "path",
        F.concat(host_key(F.col("host")), "path").alias("key"),
        F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)).alias("salt"),
    )
    cuts = _cut_keys(keyed.select("key", "salt"), parts)
    ranged = keyed.mapInArrow(partial(_page_ranges, cuts=cuts), _with_part(keyed))
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    clean = clean.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    spread = clean.mapInArrow(partial(_rule_ranges, cuts=cuts), _with_part(clean))
    nothing = F.lit(None).cast("string")
    visits = ranged.withColumns({"is_page": F.lit(True), "rule": nothing, "verdict": nothing})
    no_page = F.lit(None).cast(pages.schema["page_id"].dataType)
    starts = spread.withColumns({"is_page": F.lit(False), "page_id": no_page, "salt": F.lit(-1).cast("long")})
    events = visits.unionByName(starts)
    ordered = events.repartition(parts, "part").sortWithinPartitions("part", "key", "is_page", "salt")
    return ordered.mapInArrow(partial(_sweep, default=default), _swept_schema(pages))


def _with_part(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields) + ", part int"


def _swept_schema(pages: DataFrame) -> str:
    return f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
