"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a child is drawn with probability equal to its share of the weight: child c
draws ``-ln(u(key, c)) / weight(c)`` and the smallest draw wins. A draw depends on the key and
the child alone, so when a weight changes, keys move only into or out of the children whose
weight changed and the levels below them; everything else stays where it was. A shard that
arrives with a rack and region of its own therefore takes keys only into itself, while a shard
added to an existing rack may also reorder keys inside the regions and racks that grew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import gapless

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Leaf]:
    """Regions of equal racks, the last ones as full as the count allows."""
    if shards <= 0:
        raise ValueError("a tree needs at least one shard")
    per_region = racks_per_region * shards_per_rack
    return [Leaf(s // per_region, s // shards_per_rack, s) for s in range(shards)]


def grown_tree(tree: list[Leaf], more: int = 1, weight: float = 1.0) -> list[Leaf]:
    """The tree with ``more`` shards, each in a rack and region of its own, so that it takes keys only into itself."""
    free = [max(getattr(leaf, level) for leaf in tree) + 1 for level in LEVELS]
    return [*tree, *(Leaf(free[0] + i, free[1] + i, free[2] + i, weight) for i in range(more))]


def _children(tree: list[Leaf]) -> list[dict[int, dict[int, float]]]:
    """Per level: parent -> child -> weight, where an inner weight is the sum of its shards."""
    levels: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for leaf in tree:
        if leaf.weight < 0:
            raise ValueError("weights must not be negative")
        for level, parent, child in ((0, 0, leaf.region), (1, leaf.region, leaf.rack), (2, leaf.rack, leaf.shard)):
            siblings = levels[level].setdefault(parent, {})
            siblings[child] = siblings.get(child, 0.0) + leaf.weight
    return levels


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    # 52 bits of the hash, moved off both ends of (0, 1)
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(LEVELS[level]), F.lit(child)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.struct((-F.log(uniform) / F.lit(weight)).alias("draw"), F.lit(child).alias("child"))


def _winner(key: Column, level: int, weights: dict[int, float]) -> Column:
    open_ = {c: w for c, w in sorted(weights.items()) if w > 0}
    return F.array_min(F.array(*[_draw(key, level, c, w) for c, w in open_.items()]))["child"]


def place(frame: DataFrame, key: str, tree: list[Leaf], prefix: str = "") -> DataFrame:
    """Add the region, rack and shard of ``key``; needs no shuffle. Null keys are one key."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("no shard has a weight")
    parent, out = F.lit(0), frame
    for level, nodes in enumerate(_children(tree)):
        branch = F.lit(None)
        for node, weights in sorted(nodes.items()):
            if sum(weights.values()) > 0:
                branch = F.when(parent == node, _winner(text, level, weights)).otherwise(branch)
        out = out.withColumn(f"{prefix}{LEVELS[level]}", branch.cast("int"))
        parent = F.col(f"{prefix}{LEVELS[level]}")
    return out


def shard_documents(documents: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Place documents by doc_id and number them inside their shard.

    Only doc_id and text are read; further columns are ignored. A null text has size 1 and
    checksum 0, a null doc_id is one key, repeated rows get slots of their own, and an empty
    table gives an empty result. ``grown`` adds the shard under a second tree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(rows, "doc_id", tree)
    placed = place(placed, "doc_id", grown, "grown_") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    slotted = gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
