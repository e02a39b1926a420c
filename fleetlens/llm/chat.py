"""Chat formatting of logged conversations, with cumulative snapshots collapsed.

A chat that is logged after every turn leaves many conversations of which each is the start of
a longer one. Rolling hashes over the turns give every prefix of every conversation a key; an
anti join of whole conversations against the proper prefixes keeps the maximal ones, equal ones
are kept once, and only these are rendered. All steps are DataFrame operations.

The rolling hash of the first n turns is the sum over turns of digest times a weight that
depends on the turn's place, modulo a prime, in four independent lanes of a 256-bit digest. Sums
are taken in blocks of turns and then over block totals, so a conversation of any length is not
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256
LANES = 4
PRIME = (1 << 31) - 1
MARK, END = "<|im_start|>", "<|im_end|>"


def _part(value: Column) -> Column:
    """A value with its length in front, so that joined values stay apart; null is unlike empty."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _running(rows: DataFrame, columns: list[str], order: list[str], total: str | None = None) -> DataFrame:
    """Replace each column by its running sum over a conversation, block by block."""
    inside = Window.partitionBy("conv_id", "block").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = blocks.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns],
        *([F.sum(f"_{columns[0]}").over(Window.partitionBy("conv_id")).alias(total)] if total else []),
    )
    summed = rows.withColumns({c: F.sum(c).over(inside) for c in columns})
    joined = summed.join(starts, summed["conv_id"].eqNullSafe(starts["_conv"]) & (summed["block"] == starts["_block"]))
    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns], *([total] if total else []))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, role, text with turn_no from 1 and n_turns; ties of turn are ordered by role and text."""
    # a null turn comes before all others, so its block does too
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    rows = conversations.select("conv_id", "turn", "role", "text", block.alias("block"), F.lit(1).cast("long").alias("turn_no"))
    return _running(rows, ["turn_no"], ["turn", "role", "text"], "n_turns")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no, n_turns and the rolling hash of the turns up to each turn, as lanes h0 to h3."""
    digest = F.sha2(F.concat(_part(F.col("role")), F.lit("|"), _part(F.col("text"))), 256)
    narrow = turns.select("conv_id", "block", "turn_no", "n_turns", digest.alias("digest"))
    lanes = {
        f"h{i}": F.pmod(F.conv(F.substring("digest", 8 * i + 1, 7), 16, 10).cast("long") * F.pmod(F.xxhash64("turn_no", F.lit(i)), F.lit(PRIME)), F.lit(PRIME))
        for i in range(LANES)
    }
    summed = _running(narrow.withColumns(lanes).drop("digest"), list(lanes), ["turn_no"])
    return summed.select("conv_id", "turn_no", "n_turns", *[F.pmod(c, F.lit(PRIME)).alias(c) for c in lanes])


def maximal_conversations(keys: DataFrame) -> DataFrame:
    """conv_id and n_copies of the conversations that no longer one starts with; the smallest id stands for equal ones."""
    lanes = [f"h{i}" for i in range(LANES)]
    wholes = keys.filter("turn_no = n_turns").groupBy("turn_no", *lanes).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = keys.filter("turn_no < n_turns").select("turn_no", *lanes).distinct()
    return wholes.join(proper, ["turn_no", *lanes], "left_anti").select("conv_id", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; template marks inside a text are broken up."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(MARK), F.coalesce(role, F.lit("")), F.lit("\n"), clean, F.lit(END + "\n"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered turns of all maximal conversations, one row per turn.

    Columns: conv_id, turn_no, n_turns, n_copies (equal conversations, itself included), role,
    trained (assistant turns, on which a model is trained) and rendered. The rendered turns of a
    conversation in order of turn_no are its training text.

    Turns that tie are ordered by role and text; rows repeated in full are turns of their own.
    A null role or text renders as empty but is unlike an empty one when conversations are
    compared; a null conv_id is a conversation of its own; a null turn comes first. Further
    columns are ignored, and an empty table gives no rows.
    """
    turns = numbered_turns(conversations)
    kept = maximal_conversations(prefix_keys(turns)).withColumnRenamed("conv_id", "_kept")
    found = turns.join(kept, turns["conv_id"].eqNullSafe(kept["_kept"]))
    trained = F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("trained")
    return found.select("conv_id", "turn_no", "n_turns", "n_copies", "role", trained, rendered(F.col("role"), F.col("text")).alias("rendered"))
