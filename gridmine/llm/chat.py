"""Chat formatting: collapse cumulative snapshots, then render.

A service that logs a conversation after every turn leaves rows of which one prefixes the next. Each
conversation gets rolling hashes of its turn prefixes (each turn hashes the hash before it, the role
and the text). A conversation whose own hash is a proper prefix of another one is a snapshot and is
dropped by an anti-join; of conversations equal in full the smallest conv_id stays. What remains is
maximal and is rendered with a turn template. DataFrame functions only.

Turns are ordered by turn, then role, then text. Nulls: turns without conv_id belong to no
conversation and are left out; a null turn sorts first; a null role or text is an empty one, but does
not equal it in the hash. Repeated rows are repeated turns. An empty table gives an empty result. Extra
columns are not read. The turns of one conversation meet in one row, as the rendered text does; a
prefix that many conversations share is reduced to one row per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import materialise

START, END = "<|im_start|>", "<|im_end|>"


def _turn_bytes(t: Column) -> Column:
    """Role and text with lengths in front, so that different turns never give the same bytes."""

    def sized(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.concat(sized(t["role"]), sized(t["text"]))


def prefix_hashes(turns: Column) -> Column:
    """Hash of the first turn, of the first two, ... (hex sha-256, each over the one before)."""
    last = F.element_at  # of a list that is never empty when it is asked for
    return F.aggregate(
        turns,
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.when(F.size(acc) > 0, last(acc, -1)).otherwise(F.lit("")), _turn_bytes(t)), 256))),
    )


def with_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_equal) of maximal conversations; ``n_equal`` counts those equal in full."""
    hashed = materialise(with_turns(conversations).select("conv_id", "turns", prefix_hashes(F.col("turns")).alias("h")))
    whole = hashed.groupBy(F.element_at("h", -1).alias("own")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = hashed.where(F.size("h") > 1).select(F.explode(F.slice("h", F.lit(1), F.size("h") - 1)).alias("own")).distinct()
    kept = whole.join(proper, "own", "left_anti").select("conv_id", "n_equal")
    return kept.join(hashed.select("conv_id", "turns"), "conv_id").select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), "n_equal")


def render(turns: Column) -> Column:
    """One block per turn: start mark and role, text, end mark."""
    block = F.transform(turns, lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n")))
    return F.array_join(block, "")


def chat_documents(conversations: DataFrame) -> DataFrame:
    return collapse_snapshots(conversations).select("conv_id", "n_turns", "n_equal", render(F.col("turns")).alias("rendered"))
