"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A chat service that logs the whole history at every turn writes the same conversation again and again, each
time a little longer. Every turn gets the hash of all turns up to it; a conversation whose last hash and
length are found before the end of another one is a snapshot of it and goes, as do all but the least id of
equal conversations. What remains is rendered turn by turn.

Turns are handled in blocks of ``BLOCK_TURNS``: running hashes are taken within a block and then over the
block totals, and text is rendered into one part a block, so that no conversation meets in one row or task,
however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

BLOCK_TURNS = 256
#: Conversations that stay, up to which their ids are broadcast; more are met in a shuffled join.
BROADCAST_IDS = 500_000
_MARKS = ("a", "b")


def _turns(conversations: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn): of rows that repeat a turn, the least (role, text) stays."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    return rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("said").alias("said")).select("conv_id", "turn", "said.*")


def _hash(mark: str) -> Column:
    return F.xxhash64(F.lit(mark), "turn", F.lit("r"), "role", F.lit("t"), "text")


def log(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text) with their two 64-bit hashes, written once: texts are shuffled for this and for what is rendered."""
    return materialize(_turns(conversations).select("*", *(_hash(m).alias(m) for m in _MARKS)), "turns")


def _prefixes(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, n, a, b): for every turn, the number of turns up to it and the hashes of all of them."""
    keyed = turns.select("conv_id", "turn", F.floor(F.col("turn") / block_turns).alias("block"), *_MARKS)
    blocks = keyed.groupBy("conv_id", "block").agg(F.count("*").alias("size"), *(F.bit_xor(m).alias(m) for m in _MARKS))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("n0"), *(F.coalesce(F.bit_xor(m).over(before), F.lit(0)).alias(f"{m}0") for m in _MARKS))
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    running = keyed.select("conv_id", "block", F.row_number().over(within).alias("k"), *(F.bit_xor(m).over(within).alias(m) for m in _MARKS))
    return running.join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("n0") + F.col("k")).alias("n"), *(F.col(m).bitwiseXOR(F.col(f"{m}0")).alias(m) for m in _MARKS))


def maximal(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, n_turns) of the conversations that aren't a snapshot of another one.

    A conversation is a snapshot if its turns (number, role, text) are the first ones of a longer
    conversation. Of equal conversations the least conv_id stays. Null roles and texts count as empty; rows
    with a null conv_id or turn are left out; turns may have gaps. An empty table gives an empty result.
    """
    return _maximal(log(conversations), block_turns)


def _maximal(turns: DataFrame, block_turns: int) -> DataFrame:
    prefixes = materialize(_prefixes(turns, block_turns), "prefixes")
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", *_MARKS)).alias("e")).select("conv_id", "e.*")
    firsts = ends.groupBy("n", *_MARKS).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.join(ends.select("conv_id", F.col("n").alias("last")), "conv_id").where("n < last").select("n", *_MARKS).distinct()
    return firsts.join(inner, ["n", *_MARKS], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame, kept: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text): the kept conversations as marked text, one part for each block of turns.

    A turn is ``<|role|>\\ntext<|end|>\\n``; the parts of a conversation in their order are its whole text.
    """
    return _rendered(_turns(conversations), kept, block_turns)


def _rendered(turns: DataFrame, kept: DataFrame, block_turns: int) -> DataFrame:
    kept = materialize(kept.select("conv_id"), "kept")
    turns = turns.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, "conv_id", "left_semi")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / block_turns).alias("part")).agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Maximal conversations, rendered; columns besides conv_id, turn, role and text are ignored."""
    turns = log(conversations)
    return _rendered(turns, _maximal(turns, block_turns), block_turns)
