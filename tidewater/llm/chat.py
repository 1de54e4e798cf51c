"""Chat formatting of maximal conversations; DataFrame functions only.

Chat logs often hold the same conversation many times, each snapshot one turn
longer than the one before. Every turn gets a position and a rolling hash of the
conversation up to it: the exclusive or of 64-bit hashes of (position, role,
text), twice with different salts. A conversation is a prefix of a longer one if
and only if its hash turns up more often among all turns than conversations end
on it. Such ones go by an anti-join; of equal ones the smallest id stays. What
is left is rendered.

No task holds a whole conversation: positions and hashes are computed in blocks
of turn numbers, whose counts and hashes are then added up in order, and the
rendered text comes in parts of ``PART`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import staged

#: Turn numbers of a block, and turns of a rendered part.
BLOCK, PART = 256, 256
#: The markers of a turn.
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn between its markers. A marker's opening in role or text is parted by a zero-width space."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<​|"))
    return F.concat(F.lit(START), safe(role), F.lit("\n"), safe(text), F.lit(END + "\n"))


def _same(left: str, right: str, nullable: list[str], plain: list[str]) -> Column:
    return F.expr(" and ".join([*[f"{left}.{c} <=> {right}.{c}" for c in nullable], *[f"{left}.{c} = {right}.{c}" for c in plain]]))


def _facts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, d1, d2, pos, p1, p2): distinct turns with position and rolling hashes."""
    facts = staged(turns.select("conv_id", "turn", "d1", "d2").distinct(), "turns").withColumn("block", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(1e18)) / BLOCK))
    order = [F.col("turn").asc_nulls_last(), F.col("d1"), F.col("d2")]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = facts.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = facts.withColumn("rank", F.row_number().over(inside) - 1).alias("f").join(counts.alias("c"), _same("f", "c", ["conv_id"], ["block"]))
    pos = (F.col("before") + F.col("rank")).cast("long")
    placed = staged(placed.select("f.conv_id", "turn", "d1", "d2", "f.block", pos.alias("pos"),
                                  F.xxhash64(pos, "d1", "d2").alias("x1"), F.xxhash64("d2", "d1", pos, F.lit("second")).alias("x2")), "positions")
    ordered = Window.partitionBy("conv_id", "block").orderBy("pos")
    whole = placed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    whole = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(b) for x, b in (("x1", "b1"), ("x2", "b2"))])
    rolling = (placed.withColumn("r1", F.bit_xor("x1").over(ordered)).withColumn("r2", F.bit_xor("x2").over(ordered)).alias("f")
               .join(whole.alias("c"), _same("f", "c", ["conv_id"], ["block"])))
    return rolling.select("f.conv_id", "turn", "d1", "d2", "pos", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))


def chat_texts(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per part of a maximal conversation: conv_id, part, n_turns, copies, text.

    ``copies`` counts the logged conversations that are equal to it. Turns are
    ordered by number, null last; turns that share a number follow each other in
    a fixed order, and rows that repeat a turn are one turn. Null roles and texts
    count as empty. Rows without a conversation id are one conversation. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                         F.xxhash64(role, text).alias("d1"), F.xxhash64(text, F.lit("second"), role).alias("d2"))
    facts = staged(_facts(turns), "prefixes")
    last = facts.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("e")).select("conv_id", "e.*")
    ends = staged(last.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")), "ends")
    seen = facts.groupBy("pos", "p1", "p2").agg(F.count(F.lit(1)).alias("times"))
    inner = seen.join(ends, ["pos", "p1", "p2"]).where("times > copies").select("pos", "p1", "p2")
    maximal = staged(ends.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", "copies"), "maximal")
    # each turn's text meets its position where the conversation stays
    kept = facts.alias("f").join(maximal.alias("m"), F.expr("f.conv_id <=> m.conv_id")).select("f.conv_id", "turn", "d1", "d2", "pos", "copies")
    said = turns.alias("t").join(staged(kept, "kept").alias("k"), _same("t", "k", ["conv_id", "turn"], ["d1", "d2"]))
    said = said.select("t.conv_id", F.floor(F.col("pos") / PART).cast("long").alias("part"), "copies", F.struct("pos", rendered(F.col("role"), F.col("text")).alias("said")).alias("s"))
    parts = said.groupBy("conv_id", "part").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_set("s")).alias("s"))
    return parts.select("conv_id", "part", F.size("s").cast("long").alias("n_turns"), "copies", F.array_join("s.said", "").alias("text"))
