"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources in code point order, null last, weigh 3, 1, 2, 3, 1, 2, ... They share
``share`` times all words by weight; a source's target stops at ``most`` times
its size and the excess goes to the others by weight. That is one water level:
with the sources ordered by cap / weight, the level is (words left) / (weight
left) at the first source whose cap lies above it, which is the largest such level.

Within a source each document is expected to be copied target / size times.
Documents are taken in order of size (ties by the md5 of the id), so that the
prefix sum of the expected copies steps evenly through short and long texts;
one random offset per source is added, and a document is emitted once for each
integer that its step crosses. The words taken then differ from the target by
about one long document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import hex_digits, split_rank, word_count
from tidewater.session import staged

#: The weights in turn, the share of all words, the limit of a source and the seed of the offsets.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "tidewater"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with ``target``; one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(turn, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("mark", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("water", F.max(F.when(F.col("mark") * F.col("weight") <= F.col("cap"), F.col("mark"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in [0, 1)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "0").otherwise("1"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0. Null sources are one source, the last. A source
    without words has target 0 and no copies. Rows that repeat an id are rows of
    their own. An empty table gives no rows. Other columns are not read.
    """
    sizes = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    return _plan(sizes, weights, share, most, seed)


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    per_size = staged(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "per_size")
    goal = targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    # rows of the same source in smaller sizes; the table has one row per source and distinct size
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = per_size.select("source", "size", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    most_rows = per_size.agg(F.max("n")).first()[0] or 0
    keyed = sizes.withColumn("id_md5", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("~")))
    ranked = split_rank(keyed, ["source", "size"], "id_md5", [F.col("doc_id")], hex_digits(most_rows), "rank")
    # written out, so that the join below has a plain exchange on both sides and a hot size can be split
    g = staged(steps.alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source")).select("s.*", "source_size", "target"), "targets")
    both = ranked.alias("r").join(g.alias("g"), F.expr("r.source <=> g.source and r.size = g.size")).select("r.*", "source_size", "target", "below")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = F.col("below") + F.col("rank")
    start = offset(F.col("source"), seed)
    copies = F.least(F.floor(expected * (step + 1) + start) - F.floor(expected * step + start), F.ceil(expected)).cast("long")
    return (both.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each input row as often as it is taken, all columns unchanged.

    The plan is joined back on the id and the other facts that fix a row's
    verdict. Rows alike in all of them share their copies evenly, in any order.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plan = (mix_plan(docs, id_col, text_col, source_col, **options).groupBy("doc_id", "source", "size")
            .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"))
    keyed = docs.select(row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    both = (keyed.alias("d").join(plan.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.source <=> p.source and d.size = p.size"))
            .select("row", "d.doc_id", "d.source", "d.size", "copies", "rows"))
    single = both.where("rows = 1").select("row", F.col("copies").alias("times"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0)))
    alike = (both.where("rows > 1").withColumn("nth", nth)
             .select("row", F.expr("nth * copies div rows - (nth - 1) * copies div rows").alias("times")).where("times > 0"))
    copies = single.unionByName(alike)
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*")
