"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group and stay together. Groups are taken by
falling size; each goes to the shard with the least load so far.

The schedule depends on how many groups there are of each size, not on which,
so Spark counts groups by size and only these counts reach the driver. Sizes
are exact below 64 KiB; above that the leading 16 bits count, which puts sizes
within 0.003 % of each other into one class. This bounds the table of counts by
65,536 + 32,768 for each doubling beyond (about a million classes at 4 TiB a
group), whatever the number of documents. A heap of loads deals out each class;
for a class of many groups, the cycles in which the same shards take turns are
counted instead of popped one by one. Spark then ranks groups in their class
and reads their shard from the dealt sequence.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hex_digits, split_rank
from tidewater.session import staged


def deal(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Give ``count`` items of ``size`` to the least-loaded shards (the first one among
    equals), and add to ``loads``. Returns phases (first rank, shards): from that rank
    on, items go to these shards in turn."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    phases: list[tuple[int, list[int]]] = []
    rank = 0
    while rank < count:
        least, first = heap[0]
        turn = []  # the shards that get an item before the least-loaded one gets its second
        while heap and heap[0] < (least + size, first):
            turn.append(heapq.heappop(heap))
        turn = turn[:count - rank]
        whole = len(turn) == len(loads) or not heap
        waits = (heap[0][0] - least + size - 1) // size - 1 if heap else count
        cycles = max(1, min((count - rank) // len(turn), count if whole else waits))
        phases.append((rank, [shard for _, shard in turn]))
        rank += cycles * len(turn)
        for load, shard in turn:
            loads[shard] = load + cycles * size
            heapq.heappush(heap, (loads[shard], shard))
    return phases


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, count) pairs -> (size, phases), by falling size."""
    loads = [0] * n_shards
    return [(size, deal(loads, size, count)) for size, count in sorted(sizes, reverse=True)]


def longest_first(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, text_md5, shard, slot.

    ``size`` is the UTF-8 length of the text plus ``overhead``; slots number the
    rows of a shard from 0, ordered by the md5 of the id. A null text counts as
    empty, so null and empty texts are one group. Rows that repeat an id, or
    have none, each get a slot of their own. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = staged(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_md5"),
    ), "sizes")
    groups = base.groupBy("text_md5").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    groups = (groups.withColumn("low", F.greatest(F.length(F.bin("bytes")) - 16, F.lit(0)))
              .withColumn("class", F.expr("shiftleft(shiftright(bytes, low), low)")))
    counted = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).collect()
    plan = schedule([(r["class"], r["n"]) for r in counted], n_shards)
    turns = spark.createDataFrame(
        [(size, [{"first": a, "shards": b} for a, b in phases]) for size, phases in plan],
        "class long, phases array<struct<first: long, shards: array<int>>>")
    ranked = split_rank(groups.select("text_md5", "class"), ["class"], "text_md5", [], hex_digits(max([r["n"] for r in counted], default=0)), "rank")
    phase = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("rank")), -1)
    dealt = (ranked.join(turns, "class").withColumn("phase", phase)
             .select("text_md5", F.get(F.col("phase.shards"), ((F.col("rank") - F.col("phase.first")) % F.size("phase.shards")).cast("int")).alias("shard")))
    # written out, so that the join has a plain exchange on both sides and a hot text can be split
    placed = base.join(staged(dealt, "groups"), "text_md5").withColumn("id_md5", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("~")))
    rows = sum(r["rows"] for r in counted)
    slotted = split_rank(placed, ["shard"], "id_md5", [F.col("doc_id"), F.col("text_md5")], hex_digits(rows), "slot")
    return slotted.select("doc_id", "size", "text_crc32", "text_md5", "shard", "slot")
