"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are the same after all separators are deleted. Of
equal texts the row with the most code points stays, then the smallest id.

1. One pass writes (id, digest, length) of every row to the shared folder.
2. Misra-Gries: each task keeps ``counters`` counters over its digests; the
   counters of all tasks are added up. A digest's sum falls short of its true
   count by at most rows / (counters + 1), and all sums together are at most the
   number of rows, so no more than ``counters`` + 1 digests reach the cut of
   rows / (counters + 1), and each digest with twice that many rows does.
3. The digests that reach the cut are counted exactly and their winners found
   by one map-side-combined aggregate. These at most ``counters`` + 1 rows are
   broadcast, and rows of frequent digests are settled without a shuffle.
4. The other digests, none with more than 2 * rows / (counters + 1) rows, are
   shuffled in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES
from tidewater.session import staged

COUNTERS = 1024


def normalised(text: Column) -> Column:
    """The text without separators; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))


def misra_gries(digests: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """At most ``counters`` digests with lower bounds of their counts."""
    kept: dict[bytes, int] = {}
    for d in digests:
        if d in kept:
            kept[d] += 1
        elif len(kept) < counters:
            kept[d] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def fold(kept: dict[bytes, int], batch: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Merge two summaries: add, then take the next-largest count off all (the mergeable form of the method)."""
    for k, n in batch.items():
        kept[k] = kept.get(k, 0) + n
    if len(kept) <= counters:
        return kept
    cut = int(np.partition(np.fromiter(kept.values(), np.int64), -(counters + 1))[-(counters + 1)])
    return {k: n - cut for k, n in kept.items() if n > cut}


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest): candidates, at most ``counters`` + 1 of them, among which is every
    digest with at least 2 * rows / (counters + 1) rows."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            counted = batch.column(0).value_counts()
            kept = fold(kept, dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist())), counters)
        # the row count travels under a null digest
        yield pa.RecordBatch.from_pydict({"digest": [*kept, None], "n": [*kept.values(), rows]},
                                         schema=pa.schema([("digest", pa.binary()), ("n", pa.int64())]))

    sums = digests.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    sums = staged(sums, "summaries")
    rows = sums.where(F.col("digest").isNull()).agg(F.sum("n")).first()[0] or 0
    return sums.where(F.col("digest").isNotNull() & (F.col("n") * (counters + 1) >= rows)).select("digest")


def winners(hashed: DataFrame, counters: int) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests; at most ``counters`` + 1 rows."""
    heavy = hashed.join(F.broadcast(frequent(hashed, counters)), "digest", "left_semi")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    return staged(heavy.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
                  .select("digest", F.col("best.doc_id").alias("keep_id"), "group_size"), "winners")


def _order() -> list[Column]:
    return [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty and all-separator texts are one group.
    Rows that repeat an id inside a group carry the same verdict; a null id
    stays only if its group has no other. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    hashed = staged(digested(docs, id_col, text_col), "digests")
    best = winners(hashed, counters)
    heavy = hashed.join(F.broadcast(best), "digest")
    rest = hashed.join(F.broadcast(best.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("*", F.first("doc_id").over(group.orderBy(*_order())).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    both = heavy.select(rest.columns).unionByName(rest)
    return both.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The input with exactly one row of each group of equal texts, all columns unchanged.

    Copies of frequent digests leave map-side. Rows that repeat the id of a
    winner, too, are reduced to one.
    """
    hashed = staged(digested(docs, id_col, text_col), "digests")
    best = winners(hashed, counters)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
                        F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_chars"))
    marked = keyed.join(F.broadcast(best.withColumn("heavy", F.lit(True)).select("digest", "keep_id", "heavy")), "digest", "left")
    heavy = (marked.where(F.col("heavy") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .groupBy("digest").agg(F.max_by("row", "n_chars").alias("row")))
    rest = (marked.where(F.col("heavy").isNull())
            .withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy(*_order()))).where("nth = 1"))
    return heavy.select("row.*").unionByName(rest.select("row.*"))
