"""Topic coherence c_v (X20): how much the top words of a topic occur together in sliding windows.

A window covers 110 consecutive tokens of a document and moves by one token; a
shorter document is one window. Windows are not listed. A token at position p is
in the windows that start from p - 109 to p, so the windows with a word, or with
either of two words, are a union of intervals. Its size is the sum, over the
positions in order, of what each interval adds to the one before. The windows with both
words follow by inclusion and exclusion.

Only the top words are looked at: a document is shuffled as the places of those it has, once, and the
intervals of all pairs of a topic's words are added up where it arrives. The top words and their
pairs go to every task, so topics and words of a topic should be few. A null or empty token list has no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.text import exploded
from tidewater.session import staged

#: Fixed values of the measure: tokens of a window, and what is added to the joint probability.
WINDOW, EPSILON = 110, 1e-12


def _pairs(topics: DataFrame) -> DataFrame:
    """(wi, wj) of the words that share a topic, wi <= wj; a word with itself, too."""
    a, b = (topics.select("topic", F.col("term").alias(c)) for c in ("wi", "wj"))
    return a.join(b, "topic").where("wi <= wj").select("wi", "wj").distinct()


def window_counts(docs: DataFrame, topics: DataFrame, window: int = WINDOW, id_col: str = "doc_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(wi, wj, n): the windows with wi or wj, for all pairs of a topic; and the number of all windows as a row."""
    sized = docs.select(F.col(id_col).alias("doc"), F.col(tokens).alias("tokens"), F.size(tokens).cast("long").alias("size")).where("size > 0")
    total = sized.agg(F.coalesce(F.sum(F.greatest(F.col("size") - (window - 1), F.lit(1))), F.lit(0)).alias("windows"))
    pairs = [(r["wi"], r["wj"]) for r in _pairs(topics).collect()]
    terms = sorted({w for p in pairs for w in p})
    if not terms:
        return docs.sparkSession.createDataFrame([], "wi string, wj string, n long"), total
    codes = {w: i for i, w in enumerate(terms)}
    spots = F.transform(F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda s: s["term"].isin(terms)),
                        lambda s: F.struct(s["pos"].alias("pos"), (F.array_position(F.lit(terms), s["term"]) - 1).cast("int").alias("code")))
    key = F.coalesce(F.concat(F.lit("="), F.col("doc").cast("string")), F.lit(""))  # rows of one document meet
    dealt = sized.select(key.alias("key"), "size", spots.alias("spots")).repartition("key").sortWithinPartitions("key")

    def added(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [(codes[x], codes[y]) for x, y in pairs]
        total_ = np.zeros(len(names), "int64")
        for part in _whole(tables):
            total_ += _windows(part, names, len(terms), window)
        seen = np.flatnonzero(total_)
        yield pa.RecordBatch.from_pydict({"wi": [pairs[i][0] for i in seen], "wj": [pairs[i][1] for i in seen], "n": total_[seen]},
                                         schema=pa.schema([("wi", pa.string()), ("wj", pa.string()), ("n", pa.int64())]))
    return dealt.mapInArrow(added, "wi string, wj string, n long").groupBy("wi", "wj").agg(F.sum("n").alias("n")), total


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, ordered by key, in tables that end with a key's last row."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        open_ = pc.index(now["key"], now["key"][-1]).as_py()
        rest = now.slice(open_)
        if open_:
            yield now.slice(0, open_)
    if rest is not None:
        yield rest


def _windows(rows: pa.Table, pairs: list[tuple[int, int]], terms: int, window: int) -> np.ndarray:
    """How many windows of the documents have one of the words, for each pair of codes."""
    lists = rows["spots"].combine_chunks()
    doc = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    many = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten()
    pos, code = (flat.field(f).to_numpy().astype("int64") for f in ("pos", "code"))
    doc, size = np.repeat(doc, many), np.repeat(rows["size"].to_numpy(), many)
    low, high = np.maximum(pos - (window - 1), 0), np.minimum(pos, np.maximum(size - window, 0))
    order = np.lexsort((pos, doc))
    doc, low, high, code = doc[order], low[order], high[order], code[order]
    by = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[by], np.arange(terms + 1))
    at = [by[ends[c]:ends[c + 1]] for c in range(terms)]
    out = np.zeros(len(pairs), "int64")
    for i, (x, y) in enumerate(pairs):
        both = at[x] if x == y else np.sort(np.concatenate([at[x], at[y]]))
        if len(both):
            h, d = high[both], doc[both]
            last = np.where(np.r_[True, d[1:] != d[:-1]], -1, np.r_[-1, h[:-1]])
            out[i] = np.maximum(h - np.maximum(low[both], last + 1) + 1, 0).sum()
    return out


def cv_coherence(docs: DataFrame, topics: DataFrame, window: int = WINDOW, id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(topic, c_v) of topics given as (topic, term).

    The vector of a word has its normalised pointwise mutual information with every word of its topic;
    c_v is the mean cosine between a word's vector and the sum of all. A word that no window has counts as
    unrelated to every word (information 0)."""
    topics = staged(topics, "topics")  # read five times below, as is the small table of pairs
    counts, total = window_counts(docs, topics, window, id_col, tokens)
    counts = staged(counts, "counts")
    n = float(total.first()[0])
    own = counts.where("wi = wj").select(F.col("wi").alias("w"), F.col("n").alias("c"))
    terms = topics.select("topic", "term").distinct()
    both = (terms.withColumnRenamed("term", "x").join(terms.withColumnRenamed("term", "y"), "topic")
            .withColumn("wi", F.least("x", "y")).withColumn("wj", F.greatest("x", "y")).join(counts, ["wi", "wj"], "left")
            .join(own.select(F.col("w").alias("x"), F.col("c").alias("cx")), "x", "left").join(own.select(F.col("w").alias("y"), F.col("c").alias("cy")), "y", "left"))
    together = F.when(F.col("x") == F.col("y"), F.col("cx")).otherwise(F.col("cx") + F.col("cy") - F.col("n"))
    joint = together / F.lit(n) + F.lit(EPSILON)
    npmi = F.coalesce(F.log(joint / ((F.col("cx") / F.lit(n)) * (F.col("cy") / F.lit(n)))) / -F.log(joint), F.lit(0.0))
    # every window has both words: log(joint) is 0
    cells = both.select("topic", "x", "y", F.when(joint >= 1, F.lit(1.0)).otherwise(npmi).alias("v"))
    whole = cells.groupBy("topic", "y").agg(F.sum("v").alias("s"))
    cosine = F.when((F.sum(F.col("v") * F.col("v")) > 0) & (F.sum(F.col("s") * F.col("s")) > 0),
                    F.sum(F.col("v") * F.col("s")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("s") * F.col("s")))).otherwise(0.0)
    return cells.join(whole, ["topic", "y"]).groupBy("topic", "x").agg(cosine.alias("m")).groupBy("topic").agg(F.avg("m").alias("c_v"))


def group_topics(docs: DataFrame, group: str, words: int = 10, tokens: str = "tokens") -> DataFrame:
    """(topic, rank, term): the most frequent tokens of each group of documents, ties by term. Terms are first reduced in hash parts."""
    counts = docs.select(F.col(group).alias("topic"), F.explode(exploded(tokens)).alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("term")]
    part = F.pmod(F.xxhash64("term"), F.lit(64))
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("topic", part).orderBy(*order))).where(F.col("r") <= words)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("rank") <= words)
            .select("topic", "rank", "term"))
