"""Language identification by trained character profiles.

A profile has the log probability of every three-letter sequence in a language, with one added to
each count. It is learnt from labelled documents: sequences are counted by language. A document takes
the language under which its sequences are likeliest. Both steps are joins and grouped sums, which are
pre-aggregated in every task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 3
#: Letters that are cut at a time.
PIECE = 1 << 20
UNKNOWN = "unknown"


def _counted(texts: list[str], size: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The sequences of some texts: the number of the text, the sequence, and how often it occurs there."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[codes] = True
    rank, letters = (np.cumsum(used) - 1)[codes], int(used.sum())
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    starts = np.flatnonzero(owner[:len(owner) - size + 1] == owner[size - 1:])
    key, bound = owner[starts], len(texts)
    for j in range(size):
        if bound * letters >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            bound = len(seen)
        key, bound = key * letters + rank[starts + j], bound * letters
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = starts[first]
    return owner[at], [whole[p:p + size] for p in at.tolist()], counts


def gram_counts(df: DataFrame, id_col: str = "doc_id", extra: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(id, extra..., gram, c): how often each sequence occurs in a text, in lower case. Texts are cut by numpy, about a million
    letters at a time: a place in a string is found by reading it from the start, so cutting by an expression takes the square
    of a text's length. A sequence of a longer text has a row for each of its pieces."""
    low = df.where(F.length("text") >= size).select(id_col, *extra, F.lower("text").alias("t"))

    def cut(batches):
        for batch in batches:
            rows, texts, held = [], [], 0
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py()
                for at in range(0, max(len(text) - size + 1, 1), PIECE):
                    rows.append(row)
                    texts.append(text[at:at + PIECE + size - 1])
                    held += len(texts[-1])
                    if held >= PIECE:
                        yield counted(batch, rows, texts)
                        rows, texts, held = [], [], 0
            if texts:
                yield counted(batch, rows, texts)

    def counted(batch, rows, texts):
        owner, seqs, counts = _counted(texts, size)
        place = pa.array(np.array(rows, np.int64)[owner])
        keys = [batch.column(i).take(place) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(seqs, pa.string()), pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "gram", "c"])

    kinds = T.StructType([*[low.schema[c] for c in (id_col, *extra)], T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])
    return low.mapInArrow(cut, kinds)


def learn_profiles(df: DataFrame, lang: str = "lang", id_col: str = "doc_id", size: int = SIZE) -> tuple[DataFrame, list[str]]:
    """(gram, one column of log probabilities for each language) and the languages, sorted. Rows without a label teach nothing;
    languages are few, and only their totals reach the driver."""
    from tidewater.session import staged
    counts = staged(gram_counts(df.where(F.col(lang).isNotNull()), id_col, [lang], size).groupBy(lang, "gram").agg(F.sum("c").alias("c")), "grams")
    totals = {r[0]: r[1] for r in counts.groupBy(lang).agg(F.sum("c")).collect()}
    langs = sorted(totals)
    seen = counts.select("gram").distinct().count()
    cells = [F.log((F.coalesce(F.sum(F.when(F.col(lang) == F.lit(name), F.col("c"))), F.lit(0)) + 1) / F.lit(float(totals[name] + seen))).alias(f"lp_{i}")
             for i, name in enumerate(langs)]
    if not langs:
        return counts.select("gram").limit(0), langs
    return staged(counts.groupBy("gram").agg(*cells), "profiles"), langs


def identify(df: DataFrame, profiles: DataFrame, langs: list[str], id_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(id, detected, log_likelihood): the likeliest language (ties to the least name) and the mean log
    probability of the known sequences under it. A null text, or one without a known sequence, is unknown with 0. Ids are distinct."""
    if not langs:
        return df.select(id_col, F.lit(UNKNOWN).alias("detected"), F.lit(0.0).alias("log_likelihood"))
    hits = gram_counts(df, id_col, size=size).join(profiles, "gram")
    sums = hits.groupBy(id_col).agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * F.col(f"lp_{i}")).alias(f"s_{i}") for i in range(len(langs))])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"s_{i}") / F.col("n")).alias("worse"), F.lit(name).alias("lang")) for i, name in enumerate(langs)]))
    best = sums.select(id_col, ranked[0].alias("b"))
    return df.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("b.lang", F.lit(UNKNOWN)).alias("detected"),
                                                               F.coalesce(-F.col("b.worse"), F.lit(0.0)).alias("log_likelihood"))


def accuracy(found: DataFrame, truth: DataFrame, lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(language, n, correct) of the labelled rows."""
    return (truth.where(F.col(lang).isNotNull()).select(id_col, F.col(lang).alias("language")).join(found.select(id_col, "detected"), id_col)
            .groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("detected") == F.col("language")).cast("double")).alias("correct")))
