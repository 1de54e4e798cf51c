"""What the operators of this subpackage share.

A *word* is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return; in Python that is exactly ``bytes.split()``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The word separators, as a Java / Python character class and as a string.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_bytes(text_col: str) -> Column:
    """A text's UTF-8 bytes as column ``text``; what is no UTF-8 becomes U+FFFD, and valid texts stay as they are."""
    return F.make_valid_utf8(F.col(text_col).cast("string")).cast("binary").alias("text")


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column`` (one row at least),
    so that working memory follows the text and not the row count."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Dense ids of the words in this list, and the distinct words in id order."""
    seen = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), list(seen)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of a 128-bit hash of each word; each distinct word is hashed once."""
    ids, distinct = word_ids(words)
    table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
    return table[ids]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed longs that Spark stores."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def hex_digits(rows: int, per_chunk: int = 1 << 16) -> int:
    """How many leading hex digits of a digest cut ``rows`` rows into chunks of about ``per_chunk``."""
    digits = 0
    while rows > per_chunk << (4 * digits):
        digits += 1
    return digits


def split_rank(df: DataFrame, keys: list[str], digest: str, order: list[Column], digits: int, name: str) -> DataFrame:
    """Add ``name``: the rank from 0 of each row among the rows of its ``keys``, by ``digest`` and then ``order``.

    No task holds the rows of a hot key: a key is cut by the leading hex digits
    of the digest, the chunks are counted first, and a row's rank is its rank in
    the chunk plus what lies in earlier chunks. The cut leaves the ranks unchanged.
    """
    rows = df.withColumn("__chunk", F.substring(digest, 1, digits) if digits else F.lit(""))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(digest, *order)
    rows = rows.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    if not digits:
        return rows.drop("__chunk")
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (df.withColumn("__chunk", F.substring(digest, 1, digits)).groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
              .select(*keys, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    on = [rows[k].eqNullSafe(chunks[k]) for k in [*keys, "__chunk"]]
    both = rows.join(chunks, on[0] if len(on) == 1 else [*on])
    return both.select(*[rows[c] for c in df.columns], (F.col(name) + F.col("__before")).alias(name))
