"""Quality rules on repetition, from a suffix array of each document's words.

The words of a slice of documents form one array of numbers; the rank of a
suffix starts as (document, word), so suffixes of different documents part at
their first word. Prefix doubling sorts only the suffixes that are still equal.
The ranks of each round give the longest common prefix of neighbours by binary
lifting; the larger one of a suffix and its two neighbours is the longest
repeat that starts there. Suffixes whose repeat is not merely the tail of the
one before mark the maximal repeated substrings; the union of their spans and
the longest of them are limited. Everything runs on numpy arrays in the scan:
no shuffle, and memory follows the slice of text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, record, slices, text_bytes, word_ids

#: Production parameters. Base rule: fewest words, words of a repeated window, its largest share in percent.
MIN_WORDS, WINDOW, MAX_WINDOW_PERCENT = 10, 5, 20
#: The method's rule: repeats of at least so many words may cover at most this share, and none may be longer than that.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_REPEAT = 10, 20, 100

SYMBOLS = "#*$%&|<>"

MEASURES = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64()),
    ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
MEASURES_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, "
                "longest_repeat long, repeats array<struct<start: long, length: long>>, base_failed boolean, kept boolean")


def longest_repeats(words: np.ndarray, doc: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest run of words that starts there and
    also starts elsewhere in the same document; lengths under a power of two that is
    at most ``least`` count as 0. ``stop``: each position's document end."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = doc * np.int64(words.max() + 1) + words
    order = np.argsort(key)
    key = key[order]
    place = np.arange(n)
    first = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    levels = [rank.astype(np.int32 if n < 2**31 else np.int64)]
    tied = np.flatnonzero(~first | np.r_[~first[1:], False])
    reach = 1
    while len(tied):
        at = order[tied]
        after = np.where(at + reach < stop[at], rank[np.minimum(at + reach, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + after
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[tied] = at
        first = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        levels.append(rank.astype(levels[0].dtype))
        tied = tied[~first | np.r_[~first[1:], False]]
        reach *= 2
    floor = int(least).bit_length() - 1
    if len(levels) <= floor:
        return longest
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(levels[floor][a] == levels[floor][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        inside = (a + common < stop[a]) & (b + common < stop[b])
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where(inside & (levels[i][x] == levels[i][y]), 1 << i, 0)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT) -> pa.RecordBatch:
    """The measures and verdicts of these texts."""
    split = [t.encode().split() if t else [] for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    words, _ = word_ids([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), size)
    stop = np.repeat(ends, size)
    longest = longest_repeats(words, doc, stop, min(WINDOW, min_repeat))
    per_doc = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    at = np.flatnonzero(longest >= WINDOW)
    window_words = per_doc(covered(at, np.full(len(at), WINDOW), n))
    same_doc_before = np.r_[False, doc[1:] == doc[:-1]] if n else np.zeros(0, bool)
    tail = same_doc_before & (np.r_[0, longest[:-1]] == longest + 1) if n else same_doc_before
    maximal = np.flatnonzero((longest >= min_repeat) & ~tail)
    repeat_words = per_doc(covered(maximal, longest[maximal], n))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc[maximal], longest[maximal])
    spans = pa.StructArray.from_arrays([pa.array(maximal - (stop - size[doc])[maximal]), pa.array(longest[maximal])], ["start", "length"])
    spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[maximal], minlength=len(texts)))].astype(np.int32)), spans)
    base_failed = (size < MIN_WORDS) | (100 * window_words > MAX_WINDOW_PERCENT * size)
    kept = ~base_failed & (100 * repeat_words <= max_covered * size) & (top <= max_repeat)
    letters = [len(t) - sum(map(t.count, SPACES)) if t else 0 for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts]
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACES)] if t else []
        dup_lines.append(len(lines) - len(set(lines)))
    return record(MEASURES, [size, letters, symbols, dup_lines, window_words, repeat_words, top, spans, base_failed, kept])


def _texts(column: pa.Array) -> list[str | None]:
    return [None if b is None else b.decode() for b in column.to_pylist()]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT,
            max_covered: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: doc_id, the base measures, covered words, longest
    repeat, the maximal repeats (start, length in words), base_failed, kept.

    Null and empty texts have no words and are rejected by the base rule. Rows
    that repeat are judged alike. An empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                found = measure(_texts(part.column("text")), min_repeat, max_covered, max_repeat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.columns], names=["doc_id", *MEASURES.names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MEASURES_DDL}")


def drop_repetitive(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT,
                    max_covered: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The input's rows that pass, all columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, text_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                found = measure(_texts(part.column("text")), min_repeat, max_covered, max_repeat)
                yield part.select(["row"]).filter(found.column("kept"))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
