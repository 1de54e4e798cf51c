"""Removal of repeated passages over a compacted De Bruijn graph of token k-mers.

A passage of ``WINDOW`` words that starts in two places is to be found without
moving every window. Of the ``KMER``-word sequences inside a window, the one
with the least hash stands for it; it depends on the window's words alone, so
both copies have it. These k-mers (about one position in fourteen) are the nodes
of a sparse De Bruijn graph. The words from one node to the next in a document
are an edge.

1. Spark counts the nodes; only nodes that occur twice or more go on.
2. A node whose edge forward (backward) is the same wherever it occurs does not
   branch there. Aggregates find this and joins bring it back to each place.
3. In each document consecutive repeated nodes are joined into one path as long
   as neither the one node branches forward nor the next one backward. Wherever
   one node of such a path occurs, the whole path does.
4. Source coordinates verify: the digest (128 bits) of the words from the start
   to the end of each path is counted, and so is that of every window that has a
   repeated node and is not inside a path, that is, at the ends of paths and
   where paths branch. Digests found twice or more are repeated passages, and
   joins bring their coordinates back.

Copies of long texts thus cost a few rows each instead of one for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_long, scramble, slices, text_bytes, word_hashes
from tidewater.session import staged

#: Words of a passage and of a node.
WINDOW, KMER = 35, 8
#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of some texts in a row, hashed so that any run of them has a digest in constant time."""

    split: list[list[bytes]]
    size: np.ndarray
    start: np.ndarray
    sums: list[np.ndarray]
    undo: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Words:
        split = [t.split() if t else [] for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for ws in split for w in ws]
        hashed = word_hashes(flat) if flat else np.empty((0, 2), np.uint64)
        sums, undo = [], []
        for k, base in enumerate(BASES):
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(flat), base, np.uint64)], dtype=np.uint64)
            sums.append(np.r_[np.uint64(0), np.cumsum(scramble(hashed[:, k]) * power[:-1], dtype=np.uint64)])
            inverse = np.uint64(pow(base, -1, 1 << 64))
            undo.append(np.cumprod(np.r_[np.uint64(1), np.full(len(flat), inverse, np.uint64)], dtype=np.uint64))
        return cls(split, size, np.cumsum(size) - size, sums, undo)

    def digest(self, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        """One half of the digest of the words from ``start`` to ``stop`` (positions in the row)."""
        return scramble((self.sums[k][stop] - self.sums[k][start]) * self.undo[k][start])

    def nodes(self, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The node positions, their documents, the starts of all windows, and for each window the index of its node."""
        count = np.maximum(self.size - window + 1, 0)
        if not count.sum():
            none = np.empty(0, np.int64)
            return none, none, none, none
        starts = np.repeat(self.start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        total = int(self.size.sum())
        at = np.arange(total - kmer + 1)
        order = self.digest(at, at + kmer, 0)
        least = np.lib.stride_tricks.sliding_window_view(order, window - kmer + 1).argmin(axis=1)
        node = starts + least[starts]
        first = np.r_[True, node[1:] != node[:-1]]
        position = node[first]
        return position, np.repeat(np.arange(len(count)), count)[first], starts, np.cumsum(first) - 1


def _edges(words: Words, position: np.ndarray, doc: np.ndarray, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node hash, and the hashes of the edges to the next and from the previous node (0 at a document's ends)."""
    node = words.digest(position, position + kmer, 1)
    edge = words.digest(position[:-1], position[1:] + kmer, 0) | np.uint64(1)
    edge[doc[1:] != doc[:-1]] = 0
    return node, np.r_[edge, np.uint64(0)], np.r_[np.uint64(0), edge]


def _occurrences(keyed: DataFrame, window: int, kmer: int) -> DataFrame:
    """Every node of every document: its hash, place and the edges beside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                words = Words.of(part.column("text").to_pylist())
                position, doc, _, _ = words.nodes(window, kmer)
                if not len(position):
                    continue
                node, after, before = _edges(words, position, doc, kmer)
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(as_long(node)), part.column("doc_id").take(pick), part.column("tx").take(pick),
                    pa.array((position - words.start[doc]).astype(np.int32)), pa.array(as_long(after)), pa.array(as_long(before))],
                    names=["node", "doc_id", "tx", "pos", "after", "before"])

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"node long, doc_id {id_type}, tx long, pos int, after long, before long")


def _flags(keyed: DataFrame, window: int, kmer: int) -> DataFrame:
    """(doc_id, tx, marks): the positions of a document's repeated nodes, times four, plus 1
    if the node does not branch forward and 2 if it does not branch backward."""
    nodes = staged(_occurrences(keyed, window, kmer), "nodes", compression="zstd")
    counted = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # written out, so that the join below has a plain exchange on both sides and hot nodes can be split
    repeated = staged(counted.where("n > 1").select("node"), "repeated_nodes")
    places = staged(nodes.join(repeated, "node", "left_semi"), "places", compression="zstd")
    shape = staged(places.groupBy("node").agg((F.min("after") == F.max("after")).alias("one_after"), (F.min("before") == F.max("before")).alias("one_before")), "shapes")
    mark = F.col("pos").cast("long") * 4 + F.col("one_after").cast("long") + 2 * F.col("one_before").cast("long")
    return places.join(shape, "node").groupBy("doc_id", "tx").agg(F.collect_list(mark).alias("marks"))


def candidates(words: Words, marks: list[list[int] | None], window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start in it and length of each path and each single window to be counted."""
    position, doc, starts, node_of = words.nodes(window, kmer)
    repeated, one_after, one_before = (np.zeros(len(position), bool) for _ in range(3))
    for d, m in enumerate(marks):
        if m is not None and len(m):
            m = np.unique(np.asarray(m, np.int64))
            at = np.searchsorted(position, (m >> 2) + words.start[d])
            repeated[at] = True
            one_after[at], one_before[at] = (m & 1) > 0, (m & 2) > 0
    link = np.zeros(max(len(position) - 1, 0), bool)
    if len(position) > 1:
        link = (doc[1:] == doc[:-1]) & repeated[:-1] & repeated[1:] & one_after[:-1] & one_before[1:]
    # runs of linked nodes are paths; those of a window's length or more are counted as a whole
    head = np.flatnonzero(np.r_[True, ~link])[:len(position)]
    tail = np.r_[head[1:] - 1, len(position) - 1] if len(head) else head
    long = repeated[head] & (position[tail] + kmer - position[head] >= window)
    path_start, path_stop, path_doc = position[head[long]], position[tail[long]] + kmer, doc[head[long]]
    inside = np.zeros(len(starts), bool)
    if len(path_start):
        near = np.searchsorted(path_start, starts, "right") - 1
        inside = (near >= 0) & (starts + window <= path_stop[np.maximum(near, 0)]) & (starts >= path_start[np.maximum(near, 0)])
    single = repeated[node_of] & ~inside if len(starts) else inside
    s = starts[single]
    d = doc[node_of[single]]
    return np.r_[path_doc, d], np.r_[path_start, s], np.r_[path_stop - path_start, np.full(len(s), window)]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if it lies in a window whose words also start anywhere else, in
    any row. Kept words are joined by one space. Texts that are null, empty or
    shorter than a window lose nothing. Rows that repeat are places of their
    own, so both lose what they share. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tx"), text_bytes(text_col))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    flags = staged(_flags(keyed, window, kmer), "flags").select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), "marks")
    marked = keyed.join(flags, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t")), "left").select("doc_id", "tx", "text", "marks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                texts, marks = part.column("text").to_pylist(), part.column("marks").to_pylist()
                open_ = [m is not None for m in marks]
                words = Words.of([t if o else None for t, o in zip(texts, open_)])
                doc, start, length = candidates(words, marks, window, kmer)
                by = np.argsort(doc, kind="stable")
                doc, start, length = doc[by], start[by], length[by]
                halves = [pa.array(as_long(words.digest(start, start + length, k))) for k in (0, 1)]
                spans = pa.StructArray.from_arrays([*halves, pa.array((start - words.start[doc]).astype(np.int32)), pa.array(length.astype(np.int32))], ["h1", "h2", "start", "length"])
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
                done = [None if o else (t.split() if t else []) for t, o in zip(texts, open_)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("tx"),
                    pa.array([None if w is None else len(w) for w in done], pa.int64()),
                    pa.array([None if w is None else _digest(w) for w in done], pa.string()),
                    pa.array([t if o or with_text else None for t, o in zip(texts, open_)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), spans)], names=["doc_id", "tx", "n_words", "kept_sha256", "text", "spans"])

    state = staged(marked.mapInArrow(find, f"doc_id {id_type}, tx long, n_words long, kept_sha256 string, text binary, "
                                           "spans array<struct<h1: long, h2: long, start: int, length: int>>"), "spans", compression="zstd")
    rows = state.where("size(spans) > 0").select("doc_id", "tx", F.explode("spans").alias("s")).select("doc_id", "tx", "s.*")
    # each row of the input counts, also rows that repeat
    twice = staged(rows.groupBy("h1", "h2", "length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "length"), "repeated")
    gone = (rows.join(twice, ["h1", "h2", "length"], "left_semi").groupBy("doc_id", "tx")
            .agg(F.collect_set(F.col("start").cast("long") * (1 << 32) + F.col("length")).alias("cuts"))
            .select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), "cuts"))
    pending = state.where("kept_sha256 is null").select("doc_id", "tx", "text")
    pending = pending.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t")), "left").select("doc_id", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                n, removed, digests, kept_texts = [], [], [], []
                for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist()):
                    words = text.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for c in cuts or ():
                        edge[c >> 32] += 1
                        edge[(c >> 32) + (c & 0xFFFFFFFF)] -= 1
                    kept = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    digests.append(_digest(kept))
                    kept_texts.append(b" ".join(kept).decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    found = pending.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    settled = state.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", plain.alias("kept_text"))
    both = settled.unionByName(found)
    return both if with_text else both.drop("kept_text")
