"""Word pairs of sliding windows as a symmetric matrix in tiles, and its product with a vector.

Tokens lie in chunks of whole documents, as places in the chunk's own list of words, so only that list is joined
to the words' numbers. A word's number is a block and a place in it. Each pair of blocks is a tile: the pairs of
all chunks meet there and are summed, and a tile is kept as packed rows, columns and weights.
Every pair is kept once, and serves both directions. A product takes a tile's two blocks of the vector to it and
adds up what comes back for each block, so a task holds one tile and two blocks, and a product shuffles the tiles and
the vector times the number of blocks, which grows with the square root of the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a chunk (more if one document has more), and pairs that a tile should get.
CHUNK, TILE = 1 << 20, 1 << 22
CHUNKS = "chunk long, n long, lens binary, codes binary, words array<string>"
TILES = "lo int, hi int, pairs binary"


def chunked(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(chunk, n, lens, codes, words): the tokens of whole documents as places in ``words``, and how many each document has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(0)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
            ends, at = np.cumsum(lens), 0
            while at < len(lens):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                flat = lists.slice(at, to - at).flatten()
                if len(flat):
                    coded = flat.dictionary_encode(null_encoding="encode")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk]), pa.array([len(flat)]), *(pa.array([squeezed(x)], pa.binary()) for x in (lens[at:to], coded.indices.to_numpy())),
                        pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))],
                        names=["chunk", "n", "lens", "codes", "words"])
                    chunk += 1
                at = to
    return docs.select(tokens).mapInArrow(run, CHUNKS)


def blocks_for(chunks: DataFrame, window: int) -> int:
    """How many blocks of words give tiles of about ``TILE`` pairs."""
    pairs = (window - 1) * (chunks.agg(F.sum("n")).first()[0] or 0)
    return max(1, math.ceil(math.sqrt(2 * pairs / TILE)))


def numbered(chunks: DataFrame, blocks: int) -> DataFrame:
    """(word, b, at): each word's block and its place there."""
    words = chunks.select(F.explode("words").alias("word")).distinct().withColumn("b", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
    return words.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy("word")) - 1)


def window_pairs(chunks: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """(lo, hi, pairs): the tiles. A pair of words at positions (p, p + d) of a document of L tokens counts once for each
    window start s with max(0, p + d - window + 1) <= s <= min(p, L - window)."""
    lists = chunks.select(F.col("chunk").alias("home"), F.posexplode("words").alias("code", "of"))
    names = lists.join(words, F.col("of").eqNullSafe(F.col("word"))).select(
        "home", "code", F.when(F.col("word").isNotNull(), F.shiftleft(F.col("b").cast("long"), 32) + F.col("at")).otherwise(-1).alias("id"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _empty()
        lens, codes = (plain(left[c][0].as_buffer()) for c in ("lens", "codes"))
        ids = np.empty(right.num_rows, "int64")
        ids[right["code"].to_numpy()] = right["id"].to_numpy()
        return _pieces(lens, codes, ids, window)

    def merged(table: pa.Table) -> pa.Table:
        i, j, w = (np.concatenate(x) for x in zip(*[unpacked(p) for p in table["pairs"]]))
        key, w = _summed((i << 32) | j, w)
        return _tiles(table["lo"].to_numpy()[:1], table["hi"].to_numpy()[:1], [packed(key >> 32, key & 0xFFFFFFFF, w)])
    pieces = chunks.select("chunk", "lens", "codes").groupBy("chunk").cogroup(names.groupBy("home")).applyInArrow(run, TILES)
    return pieces.groupBy("lo", "hi").applyInArrow(merged, TILES)


def product(edges: DataFrame, vector: DataFrame, blocks: int) -> DataFrame:
    """(b, other, s): what each tile adds to block b of the product with ``vector`` (b, x), x being the doubles of a block."""
    ends = vector.select("b", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "b", "x")

    def run(tile: pa.Table, given: pa.Table) -> pa.Table:
        out: dict[tuple[int, int], np.ndarray] = {}
        if tile.num_rows:
            x = {b: np.frombuffer(v.as_buffer()) for b, v in zip(given["b"].to_pylist(), given["x"])}
            lo, hi = tile["lo"][0].as_py(), tile["hi"][0].as_py()
            i, j, w = unpacked(tile["pairs"][0])
            out[lo, hi] = np.bincount(i, w * x[hi][j], len(x[lo]))
            back = np.bincount(j, w * x[lo][i], len(x[hi]))
            out[hi, lo] = out[lo, hi] + back if lo == hi else back
        return pa.Table.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int32()),
                                     pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["b", "other", "s"])
    return edges.groupBy("lo", "hi").cogroup(ends.groupBy("lo", "hi")).applyInArrow(run, "b int, other int, s binary")


def added(table: pa.Table, n: int) -> np.ndarray:
    """The sum of a block's parts ``s`` from ``product``, in the order of the other blocks."""
    parts = sorted(((o, v) for o, v in zip(table["other"].to_pylist(), table["s"]) if v.is_valid), key=lambda p: p[0])
    total = np.zeros(n)
    for _, v in parts:
        total += np.frombuffer(v.as_buffer())
    return total


def _pieces(lens: np.ndarray, codes: np.ndarray, ids: np.ndarray, window: int) -> pa.Table:
    """The pairs of one chunk, summed and cut by tile. ``ids``: block and place of each code, -1 for a null."""
    order = np.argsort(ids)
    ids, rank = ids[order], np.empty(len(ids), "int64")
    rank[order] = np.arange(len(ids))
    long_ = np.repeat(lens >= window, lens)
    size, first = np.repeat(lens, lens)[long_], np.repeat(np.cumsum(lens) - lens, lens)[long_]
    at, r = np.flatnonzero(long_) - first, rank[codes[long_]]
    real = ids[r] >= 0
    keys, weights = [np.empty(0, "int64")], [np.empty(0, "int64")]
    for d in range(1, window):
        ok = (first[d:] == first[:-d]) & real[d:] & real[:-d]
        p, n, a, b = at[:-d][ok], size[:-d][ok], r[:-d][ok], r[d:][ok]
        keys.append(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        weights.append(np.minimum(p, n - window) - np.maximum(0, p + d - (window - 1)) + 1)
    key, w = _summed(np.concatenate(keys), np.concatenate(weights))
    if not len(key):
        return _empty()
    i, j = ids[key // len(ids)], ids[key % len(ids)]
    tile = (i >> 32 << 32) | (j >> 32)
    kinds, which = np.unique(tile, return_inverse=True)
    by = np.argsort(which.astype(np.min_scalar_type(len(kinds))), kind="stable")
    i, j, w, tile = (i & 0xFFFFFFFF)[by], (j & 0xFFFFFFFF)[by], w[by], tile[by]
    cuts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)]
    return _tiles(tile[cuts[:-1]] >> 32, tile[cuts[:-1]] & 0xFFFFFFFF, [packed(i[a:b], j[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0, in their smallest type, byte by byte, so that the many high bytes that are 0 take next to nothing, and compressed."""
    x = x.astype(np.min_scalar_type(int(x.max())))
    raw = pa.compress(x.view("u1").reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True)
    return np.array([x.itemsize, len(x), len(raw)]).tobytes() + raw


def plain(buf: pa.Buffer) -> np.ndarray:
    """The numbers of the first list in ``buf`` as long integers."""
    kind, n, size = np.frombuffer(buf.slice(0, 24), "int64").tolist()
    raw = np.frombuffer(pa.decompress(buf.slice(24, size), n * kind, "zstd"), "u1")
    return np.ascontiguousarray(raw.reshape(kind, n).T).view(f"u{kind}").reshape(n).astype("int64")


def packed(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> bytes:
    """Pairs that are ordered by i: the steps from row to row, the pairs of each row, columns and weights."""
    rows, many = np.unique(i, return_counts=True)
    return b"".join(map(squeezed, (np.diff(rows, prepend=0), many, j, w)))


def unpacked(pairs: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, w) as long integers."""
    buf, out = pairs.as_buffer(), []
    for _ in range(4):
        out.append(plain(buf))
        buf = buf.slice(24 + int(np.frombuffer(buf.slice(16, 8), "int64")[0]))
    steps, many, j, w = out
    return np.repeat(np.cumsum(steps), many), j, w


def _tiles(lo: np.ndarray, hi: np.ndarray, pairs: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(lo.astype("int32")), pa.array(hi.astype("int32")), pa.array(pairs, pa.binary())], names=["lo", "hi", "pairs"])


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its weights."""
    if not len(key):
        return key, w
    order = np.argsort(key)
    key = key[order]
    starts = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
    return key[starts], np.add.reduceat(w[order], starts)


def _empty() -> pa.Table:
    return _tiles(np.empty(0), np.empty(0), [])
