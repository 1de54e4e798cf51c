"""Token ids in files, as length-limited canonical Huffman codes.

The format is a folder with two Parquet tables:

* ``codebook``: (id, length), the code length of each id that occurs, from its
  count in the whole corpus. Codes are canonical: by length, then by id.
* ``blocks``: rows in ascending document order, cut into parts. A block holds up
  to ``BLOCK`` ids of one document as a byte-aligned bit stream, with the bit
  offset of every ``STRIDE``-th id, so a block is read without any other one and
  each stride of it without the ids before.

Decoding looks up the next ``LIMIT`` bits in a table that has the id and the
code length, for all strides of a batch side by side.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.bpe import Encoder, gather, runs, shared_file
from tidewater.llm.common import slices, text_bytes
from tidewater.session import shared_dir, staged

#: Longest code in bits, ids of a block, ids between two bit offsets, and ids of a part.
LIMIT, BLOCK, STRIDE, PART_IDS = 20, 1 << 16, 256, 1 << 24


class ExactEncoder(Encoder):
    """The library's ids by exact merging of all new pieces side by side. The library
    itself takes about two microseconds a token here, several times as much; tests
    hold the ids against it."""

    def tokens_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.exact(pieces)


_encoders: dict[int, ExactEncoder] = {}


def exact_encoder(content: bytes) -> ExactEncoder:
    key = zlib.crc32(content)
    if key not in _encoders:
        _encoders[key] = ExactEncoder(content)
    return _encoders[key]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size with none over ``limit`` (package-merge); all counts are positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = row[:len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        single = int(flags[:take].sum())
        lengths[:single] += 1
        take = 2 * (take - single)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids and their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        # the first LIMIT bits of each code, as a number; codes follow each other without a gap
        span = np.int64(1) << (LIMIT - self.lengths)
        begin = np.cumsum(span) - span
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.bits, self.length_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.bits[self.ids], self.length_of[self.ids] = begin, self.lengths
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        self.span = span

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            full = lambda x: np.concatenate([np.repeat(x, self.span), np.zeros((1 << LIMIT) - int(self.span.sum()), x.dtype)])
            self._table = full(self.ids.astype(np.int32)), full(self.lengths.astype(np.int32))
        return self._table

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Blocks of these sizes: their bytes in a row, the bytes of each, and for each id its bit offset in its block."""
        length = self.length_of[ids]
        ends = np.cumsum(sizes)
        bit_ends = np.r_[0, np.cumsum(length)]
        first = bit_ends[ends - sizes]
        block_bytes = (bit_ends[ends] - first + 7) // 8
        block_start = np.cumsum(block_bytes) - block_bytes
        inside = bit_ends[:-1] - np.repeat(first, sizes)
        at = inside + np.repeat(8 * block_start, sizes)
        byte, shift = at >> 3, at & 7
        window = (self.bits[ids] << (32 - LIMIT)) >> shift
        total = int(block_bytes.sum())
        out = np.zeros(total + 4, np.int64)
        for k in range(4):  # the bits of different ids do not overlap, so sums are unions
            out += np.bincount(byte + k, weights=(window >> (24 - 8 * k)) & 255, minlength=total + 4).astype(np.int64)[:total + 4]
        return out[:total].astype(np.uint8).tobytes(), block_bytes, inside

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of runs that begin at these bits of ``data`` and have so many ids, in a row."""
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        ids, lengths = self.table
        out = np.empty(int(counts.sum()), np.uint32)
        place = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, place, sorted_counts = starts[order].astype(np.int64), place[order], counts[order]
        alive = np.searchsorted(-sorted_counts, -np.arange(1, int(counts.max(initial=0)) + 1), "right")
        for k, n in enumerate(alive.tolist()):
            head = at[:n]
            entry = (window[head >> 3] << (head & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[place[:n] + k] = ids[entry]
            at[:n] += lengths[entry]
        return out


def crc32_concat(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two strings in a row from their CRC-32s and the second one's length:
    ``a`` moves on by as many zero bits, a linear map that is squared bit by bit."""
    def apply(matrix: list[int], v: int) -> int:
        out = 0
        for row in matrix:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    bits = 8 * b_bytes
    while bits:
        if bits & 1:
            a = apply(step, a)
        step = [apply(step, row) for row in step]
        bits >>= 1
    return a ^ b


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, row, n, ids) in the shared folder, ids as little-endian 32-bit integers with the end id."""
    file = shared_file(docs, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewater.llm.binary import exact_encoder
        e = exact_encoder(file.value)
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                ids, n = e.encode(part.column("text"))
                end = np.uint32(end_id).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n + 1), pa.array([x + end for x in runs(ids, n)], pa.binary())], names=["doc_id", "n", "ids"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids binary")
    # the row number is written with the row, so it stays the same for all that follows
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "tokens", compression="zstd")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                got = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4"))
                if len(got) > len(counts):
                    counts, got = got, counts
                counts[:len(got)] += got
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode the texts as the library does and write their ids, each document's followed by
    ``end_id``, under ``out``, documents in ascending id order (null last; rows that
    repeat an id follow each other). Null counts as empty."""
    spark = docs.sparkSession
    tokens = tokenised(docs, path, id_col, text_col, end_id)
    counts = id_counts(tokens).collect()  # a row for each id of the vocabulary at most
    ids, n = np.array([r["id"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length int").coalesce(1).write.parquet(f"{out}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))
    # borders between parts: quantiles of a sample of (id, row) whose size follows the number of parts
    parts = max(spark.sparkContext.defaultParallelism, int(n.sum()) // PART_IDS + 1)
    rows = tokens.count()
    sample = tokens.select("doc_id", "row").sample(min(1.0, 64 * parts / max(1, rows)), seed=1).collect()
    key = lambda doc_id, row: (doc_id is None, 0 if doc_id is None else doc_id, row)
    keys = sorted(key(r["doc_id"], r["row"]) for r in sample)
    borders = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*book.value)
        for whole in batches:
            for batch in slices(whole, "ids", 2 << 20):
                flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4").astype(np.int64)
                count = batch.column("n").to_numpy()
                pieces = -(-count // BLOCK)
                of = np.repeat(np.arange(len(count)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(BLOCK, count[of] - piece * BLOCK)
                data, block_bytes, at = code.encode(flat, size)
                ends = np.cumsum(block_bytes).tolist()
                starts = np.cumsum(size) - size
                marks = -(-size // STRIDE)
                mark_of = np.repeat(np.arange(len(size)), marks)
                nth = np.arange(len(mark_of)) - np.repeat(np.cumsum(marks) - marks, marks)
                offsets = at[starts[mark_of] + STRIDE * nth].astype("<u4").tobytes()
                mark_ends = (4 * np.cumsum(marks)).tolist()
                doc_ids, row_ids = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
                part = np.array([bisect.bisect_right(borders, key(d, r)) for d, r in zip(doc_ids, row_ids)], np.int32)
                pick = pa.array(of)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[of]), batch.column("doc_id").take(pick), batch.column("row").take(pick), pa.array(piece.astype(np.int32)),
                    pa.array(pieces[of].astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
                    pa.array([offsets[a:b] for a, b in zip([0, *mark_ends], mark_ends)], pa.binary()),
                ], names=["part", "doc_id", "row", "piece", "pieces", "n", "bits", "offsets"])

    blocks = tokens.mapInArrow(run, f"part int, doc_id {id_type}, row long, piece int, pieces int, n int, bits binary, offsets binary")
    ordered = blocks.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "row", "piece")
    ordered.write.option("compression", "none").parquet(f"{out}/blocks")


def read_blocks(spark: SparkSession, out: str, columns: dict[str, pa.DataType], ddl: str, finish) -> DataFrame:
    """Decode every block; ``finish`` gets the ids of a batch and the number of each block's."""
    book = spark.read.parquet(f"{out}/codebook").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in book], np.int64), np.array([r["length"] for r in book], np.int64)))
    blocks = spark.read.parquet(f"{out}/blocks")
    keep = ["part", "doc_id", "row", "piece", "pieces", "n"]
    keep_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for whole in batches:
            for batch in slices(whole, "bits", 1 << 20):
                data = batch.column("bits").to_pylist()
                size = np.fromiter(map(len, data), np.int64, len(data))
                n = batch.column("n").to_numpy().astype(np.int64)
                marks = -(-n // STRIDE)
                of = np.repeat(np.arange(len(n)), marks)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(marks) - marks, marks)
                bit = np.frombuffer(b"".join(batch.column("offsets").to_pylist()), "<u4").astype(np.int64)
                ids = code.decode(b"".join(data), 8 * (np.cumsum(size) - size)[of] + bit, np.minimum(STRIDE, n[of] - STRIDE * nth))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x, t) for x, t in zip(finish(ids, n), columns.values())]], names=[*keep, *columns])

    return blocks.select(*keep, "bits", "offsets").mapInArrow(run, f"{keep_ddl}, {ddl}")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(part, doc_id, row, piece, pieces, n, ids) of every block, ids as little-endian 32-bit integers."""
    return read_blocks(spark, out, {"ids": pa.binary()}, "ids binary", lambda ids, n: [runs(ids, n)])


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32."""
    found = read_blocks(spark, out, {"crc": pa.int64()}, "crc long", lambda ids, n: [[zlib.crc32(x) for x in runs(ids, n)]])
    one = found.where("pieces = 1").select("part", "doc_id", "row", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    @F.udf("long")
    def joined(blocks):
        crc = 0
        for b in blocks:
            crc = crc32_concat(crc, b["crc"], 4 * b["n"])
        return crc

    many = (found.where("pieces > 1").groupBy("part", "doc_id", "row")
            .agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "crc", "n"))).alias("blocks"))
            .select("part", "doc_id", "row", F.col("n_tokens").cast("long").alias("n_tokens"), joined("blocks").alias("ids_crc32")))
    docs = one.unionByName(many)
    blocks = spark.read.parquet(f"{out}/blocks")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (docs.withColumn("inside", inside).join(before, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewater/{uuid.uuid4().hex}/ids"
