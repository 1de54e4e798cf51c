"""Token alignment of two tokenizers over the same bytes, with corpus-wide counts of the linked ids.

A is a byte-level vocabulary, B a vocabulary of pieces with a leading space.
Every place where a token of A and a token of B both end closes a group. Inside
a group, the tokens whose byte ranges overlap are linked.

Most groups are one token of A and the token of B with the same bytes. The map
from A's ids to these ids of B is made once from the two vocabularies, and such
groups are counted in a vector as long as A's vocabulary, one for each task.
Only the links of other groups are counted as pairs:

1. texts are encoded in blocks of about one megabyte. A block is one row of a
   written table: its documents, what each of them has of A's ids in exact groups, and
   the other links as places in the block's own list of distinct pairs;
2. the vectors and the lists are summed up. The pairs' counts go back to the
   blocks that list them, so a pair that every document has travels once for a block;
3. each block works out the sums of its documents.

The vectors and the best count of each id of B have at most as many entries as
the vocabularies; nothing else reaches the driver or is broadcast.

Null and empty texts have no tokens, nor has a text that is not valid UTF-8 or
whose joined tokens differ from a space and the text. Such rows have zeros and an
empty digest. Rows that repeat are rows of their own and count each. A text is
handled whole, in some forty times its size of memory in one task. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidewater.llm.bpe import encoder, gather, shared_file
from tidewater.llm.common import slices
from tidewater.session import staged

#: Bytes of text in a block, about.
BLOCK_BYTES = 1 << 20
#: How pieces write a space and a byte.
SPACE_SIGN = "▁"


def without_added(content: bytes) -> bytes:
    """The tokenizer file without its added tokens, so that their strings are plain text."""
    spec = json.loads(content)
    for token in spec["added_tokens"]:
        spec["model"]["vocab"].pop(token["content"], None)
    spec["added_tokens"], spec["post_processor"] = [], None
    return json.dumps(spec).encode()


def _blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in a row, where each starts, and how long it is."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


class Aligner:
    """Both tokenizers of one Python worker, and the map between their ids."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a = encoder(without_added(byte_file))
        self.b = SentencePieceProcessor(model_proto=piece_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.pieces = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_SIGN, " ").encode() for p, byte in zip(pieces, is_byte)]
        # the id that spells the bytes as a piece comes before the one that stands for a lone byte
        self.b_of = {p: i for i, p in enumerate(self.pieces) if is_byte[i]} | {p: i for i, p in enumerate(self.pieces) if not is_byte[i]}
        self.same = np.full(self.a.size, -1)
        for token, i in self.a.id_of.items():
            self.same[i] = self.b_of.get(token, -1)
        self.n_a, self.n_b = self.a.size, len(pieces)
        self.b_blob, self.b_starts, self.b_sizes = _blob(self.pieces)
        ids = max(self.n_a, self.n_b)
        self.ids = ids
        self.words = _blob([b"%d%c" % (i, c) for c in b",|;" for i in range(ids)])  # an id and what comes after it

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all texts in a row and their number in each text, the same for B; none
        for texts whose tokens do not spell a space and the text."""
        texts = pc.fill_null(texts, b"").cast(pa.large_binary())
        raw = [t.as_py() for t in texts]
        read = [t.decode("utf-8", "replace") for t in raw]
        good = np.array([bool(r) and s.encode() == r for r, s in zip(raw, read)], bool)
        spaced = pa.array([b" " + r if g else b"" for r, g in zip(raw, good)], pa.large_binary())
        a, n_a = self.a.encode(spaced)
        a = a.astype(np.int64)
        found = self.b.encode([s if g else "" for s, g in zip(read, good)], num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter((i for x in found for i in x), np.int64, int(n_b.sum()))
        size = np.fromiter((len(r) + 1 if g else 0 for r, g in zip(raw, good)), np.int64, len(raw))
        whole = np.frombuffer(b"".join(spaced.to_pylist()), np.uint8)
        good &= _spells(whole, size, a, n_a, self.a.byte_blob, self.a.byte_starts, self.a.byte_sizes)
        good &= _spells(whole, size, b, n_b, self.b_blob, self.b_starts, self.b_sizes)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        return a, n_a, b, n_b

    def align(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Links and groups of the texts of a block; a link is a run of bytes within one token of A and one of B."""
        a, n_a, b, n_b = self.encode(texts)
        end_a, end_b = np.cumsum(self.a.byte_sizes[a]), np.cumsum(self.b_sizes[b])
        total = int(end_a[-1]) if len(end_a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        ends = np.flatnonzero(is_a | is_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        close = (is_a & is_b)[ends]  # the run that ends here closes its group
        group = np.cumsum(close) - close
        runs = np.bincount(group, minlength=int(close.sum()))
        doc_ends = np.r_[0, end_a][np.cumsum(n_a)]
        doc = np.searchsorted(doc_ends, ends)
        of_a, of_b = a[in_a], b[in_b]
        exact = (runs[group] == 1) & (self.same[of_a] == of_b)
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[in_a], group_b[in_b] = group, group
        return {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "doc": doc, "of_a": of_a, "of_b": of_b, "exact": exact,
                "n_groups": np.bincount(doc[close], minlength=len(n_a)), "n_links": np.bincount(doc, minlength=len(n_a)),
                "group_a": group_a, "group_b": group_b}

    def spelled(self, found: dict[str, np.ndarray]) -> list[bytes]:
        """Each document's groups as text: ``a1,a2|b1;a3|b2,b3``."""
        ga, gb, n_groups = found["group_a"], found["group_b"], int(found["n_groups"].sum())
        if not n_groups:
            return [b""] * len(found["n_a"])
        per_a, per_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        place_a = np.arange(len(ga)) + (np.cumsum(per_b) - per_b)[ga]
        place_b = np.arange(len(gb)) + np.cumsum(per_a)[gb]
        word = np.empty(len(ga) + len(gb), np.int64)
        word[place_a] = found["a"] + self.ids * np.r_[ga[1:] != ga[:-1], True]
        word[place_b] = found["b"] + 2 * self.ids * np.r_[gb[1:] != gb[:-1], True]
        blob, starts, sizes = self.words
        whole = gather(blob, starts[word], sizes[word]).tobytes()
        ends = np.r_[0, np.cumsum(sizes[word])][np.cumsum(found["n_a"] + found["n_b"])].tolist()
        return [whole[x:y][:-1] for x, y in zip([0, *ends], ends)]


def _spells(whole: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``n`` ids, whether its bytes are the run of ``size`` bytes of ``whole``."""
    got = np.diff(np.r_[0, np.r_[0, np.cumsum(sizes[ids])][np.cumsum(n)]])
    fits = got == size
    left = whole[np.repeat(fits, size)]
    right = gather(blob, starts[ids], sizes[ids])[np.repeat(fits, got)]
    wrong = np.r_[0, np.cumsum(left != right)]
    at = np.cumsum(np.where(fits, size, 0))
    return fits & (wrong[at] == wrong[np.r_[0, at[:-1]]] if len(at) else fits)


_aligners: dict[str, Aligner] = {}


def aligner(byte_file: bytes, piece_file: bytes) -> Aligner:
    """The aligner of this Python process for two tokenizer files."""
    key = hashlib.sha256(byte_file).hexdigest() + hashlib.sha256(piece_file).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(byte_file, piece_file)
    return _aligners[key]


def _counted(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``key``s as (key // width, key % width, how often)."""
    distinct, times = np.unique(key, return_counts=True)
    return distinct // max(width, 1), distinct % max(width, 1), times


BLOCK_DDL = ("block long, docs array<{id}>, stats binary, groups array<string>, one_doc binary, one_id binary, one_n binary, "
             "link_doc binary, link_at binary, link_n binary, pairs array<long>, pair_n array<long>, ids array<int>, id_n array<long>")


def _blocks(docs: DataFrame, files: tuple[Broadcast, Broadcast], id_col: str, text_col: str, digest: bool) -> DataFrame:
    """The written table of blocks, and a row of A's ids in exact groups (``ids``, ``id_n``) for each task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in BLOCK_DDL.split(", ")]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewater.llm.align import aligner  # the module of the worker, which keeps its tables between tasks
        both = aligner(files[0].value, files[1].value)
        task, block = TaskContext.get().partitionId(), 0
        vector = np.zeros(both.n_a, np.int64)
        id_type = None
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for part in slices(whole, "text", BLOCK_BYTES):
                f = both.align(part.column("text"))
                spelled = both.spelled(f)
                shown = [hashlib.sha256(s).hexdigest() if s else "" for s in spelled] if digest else [s.decode() for s in spelled]
                exact, pair = f["exact"], f["of_a"] * both.n_b + f["of_b"]
                vector += np.bincount(f["of_a"][exact], minlength=both.n_a)
                one_doc, one_id, one_n = _counted(f["doc"][exact] * both.n_a + f["of_a"][exact], both.n_a)
                pairs, at, pair_n = np.unique(pair[~exact], return_inverse=True, return_counts=True)
                link_doc, link_at, link_n = _counted(f["doc"][~exact] * len(pairs) + at, len(pairs))
                packed = [x.astype("<i4").tobytes() for x in (one_doc, one_id, one_n, link_doc, link_at, link_n)]
                stats = np.stack([f["n_a"], f["n_b"], f["n_groups"], f["n_links"]]).astype("<i8").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + block], pa.int64()), ids, pa.array([stats]), pa.array([shown], pa.list_(pa.string())),
                     *[pa.array([x], pa.binary()) for x in packed], pa.array([pairs], longs), pa.array([pair_n], longs),
                     pa.array([None], ints), pa.array([None], longs)], names=names)
                block += 1
        used = np.flatnonzero(vector)
        if len(used):
            none = [pa.array([None], t) for t in (pa.int64(), pa.list_(id_type), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 6, longs, longs)]
            yield pa.RecordBatch.from_arrays([*none, pa.array([used.astype(np.int32)], ints), pa.array([vector[used]], longs)], names=names)

    return staged(rows.mapInArrow(run, BLOCK_DDL.format(id=kind)), "blocks", compression="zstd")


def _totals(blocks: DataFrame, same: np.ndarray, n_b: int) -> DataFrame:
    """(pair, n, top, exact): the corpus-wide count of each linked pair, whether it is the
    highest of its id of B, and whether exact groups have it; a pair is ``a * n_b + b``."""
    spark = blocks.sparkSession
    sums = blocks.where("ids is not null").select(F.explode(F.arrays_zip("ids", "id_n")).alias("x")).groupBy("x.ids").agg(F.sum("x.id_n").alias("n"))
    vector = [(int(i) * n_b + int(same[i]), int(n), True) for i, n in sums.collect()]  # at most one row for each id of A
    exact = spark.createDataFrame(vector, "pair long, n long, exact boolean")
    others = (blocks.where("block is not null").select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pair_n").alias("n")).withColumn("exact", F.lit(False)))
    total = staged(exact.unionByName(others).groupBy("pair").agg(F.sum("n").alias("n"), F.max("exact").alias("exact")), "counts")
    best = total.groupBy(F.expr(f"pair % {n_b}").alias("b")).agg(F.max("n").alias("most"))  # at most one row for each id of B
    marked = total.join(F.broadcast(best), F.expr(f"pair % {n_b}") == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"), "exact")
    return staged(marked, "marked")


def alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
              digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tokenizers' alignment of every row, and the counts of all linked pairs.

    The first table has one row per input row: doc_id, n_a, n_b, n_groups, n_links,
    n_best (links whose pair is the most frequent one of its id of B, ties
    included), count_sum (the pairs' counts, summed over the links) and groups (as text; with
    ``digest`` its SHA-256 as groups_sha256, empty without tokens). The second one
    has a_id, b_id, n. See the module's text for nulls and other special rows.
    """
    files = (shared_file(docs, byte_path), shared_file(docs, piece_path))
    local = aligner(files[0].value, files[1].value)
    n_a, n_b = local.n_a, local.n_b
    blocks = _blocks(docs, files, id_col, text_col, digest)
    marked = _totals(blocks, local.same, n_b)
    counts, tops = np.zeros(n_a, np.int64), np.zeros(n_a, bool)
    for pair, n, top in marked.where("exact").select("pair", "n", "top").collect():  # at most one row for each id of A
        counts[pair // n_b], tops[pair // n_b] = n, top
    vectors = docs.sparkSession.sparkContext.broadcast((counts, tops))

    real = blocks.where("block is not null").drop("ids", "id_n", "pair_n")
    listed = real.select("block", F.posexplode("pairs").alias("at", "pair")).join(marked.select("pair", "n", "top"), "pair")
    back = (listed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "top"))).alias("x"))
            .select("block", F.col("x.n").alias("known"), F.col("x.top").alias("known_top")))
    both = real.drop("pairs").join(back, "block", "left").drop("block")
    kind = docs.schema[id_col].dataType.simpleString()
    last = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, one_tops = vectors.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                one_doc, one_id, one_n, link_doc, link_at, link_n = (
                    np.frombuffer(row[c].as_py(), "<i4").astype(np.int64) for c in ("one_doc", "one_id", "one_n", "link_doc", "link_at", "link_n"))
                stats = np.frombuffer(row["stats"].as_py(), "<i8").reshape(4, -1)
                size = stats.shape[1]
                known = row["known"].values.to_numpy() if row["known"].is_valid else np.empty(0, np.int64)
                known_top = row["known_top"].values.to_numpy(zero_copy_only=False).astype(bool) if row["known_top"].is_valid else np.empty(0, bool)
                total = _sums(one_doc, one_n * ones[one_id], size) + _sums(link_doc, link_n * known[link_at], size)
                best = _sums(one_doc, one_n * one_tops[one_id], size) + _sums(link_doc, link_n * known_top[link_at], size)
                yield pa.RecordBatch.from_arrays(
                    [row["docs"].values, *[pa.array(x) for x in stats], pa.array(best), pa.array(total), row["groups"].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last])

    result = both.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string")
    return result, marked.select(F.expr(f"cast(pair div {n_b} as int)").alias("a_id"), F.expr(f"cast(pair % {n_b} as int)").alias("b_id"), "n")


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the values at each of ``size`` places, exact in 64 bits; ``at`` rises."""
    total = np.r_[0, np.cumsum(values.astype(np.int64))]
    cut = np.searchsorted(at, np.arange(size + 1))
    return total[cut[1:]] - total[cut[:-1]]
