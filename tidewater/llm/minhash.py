"""Near-duplicate documents by circulant MinHash.

A document's shingles are hashed to 32-bit places. One permutation scatters the
places; a second one, shifted circularly by 0, 1, 2, ..., gives all coordinates
of the signature. Bands of five coordinates are buckets. Two documents with a
Jaccard similarity of 0.8 share none of the 36 buckets with a probability of
about (1 - 0.8^5)^36 = 6e-7.

Documents with the same set are one class from the start, so copies cost
nothing further. Pairs within a bucket are never listed as a whole:

1. every class is compared with the first class of each of its buckets, on
   their full sets; linked classes form components;
2. of the buckets whose members still lie in several components, those of up to
   256 classes are cells: their classes are compared with each other in one task, set
   against set, and at most one link a class leaves it. Buckets with the same classes are one
   cell, so a class is in 36 cells at most;
3. larger buckets are crowds. Each class of a crowd has a home in one of its blocks
   of about 256, those of a bucket's largest component apart from the others, and blocks that
   share a crowded bucket are compared;
4. a crowd of more than 65,536 classes is split by further coordinates of the
   circulant signature: its classes get new bands, five coordinates longer, of which there are as
   many as give the same bound, and steps 1 to 4 are done on these. Documents less
   similar than 0.8 part from each other faster than those above.

A pair is skipped only if both are in one component already, or if the larger
set is more than 1.25 times the smaller one, which rules out the similarity. So
every link between different texts that share a bucket is found or implied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD_PATTERN, as_long, scramble, slices, word_hashes
from tidewater.llm.graph import components
from tidewater.session import staged

#: Words of a shingle and the similarity of a link in percent, unless a contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Bands and coordinates of a band.
BANDS, ROWS = 36, 5
#: Classes and shingles of a cell or block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 18
#: Classes of a crowd that is compared block by block, and the coordinates by which the bands of a larger one grow.
CROWD, LONGER = 1 << 16, 5


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. A-Z are lower-cased. A
    text with fewer words is one shingle; one without words has none."""
    split = [t.lower().split() if t else [] for t in texts]
    hashed = scramble(word_hashes([w for ws in split for w in ws])[:, 0]) if any(split) else np.empty(0, np.uint64)
    out, start = [], 0
    for n in map(len, split):
        h = hashed[start:start + n]
        start += n
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        size = min(n, width)
        total = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            total = scramble(total + h[k:n - size + 1 + k])
        out.append(np.unique(total))
    return out


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit places."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int, shift: int = 0) -> np.ndarray:
    """(sets, size) coordinates: for shift k the least of permute(place + k) over the set; sets are not empty."""
    out = np.empty((len(sets), size), np.uint32)
    first = 0
    while first < len(sets):  # pieces that stay in the processor's cache
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 1 << 15):
            total += len(sets[last])
            last += 1
        place = scatter(np.concatenate(sets[first:last]).astype(np.uint32))
        starts = np.cumsum([0, *map(len, sets[first:last - 1])])
        for k in range(size):
            out[first:last, k] = np.minimum.reduceat(permute(place + np.uint32(shift + k)), starts)
        first = last
    return out


def bands_for(rows: int, percent: int, bands: int, base: int) -> int:
    """How many bands of ``rows`` coordinates miss a pair of the least similarity as seldom as ``bands`` of ``base``."""
    similar = percent / 100
    return math.ceil(bands * math.log1p(-similar ** base) / math.log1p(-similar ** rows))


def band_keys(sets: list[np.ndarray], bands: int, rows: int, first: int = 0) -> np.ndarray:
    """(sets, bands) 64-bit bucket keys; ``first``: the shift of the first coordinate."""
    sig = signatures(sets, bands * rows, first).astype(np.uint64).reshape(len(sets), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(first + 1), (len(sets), bands))
    for r in range(rows):
        key = scramble(key + sig[:, :, r])
    return key


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tx, n, set, keys) of each row, in the shared folder: a hash of the text, the
    number of shingles, a 128-bit digest of the set (null if empty) and its bucket keys."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tx"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                digests: list[bytes | None] = [None] * len(sets)
                keys: list[np.ndarray | None] = [None] * len(sets)
                if some:
                    for i, row in zip(some, as_long(band_keys([sets[i] for i in some], bands, rows))):
                        s = sets[i]
                        digests[i] = np.array([scramble(s).sum(), scramble(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("tx"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tx", "n", "set", "keys"])

    found = cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, tx long, n long, set binary, keys array<long>")
    return staged(found, "sketches")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text_a", 4 << 20):
                left = shingle_sets(part.column("text_a").to_pylist(), width)
                right = shingle_sets(part.column("text_b").to_pylist(), width)
                good = []
                for x, y in zip(left, right):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), larger node first, whose sizes allow the similarity."""
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.where(fits & (F.col("x") != F.col("y"))).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, n_rows: int, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(node, component) of the classes that are linked with others. ``n_rows``: a bound of the classes."""
    members = _members(classes.where("n > 0").select("node", "n", F.explode("keys").alias("key")), n_rows * bands)
    # the texts of the classes that share a bucket, one row for each class
    wanted = members.select("node").distinct().join(classes.select("node", "doc_id", "tx"), "node")
    source = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("binary").alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t"))
    texts = staged(source.join(wanted, on).groupBy("doc_id", "tx", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts", compression="zstd")
    label = members.select("node", F.col("node").alias("component")).limit(0)
    return _linked(members, label, texts, width, percent, bands, rows, rows, bands * rows)


def _few(found: DataFrame, rows: int) -> DataFrame:
    """Links, a few bytes each, in a number of partitions that follows their bound and not that of the tasks that found them."""
    return found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, rows // 100_000))


def _members(exploded: DataFrame, n_rows: int) -> DataFrame:
    """(key, node, n, hub) of the buckets with two classes or more; the hub is the first class."""
    shared = exploded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return staged(exploded.join(shared.select("key", "hub"), "key").select("key", "node", "n", "hub"), "members", rows=n_rows)


def _linked(members: DataFrame, label: DataFrame, texts: DataFrame, width: int, percent: int, bands: int, base: int, rows: int, shift: int) -> DataFrame:
    """The labels after the links within these buckets, whose bands have ``rows`` coordinates.
    ``bands`` of ``base`` coordinates set the bound; ``shift`` is the next unused coordinate."""
    n_members = members.count()
    hubs = members.select(F.col("node").alias("hub"), F.col("n").alias("n_b")).distinct()
    first = members.where("node <> hub").select("node", "n", "hub").distinct().join(hubs, "hub")
    tested = staged(_sized(first.select(F.col("node").alias("x"), F.col("n").alias("n_a"), F.col("hub").alias("y"), "n_b"), percent), "pairs", rows=n_members)
    # a row holds two texts here: the tasks follow the bytes, not the rows; what leaves them is narrow
    label = _joined(label, staged(_few(verified(tested, texts, width, percent), n_members), "found"), n_members)

    placed = members.join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes"))
    mixed = (per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("all"), F.sum("shingles").alias("shingles"), F.sum("nodes").alias("nodes"),
                                    F.max(F.struct("c", "component")).alias("top"))
             .where("parts > 1").select("key", "all", "shingles", "nodes", F.col("top.component").alias("top")))
    mixed = staged(mixed.withColumn("small", F.expr(f"all <= {BLOCK_CLASSES} and shingles <= {BLOCK_SHINGLES}")), "mixed", rows=n_members)
    open_ = staged(placed.join(mixed, "key"), "open", rows=n_members)
    crowds = _in_crowds(open_.where(f"not small and all <= {CROWD}"), n_members, texts, width, percent)
    label = _joined(label, staged(_few(_in_cells(open_, mixed, texts, width, percent).unionByName(crowds), n_members), "found"), n_members)
    crowded = open_.where(f"all > {CROWD}").select("node", "n").distinct()
    if crowded.isEmpty():
        return label
    size = rows + LONGER
    many = bands_for(size, percent, bands, base)
    again = _members(_longer(crowded, texts, width, many, size, shift), crowded.count() * many)
    return _linked(again, label, texts, width, percent, bands, base, size, shift + many * size)


def _longer(nodes: DataFrame, texts: DataFrame, width: int, bands: int, rows: int, shift: int) -> DataFrame:
    """(node, n, key): new buckets of these classes, from the coordinates after ``shift``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                keys = as_long(band_keys(shingle_sets(part.column("text").to_pylist(), width), bands, rows, shift))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "n", "keys"])

    return nodes.join(texts, "node").mapInArrow(run, "node long, n long, keys array<long>").select("node", "n", F.explode("keys").alias("key"))


def _joined(label: DataFrame, more: DataFrame, rows: int) -> DataFrame:
    """The labels after further links (a, b): only components that they join change."""
    ends = (more.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    into = components(ends, rows).select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = label.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = into.select(F.col("component").alias("node"), F.col("into").alias("component")).join(label.select("node"), "node", "left_anti")
    return staged(known.unionByName(new), "labels", rows=rows)


def _in_cells(open_: DataFrame, mixed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of each small bucket: enough to join what belongs
    together. Of buckets with the same classes one is looked at."""
    cells = mixed.where("small").groupBy("nodes", "all").agg(F.min("key").alias("key")).select("key")
    rows = open_.where("small").select("key", "node", "component").join(cells, "key").withColumn("side", F.lit(0)).join(texts, "node")
    return _compared(rows, ["key"], width, percent)


def _in_crowds(open_: DataFrame, n_members: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The same for larger buckets, whose classes are put into blocks."""
    # each class has a home: its most crowded bucket, apart for the largest component there
    home = open_.groupBy("node").agg(F.max(F.struct("all", "key", "top")).alias("home"), F.first("n").alias("n"), F.first("component").alias("component"))
    home = home.select("node", "n", "component", F.col("home.key").alias("home"),
                       F.when(F.col("component") == F.col("home.top"), F.col("component")).alias("pure"))
    crowd = home.groupBy("home", "pure").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    home = staged(home.alias("h").join(crowd.alias("c"), F.expr("h.home = c.home and h.pure <=> c.pure"))
                  .select("node", "n", "component", "h.pure", F.xxhash64("h.home", "h.pure", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")), "homes", rows=n_members)
    present = open_.select("key", "node").join(home.select("node", "block", "pure"), "node").select("key", "block", "pure").distinct()
    left = present.select("key", F.col("block").alias("ba"), F.col("pure").alias("pa"))
    right = present.select("key", F.col("block").alias("bb"), F.col("pure").alias("pb"))
    met = left.join(right, "key").where("ba <= bb and not coalesce(pa = pb, false)").select("ba", "bb").distinct()
    sides = met.select("ba", "bb", F.explode(F.array_distinct(F.array("ba", "bb"))).alias("block"))
    side = F.when(F.col("ba") == F.col("bb"), 0).when(F.col("block") == F.col("ba"), 1).otherwise(2).alias("side")
    rows = sides.join(home.select("block", "node", "component"), "block").join(texts, "node").select(F.xxhash64("ba", "bb").alias("key"), "ba", "bb", "node", "component", "text", side)
    return _compared(rows, ["key", "ba", "bb"], width, percent)


def _compared(rows: DataFrame, by: list[str], width: int, percent: int) -> DataFrame:
    """Links (a, b) between components of each group of rows (node, component, side, text), at most one a
    class. Side 0 is compared with itself, side 1 with side 2."""
    def compare(table: pa.Table) -> pa.Table:
        nodes, comps, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
        if len(set(comps.tolist())) == 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = shingle_sets(table.column("text").to_pylist(), width)
        size = np.array([len(x) for x in sets])
        one, two = side <= 1, side != 1
        universe, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((int(one.sum()), int(two.sum())), np.float32)
        for low in range(0, len(universe), 8192):
            inside = (where >= low) & (where < low + 8192)
            has = np.zeros((len(sets), min(8192, len(universe) - low)), np.float32)
            has[owner[inside], where[inside] - low] = 1
            common += has[one] @ has[two].T
        i, j = np.flatnonzero(one), np.flatnonzero(two)
        union = size[i][:, None] + size[j][None, :] - common
        near = (100 * common >= percent * union) & (comps[i][:, None] != comps[j][None, :])
        root = {c: c for c in set(comps.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in zip(*np.nonzero(near)):
            p, q = i[x], j[y]
            a, b = top(int(comps[p])), top(int(comps[q]))
            if a != b:
                root[a] = b
                out.append((int(nodes[p]), int(nodes[q])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    # few bytes but much work: the number of partitions is named, so that they are not merged by size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").groupBy(*by).applyInArrow(compare, "a long, b long")


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The sketches of all rows; (set, component, doc_id, tx) of each class, with the row of the class that
    comes first (null ids last); and the number of rows. ``component`` is the class's component as a node."""
    found = sketches(docs, id_col, text_col, width, bands, rows)
    classes = (found.where("n > 0").groupBy("set")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
               .select("set", F.col("first.doc_id").alias("doc_id"), F.col("first.tx").alias("tx"), "n", "keys"))
    n_rows = found.count()
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes", rows=n_rows)
    label = links(docs, classes, n_rows, id_col, text_col, width, percent, bands, rows)
    named = classes.select("set", "node", "doc_id", "tx").join(label, "node", "left")
    return found, named.select("set", F.coalesce("component", "node").alias("component"), "doc_id", "tx"), n_rows


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, tx (a hash of its text), n_shingles, component_id, kept.

    ``component_id`` is the smallest id among documents reachable over links.
    Null and empty texts have no shingles and are linked with nothing: each is
    its own component. Rows that repeat an id are rows of their own with equal
    verdicts where their texts are equal. A null id is reachable but never the
    component's id. An empty table gives no rows. Other columns are not read.
    """
    found, named, n_rows = labelled(docs, id_col, text_col, width, percent, bands, rows)
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # written out, so that the join below has a plain exchange on both sides and a hot set can be split
    by_set = staged(named.join(ids, "component").select("set", "component_id"), "components", rows=n_rows)
    some = found.where("n > 0").join(by_set, "set").select("doc_id", "tx", "n", "component_id")
    none = found.where("n = 0").select("doc_id", "tx", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", "tx", F.col("n").alias("n_shingles"), "component_id",
                                         F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The input with one row of each component, all columns unchanged: the row with the
    smallest id (one of them, if rows repeat it), or one without id if the component has
    no other. Rows without shingles all stay."""
    _, named, n_rows = labelled(docs, id_col, text_col, width, percent, BANDS, ROWS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("first")
    # written out, so that the join below has a plain exchange on both sides and a hot text can be split
    stay = staged(named.groupBy("component").agg(first).select("component", "first.doc_id", "first.tx"), "stay", rows=n_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    words = F.coalesce(F.col(text_col).rlike(WORD_PATTERN), F.lit(False))
    keyed = docs.where(words).select(row, F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("t"))
    both = keyed.join(stay, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tx")))
    # rows that repeat id and text are reduced before they are shuffled
    one = both.groupBy("component").agg(F.first("row").alias("row"))
    return docs.where(~words).unionByName(one.select("row.*"))
