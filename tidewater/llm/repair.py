"""Repair of conversation structure at the least cost, by the auction algorithm for shortest paths.

A conversation is sound if its roles' initials read ``(s?(ua)+)?`` and no turn of
it is blank or a duplicate. Turns can be kept, given another role or deleted,
and empty ones can be inserted. These edits are the arcs of a lattice of
integer costs: a node is a number of turns read and one of four states of that
pattern. The auction keeps a price for each node, never more than an arc's
cost plus the price at its end. A path grows from the origin over arcs that meet this
bound exactly; where none does, the price of its last node rises and the path loses
that node. When the path reaches the sink, the prices are an optimal dual
solution: an edit sequence is cheapest just if all its arcs are tight. Among these
the least one in the order of its letters is traced from the origin.

No task holds a long conversation. Turns are numbered over range partitions,
and cut into blocks of 64. Conversations of several blocks are put together by
tables of four by four: the auction gives each block's costs from state to state; these give, from
the last block to the first and level by level in groups of 64, what the rest
costs from each state at a block's end; with this each block finds its edits for
each state it may be entered in, and the states are followed from the first block on. Only
the audit of a conversation, one letter a turn, and the digest of its text, which is
read as a stream, are made in one task.

Null conversation ids are one conversation; null roles and texts count as one space, null turns come
first. Turns with one number go by role, then by the SHA-256 of role and text; rows that repeat are
turns of their own. Roles count by their first character. Texts are handled whole and bounded by 64 in
a task's row. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, WORD_PATTERN
from tidewater.session import staged

#: Turns of a block, and blocks of a group.
BLOCK, FAN = 64, 64
#: Costs of the edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The states of the pattern (nothing read, after s, after u, after a) and what each role leads to.
STATES, START, ACCEPTING = 4, 0, (0, 3)
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The one of user and assistant that each state allows.
ALLOWED = ["u", "u", "a", "u"]
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60


# ---- the lattice of a block ----

def lattice(code: str, last: bool, ends: list[int]) -> list[list[tuple[str, int, int]]]:
    """The arcs (edit, node, cost) of each node ``4 * turns read + state``; the sink is the node after them.

    ``code`` has a letter for each turn: its role, as a capital if truncated, or ``-`` if it must go.
    ``ends``: the cost of going on from each state after the block. Only the
    last block has insertions after its last turn. Arcs to nodes that cannot reach the sink are left out.
    """
    n, sink = len(code), STATES * (len(code) + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
    reach = [False] * sink + [True]
    for i in range(n, -1, -1):
        for q in (0, 1, 3, 2):  # insertions lead from 2 to 3 and from the others to 2
            arcs[STATES * i + q] = list(_edits(code, i, q, n, last, ends, sink))
        for _ in range(STATES):
            for q in range(STATES):
                reach[STATES * i + q] = reach[STATES * i + q] or any(reach[j] for _, j, _ in arcs[STATES * i + q])
    return [[a for a in out if reach[a[1]]] for out in arcs]


def _edits(code: str, i: int, q: int, n: int, last: bool, ends: list[int], sink: int) -> Iterator[tuple[str, int, int]]:
    if i == n and ends[q] < FAR:
        yield "", sink, ends[q]
    if i < n:
        yield "D", STATES * (i + 1) + q, DELETE
    if i < n or last:
        yield "I", STATES * i + NEXT[q][ALLOWED[q]], INSERT
    if i < n and code[i] != "-":
        more = TRUNCATED if code[i].isupper() else 0
        if code[i].lower() in NEXT[q]:
            yield "K", STATES * (i + 1) + NEXT[q][code[i].lower()], more
        yield "R", STATES * (i + 1) + NEXT[q][ALLOWED[q]], RENAME + more


def auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> int:
    """The least cost from ``origin`` to the sink, the last node. ``prices`` are raised; they may come from earlier origins."""
    sink, path = len(arcs) - 1, [origin]
    while path[-1] != sink:
        node = path[-1]
        least, to = min((cost + prices[j], j) for _, j, cost in arcs[node])
        if prices[node] == least:
            path.append(to)
        else:
            prices[node] = least
            if len(path) > 1:
                path.pop()
    return prices[origin] - prices[sink]


def costs(code: str, last: bool) -> list[int]:
    """The least cost of a block from each state (row) to each state (column), in a row."""
    out = [FAR] * (STATES * STATES)
    for to in range(STATES):
        arcs = lattice(code, last, [0 if q == to else FAR for q in range(STATES)])
        prices = [0] * len(arcs)
        for q in range(STATES):
            if arcs[q]:
                out[STATES * q + to] = auction(arcs, prices, q)
    return out


def edits(code: str, last: bool, ends: list[int], entries: range) -> list[tuple[str, int, int]]:
    """For each entry state: the cheapest edits, least in the order of their letters, the state after them, and the cost with what follows."""
    arcs = lattice(code, last, ends)
    sink, prices = len(arcs) - 1, [0] * len(arcs)
    cost = [auction(arcs, prices, q) if arcs[q] else FAR for q in entries]
    tight = [[a for a in out if prices[i] == a[2] + prices[a[1]]] for i, out in enumerate(arcs)]
    back: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(tight):
        for _, j, _ in out:
            back[j].append(i)
    good, todo = {sink}, [sink]
    while todo:
        for i in back[todo.pop()]:
            if i not in good:
                good.add(i)
                todo.append(i)
    found = []
    for q, c in zip(entries, cost):
        if c >= FAR:
            found.append(("", -1, FAR))
            continue
        node, said = q, []
        while True:
            letter, to, _ = min(a for a in tight[node] if a[1] in good)
            if to == sink:
                break
            said.append(letter)
            node = to
        found.append(("".join(said), node % STATES, c))
    return found


def lines(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """The turns that the edits of a block leave, from this entry state on."""
    at = 0
    for edit in audit:
        if edit == "K":
            role, text = roles[at], texts[at]
        elif edit != "D":
            role, text = NAMES[ALLOWED[state]], texts[at] if edit == "R" else ""
        at += edit != "I"
        if edit != "D":
            state = NEXT[state][role[:1]]
            yield role, text


# ---- blocks of a conversation ----

def _then(costs_: list[int], rest: list[int]) -> list[int]:
    """What a block and the rest cost from each state."""
    return [min(FAR, *(costs_[STATES * q + p] + rest[p] for p in range(STATES))) for q in range(STATES)]


def _product(first: list[int], second: list[int]) -> list[int]:
    columns = [_then(first, second[to::STATES]) for to in range(STATES)]
    return [columns[to][q] for q in range(STATES) for to in range(STATES)]


def _follow(exits: list[int], state: list[int]) -> list[int]:
    return [exits[state[0]]]


def _both(first: list[int], second: list[int]) -> list[int]:
    return [second[q] if q >= 0 else -1 for q in first]


def sweep(items: DataFrame, most: int, start: list[int], step: Callable, join: Callable, backward: bool) -> DataFrame:
    """What arrives at each block: (key, block, got). ``items`` has (key, block, v); ``start`` arrives at the
    first block (the last one if ``backward``), and ``step(v, got)`` goes on to the next. ``join(v, w)`` is what two
    blocks in a row are together. Blocks are handled in groups of ``FAN``, and groups of groups: ``most`` blocks need log(most) levels."""
    level = items.withColumn("up", F.expr(f"block div {FAN}"))
    if most <= FAN:
        given = level.withColumn("begin", F.array(*[F.lit(x).cast("long") for x in start]))
    else:
        def joined(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            v = table.column("v").to_pylist()
            whole = v[0]
            for w in v[1:]:
                whole = join(whole, w)
            return pa.table({"key": table.column("key")[:1], "block": table.column("up")[:1], "v": pa.array([whole], pa.list_(pa.int64()))})

        groups = staged(level.groupBy("key", "up").applyInArrow(joined, "key string, block long, v array<long>"), "groups")
        above = sweep(groups, -(-most // FAN), start, step, join, backward)
        given = level.join(above.select("key", F.col("block").alias("up"), F.col("got").alias("begin")), ["key", "up"])

    def passed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "descending" if backward else "ascending")])
        got, out = table.column("begin")[0].as_py(), []
        for v in table.column("v").to_pylist():
            out.append(got)
            got = step(v, got)
        return pa.table({"key": table.column("key"), "block": table.column("block"), "got": pa.array(out, pa.list_(pa.int64()))})

    return given.select("key", "up", "block", "v", "begin").groupBy("key", "up").applyInArrow(passed, "key string, block long, got array<long>")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _numbered(talks: DataFrame) -> DataFrame:
    """The turns with ``pos`` in their conversation. Range partitions split long conversations and equal turns."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    rows = talks.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("row", F.monotonically_increasing_id())
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    ranged = staged(staged(rows, "turns").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    offset = per.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order[1:]))
    return ranged.withColumn("nth", inside).join(offset, ["key", "part"]).withColumn("pos", (F.col("before") + F.col("nth") - 1).cast("long")).drop("part", "nth", "before", "row")


def marked(talks: DataFrame) -> DataFrame:
    """Every turn with its place and its first fault: key, pos, turn, role, text, fault (blank, duplicate, truncated or null)."""
    rows = staged(_numbered(talks), "numbered")
    first = staged(rows.groupBy("key", "digest").agg(F.min("pos").alias("first")), "firsts")
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = (F.when(~F.col("text").rlike(WORD_PATTERN), "blank").when(F.col("pos") > F.col("first"), "duplicate")
             .when(~end.isin(".", "!", "?"), "truncated"))
    return staged(rows.join(first, ["key", "digest"]).select("key", "pos", "turn", "role", "text", fault.alias("fault")), "marked")


def _coded(rows: DataFrame) -> DataFrame:
    """The blocks: key, block, code, initials (with the first one of the next block), last, blocks."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    block = F.expr(f"pos div {BLOCK}")
    own = F.when((F.col("pos") % BLOCK == 0) & (F.col("pos") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    each = rows.select("key", "pos", initial.alias("initial"), letter.alias("letter"), block.alias("home"), F.explode(own).alias("block"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "initial", "letter", (F.col("home") == F.col("block")).alias("own")))).alias("x")
    blocks = each.groupBy("key", "block").agg(turns)
    size = rows.groupBy("key").agg(F.expr(f"max(pos) div {BLOCK} + 1").alias("blocks"))
    spelled = F.concat_ws("", F.transform(F.filter("x", lambda t: t["own"]), lambda t: t["letter"]))
    return staged(blocks.join(size, "key").select("key", "block", spelled.alias("code"), F.concat_ws("", F.col("x.initial")).alias("initials"),
                                                  (F.col("block") == F.col("blocks") - 1).alias("last"), "blocks"), "blocks")


def _rowwise(df: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """``fn`` on each row as a dict; it gives a row of the named columns."""
    names = [c.split()[0] for c in ddl.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], names=names)

    return df.mapInArrow(run, ddl)


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def repaired_blocks(rows: DataFrame) -> DataFrame:
    """The edits of each block of the turns that ``marked`` gives: key, block, entry (the state before it), audit,
    cost (of the whole conversation; in its first block, else 0), illegal."""
    blocks = _coded(rows)
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    accept = [0 if q in ACCEPTING else FAR for q in range(STATES)]
    alone = F.array(*[F.lit(x).cast("long") for x in accept])
    several = blocks.where("blocks > 1")
    table = staged(_rowwise(several.select("key", "block", "code", "last"), lambda r: (r["key"], r["block"], costs(r["code"], r["last"])),
                            "key string, block long, v array<long>"), "costs")
    ends = sweep(table, most, accept, _then, _product, backward=True)
    # the last block ends where it likes to, at no cost
    given = blocks.where("blocks = 1").withColumn("got", alone).unionByName(several.join(ends, ["key", "block"]))

    def chosen(r: dict) -> tuple:
        found = edits(r["code"], r["last"], r["got"], range(STATES if r["block"] else 1))
        return r["key"], r["block"], r["blocks"], [f[0] for f in found], [f[1] for f in found], 0 if r["block"] else found[START][2], _illegal(r["initials"])

    picked = staged(_rowwise(given, chosen, "key string, block long, blocks long, audits array<string>, v array<long>, cost long, illegal long"), "edits")
    wide = F.when(F.col("block") == 0, F.array_repeat(F.col("v")[0], STATES)).otherwise(F.col("v"))  # the first block is entered in one state
    states = sweep(picked.where("blocks > 1").select("key", "block", wide.alias("v")), most, [START], _follow, _both, backward=False)
    one = picked.where("blocks = 1").withColumn("got", F.array(F.lit(START).cast("long")))
    entered = one.unionByName(picked.where("blocks > 1").join(states, ["key", "block"]))
    entry = F.col("got")[0]
    return staged(entered.select("key", "block", entry.alias("entry"), F.element_at("audits", (entry + 1).cast("int")).alias("audit"), "cost", "illegal"), "audits")


def _block_lines(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The turns that are left, in blocks: key, block, audit, cost, illegal, roles, texts."""
    turns = rows.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("x"))
    both = turns.join(blocks, ["key", "block"]).select("key", "block", "entry", "audit", "cost", "illegal", F.col("x.role").alias("roles"), F.col("x.text").alias("texts"))

    def left(r: dict) -> tuple:
        found = list(lines(r["audit"], r["roles"], r["texts"], r["entry"]))
        return r["key"], r["block"], r["audit"], r["cost"], r["illegal"], [f[0] for f in found], [f[1] for f in found]

    return _rowwise(both, left, "key string, block long, audit string, cost long, illegal long, roles array<string>, texts array<string>")


def repaired_turns(talks: DataFrame) -> DataFrame:
    """The sound conversations, a row for each turn: conv_id, block and nth (its order in the conversation), role, text."""
    rows = marked(talks)
    left = _block_lines(rows, repaired_blocks(rows)).select("key", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("nth", "x"))
    return _named(talks, left.select("key", "block", "nth", F.col("x.roles").alias("role"), F.col("x.texts").alias("text")), "inner")


def _named(talks: DataFrame, by_key: DataFrame, how: str) -> DataFrame:
    """The conversations' own ids in place of the key."""
    ids = talks.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    return ids.join(by_key, "key", how).drop("key")


def repair_report(talks: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``original`` (the table itself, if not given): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256; conversations without turns in ``talks`` have zeros, no audit and the digest of the empty string."""
    rows = marked(talks)
    faults = [F.count_if(F.col("fault") == f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counted = rows.groupBy("key").agg(gaps, *faults)
    left = _block_lines(rows, repaired_blocks(rows)).repartition("key").sortWithinPartitions("key", "block")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        for key, part in itertools.groupby(blocks(), key=lambda r: r["key"]):
            digest, audit, cost, illegal, first = hashlib.sha256(), [], 0, 0, True
            for r in part:
                audit.append(r["audit"])
                cost, illegal = cost + r["cost"], illegal + r["illegal"]
                for role, text in zip(r["roles"], r["texts"]):
                    digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()),
                                              pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())],
                                             names=["key", "illegal", "cost", "audit", "repaired_sha256"])

    heard = left.mapInArrow(told, "key string, illegal long, cost long, audit string, repaired_sha256 string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return _named(talks if original is None else original, counted.join(heard, "key"), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(talks: DataFrame) -> DataFrame:
    """The table with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 loses the row, 1 its text, 2 the marks
    ``.!?`` of its text, 3 comes twice, 4 has the role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = talks.withColumn("__d", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = dealt.where("__d <> 0").select("conv_id", "turn", F.when(F.col("__d") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
                                          F.when(F.col("__d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("__times")).drop("col")
