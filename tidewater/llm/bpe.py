"""Byte-pair encoding by speculation and verification.

A piece of text (what the pre-tokenizer yields) is first cut by greedy longest
match against the vocabulary. Byte-pair encoding would give the same tokens if
each token is what its own bytes encode to, and if no merge ever crosses a
border between two neighbours. The second can be seen from the two tokens
alone: the pieces that meet at the border are the last pieces in the making of
the left token and the first ones in the making of the right token; going back
through both makings, at each moment the merge of the two pieces that meet must
be absent or come later than the merges that consume them. This is tested for
all new pairs of neighbours at once on numpy arrays. Only pieces that fail are
merged exactly, all of them side by side.

White space that ends before a word belongs to the word in every case, and no
piece reaches from a non-space into a following space, so a text can be cut
before each run of white space and the parts encoded on their own. Parts repeat
a lot, so their ids are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.common import record, slices, text_bytes

#: White space of the pre-tokenizer (the Unicode property White_Space), in one byte and in more.
ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_SPACE = re.compile("|".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])).encode())
#: What the pre-tokenizer makes of the usual parts: a line feed, letters of the Latin blocks up to U+024F (in
#: UTF-8) with at most one space before them, and ASCII punctuation are a piece each.
USUAL = re.compile(rb"(\n)?([ ]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!-/:-@\[-`{-~]+)?")
#: Entries of the table of parts, each of some 60 bytes (results are the same at any size).
TABLE_SIZE = 2_000_000
NEVER = np.int64(1) << 40
MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_tokenizer(content: bytes) -> Tokenizer:
    """The library's tokenizer, without truncation and padding."""
    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _cut(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Consecutive runs of tokens, each as little-endian 32-bit integers."""
    whole = tokens.astype("<u4").tobytes()
    ends = (4 * np.cumsum(sizes)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Vocabulary, merges and the table of parts of one Python worker."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_letters()
        self.splitter = plain_tokenizer(content).pre_tokenizer
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)).encode() or b"(?!)")
        vocab = spec["model"]["vocab"]
        self.letters = letters
        self.id_of = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        # the id of each token, and -1 for beginnings of tokens that are none themselves
        self.longest = {token[:n]: -1 for token in self.id_of for n in range(1, len(token))} | self.id_of
        self.byte_ids = np.fromiter((self.id_of[bytes([b])] for b in range(256)), np.int64, 256)
        # rank of the merge that makes a token (-1: a byte), and the two tokens it merges
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            made = vocab[a + b]
            self.rule.setdefault((vocab[a], vocab[b]), (r, made))
            if self.left[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
        keys = np.fromiter((a * size + b for a, b in self.rule), np.int64, len(self.rule))
        ranks = np.fromiter((r for r, _ in self.rule.values()), np.int64, len(self.rule))
        self.size = size
        # hash tables of falling size: what finds its place taken goes to the next one
        self.hashed: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        bits = 18
        while len(keys):
            shift = np.uint64(64 - bits)
            place = (keys.astype(np.uint64) * MIX) >> shift
            _, first = np.unique(place, return_index=True)
            held, held_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER)
            held[place[first]], held_rank[place[first]] = keys[first], ranks[first]
            self.hashed.append((shift, held, held_rank))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks, bits = keys[rest], ranks[rest], max(8, bits - 1)
        self.made_by = np.full(len(spec["model"]["merges"]), -1)
        for r, token in self.rule.values():
            self.made_by[r] = token
        if any(r <= max(self.rank[a], self.rank[b]) for (a, b), (r, _) in self.rule.items()):
            raise ValueError("a merge comes before a token that it needs is made")
        made = np.flatnonzero(self.left >= 0)
        apart = np.zeros(size, bool)
        apart[made] = self.compatible(self.left[made], self.right[made], below=self.rank[made])
        self.whole = self._whole(apart)
        self.byte_sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # the table of parts: their bytes, and their ids in a row; the added tokens come first
        self.known = pa.array([t.encode() for t in self.added], pa.large_binary())
        self.flat = np.array(list(self.added.values()), "<u4")
        self.sizes, self.starts = np.ones(len(self.added), np.int64), np.arange(len(self.added))

    def _whole(self, apart: np.ndarray) -> np.ndarray:
        """Which tokens are what their own bytes encode to: bytes, and tokens made of two
        such tokens between which nothing merges before the merge that makes them."""
        whole = self.rank < 0
        for i in np.argsort(self.rank, kind="stable"):
            if self.left[i] >= 0:
                whole[i] = apart[i] and whole[self.left[i]] and whole[self.right[i]]
        return whole

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``NEVER`` where there is none."""
        keys = a * self.size + b
        mixed = keys.astype(np.uint64) * MIX
        out = np.full(len(keys), NEVER)
        for shift, held, ranks in self.hashed:
            place = mixed >> shift
            out = np.where(held[place] == keys, ranks[place], out)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether no merge crosses the border; with ``below``, none before that rank."""
        good = np.ones(len(a), bool)
        left_end = np.full(len(a), NEVER) if below is None else below.copy()
        right_end = np.full(len(a), NEVER - 1) if below is None else below - 1
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        while len(at):
            merge = self.merge_ranks(x, y)
            # of equal merges the leftmost comes first: the left piece's own merge, but not the right piece's
            bad = (merge < left_end) & (merge <= right_end)
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry  # the piece made last; of equal ones the right
            left_end, right_end = np.where(undo_left, rx, left_end)[go], np.where(undo_left, right_end, ry)[go]
            x, y = np.where(undo_left, self.right[x], x)[go], np.where(undo_left, y, self.left[y])[go]
            at = at[go]
        return good

    def greedy(self, piece: bytes) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        longest = self.longest
        tokens, start, n = [], 0, len(piece)
        while start < n:
            stop = end = start + 1
            token = longest[piece[start:stop]]
            while stop < n:
                stop += 1
                found = longest.get(piece[start:stop])
                if found is None:
                    break
                if found >= 0:
                    token, end = found, stop
            tokens.append(token)
            start = end
        return tokens

    def exact(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair encoding of all these pieces side by side: in each round, every piece
        merges all places of its lowest merge, from the left (a merge always comes
        after those that make its tokens, so no lower one can appear meanwhile).
        Returns the tokens of all pieces in a row, and the number of each piece's."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), size)
        done = [(of[:0], token[:0])]
        rank = np.full(len(token), NEVER)  # of the merge of each token with the next one
        near = np.flatnonzero(of[1:] == of[:-1])
        rank[near] = self.merge_ranks(token[near], token[near + 1])
        while len(token):
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            here = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(of)]))
            stay = here < NEVER
            done.append((of[~stay], token[~stay]))
            at = np.flatnonzero((rank == here) & stay)
            # in a run of overlapping places every other one, from the left
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            token[at] = self.made_by[rank[at]]
            stay[at + 1] = False
            moved = (np.cumsum(stay) - 1)[at]
            token, of, rank = token[stay], of[stay], rank[stay]
            # only the pairs on either side of a merge are new
            beside = np.zeros(len(token), bool)
            beside[moved] = True
            beside[moved[moved > 0] - 1] = True
            rank[beside] = NEVER
            beside[-1:] = False
            pair = np.flatnonzero(beside)
            pair = pair[of[pair] == of[pair + 1]]
            rank[pair] = self.merge_ranks(token[pair], token[pair + 1])
        of, token = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(of, kind="stable")
        return token[by], np.bincount(of, minlength=len(pieces))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all pieces in a row, the number of each piece's, and which pieces failed the check."""
        cut = list(map(self.greedy, pieces))
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(chain.from_iterable(cut), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(cut)), size)
        failed = np.zeros(len(cut), bool)
        failed[of[~self.whole[flat]]] = True
        near = np.flatnonzero(of[1:] == of[:-1])
        distinct, where = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        fits = self.compatible(distinct // self.size, distinct % self.size)
        failed[of[near][~fits[where]]] = True
        again = np.flatnonzero(failed)
        tokens, count = self.exact([pieces[i] for i in again.tolist()])
        starts = np.cumsum(size) - size
        starts[again], size[again] = len(flat) + np.cumsum(count) - count, count
        return gather(np.concatenate([flat, tokens]), starts, size), size, failed

    def tokens_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces in a row, and the number of each piece's."""
        return self.encode_pieces(pieces)[:2]

    def pieces_of(self, part: bytes) -> list[bytes]:
        """What the pre-tokenizer makes of a part of a text."""
        letters = self.letters
        return [bytes([letters[c] for c in piece]) for piece, _ in self.splitter.pre_tokenize_str(part.decode())]

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all parts in a row, and the number of each part's."""
        number: dict[bytes, int] = {}
        used, count = [], []
        for part in parts:
            usual = USUAL.fullmatch(part)
            pieces = [p for p in usual.groups() if p] if usual else self.pieces_of(part)
            count.append(len(pieces))
            for p in pieces:
                used.append(number.setdefault(p, len(number)))
        tokens, size = self.tokens_of(list(number))
        at, n = np.array(used, np.int64), np.array(count, np.int64)
        starts = np.cumsum(size) - size
        return gather(tokens, starts[at], size[at]), np.add.reduceat(size[at], np.cumsum(n) - n)

    def look_up(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of distinct parts start, and how many there are; new parts are added."""
        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(at))
        rows = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            if len(self.known) + len(new) > TABLE_SIZE:  # keep the added tokens and what this slice uses
                used = np.unique(np.r_[np.arange(len(self.added)), rows[rows >= 0]])
                rows[rows >= 0] = np.searchsorted(used, rows[rows >= 0])
                self.known = self.known.take(pa.array(used))
                self.flat, self.sizes = gather(self.flat, self.starts[used], self.sizes[used]), self.sizes[used]
            rows[rows < 0] = len(self.known) + np.arange(len(new))
            tokens, size = self.encode_parts(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.sizes = np.concatenate([self.flat, tokens.astype("<u4")]), np.concatenate([self.sizes, size])
            self.starts = np.cumsum(self.sizes) - self.sizes
        return self.starts[rows], self.sizes[rows]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a binary column; null counts as empty) in a row, and the number of each text's."""
        texts = pc.fill_null(texts, b"").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = memoryview(raw)[offsets[0]:offsets[-1]] if raw is not None else memoryview(b"")
        ends = offsets - offsets[0]
        data = np.frombuffer(whole, np.uint8)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        space = ASCII_SPACE[data]
        for m in WIDE_SPACE.finditer(whole):
            space[m.start():m.end()] = True
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[ends[:-1][ends[:-1] < len(data)]] = True
        for m in self.added_pattern.finditer(whole):
            doc = np.searchsorted(ends, m.start(), "right")
            if m.end() <= ends[doc]:
                start[m.start() + 1:m.end()] = False
                start[m.start()] = True
                if m.end() < len(data):
                    start[m.end()] = True
        starts = np.flatnonzero(start)
        cuts = pa.py_buffer(np.r_[starts, len(data)].astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, cuts, pa.py_buffer(whole)]).dictionary_encode()
        which = parts.indices.to_numpy()
        first, size = self.look_up(parts.dictionary)
        counts = size[which]
        per_text = np.diff(np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends)])
        return gather(self.flat, first[which], counts), per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: their bytes in a row, read as UTF-8 with replacement characters."""
        size = self.byte_sizes[ids]
        whole = gather(self.byte_blob, self.byte_starts[ids], size).tobytes()
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s:s + n] for each start and size, in a row."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def runs(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each run of ids as little-endian 32-bit integers."""
    return _cut(ids, counts)


_encoders: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The encoder of this Python process for a tokenizer file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def shared_file(docs: DataFrame, path: str) -> Broadcast:
    """A tokenizer file (a fixed file of about a megabyte, whatever the corpus) for all executors."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


ENCODED = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: pa.Schema, ddl: str, finish) -> DataFrame:
    file = shared_file(docs, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewater.llm.bpe import encoder  # the module of the worker, which keeps its tables between tasks
        e = encoder(file.value)
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                found = record(schema, finish(e, *e.encode(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.columns], names=["doc_id", *schema.names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ddl}")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian 32-bit integers), decoded text.

    Null counts as empty (no ids, empty text). Strings of added tokens in a text
    become those tokens, as in the library. An empty table gives no rows.
    """
    return _mapped(docs, path, id_col, text_col, ENCODED, "n_tokens long, ids binary, decoded string",
                   lambda e, ids, n: [n, runs(ids, n), e.decode(ids, n)])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and decoded text."""
    return _mapped(docs, path, id_col, text_col, DIGESTS, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda e, ids, n: [n, [hashlib.sha256(x).hexdigest() for x in runs(ids, n)],
                                      [hashlib.sha256(x.encode()).hexdigest() for x in e.decode(ids, n)]])
