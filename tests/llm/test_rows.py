"""Sharding, quality rules, exact dedup and mixing against brute force, and on awkward rows."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import exact, mixing, quality, sharding
from tidewater.llm.common import SPACES

WHITE = set(SPACES)


def words(text):
    return (text or "").encode().split()


# ---- sharding ----

def lpt(sizes, n):
    loads = [(0, i) for i in range(n)]
    out = []
    for s in sizes:
        load, i = heapq.heappop(loads)
        out.append(i)
        heapq.heappush(loads, (load + s, i))
    return out


def test_deal_is_the_heap():
    rng = random.Random(1)
    for _ in range(500):
        loads = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
        size, count = rng.randint(1, 9), rng.randint(0, 60)
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        expected = []
        for _ in range(count):
            load, i = heapq.heappop(heap)
            expected.append(i)
            heapq.heappush(heap, (load + size, i))
        phases = sharding.deal(list(loads), size, count)
        got = []
        for (first, turn), stop in zip(phases, [p[0] for p in phases[1:]] + [count]):
            got += [turn[j % len(turn)] for j in range(stop - first)]
        assert got == expected


def check_shards(found, source, n):
    assert len(found) == len(source)
    shard_of, groups = {}, defaultdict(int)
    for r in found:
        assert shard_of.setdefault(r.text_md5, r.shard) == r.shard
        groups[r.text_md5] += r["size"]
    order = sorted(groups, key=lambda d: (-groups[d], d))
    assert [shard_of[d] for d in order] == lpt([groups[d] for d in order], n)
    for s in range(n):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_sharding(small, monkeypatch, chunk):
    from tidewater.llm import common
    monkeypatch.setattr(sharding, "hex_digits", lambda rows: common.hex_digits(rows, chunk))  # small chunks: the split ranks
    check_shards(sharding.longest_first(small, 5).collect(), small.collect(), 5)


def test_sharding_awkward(clashing, documents):
    check_shards(sharding.longest_first(clashing, 3).collect(), clashing.collect(), 3)
    assert sharding.longest_first(documents([]), 3).collect() == []


# ---- quality ----

def repeated(ws, n):
    seen = defaultdict(list)
    for i in range(len(ws) - n + 1):
        seen[tuple(ws[i:i + n])].append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}


def longest(ws):
    n, best = len(ws), [0] * (len(ws) + 1)
    top = 0
    for i in range(n - 1, -1, -1):
        row = [0] * (n + 1)
        for j in range(n - 1, i, -1):
            row[j] = best[j + 1] + 1 if ws[i] == ws[j] else 0
            top = max(top, row[j])
        best = row
    return top


def measures(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if set(x) - WHITE]
    return (len(ws), sum(c not in WHITE for c in text or ""), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeated(ws, 5)), len(repeated(ws, quality.MIN_REPEAT)))


def test_quality_random_repeats():
    rng = random.Random(3)
    texts = [None, "", "a", "a " * 300, "a b " * 90, "x\nx\n\n \ny\nx"]
    for _ in range(150):
        base = [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))]
        texts.append(rng.choice(" \n").join(base + base[:rng.randint(0, 60)]))
    found = quality.measure(texts).to_pylist()
    for t, r in zip(texts, found):
        ws = words(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_covered_words"]) == measures(t)
        top = longest(ws)
        assert r["longest_repeat"] == (top if top >= quality.MIN_REPEAT else 0)
        spans = {i for s in r["repeats"] for i in range(s["start"], s["start"] + s["length"])}
        assert spans == repeated(ws, quality.MIN_REPEAT)


def test_quality_verdicts(spark, small, clashing, documents):
    for docs in (small, clashing):
        kept = Counter()
        for r in quality.quality(docs).collect():
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and 100 * r.n_covered_words <= 20 * r.n_words and r.longest_repeat <= quality.MAX_REPEAT)
            kept[r.doc_id] += r.kept
        stay = quality.drop_repetitive(docs)
        assert stay.columns == docs.columns
        assert Counter(r.doc_id for r in stay.collect()) == +kept
    assert quality.quality(documents([])).collect() == quality.drop_repetitive(documents([])).collect() == []


# ---- exact ----

def test_misra_gries_bound():
    rng = random.Random(5)
    items = [b"%d" % min(int(rng.paretovariate(0.6)), 500) for _ in range(6000)]
    kept: dict = {}
    for i in range(0, len(items), 500):
        kept = exact.fold(kept, exact.misra_gries(iter(items[i:i + 500]), 10), 10)
    assert len(kept) <= 10
    for d, n in Counter(items).items():
        assert n - len(items) / 11 * 2 <= kept.get(d, 0) <= n


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r.text or "" if c not in WHITE)].append(r)
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            yield r.doc_id, best.doc_id, len(members), r.doc_id == best.doc_id, hashlib.sha256(norm.encode()).hexdigest()


@pytest.mark.parametrize("counters", [1024, 3])
def test_exact(small, clashing, counters):
    for docs in (small, clashing):
        rows = docs.collect()
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, counters=counters).collect())
        assert got == Counter(brute_groups(rows))
        stay = exact.drop_copies(docs, counters=counters)
        assert stay.columns == docs.columns
        norms = [hashlib.sha256("".join(c for c in r.text or "" if c not in WHITE).encode()).hexdigest() for r in stay.collect()]
        assert sorted(norms) == sorted({g[4] for g in brute_groups(rows)})


def test_exact_hot_group(documents):
    docs = documents([(i, "same text" if i % 3 else f"text {i}", None, None, None) for i in range(900)])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs, counters=4).collect()}
    assert all(got[i] == ((1, 600) if i % 3 else (i, 1)) for i in range(900))
    assert exact.exact_groups(documents([])).collect() == exact.drop_copies(documents([])).collect() == []


# ---- mixing ----

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_targets(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i}": rng.choice([0, 1, 50, 1000, 40000]) for i in range(n)} | {None: 17}
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        expected = brute_targets(sizes)
        assert all(math.isclose(r.target, expected[r.source], rel_tol=1e-12, abs_tol=1e-9) for r in found)


@pytest.mark.parametrize("chunk", [1 << 16, 8])
def test_mixing(small, clashing, monkeypatch, chunk):
    from tidewater.llm import common
    monkeypatch.setattr(mixing, "hex_digits", lambda rows: common.hex_digits(rows, chunk))
    for docs in (small, clashing):
        found = mixing.mix_plan(docs).collect()
        assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in found:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
            assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        target = brute_targets(sizes)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
        assert Counter(found) == Counter(mixing.mix_plan(docs).collect())
        times = Counter()
        for r in found:
            times[r.doc_id] += r.copies
        mixed = mixing.mixed(docs)
        assert mixed.columns == docs.columns
        assert Counter(r.doc_id for r in mixed.collect()) == +times


def test_mixing_empty(documents):
    assert mixing.mix_plan(documents([])).collect() == mixing.mixed(documents([])).collect() == []


def test_covered_and_repeats_on_one_word():
    r = quality.measure(["w " * 5000]).to_pylist()[0]
    assert r["longest_repeat"] == 4999 and r["n_covered_words"] == 5000
    assert not np.any(quality.longest_repeats(np.arange(50), np.zeros(50, int), np.full(50, 50), 5))
