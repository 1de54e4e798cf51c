"""Conversation repair, token alignment and language identification against plain brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tests.llm.conftest import SENTENCE, rows
from tidewater.llm import align, language, repair
from tidewater.llm.queries import PIECES, QUERIES, TOKENIZER

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")

# ---- conversation repair ----

TALKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute_damage(data):
    sp = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in data:
        role, text = sp(role), sp(text)
        d = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        for _ in range(2 if d == 3 else 1):
            yield conv, turn, role, text


def cheapest(turns):
    """Dynamic programme over (turns read, state): least (cost, edits), from the end; with the repaired turns."""
    n = len(turns)
    best = {}
    for i in range(n, -1, -1):
        here = {q: (0, "", ()) for q in (0, 3)} if i == n else {}

        def offer(q, cost, edit, rest, line):
            new = (rest[0] + cost, edit + rest[1], line + rest[2])
            if q not in here or new[:2] < here[q][:2]:
                here[q] = new
        if i < n:
            role, text, fault = turns[i]
            for q in range(4):
                if q in best[i + 1]:
                    offer(q, 4, "D", best[i + 1][q], ())
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 * (fault == "truncated")
                for r, edit, cost in [(role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)]:
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, r[:1]))
                    if to is not None and to in best[i + 1]:
                        offer(q, cost + more, edit, best[i + 1][to], ((r, text),))
        for _ in range(4):
            for q, r, to in [(0, "user", 2), (1, "user", 2), (2, "assistant", 3), (3, "user", 2)]:
                if to in here:
                    offer(q, 3, "I", here[to], ((r, ""),))
        best[i] = here
    return best[0][0]


def brute_repair(data, original):
    talks = defaultdict(list)
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        talks[conv].append((turn is not None, turn or 0, role, digest, text, turn))
    out = {}
    for conv in {r[0] for r in original}:
        turns = sorted(talks[conv])
        seen, faults, marked = set(), Counter(), []
        for *_, role, _d, text, _t in turns:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        cost, audit, left = cheapest(marked)
        numbers = {t[-1] for t in turns if t[-1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        first = [t[2][:1] if t[2][:1] in ("s", "u", "a") else "x" for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def as_dict(df):
    found = df.collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def random_talks(seed, count, longest):
    rng = random.Random(seed)
    data = []
    for c in range(count):
        for t in range(rng.randint(1, longest)):
            if rng.random() < 0.9:
                data.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "user", "assistant", None]),
                             rng.choice([None, "", " \t", "yes.", "no", "what? ", "fine!\n", f"t{rng.randint(0, 9)}.", f"t{rng.randint(0, 99)}"])))
    return data



@pytest.mark.parametrize("block,fan", [(64, 64), (3, 2), (4, 3)])
def test_repair_equals_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    data = random_talks(block, 25, 40)
    data += [(None, None, "user", "hot."), (None, None, "user", "hot."), (None, 4, "assistant", "end?"), (900, 2, None, None), (901, 7, "system", "only."), (902, -5, "", "x.")]
    data += data[:9]  # repeated rows
    original = spark.createDataFrame(data, TALKS).withColumn("key", F.lit(1)).withColumn("block", F.lit("x")).withColumn("digest", F.lit(2))
    assert as_dict(repair.repair_report(original)) == brute_repair(data, data)
    broken = list(brute_damage(data))
    assert as_dict(repair.repair_report(repair.damaged(original), original)) == brute_repair(broken, data)


def test_repair_query_and_turns(spark):
    talks = spark.read.parquet(f"{SMALL}/conversations.parquet")
    data = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    want = brute_repair(list(brute_damage(data)), data)
    assert as_dict(QUERIES["op11_repair"](spark, SMALL)) == want
    left = defaultdict(list)
    for r in repair.repaired_turns(repair.damaged(talks)).orderBy("conv_id", "block", "nth").collect():
        left[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(left[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    empty = spark.createDataFrame([], TALKS)
    assert repair.repair_report(empty).collect() == repair.repaired_turns(empty).collect() == []


def test_auction_prices_are_dual_feasible():
    rng = random.Random(1)
    for _ in range(200):
        code = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 12)))
        arcs = repair.lattice(code, True, [0, repair.FAR, repair.FAR, 0])
        prices = [0] * len(arcs)
        cost = repair.auction(arcs, prices, 0)
        assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for _, j, c in out)
        turns = [("user system assistant x".split()["usax".index(c.lower())] if c != "-" else "user", c, "truncated" if c.isupper() else "blank" if c == "-" else None) for c in code]
        assert cost == cheapest(turns)[0]


# ---- alignment ----

def brute_align(data):
    a_tok = Tokenizer.from_file(TOKENIZER)
    a_tok.no_truncation()
    a_tok.no_padding()
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    spelled_a = lambda i: bytes(letter[c] for c in a_tok.id_to_token(i))
    spelled_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in data:
        a = b = groups = links = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(spelled_a, a)) != whole or b"".join(map(spelled_b, b)) != whole:
                a = b = []
            ends = lambda ids, f: [sum(len(f(x)) for x in ids[:k + 1]) for k in range(len(ids))]
            ea, eb = _ends(a, spelled_a), _ends(b, spelled_b)
            common = sorted(set(ea) & set(eb))
            groups, links, i, j = [], [], 0, 0
            for c in common:
                k, m = ea.index(c, i) + 1, eb.index(c, j) + 1
                groups.append((a[i:k], b[j:m]))
                for x in range(i, k):
                    for y in range(j, m):
                        if max(ea[x] - len(spelled_a(a[x])), eb[y] - len(spelled_b(b[y]))) < min(ea[x], eb[y]):
                            links.append((a[x], b[y]))
                i, j = k, m
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    top = Counter()
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    for doc_id, a, b, groups, links in docs:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
               hashlib.sha256(said.encode()).hexdigest() if a else "")


def _ends(ids, f):
    out, at = [], 0
    for i in ids:
        at += len(f(i))
        out.append(at)
    return out


def test_alignment_equals_brute_force(spark, awkward, documents, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 20_000)
    odd = documents(rows("<|endoftext|> and <s> </s> <unk> <0x41>", "  two  spaces   three", "tab\tline\n\nfeed\r\n", "ÀÉ ﬁ ligature ½   nbsp", "日本語 😀👍🏽", "▁ a lone sign",
                         "x", " ", "\n", "a" * 3000, "don't WON'T 12345 ... !!!", "é combining"))
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = awkward.unionByName(odd).unionByName(small).withColumn("block", F.lit(1)).withColumn("pairs", F.lit(2))
    found, counts = align.alignment(docs, TOKENIZER, PIECES, digest=True)
    want = list(brute_align([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert sum(r.n for r in counts.collect()) == sum(w[4] for w in want)
    text = {r.doc_id: r.groups for r in align.alignment(docs, TOKENIZER, PIECES)[0].where("n_a < 9").collect()}
    assert all(hashlib.sha256(text[w[0]].encode()).hexdigest() == w[-1] for w in want if 0 < w[1] < 9 and w[0] is not None and w[0] > 100)


def test_alignment_special_tables(spark, documents):
    assert align.alignment(documents([]), TOKENIZER, PIECES)[0].collect() == []
    broken = spark.createDataFrame([(1, bytearray(b"ab \xff cd")), (2, bytearray(b"fine"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    got = {r.doc_id: tuple(r) for r in align.alignment(broken, TOKENIZER, PIECES, digest=True)[0].collect()}
    assert got[1] == (1, 0, 0, 0, 0, 0, 0, "") and got[2][1] > 0


# ---- language ----

def brute_language(data):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    words, grams = Counter(), Counter()
    for i, text, lang in data:
        if not held(i) and lang is not None:
            words.update((lang, w) for w in split(text))
    for (lang, w), n in words.items():
        for k in range(1, language.LONGEST + 1):
            for g in language.grams(w, k):
                grams[lang, g] += n
    langs = sorted({lang for lang, _ in words})

    def table(counts, limit):
        total = Counter()
        for (_, k), n in counts.items():
            total[k] += n
        return {k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]}

    import math
    tables = [(table(words, language.WORDS), words)]
    tables += [(table({k: n for k, n in grams.items() if len(k[1]) == size}, language.GRAMS // language.LONGEST), {k: n for k, n in grams.items() if len(k[1]) == size})
               for size in range(1, language.LONGEST + 1)]
    sums = [{lang: sum(n for (x, _), n in counts.items() if x == lang) for lang in langs} for _, counts in tables]

    def logs(t, key):
        known, counts = tables[t]
        return [math.log(counts.get((lang, key), 0) + language.SMOOTH) - math.log(sums[t][lang] + language.SMOOTH * len(known)) for lang in langs] if key in known else None

    for i, text, _ in data:
        found = []
        for w in split(text):
            score = logs(0, w)
            for size in range(language.LONGEST, 0, -1):
                if score is None:
                    some = [x for x in (logs(size, g) for g in language.grams(w, size)) if x]
                    score = [sum(x) / len(some) for x in zip(*some)] if some else None
            if score:
                found.append(score)
        mean = [sum(x) / len(found) for x in zip(*found)] if found else [0.0] * len(langs)
        if not split(text) or not langs:
            yield i, held(i), "und", 0.0
        else:
            yield i, held(i), langs[mean.index(max(mean))], 1 / sum(math.exp(m - max(mean)) for m in mean)


@pytest.mark.parametrize("words,grams", [(100_000, 100_000), (40, 300)])
def test_language_equals_brute_force(spark, awkward, monkeypatch, words, grams):
    monkeypatch.setattr(language, "WORDS", words)
    monkeypatch.setattr(language, "GRAMS", grams)
    docs = awkward.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").limit(80)).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("held_out", F.lit(3))
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in language.identified(docs).collect())
    want = Counter((i, h, p, round(s, 6)) for i, h, p, s in brute_language([(r.doc_id, r.text, r.lang) for r in docs.collect()]))
    assert got == want


def test_language_special_tables(documents):
    assert language.identified(documents([])).collect() == []
    unlabelled = documents([(1, SENTENCE, None, "a", 1), (2, None, "en", "a", 1)])
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.identified(unlabelled).collect())


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97
