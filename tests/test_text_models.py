"""Topic factorisation and TF-IDF over the whole vocabulary."""

import numpy as np
import pytest

from tidewater.operators import text as X


def test_nmf_parts_two_blocks(spark):
    a, b = ["apple", "pear", "plum", "fig"], ["bolt", "nut", "screw", "nail"]
    rows = [(i, w, 1.0 + (i * 7 + j) % 3) for i in range(20) for j, w in enumerate(a if i < 10 else b)]
    out = X.nmf_topics(spark.createDataFrame(rows, "doc_id long, term string, weight double"), k=2, words=4, iterations=12).collect()
    topics = {t: {r.term for r in out if r.topic == t and r.weight > 1e-3} for t in (0, 1)}
    assert sorted(map(sorted, topics.values())) == sorted([sorted(a), sorted(b)])


def test_tfidf_keeps_every_term(spark):
    docs = spark.createDataFrame([(i, [f"w{i}", f"w{i + 1}", "all"]) for i in range(1200)], "doc_id long, tokens array<string>")
    out = X.tfidf(docs, ngram_range=(1, 1))
    assert out.select("term").distinct().count() == 1202
    one = {r.term: r.weight for r in out.where("doc_id = 5").collect()}
    idf = {"all": 1.0, "w5": np.log(1201 / 3) + 1, "w6": np.log(1201 / 3) + 1}
    norm = np.sqrt(sum(x * x for x in idf.values()))
    assert one == {k: pytest.approx(x / norm, rel=1e-12) for k, x in idf.items()}


def test_stop_words_by_language(spark):
    df = spark.createDataFrame([(1, "the cat and house", "en"), (2, "le chat et la maison", "fr"), (3, "der Hund und das Haus", "de"),
                                (4, "el gato y la casa", "es"), (5, "the cat", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.processed for r in X.preprocess(df).collect()}
    assert got == {1: "cat house", 2: "chat maison", 3: "hund haus", 4: "gato casa", 5: "the cat"}


ODD_TEXTS = ["", " ", "@", "a@", "@a", "a@b", "@@a", "a@@", "ab@c@ d", "x @a@b y", "HTTPS://q.r www wwwx httpz a_b's 1a2\u00a0b", "it\u2019s <b>x</b> a<b",
             "0123 555-123-4567 z", "\u0130\u03a3 caf\u00e9 \U0001d7d8\U0001f600e", "a" * 300 + "@" + "b" * 5, "two\n\n\tlines , ; end"]


def test_clean_tokens_are_the_tokens_of_cleaned_text(spark):
    from pyspark.sql import functions as F

    from tidewater.functions import scalar as S
    t = F.lower("text")
    for pat in (S.URL_RE, S.EMAIL_TOKEN_RE, S.PHONE_TEXT_RE, S.HTML_TAG_RE):
        t = F.regexp_replace(t, pat, "")
    slow = S.squeeze(F.regexp_replace(t, S.NON_WORD, " "))
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "text string")
    for r in df.select("text", X.tokenize(slow).alias("want"), X.clean_tokens(F.col("text")).alias("got"),
                       slow.alias("clean"), X.preprocess_clean(F.col("text")).alias("now")).collect():
        assert (r.got, r.now) == (r.want, r.clean), r.text


def test_texts_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en")], "doc_id long, text string, lang string")
    plan = X.word_counts(X.preprocess(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<.*?>") == 1
    assert X.readability(df)._jdf.queryExecution().optimizedPlan().toString().count("[aeiouy]+") == 1


def test_ngrams_of_words(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    assert {r.ngram: r["count"] for r in X.ngrams(docs, 2).collect()} == {"a b": 2, "b a": 1}
    assert {r.ngram: r["count"] for r in X.ngrams(docs, 3).collect()} == {"a b a": 1, "b a b": 1}


def test_sentiment_distribution_in_one_pass(spark):
    rows = [(1, "positive", 0.5, 1.0), (2, "negative", -0.2, 0.5), (3, "neutral", 0.0, 0.0), (4, "positive", 0.9, 0.1)]
    out = X.sentiment_distribution(spark.createDataFrame(rows, "doc_id long, label string, polarity double, subjectivity double"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {r.label: (r["count"], round(r.avg_polarity, 9), round(r.avg_subjectivity, 9), r.overall) for r in out.collect()}
    assert got == {k: (n, 0.3, 0.4, "positive") for k, n in (("positive", 2), ("negative", 1), ("neutral", 1))}


def test_tfidf_counts_terms_where_their_document_lies(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    out = X.tfidf(docs, ngram_range=(1, 1))
    assert {(r.doc_id, r.term): r.tf for r in out.collect()} == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1}
    assert "hashpartitioning(doc_id" in out._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(doc_id" in x and "term" in x.split("hashpartitioning")[1]
                   for x in out._jdf.queryExecution().executedPlan().toString().splitlines())


def test_sequences_of_long_and_odd_texts(spark):
    from collections import Counter

    from tidewater.operators import langid as LI
    texts = {1: "abcabc", 2: "ab", 3: "\U0001f600\u0130\u00e9x" * 3, 4: "AbC\x00d e", 5: "", 6: "xyzzy" * 40_000}
    df = spark.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string")
    got = {(r.doc_id, r.gram): r.c for r in LI.gram_counts(df, extra=["text"]).groupBy("doc_id", "gram").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").collect()}
    low = {k: x.lower() for k, x in texts.items() if len(x) >= 3}
    assert got == {(k, g): n for k, x in low.items() for g, n in Counter(x[i:i + 3] for i in range(len(x) - 2)).items()}
    # places in strings are not looked up one by one, which took the square of the length
    assert "substring" not in LI.gram_counts(df)._jdf.queryExecution().optimizedPlan().toString()


def test_sequences_across_pieces():
    from tidewater.operators import langid as LI
    text = "abcde" * 50
    whole = {g: c for _, g, c in zip(*LI._counted([text], 3))}
    pieces = [text[at:at + 7 + 2] for at in range(0, len(text) - 2, 7)]
    total = {}
    for _, g, c in zip(*LI._counted(pieces, 3)):
        total[g] = total.get(g, 0) + c
    assert total == whole


def test_tfidf_vectors_are_read_as_they_are_kept(spark, tmp_path):
    """As an array of the whole vocabulary each row had 2 MB."""
    import __spark_entry__ as entry
    rows = [(i, f"apple w{'abcdefgh'[i]}x pear", "en", "web", 10) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["text_tfidf_vec"](spark, str(tmp_path))
    assert "vector_to_array" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "unwrap_udt" in plan.lower()
    # apple and pear are in every text and weigh 0
    assert [(r.nnz, round(r.sq_norm, 9)) for r in out.collect()] == [(1, 1.0)] * 8


def test_large_row_groups_are_sliced(spark, tmp_path):
    import os

    from tidewater.sources.tables import sliced
    rows = [(i, os.urandom(2000).hex()) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert sliced(df, size // 20).rdd.getNumPartitions() >= 20
    assert sorted(sliced(df, size // 20).collect()) == sorted(rows)
    assert sliced(df, size).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def _left(spark, run):
    """The result of ``run`` and what it left of written copies and checkpoints."""
    import os

    from tidewater.session import ensure_checkpoint_dir, shared_dir
    kept, copies = ensure_checkpoint_dir(spark).removeprefix("file:"), os.path.join(shared_dir(spark).removeprefix("file:"), "tidewater")
    seen = lambda: {os.path.join(d, x) for d in (kept, copies) if os.path.isdir(d) for x in os.listdir(d) if x.startswith("rdd-") or d == copies}
    before = seen()
    out = run().collect()
    return out, len(seen() - before)


def test_textrank_keeps_no_round_on_disk(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "c", "d"]), (2, ["e"]), (3, ["a", "a", "b", "c"]), (4, [])], "doc_id long, tokens array<string>")
    out, left = _left(spark, lambda: X.textrank(docs))
    names, m = ["a", "b", "c", "d", "e"], np.zeros((5, 5))
    for t in (["a", "b", "a", "c", "d"], ["a", "a", "b", "c"]):
        for s in range(len(t) - 3):
            for i in range(s, s + 4):
                for j in range(i + 1, s + 4):
                    m[names.index(t[i]), names.index(t[j])] += 1
                    m[names.index(t[j]), names.index(t[i])] += 1
    share, x = m / np.maximum(m.sum(0), 1), np.ones(5)
    for _ in range(10):
        x = 0.85 + 0.15 * share @ x
    assert {r.word: r.score for r in out} == {n: pytest.approx(v, abs=1e-12) for n, v in zip(names, x)}
    assert left == 2  # the words and the last scores; all rounds were left before


def test_nmf_keeps_no_update_on_disk(spark):
    rows = [(i, f"w{(i + j) % 7}", 1.0 + (i * j) % 3) for i in range(9) for j in range(3)] + [(None, "w1", 1.0)]
    out, left = _left(spark, lambda: X.nmf_topics(spark.createDataFrame(rows, "doc_id long, term string, weight double"), k=2, words=7, iterations=2))
    assert len(out) == 14 and left == 2  # the terms and the last topics; every update was left before
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_textrank_over_tiles_of_blocks(spark, monkeypatch):
    """All pairs went through a join and a shuffle in each round, one row for each pair and direction."""
    from tidewater.plans import pairs as P
    texts = [[f"w{(i * i + 3 * j * j) % 41}" for j in range(4 + i % 30)] for i in range(60)] + [["x", None, "y", "x", "x", "y"], [], None, ["only"], ["w1"] * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(5)
    monkeypatch.setattr(P, "TILE", 1200)
    chunks = P.chunked(docs)
    assert (blocks := P.blocks_for(chunks, 4)) > 1
    tiles = X.cooccurrence_edges(chunks, P.numbered(chunks, blocks)).collect()
    assert len({(r.lo, r.hi) for r in tiles}) == len(tiles) <= blocks * (blocks + 1) // 2 and all(r.lo <= r.hi for r in tiles)
    names = sorted({w for t in texts for w in t or [] if w is not None})
    m = np.zeros((len(names), len(names)))
    for t in texts:
        for s in range(len(t or []) - 3):
            for i in range(s, s + 4):
                for j in range(i + 1, s + 4):
                    if t[i] is not None and t[j] is not None:
                        m[names.index(t[i]), names.index(t[j])] += 1
                        m[names.index(t[j]), names.index(t[i])] += 1
    share, x = m / np.maximum(m.sum(0), 1), np.ones(len(names))
    for _ in range(10):
        x = 0.85 + 0.15 * share @ x
    got = {r.word: r.score for r in X.textrank(docs).collect()}
    assert got == {n: pytest.approx(v, abs=1e-12) for n, v in [*zip(names, x), (None, 0.85)]}
    assert X.textrank(docs.where("false")).collect() == []


@pytest.mark.parametrize("query", ["text_coherence", "text_lda_coherence"])
def test_coherence_keeps_no_rows_in_memory(spark, tmp_path, monkeypatch, query):
    """Tokens and their counts were cached in the executors' heaps, and the tokens stayed there."""
    import __spark_entry__ as entry
    from pyspark import StorageLevel
    rows = [(i, " ".join(f"{w}{'abcdefgh'[(i * j) % 8]}" for j, w in enumerate(("apple", "pear", "plum", "fig") * 4)), "en", "web", 10) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept, levels = spark._jsc.sc().getPersistentRDDs, []
    frame = type(spark.range(1))
    before, keep = kept().size(), frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, level=StorageLevel.MEMORY_AND_DISK_DESER: levels.append(level) or keep(df, level))
    monkeypatch.setattr(frame, "cache", lambda df: df.persist())
    out = entry.queries()[query](spark, str(tmp_path)).collect()
    assert len(levels) == 2 and not any(x.useMemory for x in levels)
    assert len(out) == 5 and kept().size() <= before


def test_tfidf_moves_terms_twice(spark):
    """Terms were made and counted twice, and moved by term, by term with their rank, and by document as five wide columns."""
    docs = spark.createDataFrame([(i, [f"w{i % 3}", "all", f"w{i % 5}"]) for i in range(30)] + [(None, ["all", "w1"]), (31, []), (32, None)], "doc_id long, tokens array<string>")
    out = X.tfidf(docs, ngram_range=(1, 1))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan and plan.count("RepartitionByExpression") == 1  # made from the written counts
    rows = {(r.doc_id, r.term): r for r in out.collect()}
    want = {(i, w): [f"w{i % 3}", "all", f"w{i % 5}"].count(w) for i in range(30) for w in (f"w{i % 3}", "all", f"w{i % 5}")} | {(None, "all"): 1, (None, "w1"): 1}
    assert {k: r.tf for k, r in rows.items()} == want
    df = {w: sum(k[1] == w for k in want) for _, w in want}
    idf = {w: np.log(34 / (1 + n)) + 1 for w, n in df.items()}
    norm = {i: np.sqrt(sum((n * idf[w]) ** 2 for (j, w), n in want.items() if j == i)) for i, _ in want}
    assert all(r.idf == pytest.approx(idf[w]) and r.weight == pytest.approx(r.tf * idf[w] / norm[i]) for (i, w), r in rows.items())
    top = X.tfidf(docs, ngram_range=(1, 1), max_features=2).collect()
    assert {r.term for r in top} == {"all", "w1"} and {r.idf for r in top if r.term == "all"} == {rows[0, "all"].idf}


def test_nmf_deals_its_cells_once(spark, monkeypatch):
    """Every update dealt the whole matrix to its parts twice."""
    rows = [(i, f"w{(i + j) % 7}", 1.0 + (i * j) % 3) for i in range(9) for j in range(3)]
    frame, dealt = type(spark.range(1)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *a: dealt.append(df.columns) or deal(df, *a))
    kept = spark._jsc.sc().getPersistentRDDs
    before = kept().size()
    assert len(X.nmf_topics(spark.createDataFrame(rows, "doc_id long, term string, weight double"), k=2, words=7, iterations=3).collect()) == 14
    assert dealt.count(["p", "t", "d", "v"]) == 1 and kept().size() <= before
