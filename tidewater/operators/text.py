"""Text analytics (X1-X26) over a corpus DataFrame (doc_id, text[, lang]).

Per-document work is array expressions on the row (regexp, split, filter,
transform): JVM-side, inside whole-stage codegen, no Python. Corpus-level
work is explode + grouped aggregation (map-side combined, so a very common
word is pre-aggregated in every task). Vocabularies that get joined back are
bounded by construction (``max_features``) or left to AQE's size check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.lexicons import (BASIC_STOPWORDS, LANGUAGE_PROFILES, SENTIMENT_SEED,
                                          STOPWORDS)
from tidewater.functions.scalar import (HTML_TAG_RE, NON_WORD, PHONE_TEXT_RE, clean_text, squeeze,
                                        syllables)
from tidewater.plans import pairs as P
from tidewater.session import drop_staged, staged

# Word pattern (letters first, then letters, digits, _ or ') and sentence split.
WORD_RE = r"\p{L}[\p{L}\p{N}_']*"
SENTENCE_SPLIT_RE = r"[.!?]+"
# The same matches as URL_RE and EMAIL_TOKEN_RE without going back over each run of characters.
URL_FAST_RE = r"(?:http|www)\S+"
EMAIL_TOKEN_FAST_RE = r"(?<!\S)\S+@\S+"
# What parts the tokens of cleaned text: NON_WORD and white space.
NOT_CLEAN_RE = r"[^\p{L}\p{N}_]+"

# Entity patterns (re-aim of named-entity extraction).
ENTITY_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s<>\"']+|www\.[^\s<>\"']+",
    "phone": PHONE_TEXT_RE,
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}",
    "code": r"\b[A-Z]{2,4}\d{4,8}\b",
}


def corpus(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, extra...) with null texts dropped."""
    return df.select(id_col, F.col(text_col).alias("text"), *extra).where(F.col("text").isNotNull())


# --- X1-X5: preprocessing ------------------------------------------------------

def _stripped(text: Column) -> Column:
    """Lowercase, without URLs / e-mails / phones / HTML tags."""
    t = F.lower(text)
    for pat in (URL_FAST_RE, EMAIL_TOKEN_FAST_RE, PHONE_TEXT_RE, HTML_TAG_RE):
        t = F.regexp_replace(t, pat, "")
    return t


def preprocess_clean(text: Column, remove_numbers: bool = False) -> Column:
    """The cleaning step of the default preprocessing config: lowercase, strip
    URLs / e-mails / phones / HTML tags, punctuation -> space, squeeze."""
    t = F.regexp_replace(_stripped(text), NON_WORD, " ")
    if remove_numbers:
        t = F.regexp_replace(t, r"\d+", "")
    return squeeze(t)


def tokenize(text: Column) -> Column:
    """X2 (SEM-17): whitespace tokens of cleaned text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_tokens(text: Column, remove_numbers: bool = False) -> Column:
    """``tokenize(preprocess_clean(text))``. What cleaning turns into spaces only parts tokens, so they are cut out in one pass."""
    if remove_numbers:
        return tokenize(preprocess_clean(text, remove_numbers))
    return F.filter(F.split(_stripped(text), NOT_CLEAN_RE), lambda w: w != "")


def exploded(tokens: str) -> Column:
    """The array column as an expression to explode. Of a bare column Spark first asks whether the array is
    empty, below the projection that makes it, and so would clean each text twice."""
    return F.concat(F.col(tokens))


def word_tokens(text: Column) -> Column:
    """Words of raw text: a letter followed by letters, digits, _ or '."""
    return F.regexp_extract_all(text, F.lit(WORD_RE), 0)


def remove_stopwords(tokens: Column, lang: Column | None = None, lists: dict[str, Sequence[str]] | None = None,
                     custom: Sequence[str] = (), default: str = "en") -> Column:
    """Drop tokens whose lowercase form is a stop word of the row's language or a
    custom word. One branch per language, each a test against a constant set; a
    language without a list loses custom words only."""
    lists = lists or STOPWORDS

    def without(words: Sequence[str]) -> Column:
        stop = sorted({*words, *custom})
        return F.filter(tokens, lambda t: ~F.lower(t).isin(stop)) if stop else tokens
    if lang is None:
        return without(lists.get(default, ()))
    return F.coalesce(*[F.when(lang == k, without(v)) for k, v in lists.items()], without(()))


def filter_tokens(tokens: Column, min_len: int = 2, max_len: int = 20) -> Column:
    """Keep alphabetic tokens of length min..max."""
    return F.filter(tokens, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & t.rlike(r"^\p{L}+$"))


def preprocess(df: DataFrame, lang_col: str | None = "lang", stop_lists: dict | None = None,
               custom_stopwords: Sequence[str] = (), lemmas: DataFrame | None = None,
               min_len: int = 2, max_len: int = 20, remove_numbers: bool = False) -> DataFrame:
    """Clean -> tokens -> stop words -> normalise (optional lemma table) -> filter.
    Adds ``tokens`` (array) and ``processed`` (space-joined)."""
    lang = F.col(lang_col) if lang_col else None
    out = df.withColumn("tokens", clean_tokens(F.col("text"), remove_numbers))
    out = out.withColumn("tokens", remove_stopwords(F.col("tokens"), lang, stop_lists, custom_stopwords))
    if lemmas is not None:
        out = normalize_tokens(out, lemmas)
    out = out.withColumn("tokens", filter_tokens(F.col("tokens"), min_len, max_len))
    return out.withColumn("processed", F.array_join("tokens", " "))


def derived_lemmas(docs: DataFrame, min_len: int = 4) -> DataFrame:
    """A lemma table derived from the corpus itself: plural 'xs' -> 'x' when 'x' is
    also a word of the corpus (a Spark job over the vocabulary)."""
    vocab = docs.select(F.explode(exploded("tokens")).alias("token")).distinct()
    plural = vocab.where(F.col("token").endswith("s") & (F.length("token") >= min_len)) \
        .select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return plural.join(vocab.withColumnRenamed("token", "lemma"), "lemma", "left_semi")


def normalize_tokens(df: DataFrame, lemmas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Replace tokens through a (token, lemma) table, keeping token order.

    Tokens are exploded with their position, joined to the lemma table (a
    normal equi-join; AQE broadcasts it when it is small) and re-collected per
    document in position order."""
    ex = df.select(id_col, F.posexplode(exploded("tokens")).alias("pos", "token"))
    mapped = ex.join(lemmas.select("token", "lemma"), "token", "left") \
        .select(id_col, "pos", F.coalesce("lemma", "token").alias("token"))
    back = mapped.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("_norm"))
    return (df.join(back, id_col, "left")
            .withColumn("tokens", F.coalesce(F.col("_norm"), F.array().cast("array<string>"))).drop("_norm"))


# --- X6 / X7: statistics -----------------------------------------------------------

def text_stats(df: DataFrame) -> DataFrame:
    """Count, avg/max/min length and words, totals."""
    n_chars = F.length("text")
    n_words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    per = df.select(n_chars.alias("c"), n_words.alias("w"))
    return per.agg(F.count(F.lit(1)).alias("total_texts"), F.avg("c").alias("avg_text_length"),
                   F.max("c").alias("max_text_length"), F.min("c").alias("min_text_length"),
                   F.avg("w").alias("avg_word_count"), F.max("w").alias("max_word_count"),
                   F.min("w").alias("min_word_count"), F.sum("c").alias("total_characters"),
                   F.sum("w").alias("total_words"))


# --- X8: language -------------------------------------------------------------------------

def profile_table(spark: SparkSession, profiles: dict[str, Sequence[str]] | None = None) -> DataFrame:
    profiles = profiles or LANGUAGE_PROFILES
    return spark.createDataFrame([(lang, w) for lang, ws in profiles.items() for w in sorted(set(ws))],
                                 "lang string, token string")


def detect_language(df: DataFrame, profiles: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """X8 (re-aim): per document, the language whose stop-word profile matches
    most tokens (ties -> alphabetical); documents with no match -> 'unknown'.
    The fixed profile table is broadcast, so no token is shuffled; for another one that is left to AQE's size check."""
    prof = profiles if profiles is not None else F.broadcast(profile_table(df.sparkSession))
    toks = df.select(id_col, F.explode(word_tokens(F.lower(F.col("text")))).alias("token"))
    hits = toks.join(prof, "token").groupBy(id_col, "lang").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy(id_col).agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("detected"),
                                    F.max("score").alias("score"))
    return (df.select(id_col).join(best, id_col, "left")
            .select(id_col, F.coalesce("detected", F.lit("unknown")).alias("detected"),
                    F.coalesce("score", F.lit(0)).cast("long").alias("score")))


# --- X9: entities -----------------------------------------------------------------------------

def extract_entities(df: DataFrame, id_col: str = "doc_id", patterns: dict[str, str] | None = None) -> DataFrame:
    """X9 (re-aim): distinct pattern entities per document and kind."""
    patterns = patterns or ENTITY_PATTERNS
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 0).alias("found"))
                      for k, p in patterns.items()])
    ex = (df.select(id_col, F.explode(parts).alias("s"))
          .select(id_col, "s.kind", F.explode("s.found").alias("entity")))
    return ex.distinct()


# --- X10-X12: sentiment ------------------------------------------------------------------------

def lexicon_table(spark: SparkSession, lexicon: dict | None = None) -> DataFrame:
    lexicon = lexicon or SENTIMENT_SEED
    return spark.createDataFrame([(k, float(p), float(s)) for k, (p, s) in sorted(lexicon.items())],
                                 "token string, polarity double, subjectivity double")


def sentiment(df: DataFrame, lexicon: DataFrame | None = None, id_col: str = "doc_id",
              threshold: float = 0.1) -> DataFrame:
    """Mean lexicon polarity / subjectivity of the matched words (0 when no
    word matches), label at +-threshold, confidence = |polarity|. The fixed lexicon is broadcast, so no
    token is shuffled; for another one that is left to AQE's size check."""
    lex = lexicon if lexicon is not None else F.broadcast(lexicon_table(df.sparkSession))
    toks = df.select(id_col, F.explode(word_tokens(F.lower(F.col("text")))).alias("token"))
    scored = toks.join(lex, "token").groupBy(id_col).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"),
        F.count(F.lit(1)).alias("matched"))
    out = df.select(id_col).join(scored, id_col, "left").na.fill(0.0, ["polarity", "subjectivity"]) \
        .na.fill(0, ["matched"])
    p = F.col("polarity")
    return out.select(id_col, "polarity", "subjectivity", F.col("matched").cast("long").alias("matched"),
                      F.when(p > threshold, "positive").when(p < -threshold, "negative")
                      .otherwise("neutral").alias("label"), F.abs(p).alias("confidence"))


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """X11: label counts with the corpus averages and the overall label."""
    marks = ("polarity", "subjectivity")
    counts = scored.groupBy("label").agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(f"s_{c}") for c in marks],
                                         *[F.count(c).alias(f"n_{c}") for c in marks])
    every = Window.partitionBy()  # over one row per label
    out = counts.select("label", "count", *[(F.sum(f"s_{c}").over(every) / F.sum(f"n_{c}").over(every)).alias(f"avg_{c}") for c in marks])
    p = F.col("avg_polarity")
    return out.withColumn("overall", F.when(p > 0.1, "positive").when(p < -0.1, "negative").otherwise("neutral"))


# --- X13-X16: frequencies and n-grams -----------------------------------------------------

def word_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.select(F.explode(exploded(tokens)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def top_words(docs: DataFrame, k: int = 10, tokens: str = "tokens") -> DataFrame:
    """Most frequent words (ties -> alphabetical)."""
    return word_counts(docs, tokens).orderBy(F.desc("count"), "word").limit(k)


def simple_keywords(df: DataFrame, k: int = 10) -> DataFrame:
    """X13, simple extractor: clean_text words minus the basic stop list, length > 2."""
    words = F.filter(F.split(clean_text(F.col("text")), " "), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in sorted(set(BASIC_STOPWORDS))])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))
    return top_words(df.select(kept.alias("tokens")), k)


def word_weights(docs: DataFrame, k: int = 20, tokens: str = "tokens") -> DataFrame:
    """Top-k words with weight = count / max count."""
    top = top_words(docs, k, tokens)
    mx = F.max("count").over(Window.partitionBy())  # over <= k rows
    return top.withColumn("weight", F.col("count") / mx)


def ngram_array(tokens: Column, n: int) -> Column:
    """n-grams of one document (never across documents)."""
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - n),
                       lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))


def ngrams(docs: DataFrame, n: int = 2, tokens: str = "tokens") -> DataFrame:
    """(ngram, count) over the corpus."""
    t = F.col(tokens)
    grams = F.when(F.size(t) >= n, ngram_array(t, n)).otherwise(F.array().cast("array<string>"))  # no bare column, see exploded
    return docs.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


def top_ngrams(docs: DataFrame, n: int = 2, k: int = 20, tokens: str = "tokens") -> DataFrame:
    return ngrams(docs, n, tokens).orderBy(F.desc("count"), "ngram").limit(k)


def ngram_totals(docs: DataFrame, n: int = 2, tokens: str = "tokens") -> DataFrame:
    g = ngrams(docs, n, tokens)
    return g.agg(F.count(F.lit(1)).alias("unique_ngrams"), F.sum("count").alias("total_ngrams"))


# --- X17 / X25: TF-IDF ----------------------------------------------------------------------

def tfidf(docs: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", max_features: int | None = None,
          ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """X17 (SEM-19): (doc_id, term, tf, idf, weight) with raw counts, smoothed
    idf = ln((1 + n) / (1 + df)) + 1 and L2-normalised rows, over the whole
    vocabulary. ``max_features`` keeps the most frequent terms only (ties ->
    alphabetical). Terms are counted once, where their documents lie, and go to their term's partition for
    the document frequency; that table is written, and the weights are made from it."""
    t = F.col(tokens)
    grams = F.array().cast("array<string>")
    for n in range(ngram_range[0], ngram_range[1] + 1):
        g = F.when(F.size(t) >= n, ngram_array(t, n)).otherwise(F.array().cast("array<string>"))
        grams = F.concat(grams, g)
    # the tokens go to their document's partition, so that the terms made there are counted without a shuffle of their own
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = docs.select(id_col, tokens).repartition(parts, F.col(id_col)).select(id_col, F.explode(grams).alias("term"))
    tf = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = docs.count()
    if max_features is not None:
        kept = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("cf"), "term").limit(max_features)
        counted = tf.join(kept.select("term", "df"), "term").select(id_col, "term", "tf", "df")
    else:
        counted = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))  # a document's row once: as many rows as documents at most
    # the shuffle files up to here go before the terms are dealt by document again, with two counts that take few bytes
    cells = staged(counted, "term_counts", "zstd", tidy=True).repartition(parts, F.col(id_col))
    w = cells.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(id_col)))  # one document's terms
    return w.select(id_col, "term", "tf", "idf", (raw / norm).alias("weight"))


def tfidf_keywords(weights: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """Mean TF-IDF score per term over all documents, top k."""
    return (weights.groupBy("term").agg((F.sum("weight") / n_docs).alias("mean_score"))
            .orderBy(F.desc("mean_score"), "term").limit(k))


# --- X18: TextRank --------------------------------------------------------------------------

def cooccurrence_edges(chunks: DataFrame, words: DataFrame, window: int = 4) -> DataFrame:
    """Symmetric co-occurrence counts of words at distance 1..window-1 inside sliding windows of ``window`` words,
    within each document, as tiles of pairs of numbered words (see ``plans.pairs``)."""
    return P.window_pairs(chunks, words, window)


def textrank(docs: DataFrame, tokens: str = "tokens", iterations: int = 10, damping: float = 0.15,
             window: int = 4) -> DataFrame:
    """X18 (SEM-20): score_i = (1 - damping) + damping * sum_j w_ij * score_j / rowsum_j,
    10 rounds from 1.0 (damping 0.15 reproduces the reference's reversed constant).
    Words are numbered, scores lie in blocks, and each round is one product with the written tiles of pairs. A round's shuffle
    files and the scores before it go when it has ended, so the disk holds one round, not all."""
    chunks = staged(P.chunked(docs, tokens), "chunks", "zstd", tidy=True)  # the text pipeline runs once
    blocks = P.blocks_for(chunks, window)
    vocab = staged(P.numbered(chunks, blocks), "words", tidy=True)
    edges = staged(cooccurrence_edges(chunks, vocab, window), "edges", tidy=True)
    drop_staged(chunks)
    state = "b int, score binary, rowsum binary"
    empty = F.lit(None).cast("binary")

    def first(table: pa.Table) -> pa.Table:
        n = pc.max(table["n"]).as_py()
        return row(table, np.ones(n), P.added(table, n))

    def following(table: pa.Table) -> pa.Table:
        own = table.filter(table["score"].is_valid())
        rowsum = np.frombuffer(own["rowsum"][0].as_buffer())
        return row(own, (1.0 - damping) + damping * P.added(table, len(rowsum)), rowsum)

    def row(table: pa.Table, score: np.ndarray, rowsum: np.ndarray) -> pa.Table:
        return pa.table({"b": table["b"].slice(0, 1), "score": pa.array([score.tobytes()], pa.binary()), "rowsum": pa.array([rowsum.tobytes()], pa.binary())})

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[np.frombuffer(x.as_buffer()) for x in two] for two in zip(batch["score"], batch["rowsum"])]
            yield pa.RecordBatch.from_arrays([batch["b"], pa.array([np.divide(s, r, out=np.zeros(len(s)), where=r > 0).tobytes() for s, r in pairs], pa.binary())], names=["b", "x"])

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["b"], pa.array([np.ones(n).tobytes() for n in batch["n"].to_pylist()], pa.binary())], names=["b", "x"])

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in zip(batch["b"].to_pylist(), batch["score"]):
                score = np.frombuffer(x.as_buffer())
                for at in range(0, len(score), 1 << 16):
                    part = score[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, "int32")), pa.array(np.arange(at, at + len(part), dtype="int32")), pa.array(part)], names=["b", "at", "score"])

    sizes = vocab.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    rowsums = P.product(edges, sizes.mapInArrow(ones, "b int, x binary"), blocks)
    both = sizes.select("b", "n", F.lit(None).cast("int").alias("other"), empty.alias("s")).unionByName(
        rowsums.select("b", F.lit(None).cast("long").alias("n"), "other", "s"))
    scores = staged(both.groupBy("b").applyInArrow(first, state), "scores", tidy=True)
    for _ in range(iterations):
        came = P.product(edges, scores.mapInArrow(shares, "b int, x binary"), blocks)
        both = scores.select("*", F.lit(None).cast("int").alias("other"), empty.alias("s")).unionByName(
            came.select("b", empty.alias("score"), empty.alias("rowsum"), "other", "s"))
        last, scores = scores, staged(both.groupBy("b").applyInArrow(following, state), "scores", tidy=True)
        drop_staged(last)
    drop_staged(edges)
    return vocab.join(scores.mapInArrow(spread_out, "b int, at int, score double"), ["b", "at"]).select("word", "score")


# --- X22 / X23: readability ----------------------------------------------------------------

def readability(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document Flesch reading ease, Flesch-Kincaid grade and Gunning fog
    (documents without sentences or words are skipped)."""
    sents = F.filter(F.split(F.col("text"), SENTENCE_SPLIT_RE), lambda s: F.trim(s) != "")
    # words and syllables once for each text: a filter on a plain column would be worked out again below the projection
    cut = df.select(id_col, F.transform(word_tokens(F.col("text")), lambda w: syllables(w)).alias("syl"), F.size(sents).alias("ns"))
    per = cut.select(id_col, F.inline(F.array(F.struct(
        F.size("syl").alias("nw"), "ns", F.aggregate("syl", F.lit(0), lambda acc, x: acc + x).alias("nsyl"),
        F.size(F.filter("syl", lambda x: x >= 3)).alias("ncomplex"))))).where((F.col("nw") > 0) & (F.col("ns") > 0))
    wps = F.col("nw") / F.col("ns")
    spw = F.col("nsyl") / F.col("nw")
    return per.select(id_col,
                      (206.835 - 1.015 * wps - 84.6 * spw).alias("flesch_reading_ease"),
                      (0.39 * wps + 11.8 * spw - 15.59).alias("flesch_kincaid_grade"),
                      (0.4 * (wps + 100 * F.col("ncomplex") / F.col("nw"))).alias("gunning_fog"))


READABILITY_METRICS = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"]


def readability_summary(per_doc: DataFrame) -> DataFrame:
    """Average / min / max / population std per metric."""
    aggs = []
    for m in READABILITY_METRICS:
        aggs += [F.avg(m).alias(f"{m}__average"), F.min(m).alias(f"{m}__min"),
                 F.max(m).alias(f"{m}__max"), F.stddev_pop(m).alias(f"{m}__std")]
    wide = per_doc.agg(*aggs)
    structs = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{s}").alias(s) for s in ("average", "min", "max", "std")])
               for m in READABILITY_METRICS]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def readability_simple(df: DataFrame, id_col: str = "doc_id", digits: int | None = 2) -> DataFrame:
    """sentences = pieces of split('.'), words = whitespace split,
    flesch = 206.835 - 1.015 * words/sentences - 84.6 * average word length (rounded 2)."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    n_sent = F.size(F.split(F.col("text"), r"\.", -1))
    nw = F.size(words)
    total_len = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda a, x: a + x)
    asl = F.when(n_sent > 0, nw / n_sent).otherwise(0.0)
    awl = F.when(nw > 0, total_len / nw).otherwise(0.0)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.where(F.length("text") > 0).select(
        id_col, rnd(206.835 - 1.015 * asl - 84.6 * awl).alias("flesch_score"),
        rnd(asl).alias("avg_sentence_length"), rnd(awl).alias("avg_word_length"))


# --- X19-X21, X24, X25: model-based text features ------------------------------------------

def count_vectors(docs: DataFrame, tokens: str = "tokens", vocab_size: int = 1 << 18, min_df: float = 1.0):
    """Bag of words with MLlib. Its vocabulary lives in the driver, so it holds the
    ``vocab_size`` most frequent terms (MLlib's default of 262,144)."""
    from pyspark.ml.feature import CountVectorizer
    model = CountVectorizer(inputCol=tokens, outputCol="counts", vocabSize=vocab_size, minDF=min_df).fit(docs)
    return model, model.transform(docs)


def on_disk(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks, in the partitions it has. Kept in memory, it would fill each executor's heap with rows."""
    return df.persist(StorageLevel.DISK_ONLY)


def lda_topics(docs: DataFrame, k: int = 5, words: int = 10, seed: int = 42, max_iter: int = 10,
               tokens: str = "tokens") -> DataFrame:
    """LDA topics as (topic, rank, term, weight)."""
    from pyspark.ml.clustering import LDA
    cv, counted = count_vectors(docs, tokens)
    counted = on_disk(counted.select("counts"))  # read in every round
    model = LDA(k=k, seed=seed, maxIter=max_iter, featuresCol="counts").fit(counted)
    counted.unpersist()
    vocab = cv.vocabulary
    rows = [(int(r["topic"]), i + 1, vocab[t], float(w))
            for r in model.describeTopics(words).collect()
            for i, (t, w) in enumerate(zip(r["termIndices"], r["termWeights"]))]
    return docs.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")


def umass_coherence(docs: DataFrame, topics: DataFrame, tokens: str = "tokens") -> DataFrame:
    """UMass coherence per topic, sum over ordered top-word pairs of
    log((D(wi, wj) + 1) / D(wj)) with document co-occurrence counts. Only the
    top words of the topics are looked at, so per document at most
    (words per topic)^2 pairs are formed."""
    top = topics.select("topic", "rank", "term")
    terms = top.select("term").distinct()
    present = staged(docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("term")).join(terms, "term"), "present")  # read three times
    df1 = present.groupBy("term").agg(F.count(F.lit(1)).alias("d1"))
    a = top.withColumnRenamed("term", "wi").withColumnRenamed("rank", "ri")
    b = top.withColumnRenamed("term", "wj").withColumnRenamed("rank", "rj")
    pairs = a.join(b, "topic").where(F.col("ri") > F.col("rj"))
    pa = present.withColumnRenamed("term", "wi")
    pb = present.withColumnRenamed("term", "wj")
    co = pa.join(pb, "doc_id").join(pairs.select("wi", "wj").distinct(), ["wi", "wj"]) \
        .groupBy("wi", "wj").agg(F.count(F.lit(1)).alias("d2"))
    scored = pairs.join(co, ["wi", "wj"], "left").join(df1.withColumnRenamed("term", "wj"), "wj", "left")
    val = F.log((F.coalesce("d2", F.lit(0)) + 1.0) / F.col("d1"))
    return scored.groupBy("topic").agg(F.sum(val).alias("umass"))


def nmf_topics(weights: DataFrame, k: int = 5, words: int = 10, seed: int = 42, id_col: str = "doc_id",
               iterations: int = 10) -> DataFrame:
    """Non-negative factorisation V = W H of the whole sparse (doc, term, weight)
    matrix, absent cells being zeros, by multiplicative updates; top terms per topic.

    V, with numbers for terms, lies in parts by term. A part gets the rows of H of its terms and each row of W that it
    needs once, so that no product of a cell is shuffled for H, and for W only a part's sums by document are. The k x k
    Gram matrix of the other factor is the only thing collected. The shuffle files of an update and the factor before it go
    when it has ended, so the disk holds one update, not all.
    """
    spark = weights.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    comps = range(k)

    def start(of: DataFrame, key: str, salt: int, *more: Column) -> DataFrame:
        return staged(of.select(*more, *[
            ((F.pmod(F.xxhash64(F.col(key), F.lit(i), F.lit(seed + salt)), F.lit(1_000_000)) + 1) / 1e6).alias(f"f{i}") for i in comps]), "nmf_start", tidy=True)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "p")

    def updated(own: DataFrame, keys: list[str], other: DataFrame, met: DataFrame) -> DataFrame:
        gram = other.agg(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g{i}_{j}") for i in comps for j in comps]).first()
        top = met.groupBy(*keys).agg(*[F.sum(F.col("v") * F.col(f"f{i}")).alias(f"n{i}") for i in comps])
        scaled = []
        for i in comps:
            below = F.lit(1e-12)
            for j in comps:
                below = below + F.col(f"f{j}") * float(gram[f"g{j}_{i}"] or 0.0)
            scaled.append((F.col(f"f{i}") * F.col(f"n{i}") / below).alias(f"f{i}"))
        return staged(own.join(top, keys).select(*keys, *scaled), "nmf_factor", tidy=True)

    whole = "spark.sql.requireAllClusterKeysForCoPartition"  # without it what is dealt by p also serves joins by p and more
    before = spark.conf.get(whole)
    spark.conf.set(whole, "false")
    try:
        named = staged(weights.select(F.col(id_col).alias("d"), F.col("term"), F.col("weight").alias("v")), "nmf_matrix", tidy=True)
        terms = staged(named.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t"),
                                                              F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("p")), "nmf_terms", tidy=True)
        written = staged(named.join(terms, "term").select("p", "t", "d", "v"), "nmf_cells", tidy=True)
        cells = on_disk(dealt(written).sortWithinPartitions("p", "t"))  # in its parts once, for all updates
        w = start(named.select("d").distinct(), "d", 0, F.col("d"))
        h = start(terms, "term", 1, F.col("p"), F.col("t"))
        drop_staged(named)
        places = staged(written.select("p", "d").distinct(), "nmf_places", tidy=True)
        for _ in range(iterations):
            last, h = h, updated(dealt(h), ["p", "t"], w, cells.join(dealt(places.join(w, "d")), ["p", "d"]))
            drop_staged(last)
            last, w = w, updated(w, ["d"], h, cells.join(dealt(h), ["p", "t"]))
            drop_staged(last)
        cells.unpersist()
        drop_staged(written, places, w)
    finally:
        spark.conf.set(whole, before)
    ranked = h.join(terms, ["p", "t"]).select("term", F.explode(F.array(*[
        F.struct(F.lit(i).alias("topic"), F.col(f"f{i}").alias("weight")) for i in comps])).alias("s")).select("s.topic", "term", "s.weight")
    return _top_terms(ranked, words)


def _top_terms(ranked: DataFrame, words: int) -> DataFrame:
    """(topic, rank, term, weight): the ``words`` heaviest terms of each topic; terms are first reduced in hash parts."""
    part = F.pmod(F.xxhash64("term"), F.lit(64))
    order = [F.desc("weight"), F.col("term")]
    some = ranked.withColumn("r", F.row_number().over(Window.partitionBy("topic", part).orderBy(*order))).where(F.col("r") <= words)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= words).select("topic", "rank", "term", "weight")


def word2vec_embeddings(docs: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, seed: int = 42,
                        tokens: str = "tokens") -> DataFrame:
    """Document vector = mean of its word vectors (MLlib Word2Vec)."""
    from pyspark.ml.feature import Word2Vec
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol=tokens,
                     outputCol="embedding").fit(docs)
    return model.transform(docs)


def tfidf_vectors(docs: DataFrame, tokens: str = "tokens", vocab_size: int = 1 << 18) -> DataFrame:
    """Sparse TF-IDF vectors (CountVectorizer -> IDF -> L2 Normalizer)."""
    from pyspark.ml.feature import IDF, Normalizer
    _, counted = count_vectors(staged(docs, "tokens"), tokens, vocab_size)  # read three times
    idf = IDF(inputCol="counts", outputCol="raw").fit(counted)
    return Normalizer(inputCol="raw", outputCol="tfidf", p=2.0).transform(idf.transform(counted))
