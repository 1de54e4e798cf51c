"""Text queries (X1-X26, S10, K8, D6) over the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.lexicons import BASIC_STOPWORDS, LANGUAGE_PROFILES, SENTIMENT_SEED, STOPWORDS
from tidewater.operators import text as X
from tidewater.session import staged
from tidewater.sources.tables import sliced, table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6

NON_WORD_SQL = r"[^\p{L}\p{N}_\s]"
WORD_SQL = X.WORD_RE.replace("'", "''")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + "]::VARCHAR[]"


def _clean_sql(col: str) -> str:
    t = f"lower({col})"
    for pat in (r"http\S+|www\S+|https\S+", r"\S+@\S+", r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"<.*?>"):
        t = f"regexp_replace({t}, '{pat}', '', 'g')"
    t = f"regexp_replace({t}, '{NON_WORD_SQL}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_STOP_CASE = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {_sql_list(v)}" for k, v in STOPWORDS.items()) + " ELSE []::VARCHAR[] END"

PRE_CTES = f"""docs AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array({_clean_sql('text')}, '\\s+'), lambda w: w <> '') AS t0 FROM docs),
stp AS (SELECT doc_id, lang, text, t0, {_STOP_CASE} AS sl FROM tok),
st1 AS (SELECT doc_id, lang, text, t0, list_filter(t0, lambda w: NOT list_contains(sl, lower(w))) AS t1 FROM stp),
pre AS (SELECT doc_id, text, t0, t1, list_filter(t1, lambda w: length(w) >= 2 AND length(w) <= 20
  AND regexp_full_match(w, '\\p{{L}}+')) AS tokens FROM st1)"""


def _with_pre(body: str, more: str = "") -> str:
    return "WITH " + PRE_CTES + ((",\n" + more) if more else "") + "\n" + body


def docs(spark, d):
    return X.corpus(table(spark, d, "documents"), extra=["lang"])


def pre(spark, d):
    return X.preprocess(docs(spark, d))


def docs_sliced(spark, d):
    return X.corpus(sliced(table(spark, d, "documents")), extra=["lang"])


def pre_sliced(spark, d):
    return X.preprocess(docs_sliced(spark, d))


@register("text_set_data", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def text_set_data(spark, d):
    return X.corpus(table(spark, d, "documents"))


@register("text_preprocess", _with_pre("SELECT doc_id, array_to_string(tokens, ' ') AS processed FROM pre"))
def text_preprocess(spark, d):
    return pre(spark, d).select("doc_id", "processed")


@register("text_tokens", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD_SQL}')) AS INT) AS n_tokens,
  md5(array_to_string(regexp_extract_all(text, '{WORD_SQL}'), ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL""")
def text_tokens(spark, d):
    t = X.word_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("text_stopwords", _with_pre("SELECT doc_id, CAST(len(t0) AS INT) AS n_before, CAST(len(t1) AS INT) AS n_after FROM st1"))
def text_stopwords(spark, d):
    df = docs(spark, d)
    cut = df.select("doc_id", "lang", X.clean_tokens(F.col("text")).alias("t0"))
    return cut.select("doc_id", F.size("t0").alias("n_before"), F.size(X.remove_stopwords(F.col("t0"), F.col("lang"))).alias("n_after"))


@register("text_filter_tokens", _with_pre("SELECT doc_id, CAST(len(t1) AS INT) AS n_in, CAST(len(tokens) AS INT) AS n_kept FROM pre"))
def text_filter_tokens(spark, d):
    stopped = docs(spark, d).select("doc_id", "lang", X.clean_tokens(F.col("text")).alias("t0")).select(
        "doc_id", X.remove_stopwords(F.col("t0"), F.col("lang")).alias("t1"))
    sizes = staged(stopped.select("doc_id", F.size("t1").alias("n_in"), F.size(X.filter_tokens(F.col("t1"))).alias("n_kept")), "sizes")
    return sizes.select("doc_id", "n_in").join(sizes.select("doc_id", "n_kept"), "doc_id")


_LEMMA_CTES = """vocab AS (SELECT DISTINCT unnest(t1) AS token FROM st1),
lem AS (SELECT v.token, substring(v.token, 1, length(v.token) - 1) AS lemma FROM vocab v
  WHERE suffix(v.token, 's') AND length(v.token) >= 4 AND substring(v.token, 1, length(v.token) - 1) IN (SELECT token FROM vocab)),
ex AS (SELECT doc_id, unnest(t1) AS token, unnest(generate_series(1, len(t1))) AS pos FROM st1),
norm AS (SELECT ex.doc_id, list(coalesce(lem.lemma, ex.token) ORDER BY ex.pos) AS t2 FROM ex LEFT JOIN lem ON ex.token = lem.token GROUP BY ex.doc_id)"""


@register("text_normalize", _with_pre("""
SELECT s.doc_id, array_to_string(list_filter(coalesce(n.t2, []::VARCHAR[]), lambda w: length(w) >= 2 AND length(w) <= 20
  AND regexp_full_match(w, '\\p{L}+')), ' ') AS processed FROM st1 s LEFT JOIN norm n ON s.doc_id = n.doc_id""", _LEMMA_CTES))
def text_normalize(spark, d):
    df = docs(spark, d)
    stopped = df.withColumn("tokens", X.remove_stopwords(X.clean_tokens(F.col("text")), F.col("lang")))
    lemmas = X.derived_lemmas(stopped)
    out = X.preprocess(df, lemmas=lemmas)
    return out.select("doc_id", "processed")


@register("text_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS total_texts, {r6('avg(c)')} AS avg_text_length, CAST(max(c) AS INT) AS max_text_length,
  CAST(min(c) AS INT) AS min_text_length, {r6('avg(w)')} AS avg_word_count, CAST(max(w) AS INT) AS max_word_count,
  CAST(min(w) AS INT) AS min_word_count, CAST(sum(c) AS BIGINT) AS total_characters, CAST(sum(w) AS BIGINT) AS total_words
FROM (SELECT length(text) AS c, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w
      FROM documents WHERE text IS NOT NULL)""")
def text_stats(spark, d):
    return X.text_stats(docs(spark, d))


@register("text_length_hist", f"""
SELECT CAST(bin AS INT) AS bin, {r6('lo + bin * (hi - lo) / 20')} AS bin_start, {r6('lo + (bin + 1) * (hi - lo) / 20')} AS bin_end,
  CAST(count(*) AS BIGINT) AS count FROM (
  SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((w - lo) / ((hi - lo) / 20)), 19) AS INT) END AS bin, lo, hi
  FROM (SELECT len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
       (SELECT min(w2) AS lo, max(w2) AS hi FROM (SELECT len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w2
        FROM documents WHERE text IS NOT NULL)))
GROUP BY bin, lo, hi""")
def text_length_hist(spark, d):
    from tidewater.operators.charts import histogram
    wc = docs(spark, d).select(F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("words"))
    return histogram(wc, "words", 20)


_PROFILE_VALUES = ", ".join(f"('{lang}', '{w}')" for lang, ws in LANGUAGE_PROFILES.items() for w in sorted(set(ws)))


@register("text_language", f"""
WITH prof(lang, token) AS (VALUES {_PROFILE_VALUES}),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS token FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, p.lang, count(*) AS score FROM toks JOIN prof p ON toks.token = p.token GROUP BY 1, 2),
best AS (SELECT doc_id, lang, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM hits)
SELECT d.doc_id, coalesce(b.lang, 'unknown') AS detected, CAST(coalesce(b.score, 0) AS BIGINT) AS score
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.rn = 1 WHERE d.text IS NOT NULL""")
def text_language(spark, d):
    return X.detect_language(docs(spark, d))


@register("text_entities", "SELECT DISTINCT doc_id, kind, entity FROM (" + "\nUNION ALL\n".join(
    f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS entity FROM documents WHERE text IS NOT NULL"
    for k, p in X.ENTITY_PATTERNS.items()) + ")")
def text_entities(spark, d):
    return X.extract_entities(docs(spark, d))


_LEX_VALUES = ", ".join(f"('{k}', {p!r}, {s!r})" for k, (p, s) in sorted(SENTIMENT_SEED.items()))
_SENT_SQL = f"""lex(token, polarity, subjectivity) AS (VALUES {_LEX_VALUES}),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS token FROM documents WHERE text IS NOT NULL),
sc AS (SELECT doc_id, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity, count(*) AS matched
  FROM toks JOIN lex ON toks.token = lex.token GROUP BY doc_id),
sent AS (SELECT d.doc_id, coalesce(polarity, 0.0) AS polarity, coalesce(subjectivity, 0.0) AS subjectivity,
  CAST(coalesce(matched, 0) AS BIGINT) AS matched FROM documents d LEFT JOIN sc ON d.doc_id = sc.doc_id WHERE d.text IS NOT NULL)"""
_LABEL = "CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END"


@register("text_sentiment", f"""WITH {_SENT_SQL}
SELECT doc_id, {r6('polarity')} AS polarity, {r6('subjectivity')} AS subjectivity, matched, {_LABEL} AS label,
  {r6('abs(polarity)')} AS confidence FROM sent""")
def text_sentiment(spark, d):
    return X.sentiment(docs(spark, d))


@register("text_sentiment_dist", f"""WITH {_SENT_SQL}
SELECT {_LABEL} AS label, CAST(count(*) AS BIGINT) AS count, {r6('(SELECT avg(polarity) FROM sent)')} AS avg_polarity,
  {r6('(SELECT avg(subjectivity) FROM sent)')} AS avg_subjectivity,
  (SELECT CASE WHEN avg(polarity) > 0.1 THEN 'positive' WHEN avg(polarity) < -0.1 THEN 'negative' ELSE 'neutral' END FROM sent) AS overall
FROM sent GROUP BY 1""")
def text_sentiment_dist(spark, d):
    return X.sentiment_distribution(X.sentiment(docs_sliced(spark, d)))


@register("text_classify", f"""WITH {_SENT_SQL}
SELECT doc_id, {_LABEL} AS label, {r6('abs(polarity)')} AS confidence FROM sent""")
def text_classify(spark, d):
    return X.sentiment(docs(spark, d)).select("doc_id", "label", "confidence")


@register("text_keywords_freq", _with_pre("""
SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(tokens) AS word FROM pre)
GROUP BY word ORDER BY count DESC, word LIMIT 10"""))
def text_keywords_freq(spark, d):
    return X.top_words(pre_sliced(spark, d), 10)


@register("text_keywords_simple", f"""
SELECT word, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{NON_WORD_SQL}', '', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda w: w <> '' AND NOT list_contains({_sql_list(BASIC_STOPWORDS)}, w) AND length(w) > 2)) AS word
  FROM documents WHERE text IS NOT NULL)
GROUP BY word ORDER BY count DESC, word LIMIT 10""")
def text_keywords_simple(spark, d):
    return X.simple_keywords(docs(spark, d), 10)


@register("text_word_freq", _with_pre(f"""
SELECT word, count, {r6('count / max(count) OVER ()')} AS weight FROM (
  SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(tokens) AS word FROM pre)
  GROUP BY word ORDER BY count DESC, word LIMIT 20)"""))
def text_word_freq(spark, d):
    return X.word_weights(pre_sliced(spark, d), 20)


def _ngram_sql(n: int) -> str:
    return (f"SELECT unnest(list_transform(generate_series(1, len(tokens) - {n} + 1), "
            f"lambda i: array_to_string(tokens[i:i + {n - 1}], ' '))) AS ngram FROM pre WHERE len(tokens) >= {n}")


@register("text_ngrams", _with_pre(f"""
SELECT ngram, CAST(count(*) AS BIGINT) AS count FROM ({_ngram_sql(2)}) GROUP BY ngram ORDER BY count DESC, ngram LIMIT 20"""))
def text_ngrams(spark, d):
    return X.top_ngrams(pre_sliced(spark, d), 2, 20)


@register("text_ngram_totals", _with_pre(f"""
SELECT CAST(count(DISTINCT ngram) AS BIGINT) AS unique_ngrams, CAST(count(*) AS BIGINT) AS total_ngrams FROM ({_ngram_sql(3)})"""))
def text_ngram_totals(spark, d):
    return X.ngram_totals(pre_sliced(spark, d), 3)


@register("text_bigrams", _with_pre(f"""
SELECT ngram, CAST(count(*) AS BIGINT) AS count FROM ({_ngram_sql(2)}) GROUP BY ngram ORDER BY count DESC, ngram LIMIT 15"""))
def text_bigrams(spark, d):
    return X.top_ngrams(pre_sliced(spark, d), 2, 15)


_TFIDF_CTES = f"""terms AS (SELECT doc_id, unnest(list_concat(tokens, CASE WHEN len(tokens) >= 2 THEN list_transform(generate_series(1, len(tokens) - 1),
    lambda i: array_to_string(tokens[i:i + 1], ' ')) ELSE []::VARCHAR[] END)) AS term FROM pre),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM pre)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, tf.term, tf, idf, tf * idf AS raw FROM tf JOIN vocab ON tf.term = vocab.term),
tfidf AS (SELECT doc_id, term, tf, idf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@register("text_tfidf", _with_pre(f"SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, {r6('idf')} AS idf, {r6('weight')} AS weight FROM tfidf",
                                  _TFIDF_CTES))
def text_tfidf(spark, d):
    return X.tfidf(pre(spark, d))


@register("text_keywords_tfidf", _with_pre(f"""
SELECT term, {r6('s')} AS mean_score FROM (SELECT term, sum(weight) / (SELECT count(*) FROM pre) AS s FROM tfidf GROUP BY term
  ORDER BY s DESC, term LIMIT 10)""", _TFIDF_CTES))
def text_keywords_tfidf(spark, d):
    p = pre(spark, d)
    return X.tfidf_keywords(X.tfidf(p), p.count(), 10)


def _textrank_sql(iterations: int = 10) -> str:
    ctes = ["""ex AS (SELECT doc_id, tokens, len(tokens) AS L FROM pre WHERE len(tokens) >= 4),
pairs AS (SELECT tokens[i + 1] AS a, tokens[i + dd + 1] AS b, least(i, L - 4) - greatest(0, i + dd - 3) + 1 AS w
  FROM (SELECT tokens, L, unnest(generate_series(0, L - 2)) AS i FROM ex) x, LATERAL (SELECT unnest(generate_series(1, least(3, L - 1 - x.i))) AS dd)),
edges AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT a AS src, b AS dst, w FROM pairs WHERE w > 0
  UNION ALL SELECT b, a, w FROM pairs WHERE w > 0) GROUP BY 1, 2),
rs AS (SELECT src, sum(weight) AS rowsum FROM edges GROUP BY src),
nrm AS (SELECT e.src AS i, e.dst AS j, e.weight / rs.rowsum AS nw FROM edges e JOIN rs ON e.dst = rs.src),
vocab AS (SELECT DISTINCT unnest(tokens) AS word FROM pre),
s0 AS (SELECT word, 1.0 AS score FROM vocab)"""]
    for k in range(1, iterations + 1):
        ctes.append(f"""s{k} AS (SELECT v.word, 0.85 + 0.15 * coalesce(c.s, 0.0) AS score FROM vocab v LEFT JOIN
  (SELECT nrm.i, sum(nrm.nw * p.score) AS s FROM nrm JOIN s{k - 1} p ON nrm.j = p.word GROUP BY nrm.i) c ON v.word = c.i)""")
    return _with_pre(f"SELECT word, {r6('score')} AS score FROM s{iterations}", ",\n".join(ctes))


@register("text_textrank", _textrank_sql())
def text_textrank(spark, d):
    return X.textrank(pre_sliced(spark, d))


def _readability_cte() -> str:
    syl = ("list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) "
           "- CASE WHEN lower(w) LIKE '%e' THEN 1 ELSE 0 END))")
    return f"""rd0 AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS ws,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS ns FROM documents WHERE text IS NOT NULL),
rd1 AS (SELECT doc_id, len(ws) AS nw, ns, {syl} AS sy FROM rd0),
rd AS (SELECT doc_id, 206.835 - 1.015 * (nw / ns) - 84.6 * (coalesce(list_sum(sy), 0) / nw) AS flesch_reading_ease,
  0.39 * (nw / ns) + 11.8 * (coalesce(list_sum(sy), 0) / nw) - 15.59 AS flesch_kincaid_grade,
  0.4 * ((nw / ns) + 100 * (len(list_filter(sy, lambda x: x >= 3)) / nw)) AS gunning_fog FROM rd1 WHERE nw > 0 AND ns > 0)"""


@register("text_readability", "WITH " + _readability_cte() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, {r6(f'avg({m})')} AS average, {r6(f'min({m})')} AS min, {r6(f'max({m})')} AS max, "
    f"{r6(f'stddev_pop({m})')} AS std FROM rd" for m in X.READABILITY_METRICS))
def text_readability(spark, d):
    return X.readability_summary(X.readability(docs_sliced(spark, d)))


@register("text_readability_simple", f"""
SELECT doc_id, {r6('206.835 - 1.015 * asl - 84.6 * awl')} AS flesch_score, {r6('asl')} AS avg_sentence_length,
  {r6('awl')} AS avg_word_length FROM (
  SELECT doc_id, CASE WHEN ns > 0 THEN nw / ns ELSE 0.0 END AS asl, CASE WHEN nw > 0 THEN tl / nw ELSE 0.0 END AS awl FROM (
    SELECT doc_id, len(string_split(text, '.')) AS ns, len(ws) AS nw, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS tl
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS ws
          FROM documents WHERE text IS NOT NULL AND length(text) > 0)))""")
def text_readability_simple(spark, d):
    # unrounded here: half-way cases round differently across engines
    return X.readability_simple(docs(spark, d), digits=None)


@register("text_summary", "WITH " + PRE_CTES + ",\n" + _readability_cte() + ",\n" + _SENT_SQL + f"""
SELECT 'basic' AS section, 'total_texts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM docs
UNION ALL SELECT 'basic', 'avg_text_length', {r6('avg(length(text))')} FROM docs
UNION ALL SELECT 'sentiment', 'avg_polarity', {r6('avg(polarity)')} FROM sent
UNION ALL SELECT 'sentiment', 'avg_subjectivity', {r6('avg(subjectivity)')} FROM sent
UNION ALL SELECT 'readability', 'flesch_reading_ease', {r6('avg(flesch_reading_ease)')} FROM rd
UNION ALL SELECT 'readability', 'gunning_fog', {r6('avg(gunning_fog)')} FROM rd
UNION ALL SELECT 'keywords', 'distinct_words', CAST(count(DISTINCT w) AS DOUBLE) FROM (SELECT unnest(tokens) AS w FROM pre)""")
def text_summary(spark, d):
    df = docs_sliced(spark, d)
    p = X.preprocess(df)
    basic = df.agg(F.count(F.lit(1)).cast("double").alias("total_texts"), F.avg(F.length("text")).alias("avg_text_length"))
    sent = X.sentiment(df).agg(F.avg("polarity").alias("avg_polarity"), F.avg("subjectivity").alias("avg_subjectivity"))
    rd = X.readability(df).agg(F.avg("flesch_reading_ease").alias("flesch_reading_ease"),
                               F.avg("gunning_fog").alias("gunning_fog"))
    kw = p.select(F.explode(X.exploded("tokens")).alias("w")).agg(F.count_distinct("w").cast("double").alias("distinct_words"))

    def long(frame, section):
        return frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                                for c in frame.columns])).alias("s")).select(
            F.lit(section).alias("section"), "s.metric", "s.value")
    return (long(basic, "basic").unionByName(long(sent, "sentiment")).unionByName(long(rd, "readability"))
            .unionByName(long(kw, "keywords")))


@register("text_export", _with_pre("""
SELECT p.doc_id, p.text AS original_text, array_to_string(p.tokens, ' ') AS processed_text, CAST(length(p.text) AS INT) AS text_length,
  CAST(len(list_filter(regexp_split_to_array(trim(p.text), '\\s+'), lambda x: x <> '')) AS INT) AS word_count FROM pre p"""))
def text_export(spark, d):
    p = pre(spark, d)
    return p.select("doc_id", F.col("text").alias("original_text"), F.col("processed").alias("processed_text"),
                    F.length("text").alias("text_length"),
                    F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("word_count"))
