"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import align, binary, bpe, chat, exact, language, minhash, mixing, pii, quality, repair, sharding, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values of the contracts.
SHARDS = 24
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 0
#: The key of the surrogates; a real run gives its own and keeps it secret.
PII_KEY = "tidewater"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The words of a text in DuckDB, as a list.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SEPARATORS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.longest_first(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _repeated(n: int) -> str:
    """Documents' word positions that lie in a window of ``n`` words that the document has twice or more: (doc_id, pos)."""
    return f"""
  SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) AS pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, window_words) AS c FROM (
      SELECT doc_id, unnest(range(1, len(w) - {n} + 2)) AS pos, array_to_string(w[pos:pos + {n} - 1], ' ') AS window_words FROM docs WHERE len(w) >= {n}))
  WHERE c > 1"""


@query("op2_quality", f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
w5 AS ({_repeated(quality.WINDOW)}),
wm AS ({_repeated(quality.MIN_REPEAT)}),
wl AS ({_repeated(quality.MAX_REPEAT + 1)}),
n5 AS (SELECT doc_id, count(*) AS n FROM w5 GROUP BY doc_id),
nm AS (SELECT doc_id, count(*) AS n FROM wm GROUP BY doc_id),
nl AS (SELECT DISTINCT doc_id FROM wl),
found AS (
  SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(text, {SEPARATORS}, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: length(translate(l, {SEPARATORS}, '')) > 0) AS lines,
         CAST(coalesce(n5.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(nm.n, 0) AS BIGINT) AS n_covered_words,
         nl.doc_id IS NOT NULL AS long_repeat
  FROM docs LEFT JOIN n5 USING (doc_id) LEFT JOIN nm USING (doc_id) LEFT JOIN nl USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_covered_words,
       long_repeat, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_WINDOW_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_WINDOW_PERCENT} * n_words)
         AND 100 * n_covered_words <= {quality.MAX_COVERED_PERCENT} * n_words AND NOT long_repeat AS kept
FROM found""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdicts of all documents."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words",
        (F.col("longest_repeat") > quality.MAX_REPEAT).alias("long_repeat"), "base_failed", "kept")


@query("op3_substring", f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {substring.WINDOW} + 2)) AS pos, array_to_string(w[pos:pos + {substring.WINDOW} - 1], ' ') AS window_words
        FROM docs WHERE len(w) >= {substring.WINDOW}),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {substring.WINDOW})) AS pos
         FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY window_words) AS c FROM win) WHERE c > 1),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated passages of 35 words or more, as digests."""
    return substring.cut_passages(table(spark, sf_dir, "documents"), with_text=False)


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their decoded texts, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op5_chat", f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
             md5(string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY turn)) AS h FROM t),
e AS (SELECT conv_id, max(pos) + 1 AS n, arg_max(h, pos) AS h FROM p GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n, h, count(*) AS copies FROM e GROUP BY n, h),
longer AS (SELECT DISTINCT p.h, p.pos + 1 AS n FROM p JOIN e USING (conv_id) WHERE e.n > p.pos + 1),
m AS (SELECT * FROM k ANTI JOIN longer USING (h, n))
SELECT conv_id, CAST(pos // {chat.PART} AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_turns, CAST(any_value(copies) AS BIGINT) AS copies,
       string_agg('{chat.START}' || replace(role, '<|', '<' || chr(8203) || '|') || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '{chat.END}' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN m USING (conv_id) GROUP BY conv_id, pos // {chat.PART}""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.chat_texts(table(spark, sf_dir, "conversations"))


@query("op6_exact", f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), {SEPARATORS}, '') AS norm, length(coalesce(text, '')) AS n FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS c FROM d)
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document and the row that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op7_binary")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Huffman-coded files and read back."""
    out = binary.new_folder(spark)
    binary.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, out, end_id=END_ID)
    return binary.read_digests(spark, out)


@query("op8_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on two-word shingles."""
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=2).drop("tx")


@query("op9_mixing", f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(f'{w}.0::DOUBLE' for w in mixing.WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight,
             CAST({mixing.MOST} AS DOUBLE) * source_size AS cap FROM s),
m AS (SELECT *, (CAST({mixing.SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark FROM w),
l AS (SELECT *, max(CASE WHEN mark * weight <= cap THEN mark END) OVER () AS water FROM m),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM l),
r AS (SELECT doc_id, d.source, size, source_size, target,
             row_number() OVER (PARTITION BY d.source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
             CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN '0' ELSE '1' END), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(e * (k + 1) + u) - floor(e * k + u), ceil(e)) AS BIGINT) * size AS taken FROM r""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data and secrets."""
    return pii.replaced(table(spark, sf_dir, "documents"), PII_KEY)


@query("op11_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired at the least cost."""
    talks = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(talks), talks)


@query("op12_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents."""
    return align.alignment(table(spark, sf_dir, "documents"), TOKENIZER, PIECES, digest=True)[0]


@query("op13_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those that are not held out."""
    return language.identified(table(spark, sf_dir, "documents"))
