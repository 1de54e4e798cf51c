"""Registry / custom-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import registry as RG
from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.profile_q import _describe_sql
from tidewater.suite.sqlgen import LINEITEM_NUMERIC
from tidewater.suite.text_q import _ngram_sql, _with_pre, pre_sliced


@register("udf_register", """
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '[ \\t\\n\\r\\f]+'),
  lambda w: w <> '')) AS INT) AS words FROM documents""")
def udf_register(spark, d):
    RG.register_function(spark, "tw_word_count", RG.word_count_udf())
    docs = table(spark, d, "documents")
    return spark.sql("SELECT doc_id, tw_word_count(text) AS words FROM {docs}", docs=docs)


@register("registry_call", _describe_sql("lineitem", LINEITEM_NUMERIC))
def registry_call(spark, d):
    return RG.call("describe", table(spark, d, "lineitem"), method="exact")


@register("plan_run")
def plan_run(spark, d):
    return RG.run_plan(table(spark, d, "lineitem"), "quick_insights")


@register("udtf_ngrams", _with_pre(f"""
SELECT ngram, CAST(count(*) AS BIGINT) AS count FROM ({_ngram_sql(2)}) GROUP BY ngram ORDER BY count DESC, ngram LIMIT 20"""))
def udtf_ngrams(spark, d):
    RG.register_ngrams(spark, "tw_ngrams")
    p = pre_sliced(spark, d).select("doc_id", "processed")
    grams = spark.sql("SELECT g.ngram FROM {p}, LATERAL tw_ngrams(processed, 2) g", p=p)
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "ngram").limit(20)
