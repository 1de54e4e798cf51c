"""Steps whose work used to grow with all tokens, pairs or distinct values."""

import pyarrow as pa

from tidewater.operators import features, text, topics, valence


def test_distinct_counts_hold_few_values(spark):
    df = spark.range(6000).selectExpr("id as many", "id % 7 as few", "if(id % 2 = 0, 0.0D, -0.0D) as zero", "cast(null as int) as none", "cast(id % 11 as string) as eleven")
    got = features.distinct_counts(df, df.columns, 10)
    assert {c: got[c] for c in ("few", "zero", "none")} == {"few": 7, "zero": 1, "none": 0}
    assert 10 < got["many"] <= features.BUCKETS and got["eleven"] > 10


def test_fixed_lexicons_shuffle_no_token(spark):
    docs = spark.createDataFrame([(1, "a good day, la casa"), (2, None)], "doc_id long, text string")
    for out in (text.sentiment(docs), valence.valence_sentiment(docs), text.detect_language(docs.na.fill(""))):
        assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()


def test_window_counts_shuffle_a_document_once(spark):
    docs = spark.createDataFrame([(1, ["a", "x", "b", "x", "x"]), (None, ["b"]), (1, ["a", "x", "b", "x", "x"]), (2, ["x"]), (3, None)], "doc_id long, tokens array<string>")
    top = spark.createDataFrame([(0, "a"), (0, "b")], "topic int, term string")
    counts, total = topics.window_counts(docs, top, 2)
    assert "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()
    # rows of one document count their windows once, as their intervals are joined
    assert {(r.wi, r.wj): r.n for r in counts.collect()} == {("a", "a"): 1, ("b", "b"): 3, ("a", "b"): 4}
    assert total.first()[0] == 4 + 1 + 4 + 1


def test_rows_of_a_document_stay_together():
    batches = [pa.RecordBatch.from_pydict({"key": k}) for k in (["a", "a"], ["a"], [], ["a", "b", "c"], ["c"])]
    assert [t["key"].to_pylist() for t in topics._whole(iter(batches))] == [["a", "a", "a", "a", "b"], ["c", "c"]]
