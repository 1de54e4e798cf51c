"""A cross-section of registered queries against their DuckDB oracle at sf0.001."""

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = ["profile_columns", "describe_numeric", "outlier_rows", "clean_chain", "win_interpolate",
        "win_rate_counts", "text_tfidf", "text_textrank", "ts_decompose", "metric_auc", "ml_knn",
        "session_analytics", "stream_quota", "feat_bins", "corr_matrix"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    got = entry.queries()[name](spark, SF).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert compare(got, exp) is None
