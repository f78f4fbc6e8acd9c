"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import math
import os

import duckdb
import pytest

from assay import catalog

DIR = os.environ.get("ASSAY_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "overview missing_profile column_meta iqr_outliers univariate_numeric univariate_categorical histogram pearson_matrix strong_pairs crosstab_chi2 crosstab_chi2_yates cramers_v eta_squared temporal_quartile_shift rolling_trend psi_numeric psi_categorical ks_two_sample drift_dataset readiness_columns leak_id leak_consolidated t_impute_mode t_scale_robust t_remove_outliers t_encode_label t_encode_target".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(map(str, (plain(r[i]) for i in order))) for r in got])


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, DIR)
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert a and a == b


def test_pair_scores_cover_every_column(spark):
    got = {frozenset((r["a"], r["b"])): r for r in catalog.QUERIES["pair_scores"](spark, DIR).collect()}
    names = set("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax net_price l_returnflag l_linestatus".split())
    assert set().union(*got) == names and len(got) == 55
    assert got[frozenset(("l_extendedprice", "net_price"))]["strength"] == "Strong"
    assert {r["method"] for r in got.values()} == {"mutual_information", "cramers_v", "correlation_ratio"}
