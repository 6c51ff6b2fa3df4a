"""Every named query against the SQL that must give the same rows, with whole and with cut series."""

import math
import os

import duckdb
import pytest

from signalspark import catalog

catalog.load_all()
# Queries whose plan depends on how series are laid out.
LAID_OUT = [
    "row_numbering",
    "split_manifest_time",
    "split_manifest_subject",
    "fill_gaps",
    "impute_train_medians",
    "normalize_global",
    "normalize_online",
    "profile_table",
    "profile_safe_rows",
    "stride_downsample",
    "even_cap",
    "restride_rows",
    "flagship_window_features",
    "window_meta",
    "window_samples",
    "window_feature_table",
    "beat_spectrum",
    "sequence_examples",
    "feature_table_dataset",
    "category_codes",
    "classification_metrics",
    "threshold_f1",
    "roc_points",
    "pr_points",
]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf, name)}.parquet'")
    return con


def canonical(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "None"):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False))


def compare(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    compare(spark, duck, sf, name)


@pytest.mark.parametrize("name", LAID_OUT)
def test_query_equals_sql_with_cut_series(spark, duck, sf, cut_series, name):
    compare(spark, duck, sf, name)


@pytest.mark.parametrize("name", ["boosted_classifier", "boosted_classifier_platt", "sequence_forecaster"])
def test_probabilities(spark, sf, name):
    scores = [r.p for r in catalog.QUERIES[name](spark, sf).collect()]
    assert scores and all(0.0 <= p <= 1.0 for p in scores)


def test_random_missingness_rate(spark, sf):
    table = catalog.QUERIES["random_missingness"](spark, sf).toPandas()
    assert abs(table.eda.isna().mean() - 0.2) < 0.05 and abs(table.temp.isna().mean() - 0.2) < 0.05


def test_profile_ablation_reports_both_runs(spark, sf):
    table = catalog.QUERIES["profile_ablation"](spark, sf).collect()
    assert {(r.model, r.metric) for r in table} == {
        (m, k) for m in ("profiles_on", "profiles_off") for k in ("auroc", "rmse")
    }
