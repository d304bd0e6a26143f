"""Every query that SQL can state equals its statement."""

import pytest

from __spark_entry__ import entry
from check_oracles import compare, duck
from registry.queries import all_queries as queries
from registry.statements import all_statements as oracle_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    frame = queries()[name](spark, SMALL)
    assert compare(frame, frame.collect(), duck(SMALL), oracle_sql()[name]) == ""


def test_statements_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_only_model_results_lack_a_statement():
    assert set(queries()) - set(oracle_sql()) == {
        "ml_logistic_fit",
        "ml_forest_fit",
        "ml_predict",
        "ml_model_comparison",
        "ml_coefficients",
        "ml_top_signed_coefficients",
        "ml_permutation_importance",
        # Measures of the fitted models; what SQL can say of them has its own queries.
        "ml_model_classification_report",
        "ml_model_confusion_matrix",
        "ml_model_measures",
        "ml_model_pr_curve",
        "ml_model_threshold_f1",
    }


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


COMPILED = ("funnel_device", "kpi_clean_orders", "retention_matrix", "ml_feature_table", "ml_roc_auc")


@pytest.mark.parametrize("name", COMPILED)
def test_compiled_plans_equal_sql(spark, name):
    """The other tests run without generated code; these run as production does."""
    settings = {
        "spark.sql.codegen.wholeStage": "true",
        "spark.sql.codegen.factoryMode": "FALLBACK",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = queries()[name](spark, SMALL)
        assert compare(frame, frame.collect(), duck(SMALL), oracle_sql()[name]) == ""
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
