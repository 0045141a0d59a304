"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import pytest

from gristmill.catalog import ORACLES, QUERIES
from oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HEAVY = {"leaderboard_classification", "leaderboard_regression", "permutation_importance", "text_classifier_scores",
         "text_classifier_terms", "model_card"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, con, name):
    problem, _ = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in HEAVY])
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
