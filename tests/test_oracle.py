"""Every query with SQL returns exactly what the SQL returns, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracle import compare, connect  # noqa: E402

from __spark_entry__ import SMOKE_FOLDER, entry, oracle_sql, queries  # noqa: E402
from daymark.operators import features  # noqa: E402
from daymark.plans.oracle import ORACLE  # noqa: E402
from daymark.plans.queries import REGISTRY  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SMOKE_FOLDER).exists(), reason="no test tables")
TRAINED = {"wf_logistic", "wf_gbt", "wf_random_forest", "oof_predictions", "model_summary", "forecast_7day"}


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_FOLDER)


def test_only_model_fits_lack_sql():
    assert set(REGISTRY) - set(ORACLE) == TRAINED
    assert set(ORACLE) <= set(REGISTRY)
    assert set(REGISTRY) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(con, oracle_sql()[name], queries()[name](spark, SMOKE_FOLDER)) == ""


def test_entry(spark):
    frame = entry(spark)
    assert set(features.model_columns(frame)) == set(frame.columns) - {"series_id", "date", "year", "target"}
    assert len(features.model_columns(frame)) == 31
