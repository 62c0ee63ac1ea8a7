"""Text queries that SQL can express, on the smallest tables; the others keep their contract's shape."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from check_oracle import compare, connect  # noqa: E402

from daymark.llm.queries import ORACLE, REGISTRY  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
COLUMNS = {
    "op1_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_personal": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(connect(FOLDER), ORACLE[name], REGISTRY[name](spark, FOLDER)) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, name):
    found = REGISTRY[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert COLUMNS[name] <= set(found.columns) and found.select("doc_id").distinct().count() == documents
    assert found.count() == documents
