"""Every SQL twin against its query."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from marketlens.llm import sql


@pytest.mark.parametrize("name", sorted(sql.QUERIES))
def test_agrees_with_sql(spark, small, name):
    assert differences(entry.queries()[name](spark, small), duck(small), entry.oracle_sql()[name]) == []


def test_what_has_no_sql_is_known():
    optional = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
    assert optional - set(entry.oracle_sql()) == {
        "op7_token_counts", "op8_language_id", "op9_quality_classifier", "op10_best_fit_packing", "pipeline"}
