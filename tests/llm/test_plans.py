"""What the physical plans must and must not contain."""

import re

import pytest

from millrace.llm import queries
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_secret_scan", "op3_url_filters", "op9_line_dedup"])
def test_native_operators_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, SMALL)))


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_toxicity", "op6_license_scans", "op8_packing", "op10_quality_rules"])
def test_scoring_operators_do_not_shuffle(spark, name):
    p = plan(queries.QUERIES[name](spark, SMALL))
    assert "Exchange" not in p and "Join" not in p


@pytest.mark.parametrize(("name", "columns"), [("op1_decontamination", {"doc_id", "text"}), ("op3_url_filters", {"page_id", "url"}), ("op4_toxicity", {"doc_id", "text"}), ("op6_license_scans", {"doc_id", "text"}), ("op8_packing", {"doc_id", "text"}), ("op10_quality_rules", {"doc_id", "text"})])
def test_scans_read_only_what_is_needed(spark, name, columns):
    p = plan(queries.QUERIES[name](spark, SMALL))
    # of the given tables; what an operator has written itself may have other columns
    read = {tuple(re.findall(r"(\w+):", m)) for m in re.findall(rf"Location: [^\n]*?\[file:{SMALL}[^\n]*?ReadSchema: struct<([^>]*)>", p)}
    assert read and set().union(*read) <= columns


def test_queries_have_no_product_and_no_limit(spark):
    for name in ("op1_decontamination", "op2_secret_scan", "op3_url_filters", "op5_quality_classifier", "op6_license_scans", "op8_packing", "op9_line_dedup"):
        p = plan(queries.QUERIES[name](spark, SMALL))
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|CollectLimit|LocalLimit|Sample", p), name
