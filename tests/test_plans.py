"""Queries that read their sources once: nothing is kept in executors' memory, and nothing is joined to itself."""

import re

import pytest

from quarry import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["i01_i08_opcodes", "a08_sizes"])
def test_one_reading(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "InMemoryTableScan" not in text and "Join" not in text
    assert len(re.findall("Generate explode|Generate posexplode", text)) == 1


@pytest.mark.parametrize("name", ["j01_j03_sem001_sem003_sem010", "s10_a03_exit_codes", "a03_r05_error_counts"])
def test_kept_tables_take_no_memory(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    kept = re.findall(r"StorageLevel\(([^)]*)\)", text)
    assert kept and not any("memory" in k for k in kept)


@pytest.mark.parametrize("name", ["s10_a03_exit_codes", "a03_r05_error_counts"])
def test_findings_are_one_reading(spark, name):
    """Only findings are kept, not sentences, and names are looked up without joins on them."""
    text = plan(queries.QUERIES[name](spark, SF))
    assert len(re.findall("InMemoryRelation", text)) == 1 and "name#" not in "".join(re.findall(r"\w*Join\w* .*", text))
    assert len(re.findall("posexplode", text)) == 1
