"""Every registered query with a SQL counterpart agrees with DuckDB on the same files."""

import __spark_entry__ as entry
import pytest
from compare import differences, duck

from rankweave.plans import registry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, folder, con, name, capsys):
    result = QUERIES[name](spark, folder)
    assert differences(result, con, ORACLE[name]) is None
    capsys.readouterr()
    result.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_stored_split_is_pruned(spark, folder, capsys):
    split = registry.Split(spark, folder)
    split.positives.select("item_id").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(is_test" in plan
    assert "GreaterThanOrEqual(rating,3.0)" in plan
    assert "ReadSchema: struct<item_id:bigint,rating:double>" in plan


def test_top_n_is_cut_before_the_shuffle(spark, folder, capsys):
    QUERIES["factor_topk"](spark, folder).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
