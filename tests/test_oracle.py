"""Every registered query with SQL equals DuckDB at sf0.001; every other
query runs and returns rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare

SF = "/root/testdata/sf0.001"
# the training-data queries and their pipeline have their own tests
OWN = {k for k in queries() if k.startswith("op") and k[2:3].isdigit()} | {"pipeline"}
SQL = {k: v for k, v in oracle_sql().items() if k not in OWN}
SLOW_MODELS = {"clf_all", "clf_svm", "stack_gbt_colsample", "compare_models"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck001, name):
    problems, _ = compare(spark, duck001, name, queries()[name], SQL[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL) - SLOW_MODELS - OWN))
def test_rows_only(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["model", "label", "precision", "recall", "f1", "support"]
