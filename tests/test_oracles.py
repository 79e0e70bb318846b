"""Every registered query against DuckDB, and the bound input tables themselves."""

import re

import pandas as pd
import pytest

from fieldspark.sources.schemas import SCHEMAS
from verification.compare import differences, rows_of, spark_frame
from verification.oracles import ORACLES, with_binding
from verification.queries import QUERIES, decimals_as_double


@pytest.mark.parametrize("name", SCHEMAS)
def test_bound_table(name, tables, duck):
    result = duck.execute(with_binding(f"select * from {name}"))
    want = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description])
    got = spark_frame(decimals_as_double(getattr(tables, name)))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert differences(df, duck, name) == []
    if name in ORACLES:  # the forecast's trees are MLlib's own code
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|Pandas|CartesianProduct|NestedLoop|Exchange Single", plan)


def test_only_the_forecast_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"harvest_forecast"}
    assert set(ORACLES) <= set(QUERIES)
