"""Corpus queries against their DuckDB equivalents, on the smallest tables and on awkward rows."""

import os

import duckdb
import pandas as pd
import pytest

from gaitlake.llm import queries
from gaitlake.llm.secrets import scan_secrets
from gaitlake.llm.substrings import remove_repeats

SF = "/root/testdata/sf0.001"


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want.astype(got.dtypes.to_dict()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    same(queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize(("operator", "name"), [(remove_repeats, "op1_columnwise_suffix_dedup"), (scan_secrets, "op5_secret_ownership")])
def test_operator_equals_oracle_on_awkward_rows(docs, rows, operator, name):
    duck = duckdb.connect()
    duck.register("held", pd.DataFrame([r[:4] for r in rows if r[0] is not None], columns=["doc_id", "text", "lang", "source"]))
    duck.sql("create view documents as select * from held")
    same(operator(docs.where("doc_id is not null")).toPandas(), duck.sql(queries.ORACLES[name]).df())
