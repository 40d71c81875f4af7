"""Driver contract: every registered query against its check SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from lapforge.sources.telemetry import lake_size
from tools.check_oracle import TABLES, cell

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert contract.entry(spark).count() == 6


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    own = {name for name in QUERIES if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(ORACLES) == {"m1_m7_detect_mistakes", "m6_run_meta"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not re.match(r"op\d+_", n)))
def test_query(spark, sf_dir, tables, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = tables.execute(ORACLES[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(tuple(cell(v) for v in r) for r in got[columns].itertuples(index=False))
    right = sorted(tuple(cell(v) for v in r) for r in want[columns].itertuples(index=False))
    assert left == right


def test_model_queries(spark, sf_dir):
    rows = QUERIES["m1_m7_detect_mistakes"](spark, sf_dir).toPandas()
    assert len(rows) > 5900 and 0 < rows.is_mistake.mean() < 0.3
    assert lake_size(spark, sf_dir).first().lake_size.endswith(" MB")
