"""Registered queries against their SQL on the smallest tables, and the shape of their plans.

All queries of the library, the model fits included.
"""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from __spark_entry__ import FLAGSHIP, entry, queries
from check import compare
from cohortwright.bindings import BOOKS
from cohortwright.bindings.views import TABLES

SF = "/root/testdata/sf0.001"
OWN = {name: query for book in BOOKS for name, query in book.queries.items()}
ORACLES = {name: text for book in BOOKS for name, text in book.oracles.items()}
NAMES = list(OWN)


@pytest.fixture(scope="module")
def outcomes(spark):
    """Status, row count and plan of every query, run a few at a time."""
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def run(name):
        built = []

        def query(session, sf):
            built.append(OWN[name](session, sf))
            return built[0]

        try:
            status, rows, _ = compare(spark, connection.cursor(), name, query, ORACLES.get(name), SF)
            return status, rows, built[0]._jdf.queryExecution().executedPlan().toString()
        except Exception as error:  # reported by the query's own test
            return f"{type(error).__name__}: {error}", 0, ""

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES)))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(outcomes, name):
    status, rows, plan = outcomes[name]
    assert status in ("match", "rows-only") and rows > 0
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_but_one_has_an_oracle():
    assert [n for n in OWN if n not in ORACLES] == ["m11_pca2"]
    assert set(ORACLES) <= set(OWN) <= set(queries())


def test_entry(spark):
    assert FLAGSHIP in queries()
    assert entry(spark).count() == 3
