"""Registered queries against their checking SQL at the smallest size.

``tools/check.py`` runs all of them; this keeps a few of each kind in the suite.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from cohortlake import registry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = set()
CHOSEN = [
    "scan_typed_csv",
    "tree_edges",
    "nonmember_filter",
    "exclusion_flow",
    "join_dictionary",
    "complete_grid",
    "feature_columns",
    "interval_label",
    "histogram_log10",
    "summary_by_stratum",
    "relative_abundance",
    "clr",
    "shannon",
    "jaccard_weighted",
    "unifrac_weighted",
    "permanova",
    "diversity_by_exposure",
    "fisher_exact_2x2",
    "log_likelihood",
    "hpdi",
    "diag_energy",
    "effect_counts",
    "effect_compare",
    "effective_size",
    "log_likelihood_normal",
    "logistic_effects",
    "pcoa",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


def test_every_query_has_sql_but_the_listed():
    assert set(registry.QUERIES) - set(registry.ORACLE) == WITHOUT_SQL
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
