"""Every registered query of the library against its SQL, at the smallest scale."""

import glob
import math
import os

import pytest

from loomline.plans.oracle import SQL
from loomline.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return v


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        rel = con.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        assert got == want


def test_no_query_collects_rows_with_python_in_the_hot_path(spark, sf):
    """The scorers stay in the JVM: only the pairwise mean of the metric row runs in Arrow batches."""
    plan = QUERIES["sentence_scores"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    plan = QUERIES["doc_metrics_corpus"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
