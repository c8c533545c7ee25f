"""What a query on metric rows writes and computes."""

import pytest

from loomline.plans import queries


@pytest.mark.parametrize("name, metrics", [("dominance_experiment", {"pti", "pai"}), ("instability_experiment", {"teg", "ties"}), ("lewi_nava_validation", {"nava", "lewi_drop"}), ("systems_differ", {"sentiment", "vader_score"}), ("correlation_matrix", {"gase", "pti", "pai", "ties", "rci"})])
def test_only_what_is_read_is_written(spark, sf, monkeypatch, name, metrics):
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, _: written.append(set(df.columns)) or df)
    queries.QUERIES[name](spark, sf)
    assert written == [{"doc_id", "dataset", "gold_sentiment"} | metrics]


def test_two_documents_are_filtered_before_their_metrics(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "materialize", lambda *_: pytest.fail("nothing is written"))
    plan = queries.compare_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (1,2)" in plan[plan.rindex("o_custkey") - 4000 :] and "mean_jaccard" not in plan
    orders = [x for x in plan.splitlines() if "Filter" in x and "o_custkey" in x]
    assert orders and all("IN (1,2)" in x for x in orders)


def test_a_profile_computes_the_rows_it_describes(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "materialize", lambda *_: pytest.fail("nothing is written"))
    plan = queries.domain_profile(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # read from below: the cap comes before the Jaccard of segments
    assert max(i for i, x in enumerate(plan) if "Window" in x) > max(i for i, x in enumerate(plan) if "mean_jaccard" in x or "one(" in x or "PythonUDF" in x or "ArrowEvalPython" in x)


def test_baselines_read_the_texts_once(spark, sf, monkeypatch):
    from loomline.operators import evaluation as E

    written, real = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name: written.append(set(df.columns)) or real(df, name))
    plan = queries.baselines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert written == [{"dataset", "gold_sentiment", *E.SYSTEMS}] and "l_orderkey" not in plan
