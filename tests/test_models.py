"""The models query is the whole job of its operator."""

import pytest

from tallyspark.operators import features, model
from tallyspark.plans import registry


def test_models_query_is_the_whole_job(spark, monkeypatch):
    made, forest = [], model.forest
    monkeypatch.setattr(model, "forest", lambda names, label, trees=300: made.append(forest(names, label, trees)) or forest(names, label, 3))  # fits 3 trees, for time
    got = {(r.model, r.metric): r.value for r in registry.QUERIES["m12_m15_models"](spark, "/root/testdata/sf0.001").collect()}
    rf = made[0].getStages()[-1]
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode()) == (300, 30, 10)
    cells = [{k: got[name, k] for k in ("tn", "fp", "fn", "tp")} for name in ("logistic_regression", "random_forest")]
    assert sum(cells[0].values()) == sum(cells[1].values()) > 0
    for name, c in zip(("logistic_regression", "random_forest"), cells):
        assert got[name, "accuracy"] == pytest.approx((c["tn"] + c["tp"]) / sum(c.values()), abs=1e-4)
        assert sum(got[name, f"importance_{f}"] for f in features.FEATURES) == pytest.approx(1)
    assert all(("logistic_regression", f"coefficient_{f}") in got for f in features.FEATURES)
