"""Registered queries run the searches and ensembles with the reference's counts."""
import inspect
import math
from unittest.mock import MagicMock

import pytest

from churnkit.operators import clustering as CL
from churnkit.operators import kernels as K
from churnkit.operators import models as MD
from churnkit.operators import panel as P
from churnkit.operators import tuning
from churnkit.plans import q_models


@pytest.fixture
def calls(spark, monkeypatch):
    """Arguments, with defaults, of every operator call of a query; nothing is fitted."""
    seen = []

    def watch(module, name):
        signature = inspect.signature(getattr(module, name))

        def record(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append((name, dict(bound.arguments)))
            return MagicMock() if module is tuning else (MagicMock(), MagicMock())
        monkeypatch.setattr(module, name, record)

    for module, names in ((MD, ["gradient_boosting", "early_stopped_boosting", "adaboost"]), (K, ["kernel_svm", "svm_with_pca"]), (CL, ["k_search"]),
                          (tuning, ["linear_grid", "forest_search", "tree_grid", "kernel_comparison", "rbf_grid", "logistic_cv", "cv_auc", "learning_curve"])):
        for name in names:
            watch(module, name)
    for name in ("vec_table", "model_table", "round_doubles"):
        monkeypatch.setattr(q_models, name, MagicMock())
    monkeypatch.setattr(K, "platt", MagicMock())
    return lambda query: (seen.clear(), query(MagicMock(), "none"), list(seen))[2]


def test_counts(calls):
    boosting = calls(q_models.boosting_models)
    assert [a["n_trees"] for _, a in boosting] == [100] * 3 and boosting[2][1]["patience"] == 20
    assert calls(q_models.adaboost)[0][1]["rounds"] == 100
    kernels = calls(q_models.kernel_svms)
    assert [a["m"] for n, a in kernels if n == "kernel_svm"] == [200] * 3 and "m" not in kernels[-1][1]["kw"]
    grid = calls(q_models.grid_search)[0][1]
    assert sum(len(cs) * len(shares) for _, cs, shares in grid["grids"]) == 27 and grid["folds"] == 5
    svm = calls(q_models.linear_svm_grid)[0][1]
    assert sum(len(cs) for _, cs, _ in svm["grids"]) == 12 and (svm["folds"], svm["loss"]) == (5, "squared_hinge")
    cv = calls(q_models.logistic_cv)[0][1]
    assert len(cv["Cs"]) == 10 and (cv["Cs"][0], cv["folds"]) == (1e-4, 5) and math.isclose(cv["Cs"][-1], 1e4)
    assert calls(q_models.cv_scores)[0][1]["folds"] == 5
    rbf = calls(q_models.rbf_grid)[0][1]
    assert (len(rbf["Cs"]) * len(rbf["gammas"]), rbf["folds"], rbf["sample"]) == (20, 3, 2000)
    kernel = calls(q_models.kernel_comparison)[0][1]
    assert len(kernel["kernels"]) == 4 and kernel["folds"] == 3
    tree = calls(q_models.tree_grid)[0][1]
    assert math.prod(map(len, tree["grid"].values())) == 192 and tree["folds"] == 5
    curve = calls(q_models.learning_curve)[0][1]
    assert (len(curve["fractions"]), curve["folds"], len(curve["models"])) == (10, 5, 4)
    searched = calls(q_models.k_search)[0][1]
    assert list(searched["k_range"]) == list(range(2, 15)) and searched["n_init"] == 10
    drawn = calls(q_models.random_search)[0][1]
    assert (drawn["n_iter"], drawn["folds"]) == (50, 5) and math.prod(map(len, drawn["space"].values())) >= 50
    assert [f.name for f in P.BASIC] == ["Decision Tree", "Random Forest", "Gradient Boosting", "XGBoost", "LightGBM", "Logistic Regression", "SVM"]
    assert all(f.params.get("n_trees", 100) == 100 for f in P.BASIC)
