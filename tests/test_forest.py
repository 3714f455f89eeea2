import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.operators import forest, tree_shap
from cityflow.operators.boosting import binned
from cityflow.operators.forest import Forest, Settings, fit_forest
from cityflow.plans import scoring
from cityflow.plans.registry import MODEL_FEATURES

NAMES = ("a", "b", "c", "d")


def rows_of(spark, n=4000, names=NAMES, parts=1):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, len(names)))
    frame = pd.DataFrame(x, columns=list(names)).assign(y=np.round(3 * x[:, 0] + np.where(x[:, 1] > 0.3, 4.0, 0.0) + rng.normal(size=n) / 4, 3))
    return spark.createDataFrame(frame).repartition(parts).persist()


def trees_of(model):
    return [tuple(r) for r in model.nodes().orderBy("treeID", "id").collect()]


def test_a_deep_forest_stays_a_table(spark, monkeypatch):
    """Trees, predictions and importance: no tree passes through the driver."""
    table = rows_of(spark)
    model = fit_forest(binned(table, NAMES, "y", bins=32), Settings(numTrees=12, maxDepth=10, minInstancesPerNode=3))
    assert isinstance(model, Forest) and [t.treeID for t in model.trees] == list(range(12)) and max(t.depth for t in model.trees) > 6
    found = model.transform(table).agg(F.avg((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y"), F.count("*")).first()
    assert found[0] < 0.1 * found[1] and found[2] == 4000
    assert model.importance.sum() == pytest.approx(1) and model.importance[:2].sum() > 0.85
    nodes = model.nodes().toPandas()
    leaves = nodes[nodes.leftChild < 0]
    assert leaves.cover.min() >= 3
    for _, tree in nodes.groupby("treeID"):
        by_id = tree.set_index("id")
        inner = tree[tree.leftChild >= 0]
        assert (by_id.cover[inner.leftChild].to_numpy() + by_id.cover[inner.rightChild].to_numpy() == inner.cover.to_numpy()).all()
        sums = [by_id.cover[inner[c]].to_numpy() * by_id.prediction[inner[c]].to_numpy() for c in ("leftChild", "rightChild")]
        assert sums[0] + sums[1] == pytest.approx((inner.cover * inner.prediction).to_numpy())


def test_trees_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    data = binned(rows_of(spark, parts=3), NAMES, "y", bins=32)
    wide = data.blocks.repartition(3).persist()
    settings = Settings(numTrees=5, maxDepth=7, minInstancesPerNode=3)
    data.blocks = data.blocks.coalesce(1)
    whole = trees_of(fit_forest(data, settings))
    data.blocks = wide
    for rows, size in ((1 << 17, 1 << 26), (300, 1 << 26), (300, 1 << 13), (0, 1 << 16)):
        monkeypatch.setattr(forest, "LOCAL_ROWS", rows)
        monkeypatch.setattr(forest, "HISTOGRAM_BYTES", size)
        assert trees_of(fit_forest(data, settings)) == whole


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, float("nan"), 1.0, 2.0, 2.0)] * 5 + [(0.5, 1.0, None, 2.0, 2.0)], "a double, b double, c double, d double, y double")
    model = fit_forest(binned(rows, NAMES, "y", bins=32), Settings(numTrees=3))
    assert [r.prediction for r in model.transform(rows).collect()] == [2.0] * 6
    assert model.transform(rows.limit(0)).count() == 0
    model.save(str(tmp_path / "m"))
    assert trees_of(Forest.load(spark, str(tmp_path / "m"))) == trees_of(model)


def test_large_models_are_explained_without_the_driver(spark, monkeypatch, tmp_path):
    table = rows_of(spark, 600, MODEL_FEATURES)
    model = fit_forest(binned(table, MODEL_FEATURES, "y", bins=32), Settings(numTrees=6, maxDepth=8, minInstancesPerNode=3))
    whole = scoring.load_leaves(spark, model, str(tmp_path / "a"))
    want = {r.y: r.contributions for r in scoring.explained(table.limit(50), model, whole).collect()}
    monkeypatch.setattr(tree_shap, "CELLS_PER_BLOCK", 500)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    leaves = scoring.load_leaves(spark, model, str(tmp_path / "b"))
    assert len(whole.blocks) == 1 and len(leaves.blocks) > 3
    rows = scoring.explained(table.limit(50), model, leaves).collect()
    assert len(rows) == 50
    for r in rows:
        assert r.contributions == pytest.approx(want[r.y], abs=1e-9)
        assert sum(r.contributions) + r.base_value == pytest.approx(r.raw_prediction, abs=1e-9)


def test_shares_of_paths_of_eight_features_are_looked_up(monkeypatch):
    """What is worked out depends on the leaves, not on the number of rows."""
    rng, cells, shares = np.random.default_rng(3), [], tree_shap._shares
    feature = np.stack([rng.choice(24, 8, replace=False) for _ in range(90)])
    low = np.where(rng.random(feature.shape) < 0.5, -np.inf, -0.5)
    leaves = tree_shap.Leaves(feature, low, np.where(np.isinf(low), 0.5, np.inf), rng.uniform(0.2, 0.9, feature.shape), rng.normal(size=90), 24)
    x = rng.normal(size=(3000, 24))
    passed = (x[:, feature] > leaves.low) & (x[:, feature] <= leaves.high)
    want = np.zeros((3000, 24))
    for i in range(90):
        want[:, feature[i]] += shares(leaves.value[i], leaves.cover[i], passed[:, i])

    def counted(value, cover, passed):
        cells.append(np.broadcast_shapes(cover.shape, passed.shape))
        return shares(value, cover, passed)

    monkeypatch.setattr(tree_shap, "_shares", counted)
    assert tree_shap.attributions(leaves, x) == pytest.approx(want, abs=1e-9)
    assert sum(np.prod(c) for c in cells) == 90 * 256 * 8
