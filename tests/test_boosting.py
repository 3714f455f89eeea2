"""Boosting: splits and leaves against a plain version, patience, bounds, equal trees however rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflow.operators import boosting
from cityflow.operators.boosting import Settings, binned, boost
from cityflow.plans import training

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 3)), 2)
    y = 3 * (x[:, 0] > 0.3) + np.sin(2 * x[:, 1]) + rng.normal(scale=0.3, size=900)
    held = rng.random(900) < 0.25
    rows = [(*map(float, r), float(v), bool(h)) for r, v, h in zip(x, y, held)] + [(1.0, 1.0, 1.0, None, False)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, held boolean").persist()


def plain(x, y, edges, s):
    """All rounds by trying every split of every node on the rows themselves."""
    margin, trees = np.full(len(y), y.mean()), []
    soft = lambda g: np.sign(g) * max(abs(g) - s.alpha, 0)
    score = lambda g: soft(g.sum()) ** 2 / max(len(g) + s.penalty, 1e-12)

    def grow(rows, depth):
        g = np.rint((margin[rows] - y[rows]) / boosting.UNIT) * boosting.UNIT
        best = (1e-9, None)
        for f in range(x.shape[1]) if depth else ():
            for cut in edges[f]:
                left = x[rows, f] <= cut
                if min(left.sum(), (~left).sum()) >= max(s.least, 1):
                    gain = score(g[left]) + score(g[~left]) - score(g)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            return -s.rate * soft(g.sum()) / max(len(g) + s.penalty, 1e-12)
        f, cut = best[1]
        left = x[rows, f] <= cut
        return f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(s.rounds):
        trees.append(grow(np.arange(len(y)), s.depth))
        margin = margin + np.array([value(trees[-1], r) for r in x])
    return lambda rows: np.array([y.mean() + sum(value(t, r) for t in trees) for r in rows])


@pytest.mark.parametrize("more", [{}, {"alpha": 2.0, "penalty": 5.0, "least": 12}])
def test_equals_a_plain_search_of_all_splits(table, more):
    s = Settings(rounds=4, depth=3, rate=0.3, **more)
    data = binned(table.where("not held"), NAMES, "y", bins=32)
    model = boost(data, s)
    rows = np.array([r[:4] for r in table.where("not held and y is not null").collect()], float)
    want = plain(rows[:, :3], rows[:, 3], data.edges, s)
    got = {r[:3]: r.prediction for r in model.transform(table).select(*NAMES, "prediction").collect()}
    assert [got[tuple(r)] for r in rows[:, :3]] == pytest.approx(list(want(rows[:, :3])), abs=1e-6)
    data.unpersist()


def test_trees_do_not_depend_on_how_rows_are_dealt(table, monkeypatch):
    s = Settings(rounds=20, depth=4, rate=0.2, columns=0.7)
    one = boost(binned(table, NAMES, "y"), s)
    monkeypatch.setattr(boosting, "TASK_ROWS", 60)
    data = binned(table.repartition(7, "a"), NAMES, "y")
    assert data.blocks.getNumPartitions() == 7
    many = boost(data, s)
    assert (one.value == many.value).all() and (one.threshold == many.threshold).all() and one.rounds == 20


def test_patience_acts(table):
    data = binned(table, NAMES, "y", F.col("held"))
    model = boost(data, Settings(rounds=400, depth=4, rate=0.3, patience=10))
    assert 1 <= model.rounds < 400 and len(model.errors) == model.rounds + 10
    assert min(model.errors) == model.errors[model.rounds - 1]
    squared = model.transform(table.where("held")).select(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert squared**0.5 == pytest.approx(min(model.errors), rel=1e-9)
    whole = boost(data, Settings(rounds=model.rounds, depth=4, rate=0.3))
    assert (whole.value == model.value).all()
    with pytest.raises(ValueError):
        boost(binned(table, NAMES, "y"), Settings(patience=3))


def test_leaves_are_bounded(table):
    model = boost(binned(table, NAMES, "y"), Settings(rounds=3, depth=8, leaves=6, least=5))
    for t in range(3):
        leaf = (model.tree == t) & (model.left < 0)
        assert leaf.sum() == 6 and model.cover[leaf].min() >= 5
    assert model.importance.sum() == pytest.approx(1) and model.importance.argmax() == 0


def test_a_constant_label_and_nulls(spark):
    rows = spark.createDataFrame([(None, float("nan"), 1.0, 2.0)] * 5 + [(0.5, 1.0, None, 2.0)], "a double, b double, c double, y double")
    model = boost(binned(rows, NAMES, "y"), Settings(rounds=2, depth=3))
    assert [r.prediction for r in model.transform(rows).collect()] == [2.0] * 6
    with pytest.raises(ValueError):
        binned(rows.limit(0), NAMES, "y")


def test_saved_models_predict_the_same(spark, table, tmp_path):
    model = boost(binned(table, NAMES, "y", F.col("held")), Settings(rounds=30, depth=3, patience=5, leaves=5))
    model.save(spark, str(tmp_path / "m"))
    again = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert again.settings == model.settings and again.errors == model.errors
    both = [m.transform(table).select("a", "b", "c", "prediction").orderBy("a", "b", "c").collect() for m in (model, again)]
    assert both[0] == both[1]


def test_search_stops_each_trial_by_patience(table):
    rows = table.withColumn("split", F.when(F.col("held"), "validation").otherwise("fit")).withColumn("trip_count", F.col("y"))
    space = training.SPACE | {"rounds": (40, 60, "int"), "depth": (2, 3, "int"), "rate": (0.2, 0.5, "log")}
    trials, best = training.tune(rows, 4, space, patience=4, features=NAMES)
    assert len(trials) == 4 and [t.rmse for t in trials] == sorted(t.rmse for t in trials)
    assert all(t.run == min(t.drawn["rounds"], t.kept + 4) for t in trials)
    assert best.rounds == trials[0].kept and min(best.errors) == trials[0].rmse


def test_published_settings_are_the_default(spark):
    quick = training.preset_of(spark)
    spark.conf.unset(training.PRESET_SETTING)
    assert training.preset_of(spark) == "full"
    spark.conf.set(training.PRESET_SETTING, quick)
    full = training.PRESETS["full"]
    assert [full[k]["numTrees"] for k in ("random_forest", "random_forest_deep")] == [300, 300]
    assert [full[k]["rounds"] for k in ("boosted_a", "boosted_b")] == [600, 500]
    assert (training.TRIALS, training.PATIENCE) == (50, 30)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_boosting_in_a_task_walks_each_level_once(monkeypatch, scale):
    """Trees are those of plain sums over blocks; no row starts again at the root."""
    rng = np.random.default_rng(5)
    codes, fit = rng.integers(0, 20, (3000, 4)).astype(np.uint8), rng.random(3000) < 0.8
    label = scale * (codes[:, 0] + rng.normal(size=3000))
    blocks = [((0, i), codes[i : i + 1000], label[i : i + 1000], fit[i : i + 1000]) for i in range(0, 3000, 1000)]
    settings, base = Settings(rounds=6, depth=5, rows=0.7, columns=0.7, alpha=0.5, leaves=20, patience=3), float(label[fit].mean())

    class Plain:
        def __init__(self):
            self.blocks = [(*b, np.full(len(b[2]), base)) for b in blocks]

        def histogram(self, *args):
            return next(boosting._sums(iter(self.blocks), *args))

        def advance(self, tree, steps):
            self.blocks = list(map(boosting._advance(tree, steps), self.blocks))

    want, errors = boosting._rounds(Plain(), settings, 20, 4, int((~fit).sum()))
    monkeypatch.setattr(boosting.Trees, "leaf", None)
    found, same = boosting._rounds(boosting.Held(blocks, base), settings, 20, 4, int((~fit).sum()))
    assert same == errors and len(found) == len(want) > 1
    for a, b in zip(found, want):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "bin", "left", "right", "value", "cover", "gain"))


def test_a_histogram_has_no_room_for_bins_that_a_feature_lacks():
    """Trees do not depend on it; sums are as wide as the bins of the drawn features together."""
    rng = np.random.default_rng(6)
    widths = [2, 120, 7, 30]
    codes, fit = np.stack([rng.integers(0, w, 2000) for w in widths], 1).astype(np.uint8), np.ones(2000, bool)
    label = codes[:, 1] / 10 + 3.0 * codes[:, 0] + rng.normal(size=2000)
    settings, seen = Settings(rounds=4, depth=4, columns=0.5), []

    class Watched(boosting.Held):
        def histogram(self, *args):
            found = super().histogram(*args)
            seen.append((found[0].shape[-1], sum(widths[c] for c in args[6])))
            return found

    found, _ = boosting._rounds(Watched([((0, 0), codes, label, fit)], label.mean()), settings, widths, 4, 0)
    assert seen and all(a == b for a, b in seen)
    want, _ = boosting._rounds(boosting.Held([((0, 0), codes, label, fit)], label.mean()), settings, 120, 4, 0)
    for a, b in zip(found, want):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "bin", "left", "right", "value", "cover", "gain"))


def test_a_task_holds_bin_numbers_as_bytes():
    """A row of the boosting task costs one byte for each feature, not eight."""
    codes, label = np.random.default_rng(8).integers(0, 120, (500, 3)).astype(np.uint8), np.ones(500)
    held = boosting.Held([((0, 0), codes, label, label > 0)], 0.0)
    assert sum(v.nbytes for v in vars(held).values() if isinstance(v, np.ndarray) and v.ndim == 2) == codes.size
