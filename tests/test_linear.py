import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import linear, models


def table(spark, x, y, parts=3):
    rows = [(i, a.tolist(), int(t), "clash") for i, (a, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, x array<double>, target_index int, y string").repartition(parts)


def made(seed=3, n=300, d=6, k=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    return rng.normal(size=(n, d)) + 0.8 * rng.normal(size=(k, d))[y], y


def hinge_value(x, y, w, k, cost):
    sign = np.where(y == k, 1.0, -1.0)
    wide = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    slack = np.maximum(0, 1 - sign * (wide @ w))
    return w @ w / 2 + (np.where(sign > 0, cost, 1.0) * slack**2).sum()


@pytest.mark.parametrize("second_order", [True, False])
def test_squared_hinge_reaches_its_optimum(spark, monkeypatch, second_order):
    monkeypatch.setattr(linear, "BLOCK_BYTES", 8 * 6 * 17)
    monkeypatch.setattr(linear, "FAN_IN", 2)
    if not second_order:
        monkeypatch.setattr(linear, "HESSIAN_BYTES", 0)
    x, y = made()
    fitted = models.fit_linear_svm(table(spark, x, y, 5), 3, bound=1e-7)
    assert fitted.gap <= 1e-7
    rng = np.random.default_rng(1)
    for k in range(3):
        w = np.r_[fitted.model.weights[:, k], fitted.model.bias[k]]
        cost = len(y) / (3 * (y == k).sum())
        best = hinge_value(x, y, w, k, cost)
        # no neighbour is lower by more than the proved gap
        for _ in range(200):
            assert hinge_value(x, y, w + rng.normal(size=len(w)) * rng.choice([1e-4, 1e-2, 0.3]), k, cost) >= best * (1 - 1e-7)


def test_fewer_steps_leave_a_larger_proved_gap(spark):
    x, y = made(5)
    df = table(spark, x, y)
    early, late = models.fit_linear_svm(df, 3, max_iter=1), models.fit_linear_svm(df, 3)
    assert early.gap > late.gap and late.gap <= 1e-6


def test_logistic_gap_covers_the_true_distance(spark):
    x, y = made(7)
    df = table(spark, x, y)
    z = (x - x.mean(0)) / x.std(0)

    def value(w, b):
        s = z @ w + b
        s = s - s.max(1, keepdims=True)
        return (w * w).sum() / 2 + (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).sum()

    full, short = models.fit_logreg(df, 3, max_iter=3000), models.fit_logreg(df, 3, max_iter=3)
    best, rough = (value(m.model.coefficientMatrix.toArray().T, m.model.interceptVector.toArray()) for m in (full, short))
    assert full.gap < 1e-4 < short.gap
    assert (rough - best) / rough <= short.gap


def test_odd_rows(spark):
    x, y = made(9, 40, 2, 2)
    df = table(spark, x, y).unionByName(spark.createDataFrame([(90, None, 0, ""), (91, [1.0, 2.0], None, "")], "id int, x array<double>, target_index int, y string"))
    assert models.fit_linear_svm(df, 3).gap <= 1e-6  # the third class has no rows
    same = table(spark, np.ones((10, 2)), np.zeros(10))
    assert models.fit_linear_svm(same, 2).transform(same).where("y_pred = 0").count() == 10
    for bad in ([float("nan"), 1.0], [1.0]):
        with pytest.raises(Exception, match="finite numbers|same length|dimension|requirement"):
            models.fit_linear_svm(df.unionByName(df.limit(1).withColumn("x", F.array(*[F.lit(v) for v in bad]))), 2)
    with pytest.raises(Exception, match="targets have to be"):
        models.fit_linear_svm(df.withColumn("target_index", F.lit(5)), 2)


def test_grid_makes_features_once_per_size(spark):
    x, y = made(11, 120, 4, 2)
    df = table(spark, x, y)
    calls = []

    def features_of(rows, size):
        calls.append(size)
        return rows.withColumn("x", F.slice("x", 1, size))

    configs = {f"{f}_{s}": {"family": f, "input_size": s} for f in ("logreg", "linear_svm", "none") for s in (2, 4)}
    got = {r["experiment_id"]: r for r in models.run_grid(configs, df, df, 2, features_of=features_of).collect()}
    assert sorted(calls) == [2, 2, 4, 4] and len(got) == 6  # training and held-out rows
    for name, r in got.items():
        if name.startswith("none"):
            assert "none" in r["error"] and r["val_confusion"] is None
        else:
            counts = np.array(r["val_confusion"])
            assert counts.sum() == 120 and r["val_accuracy"] == pytest.approx(np.trace(counts) / 120) and r["gap"] is not None


def test_batches_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    items = spark.createDataFrame([("a.png", ".png", 1), ("b.png", None, 1), ("c.gif", ".gif", 0), (None, None, None)], "filename string, ext string, ok int")
    assert models.scored_history(spark, path).count() == models.scoring_errors(spark, path).count() == 0
    with pytest.raises(ValueError, match="2 items"):
        models.score_batch(items, path, "b-1", valid=F.col("ok") == 1, on_error="raise")
    assert models.read_batches(spark, path).count() == 0  # written, but not in the ledger
    assert models.score_batch(items, path, "b-1", valid=F.col("ok") == 1) == {"batch": "b-1", "scored": 2, "failed": 2, "added": True}
    first = sorted(models.scored_history(spark, path).collect())
    assert models.score_batch(items, path, "b-1", valid=F.col("ok") == 1)["added"] is False
    assert sorted(models.scored_history(spark, path).collect()) == first and [r["filename"] for r in first] != []
    assert {r["filename"] for r in models.scoring_errors(spark, path).collect()} == {"c.gif", None}
    models.score_batch(items, path, "b-2", scorer=lambda df: df.withColumn("label", F.lit("x")).withColumn("score", F.when(F.col("ok") == 1, 0.5)))
    assert models.read_ledger(spark, path).where("batch = 'b-2'").first()["scored"] == 2
    assert len({r["id"] for r in models.scored_history(spark, path).collect()}) == 4
    empty = models.score_batch(items.limit(0), path, "b-3")
    assert (empty["scored"], empty["failed"], empty["added"]) == (0, 0, True)
    for bad in ({"batch": "a/b"}, {"batch": "x", "on_error": "skip"}):
        with pytest.raises(ValueError):
            models.score_batch(items, path, **bad)
