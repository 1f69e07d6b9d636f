"""The pair classifier: equal pairs are one row with their number, which changes no loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import models
from gridmine.operators.networks import Network, fit_network, minimise, moments

COLUMNS = ["a", "b"]


def test_counted_rows_train_like_single_rows(spark):
    different = [(1.0, 2.0, 0, 7), (2.0, 1.0, 1, 3), (3.0, 5.0, 0, 1), (4.0, 1.5, 1, 9), (1.0, 2.0, 1, 2)]
    counted = spark.createDataFrame(different, "a double, b double, label int, n long")
    single = counted.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).repartition(3)
    one, other = (fit_network(rows, COLUMNS, scaled_by=rows, hidden=5, iterations=6) for rows in (counted, single))
    assert one.weights == pytest.approx(other.weights, abs=1e-6)
    assert one.mean == pytest.approx(np.average([r[:2] for r in different], axis=0, weights=[r[3] for r in different]))
    got = {(r["a"], r["b"]): r["prediction"] for r in one.predict(counted).collect()}
    assert len(got) == 4 and set(got.values()) <= {0.0, 1.0}


def test_gradient_and_minimum():
    draw = np.random.default_rng(1)
    x, label, n = draw.normal(size=(6, 2)), np.array([0, 1, 1, 0, 1, 0]), np.array([1.0, 4, 2, 1, 1, 3])
    at = lambda w: Network(COLUMNS, 3, np.zeros(2), np.ones(2), w).loss(x, label, n)
    w = draw.normal(size=2 * 3 + 3 + 3 * 2 + 2)
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-6
        assert at(w)[2 + k] == pytest.approx((at(w + step)[1] - at(w - step)[1]) / 2e-6, abs=1e-5)
    best = minimise(lambda v: (float((v - 3) @ (v - 3) * 10 + v[0] ** 4), 20 * (v - 3) + np.array([4 * v[0] ** 3, 0])), np.zeros(2), 30)
    assert best[1] == pytest.approx(3, abs=1e-3) and 4 * best[0] ** 3 == pytest.approx(-20 * (best[0] - 3), abs=1e-2)


def test_missing_inputs_and_constants(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 2), (1.0, 4.0, 2)], "a double, b double, n long")
    mean, scale = moments(rows, COLUMNS, "n")
    assert mean.tolist() == [1.0, 3.0] and scale[0] == 0 and scale[1] == pytest.approx(1 / np.std([2, 2, 4, 4], ddof=1))
    bad = spark.createDataFrame([(None, 1.0, 1, 1), (1.0, 2.0, 0, 1)], "a double, b double, label int, n long")
    with pytest.raises(Exception, match="missing or not finite"):
        fit_network(bad, COLUMNS, scaled_by=bad, hidden=2)


def test_the_pair_classifier_goes_through_different_pairs_only(spark, tmp_path, monkeypatch):
    """Before, every iteration went through every pair."""
    lines = spark.range(3000).select(
        (F.col("id") / 3).cast("long").alias("l_orderkey"),
        (F.col("id") % 3).cast("int").alias("l_linenumber"),
        F.lit(1).cast("long").alias("l_partkey"),
        F.lit(1).cast("long").alias("l_suppkey"),
        (1 + F.pmod(F.xxhash64("id"), F.lit(4))).cast("double").alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    fit = models.fit_network
    monkeypatch.setattr(models, "fit_network", lambda rows, *a, **b: seen.append(rows.agg(F.count("*"), F.sum("n")).first()) or fit(rows, *a, **b))
    got = entry.queries()["m11_interval_pair_classifier"](spark, str(tmp_path)).first()
    assert (got["n"], got["at_least_majority"]) == (899, True)
    assert len(seen) == 1 and seen[0][0] <= 16 and seen[0][1] == 2100
