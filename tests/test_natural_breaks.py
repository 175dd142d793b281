import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrates.operators import natural_breaks as nb


def brute_force(values, k):
    """Least squared deviation over all ways to cut the sorted distinct values."""
    values = sorted(values)
    distinct = sorted(set(values))
    best = None
    for cuts in itertools.combinations(distinct[1:], min(k, len(distinct)) - 1):
        edges = [float("-inf"), *cuts, float("inf")]
        total = 0.0
        for low, high in zip(edges[:-1], edges[1:]):
            part = [v for v in values if low <= v < high]
            mean = sum(part) / len(part)
            total += sum((v - mean) ** 2 for v in part)
        best = total if best is None else min(best, total)
    return best


def deviation(values, rows):
    total = 0.0
    for row in rows:
        part = [v for v in values if row["lower"] <= v <= row["upper"]]
        assert len(part) == row["n"]
        mean = sum(part) / len(part)
        total += sum((v - mean) ** 2 for v in part)
    return total


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bins", [24, 1024])
def test_least_deviation(spark, monkeypatch, seed, bins):
    monkeypatch.setattr(nb, "BINS", bins)
    rng = random.Random(seed)
    shapes = [
        [rng.uniform(0, 10) for _ in range(30)],
        [rng.lognormvariate(0, 2.5) for _ in range(30)],
        [rng.choice([0.0, 0.001, 0.002, 5.0, 5.001, 900.0]) for _ in range(30)],
        [float(rng.randrange(12)) for _ in range(40)],
    ]
    values = shapes[seed]
    df = spark.createDataFrame([(v,) for v in values + [float("nan")]] + [(None,)], "x double")
    rows = sorted(nb.natural_breaks(df, ["x"], 4).collect(), key=lambda r: r["class"])
    assert sum(r["n"] for r in rows) == len(values)
    assert deviation(values, rows) == pytest.approx(brute_force(values, 4), rel=1e-9, abs=1e-12)


def test_few_values_and_many_measures(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (7.0, 3.0), (7.0, 100.0)], "a double, b double")
    rows = nb.natural_breaks(df, ["a", "b"], {"a": 5, "b": 2}).collect()
    got = {(r["measure"], r["class"]): (r["lower"], r["upper"], r["n"]) for r in rows}
    assert got == {("a", 0): (1, 1, 2), ("a", 1): (7, 7, 2), ("b", 0): (1, 3, 3), ("b", 1): (100, 100, 1)}


def test_long_tailed_values(spark):
    rows = 300_000
    df = spark.range(rows, numPartitions=8).select(F.exp(F.randn(3) * 2.0).alias("x"), F.exp(F.randn(4) * 2.5).alias("y"))
    df = df.cache()
    got = nb.natural_breaks(df, ["x", "y"], 5).orderBy("measure", "class").collect()
    for name in ("x", "y"):
        data = np.sort(df.select(name).toPandas()[name].to_numpy())
        borders = np.cumsum([r["n"] for r in got if r["measure"] == name])
        assert borders[-1] == rows and len(borders) == 5
        count, total = np.arange(rows + 1.0), np.concatenate([[0.0], np.cumsum(data)])
        edges = np.concatenate([[0], borders])
        means = np.diff(total[edges]) / np.diff(count[edges])
        middles = (means[1:] + means[:-1]) / 2
        # Each cut halves the way between means, and no start of the usual iteration does better.
        assert all(data[b - 1] <= m <= data[b] for b, m in zip(borders, middles))
        cost = squares(data, edges)
        rng = np.random.default_rng(1)
        for _ in range(8):
            cuts = np.sort(rng.choice(data, 4, replace=False))
            for _ in range(100):
                edges = np.unique(np.concatenate([[0], np.searchsorted(data, cuts, "right"), [rows]]))
                means = np.diff(total[edges]) / np.diff(count[edges])
                cuts = (means[1:] + means[:-1]) / 2
            assert cost <= squares(data, edges) * (1 + 1e-9)


def squares(data, edges):
    return sum(((data[a:b] - data[a:b].mean()) ** 2).sum() for a, b in zip(edges[:-1], edges[1:]))
