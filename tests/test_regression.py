from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrates.operators import regression as reg
from eventrates.operators.design import BinaryModel, design_matrix

LEVELS = ["a", "b", "c"]


def sample(seed=7, rows=3000, clusters=25):
    rng = np.random.default_rng(seed)
    cluster = rng.integers(0, clusters, rows)
    # A third of all rows in one cluster.
    cluster[: rows // 3] = 0
    group = rng.choice(LEVELS, rows)
    post = rng.random(rows) < 0.4
    lat = 44.98 + rng.normal(0, 0.05, rows)
    size = rng.integers(0, 2, rows)
    drift = rng.normal(0, 0.7, clusters)[cluster]
    eta = -0.4 + 0.6 * (group == "b") - 0.5 * (group == "c") + 0.3 * post + 2.0 * (lat - 44.98) + drift
    y = (rng.random(rows) < 1 / (1 + np.exp(-eta))).astype(int)
    return [
        (f"k{c}", int(v), str(g), bool(t), float(s), float(x))
        for c, v, g, t, s, x in zip(cluster, y, group, post, size, lat)
    ]


def to_df(spark, rows):
    return spark.createDataFrame(rows, "cluster string, y int, grp string, post boolean, size double, lat double")


def plain_design(rows, numeric):
    out = []
    for _, _, g, t, s, x in rows:
        row = [1.0, g == "b", g == "c"]
        if numeric:
            row += [s, x]
        row += [t, t and g == "b", t and g == "c"]
        out.append(row)
    return np.array(out, dtype=float)


def plain_fit(x, y, cluster):
    """Maximum likelihood, correlation, one step and covariance, written cluster by cluster from the formulas."""
    x0 = x.copy()
    center = np.zeros(x.shape[1])
    p = x.shape[1]
    beta = np.zeros(p)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x0 @ beta))
        beta = beta + np.linalg.solve((x0 * (mu * (1 - mu))[:, None]).T @ x0, x0.T @ (y - mu))
    groups = [np.flatnonzero(cluster == c) for c in sorted(set(cluster))]

    def parts(b, g):
        mu = 1 / (1 + np.exp(-x[g] @ b))
        v = mu * (1 - mu)
        return v, (y[g] - mu) / np.sqrt(v), y[g] - mu

    top = bottom = 0.0
    for g in groups:
        _, e, _ = parts(beta, g)
        top += (e.sum() ** 2 - (e**2).sum()) / 2
        bottom += len(g) * (len(g) - 1) / 2
    rho = top / bottom

    def pass_at(b):
        w, shift, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for g in groups:
            v, e, r = parts(b, g)
            a = (np.sqrt(v)[:, None] * x[g]).sum(axis=0)
            c = rho / (1 - rho + len(g) * rho)
            w += (x[g] * v[:, None]).T @ x[g] - c * np.outer(a, a)
            shift += c * e.sum() * a
            u = x[g].T @ r - c * a * e.sum()
            meat += np.outer(u, u)
        return w, shift, meat

    w, shift, _ = pass_at(beta)
    stepped = beta - np.linalg.solve(w, shift)
    w, _, meat = pass_at(stepped)
    inverse = np.linalg.inv(w)
    return beta, rho, stepped, inverse @ meat @ inverse


def model(numeric):
    covariates = ["grp", *(["size", "lat"] if numeric else []), "post"]
    return BinaryModel("y", covariates, {"grp": LEVELS}, period="post", period_interactions=["grp"])


@pytest.mark.parametrize("numeric", [False, True])
def test_matches_cluster_loop(spark, numeric):
    rows = sample()
    fit = reg.one_step_gee(to_df(spark, rows), model(numeric), "cluster")
    beta, rho, stepped, cov = plain_fit(
        plain_design(rows, numeric), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    )
    assert fit.rho == pytest.approx(rho, rel=1e-8)
    np.testing.assert_allclose(fit.beta_start, beta, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(fit.beta, stepped, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(fit.covariance, cov, rtol=1e-5, atol=1e-8)
    assert (fit.rows, fit.clusters) == (len(rows), 25)


def test_agrees_with_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = to_df(spark, sample())
    spec = model(True)
    wide = design_matrix(df, spec, "cluster")
    names = [c for c in wide.columns if c not in ("cluster", "y", "(intercept)")]
    plain = wide.toDF("cluster", "y", "one", *[f"x{i}" for i in range(len(names))])
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(plain)
    ml = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", tol=1e-12).fit(vectors)
    terms, beta = reg.fit_glm(df, spec, "cluster")
    assert terms == ["(intercept)", *names]
    np.testing.assert_allclose(beta, [ml.intercept, *ml.coefficients], rtol=1e-5, atol=1e-6)
    one = df.limit(5)
    means = reg.predict(one, spec, terms, beta).collect()
    assert all(0 < r["mean"] < 1 for r in means)


def test_odds_ratio_tables(spark):
    df = to_df(spark, sample())
    spec = model(False)
    fit = reg.one_step_gee(df, spec, "cluster")
    odds = {r["term"]: r for r in reg.odds_ratios(spark, fit, ["grp[b]", "grp[c]"]).collect()}
    i = fit.index("grp[b]")
    assert odds["grp[b]"]["odds_ratio"] == pytest.approx(np.exp(fit.beta[i]))
    assert odds["grp[b]"]["upper"] == pytest.approx(
        np.exp(fit.beta[i] + 1.959963984540054 * np.sqrt(fit.covariance[i, i]))
    )
    post = reg.contrast_odds_ratios(spark, fit, reg.period_pairs(fit, spec, "grp")).collect()
    assert [r["term"] for r in post] == ["grp[b] + post:grp[b]", "grp[c] + post:grp[c]"]
    assert reg.coefficients(spark, fit).count() == 6 and reg.covariances(spark, fit).count() == 36


def test_missing_and_unlisted_rows_are_left_out(spark):
    rows = sample(rows=600)
    extra = [("k1", 1, "zz", True, 1.0, 45.0), ("k1", 1, None, True, 1.0, 45.0), ("k1", 0, "a", None, 1.0, 45.0)]
    clean = reg.one_step_gee(to_df(spark, rows), model(False), "cluster")
    dirty = reg.one_step_gee(to_df(spark, rows + extra), model(False), "cluster")
    np.testing.assert_allclose(clean.beta, dirty.beta, rtol=1e-10)
    assert dirty.rows == 600


def test_unused_level_is_reported(spark):
    spec = BinaryModel("y", ["grp", "post"], {"grp": [*LEVELS, "never"]})
    with pytest.warns(UserWarning, match="never"):
        fit = reg.one_step_gee(to_df(spark, sample(rows=600)), spec, "cluster")
    assert fit.aliased == ["grp[never]"]
    last = [r for r in reg.coefficients(spark, fit).collect() if r["term"] == "grp[never]"]
    assert last[0]["beta"] is None


def test_separated_outcome(spark):
    """One cell without successes: an estimate with a warning; means and the other terms are those of the cells."""
    rows = [("k%d" % (i % 5), 0 if i % 3 == 0 else i % 2, LEVELS[i % 3], i % 4 < 2, 1.0, 2.0) for i in range(300)]
    with pytest.warns(reg.SeparatedOutcome, match="intercept"):
        fit = reg.one_step_gee(to_df(spark, rows), model(False), "cluster")
    assert np.isfinite(fit.beta).all() and np.isfinite(fit.covariance).all() and fit.beta_start[0] < -12
    with pytest.warns(reg.SeparatedOutcome):
        terms, beta = reg.fit_glm(to_df(spark, rows), model(False), "cluster")
    by = dict(zip(terms, beta))
    for g in ("b", "c"):
        hits = [r[1] for r in rows if r[2] == g and not r[3]]
        assert by["(intercept)"] + by[f"grp[{g}]"] == pytest.approx(np.log(sum(hits) / (len(hits) - sum(hits))), abs=1e-6)


def test_rare_outcome_is_not_separated(spark, recwarn):
    """One success in very many rows needs many steps, but has a finite estimate."""
    df = spark.range(400_000).selectExpr(
        "concat('k', id % 40) AS cluster", "cast(id = 7 AS int) AS y", "if(id % 2 = 0, 'a', 'b') AS grp",
        "id % 3 = 0 AS post", "1.0D AS size", "2.0D AS lat",
    )
    terms, beta = reg.fit_glm(df, BinaryModel("y", [], {}), "cluster")
    assert terms == ["(intercept)"] and beta[0] == pytest.approx(-np.log(399_999), abs=1e-8)
    assert not [w for w in recwarn if issubclass(w.category, reg.SeparatedOutcome)]


def test_singleton_clusters(spark):
    lone = [(f"k{i}", i % 2, LEVELS[(i // 2) % 3], (i // 6) % 2 == 0, 1.0, 2.0) for i in range(240)]
    with pytest.raises(reg.UndefinedCorrelation):
        reg.one_step_gee(to_df(spark, lone), model(False), "cluster")
    assert reg.cluster_correlation(to_df(spark, lone), model(False), "cluster").first()["rho"] is None


def test_dependent_terms_have_no_estimate(spark):
    """The later of two dependent terms is left out, as if it had not been asked for."""
    rows = [(*r[:4], 3.0 * (r[2] == "b") - 2.0 * (r[2] == "c") + 1.0, r[5]) for r in sample(rows=900)]
    df = to_df(spark, rows).withColumn("twin", F.col("grp")).withColumn("sum", F.col("lat") * 2 + F.col("size"))
    spec = BinaryModel("y", ["grp", "size", "lat", "twin", "sum", "post"], {"grp": LEVELS, "twin": None}, "post", ["grp"])
    with pytest.warns(UserWarning, match="twin"):
        fit = reg.one_step_gee(df, spec, "cluster")
    assert fit.aliased == ["size", "twin[b]", "twin[c]", "sum"]
    less = BinaryModel("y", ["grp", "lat", "post"], {"grp": LEVELS}, "post", ["grp"])
    plain = reg.one_step_gee(df, less, "cluster")
    assert fit.terms == plain.terms
    np.testing.assert_allclose(fit.beta, plain.beta, rtol=1e-7)
    np.testing.assert_allclose(fit.covariance, plain.covariance, rtol=1e-6, atol=1e-9)
    missing = reg.coefficients(spark, fit).where("beta IS NULL").collect()
    assert [r["term"] for r in missing] == fit.aliased


def test_outcomes_fitted_together(spark):
    """Two outcomes in the same passes, some rows without the second, give what each gives alone."""
    df = to_df(spark, sample(rows=1200)).withColumn("z", F.when(F.col("size") > 0.5, (F.col("lat") > 44.99).cast("int")))
    df = df.withColumn("z", F.when(F.hash("lat") % 7 == 0, 1 - F.col("z")).otherwise(F.col("z")))
    for numeric in (False, True):
        first = model(numeric) if not numeric else BinaryModel("y", ["grp", "lat", "post"], {"grp": LEVELS}, "post", ["grp"])
        second = replace(first, outcome="z")
        both = reg.one_step_gees(df, [first, second], "cluster")
        for fit, spec in zip(both, (first, second)):
            alone = reg.one_step_gee(df, spec, "cluster")
            assert (fit.rows, fit.clusters, fit.terms) == (alone.rows, alone.clusters, alone.terms)
            np.testing.assert_allclose(fit.beta, alone.beta, rtol=1e-8)
            np.testing.assert_allclose(fit.covariance, alone.covariance, rtol=1e-7)
    with pytest.raises(ValueError, match="outcome"):
        reg.one_step_gees(df, [model(False), replace(model(True), outcome="z")], "cluster")


def test_number_interactions(spark):
    rows = sample(rows=900)
    spec = BinaryModel(
        "y", ["grp", "lat", "post"], {"grp": LEVELS}, period="post", period_interactions=["lat"],
        category="grp", category_interactions=["lat", "grp"],
    )
    fit = reg.one_step_gee(to_df(spark, rows), spec, "cluster")
    assert fit.terms == [
        "(intercept)", "grp[b]", "grp[c]", "lat", "post", "grp[b]:lat", "grp[c]:lat", "post:lat",
    ]
    x = np.array(
        [[1, g == "b", g == "c", lat, t, (g == "b") * lat, (g == "c") * lat, t * lat] for _, _, g, t, _, lat in rows],
        dtype=float,
    )
    x[:, 3] -= 45; x[:, 5] -= 45 * x[:, 1]; x[:, 6] -= 45 * x[:, 2]; x[:, 7] -= 45 * x[:, 4]
    _, rho, stepped, _ = plain_fit(x, np.array([r[1] for r in rows]), np.array([r[0] for r in rows]))
    assert fit.rho == pytest.approx(rho, rel=1e-7)
    for name in ("lat", "grp[b]:lat", "grp[c]:lat", "post:lat"):
        k = fit.index(name)
        assert fit.beta[k] == pytest.approx(stepped[k], rel=1e-5)


def test_design_matrix_rows(spark):
    df = to_df(spark, [("k", 1, "b", True, 2.0, 3.0), ("k", 0, "a", False, 2.0, 3.0), ("k", 0, "q", False, 2.0, 3.0)])
    got = design_matrix(df, model(True), "cluster").orderBy(F.desc("y")).collect()
    assert [list(r)[2:] for r in got] == [[1, 1, 0, 2, 3, 1, 1, 0], [1, 0, 0, 2, 3, 0, 0, 0]]


def test_many_levels(spark):
    rng = np.random.default_rng(8)
    n, levels = 12_000, 300
    code = rng.integers(0, levels, n)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * x + 0.4 * np.sin(code))))).astype(int)
    rows = [(int(i % 40), int(a), f"L{b:03d}", float(c)) for i, (a, b, c) in enumerate(zip(y, code, x))]
    df = spark.createDataFrame(rows, "cluster int, y int, kind string, x double")
    spec = BinaryModel("y", ["kind", "x"], {"kind": None})
    fit = reg.one_step_gee(df, spec, "cluster")
    held = np.zeros((n, levels + 1))
    held[:, 0], held[np.arange(n), code], held[:, levels] = 1, 1, x
    held[:, 0] = 1
    beta, rho, stepped, cov = plain_fit(held, y, np.arange(n) % 40)
    assert fit.rho == pytest.approx(rho, rel=1e-7)
    np.testing.assert_allclose(fit.beta, stepped, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(fit.covariance, cov, rtol=1e-5, atol=1e-8)


def test_sums_leave_tasks_as_one_row(spark):
    df = spark.range(1000).repartition(9)
    total = reg._add_up(df, lambda pdf: np.full(50_000, float(pdf["id"].sum())), 50_000)
    assert (total == 499_500).all()
