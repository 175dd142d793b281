"""Binary regression with exchangeable within-cluster correlation: one-step estimating equations, robust covariance.

All sums over rows are taken as moments per (cluster, category combination): within a combination the design row is
fixed but for the few numeric covariates, so a handful of sums per group - combined map-side, in generated code -
carry everything the estimator needs. Models that differ in their outcome alone share the rows and every pass: their
moments are columns of one grouping. Per-cluster vectors and the p x p matrices are built from those groups on the
executors; a task sends one packed array, added up by a layer of reducers, and only sums reach the driver. A model
without numeric covariates is first compressed to row counts, after which no pass reads the data again.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from eventrates.functions.columns import Z_95, logistic
from eventrates.operators.design import INTERCEPT, BinaryModel, Term, complete_rows
from eventrates.session import stored

WEIGHT = "__w"
# A term is dependent where earlier terms leave no more than this share of its square in the information matrix.
DEPENDENT = 1e-11
# A step below this ends the fit, as the next would be about its square; a relative change of the deviance below FLAT
# asks whether the outcome is separated.
STEP, FLAT = 1e-6, 1e-8


class SeparatedOutcome(UserWarning):
    """Some combination of terms tells the outcome without error, so an estimate grows without end."""


class UndefinedCorrelation(ValueError):
    """No cluster has two rows, so there is no within-cluster pair to estimate a correlation from."""


@dataclass
class _Prepared:
    """Complete rows of models with one design, numbers standardised, with a row weight; and how to undo the latter.

    ``kept`` is the table held in storage while the models are fitted. ``terms`` name levels by their codes.
    """

    rows: DataFrame
    kept: DataFrame
    model: BinaryModel
    outcomes: list[str]
    cluster: str
    terms: list[Term]
    shift: dict[str, float]
    scale: dict[str, float]

    @property
    def basis(self) -> list[str | None]:
        """The constant and the numbers a term may be multiplied by."""
        return [None, *self.model.numbers]

    def unscale(self, used: Sequence[int]) -> np.ndarray:
        """Matrix taking coefficients of standardised numbers to those of the raw ones."""
        position = {(self.terms[k].where, self.terms[k].number): i for i, k in enumerate(used)}
        matrix = np.eye(len(used))
        for i, t in enumerate(self.terms[k] for k in used):
            if t.number is not None:
                matrix[i, i] = 1 / self.scale[t.number]
                if self.shift[t.number]:
                    matrix[position[(t.where, None)], i] = -self.shift[t.number] / self.scale[t.number]
        return matrix


@dataclass
class _State:
    """One outcome while it is fitted: the terms in use, their coefficients, and sums at these."""

    y: int
    used: list[int]
    beta: np.ndarray
    score: np.ndarray | None = None
    gram: np.ndarray | None = None
    likelihood: float = -np.inf
    separated: bool = False

    def at(self, beta: np.ndarray) -> _State:
        return replace(self, beta=beta)


@dataclass
class OneStepFit:
    """Estimates by term, robust covariance, correlation and sizes. Aliased terms have no estimate."""

    terms: list[str]
    beta_start: np.ndarray
    beta: np.ndarray
    covariance: np.ndarray
    rho: float
    rows: float
    clusters: int
    aliased: list[str]

    def index(self, term: str) -> int:
        return self.terms.index(term)


def _coded(rows: DataFrame, model: BinaryModel) -> tuple[DataFrame, list[Term]]:
    """Categories as the positions of their levels, in rows and terms: narrower to keep, faster to compare and group."""
    codes = {
        c: (F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c)) - 1).cast("int")
        for c, levels in model.levels.items()
    }

    def code(column: str, value: object) -> object:
        return model.levels[column].index(value) if column in model.levels else value

    terms = [replace(t, where=tuple((c, code(c, v)) for c, v in t.where)) for t in model.terms()]
    return rows.withColumns(codes), terms


def _prepare(df: DataFrame, models: Sequence[BinaryModel], cluster: str) -> _Prepared:
    """The shared rows of models that differ in their outcome alone."""
    model, outcomes = models[0].resolve(df), [m.outcome for m in models]
    if any(replace(m, outcome=model.outcome) != models[0] for m in models):
        raise ValueError("models fitted together differ in their outcome alone")
    rows, terms = _coded(complete_rows(df, model, cluster, outcomes), model)
    shift, scale = {}, {}
    if model.numbers:
        rows = kept = stored(rows).persist(StorageLevel.MEMORY_AND_DISK)
        sums = [f(c) for c in model.numbers for f in (F.avg, F.stddev_pop)]
        stats = rows.agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()
        shapes = {(t.where, t.number) for t in terms}
        for i, c in enumerate(model.numbers):
            # A number is centred only if each of its terms has the matching constant term to absorb the shift.
            absorbed = all((t.where, None) in shapes for t in terms if t.number == c)
            shift[c] = stats[2 * i] if absorbed and stats[2 * i] is not None else 0.0
            scale[c] = stats[2 * i + 1] or 1.0
        rows = rows.withColumns({c: (F.col(c) - shift[c]) / scale[c] for c in model.numbers}).withColumn(
            WEIGHT, F.lit(1.0)
        )
    else:
        rows = rows.groupBy(cluster, *model.patterns, *outcomes).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
        kept = rows = stored(rows).persist(StorageLevel.MEMORY_AND_DISK)
    return _Prepared(rows, kept, model, outcomes, cluster, terms, shift, scale)


def _indicators(pdf: pd.DataFrame, terms: Sequence[Term]) -> np.ndarray:
    """Group x term 0/1 matrix of a small table of category combinations."""
    held = np.ones((len(pdf), len(terms)))
    for k, term in enumerate(terms):
        for column, value in term.where:
            held[:, k] *= (pdf[column] == value).to_numpy(dtype=float)
    return held


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _linear(prep: _Prepared, used: Sequence[int], beta: np.ndarray) -> Column:
    """Linear predictor. Terms of the same columns share one array of coefficients, looked up by the levels' codes."""
    tables: dict[tuple[tuple[str, ...], str | None], dict[tuple[int, ...], float]] = {}
    for k, value in zip(used, beta):
        term = prep.terms[k]
        columns = tuple(c for c, _ in term.where)
        tables.setdefault((columns, term.number), {})[tuple(int(v) for _, v in term.where)] = float(value)
    eta = F.lit(0.0)
    for (columns, number), values in tables.items():
        sizes = [len(prep.model.levels[c]) if c in prep.model.levels else 2 for c in columns]
        flat, place = np.zeros(int(np.prod(sizes, dtype=np.int64))), F.lit(0)
        for codes, value in values.items():
            flat[int(np.ravel_multi_index(codes, sizes)) if codes else 0] = value
        for c, size in zip(columns, sizes):
            place = place * size + F.col(c).cast("int")
        part = F.get(F.array(*[F.lit(float(v)) for v in flat]), place)
        eta = eta + (part if number is None else part * F.col(number))
    return eta


def _moments(prep: _Prepared, states: Sequence[_State], by_cluster: bool) -> DataFrame:
    """Weighted sums per category combination (and cluster) at the states' coefficients, all outcomes in one grouping.

    With the state's number in front, ``R``: residuals, ``M``: variances, times the constant and the numbers; by cluster
    also ``n``, the sum and sum of squares of standardised residuals, and ``A``: root variances.
    """
    z = [F.lit(1.0) if c is None else F.col(c) for c in prep.basis]
    keys = [*([prep.cluster] if by_cluster else []), *prep.model.patterns]
    sums = {}
    scored = prep.rows.withColumns({f"__eta{s.y}": _linear(prep, s.used, s.beta) for s in states})
    scored = scored.withColumns({f"__mu{s.y}": logistic(f"__eta{s.y}") for s in states})
    # 1 - mu as the logistic of -eta keeps its digits when mu is near one.
    scored = scored.withColumns({f"__v{s.y}": F.col(f"__mu{s.y}") * logistic(-F.col(f"__eta{s.y}")) for s in states})
    for s in states:
        outcome = F.col(prep.outcomes[s.y])
        w = F.when(outcome.isNotNull(), F.col(WEIGHT)).otherwise(0.0)
        y = F.coalesce(outcome, F.lit(0.0))
        eta, mu, v = (F.col(f"__{c}{s.y}") for c in ("eta", "mu", "v"))
        of = {f"R{j}": F.sum(w * (y - mu) * z[j]) for j in range(len(z))}
        of |= {f"M{i}_{j}": F.sum(w * v * z[i] * z[j]) for i, j in _pairs(len(z))}
        if by_cluster:
            e = (y - mu) / F.sqrt(v)
            of |= {"n": F.sum(w), "se": F.sum(w * e), "see": F.sum(w * e * e)}
            of |= {f"A{j}": F.sum(w * F.sqrt(v) * z[j]) for j in range(len(z))}
        else:
            softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
            of["ll"] = F.sum(w * (y * eta - softplus))
        sums |= {f"{s.y}_{name}": value for name, value in of.items()}
    return scored.groupBy(*keys).agg(*[value.alias(name) for name, value in sums.items()])


def _add_up(df: DataFrame, vector: Callable[[pd.DataFrame], np.ndarray], length: int) -> np.ndarray:
    """Sum over all rows of ``df`` of a vector each batch contributes.

    A task sends one row with its whole sum. About the root of the shuffle partitions' number of reducers add these up,
    and the driver adds what they send.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                total = vector(pdf) if total is None else total + vector(pdf)
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for data in pdf["s"]:
                part = np.frombuffer(data)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    reducers = isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = df.mapInPandas(partial, "s binary").repartition(max(1, reducers)).mapInPandas(added, "s binary")
    result = np.zeros(length)
    for row in sent.collect():
        result += np.frombuffer(row[0])
    return result


def _packed(matrix: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix."""
    return matrix[np.triu_indices(len(matrix))]


def _square(packed: np.ndarray, p: int) -> np.ndarray:
    matrix = np.zeros((p, p))
    matrix[np.triu_indices(p)] = packed
    return matrix + np.triu(matrix, 1).T


def _triangle(p: int) -> int:
    return p * (p + 1) // 2


def _evaluated(groups: DataFrame, prep: _Prepared, states: Sequence[_State]) -> list[_State]:
    """The states with score, information matrix and log-likelihood from moments per category combination."""
    terms, basis = prep.terms, prep.basis
    place = np.array([basis.index(t.number) for t in terms])
    todo = [(s.y, np.array(s.used, dtype=int)) for s in states]
    with_likelihood = f"{states[0].y}_ll" in groups.columns

    def vector(pdf: pd.DataFrame) -> np.ndarray:
        every, parts = _indicators(pdf, terms), []
        for y, used in todo:
            held, own = every[:, used], place[used]
            residual = pdf[[f"{y}_R{j}" for j in range(len(basis))]].to_numpy()
            gram = np.zeros((len(used), len(used)))
            for i, j in _pairs(len(basis)):
                rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
                block = (held[:, rows] * pdf[f"{y}_M{i}_{j}"].to_numpy()[:, None]).T @ held[:, columns]
                gram[np.ix_(rows, columns)] = block
                gram[np.ix_(columns, rows)] = block.T
            parts += [(held * residual[:, own]).sum(axis=0), _packed(gram)]
            parts.append([pdf[f"{y}_ll"].sum() if with_likelihood else 0.0])
        return np.concatenate(parts)

    lengths = [len(used) + _triangle(len(used)) + 1 for _, used in todo]
    total, out = _add_up(groups, vector, sum(lengths)), []
    for s, part in zip(states, np.split(total, np.cumsum(lengths)[:-1])):
        p = len(s.used)
        out.append(replace(s, score=part[:p], gram=_square(part[p:-1], p), likelihood=float(part[-1])))
    return out


def independent(matrix: np.ndarray, tolerance: float = DEPENDENT) -> list[int]:
    """Terms, in order, that no earlier ones make up: Cholesky factors of a symmetric matrix, passing over the rest."""
    p = len(matrix)
    factor, kept = np.zeros((p, p)), []
    for j in range(p):
        row = factor[kept, j] if kept else np.zeros(0)
        left = matrix[j, j] - row @ row
        if left <= tolerance * matrix[j, j]:
            continue
        ahead = np.arange(j, p)
        factor[j, ahead] = (matrix[j, ahead] - row @ factor[np.ix_(kept, ahead)]) / np.sqrt(left)
        kept.append(j)
    return kept


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution scaled by the diagonal, so that terms of very different weight keep their digits."""
    size = 1 / np.sqrt(np.abs(np.diag(matrix)))
    right = right * size if right.ndim == 1 else right * size[:, None]
    found = np.linalg.solve(matrix * np.outer(size, size), right)
    return found * size if found.ndim == 1 else found * size[:, None]


def _tells_apart(prep: _Prepared, state: _State, direction: np.ndarray) -> bool:
    """Whether, along a direction of coefficients, each row's likelihood grows or stays: then no estimate is finite."""
    outcome = F.col(prep.outcomes[state.y])
    pull = F.when(outcome.isNotNull(), (2 * outcome - 1) * _linear(prep, state.used, direction / np.abs(direction).max()))
    low, high = prep.rows.agg(F.min(pull), F.max(pull)).first()
    return low is not None and high > 0 and low >= -1e-4 * high


def _maximum_likelihood(prep: _Prepared) -> tuple[list[_State], list[list[str]]]:
    """Newton's method, one pass over the moments for all outcomes at once. Returns states and terms left out of each.

    Terms that depend on earlier ones are left out. A fit ends when its step vanishes. When the deviance stops changing
    first, rows are asked whether the last step separates the outcome: if so, the estimate reached is returned with a
    warning. Each step raises the likelihood, so there is no limit of steps.
    """
    p = len(prep.terms)
    states = [_State(i, list(range(p)), np.zeros(p)) for i in range(len(prep.outcomes))]
    states, left_out = _evaluated(_moments(prep, states, False), prep, states), []
    for i, s in enumerate(states):
        if s.gram[0, 0] == 0:
            raise ValueError("no complete rows to fit")
        kept = independent(s.gram)
        left_out.append([t.name for k, t in enumerate(prep.terms) if k not in set(kept)])
        states[i] = replace(s, used=kept, beta=s.beta[kept], score=s.score[kept], gram=s.gram[np.ix_(kept, kept)])
    for names in {tuple(n) for n in left_out if n}:
        warnings.warn(f"terms that earlier terms make up, or that hold in no row, are left out: {list(names)}", stacklevel=3)
    steps = {i: _solve(s.gram, s.score) for i, s in enumerate(states)}
    while steps:
        tried = [states[i].at(states[i].beta + step) for i, step in steps.items()]
        tried = _evaluated(_moments(prep, tried, False), prep, tried)
        for i, trial in zip(list(steps), tried):
            before, size = states[i], np.abs(steps[i]).max()
            if not trial.likelihood >= before.likelihood - 1e-12 * abs(before.likelihood):
                steps[i] = steps[i] / 2
                if size < STEP:
                    del steps[i]
                continue
            change = abs(trial.likelihood - before.likelihood) / (abs(trial.likelihood) + 0.05)
            states[i] = trial
            if size > 1e-3 and change < FLAT and _tells_apart(prep, trial, steps[i]):
                far = [prep.terms[k].name for k, d in zip(trial.used, steps[i]) if abs(d) > 0.1 * size]
                warnings.warn(SeparatedOutcome(f"{prep.outcomes[i]} is told without error by {far}"), stacklevel=3)
                states[i] = replace(trial, separated=True)
                del steps[i]
                continue
            steps[i] = _solve(trial.gram, trial.score)
            if size < STEP or change == 0 and np.abs(steps[i]).max() >= size:
                del steps[i]
    return states, left_out


def _clusters(cells: DataFrame, prep: _Prepared, states: Sequence[_State]) -> DataFrame:
    """Per cluster and outcome: rows, sums of residuals, root-variance-weighted design sum ``a``, residual one ``u``.

    A cluster's cells, one for each category combination, come to one task in order and are added up as they come.
    """
    terms, basis = prep.terms, prep.basis
    place = np.array([basis.index(t.number) for t in terms])
    todo, cluster = [(s.y, np.array(s.used, dtype=int)) for s in states], prep.cluster

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        every, parts = _indicators(pdf, terms), []
        for y, used in todo:
            held, own = every[:, used], place[used]
            parts.append(pdf[[f"{y}_n", f"{y}_se", f"{y}_see"]].to_numpy())
            parts += [held * pdf[[f"{y}_{c}{j}" for j in range(len(basis))]].to_numpy()[:, own] for c in "AR"]
        return np.concatenate(parts, axis=1)

    def rows(totals: np.ndarray) -> pd.DataFrame:
        out, at = {}, 0
        for y, used in todo:
            for name in ("n", "se", "see"):
                out[f"{y}_{name}"] = totals[:, at]
                at += 1
            for name in "au":
                out[f"{y}_{name}"] = [t[at : at + len(used)].tobytes() for t in totals]
                at += len(used)
        return pd.DataFrame(out)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, total = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            names = pdf[cluster]
            starts = np.flatnonzero(np.concatenate([[True], (names.iloc[1:].to_numpy() != names.iloc[:-1].to_numpy())]))
            found = np.add.reduceat(sums(pdf), starts, axis=0)
            if total is not None:
                if names.iloc[0] == open_:
                    found[0] += total
                else:
                    found = np.vstack([total, found])
            open_, total = names.iloc[-1], found[-1]
            if len(found) > 1:
                yield rows(found[:-1])
        if total is not None:
            yield rows(total[None, :])

    kinds = {"n": "double", "se": "double", "see": "double", "a": "binary", "u": "binary"}
    schema = ", ".join(f"`{y}_{name}` {kind}" for y, _ in todo for name, kind in kinds.items())
    return cells.repartition(cluster).sortWithinPartitions(cluster).mapInPandas(added, schema)


def _correlation(clusters: DataFrame, states: Sequence[_State]) -> list[tuple[float | None, float, int]]:
    """By outcome: moment estimate of the exchangeable correlation, rows, clusters."""
    sums = []
    for s in states:
        n, se, see = (F.col(f"{s.y}_{c}") for c in ("n", "se", "see"))
        sums += [F.sum((se * se - see) / 2), F.sum(n * (n - 1) / 2), F.sum(n), F.count(F.when(n > 0, 1))]
    row = clusters.agg(*[c.alias(str(i)) for i, c in enumerate(sums)]).first()
    parts = [row[4 * i : 4 * i + 4] for i in range(len(states))]
    return [((p / q if q else None), n, k) for p, q, n, k in parts]


def _cluster_sums(
    clusters: DataFrame, states: Sequence[_State], rhos: Sequence[float]
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By outcome, sums over clusters: c a a', c (sum e) a, and outer products of the corrected scores."""
    todo = [(s.y, rho) for s, rho in zip(states, rhos)]

    def vector(pdf: pd.DataFrame) -> np.ndarray:
        parts = []
        for y, rho in todo:
            a, u = (np.stack([np.frombuffer(b) for b in pdf[f"{y}_{c}"]]) for c in "au")
            c = rho / (1 - rho + pdf[f"{y}_n"].to_numpy() * rho)
            pull = a * (c * pdf[f"{y}_se"].to_numpy())[:, None]
            corrected = u - pull
            parts += [_packed(a.T @ (a * c[:, None])), pull.sum(axis=0), _packed(corrected.T @ corrected)]
        return np.concatenate(parts)

    lengths = [n for s in states for n in (_triangle(len(s.used)), len(s.used), _triangle(len(s.used)))]
    parts = np.split(_add_up(clusters, vector, sum(lengths)), np.cumsum(lengths)[:-1])
    return [
        (_square(parts[3 * i], len(s.used)), parts[3 * i + 1], _square(parts[3 * i + 2], len(s.used)))
        for i, s in enumerate(states)
    ]


def cluster_correlation(df: DataFrame, model: BinaryModel, cluster: str) -> DataFrame:
    """One row: the correlation estimate at the maximum-likelihood fit (NULL without pairs), rows and clusters."""
    prep = _prepare(df, [model], cluster)
    try:
        states, _ = _maximum_likelihood(prep)
        ((rho, rows, count),) = _correlation(_clusters(_moments(prep, states, True), prep, states), states)
    finally:
        prep.kept.unpersist()
    return df.sparkSession.createDataFrame([(rho, int(rows), count)], "rho double, rows long, clusters long")


def fit_glm(df: DataFrame, model: BinaryModel, cluster: str) -> tuple[list[str], np.ndarray]:
    """Maximum-likelihood coefficients by term name, on the original scale; dependent terms are left out."""
    prep = _prepare(df, [model], cluster)
    try:
        (state,), _ = _maximum_likelihood(prep)
    finally:
        prep.kept.unpersist()
    return [prep.terms[k].name for k in state.used], prep.unscale(state.used) @ state.beta


def one_step_gee(df: DataFrame, model: BinaryModel, cluster: str) -> OneStepFit:
    """One estimating-equation step from the maximum-likelihood fit, with cluster-robust covariance at the new point.

    The correlation estimated at the start is kept for the covariance.
    """
    return one_step_gees(df, [model], cluster)[0]


def one_step_gees(df: DataFrame, models: Sequence[BinaryModel], cluster: str) -> list[OneStepFit]:
    """``one_step_gee`` of models that differ in their outcome alone, all from the same passes over the rows.

    A row takes part in the models whose outcome it has.
    """
    prep = _prepare(df, models, cluster)
    held: list[DataFrame] = [prep.kept]
    try:
        starts, left_out = _maximum_likelihood(prep)
        clusters = _clusters(_moments(prep, starts, True), prep, starts).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(clusters)
        sizes = _correlation(clusters, starts)
        if any(rho is None for rho, _, _ in sizes):
            raise UndefinedCorrelation("every cluster has a single row")
        rhos = [rho for rho, _, _ in sizes]
        sums = _cluster_sums(clusters, starts, rhos)
        ends = [s.at(s.beta - _solve(s.gram - outer, pull)) for s, (outer, pull, _) in zip(starts, sums)]

        cells = _moments(prep, ends, True).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(cells)
        sums = [c for c in cells.columns if re.fullmatch(r"[0-9]+_[RM][0-9_]+", c)]
        whole = cells.groupBy(*prep.model.patterns).agg(*[F.sum(c).alias(c) for c in sums])
        ends = _evaluated(whole, prep, ends)
        sums = _cluster_sums(_clusters(cells, prep, ends), ends, rhos)
    finally:
        for df_ in held:
            df_.unpersist()
    fits = []
    for start, end, (outer, _, scores), (rho, rows, count), unused in zip(starts, ends, sums, sizes, left_out):
        bread = _solve(end.gram - outer, np.eye(len(end.used)))
        back = prep.unscale(end.used)
        covariance = back @ bread @ scores @ bread.T @ back.T
        names = [prep.terms[k].name for k in end.used]
        fits.append(OneStepFit(names, back @ start.beta, back @ end.beta, covariance, rho, rows, count, unused))
    return fits


def predict(df: DataFrame, model: BinaryModel, terms: Sequence[str], beta: Sequence[float], out: str = "mean") -> DataFrame:
    """Add the predicted mean of each row; missing where the row lacks a covariate or has an unlisted level."""
    model = model.resolve(df)
    by_name = {t.name: t for t in model.terms()}
    eta = F.lit(0.0)
    for name, value in zip(terms, beta):
        eta = eta + by_name[name].column() * F.lit(float(value))
    known = F.lit(True)
    for c in model.patterns:
        known = known & (F.col(c).isin(list(model.levels[c])) if c in model.levels else F.col(c).isNotNull())
    return df.withColumn(out, F.when(known, logistic(eta)))


def coefficients(spark: SparkSession, fit: OneStepFit) -> DataFrame:
    """One row per term: starting and updated estimate, robust standard error; aliased terms with NULL."""
    se = np.sqrt(np.diag(fit.covariance))
    rows = [(t, float(b0), float(b), float(s)) for t, b0, b, s in zip(fit.terms, fit.beta_start, fit.beta, se)]
    rows += [(t, None, None, None) for t in fit.aliased]
    return spark.createDataFrame(rows, "term string, beta_start double, beta double, se double")


def covariances(spark: SparkSession, fit: OneStepFit) -> DataFrame:
    """One row per ordered pair of terms."""
    rows = [
        (a, b, float(fit.covariance[i, j])) for i, a in enumerate(fit.terms) for j, b in enumerate(fit.terms)
    ]
    return spark.createDataFrame(rows, "term_i string, term_j string, covariance double")


def _odds_rows(estimates: Sequence[tuple[str, float, float]], z: float) -> list[tuple]:
    return [(t, *(float(np.exp(b + d * z * s)) for d in (0, -1, 1))) for t, b, s in estimates]


ODDS_SCHEMA = "term string, odds_ratio double, lower double, upper double"


def odds_ratios(spark: SparkSession, fit: OneStepFit, terms: Sequence[str] | None = None, z: float = Z_95) -> DataFrame:
    """Odds ratio and Wald interval of the named terms (all but the intercept by default)."""
    names = [t for t in fit.terms if t != INTERCEPT] if terms is None else terms
    picked = [(t, fit.index(t)) for t in names]
    return spark.createDataFrame(
        _odds_rows([(t, fit.beta[i], np.sqrt(fit.covariance[i, i])) for t, i in picked], z), ODDS_SCHEMA
    )


def contrast_odds_ratios(
    spark: SparkSession, fit: OneStepFit, pairs: Sequence[tuple[str, str]], z: float = Z_95
) -> DataFrame:
    """Odds ratio of the sum of two terms, such as a category and its period interaction."""
    rows = []
    for main, added in pairs:
        i, j = fit.index(main), fit.index(added)
        variance = fit.covariance[i, i] + fit.covariance[j, j] + 2 * fit.covariance[i, j]
        rows.append((f"{main} + {added}", fit.beta[i] + fit.beta[j], np.sqrt(variance)))
    return spark.createDataFrame(_odds_rows(rows, z), ODDS_SCHEMA)


def period_pairs(fit: OneStepFit, model: BinaryModel, covariate: str) -> list[tuple[str, str]]:
    """Pairs (main term, period interaction) of a covariate's terms that both have an estimate."""
    mains = [t for t in fit.terms if t.startswith(f"{covariate}[") and ":" not in t]
    return [(t, f"{model.period}:{t}") for t in mains if f"{model.period}:{t}" in fit.terms]
