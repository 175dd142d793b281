"""Clustered regressions of search outcomes on category and period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed
from eventrates.functions.columns import after_date, fill_missing, level_code
from eventrates.operators.clean import exclude_values
from eventrates.operators.design import BinaryModel
from eventrates.operators.regression import (
    OneStepFit,
    coefficients,
    contrast_odds_ratios,
    odds_ratios,
    one_step_gees,
    period_pairs,
)
from eventrates.operators.series import days_since_first
from eventrates.session import stored

CATEGORY, PERIOD, CLUSTER = "raceRecode", "postPeriod", "neighborhood"


def model_events(events: DataFrame, cutoff: str = fixed.PERIOD_CUTOFF) -> DataFrame:
    """Events with both search fields filled, outcomes coded 0/1, period flag, day number and filled reason."""
    kept = exclude_values(events, {"personSearch": [""], "vehicleSearch": [""]})
    coded = kept.withColumns(
        {
            PERIOD: after_date("date", cutoff),
            "personSearch": level_code("personSearch", ["NO", "YES"]),
            "vehicleSearch": level_code("vehicleSearch", ["NO", "YES"]),
            "reason": fill_missing("reason"),
        }
    )
    return days_since_first(coded, "date")


def search_model(outcome: str, adjusted: bool, levels: Sequence[str] = tuple(fixed.MODEL_LEVELS)) -> BinaryModel:
    """Category and period with their interaction; adjusted for person, problem, daylight and place if asked."""
    if not adjusted:
        return BinaryModel(outcome, [CATEGORY, PERIOD], {CATEGORY: levels}, PERIOD, [CATEGORY])
    factors = ["gender", "preRaceRecode", "problem", "reason"]
    return BinaryModel(
        outcome,
        [CATEGORY, *factors, "veilAfterSunset", "lat", "long", PERIOD],
        {CATEGORY: levels, **dict.fromkeys(factors)},
        PERIOD,
        [CATEGORY],
    )


@dataclass
class ModelResult:
    model: BinaryModel
    fit: OneStepFit
    coefficients: DataFrame
    odds: DataFrame
    period_odds: DataFrame


def fit_models(events: DataFrame, models: dict[str, BinaryModel], cluster: str = CLUSTER) -> dict[str, ModelResult]:
    """Fit several models. Those that differ in their outcome alone share their rows and every pass over them.

    The columns that the models use are stored once.
    """
    used = {cluster}
    for model in models.values():
        used |= {model.outcome, *model.covariates, *model.period_interactions, *model.category_interactions}
        used |= {model.period} if model.period else set()
    table = stored(events.select(*sorted(used)))
    together: dict[str, list[str]] = {}
    for name, model in models.items():
        design = replace(model, outcome="")
        same = next((d for d in together.values() if replace(models[d[0]], outcome="") == design), None)
        if same is None:
            together[name] = [name]
        else:
            same.append(name)
    fits: dict[str, OneStepFit] = {}
    for names in together.values():
        fits |= zip(names, one_step_gees(table, [models[n] for n in names], cluster))
    spark, results = events.sparkSession, {}
    for name, model in models.items():
        first, fit = next(iter(model.levels)), fits[name]
        own = [t for t in fit.terms if t.startswith(f"{first}[")]
        results[name] = ModelResult(
            model,
            fit,
            coefficients(spark, fit),
            odds_ratios(spark, fit, own),
            contrast_odds_ratios(spark, fit, period_pairs(fit, model, first)),
        )
    return results


def search_battery(events: DataFrame, cutoff: str = fixed.PERIOD_CUTOFF) -> dict[str, ModelResult]:
    """The four standard models: person and vehicle search, each plain and adjusted."""
    models = {
        f"{'adjusted' if adjusted else 'plain'}_{outcome}": search_model(outcome, adjusted)
        for outcome in ("personSearch", "vehicleSearch")
        for adjusted in (False, True)
    }
    return fit_models(model_events(events, cutoff), models)
