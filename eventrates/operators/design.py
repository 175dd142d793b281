"""Design of a binary regression: terms, complete rows, and the design matrix as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventrates.functions.columns import is_number, with_levels
from eventrates.session import levels_of_each

INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class Term:
    """One design column: an indicator (all listed column values hold) times at most one number."""

    name: str
    where: tuple[tuple[str, object], ...] = ()
    number: str | None = None

    def indicator(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in self.where], F.lit(True))

    def column(self) -> Column:
        value = F.lit(1.0) if self.number is None else F.col(self.number)
        return F.when(self.indicator(), value).otherwise(0.0)


@dataclass(frozen=True)
class BinaryModel:
    """Specification of a regression of a 0/1 outcome.

    ``covariates`` are in model order. Those named in ``levels`` are categories, the first level being the base;
    ``None`` as levels means all occurring values in alphabetical order. The others are booleans or numbers.
    ``category_interactions`` multiplies each non-base level of ``category`` with the listed numbers, and
    ``period_interactions`` the boolean ``period`` with every term of the listed covariates.
    """

    outcome: str
    covariates: Sequence[str]
    levels: Mapping[str, Sequence[str] | None] = field(default_factory=dict)
    period: str | None = None
    period_interactions: Sequence[str] = ()
    category: str | None = None
    category_interactions: Sequence[str] = ()
    booleans: frozenset[str] = frozenset()

    def resolve(self, df: DataFrame) -> BinaryModel:
        """Fill in level lists and learn which covariates are boolean."""
        used = [*self.covariates, *self.period_interactions, *([self.period] if self.period else [])]
        levels = {c: list(v) if v is not None else None for c, v in self.levels.items() if c in used}
        open_ = [c for c, v in levels.items() if v is None]
        levels |= levels_of_each(df, open_) if open_ else {}
        booleans = {c for c in used if c not in levels and isinstance(df.schema[c].dataType, T.BooleanType)}
        return replace(self, levels=levels, booleans=frozenset(booleans))

    @property
    def patterns(self) -> list[str]:
        """Columns an indicator may depend on."""
        used = dict.fromkeys([*self.covariates, *self.period_interactions, *([self.period] if self.period else [])])
        return [c for c in used if c in self.levels or c in self.booleans]

    @property
    def numbers(self) -> list[str]:
        """Numeric covariates."""
        used = dict.fromkeys([*self.covariates, *self.period_interactions, *self.category_interactions])
        return [c for c in used if c not in self.levels and c not in self.booleans]

    def pattern_bound(self) -> int:
        """Largest possible number of category combinations."""
        sizes = [len(self.levels[c]) if c in self.levels else 2 for c in self.patterns]
        return reduce(lambda a, b: a * b, sizes, 1)

    def _main(self, covariate: str) -> list[Term]:
        if covariate in self.levels:
            return [Term(f"{covariate}[{v}]", ((covariate, v),)) for v in self.levels[covariate][1:]]
        if covariate in self.booleans:
            return [Term(covariate, ((covariate, True),))]
        return [Term(covariate, (), covariate)]

    def terms(self) -> list[Term]:
        """Intercept, main effects, category interactions, period interactions."""
        terms = [Term(INTERCEPT)]
        for covariate in self.covariates:
            terms += self._main(covariate)
        for covariate in self.category_interactions:
            # Only numbers interact with the category; a category among them is passed over.
            if covariate in self.numbers:
                terms += [
                    Term(f"{t.name}:{covariate}", t.where, covariate) for t in self._main(self.category)
                ]
        for covariate in self.period_interactions:
            terms += [
                Term(f"{self.period}:{t.name}", ((self.period, True), *t.where), t.number)
                for t in self._main(covariate)
            ]
        return terms


def complete_rows(
    df: DataFrame, model: BinaryModel, cluster: str, outcomes: Sequence[str] | None = None
) -> DataFrame:
    """The model's columns of the rows that miss none of them; a value outside its level list counts as missing.

    Of several ``outcomes`` a row may miss some, but not all.
    """
    outcomes = [model.outcome] if outcomes is None else outcomes
    columns = [F.col(cluster), *[F.col(c).cast("double").alias(c) for c in outcomes]]
    for c in model.patterns:
        columns.append(with_levels(c, model.levels[c]).alias(c) if c in model.levels else F.col(c))
    columns += [F.col(c).cast("double").alias(c) for c in model.numbers]
    present = [F.col(c).isNotNull() for c in (cluster, *model.patterns)]
    present += [reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in outcomes])]
    present += [is_number(c) for c in model.numbers]
    return df.select(*columns).where(reduce(lambda a, b: a & b, present))


def design_matrix(df: DataFrame, model: BinaryModel, cluster: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cluster, outcome and one column per term. Column ``keep`` are carried along, such as a row key."""
    model = model.resolve(df)
    rows = df.select(*df.columns)
    present = [F.col(c).isNotNull() for c in (cluster, model.outcome, *model.patterns)]
    present += [with_levels(c, levels).isNotNull() for c, levels in model.levels.items()]
    present += [is_number(c) for c in model.numbers]
    rows = rows.where(reduce(lambda a, b: a & b, present))
    outcome = F.col(model.outcome).cast("double").alias(model.outcome)
    return rows.select(*keep, cluster, outcome, *[t.column().cast("double").alias(t.name) for t in model.terms()])
