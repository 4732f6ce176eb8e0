"""Reusable metrics: named dimensions and measures over a source.

A measure is made of states that add up (sums, counts, distinct values) and a formula over them, so it can be worked out at
any grain from finer states; ratios and distinct counts are never averaged from finer results.
``MetricView.query`` adds only the joins the chosen expressions need, as left joins that keep every source row.  Before
joining a dimension it folds the source to one row for each chosen source dimension, join key and distinct value, so the
joins meet as many rows as there are keys, not as many as there are facts, and a hot store crosses them once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions.numeric import SCALE, fixed


@dataclass(frozen=True, eq=False)
class State:
    """A number to add up per row of the source, or with ``distinct`` a value to tell apart."""

    expr: Column
    distinct: bool = False

    def of_rows(self) -> Column:
        return F.count_distinct(self.expr) if self.distinct else F.sum(self.expr)


@dataclass(frozen=True, eq=False)
class Measure:
    """``formula`` gets a function from states to their aggregates."""

    states: tuple[State, ...]
    formula: Callable[[Callable[[State], Column]], Column]

    def of_rows(self) -> Column:
        return self.formula(State.of_rows)

    def _with(self, other: "Measure | float", how: Callable[[Column, Column], Column]) -> "Measure":
        if not isinstance(other, Measure):
            return Measure(self.states, lambda get: how(self.formula(get), F.lit(other)))
        return Measure(self.states + other.states, lambda get: how(self.formula(get), other.formula(get)))

    def __truediv__(self, other: "Measure | float") -> "Measure":
        """The quotient; NULL where the divisor is 0."""
        return self._with(other, lambda x, y: x / F.nullif(y, F.lit(0)))


def total(expr: Column | str) -> Measure:
    state = State(F.col(expr) if isinstance(expr, str) else expr)
    return Measure((state,), lambda get: get(state))


def count_of(condition: Column) -> Measure:
    """Rows for which the condition is true."""
    state = State(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return Measure((state,), lambda get: F.coalesce(get(state), F.lit(0).cast("bigint")))


def count_rows() -> Measure:
    return count_of(F.lit(True))


def money(expr: Column | str) -> Measure:
    """Exact sum of a DOUBLE with a bounded number of decimals."""
    return total(fixed(expr)) / SCALE


def mean(expr: Column | str) -> Measure:
    """Sum over the number of values that are not NULL."""
    c = F.col(expr) if isinstance(expr, str) else expr
    return total(c) / count_of(c.isNotNull())


def mean_money(expr: Column | str) -> Measure:
    c = F.col(expr) if isinstance(expr, str) else expr
    return money(c) / count_of(c.isNotNull())


def share(condition: Column) -> Measure:
    """Share of the rows for which the condition is true."""
    return count_of(condition) / count_rows()


def distinct(expr: Column | str) -> Measure:
    state = State(F.col(expr) if isinstance(expr, str) else expr, distinct=True)
    return Measure((state,), lambda get: get(state))


@dataclass(frozen=True)
class Join:
    """A table joined on equally named ``on`` columns; ``needs`` lists joins it builds on.

    ``fine`` says that the key is about as fine as the source's rows, so that folding by it would not pay.
    """

    table: DataFrame
    on: str
    columns: Mapping[str, str]
    needs: Sequence[str] = ()
    fine: bool = False


@dataclass(frozen=True)
class Field:
    """An expression over the columns of the source, or with ``joins`` over those joins' columns and keys.

    A measure with ``joins`` may hold distinct states only: it is taken after folding.
    """

    expr: Column | Measure
    joins: Sequence[str] = ()


@dataclass(frozen=True)
class MetricView:
    source: DataFrame
    dimensions: Mapping[str, Column | Field]
    measures: Mapping[str, Column | Measure | Field]
    joins: Mapping[str, Join] = field(default_factory=dict)

    def _pick(self, kind: str, names: Sequence[str], table: Mapping) -> list[tuple[str, Field]]:
        missing = [n for n in names if n not in table]
        if missing:
            raise KeyError(f"unknown {kind}: {', '.join(missing)}")
        return [(n, f if isinstance(f, Field) else Field(f)) for n in names for f in (table[n],)]

    def query(self, dimensions: Sequence[str] = (), measures: Sequence[str] = (),
              where: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """Measures grouped by dimensions; ``where`` maps a dimension to a condition on it."""
        dims = self._pick("dimension", dimensions, self.dimensions)
        aggs = self._pick("measure", measures, self.measures)
        tests = self._pick("dimension", list(where or {}), self.dimensions)
        names = self._needed([j for _, f in [*dims, *aggs, *tests] for j in f.joins])
        plain = [self.joins[n] for n in names]
        folds = bool(names) and not any(j.fine for j in plain) and all(isinstance(f.expr, Measure) for _, f in aggs)
        df = self.source
        for name, f in tests:
            if folds and not f.joins:
                df = df.filter(where[name](f.expr))
        if not folds:
            df = self._joined(df, plain)
            for name, f in tests:
                df = df.filter(where[name](f.expr))
            return df.groupBy(*[f.expr.alias(n) for n, f in dims]).agg(
                *[(f.expr.of_rows() if isinstance(f.expr, Measure) else f.expr).alias(n) for n, f in aggs])
        # Fold the facts, join the dimensions to what is left, and fold again at the wanted grain.
        states = [s for _, f in aggs if not f.joins for s in f.expr.states]
        own = {n: f"_d{i}" for i, (n, f) in enumerate(dims) if not f.joins}
        keys = [j.on for j in plain if j.on in self.source.columns]
        sums = {s: f"_s{i}" for i, s in enumerate(states) if not s.distinct}
        values = {s: f"_v{i}" for i, s in enumerate(states) if s.distinct}
        by = [f.expr.alias(own[n]) for n, f in dims if n in own]
        by += [F.col(k) for k in dict.fromkeys(keys)] + [s.expr.alias(a) for s, a in values.items()]
        folded = df.groupBy(*by).agg(*[F.sum(s.expr).alias(a) for s, a in sums.items()] or [F.lit(1).alias("_one")])
        df = self._joined(folded, plain)
        for name, f in tests:
            if f.joins:
                df = df.filter(where[name](f.expr))

        def get(state: State) -> Column:
            return F.sum(sums[state]) if state in sums else F.count_distinct(
                F.col(values[state]) if state in values else state.expr)

        return df.groupBy(*[(F.col(own[n]) if n in own else f.expr).alias(n) for n, f in dims]).agg(
            *[f.expr.formula(get).alias(n) for n, f in aggs])

    def _needed(self, names: Sequence[str]) -> list[str]:
        """The joins and what they build on, in an order in which they can be made."""
        out: list[str] = []
        for name in names:
            out += [n for n in [*self._needed(self.joins[name].needs), name] if n not in out]
        return out

    @staticmethod
    def _joined(df: DataFrame, joins: Sequence[Join]) -> DataFrame:
        for join in joins:
            cols = [F.col(join.on)] + [F.col(c).alias(a) for a, c in join.columns.items() if c != join.on]
            df = df.join(join.table.select(*cols), join.on, "left")
        return df
