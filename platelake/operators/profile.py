"""Column profiles from mergeable states.

A state holds, for one table, column and day, what can be added up later: rows, NULLs, bounds, mean and squared deviation, an
HLL sketch of the distinct values and a KLL sketch of the numbers.  States of any window are merged without another scan of
the table.  All columns of a table are measured in one aggregation over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake.sources.keyed import KeyedTable

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
QUARTILES = (0.25, 0.5, 0.75)
STATE = ["table_name", "column_name", "day"]


def _number(name: str, kind: str) -> Column:
    """The column as a double; dates and times as seconds, NULL for other kinds."""
    c = F.col(f"`{name}`")
    if kind in NUMBERS or kind.startswith("decimal"):
        return c.cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp").cast("double")
    return F.lit(None).cast("double")


def _text(name: str, kind: str) -> Column:
    """The value as text, by which distinct values are told apart; nested values as JSON."""
    c = F.col(f"`{name}`")
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def states(df: DataFrame, table: str, day: Column | None = None, columns: list[str] | None = None, lg_k: int = 12) -> DataFrame:
    """A state for each column and day (NULL without ``day``): STATE, rows, nulls, low, high, mean, m2, distinct_sketch,
    number_sketch.

    Low, high, mean and the number sketch are of numbers and times (in seconds); NaN is left out of them, and counted in rows.
    """
    kinds = dict(df.dtypes)
    names = columns or df.columns
    aggs = []
    for i, name in enumerate(names):
        x = _number(name, kinds[name])
        x = F.when(~F.isnan(x), x)
        aggs.append(F.struct(
            F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(f"`{name}`").isNull()).alias("nulls"), F.count(x).alias("numbers"), F.min(x).alias("low"),
            F.max(x).alias("high"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
            F.hll_sketch_agg(_text(name, kinds[name]), F.lit(lg_k)).alias("distinct_sketch"),
            F.kll_sketch_agg_double(x).alias("number_sketch")).alias(f"s{i}"))
    flat = df.groupBy((F.lit(None).cast("date") if day is None else day.cast("date")).alias("day")).agg(*aggs)
    each = F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")
    return flat.select(F.lit(table).alias("table_name"), "day", each).select("table_name", "s.column_name", "day", *[
        f"s.{c}" for c in ("rows", "nulls", "numbers", "low", "high", "mean", "m2", "distinct_sketch", "number_sketch")])


def merged(parts: DataFrame, by: tuple[str, ...] = ("table_name", "column_name")) -> DataFrame:
    """The profile of all rows behind the states, per ``by``."""
    n = F.sum("numbers")
    mean = F.sum(F.col("numbers") * F.col("mean")) / n
    # Squared deviations around the common mean, from those around each state's own.
    out = parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        mean.alias("mean"), (F.sum(F.col("m2") + F.col("numbers") * F.col("mean") * F.col("mean")) - n * mean * mean).alias("m2"),
        n.alias("numbers"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.kll_merge_agg_double(F.when(F.col("numbers") > 0, F.col("number_sketch"))).alias("sketch"))
    quartiles = F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double(
        "sketch", F.array(*[F.lit(q) for q in QUARTILES])))
    spread = F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.nullif(F.col("numbers"), F.lit(0)))
    return out.select(*by, "rows", "nulls", "distinct_values", "low", "high", "mean", spread.alias("deviation"),
                      quartiles.alias("quartiles"))


class ProfileStore:
    """Stored states; a day that is measured again replaces its states."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = KeyedTable(spark, root, STATE, by="table_name", chars=255)

    def measure(self, df: DataFrame, table: str, day: Column | None = None, columns: list[str] | None = None) -> None:
        self.table.upsert(states(df, table, day, columns))

    def profile(self, table: str, first: str | None = None, last: str | None = None) -> DataFrame | None:
        """Profile of the days from ``first`` to ``last``, all of them by default; reads the table's states alone."""
        found = self.table.read_between(table, table)
        if found is None:
            return None
        if first is not None:
            found = found.filter(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            found = found.filter(F.col("day") <= F.lit(last).cast("date"))
        return merged(found)
