"""Masking, row visibility, profiling and PII classification as data jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake import schemas
from platelake.functions.masks import mask_email, mask_phone

MASKS = {"class.email_address": mask_email, "class.phone_number": mask_phone}

ROW_FILTERED = ("guest_order", "waste_log", "loyalty_transaction", "guest_profile", "time_punch", "unit")

ADMIN_GROUP = "qsr_admin"

# Our rules: pattern of each class and the share of non-NULL values that must match.
PII_PATTERNS = {
    "class.email_address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "class.phone_number": r"(\+?\d{1,2}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}",
    "class.zip_code": r"^\d{5}(-\d{4})?\z",
    "class.name": r"^[A-Z][a-z]+( [A-Z][a-z]+)+\z",
}


def mask_by_tag(df: DataFrame, table: str, masks=None) -> DataFrame:
    """Mask every column whose class carries a mask; a table without declared classes is an error, not unmasked."""
    masks = MASKS if masks is None else masks
    if table not in schemas.COLUMN_TAGS:
        raise ValueError(f"no column classes are declared for {table}")
    tags = schemas.COLUMN_TAGS[table]
    return df.withColumns({c: masks[t](F.col(c)) for c, t in tags.items() if t in masks and c in df.columns})


def tagged(df: DataFrame, table: str) -> DataFrame:
    """Attach class tags as column metadata."""
    tags = schemas.COLUMN_TAGS.get(table, {})
    return df.select(*[F.col(c).alias(c, metadata={"class": tags[c]}) if c in tags else F.col(c) for c in df.columns])


def visible_to(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows the caller's groups may see: their franchisees, their regions, or all for admins."""
    if ADMIN_GROUP in groups:
        return df
    mine = F.concat(F.lit("franchisee_"), F.col("franchisee_id").cast("string")).isin(*groups) | F.concat(
        F.lit("region_"), F.col("region_id").cast("string")).isin(*groups)
    return df.filter(F.coalesce(mine, F.lit(False)))


def _statistics(c: str, dtype: str) -> list[Column]:
    col = F.col(c)
    stats = [F.count(F.lit(1)).alias("rows"), F.count_if(col.isNull()).alias("nulls"),
             F.approx_count_distinct(col).alias("distinct_values"),
             F.min(col).cast("string").alias("minimum"), F.max(col).cast("string").alias("maximum")]
    numeric = dtype in ("bigint", "int", "double")
    x = col.cast("double") if numeric else F.lit(None).cast("double")
    stats += [F.avg(x).alias("mean"), F.stddev(x).alias("stddev"),
              F.percentile_approx(x, [0.25, 0.5, 0.75]).alias("quartiles")]
    return [F.struct(F.lit(c).alias("column_name"), *stats).alias(f"s_{c}")]


def profile_table(df: DataFrame, columns: list[str] | None = None, ts: str | None = None,
                  width: str = "1 day") -> DataFrame:
    """Statistics per column, and per time window when ``ts`` is given.

    All columns are profiled in one aggregation over one scan.
    """
    kinds = dict(df.dtypes)
    cols = columns or df.columns
    aggs = [a for c in cols for a in _statistics(c, kinds[c])]
    by = [F.window(ts, width)["start"].alias("window_start")] if ts else []
    flat = df.groupBy(*by).agg(*aggs)
    keep = ["window_start"] if ts else []
    return flat.select(*keep, F.explode(F.array(*[F.col(f"s_{c}") for c in cols])).alias("s")).select(*keep, "s.*")


def daily_profile(df: DataFrame, columns: list[str], ts: str) -> DataFrame:
    """Exact rows, NULLs, minimum and maximum per day and numeric column."""
    aggs = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col(c).isNull()).alias("nulls"), F.min(F.col(c).cast("double")).alias("minimum"),
                     F.max(F.col(c).cast("double")).alias("maximum")).alias(f"s_{c}") for c in columns]
    flat = df.groupBy(F.to_date(F.window(ts, "1 day")["start"]).alias("day")).agg(*aggs)
    return flat.select("day", F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("day", "s.*")


def classify_pii(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Matching values of each class per column, and whether the column belongs to it."""
    aggs, parts = [], []
    for c in columns:
        aggs.append(F.count(c).alias(f"n_{c}"))
        for i, (tag, pattern) in enumerate(PII_PATTERNS.items()):
            aggs.append(F.count_if(F.col(c).rlike(pattern)).alias(f"m_{c}_{i}"))
            parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(tag).alias("class"),
                                  F.col(f"n_{c}").alias("values"), F.col(f"m_{c}_{i}").alias("matches")))
    rows = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    share = F.col("matches") / F.nullif(F.col("values"), F.lit(0))
    return rows.withColumn("detected", F.coalesce(share >= threshold, F.lit(False)))
