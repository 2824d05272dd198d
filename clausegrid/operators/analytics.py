"""Cohorts, timelines, load summaries, interval and recursive joins, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles, least and greatest value."""
    cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points]
    return df.groupBy(*by).agg(F.min(value).alias("least"), *cols, F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def rate(part: Column, whole: Column, places: int = 1) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), places)


def cohort_rollup(df: DataFrame, levels: list[str], granted: Column) -> DataFrame:
    """Outcomes at each level of a hierarchy; scope is the name of the finest level that a row is for."""
    agg = df.rollup(*levels).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("applications"), F.count_if(granted).alias("granted"))
    scope = F.lit("all")
    for i, level in enumerate(levels):
        scope = F.when(F.col("g") == (1 << (len(levels) - 1 - i)) - 1, level).otherwise(scope)
    return agg.withColumn("scope", scope).withColumn("grant_rate", rate(F.col("granted"), F.col("applications"))).drop("g")


def yearly(df: DataFrame, date: str, granted: Column) -> DataFrame:
    agg = df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("applications"), F.count_if(granted).alias("granted"))
    return agg.withColumn("grant_rate", rate(F.col("granted"), F.col("applications")))


def without_last_years(timeline: DataFrame, n: int = 2) -> DataFrame:
    """A timeline (a row per year, so small) without its last, incomplete years."""
    return timeline.withColumn("r", F.row_number().over(Window.orderBy(F.desc("year")))).where(F.col("r") > n).drop("r")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left rows with the first right row of the same key, or nulls."""
    first = right.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy(order))).where("__r = 1").drop("__r")
    return left.join(first, on, "left")


def latest(df: DataFrame, by: list[str], ts: str, order: str, n: int = 12) -> DataFrame:
    """The newest n rows of each group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), F.asc(order)))).where(F.col("position") <= n)


def fresh(df: DataFrame, ts: str, now: Column, hours: int = 6) -> DataFrame:
    return df.where(F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))


def islands(df: DataFrame, by: list[str], start: str, end: str, order: str) -> DataFrame:
    """Merged covered spans and the gap before each: running greatest end, then lead."""
    w = Window.partitionBy(*by).orderBy(start, order)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("island", F.sum(F.when(F.col(start) <= reached, 0).otherwise(1)).over(w))
    return marked.groupBy(*by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))
