"""Data-quality checks as tables of results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How severe a failed check is.
SEVERITY = {"row_count": "warn", "duplicate_keys": "block", "coverage": "warn", "jumps": "block", "freshness": "warn", "agreement": "block"}


def result(df: DataFrame, name: str, value: Column, passed: Column) -> DataFrame:
    """One row: (check_name, value, status, severity) of an aggregate."""
    return df.agg(value.cast("double").alias("value"), passed.alias("__p")).select(F.lit(name).alias("check_name"), "value", F.when(F.coalesce("__p", F.lit(False)), "pass").otherwise("fail").alias("status"), F.lit(SEVERITY.get(name.split(":")[0], "warn")).alias("severity"))


def row_count_band(df: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """Groups with a number of rows outside the band."""
    n = df.groupBy(by).count()
    bad = F.count_if(~F.col("count").between(low, high))
    return result(n, "row_count", bad, bad == 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).count().where("count > 1")
    return result(n, "duplicate_keys", F.count(F.lit(1)), F.count(F.lit(1)) == 0)


def coverage(df: DataFrame, column: str, least: float) -> DataFrame:
    """The share of rows that have a value."""
    share = F.avg(F.col(column).isNotNull().cast("double"))
    return result(df, f"coverage:{column}", share, share >= least)


def unexplained_jumps(panel: DataFrame, factors: DataFrame, key: str, date: str, price: str, most: float = 0.5) -> DataFrame:
    """Rows whose price moved by more than a share from the row before, on a day without a factor."""
    w = Window.partitionBy(key).orderBy(date)
    jumps = panel.withColumn("__r", F.abs(F.try_divide(F.col(price), F.lag(price).over(w)) - 1)).where(F.col("__r") > most)
    free = jumps.join(factors.select(key, F.col("ex_date").alias(date)), [key, date], "left_anti")
    n = F.count(F.lit(1))
    return result(free, "jumps", n, n == 0)


def freshness(df: DataFrame, key: str, date: str, as_of: Column, days: int, most: float) -> DataFrame:
    """The share of keys whose last date is older than some days."""
    last = df.groupBy(key).agg(F.max(date).alias("__l"))
    share = F.avg((F.datediff(as_of, "__l") > days).cast("double"))
    return result(last, "freshness", share, share <= most)


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, other: str, within: float, least: float) -> DataFrame:
    """The share of the keys in both whose values agree within a share."""
    both = a.join(b, list(keys))
    share = F.avg((F.abs(F.col(value) - F.col(other)) <= within * F.abs(F.col(other))).cast("double"))
    return result(both, "agreement", share, share >= least)


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def blockers(log: DataFrame) -> DataFrame:
    """The failed blocking checks of the latest run of a log (run_id, checked_at, check_name, status, severity)."""
    w = Window.partitionBy("check_name").orderBy(F.desc("checked_at"), F.desc("run_id"))
    return log.withColumn("__k", F.row_number().over(w)).where("__k = 1 and status = 'fail' and severity = 'block'").drop("__k")


def require_clean(log: DataFrame, force: bool = False) -> None:
    """Raise where the latest checks block, unless forced. A check is a row; a run has a few dozen."""
    names = [r["check_name"] for r in blockers(log).select("check_name").limit(100).collect()]
    if names and not force:
        raise RuntimeError("blocked by failed checks: " + ", ".join(sorted(names)))
