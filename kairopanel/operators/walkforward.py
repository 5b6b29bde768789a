"""Walk-forward tests: variants chosen on the past, judged on what comes next, stitched to one path; a holdout; all variants beside it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSIONS_A_YEAR = 252


def sharpe(ret: Column, rf_annual: float) -> Column:
    """Aggregate: the yearly ratio of the mean return over the risk-free one to the deviation."""
    return F.try_divide(F.avg(ret - rf_annual / SESSIONS_A_YEAR), F.nullif(F.stddev_samp(ret), F.lit(0.0))) * SESSIONS_A_YEAR**0.5


def fold_table(spark, start: str, years: Sequence[int], holdout: str, embargo_days: int) -> DataFrame:
    """(fold, train_from, train_to, test_from, test_to): a row a year that begins before the holdout, and the holdout's."""
    first, held = date.fromisoformat(start), date.fromisoformat(holdout)
    begins = [date(y, 1, 1) for y in years if date(y, 1, 1) < held]
    rows = [(str(d.year), first, d - timedelta(embargo_days), d, min(date(d.year, 12, 31), held - timedelta(1))) for d in begins]
    rows.append(("holdout", first, held - timedelta(embargo_days), held, date(9999, 12, 31)))
    return spark.createDataFrame(rows, "fold string, train_from date, train_to date, test_from date, test_to date")


def chosen_variants(returns: DataFrame, folds: DataFrame, variant: str, day: str, ret: str, rf_annual: float = 0.06, least_train: int = 250) -> DataFrame:
    """(fold, selected, train_sharpe, n_train, test_from, test_to): each fold's variant with the best train ratio, of equal ones the first by name.

    Folds (broadcast: a row a year) are met by range and summed at once; a variant with fewer than ``least_train`` train returns isn't chosen.
    """
    rows = returns.select(F.col(variant).alias("__v"), F.col(day).alias("__d"), F.col(ret).alias("__r")).where("__r is not null")
    met = rows.join(F.broadcast(folds), F.col("__d").between(F.col("train_from"), F.col("train_to")))
    ratios = met.groupBy("fold", "test_from", "test_to", "__v").agg(sharpe(F.col("__r"), rf_annual).alias("s"), F.count("*").alias("n")).where((F.col("n") >= least_train) & F.col("s").isNotNull())
    best = ratios.groupBy("fold", "test_from", "test_to").agg(F.min_by(F.struct("__v", "s", "n"), F.struct(-F.col("s"), "__v")).alias("b"))
    return best.select("fold", F.col("b.__v").alias("selected"), F.col("b.s").alias("train_sharpe"), F.col("b.n").alias("n_train"), "test_from", "test_to")


def stitched_path(returns: DataFrame, chosen: DataFrame, variant: str, day: str, ret: str, purge: int = 21, least_test: int = 40) -> DataFrame:
    """(fold, day, variant, ret): each test period's returns of the variant chosen for it, one after another.

    The first ``purge`` sessions of a period are left out, as positions may reach from the train period into them; so is a period of which
    fewer than ``least_test`` sessions are left.
    """
    on = (F.col(variant) == F.col("selected")) & F.col(day).between(F.col("test_from"), F.col("test_to"))
    rows = returns.where(F.col(ret).isNotNull()).join(F.broadcast(chosen.select("fold", "selected", "test_from", "test_to")), on)
    place = F.row_number().over(Window.partitionBy("fold").orderBy(day))
    rows = rows.withColumn("__k", place).where(F.col("__k") > purge).withColumn("__n", F.count("*").over(Window.partitionBy("fold")))
    return rows.where(F.col("__n") >= least_test).select("fold", day, F.col(variant), F.col(ret))


def judged(path: DataFrame, bench: DataFrame, by: Sequence[str], day: str, ret: str, rf_annual: float = 0.06) -> DataFrame:
    """(by, n, sharpe, information_ratio, cagr, excess_cagr, max_drawdown, best, worst, hit) of returns beside those of an index (day, bench).

    A day without a return of the index counts as 0. ``best``, ``worst`` and ``hit`` are of calendar months.
    """
    rows = path.join(bench.select(day, "bench"), day, "left").withColumn("bench", F.coalesce("bench", F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v", F.exp(F.sum(F.log1p(F.col(ret))).over(w)))
    rows = rows.withColumn("__dd", F.col("__v") / F.greatest(F.max("__v").over(w), F.lit(1.0)) - 1)
    active = F.col(ret) - F.col("bench")
    grown = lambda c: F.exp(F.sum(F.log1p(c)) * SESSIONS_A_YEAR / F.count("*")) - 1
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), sharpe(F.col(ret), rf_annual).alias("sharpe"), (F.try_divide(F.avg(active), F.nullif(F.stddev_samp(active), F.lit(0.0))) * SESSIONS_A_YEAR**0.5).alias("information_ratio"),
        grown(F.col(ret)).alias("cagr"), (grown(F.col(ret)) - grown(F.col("bench"))).alias("excess_cagr"), F.min("__dd").alias("max_drawdown"),
    )
    months = rows.groupBy(*by, F.trunc(day, "month").alias("__m")).agg((F.exp(F.sum(F.log1p(F.col(ret)))) - 1).alias("m"))
    months = months.groupBy(*by).agg(F.max("m").alias("best"), F.min("m").alias("worst"), F.avg((F.col("m") > 0).cast("double")).alias("hit"))
    return out.join(months, list(by)) if by else out.crossJoin(F.broadcast(months))
