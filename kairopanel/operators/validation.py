"""Statistics that judge scores: forward returns, rank correlations, deciles, folds, calibration, ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .asof import asof_join
from .cross_section import average_rank, deciles
from .quantiles import group_quantiles


def forward_returns(panel: DataFrame, dates: DataFrame, calendar: DataFrame, horizon: int, key: str = "symbol", date: str = "trade_date", grace: int = 5, haircut: float = 0.01) -> DataFrame:
    """(as_of, key, fwd, matured, delisted): adjusted return from each date to the ``horizon``-th session after it.

    panel: (key, trade_date, close), adjusted; calendar: (trade_date, session_no), a row a day. Where a key's last price lies more than ``grace`` sessions
    before the end, it counts as delisted: the return to its last price, less the haircut. A date whose end lies beyond the calendar isn't matured.
    """
    cal = calendar.select(F.col(date), "session_no")
    last = calendar.agg(F.max("session_no").alias("__end"))
    ends = dates.select("as_of").join(cal.withColumnRenamed(date, "as_of"), "as_of").withColumn("__to", F.col("session_no") + horizon).crossJoin(F.broadcast(last))
    ends = ends.withColumn("matured", F.col("__to") <= F.col("__end")).drop("session_no")
    rows = panel.select(key, date, "close").where("close is not null").join(F.broadcast(cal), date).select(key, "session_no", "close")
    start = rows.join(F.broadcast(ends.join(cal.withColumnRenamed(date, "as_of"), "as_of")), "session_no").select(key, "as_of", "__to", "__end", "matured", F.col("close").alias("__first"))
    # the last price up to the end: ends and prices of a key in one sorted run
    last_price = rows.select(key, "session_no", F.col("close").alias("__last"), F.col("session_no").alias("__s"))
    met = asof_join(start, last_price, [key], "__to", "session_no", ["__last", "__s"])
    gone = F.col("matured") & (F.col("__to") - F.col("__s") > grace)
    ret = F.try_divide("__last", "__first") * F.when(gone, 1 - haircut).otherwise(1.0) - 1
    return met.select("as_of", key, F.when(F.col("matured"), ret).alias("fwd"), "matured", gone.alias("delisted"))


def rank_ic(df: DataFrame, by: Sequence[str], score: str, outcome: str, least: int = 30) -> DataFrame:
    """(by, ic, n): Spearman correlation of each date with at least ``least`` complete names."""
    both = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    both = both.withColumn("__a", average_rank(F.col(score), by)).withColumn("__b", average_rank(F.col(outcome), by))
    return both.groupBy(*by).agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def newey_west(df: DataFrame, by: Sequence[str], value: str, order: str, lags: int = 11) -> DataFrame:
    """(by, mean, t, n): mean of a series and its t-statistic with Bartlett weights."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).withColumn("__e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    own = [F.sum(F.col("__e") * F.col("__e")).alias("g0")] + [F.sum(F.col("__e") * F.col(f"__l{k}")).alias(f"g{k}") for k in range(1, lags + 1)]
    rows = rows.withColumns({f"__l{k}": F.lag("__e", k).over(w) for k in range(1, lags + 1)})
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), *own)
    var = F.col("g0")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))
    # variance of the mean: sum of weighted autocovariances over n squared
    return out.withColumn("t", F.try_divide(F.col("mean"), F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("n"), F.lit(0.0)))).select(*by, "mean", "t", "n")


def decile_means(df: DataFrame, by: Sequence[str], score: str, outcome: str, key: str = "symbol", n: int = 10) -> DataFrame:
    """(decile, mean, names): outcomes by decile of each date's scores, and whether the mean rises from the decile below."""
    both = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    both = both.withColumn("decile", deciles([score, key], by, n))
    out = both.groupBy("decile").agg(F.avg(outcome).alias("mean"), F.count("*").alias("names"))
    return out.withColumn("rises", F.col("mean") > F.lag("mean").over(Window.orderBy("decile")))


def verdict_shares(df: DataFrame, by: Sequence[str], verdict: str) -> DataFrame:
    """(verdict, share): mean over the dates of each verdict's share of the date's names."""
    counts = df.groupBy(*by, verdict).agg(F.count("*").alias("__n"))
    share = counts.withColumn("__s", F.col("__n") / F.sum("__n").over(Window.partitionBy(*by)))
    dates = df.select(*by).distinct().agg(F.count("*").alias("__d"))
    return share.groupBy(verdict).agg(F.sum("__s").alias("__t")).crossJoin(F.broadcast(dates)).select(verdict, (F.col("__t") / F.col("__d")).alias("share"))


def long_short(df: DataFrame, by: Sequence[str], top: Column, bottom: Column, outcome: str, least: int = 5) -> DataFrame:
    """(by, spread): mean outcome of the top minus that of the bottom names, where either side has enough."""
    x = lambda c: F.when(c & F.col(outcome).isNotNull(), F.col(outcome))
    out = df.groupBy(*by).agg(F.avg(x(top)).alias("__a"), F.avg(x(bottom)).alias("__b"), F.count(x(top)).alias("__n"), F.count(x(bottom)).alias("__m"))
    return out.where((F.col("__n") >= least) & (F.col("__m") >= least)).select(*by, (F.col("__a") - F.col("__b")).alias("spread"))


def transition_rate(df: DataFrame, keys: Sequence[str], as_of: str, value: str) -> DataFrame:
    """(transitions, changed, rate) of consecutive states of each key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(as_of))
    moved = df.withColumn("__b", before).where("__b is not null")
    return moved.agg(F.count("*").alias("transitions"), F.count_if(F.col(value) != F.col("__b")).alias("changed")).withColumn("rate", F.try_divide("changed", "transitions"))


def brier(train: DataFrame, test: DataFrame, score: str, event: str, bins: int = 10) -> DataFrame:
    """(brier, climatology, n): squared error of the event rates of train-score quantile bins, made monotone, on the test rows.

    The edges are exact quantiles of the train scores: ``bins`` - 1 numbers. The train rows are written once, as they are read three times.
    """
    train = written(train.select(score, event))
    edges = train.agg(F.avg(F.col(event).cast("double")).alias("__base")).crossJoin(F.broadcast(group_quantiles(train, [], score, [k / bins for k in range(1, bins)], "__e").drop("n")))
    place = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("__bin", F.size(F.filter("__e", lambda x: x < F.col(score))))
    rates = place(train).groupBy("__bin").agg(F.avg(F.col(event).cast("double")).alias("__r"))
    rates = rates.withColumn("__p", F.max("__r").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))).select("__bin", "__p")
    scored = place(test).join(F.broadcast(rates), "__bin", "left")
    y = F.col(event).cast("double")
    return scored.agg(F.avg(F.pow(F.coalesce("__p", "__base") - y, 2)).alias("brier"), F.avg(F.pow(F.col("__base") - y, 2)).alias("climatology"), F.count("*").alias("n"))


def normal_cdf(z: Column) -> Column:
    """For small results: Python computes one value a row."""
    return _mapped(NormalDist().cdf, z)


def normal_ppf(p: Column) -> Column:
    return _mapped(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None, p)


def _mapped(f, x: Column) -> Column:
    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore").astype(float)

    return each(x)


def deflated_sharpe(stats: DataFrame, trials: int | None = None) -> DataFrame:
    """Statistics of each trial (n, mean, sd, skew, kurtosis: not in excess) with sr, sr0 and dsr, the probability that the true ratio exceeds what luck gives the best of all.

    trials: how many were tried, the number of rows unless given.
    """
    gamma = 0.5772156649015329
    rows = stats.withColumn("sr", F.try_divide("mean", F.nullif(F.col("sd"), F.lit(0.0))))
    k = rows.agg(F.var_samp("sr").alias("__v"), F.count("sr").alias("__k"))
    rows = rows.crossJoin(F.broadcast(k)).withColumn("__k", F.lit(float(trials)) if trials else F.col("__k").cast("double"))
    best = (1 - gamma) * normal_ppf(1 - 1 / F.col("__k")) + gamma * normal_ppf(1 - 1 / (F.col("__k") * F.exp(F.lit(1.0))))
    rows = rows.withColumn("sr0", F.when(F.col("__k") > 1, F.sqrt("__v") * best).otherwise(0.0))
    z = (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.col("sr") * F.col("sr"))
    return rows.withColumn("dsr", normal_cdf(z)).drop("__v", "__k")


def walk_forward(returns: DataFrame, variant: str, ret: str, date: str, embargo_days: int = 30, train_years: int = 3) -> DataFrame:
    """(year, variant, train_sharpe, oos_n, oos_mean): for each test year the variant with the best train ratio, and what it did in that year.

    Train windows are the years before, ending ``embargo_days`` before the test year begins. Folds are rows that the returns are joined
    with, not a loop.
    """
    years = returns.select(F.year(date).alias("year")).distinct()
    rows = returns.select(F.col(variant), F.col(ret).alias("__r"), F.col(date).alias("__d"))
    start = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    inside = (F.col("__d") < F.date_sub(start, embargo_days)) & (F.col("__d") >= F.add_months(start, -12 * train_years))
    ratio = F.try_divide(F.avg("__r"), F.nullif(F.stddev_samp("__r"), F.lit(0.0))) * 252**0.5
    train = rows.join(F.broadcast(years), inside).groupBy("year", variant).agg(ratio.alias("train_sharpe"))
    best = train.where("train_sharpe is not null").withColumn("__k", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("train_sharpe"), variant))).where("__k = 1").drop("__k")
    test = rows.groupBy(F.year("__d").alias("year"), variant).agg(F.count("*").alias("oos_n"), F.avg("__r").alias("oos_mean"))
    return best.join(test, ["year", variant])


def publish(candidates: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that the append-only ledger doesn't have yet, pending."""
    return candidates.join(ledger.select(*keys), list(keys), "left_anti").withColumn("status", F.lit("pending"))


def mature(ledger: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ledger with fwd, bench and status: hit or miss where the outcome (keys, fwd, bench, matured, delisted) is matured."""
    done = ledger.drop("status", "fwd", "bench").join(outcomes, list(keys), "left")
    status = F.when(~F.coalesce("matured", F.lit(False)), "pending").when(F.coalesce("delisted", F.lit(False)), "delisted").when(F.col("fwd") > F.col("bench"), "hit").otherwise("miss")
    return done.withColumn("status", status).drop("matured", "delisted")


def ledger_report(ledger: DataFrame, by: Sequence[str], least: int = 100) -> DataFrame:
    """(by, matured, hit_rate, mean_excess), the rates only from ``least`` matured rows on."""
    done = F.col("status") != "pending"
    out = ledger.groupBy(*by).agg(F.count_if(done).alias("matured"), F.avg(F.when(done, (F.col("status") == "hit").cast("double"))).alias("hit_rate"), F.avg(F.when(done, F.col("fwd") - F.col("bench"))).alias("mean_excess"))
    enough = F.col("matured") >= least
    return out.withColumn("hit_rate", F.when(enough, F.col("hit_rate"))).withColumn("mean_excess", F.when(enough, F.col("mean_excess")))
