"""Returns, costs and statistics of target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portfolio_returns(weights: DataFrame, returns: DataFrame, by: Sequence[str], calendar: DataFrame, key: str = "symbol", as_of: str = "as_of", date: str = "trade_date") -> DataFrame:
    """(by, trade_date, ret, exposure): daily returns of weights that take effect at the next session and drift until the next ones.

    weights: (by, as_of, key, weight); returns: (key, trade_date, ret). A missing return is 0. Cash earns nothing. Without cash and lot accounting
    this approximates a simulation of orders: between rebalances, value is sum(w * growth) + cash.
    """
    w = Window.partitionBy(*by).orderBy(as_of)
    spans = weights.select(*by, as_of).distinct().withColumn("__until", F.lead(as_of).over(w))
    days = calendar.select(date).distinct()
    grid = spans.join(days, (F.col(date) > F.col(as_of)) & (F.col("__until").isNull() | (F.col(date) <= F.col("__until"))))
    held = grid.join(weights, [*by, as_of]).join(returns.select(key, date, "ret"), [key, date], "left")
    path = Window.partitionBy(*by, as_of, key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__growth", F.exp(F.sum(F.ln(F.greatest(1 + F.coalesce("ret", F.lit(0.0)), F.lit(1e-9)))).over(path)))
    value = held.groupBy(*by, as_of, date).agg((F.sum(F.col("weight") * F.col("__growth")) + 1 - F.sum("weight")).alias("__value"), F.sum("weight").alias("exposure"))
    before = F.coalesce(F.lag("__value").over(Window.partitionBy(*by, as_of).orderBy(date)), F.lit(1.0))
    return value.withColumn("ret", F.col("__value") / before - 1).select(*by, date, "ret", "exposure")


def turnover(weights: DataFrame, by: Sequence[str], key: str = "symbol", as_of: str = "as_of") -> DataFrame:
    """(by, as_of, key, before, weight, change): consecutive weights of every name held at either date."""
    dates = weights.select(*by, as_of).distinct().withColumn("__next", F.lead(as_of).over(Window.partitionBy(*by).orderBy(as_of)))
    now = weights.select(*by, F.col(as_of), key, "weight")
    old = weights.join(dates, [*by, as_of]).where("__next is not null").select(*by, F.col("__next").alias(as_of), key, F.col("weight").alias("before"))
    both = now.join(old, [*by, as_of, key], "full").fillna(0.0, ["weight", "before"])
    return both.withColumn("change", F.col("weight") - F.col("before"))


#: The fee schedule of an order.
FEES = {"brokerage": 20.0, "securities_tax": 0.001, "exchange": 0.0000297, "regulator": 1e-6, "stamp_buy": 0.00015, "tax_on_fees": 0.18, "sell_charge": 15.34, "impact_base_bps": 10.0, "impact_slope_bps": 50.0, "impact_cap_bps": 100.0, "unknown_participation": 0.05}


def order_cost(value: Column, buy: Column, adv: Column, fees: dict[str, float] = FEES) -> Column:
    """struct(explicit, impact, total, bps, participation) of an order of a value, at an average daily turnover."""
    f = fees
    exchange, regulator = value * f["exchange"], value * f["regulator"]
    explicit = f["brokerage"] + value * f["securities_tax"] + exchange + regulator + F.when(buy, value * f["stamp_buy"]).otherwise(f["sell_charge"]) + (f["brokerage"] + exchange + regulator) * f["tax_on_fees"]
    part = F.coalesce(F.try_divide(value, F.when(adv > 0, adv)), F.lit(f["unknown_participation"]))
    impact = value * F.least(F.lit(f["impact_cap_bps"]), f["impact_base_bps"] + f["impact_slope_bps"] * F.sqrt(part)) / 1e4
    return F.when(value > 0, F.struct(explicit.alias("explicit"), impact.alias("impact"), (explicit + impact).alias("total"), ((explicit + impact) / value * 1e4).alias("bps"), part.alias("participation")))


def delisting_returns(panel: DataFrame, last_session: int | Column, key: str = "symbol", grace: int = 5, haircut: float = 0.01) -> DataFrame:
    """(key, session_no, ret): the loss of names without a price for more than ``grace`` sessions, at the session after them."""
    last = panel.where("close is not null").groupBy(key).agg(F.max("session_no").alias("__last"))
    gone = last.where(F.lit(last_session) - F.col("__last") > grace)
    return gone.select(key, (F.col("__last") + grace + 1).alias("session_no"), F.lit(-haircut).alias("ret"))


def total_return_index(index: DataFrame, by: Sequence[str] = (), date: str = "trade_date", dividend: float = 0.013, days: int = 252) -> DataFrame:
    """With ret, the daily change plus a yield, and level, its compounded path from 1."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(date)
    out = index.withColumn("ret", F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1 + dividend / days, F.lit(0.0)))
    return out.withColumn("level", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def performance(returns: DataFrame, by: Sequence[str], ret: str = "ret", date: str = "trade_date", bench: str | None = None, rf: float = 0.06, year: int = 252) -> DataFrame:
    """Growth, risk and, given a benchmark's returns, active statistics of each group's daily returns."""
    path = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("__v", F.exp(F.sum(F.ln(1 + F.col(ret))).over(path)))
    rows = rows.withColumn("__dd", F.col("__v") / F.greatest(F.max("__v").over(path), F.lit(1.0)) - 1)
    x = F.col(ret) - rf / year
    aggs = [
        F.count(ret).alias("n"), F.exp(F.sum(F.ln(1 + F.col(ret)))).alias("multiple"), (F.stddev_samp(ret) * year**0.5).alias("vol"),
        (F.try_divide(F.avg(x), F.nullif(F.stddev_samp(ret), F.lit(0.0))) * year**0.5).alias("sharpe"),
        (F.try_divide(F.avg(x), F.nullif(F.stddev_samp(F.when(x < 0, x)), F.lit(0.0))) * year**0.5).alias("sortino"),
        F.min("__dd").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit"),
        F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurtosis"),
    ]
    if bench:
        active = F.col(ret) - F.col(bench)
        aggs += [
            (F.avg(active) * year).alias("active"), (F.stddev_samp(active) * year**0.5).alias("tracking_error"),
            F.try_divide(F.covar_samp(ret, bench), F.nullif(F.var_samp(bench), F.lit(0.0))).alias("beta"),
        ]
    out = rows.groupBy(*by).agg(*aggs).withColumn("cagr", F.pow("multiple", F.lit(year) / F.col("n")) - 1)
    out = out.withColumn("calmar", F.try_divide("cagr", F.nullif(F.abs("max_drawdown"), F.lit(0.0))))
    return out.withColumn("information_ratio", F.try_divide("active", F.nullif(F.col("tracking_error"), F.lit(0.0)))) if bench else out
