"""Rolling features of a panel with a row for each key and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

YEAR = 252


def frame(key: str, order: str, n: int, end: int = 0) -> WindowSpec:
    """The last n rows up to ``end`` (0: this one)."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(end - n + 1, end)


def at_least(x: Column, of: Column, w: WindowSpec, least: int) -> Column:
    """A windowed value where enough of the column is known in the window."""
    return F.when(F.count(of).over(w) >= least, x)


def rolling_rank(x: Column, w: WindowSpec, least: int) -> Column:
    """The share of the window's values that the current one reaches: ties count half, as with average ranks."""
    values = F.collect_list(x).over(w)
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when((F.size(values) >= least) & x.isNotNull(), (below + (same + 1) / 2) / F.size(values))


def drawdown_in(values: Column) -> Column:
    """The worst fall from a running maximum within an array; null for an empty one."""
    step = lambda s, v: F.struct(F.greatest(s["top"], v).alias("top"), F.least(s["worst"], v / F.greatest(s["top"], v) - 1).alias("worst"))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst"))
    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda s: s["worst"]))


def price_features(panel: DataFrame, key: str = "symbol", order: str = "session_no", benchmark: str | None = None) -> DataFrame:
    """Momentum, volatility, range, liquidity and benchmark features at every row of a dense panel.

    Needs close, high, low, volume and turnover. Windows count sessions; means and deviations skip nulls, and a
    momentum is null if its exact session is missing. benchmark names the column of the benchmark's close.
    """
    w = Window.partitionBy(key).orderBy(order)
    back = lambda k: F.lag("close", k).over(w)
    out = panel.withColumn("log_return", F.ln(F.try_divide(F.col("close"), back(1))))
    out = out.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back(1)), F.abs(F.col("low") - back(1))))
    if benchmark:
        out = out.withColumn("bench_return", F.ln(F.try_divide(F.col(benchmark), F.lag(benchmark).over(w))))
    f = lambda n: frame(key, order, n)
    illiquid = F.try_divide(F.abs(F.exp("log_return") - 1), F.when(F.col("turnover") > 0, F.col("turnover")))
    features = {
        "history_days": F.count("close").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)),
        "mom_12_1": F.try_divide(back(21), back(252)) - 1,
        "mom_6_1": F.try_divide(back(21), back(126)) - 1,
        "mom_1": F.try_divide(F.col("close"), back(21)) - 1,
        "vol_60": F.stddev_samp("log_return").over(f(60)) * YEAR**0.5,
        "vol_250": F.stddev_samp("log_return").over(f(250)) * YEAR**0.5,
        "dist_52w_high": F.try_divide(F.col("close"), F.max("close").over(f(251))) - 1,
        "dma50_ratio": F.try_divide(F.col("close"), F.avg("close").over(f(50))) - 1,
        "dma200_ratio": F.try_divide(F.col("close"), F.avg("close").over(f(200))) - 1,
        "atr14_pct": F.try_divide(F.avg("true_range").over(f(14)), F.col("close")),
        "adv20": F.avg("turnover").over(f(20)),
        "turnover_med120": F.percentile("turnover", F.lit(0.5)).over(f(120)),
        "vol_ratio_20_120": F.try_divide(F.avg("volume").over(f(20)), F.avg("volume").over(f(120))),
        "amihud_60": F.avg(illiquid).over(f(60)) * 1e9,
    }
    if benchmark:
        beta = F.try_divide(F.covar_samp("log_return", "bench_return").over(f(250)), F.var_samp("bench_return").over(f(250)))
        features["beta_250"] = F.when(F.count("bench_return").over(f(250)) > 30, beta)
    return out.withColumns(features)


class RunningSums:
    """Counts, sums and sums of products over the last rows of a key, from one running total each and its value some rows before.

    Every total runs over the same window, so a panel is sorted once and each row costs the same for windows of any length.
    """

    def __init__(self, key: str, order: str):
        self.order = Window.partitionBy(key).orderBy(order)
        self.totals: dict[str, Column] = {}

    def total(self, name: str, x: Column) -> None:
        self.totals[f"__n_{name}"] = F.count(x).over(self.order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
        self.totals[f"__s_{name}"] = F.coalesce(F.sum(x).over(self.order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))

    def of(self, kind: str, name: str, n: int) -> Column:
        held = F.col(f"__{kind}_{name}")
        return held - F.coalesce(F.lag(held, n).over(self.order), F.lit(0.0))

    def n(self, name: str, n: int) -> Column:
        return self.of("n", name, n)

    def sum(self, name: str, n: int) -> Column:
        return self.of("s", name, n)

    def mean(self, name: str, n: int) -> Column:
        return F.when(self.n(name, n) > 0, self.sum(name, n) / self.n(name, n))


def sampled_features(panel: DataFrame, dates: DataFrame, key: str = "symbol", order: str = "session_no", date: str = "trade_date", benchmark: str | None = None, delivery: str | None = None) -> DataFrame:
    """The features of :func:`price_features` at the rows of dates (as_of) alone, with beta, residual volatility, delivery and the year's drawdown.

    Means, deviations and the regression on the benchmark come from running sums: each session adds to totals, and a date takes their
    differences. Only the year's high, the drawdown, the median turnover and the illiquidity, which is a mean of very small numbers, need a
    date's own rows; they are cut from one array of a key's sessions (a few thousand). delivery names the column of the delivered share of the volume. A fortieth or so of a
    panel's rows are month ends: no window of 250 rows is evaluated at the others.
    """
    w = Window.partitionBy(key).orderBy(order)
    back = lambda k: F.lag("close", k).over(w)
    rows = panel.withColumn("__lr", F.ln(F.try_divide(F.col("close"), back(1))))
    rows = rows.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back(1)), F.abs(F.col("low") - back(1))))
    lr, sums = F.col("__lr"), RunningSums(key, order)
    for name, x in {"lr": lr, "lr2": lr * lr, "close": F.col("close"), "tr": F.col("__tr"), "turnover": F.col("turnover"), "volume": F.col("volume")}.items():
        sums.total(name, x)
    if delivery:
        sums.total("dp", F.col(delivery))
    if benchmark:
        rows = rows.withColumn("__b", F.ln(F.try_divide(F.col(benchmark), F.lag(benchmark).over(w))))
        b, both = F.col("__b"), F.col("__b").isNotNull() & lr.isNotNull()
        for name, x in {"b": b, "b2": b * b, "pb": F.when(both, b), "pl": F.when(both, lr), "plb": F.when(both, lr * b), "l0": F.when(lr.isNotNull(), F.coalesce(b, F.lit(0.0))), "l02": F.when(lr.isNotNull(), F.coalesce(b * b, F.lit(0.0))), "llb": F.when(lr.isNotNull(), F.coalesce(lr * b, F.lit(0.0)))}.items():
            sums.total(name, x)
    spread = lambda s2, s, n: F.when(n > 1, F.greatest((s2 - s * s / n) / (n - 1), F.lit(0.0)))
    year = F.lit(YEAR**0.5)
    vol = lambda k: F.sqrt(spread(sums.sum("lr2", k), sums.sum("lr", k), sums.n("lr", k))) * year
    ratio = lambda a, b: F.try_divide(a, F.when(b != 0, b))
    features = {
        "history_days": F.col("__n_close").cast("long"), "mom_12_1": ratio(back(21), back(252)) - 1, "mom_6_1": ratio(back(21), back(126)) - 1, "mom_1": ratio(F.col("close"), back(21)) - 1,
        "vol_60": vol(60), "vol_250": vol(250), "dma50_ratio": ratio(F.col("close"), sums.mean("close", 50)) - 1, "dma200_ratio": ratio(F.col("close"), sums.mean("close", 200)) - 1,
        "atr14_pct": ratio(sums.mean("tr", 14), F.col("close")), "adv20": sums.mean("turnover", 20), "vol_ratio_20_120": ratio(sums.mean("volume", 20), sums.mean("volume", 120)),
    }
    if delivery:
        features |= {"deliv_pct_20": sums.mean("dp", 20), "deliv_ratio": ratio(sums.mean("dp", 20), sums.mean("dp", 120))}
    if benchmark:
        n = sums.n("pb", 250)
        cov = F.when(n > 1, (sums.sum("plb", 250) - sums.sum("pb", 250) * sums.sum("pl", 250) / n) / (n - 1))
        beta = F.when(sums.n("b", 250) > 30, ratio(cov, spread(sums.sum("b2", 250), sums.sum("b", 250), sums.n("b", 250))))
        # the deviation of lr - beta * b, an unknown b or beta counting as 0, over the rows with a return
        k, m = F.coalesce(beta, F.lit(0.0)), sums.n("lr", 250)
        left2 = sums.sum("lr2", 250) - 2 * k * sums.sum("llb", 250) + k * k * sums.sum("l02", 250)
        left = sums.sum("lr", 250) - k * sums.sum("l0", 250)
        features |= {"beta_250": beta, "idio_vol_250": F.when(sums.n("b", 250) > 30, F.sqrt(spread(left2, left, m)) * year)}
    held = rows.withColumns(sums.totals).withColumns(features)
    at = held.join(F.broadcast(dates.select(F.col("as_of").alias(date)).distinct()), date, "left_semi").where("close is not null")
    path = panel.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "close", "turnover"))).alias("__path"), F.min(order).alias("__first"))
    # a dense panel: a session's place in its key's array follows from its number
    last = lambda k: F.slice("__path", F.greatest(F.col(order) - F.col("__first") + 2 - k, F.lit(1)).cast("int"), F.least(F.lit(k), F.col(order) - F.col("__first") + 1).cast("int"))
    closes = F.filter(F.transform(last(251), lambda r: r["close"]), lambda v: v.isNotNull())
    traded = F.array_sort(F.filter(F.transform(last(120), lambda r: r["turnover"]), lambda v: v.isNotNull()))
    middle = F.when(F.size("__t") > 0, (F.get("__t", F.floor((F.size("__t") - 1) / 2).cast("int")) + F.get("__t", F.floor(F.size("__t") / 2).cast("int"))) / 2)
    moved = lambda a, b: F.try_divide(F.abs(F.exp(F.ln(F.try_divide(b["close"], a["close"]))) - 1), F.when(b["turnover"] > 0, b["turnover"]))
    days = last(61)
    illiquid = F.filter(F.zip_with(F.slice(days, 1, F.size(days) - 1), F.slice(days, 2, 60), moved), lambda v: v.isNotNull())
    out = at.join(path, key).withColumns({"__c": closes, "__t": traded, "__i": F.when(F.size(days) > 1, illiquid)})
    mean = F.when(F.size("__i") > 0, F.aggregate("__i", F.lit(0.0), lambda s, v: s + v) / F.size("__i"))
    out = out.withColumns({"dist_52w_high": ratio(F.col("close"), F.array_max("__c")) - 1, "dd_250": drawdown_in(F.col("__c")), "turnover_med120": middle, "amihud_60": mean * 1e9})
    return out.select(key, F.col(date).alias("as_of"), "close", *features, "dist_52w_high", "dd_250", "turnover_med120", "amihud_60")


def drawdown_250(panel: DataFrame, key: str = "symbol", order: str = "session_no", n: int = 250) -> Column:
    """The worst drawdown inside the last n rows; costly, so select rows before or after as needed."""
    return drawdown_in(F.collect_list("close").over(frame(key, order, n)))


def market_regime(index: DataFrame, date: str = "trade_date", n: int = 200, least: int = 120, rank: int = 250) -> DataFrame:
    """(regime, exposure) of an index (close, vix): its mean of n sessions and the rank of its volatility.

    Above the mean and calm (rank under 0.8): RISK_ON, 1.0. Below and not calm, where an unknown rank isn't calm: RISK_OFF, 0.4. Else,
    and while the mean isn't known: NEUTRAL, 0.7. The index has a row a day.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(date)
    held = index.withColumn("vix", F.last("vix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mean = at_least(F.avg("close").over(order.rowsBetween(1 - n, 0)), F.col("close"), order.rowsBetween(1 - n, 0), least)
    held = held.withColumn("dma", mean).withColumn("vix_pct", rolling_rank(F.col("vix"), order.rowsBetween(1 - rank, 0), least))
    calm = F.coalesce(F.col("vix_pct") < 0.8, F.lit(False))
    regime = F.when(F.col("dma").isNull(), "NEUTRAL").when((F.col("close") > F.col("dma")) & calm, "RISK_ON").when((F.col("close") <= F.col("dma")) & ~calm, "RISK_OFF").otherwise("NEUTRAL")
    held = held.withColumn("regime", regime)
    return held.withColumn("exposure", F.when(F.col("regime") == "RISK_ON", 1.0).when(F.col("regime") == "RISK_OFF", 0.4).otherwise(0.7))
