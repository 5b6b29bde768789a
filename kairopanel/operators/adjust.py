"""Adjustment of prices for splits, bonuses and consolidations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nearest_ratio

#: Price ratios of usual actions.
CLEAN_RATIOS = [1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10, 1 / 20, 1 / 25, 1 / 50, 2 / 3, 1 / 1.5, 2, 3, 4, 5, 10]


def day_factors(actions: DataFrame, key: str = "symbol", date: str = "ex_date") -> DataFrame:
    """(key, ex_date, factor): the product of all factors of a day."""
    return actions.where("factor > 0").groupBy(key, date).agg(F.exp(F.sum(F.ln("factor"))).alias("factor"))


def adjusted(panel: DataFrame, factors: DataFrame, key: str = "symbol", date: str = "trade_date", prices: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices times, and volume over, the product ``adj`` of all factors with a later ex-date, and its logarithm ``log_adj``; turnover stays.

    Factors are put among the rows of their key, so one sort serves, however many there are. A product beyond what a double holds
    is 0 or infinite, and so are the prices and the volume; log_adj stays exact.
    """
    known = factors.select(key, F.col("ex_date").alias(date), F.ln("factor").alias("__f"))
    rows = panel.select("*", F.lit(1).alias("__row")).unionByName(known.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    # from the last date back, so that the sum grows with the rows
    later = Window.partitionBy(key).orderBy(F.desc(F.unix_date(date))).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("log_adj", F.coalesce(F.sum("__f").over(later), F.lit(0.0))).where("__row = 1").drop("__f", "__row").withColumn("adj", F.exp("log_adj"))
    rows = rows.withColumns({p: F.col(p) * F.col("adj") for p in prices if p in panel.columns})
    return rows.withColumn("volume", F.col("volume") * F.exp(-F.col("log_adj"))) if "volume" in panel.columns else rows


def confirmed_actions(factors: DataFrame, panel: DataFrame, key: str = "symbol", date: str = "trade_date", days: int = 8, within: float = 0.35) -> DataFrame:
    """factors with confirmed_on and gap: the nearest session within some days whose price gap is within a share of the factor.

    gap is the open over the close before. Ties go to the earlier session; factors without such a session keep nulls.
    Sessions and actions meet by runs of ``2 * days + 1`` days, a session in its own and those on either side.
    """
    w = Window.partitionBy(key).orderBy(date)
    run = lambda d: F.floor(F.unix_date(d) / (2 * days + 1))
    prior = F.lag("close").over(w)
    gaps = panel.select(key, F.col(date).alias("confirmed_on"), F.when((prior > 0) & (F.col("open") > 0), F.col("open") / prior).alias("gap")).where("gap is not null")
    gaps = gaps.withColumn("__run", F.explode(F.array_distinct(F.array(run(F.date_sub("confirmed_on", days)), run(F.date_add("confirmed_on", days))))))
    near = factors.withColumn("__run", run(F.col("ex_date"))).join(gaps, [key, "__run"]).where(F.abs(F.datediff("confirmed_on", "ex_date")) <= days).where(F.abs(F.col("gap") / F.col("factor") - 1) <= within)
    first = Window.partitionBy(key, "ex_date").orderBy(F.abs(F.datediff("confirmed_on", "ex_date")), "confirmed_on")
    near = near.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(key, "ex_date", "confirmed_on", "gap")
    return factors.join(near, [key, "ex_date"], "left")


def gap_candidates(panel: DataFrame, actions: DataFrame, key: str = "symbol", date: str = "trade_date", low: float = 0.7, high: float = 1.4, floor: float = 5.0, off: float = 0.08, persist: float = 0.25, apart: int = 5) -> DataFrame:
    """Sessions whose price gap looks like an action that nobody announced.

    The gap, the open over the close before, is at most ``low`` or at least ``high`` from a price of ``floor`` or more, near a usual
    ratio; the close three sessions on, at most 12 days later, over the close before is still within ``persist`` of the ratio;
    the median volume is at least 0.6 over a ratio below 1, where an unknown one rejects, and at most 1.6 over another; and no
    action is known within ``apart`` days.
    """
    w = Window.partitionBy(key).orderBy(date)
    rows = panel.select(
        key, date, "open", F.lag("close").over(w).alias("prior"), F.lead("close", 3).over(w).alias("later"), F.lead(date, 3).over(w).alias("later_on"),
        F.percentile("volume", F.lit(0.5)).over(w.rowsBetween(-25, -5)).alias("volume_before"), F.percentile("volume", F.lit(0.5)).over(w.rowsBetween(5, 25)).alias("volume_after"),
    ).where("prior > 0 and open > 0 and later > 0").withColumn("gap", F.col("open") / F.col("prior")).where((F.col("gap") <= low) | (F.col("gap") >= high)).where(F.col("prior") >= floor)
    rows = rows.withColumn("near", nearest_ratio(F.col("gap"), CLEAN_RATIOS)).where(F.col("near.off") <= off)
    ratio = F.col("near.ratio")
    rows = rows.where((F.datediff("later_on", date) <= 12) & (F.abs(F.col("later") / F.col("prior") / ratio - 1) <= persist))
    moved = F.col("volume_after") / F.nullif("volume_before", F.lit(0.0))
    rows = rows.where(F.when(ratio < 1, moved >= 0.6 / ratio).otherwise(F.coalesce(moved <= 1.6 / ratio, F.lit(True))))
    known = actions.select(F.col(key).alias("__k"), F.col("ex_date").alias("__x"))
    free = rows.join(known, (F.col(key) == F.col("__k")) & (F.abs(F.datediff(date, "__x")) <= apart), "left_anti")
    return free.select(key, F.col(date).alias("ex_date"), "gap", F.col("near.ratio").alias("factor"))


def adjusted_series(prices: DataFrame, factors: DataFrame, order: Sequence[str] = ("EQ", "BE"), key: str = "symbol", date: str = "trade_date") -> DataFrame:
    """One adjusted row for each key and date of prices in several series: that of the first series of the order, then by name.

    The series is chosen before a row meets the factors, so each factor counts once, however many series trade on a day.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("series"))
    place = F.when(place > 0, place).otherwise(len(order) + 1)
    rest = [c for c in prices.columns if c not in (key, date)]
    one = prices.groupBy(key, date).agg(F.min_by(F.struct(*rest), F.struct(place, "series")).alias("__x"))
    return adjusted(one.select(key, date, "__x.*"), factors, key, date)
