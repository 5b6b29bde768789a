"""Small reads: slices of series, lists joined and compared, evidence by date, orders of work, the configuration in force, features of statements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import keep_first


def index_series(closes: DataFrame, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(trade_date, close) of one index between two dates, both included, in order."""
    rows = closes.where(F.col("index_name") == name)
    if start:
        rows = rows.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return rows.select("trade_date", "close").orderBy("trade_date")


def excluded(lists: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """The keys that any of the lists names, once."""
    return reduce(lambda a, b: a.unionByName(b), [x.select(key) for x in lists]).distinct()


def in_all(lists: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """The keys that every list names, once."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [x.select(key).distinct() for x in lists])


def visible_sources(sources: DataFrame, as_of: Column, key: str = "symbol", most: int = 12) -> DataFrame:
    """The sources (key, src_id, published, seen) seen by a date and not published after it, the newest first, undated ones last, so many a key, with place."""
    some = sources.where((F.col("seen") <= as_of) & (F.col("published").isNull() | (F.col("published") <= as_of)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("published").desc_nulls_last(), "src_id"))
    return some.withColumn("place", place).where(F.col("place") <= most)


def sweep_order(filings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """filings with turn: the order in which they are to be read, audited ones first, then the oldest period, ties by url."""
    audited = F.when(F.lower(F.trim("audited")) == "audited", 0).otherwise(1)
    return filings.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(audited, "period_end", "url")))


def validated_configuration(runs: DataFrame, key: str = "sleeve") -> DataFrame:
    """(key, verdict, top_n, variant, turnover) of the latest judged run (key, created_at, verdict, selected) of each sleeve.

    ``selected`` is written like L-N20-momentum_tilt-T1cr; one that isn't leaves the three null. A forced or open run isn't judged.
    """
    judged = runs.where(F.col("verdict").isin("VALIDATED", "NOT VALIDATED"))
    last = keep_first(judged, [key], [F.desc("created_at"), F.desc("selected"), "verdict"])
    part = lambda k: F.nullif(F.regexp_extract("selected", r"^[LS]-N([0-9]+)-([a-z_]+)-T([0-9]+)cr$", k), F.lit(""))
    return last.select(key, "verdict", part(1).cast("int").alias("top_n"), part(2).alias("variant"), (part(3).cast("double") * 1e7).alias("turnover"))


def evidence_status(latest: Column, as_of: Column, rank: Column, most_days: int = 40) -> Column:
    """OK, STALE where the latest row is older than some days, UNKNOWN where there is none or it has no rank."""
    return F.when(latest.isNull() | rank.isNull(), "UNKNOWN").when(F.datediff(as_of, latest) > most_days, "STALE").otherwise("OK")


def rank_percentile(rank: Column, universe: Column) -> Column:
    """1 for the best of many, 0 for the last."""
    return F.when(universe > 0, 1 - rank / universe)


def statement_features(quarters: DataFrame, key: str = "symbol", period: str = "period_end") -> DataFrame:
    """(key, period, sales_ttm, pat_ttm, sales_yoy_ttm, pat_yoy_ttm, opm_ttm, opm_chg_1y, fcf_ttm, ps, earnings_yield) at each quarter with four before it.

    quarters: (key, period, sales, operating_profit, net_profit, fcf, mcap, deposits), a row a quarter. A sum needs all four quarters within a
    year's span; growth compares with the sum four quarters before, where that is above 0; a lender (deposits known and above 0) has no
    free cash flow. Ratios over nothing, and infinite ones, are null.
    """
    w = Window.partitionBy(key).orderBy(period)
    whole = F.datediff(period, F.lag(period, 3).over(w)) <= 300
    four = w.rowsBetween(-3, 0)
    ttm = lambda c: F.when(whole & (F.count(c).over(four) == 4), F.sum(c).over(four))
    rows = quarters.withColumns({f"__{c}": ttm(c) for c in ("sales", "operating_profit", "net_profit", "fcf")})
    rows = rows.withColumn("__opm", F.try_divide("__operating_profit", F.when(F.col("__sales") > 0, F.col("__sales"))))
    before = lambda c: F.lag(c, 4).over(w)
    grown = lambda c: F.try_divide(F.col(c), F.when(before(c) > 0, before(c))) - 1
    lender = F.coalesce(F.col("deposits") > 0, F.lit(False))
    worth = F.when(F.col("mcap") > 0, F.col("mcap"))
    return rows.select(
        key, period, F.col("__sales").alias("sales_ttm"), F.col("__net_profit").alias("pat_ttm"), grown("__sales").alias("sales_yoy_ttm"), grown("__net_profit").alias("pat_yoy_ttm"), F.col("__opm").alias("opm_ttm"),
        (F.col("__opm") - before("__opm")).alias("opm_chg_1y"), F.when(~lender, F.col("__fcf")).alias("fcf_ttm"), F.try_divide(worth, F.when(F.col("__sales") > 0, F.col("__sales"))).alias("ps"),
        F.try_divide("__net_profit", worth).alias("earnings_yield"),
    )
