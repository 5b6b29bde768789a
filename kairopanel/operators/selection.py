"""Composite scores, selection with hysteresis and capped weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import weighted_mean
from .cross_section import zscore_grouped

#: Bucket weights of the long-horizon variants.
LONG_WEIGHTS = {
    "base": {"z_quality": 0.30, "z_value": 0.25, "z_momentum": 0.30, "z_lowrisk": 0.15},
    "quality_tilt": {"z_quality": 0.40, "z_value": 0.20, "z_momentum": 0.25, "z_lowrisk": 0.15},
    "momentum_tilt": {"z_quality": 0.25, "z_value": 0.20, "z_momentum": 0.40, "z_lowrisk": 0.15},
}
#: Component weights of the short-horizon variants.
SHORT_WEIGHTS = {
    "base": {"z_mom_1": 0.40, "z_breakout": 0.30, "z_delivery": 0.30},
    "breakout_tilt": {"z_mom_1": 0.30, "z_breakout": 0.45, "z_delivery": 0.25},
    "flow_tilt": {"z_mom_1": 0.30, "z_breakout": 0.25, "z_delivery": 0.45},
}


def composite(weights: dict[str, float], least: int = 2) -> Column:
    """Weighted mean of the known columns; null if fewer than ``least`` are known."""
    return weighted_mean([(F.col(c), w) for c, w in weights.items()], least)


def variants(df: DataFrame, weights: dict[str, dict[str, float]], least: int = 2) -> DataFrame:
    """A row for each variant: (..., variant, score)."""
    scored = F.array(*[F.struct(F.lit(v).alias("variant"), composite(w, least).alias("score")) for v, w in weights.items()])
    return df.withColumn("__v", F.explode(scored)).select("*", "__v.variant", "__v.score").drop("__v")


def rankable() -> Column:
    """Two known buckets and no surveillance."""
    return F.coalesce((F.col("buckets_known") >= 2) & (F.col("in_gsm") == 0) & (F.col("in_asm") == 0), F.lit(False))


def eligible(min_turnover: float = 1e7, min_price: float = 20.0, positive_profit: bool = True, least_days: int = 250) -> Column:
    """Whether a sleeve may hold a name: rankable, not banned, liquid, not too cheap, with a year's history and, if wanted, a profit; unknown counts against it."""
    at = lambda c, least: F.coalesce(F.col(c), F.lit(0)) >= least
    fit = rankable() & (F.coalesce(F.col("in_fo_ban"), F.lit(0)) == 0) & at("turnover_med120", min_turnover) & at("close", min_price) & at("history_days", least_days)
    return fit & (F.coalesce(F.col("pat_ttm"), F.lit(-1.0)) > 0) if positive_profit else fit


def short_scores(df: DataFrame, by: Sequence[str], group: str = "industry", weights: dict[str, dict[str, float]] = SHORT_WEIGHTS) -> DataFrame:
    """df with variant and score: grouped z-scores of mom_1, of the surge of volume of names within 0.05 of their high (0 for others), and of the delivery ratio.

    The ratios are cut to 5. A name without a momentum has no score; an unknown industry is a group of its own.
    """
    surge = F.when(F.col("dist_52w_high") >= -0.05, F.least(F.greatest(F.col("vol_ratio_20_120"), F.lit(0.0)), F.lit(5.0))).otherwise(0.0)
    df = df.withColumns({"__g": F.coalesce(F.col(group).cast("string"), F.lit("UNKNOWN")), "__breakout": surge, "__delivery": F.when(F.col("deliv_ratio").isNotNull(), F.least(F.greatest(F.col("deliv_ratio"), F.lit(0.0)), F.lit(5.0)))})
    for column, out in (("mom_1", "z_mom_1"), ("__breakout", "z_breakout"), ("__delivery", "z_delivery")):
        df = zscore_grouped(df, column, by, "__g", out)
    total = lambda w: F.when(F.col("mom_1").isNotNull(), reduce(lambda a, b: a + b, [x * F.col(c) for c, x in w.items()]))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), total(w).alias("score")) for v, w in weights.items()]))
    return df.withColumn("__v", each).select("*", "__v.variant", "__v.score").drop("__v", "__g", "__breakout", "__delivery")


def ranked(df: DataFrame, by: Sequence[str], key: str = "symbol", score: str = "score") -> DataFrame:
    """With rank from 1 by descending score, ties by key; rows without a score have none."""
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))


def select_with_hysteresis(df: DataFrame, by: Sequence[str], n: int, hold: float = 1.5, key: str = "symbol", as_of: str = "as_of", new: str | None = None, locked: str | None = None) -> DataFrame:
    """(by, as_of, key, rank, kept): n names a date; a name stays while its rank is at most hold * n, the best others fill up.

    What is held depends on the date before, so each group's dates are walked in order, by one task a group; only ranks up to
    hold * n, and locked rows, enter. new names a boolean column: false on a date admits no new names. locked names one that keeps a
    held name whatever its rank.
    """
    columns = [*by, as_of, key, "rank", F.col(new).alias("__new") if new else F.lit(True).alias("__new"), F.col(locked).alias("__locked") if locked else F.lit(False).alias("__locked")]
    near = df.select(*columns).where((F.col("rank") <= int(hold * n)) | F.col("__locked"))
    schema = near.select(*by, as_of, key, "rank").schema

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        out = []
        for _, day in rows.sort_values([as_of, "rank", key]).groupby(as_of, sort=True):
            stays = day[key].isin(held) & ((day["rank"] <= hold * n) | day["__locked"])
            room = max(0, n - int(stays.sum()))
            fresh = day[~stays & (day["rank"] <= hold * n) & day["__new"]].head(room)
            some = pd.concat([day[stays], fresh])
            some = some.assign(kept=some[key].isin(held))
            held = set(some[key])
            out.append(some)
        found = pd.concat(out)
        return found[[*by, as_of, key, "rank", "kept"]]

    return near.groupBy(*by).applyInPandas(walk, schema.add("kept", "boolean"))


def capped_weights(vol: np.ndarray, industry: np.ndarray, name_cap: float, industry_cap: float, exposure: float, rounds: int = 50) -> np.ndarray:
    """Weights in proportion to 1 / vol under both caps; what no name can take stays cash.

    Volatilities are at least 0.05; an unknown one is the median of the known, 0.3 if none is. A cap on names below 1 / n is
    raised to that. In each round industries above their cap shrink to it, and what is missing to 1 goes to the names of the
    others in proportion to their room below the cap.
    """
    known = vol[~np.isnan(vol)]
    w = 1 / np.maximum(np.where(np.isnan(vol), np.median(known) if len(known) else 0.3, vol), 0.05)
    most = max(name_cap, 1 / len(w))
    w = np.minimum(w / w.sum(), most)
    of = np.unique(industry, return_inverse=True)[1]
    for _ in range(rounds):
        held = np.bincount(of, w)
        w = w * np.where(held > industry_cap + 1e-12, industry_cap / np.maximum(held, 1e-300), 1.0)[of]
        missing = 1 - w.sum()
        room = np.where(held[of] >= industry_cap - 1e-9, 0.0, np.maximum(most - w, 0.0))
        if missing < 1e-9 or room.sum() <= 1e-12:
            break
        w = w + room * min(1.0, missing / room.sum())
    return np.round(w * exposure, 8)


def inverse_vol_weights(df: DataFrame, by: Sequence[str], key: str = "symbol", vol: str = "vol_60", industry: str = "industry", name_cap: float = 0.05, industry_cap: float = 0.25, exposure: str | None = None) -> DataFrame:
    """(by, key, weight) of the selected names, a few dozen a group."""
    rows = df.select(*by, key, F.col(vol).cast("double").alias("__vol"), F.coalesce(industry, F.lit("?")).alias("__industry"), (F.col(exposure) if exposure else F.lit(1.0)).cast("double").alias("__exposure"))
    schema = rows.select(*by, key).schema

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        w = capped_weights(rows["__vol"].to_numpy(float), rows["__industry"].to_numpy(str), name_cap, industry_cap, float(rows["__exposure"].iloc[0]))
        return rows[[*by, key]].assign(weight=w)

    return rows.groupBy(*by).applyInPandas(weigh, schema.add("weight", "double"))
