"""What has to hold before results are believed: checks against bars, capacity, states of a claim, trials counted once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bars of a calibration: (check, statistic, how it compares, bar). A statistic that is true or false has to be true.
CALIBRATION = [
    ("decile_monotonic_overall", "decile_monotonic_overall", "true", None), ("decile_monotonic_years_min_share", "decile_monotonic_years_share", ">=", 0.70), ("tiers_ordered", "tiers_ordered", "true", None), ("long_short_min_pp", "long_short_pp", ">=", 0.06),
    ("long_short_t_min", "long_short_t", ">=", 2.0), ("ic_mean_min", "ic_mean", ">=", 0.05), ("ic_t_min", "ic_t", ">=", 2.0), ("mos_ic_min", "mos_ic_mean", ">=", 0.03), ("mos_ic_t_min", "mos_ic_t", ">=", 1.5), ("hit_conviction_buy_min", "hit_conviction_buy", ">=", 0.60),
    ("hit_all_buy_min", "hit_all_buy", ">=", 0.55), ("hit_sell_min", "hit_sell", ">=", 0.55), ("hard_flag_precision_min", "hard_flag_precision", ">=", 0.65), ("brier_max", "brier", "<=", 0.24), ("brier_vs_climatology_min_gain", "brier_gain_vs_climatology", ">=", 0.01),
    ("coverage_neutral_abs_corr_max", "score_coverage_corr", "abs<=", 0.10), ("dci_informative", "dci_informative", "true", None), ("sector_max_share_conviction", "sector_max_share_conviction", "<=", 0.40), ("sector_ls_positive_min_profiles", "sector_ls_positive_profiles", ">=", 3.0),
    ("monthly_transition_max", "monthly_transition", "<=", 0.25), ("min_tier_share", "min_tier_share", ">=", 0.05), ("dsr_p_max", "dsr_p", "<=", 0.05), ("holdout_long_short_positive", "holdout_long_short", ">", 0.0),
]
#: The bars of a backtest.
BACKTEST = [
    ("oos_sharpe", "sharpe", ">=", 0.8), ("oos_information_ratio", "information_ratio", ">=", 0.5), ("oos_drawdown_not_worse_than_index", "drawdown_over_index", ">=", 0.0), ("deflated_sharpe", "dsr_p", "<", 0.05), ("recent_folds_positive_excess", "recent_folds_positive", ">=", 3.0),
    ("robust_across_variants", "worst_variant_sharpe", ">=", 0.5), ("capacity", "median_participation", "<", 0.05),
]


def checked(df: DataFrame, keys: Sequence[str], bars: list[tuple]) -> DataFrame:
    """(keys, check, value, bar, passed) of rows of statistics, a row for each bar; unknown where the statistic is, or its column missing."""

    def one(name: str, statistic: str, how: str, bar: float | None) -> Column:
        x = F.col(statistic).cast("double") if statistic in df.columns else F.lit(None).cast("double")
        holds = {">=": lambda: x >= bar, ">": lambda: x > bar, "<=": lambda: x <= bar, "<": lambda: x < bar, "abs<=": lambda: F.abs(x) <= bar, "true": lambda: x == 1}[how]()
        return F.struct(F.lit(name).alias("check"), x.alias("value"), F.lit(bar).cast("double").alias("bar"), holds.alias("passed"))

    return df.select(*keys, F.explode(F.array(*[one(*b) for b in bars])).alias("x")).select(*keys, "x.*")


def verdicts(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, verdict, n_pass, n_fail, n_unknown): validated where all checks pass; an unknown one isn't a pass."""
    n = lambda c: F.count_if(c)
    out = checks.groupBy(*keys).agg(n(F.col("passed")).alias("n_pass"), n(~F.col("passed")).alias("n_fail"), n(F.col("passed").isNull()).alias("n_unknown"))
    return out.withColumn("verdict", F.when((F.col("n_fail") == 0) & (F.col("n_unknown") == 0), "VALIDATED").otherwise("NOT VALIDATED"))


def capacity(orders: DataFrame, by: Sequence[str], value: str = "value", adv: str = "adv") -> DataFrame:
    """(by, p50, p90): quantiles of the orders' shares of the average daily turnover; orders without one don't count."""
    share = F.try_divide(F.col(value), F.when(F.col(adv) > 0, F.col(adv)))
    return orders.groupBy(*by).agg(F.percentile(share, F.lit(0.5)).alias("p50"), F.percentile(share, F.lit(0.9)).alias("p90"))


def claim_state(verdict: Column, forced: Column, prospective: Column, open_items: Column) -> Column:
    """How far a result may be claimed: only diagnostic if forced or not validated; else proven by published results, provisional while items are open, or passed on history."""
    return F.when(F.coalesce(forced, F.lit(False)) | (F.coalesce(verdict, F.lit("")) != "VALIDATED"), "DIAGNOSTIC").when(F.coalesce(prospective, F.lit(False)), "PROSPECTIVE_VALIDATED").when(open_items > 0, "PROVISIONAL").otherwise("BACKTEST_PASS")


def proven(ledger: DataFrame, by: Sequence[str], least: int = 100, months: int = 12) -> DataFrame:
    """(by, proven): whether published rows (as_of, status, fwd, bench) that matured are enough, of enough months, and above the benchmark on average."""
    done = ledger.where(F.col("status").isin("hit", "miss") & F.col("fwd").isNotNull())
    excess = F.avg(F.col("fwd") - F.coalesce("bench", F.lit(0.0)))
    return done.groupBy(*by).agg(((F.count("*") >= least) & (F.countDistinct(F.trunc("as_of", "month")) >= months) & (excess > 0)).alias("proven"))


def distinct_trials(trials: DataFrame, by: Sequence[str], grid: str = "grid", but: Sequence[str] = ()) -> DataFrame:
    """(by, trials): how many different keys the arrays of all trials hold, but those named."""
    keys = trials.select(*by, F.explode(grid).alias("__k")).where(~F.col("__k").isin(list(but)) if but else F.lit(True))
    return keys.groupBy(*by).agg(F.countDistinct("__k").alias("trials"))


def evidence_flags(columns: Sequence[str]) -> Column:
    """Array of what a name's latest features warn of; unknown inputs warn of nothing, but for not being rankable."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("double")
    rules = [
        ("ASM_STAGE_2_PLUS", c("in_asm") > 0), ("GSM", c("in_gsm") > 0), ("FO_BAN", c("in_fo_ban") > 0), ("ALTMAN_DISTRESS", c("altman_zpp") < 1.1), ("PROMOTER_SELLING", c("promoter_chg_1y") < -2),
        ("STALE_STATEMENTS", c("stmt_age_days") > 200), ("NOT_RANKABLE", F.coalesce(c("rankable"), F.lit(0)) == 0),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def evidence_points(percentile: Column, flags: Column, most: float = 3.0) -> Column:
    """struct(points, status) of a validated percentile: the top half earns, a flag takes all; unknown without a percentile."""
    earned = F.when(F.size(flags) > 0, 0.0).otherwise(F.round(most * F.greatest(F.lit(0.0), (percentile - 0.5) / 0.5), 2))
    status = F.when(percentile.isNull(), "UNKNOWN").when(earned >= most * 0.7, "PASS").when(earned > 0, "PARTIAL").otherwise("FAIL")
    return F.struct(F.when(percentile.isNotNull(), earned).otherwise(0.0).alias("points"), status.alias("status"))


def tiers_in_order(means: Sequence[Column]) -> Column:
    """Whether each mean is above the next; unknown if one is."""
    return reduce(lambda a, b: a & b, [x > y for x, y in zip(means, means[1:])])
