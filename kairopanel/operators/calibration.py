"""Calibration of ratings: what followed each rating, folds with an embargo, one holdout, and the statistics that are judged.

A **history** has a row for each date, variant and name: (as_of, variant, symbol, profile, status, score, verdict, mos, band, coverage,
hard: codes of hard flags, fwd, bench, excess, fwd_long, bench_long, excess_long, matured_on).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .cross_section import deciles
from .rating import VERDICTS
from .validation import brier, long_short, newey_west, normal_cdf, normal_ppf, rank_ic, transition_rate

BUY, SOLD = ["CONVICTION_BUY", "SPECULATIVE_BUY"], ["SELL", "TRIM"]
#: The hard flags that can be computed for the past.
HISTORICAL = ["FORENSIC_BENEISH_2Y", "FORENSIC_CASH_DIVERGENCE", "SOLVENCY_BREACH", "CAPITAL_BREACH_BANK"]


def returns_ahead(
    panel: DataFrame, dates: DataFrame, calendar: DataFrame, horizons: dict[str, int], key: str = "symbol", date: str = "trade_date", grace: int = 5, haircut: float = 0.01,
    delisted: bool = False,
) -> DataFrame:
    """(as_of, key, matured_on, <name>...): adjusted returns from each date over several horizons, from one sorted run a key.

    panel: (key, date, close), adjusted; calendar: (date, session_no). horizons: a column's name and its sessions, the first one's end being
    ``matured_on``. A key whose last price lies more than ``grace`` sessions before an end counts as delisted: the return to its last price,
    less the haircut. Returns beyond the calendar's end are null. With ``delisted`` there are also <name>_on, the horizon's end, and
    <name>_delisted.
    """
    cal = calendar.select(F.col(date), "session_no")
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("sessions")) for n, h in horizons.items()]))
    ends = dates.select("as_of").join(cal.withColumnRenamed(date, "as_of"), "as_of").select("as_of", "session_no", spans.alias("h"))
    ends = ends.select("as_of", "session_no", "h.name", (F.col("session_no") + F.col("h.sessions")).alias("__to"))
    ends = ends.join(cal.select(F.col("session_no").alias("__to"), F.col(date).alias("__on")), "__to")  # only what is matured
    rows = panel.select(key, date, "close").where("close is not null").join(F.broadcast(cal), date)
    starts = rows.join(F.broadcast(ends), "session_no").select(key, "as_of", "name", "__to", "__on", F.col("close").alias("__first"))
    prices = rows.select(key, "session_no", F.col("close").alias("__last"), F.col("session_no").alias("__s"))
    met = asof_join(starts, prices, [key], "__to", "session_no", ["__last", "__s"])
    gone = F.col("__to") - F.col("__s") > grace
    kept = F.when(gone, 1 - haircut).otherwise(1.0)
    ret = F.when(F.col("__first") > 0, F.col("__last") * kept / F.col("__first") - 1)
    at = lambda c, n: F.max(F.when(F.col("name") == n, c))
    return met.groupBy("as_of", key).agg(at(F.col("__on"), next(iter(horizons))).alias("matured_on"), *[at(ret, n).alias(n) for n in horizons], *[x for n in horizons if delisted for x in (at(F.col("__on"), n).alias(f"{n}_on"), at(gone, n).alias(f"{n}_delisted"))])


def benchmark_ahead(index: DataFrame, dates: DataFrame, calendar: DataFrame, horizons: dict[str, int], date: str = "trade_date", annual: float = 0.0) -> DataFrame:
    """(as_of, <name>...): returns of an index (date, close; a row a session) over the horizons, with dividends of ``annual`` a year."""
    level = index.select(date, "close").join(calendar.select(date, "session_no"), date)
    out = level.join(dates.select(F.col("as_of").alias(date)), date, "left_semi").select(F.col(date).alias("as_of"), "session_no", F.col("close").alias("__first"))
    for name, sessions in horizons.items():
        end = level.select((F.col("session_no") - sessions).alias("session_no"), F.col("close").alias("__last"), F.col(date).alias("__on"))
        ret = F.try_divide("__last", "__first") - 1 + annual * F.datediff("__on", "as_of") / 365
        out = out.join(F.broadcast(end), "session_no", "left").withColumn(name, ret).drop("__last", "__on")
    return out.drop("session_no", "__first")


def history(ratings: DataFrame, ahead: DataFrame, bench: DataFrame) -> DataFrame:
    """Ratings of matured dates with what followed: ahead (as_of, symbol, matured_on, fwd, fwd_long), bench (as_of, bench, bench_long; a row a date)."""
    matured = ahead.groupBy("as_of").agg(F.max("matured_on").alias("matured_on")).where("matured_on is not null")
    rows = ratings.join(F.broadcast(matured), "as_of").join(ahead.drop("matured_on"), ["as_of", "symbol"], "left").join(F.broadcast(bench), "as_of", "left")
    return rows.withColumn("excess", F.col("fwd") - F.col("bench")).withColumn("excess_long", F.col("fwd_long") - F.col("bench_long"))


def folds(rows: DataFrame, variants: Sequence[str], years: Sequence[int], holdout: str, least: int = 30) -> DataFrame:
    """(fold, selected, train_ic, n_train, n_test, test_from, test_to): the variant that each test period is judged with.

    A fold learns from the dates before its year whose returns had **matured** when the year began; the variant with the
    largest mean rank correlation is selected, of equal ones the first named. The last fold is the holdout: it learns from all that had
    matured when it began, and its rows are in no other fold. A fold without train or test rows is left out.
    """
    spark = rows.sparkSession
    spans = [(str(y), f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in years] + [("holdout", holdout, holdout, "9999-12-31")]
    each = spark.createDataFrame(spans, "fold string, train_to string, test_from string, test_to string")
    each = each.select("fold", *[F.to_date(c).alias(c) for c in ("train_to", "test_from", "test_to")])
    place = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    some = rows.where(F.col("variant").isin(list(variants)))
    ics = rank_ic(some, ["variant", "as_of"], "score", "excess", least).select("variant", "as_of", "ic")
    by_date = some.groupBy("variant", "as_of", "matured_on").agg(F.count("*").alias("__n")).join(ics, ["variant", "as_of"], "left")
    before = (F.col("as_of") <= F.col("train_to")) & (F.col("matured_on") <= F.col("test_from")) & (F.col("as_of") < F.lit(holdout).cast("date"))
    seen = by_date.join(F.broadcast(each), before).groupBy("fold", "variant").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic"), F.sum("__n").alias("__n"))
    chosen = seen.groupBy("fold").agg(F.min_by(F.struct("variant", "ic"), F.struct(-F.col("ic"), place)).alias("b"), F.sum("__n").alias("n_train"))
    inside = F.col("as_of").between(F.col("test_from"), F.col("test_to")) & ((F.col("fold") == "holdout") | (F.col("as_of") < F.lit(holdout).cast("date")))
    tests = by_date.join(F.broadcast(each), inside).groupBy("fold", "test_from", "test_to").agg(F.sum("__n").alias("n_test"))
    return chosen.join(tests, "fold").select("fold", F.col("b.variant").alias("selected"), F.col("b.ic").alias("train_ic"), "n_train", "n_test", "test_from", "test_to")


def stitched(rows: DataFrame, chosen: DataFrame, holdout: str) -> DataFrame:
    """The rows of each test period under the variant that its fold selected, with the fold (broadcast: a row a year)."""
    on = (F.col("variant") == F.col("selected")) & F.col("as_of").between(F.col("test_from"), F.col("test_to"))
    met = rows.join(F.broadcast(chosen.select("fold", "selected", "test_from", "test_to")), on)
    return met.where((F.col("fold") == "holdout") | (F.col("as_of") < F.lit(holdout).cast("date"))).drop("selected", "test_from", "test_to")


def tier_statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, verdict, n, mean_excess, hit) of rated rows with a return."""
    some = rows.where("status = 'RATED' and excess is not null")
    return some.groupBy(*by, "verdict").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit"))


def decile_table(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, decile, n, mean_excess) of rated rows, deciles of the score within each date of a variant."""
    some = rows.where("status = 'RATED' and score is not null and excess is not null")
    some = some.withColumn("decile", deciles(["score", "symbol"], ["variant", "as_of"], 10))
    return some.groupBy(*by, "decile").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"))


def rises(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, deciles, rises) of a :func:`decile_table`: whether each decile's mean lies above that of the one below."""
    out = table.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("decile", "mean_excess"))).alias("__m"))  # ten at most
    steps = F.zip_with(F.slice("__m", 2, 9), F.slice("__m", 1, F.size("__m") - 1), lambda b, a: b["mean_excess"] > a["mean_excess"])
    return out.select(*by, F.size("__m").alias("deciles"), F.forall(steps, lambda s: s).alias("rises"))


def variant_diagnostics(rows: DataFrame, holdout: str, least: int = 30, least_side: int = 5) -> DataFrame:
    """(variant, ic_mean, ic_se, long_short_pp, n_dates) over all dates before the holdout, of every variant."""
    before = rows.where(F.col("as_of") < F.lit(holdout).cast("date"))
    ic = rank_ic(before, ["variant", "as_of"], "score", "excess", least).groupBy("variant")
    ic = ic.agg(F.avg("ic").alias("ic_mean"), (F.stddev_samp("ic") / F.sqrt(F.count("*"))).alias("ic_se"), F.count("*").alias("n_dates"))
    spread = _spread(before, ["variant"], least_side).groupBy("variant").agg(F.avg("spread").alias("long_short_pp"))
    return ic.join(spread, "variant", "left").select("variant", "ic_mean", "ic_se", "long_short_pp", "n_dates")


def _spread(rows: DataFrame, by: Sequence[str], least_side: int) -> DataFrame:
    rated = rows.where("status = 'RATED'")
    return long_short(rated, [*by, "as_of"], F.col("verdict").isin(BUY), F.col("verdict").isin(SOLD), "excess", least_side)


def _t(series: DataFrame, value: str, name: str, least: int = 6) -> DataFrame:
    """A row: the mean of a dated series and, from ``least`` dates on, its t-statistic."""
    found = newey_west(series.withColumn("__all", F.lit(1)), ["__all"], value, "as_of")
    return found.select(F.max("mean").alias(f"{name}_mean"), F.max(F.when(F.col("n") >= least, F.col("t"))).alias(f"{name}_t"))


def deflated_p(series: DataFrame, value: str, trials: int, least: int = 30) -> DataFrame:
    """A row: (dsr_p, n), the probability that a series' mean over its deviation is luck, given the best of some trials.

    The variance between trials isn't known here and counts as a quarter of the ratio's square.
    """
    gamma = 0.5772156649015329
    s = series.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    sr = F.try_divide("m", F.nullif(F.col("sd"), F.lit(0.0)))
    luck = lambda k: (1 - gamma) * normal_ppf(F.lit(1 - 1 / k)) + gamma * normal_ppf(F.lit(1 - 1 / (k * 2.718281828459045)))
    s = s.withColumn("sr", sr).withColumn("sr0", F.abs("sr") / 2 * luck(trials) if trials > 1 else F.lit(0.0))
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")))
    z = (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / spread
    return s.select("n", z.alias("z")).select(F.when(F.col("n") >= least, 1 - normal_cdf(F.col("z"))).alias("dsr_p"), "n")


def statistics(tests: DataFrame, held: DataFrame, trials: int, least: int = 30, least_side: int = 5) -> DataFrame:
    """One row with all statistics of the bar, of the test rows of all folds and of the holdout's; unknown where too little is there.

    Both are read several times: hand in written tables. ``least`` names a date give a rank correlation, ``least_side`` names on
    either side a spread.
    """
    rated, kept = tests.where("status = 'RATED'"), held.where("status = 'RATED'")
    verdict, excess = F.col("verdict"), F.col("excess")
    whole = rises(decile_table(rated, []).withColumn("__all", F.lit(1)), ["__all"]).select(F.col("rises").alias("decile_monotonic_overall"))
    yearly = rises(decile_table(rated.withColumn("year", F.year("as_of")), ["year"]), ["year"]).where("deciles = 10")
    yearly = yearly.agg(F.avg(F.col("rises").cast("double")).alias("decile_monotonic_years_share"))
    best_first = F.array(*[F.lit(v) for v in reversed(VERDICTS)])
    tiers = tier_statistics(rated, []).withColumn("k", F.array_position(best_first, verdict))
    tiers = tiers.agg(F.sort_array(F.collect_list(F.struct("k", "mean_excess", "hit"))).alias("t"))  # five at most
    steps = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, 5), lambda a, b: a["mean_excess"] >= b["mean_excess"])
    tiers = tiers.select(F.when(F.size("t") >= 2, F.forall(steps, lambda s: s)).alias("tiers_ordered"), F.get(F.filter("t", lambda x: x["k"] == 1), F.lit(0))["hit"].alias("hit_conviction_buy"))
    spread = _spread(rated, [], least_side)
    ic = rank_ic(rated, ["as_of"], "score", "excess", least)
    mos = rank_ic(rated, ["as_of"], "mos", "excess_long", least)
    rate = lambda who, what: F.when(F.count_if(who & excess.isNotNull()) >= 20, F.avg(F.when(who & excess.isNotNull(), what.cast("double"))))
    hits = rated.agg(
        rate(verdict.isin(BUY), excess > 0).alias("hit_all_buy"), rate(verdict == "SELL", excess < 0).alias("hit_sell"),
        F.when(F.count_if(F.col("score").isNotNull() & F.col("coverage").isNotNull()) > 50, F.corr("score", "coverage")).alias("score_coverage_corr"),
        F.count("*").alias("n_obs"), F.countDistinct("as_of").alias("n_dates"),
    )
    flagged = F.arrays_overlap("hard", F.array(*[F.lit(c) for c in HISTORICAL])) & F.col("fwd").isNotNull()
    precision = tests.agg(F.when(F.count_if(flagged) >= 30, F.avg(F.when(flagged, F.coalesce(excess < 0, F.lit(False)).cast("double")))).alias("hard_flag_precision"))
    events = [df.where("score is not null and excess is not null").withColumn("up", excess > 0) for df in (rated, kept)]
    judged = brier(*events, "score", "up").select("brier", (F.col("climatology") - F.col("brier")).alias("brier_gain_vs_climatology"), F.col("n").alias("__n"))
    judged = judged.crossJoin(F.broadcast(events[0].agg(F.count("*").alias("__m"))))
    enough = (F.col("__n") >= 30) & (F.col("__m") >= 100)
    judged = judged.select(*[F.when(enough, F.col(c)).alias(c) for c in ("brier", "brier_gain_vs_climatology")])
    bands = rank_ic(rated.where("band in ('HIGH', 'LOW')"), ["band", "as_of"], "score", "excess", least)
    bands = bands.agg(*[F.avg(F.when(F.col("band") == b, F.col("ic"))).alias(f"ic_{b.lower()}_dci") for b in ("HIGH", "LOW")])
    bands = bands.withColumn("dci_informative", F.col("ic_high_dci") >= F.col("ic_low_dci"))
    per_date = lambda df, c: df.groupBy("as_of", c).agg(F.count("*").alias("n")).withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("as_of")))
    sure = per_date(rated.where("verdict = 'CONVICTION_BUY'"), "profile").groupBy("profile").agg(F.avg("s").alias("s"), F.sum("n").alias("n"))
    sure = sure.agg(F.when(F.sum("n") >= 20, F.max("s")).alias("sector_max_share_conviction"))
    sectors = _spread(rated, ["profile"], least_side).groupBy("profile").agg(F.avg("spread").alias("s")).agg(F.count_if(F.col("s") > 0).alias("sector_ls_positive_profiles"))
    moved = transition_rate(rated, ["symbol"], "as_of", "verdict").select(F.col("rate").alias("monthly_transition"))
    shares = per_date(rated, "verdict").groupBy("verdict").agg(F.avg("s").alias("s"))
    shares = shares.agg(F.when(F.count("*") == len(VERDICTS), F.min("s")).otherwise(0.0).alias("min_tier_share"))
    last = _spread(kept, [], least_side).agg(F.avg("spread").alias("holdout_long_short"))
    parts = [
        whole.agg(F.first("decile_monotonic_overall").alias("decile_monotonic_overall")), yearly, tiers, _t(spread, "spread", "long_short").withColumnRenamed("long_short_mean", "long_short_pp"), _t(ic, "ic", "ic"), _t(mos, "ic", "mos_ic"), hits, precision, judged,
        bands, sure, sectors, moved, shares, deflated_p(spread.withColumn("s", F.col("spread") / 12), "s", trials).select("dsr_p"), last,
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # each has one row
