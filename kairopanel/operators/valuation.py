"""Fair values: cost of capital models, own multiples, triangulation, margin of safety and expected returns.

All are expressions over a :func:`statements.prepared` frame that also has ``y_mcap``, the market value at each year's end, and ``profile``.
Values are a share; an unknown input makes an unknown value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, dividend_value, earnings_power, implied_growth, justified_pb, two_stage_value, weighted_median
from .statements import TERMINAL, at, cagr, known, last, median, metric, ratio

#: Weights of the models in the fair value of a profile.
MODEL_WEIGHTS = {
    "GENERAL": {"model_dcf_base": 0.40, "model_ev_ebitda": 0.35, "model_p_fcf": 0.25},
    "IT_SERVICES": {"model_dcf_base": 0.40, "model_ev_ebitda": 0.35, "model_p_fcf": 0.25},
    "PHARMA": {"model_dcf_base": 0.40, "model_ev_ebitda": 0.35, "model_p_fcf": 0.25},
    "CYCLICAL": {"model_dcf_base": 0.20, "model_ev_ebitda": 0.55, "model_p_fcf": 0.25},
    "BANK": {"model_justified_pb": 0.70, "model_ddm": 0.30},
    "NBFC_FIN": {"model_justified_pb": 0.70, "model_ddm": 0.30},
}
#: Bounds of the multiples that a model may use.
EV_EBITDA_BOUNDS, P_FCF_BOUNDS = (4.0, 30.0), (5.0, 60.0)
#: Models of companies and of banks and lenders.
OPERATING = ["model_dcf_base", "model_dcf_bull", "model_dcf_bear", "model_ev_ebitda", "model_p_fcf", "model_epv"]
LENDING = ["model_justified_pb", "model_ddm"]


def band_position(history: Column, now: Column, least: int = 3) -> Column:
    """The share of the known values of an array that the current one reaches; null with fewer than ``least``."""
    some = known(history)
    return F.when(now.isNotNull() & (F.size(some) >= least), F.size(F.filter(some, lambda x: x <= now)) / F.size(some))


def with_own_multiples(df: DataFrame, years: int = 10) -> DataFrame:
    """df with arrays of the last ten years that have a market value: v_ev_ebitda, v_ev_ebitda_positive, v_p_fcf and v_pe."""
    columns = ("y_mcap", "m_debt", "y_operating_profit", "y_net_profit", "y_fcf")
    rows = last(F.filter(F.arrays_zip(*columns), lambda x: x["y_mcap"].isNotNull()), years)
    df = df.withColumn("__years", rows)
    ev = lambda x: x["y_mcap"] + F.coalesce(x["m_debt"], F.lit(0.0))
    over = lambda top, of: known(F.transform("__years", lambda x: F.when(x[of] > 0, top(x) / x[of])))
    return df.withColumns({
        "v_ev_ebitda": over(ev, "y_operating_profit"), "v_ev_ebitda_positive": over(lambda x: F.when(ev(x) > 0, ev(x)), "y_operating_profit"),
        "v_p_fcf": over(lambda x: x["y_mcap"], "y_fcf"), "v_pe": over(lambda x: x["y_mcap"], "y_net_profit"),
    }).drop("__years")


def valued(df: DataFrame, fundamental_growth: Column) -> DataFrame:
    """df with the models and what they need as columns, step by step, each computed once a row.

    fundamental_growth: null where it isn't known; the growth of sales over five years, at most 0.15, stands in, else 0.08.
    """
    y, c = (lambda n: F.col(f"y_{n}")), (lambda n: F.col(f"m_{n}"))
    lender = F.col("profile").isin("BANK", "NBFC_FIN")
    shares, mcap, net, wacc, nopat = F.col("shares"), c("mcap"), c("net"), c("wacc"), c("nopat_ttm")
    positive = lambda x: F.when(x > 0, x)
    df = with_own_multiples(df)
    fcf3 = median(known(last(known(y("fcf")), 3)))
    s5, s0 = at(y("sales"), 1), at(y("sales"), 6)
    stand_in = F.least(F.coalesce(F.when((s5 > 0) & (s0 > 0), F.pow(s5 / s0, 0.2) - 1), F.lit(0.08)), F.lit(0.15))
    df = df.withColumns({
        "v_fcf3": fcf3, "v_fcf0": F.coalesce(positive(fcf3), positive(nopat) * 0.5, fcf3), "v_g1": clip(F.coalesce(fundamental_growth, stand_in), -0.05, 0.25), "v_fg": fundamental_growth,
        "v_opm5": median(known(last(known(c("opm")), 5))), "v_ev": mcap + net, "v_payout": at(y("payout_pct"), 1),
        "v_roe": ratio(F.col("t_net_profit"), F.coalesce(F.when((at(c("book"), 1) > 0) & (at(c("book"), 2) > 0), (at(c("book"), 1) + at(c("book"), 2)) / 2), at(c("book"), 1)), True),
    })
    v = lambda n: F.col(f"v_{n}")
    equity = lambda ev: F.try_divide(positive(ev - net), positive(shares))
    dcf = lambda g: equity(two_stage_value(v("fcf0"), g, wacc, F.lit(TERMINAL)))
    bounded = lambda a, bounds: clip(median(a, 3), *bounds)
    retention = clip(1 - F.coalesce(v("payout") / 100, F.lit(0.0)), 0, 1)
    g = F.least(retention * v("roe"), c("ke") - 0.01)
    df = df.withColumns({
        "v_lender_g": g, "v_justified_pb": justified_pb(v("roe"), c("ke"), g),
        "model_dcf_base": F.when(~lender, dcf(v("g1"))), "model_dcf_bull": F.when(~lender, dcf(v("g1") + 0.05)), "model_dcf_bear": F.when(~lender, dcf(v("g1") - 0.05)),
        "model_ev_ebitda": F.when(~lender, equity(bounded(v("ev_ebitda_positive"), EV_EBITDA_BOUNDS) * v("opm5") * F.col("t_sales"))),
        "model_p_fcf": F.when(~lender, F.try_divide(bounded(v("p_fcf"), P_FCF_BOUNDS) * positive(v("fcf3")), positive(shares))),
        "model_epv": F.when(~lender, equity(earnings_power(nopat, wacc))),
    })
    bvps, eps = ratio(at(c("book"), 1), shares, True), ratio(F.col("t_net_profit"), shares, True)
    df = df.withColumns({
        "model_justified_pb": F.when(lender, v("justified_pb") * bvps),
        "model_ddm": F.when(lender & (v("payout") >= 30), dividend_value(eps * v("payout") / 100, c("ke"), v("lender_g"))),
    })
    weight = lambda m: reduce(lambda rest, p: F.when(F.col("profile") == p, F.lit(MODEL_WEIGHTS[p].get(m))).otherwise(rest), MODEL_WEIGHTS, F.lit(MODEL_WEIGHTS["GENERAL"].get(m)))
    entry = lambda m: F.struct(positive(F.col(m)).alias("value"), weight(m).cast("double").alias("weight"))
    central = F.filter(F.array(*[entry(m) for m in OPERATING + LENDING]), lambda x: x["value"].isNotNull() & x["weight"].isNotNull())
    df = df.withColumn("v_central", central).withColumn("v_values", F.transform("v_central", lambda x: x["value"]))
    values, n = v("values"), F.size("v_values")
    base = F.when(n >= 2, weighted_median(v("central"))).when(n == 1, F.get(values, F.lit(0)))
    of = lambda names: F.array_compact(F.array(*[F.col(m) for m in names]))
    highs, lows = of([m for m in OPERATING if m not in ("model_dcf_bear", "model_epv")]), of([m for m in OPERATING if m != "model_dcf_bull"])
    return df.withColumns({
        "v_base": base, "v_n": n,
        "v_bull": F.when(base.isNotNull(), F.when(lender, F.array_max(values)).otherwise(F.array_max(highs))), "v_bear": F.when(base.isNotNull(), F.when(lender, F.array_min(values)).otherwise(F.array_min(lows))),
        "v_dispersion": F.when(n >= 2, F.try_divide(F.array_max(values) - F.array_min(values), median(values))),
        "v_implied": F.when(~lender, implied_growth(v("ev"), v("fcf0"), wacc, F.lit(TERMINAL))),
    })


def expected_return(earnings_yield: Column, growth: Column, pe: Column, usual_pe: Column, vol: Column) -> Column:
    """struct(lo, mid, hi): the yield, the growth within -0.1 and 0.2, and a third of the way back to the usual multiple, within 0.15; the band is vol / sqrt(3), at least 0.1."""
    back = F.when((usual_pe > 0) & (pe > 0), clip(F.ln(usual_pe / pe) / 3, -0.15, 0.15)).otherwise(0.0)
    mid = earnings_yield + clip(growth, -0.10, 0.20) + back
    width = F.greatest(F.lit(0.10), vol / 3**0.5)
    return F.when(mid.isNotNull() & pe.isNotNull() & usual_pe.isNotNull() & vol.isNotNull(), F.struct((mid - width).alias("lo"), mid.alias("mid"), (mid + width).alias("hi")))


def valuation_columns() -> dict[str, Column]:
    """Metrics of a :func:`valued` frame (with price, and vol_250, history_days, stmt_age_days where it has them)."""
    c, v = (lambda n: F.col(f"m_{n}")), (lambda n: F.col(f"v_{n}"))
    lender = F.col("profile").isin("BANK", "NBFC_FIN")
    company, m = ~lender, metric
    pe = ratio(c("mcap"), F.col("t_net_profit"), True)
    pe = F.when(F.col("t_net_profit") > 0, pe)
    ebitda = F.when(F.col("t_operating_profit") > 0, ratio(v("ev"), F.col("t_operating_profit"), True))
    usual_pe = median(v("pe"), 3)
    er = expected_return(ratio(F.col("t_net_profit"), c("mcap"), True), v("fg"), pe, usual_pe, F.col("vol_250"))
    gap = v("implied") - v("fg")
    pb = ratio(c("mcap"), at(c("book"), 1), True)
    return {
        "shares_cr": m(F.col("shares")), "mcap_cr": m(c("mcap")), "pe_band_pos_10y": m(band_position(v("pe"), pe)), "ev_ebitda_band_pos": m(band_position(v("ev_ebitda"), ebitda), company),
        "fcf0": m(v("fcf0"), company), "nopat_ttm_val": m(c("nopat_ttm"), company), "implied_growth": m(v("implied"), company), "dcf_g1": m(v("g1"), company),
        "own_ev_ebitda_median": m(median(v("ev_ebitda_positive"), 3), company), "own_p_fcf_median": m(median(v("p_fcf"), 3), company),
        **{n: m(F.col(n), company) for n in OPERATING}, **{n: m(F.col(n), lender) for n in LENDING}, "justified_pb": m(v("justified_pb"), lender), "pb_vs_justified": m(ratio(pb, v("justified_pb"), True), lender),
        "fv_base": m(v("base")), "fv_bull": m(v("bull")), "fv_bear": m(v("bear")), "val_dispersion": m(v("dispersion")), "n_models": m(v("n")), "mos_base": m(ratio(v("base"), F.col("price"), True) - 1),
        "er_lo": m(er["lo"]), "er_mid": m(er["mid"]), "er_hi": m(er["hi"]), "growth_gap": m(gap, company), "growth_gap_val": m(gap, company),
        "pe_ttm_feat": m(pe), "pat_ttm": m(F.col("t_net_profit")),
    }


def filing_columns() -> dict[str, Column]:
    """Metrics that read the latest filing: columns x_<item> (null where unknown), beside the histories, face_value, profile and promoter_chg_1y, ofs_deals, net_debt_ebitda.

    Shares of bad loans and the core capital ratio are in percent, as filings give them and as flags and scales read them.

    Items: current_assets, current_liabilities, cash, borrowings_current, cet1, capital_adequacy_ratio, gross_npa, net_npa, return_on_assets,
    advances, deposits, provisions, auditor_opinion (text). Quarters also have gross_npa_pct and net_npa_pct, years working_capital_days, deposits
    and financing_profit.
    """
    x, y, q = (lambda n: F.col(f"x_{n}")), (lambda n: F.col(f"y_{n}")), (lambda n: F.col(f"q_{n}"))
    bank, lender = F.col("profile") == "BANK", F.col("profile").isin("BANK", "NBFC_FIN")
    company, m = ~lender, metric
    borrowings, days = at(y("borrowings"), 1), y("working_capital_days")
    opinion = F.lower(x("auditor_opinion"))
    earned = F.transform(F.arrays_zip("y_financing_profit", "y_other_income", "y_period"), lambda r: F.when(r["y_financing_profit"].isNotNull() | r["y_other_income"].isNotNull(), F.struct(r["y_period"].alias("at"), (F.coalesce(r["y_financing_profit"], F.lit(0.0)) + F.coalesce(r["y_other_income"], F.lit(0.0))).alias("v"))))
    earned = F.array_compact(earned)
    shares = last(y("equity_capital"), 5)
    bought_back = at(y("equity_capital"), 1) < 0.98 * at(y("equity_capital"), 2)
    cfo = known(last(y("cfo"), 5))
    unknown = F.lit(None).cast("double")
    return {
        "wc_days_delta_3y": m(F.when(F.size(days) > 0, at(days, 1) - F.get(days, F.greatest(F.size(days) - 4, F.lit(0)))), company),
        "current_ratio": m(ratio(x("current_assets"), x("current_liabilities"), True), company), "cash_to_debt": m(ratio(x("cash"), borrowings, True), company), "st_debt_share": m(ratio(x("borrowings_current"), borrowings, True), company),
        "contingent_to_networth": m(unknown, F.lit(False)), "accrual_ratio_bs_abs": m(unknown, company), "moat_grade_llm": m(unknown), "mgmt_grade_llm": m(unknown),
        "gnpa_pct": m(at(q("gross_npa_pct"), 1), lender), "nnpa_pct": m(at(q("net_npa_pct"), 1), lender),
        **{n: m(at(q("gross_npa_pct"), 1) - at(q("gross_npa_pct"), 5), lender) for n in ("gnpa_trend_4q", "gnpa_delta_4q_neg")},
        "cet1_pct": m(x("cet1"), bank), "provision_coverage": m(ratio(x("provisions"), x("gross_npa"), True), lender), "deposit_vs_advance_growth": m(ratio(at(y("deposits"), 1), at(y("deposits"), 2), True) - 1, bank), "credit_cost": m(ratio(x("provisions"), x("advances"), True), lender),
        "accrual_ratio_sloan_prev": m(ratio(at(y("net_profit"), 2) - at(y("cfo"), 2), at(y("total_assets"), 2), True), company),
        "audit_opinion_clean": m(F.when(opinion.isNotNull(), (F.contains(opinion, F.lit("unmodified")) | F.contains(opinion, F.lit("clean"))).cast("double"))),
        "ppop_growth_3y": m(cagr(F.transform(earned, lambda r: r["v"]), F.transform(earned, lambda r: r["at"]), 3), lender),
        "dilution_5y": m(F.when(F.col("face_value") > 0, share_growth(shares, last(y("net_profit"), 5)))),
        "ofs_matched": m(F.coalesce((F.col("promoter_chg_1y") < -2) & (F.col("ofs_deals") > 0), F.lit(False)).cast("double")),
        "leveraged_buyback": m(F.coalesce((F.col("face_value") > 0) & bought_back & (F.col("net_debt_ebitda") > 3), F.lit(False)).cast("double")),
        "su_cfo_5y": m(F.when(F.size(cfo) > 0, F.aggregate(cfo, F.lit(0.0), lambda s, v: s + v))),
        "kpi_cet1": m(x("cet1") / 100, bank), "kpi_car": m(x("capital_adequacy_ratio") / 100, bank), "kpi_gnpa": m(x("gross_npa"), lender), "kpi_nnpa": m(x("net_npa"), lender), "kpi_roa": m(x("return_on_assets") / 100, lender),
        "kpi_advances": m(x("advances"), bank), "kpi_deposits": m(x("deposits"), bank), "kpi_provisions": m(x("provisions"), bank),
    }


def share_growth(capital: Column, profit: Column) -> Column:
    """Growth a year of an array of yearly capitals, in which a rise by half or more without a fall of the profit is a bonus issue and counts as none.

    Each year is compared with the one before as it counts, not as it was. Unknown and non-positive values are left out; two have to be left.
    """
    rows = F.arrays_zip(capital.alias("c"), profit.alias("p"))

    def step(done: Column, r: Column) -> Column:
        jump = F.when(done["before"] > 0, r["c"] / done["before"])
        change = F.when(done["p"] > 0, r["p"] / done["p"])
        value = F.when((jump >= 1.5) & (change.isNull() | (change >= 1.0)), r["c"] / jump).otherwise(r["c"])
        return F.struct(value.alias("before"), r["p"].alias("p"), F.array_append(done["out"], value).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("p"), F.array().cast("array<double>").alias("out"))
    some = F.filter(F.aggregate(rows, start, step, lambda d: d["out"]), lambda v: v > 0)
    return F.when(F.size(some) >= 2, F.pow(F.element_at(some, -1) / F.get(some, F.lit(0)), 1 / (F.size(some) - 1)) - 1)

