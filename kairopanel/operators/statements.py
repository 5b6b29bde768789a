"""Statements: long facts to arrays of years and quarters, trailing sums, features and metrics with a status.

A metric is a column of type struct(value, status): OK with a value, NA where it doesn't apply to the row's profile, else UNKNOWN. Unknown inputs make
unknown outputs; nothing is filled with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, weighted_median

#: Rates of the valuation.
TAX, RISK_FREE, PREMIUM, TERMINAL = 0.25, 0.06, 0.055, 0.05


def wide(facts: DataFrame, keys: Sequence[str], items: Sequence[str], item: str = "line_item", value: str = "value") -> DataFrame:
    """A column for each item, of a fixed list, so no job looks for the values first."""
    return facts.groupBy(*keys).pivot(item, list(items)).agg(F.first(value))


def trailing(df: DataFrame, columns: Sequence[str], by: Sequence[str], period: str = "period_end", n: int = 4, days: int = 300, suffix: str = "_ttm") -> DataFrame:
    """Sums of the last n periods where all are known and their ends span at most ``days``; else null."""
    w = Window.partitionBy(*by).orderBy(period)
    f = w.rowsBetween(1 - n, 0)
    whole = (F.count(F.lit(1)).over(f) == n) & (F.datediff(F.col(period), F.min(period).over(f)) <= days)
    return df.withColumns({f"{c}{suffix}": F.when(whole & (F.count(c).over(f) == n), F.sum(c).over(f)) for c in columns})


def histories(facts: DataFrame, by: Sequence[str], items: Sequence[str], kind: str, n: int, period: str = "period_end", item: str = "line_item", value: str = "value") -> DataFrame:
    """One row for each of by with, for each item, the array of its last n values in the order of their periods; periods without it are null.

    kind prefixes the columns, so years and quarters can stand side by side.
    """
    flat = wide(facts, [*by, period], items, item, value)
    packed = flat.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(period, *items))).alias("__h"))
    packed = packed.withColumn("__h", F.slice("__h", F.greatest(F.size("__h") - n + 1, F.lit(1)), n))
    return packed.select(*by, F.transform("__h", lambda x: x[period]).alias(f"{kind}_period"), *[F.transform("__h", _field(i)).alias(f"{kind}_{i}") for i in items])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def at(a: Column, k: int) -> Column:
    """The k-th value from the end (1: the last), or null."""
    return F.when(F.size(a) >= k, F.element_at(a, -k))


def last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once a row, however often f reads it: functions on arrays don't share what they have in common."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def total(a: Column, n: int, least: int | None = None) -> Column:
    """Sum of the last n values if all (or at least ``least``) are known."""
    added = lambda some: F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
    if least is None:
        return F.when(F.size(a) >= n, added(F.slice(a, -n, n)))  # a sum with an unknown value is unknown
    return once(known(last(a, n)), lambda some: F.when(F.size(some) >= least, added(some)))


def mean(a: Column) -> Column:
    return once(known(a), lambda some: F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some)))


def deviation(a: Column, sample: bool) -> Column:
    less = 1 if sample else 0
    squares = lambda some, m: F.aggregate(some, F.lit(0.0), lambda s, x: s + F.pow(x - m, 2))
    return once(known(a), lambda some: F.when(F.size(some) > less, F.sqrt(once(mean(some), lambda m: squares(some, m)) / (F.size(some) - less))))


def median(a: Column, least: int = 1) -> Column:

    def of(some: Column) -> Column:
        n = F.size(some)
        middle = lambda k: F.get(some, F.floor(k).cast("int"))
        return F.when(n >= least, F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2))

    return once(F.sort_array(known(a)), of)


def slope(a: Column, least: int = 3) -> Column:
    """Of the least-squares line through the known values, at the distance of their places."""
    points = F.filter(F.transform(a, lambda y, k: F.struct(k.cast("double").alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())

    def of(points: Column) -> Column:
        n = F.size(points)
        s = lambda f: F.aggregate(points, F.lit(0.0), lambda t, p: t + f(p))
        x, y = s(lambda p: p["x"]), s(lambda p: p["y"])
        return F.when(n >= least, F.try_divide(n * s(lambda p: p["x"] * p["y"]) - x * y, n * s(lambda p: p["x"] * p["x"]) - x * x))

    return once(points, of)


def cagr(a: Column, periods: Column, years: int) -> Column:
    """Growth a year from the value ``years`` before the last one, by actual days; both have to be positive."""
    first, end = at(a, years + 1), at(a, 1)
    span = F.datediff(at(periods, 1), at(periods, years + 1)) / 365.25
    return F.when((first > 0) & (end > 0) & (span > 0), F.pow(end / first, 1 / span) - 1)


def ratio(a: Column, b: Column, positive: bool = False) -> Column:
    return F.try_divide(a, F.when(b > 0, b) if positive else F.nullif(b, F.lit(0.0)))


def each(f: Callable[..., Column], *arrays: Column) -> Column:
    """f over the values at the same place of several arrays."""
    if len(arrays) == 2:
        return F.zip_with(*arrays, f)
    names = [f"a{k}" for k in range(len(arrays))]
    return F.transform(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names)]), lambda x: f(*[x[n] for n in names]))


def average_of_two(a: Column) -> Column:
    return F.coalesce((at(a, 1) + at(a, 2)) / 2, at(a, 1))


def share_of(a: Column) -> Column:
    """The share of the known booleans of an array that hold."""
    return once(known(a), lambda some: F.when(F.size(some) > 0, F.size(F.filter(some, lambda x: x)) / F.size(some)))


def pairs_rising(a: Column) -> Column:
    """For each value but the first whether it is positive and above a positive one before; null if either is unknown."""
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(a), F.lit(2))), lambda k: (F.get(a, k - 1) > F.get(a, k - 2)) & (F.get(a, k - 2) > 0))


def metric(value: Column, applies: Column | None = None) -> Column:
    """struct(value, status) of a value."""
    value = value.cast("double")
    status = F.when(value.isNotNull(), "OK").otherwise("UNKNOWN")
    if applies is not None:
        value, status = F.when(applies, value), F.when(applies, status).otherwise("NA")
    return F.struct(value.alias("value"), status.alias("status"))


def prepared(df: DataFrame) -> DataFrame:
    """The frame of :func:`metric_columns` with what its metrics share, step by step, so that each is computed once a row."""
    y, q, c = (lambda n: F.col(f"y_{n}")), (lambda n: F.col(f"q_{n}")), (lambda n: F.col(f"m_{n}"))
    span = F.datediff(at(F.col("q_period"), 1), at(F.col("q_period"), 4)) <= 300
    sums = ("operating_profit", "depreciation", "interest", "net_profit", "other_income", "pbt", "sales")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    df = df.withColumns({f"t_{n}": F.coalesce(F.when(span, total(q(n), 4)), at(y(n), 1)) for n in sums})
    df = df.withColumns({
        "m_book": each(lambda a, b: a + b, y("equity_capital"), y("reserves")),
        "m_nopat": each(lambda op, d: (op - d) * (1 - TAX), y("operating_profit"), y("depreciation")),
        "m_opm": each(lambda op, s: ratio(op, s, True), y("operating_profit"), y("sales")),
        "m_debt": each(lambda b, i: F.when(b <= 0, 0.0).otherwise(b - zero(i)), y("borrowings"), y("investments")),
        "m_roce": F.transform(y("roce_pct"), lambda x: x / 100),
        "m_dep_rate": each(lambda a, b: ratio(a, b, True), y("depreciation"), y("fixed_assets")),
        "m_retained": each(lambda p, o: p * (1 - zero(o) / 100), y("net_profit"), y("payout_pct")),
        "m_dividends": each(lambda p, o: F.greatest(p, F.lit(0.0)) * zero(o) / 100, y("net_profit"), y("payout_pct")),
        "m_paid": known(last(y("payout_pct"), 5)), "m_fcf3": median(last(y("fcf"), 3)), "m_mcap": F.col("price") * F.col("shares"),
        "m_ke": RISK_FREE + (0.67 * clip(F.coalesce("beta", F.lit(1.0)), 0.6, 1.6) + 0.33) * PREMIUM,
        "m_kd": clip(ratio(F.col("t_interest"), average_of_two(y("borrowings")), True), RISK_FREE, RISK_FREE + 0.08),
        "m_accrual": ratio(at(y("net_profit"), 1) - at(y("cfo"), 1), at(y("total_assets"), 1), True),
        "m_beneish0": _beneish(y)(0), "m_beneish1": _beneish(y)(1), "m_nopat_ttm": (F.col("t_operating_profit") - F.col("t_depreciation")) * (1 - TAX),
    })
    d, e = zero(at(y("borrowings"), 1)), F.col("m_mcap")
    df = df.withColumns({
        "m_capital": each(lambda b, d, i: F.when(b + d - zero(i) > 0, b + d - zero(i)), c("book"), y("borrowings"), y("investments")), "m_net": at(c("debt"), 1),
        "m_wacc": F.greatest(ratio(e, d + e) * c("ke") + ratio(d, d + e) * F.coalesce(c("kd"), F.lit(RISK_FREE + 0.02)) * (1 - TAX), F.lit(TERMINAL + 0.03)),
        "m_reinvested": _reinvestment(y, c("nopat")), "m_roe": ratio(F.col("t_net_profit"), average_of_two(c("book")), True),
    })
    grown = at(c("capital"), 1) - at(c("capital"), 6)
    return df.withColumns({
        "m_roic": ratio(c("nopat_ttm"), average_of_two(c("capital")), True), "m_spreads": F.transform(each(lambda n, k: ratio(n, k, True), c("nopat"), c("capital")), lambda r: r - c("wacc")),
        "m_incremental": ratio(at(c("nopat"), 1) - at(c("nopat"), 6), F.when(grown > 0, grown)),
    })


def metric_columns(non_financial: Column | None = None) -> dict[str, Column]:
    """Metrics of a :func:`prepared` frame of histories: y_<item> for years and q_<item> for quarters (see :func:`histories`), price, shares and beta.

    Items: sales, expenses, operating_profit, other_income, interest, depreciation, pbt, net_profit, tax_pct, payout_pct, equity_capital, reserves,
    borrowings, other_liabilities, total_assets, fixed_assets, cwip, investments, other_assets, cfo, cfi, fcf, debtor_days, inventory_days, payable_days,
    roce_pct, eps, deposits.
    """
    non_financial = F.lit(True) if non_financial is None else non_financial
    y, c = (lambda n: F.col(f"y_{n}")), (lambda n: F.col(f"m_{n}"))
    years, shares, mcap = F.col("y_period"), F.col("shares"), F.col("m_mcap")
    ttm = lambda n: F.col(f"t_{n}")
    book, nopat, capital, opm, debt, roce, dep_rate, retained, dividends = (c(n) for n in ("book", "nopat", "capital", "opm", "debt", "roce", "dep_rate", "retained", "dividends"))
    ke, wacc, nopat_ttm, roic, spreads, net, fcf3 = (c(n) for n in ("ke", "wacc", "nopat_ttm", "roic", "spreads", "net", "fcf3"))
    fcf, op_ttm, accrual, beneish = y("fcf"), ttm("operating_profit"), c("accrual"), lambda k: c(f"beneish{k}")
    growth = lambda a, n: cagr(a, years, n)
    reinvested, incremental, roe = c("reinvested"), c("incremental"), c("roe")
    fundamental = clip(reinvested * incremental, -0.10, 0.30)
    leak = total(retained, 5) - (at(y("reserves"), 1) - at(y("reserves"), 6))
    paid = c("paid")
    years_paid = F.size(F.filter(paid, lambda x: x > 0))
    funded = each(lambda a, b, d: a + b - d >= 0, y("cfo"), y("cfi"), dividends)
    m, bank = metric, ~non_financial
    return {
        "roic_ttm": m(roic, non_financial), "wacc": m(wacc, non_financial), "spread_ttm": m(roic - wacc, non_financial),
        "spread_median_5y": m(median(last(spreads, 5), 3), non_financial), "spread_trend_5y": m(slope(last(spreads, 5)), non_financial),
        "roce_median_10y": m(median(last(roce, 10), 3), non_financial), "roce_min_10y": m(F.array_min(known(last(roce, 10))), non_financial),
        "opm_median_8y": m(median(last(opm, 8), 3), non_financial), "opm_cv_8y": m(ratio(deviation(last(opm, 8), True), F.abs(mean(last(opm, 8)))), non_financial),
        "opm_chg_3y": m(at(opm, 1) - at(opm, 4), non_financial), "sales_growth_3y_pos": m((at(y("sales"), 1) > at(y("sales"), 4)).cast("double")),
        "moat_persistence": m(share_of(F.transform(last(roce, 10), lambda r: r > wacc)), non_financial),
        "pricing_power_proxy": m(_pricing_power(y, opm), non_financial),
        "gross_margin_median_5y": m(F.lit(None), non_financial), "gm_stability_5y": m(F.lit(None), non_financial),
        "roa_ttm": m(ratio(ttm("net_profit"), average_of_two(y("total_assets")), True), bank), "roe_coe_spread": m(roe - ke, bank),
        "nim_pct": m(ratio(at(y("sales"), 1) - at(y("interest"), 1), average_of_two(y("total_assets")), True), bank),
        "cost_to_income": m(ratio(at(y("expenses"), 1), at(y("sales"), 1) - at(y("interest"), 1) + F.coalesce(at(y("other_income"), 1), F.lit(0.0)), True), bank),
        "roe_median_5y": m(median(last(each(lambda p, b: ratio(p, b, True), y("net_profit"), book), 5), 3), bank),
        "net_debt": m(net, non_financial), "net_debt_ebitda": m(ratio(net, op_ttm, True), non_financial),
        "net_debt_ebitda_prev": m(ratio(at(debt, 2), at(y("operating_profit"), 2), True), non_financial),
        "net_debt_fcf_years": m(F.when(net <= 0, 0.0).when(fcf3 <= 0, 10.0).otherwise(F.least(ratio(net, fcf3), F.lit(10.0))), non_financial),
        "int_cover_ttm": m(ratio(op_ttm, ttm("interest"), True), non_financial),
        "int_cover_min_5y": m(F.array_min(known(last(each(lambda a, b: ratio(a, b, True), y("operating_profit"), y("interest")), 5))), non_financial),
        "altman_zpp": m(altman(y), non_financial), "debt_equity": m(ratio(at(y("borrowings"), 1), at(book, 1), True), non_financial),
        "de_trend_3y": m(slope(last(each(lambda a, b: ratio(a, b, True), y("borrowings"), book), 3)), non_financial),
        "fin_leverage": m(ratio(at(y("borrowings"), 1), at(book, 1), True), bank), "borrowing_cost": m(ratio(ttm("interest"), average_of_two(y("borrowings")), True), bank),
        "cfo_to_pat_5y": m(ratio(total(y("cfo"), 5), total(y("net_profit"), 5), True), non_financial),
        "fcf_conversion_5y": m(ratio(total(fcf, 5), total(y("net_profit"), 5), True), non_financial),
        "cfo_to_ebitda_5y": m(ratio(total(y("cfo"), 5), total(y("operating_profit"), 5), True), non_financial),
        "accrual_ratio_sloan": m(accrual, non_financial), "accrual_ratio_sloan_abs": m(F.abs(accrual), non_financial),
        "beneish_m": m(beneish(0), non_financial), "beneish_m_prev": m(beneish(1), non_financial),
        "beneish_level": m(F.when(beneish(0) < -2.22, 100.0).when(beneish(0) <= -1.78, 50.0).when(beneish(0).isNotNull(), 0.0), non_financial),
        "other_income_share": m(ratio(ttm("other_income"), ttm("pbt"), True)), "other_income_share_prev": m(ratio(at(y("other_income"), 2), at(y("pbt"), 2), True)),
        "cash_tax_gap": m(mean(F.transform(last(y("tax_pct"), 3), lambda x: F.abs(x / 100 - TAX)))),
        "capitalisation_proxy": m(ratio(at(y("cwip"), 1), at(y("fixed_assets"), 1) + at(y("cwip"), 1), True), non_financial),
        **{f"{n}_days_delta_3y": m(at(y(f"{c}_days"), 1) - at(y(f"{c}_days"), 4), non_financial) for n, c in (("receivable", "debtor"), ("inventory", "inventory"), ("payable", "payable"))},
        "ccc_delta_3y": m(reduce(lambda a, b: a + b, [s * (at(y(c), 1) - at(y(c), 4)) for c, s in (("debtor_days", 1), ("inventory_days", 1), ("payable_days", -1))]), non_financial),
        "depreciation_rate_cv_5y": m(ratio(deviation(last(dep_rate, 5), False), mean(last(dep_rate, 5))), non_financial),
        "reserves_leakage_5y": m(clip(ratio(leak, total(retained, 5)), -1, 1), non_financial),
        "reinvestment_rate_5y": m(reinvested, non_financial), "incremental_roic_5y": m(incremental, non_financial), "fundamental_growth": m(fundamental, non_financial),
        "sales_cagr_3y": m(growth(y("sales"), 3)), "sales_cagr_5y": m(growth(y("sales"), 5)), "pat_cagr_5y": m(growth(y("net_profit"), 5)), "eps_cagr_5y": m(growth(y("eps"), 5)), "bvps_cagr_5y": m(growth(book, 5), bank),
        "growth_consistency_5y": m(share_of(each(lambda a, b: a & b, pairs_rising(last(y("sales"), 6)), pairs_rising(last(y("net_profit"), 6))))),
        "sales_yoy_ttm": m(ratio(ttm("sales"), at(y("sales"), 2), True) - 1), "pat_yoy_ttm": m(ratio(ttm("net_profit") - at(y("net_profit"), 2), F.abs(at(y("net_profit"), 2)))),
        "capex_return_test": m(ratio(at(y("operating_profit"), 1) - at(y("operating_profit"), 6), -total(y("cfi"), 5), True), non_financial),
        "self_funding_5y": m(share_of(last(funded, 5)), non_financial),
        "payout_discipline": m(F.when(F.size(paid) == 5, F.when((years_paid >= 4) & mean(paid).between(20, 60), 100.0).when(years_paid <= 2, 0.0).otherwise(50.0))),
        "mcap": m(mcap), "bvps": m(ratio(at(book, 1), shares, True)), "eps_ttm": m(ratio(ttm("net_profit"), shares, True)),
        "pe_ttm": m(ratio(mcap, ttm("net_profit"), True)), "pb": m(ratio(mcap, at(book, 1), True)), "earnings_yield": m(ratio(ttm("net_profit"), mcap, True)),
        "ev": m(mcap + net, non_financial), "fcf_yield": m(ratio(fcf3, mcap, True), non_financial), "div_yield": m(ratio(at(dividends, 1), mcap, True)), "ev_ebitda_ttm": m(ratio(mcap + net, op_ttm, True), non_financial),
        "coe": m(ke), "model_epv": m(ratio(ratio(nopat_ttm, wacc) - net, shares, True), non_financial),
    }


def altman(y: Callable[[str], Column]) -> Column:
    """Z'': working capital, reserves and earnings over assets, equity over liabilities."""
    ta = at(y("total_assets"), 1)
    ebit = at(y("operating_profit"), 1) - at(y("depreciation"), 1) + F.coalesce(at(y("other_income"), 1), F.lit(0.0))
    wc = at(y("other_assets"), 1) - at(y("other_liabilities"), 1)
    equity = at(y("equity_capital"), 1) + at(y("reserves"), 1)
    return 3.25 + 6.56 * ratio(wc, ta, True) + 3.26 * ratio(at(y("reserves"), 1), ta, True) + 6.72 * ratio(ebit, ta, True) + 1.05 * ratio(equity, at(y("borrowings"), 1) + at(y("other_liabilities"), 1), True)


def _beneish(y: Callable[[str], Column]) -> Callable[[int], Column]:
    """The M-score ``back`` years ago, from keyed components: an unknown one counts as no change; six have to be known."""

    def score(back: int) -> Column:
        now, old = (lambda n: at(y(n), 1 + back)), (lambda n: at(y(n), 2 + back))
        change = lambda f: ratio(f(now), f(old))
        margin = lambda t: ratio(t("operating_profit"), t("sales"), True)
        rate = lambda t: ratio(t("depreciation"), t("depreciation") + t("fixed_assets"), True)
        parts = [
            (0.92, change(lambda t: t("debtor_days")), 1.0), (0.528, ratio(margin(old), margin(now)), 1.0),
            (0.404, change(lambda t: 1 - ratio(t("other_assets") + t("fixed_assets"), t("total_assets"), True)), 1.0), (0.892, change(lambda t: t("sales")), 1.0),
            (0.115, ratio(rate(old), rate(now)), 1.0), (4.679, ratio(now("net_profit") - now("cfo"), now("total_assets"), True), 0.0),
            (-0.327, change(lambda t: ratio(t("borrowings") + t("other_liabilities"), t("total_assets"), True)), 1.0),
        ]
        n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for _, p, _ in parts])
        # the expense component is never known: it stands at no change
        return F.when(n >= 6, -4.84 - 0.172 + reduce(lambda a, b: a + b, [w * F.coalesce(p, F.lit(d)) for w, p, d in parts]))

    return score


def _reinvestment(y: Callable[[str], Column], nopat: Column) -> Column:
    """What five years put into fixed and working capital, over their after-tax operating profit."""
    working = each(lambda a, b: a - b, y("other_assets"), y("other_liabilities"))
    net = total(F.transform(y("cfi"), lambda x: F.greatest(-x, F.lit(0.0))), 5) - total(y("depreciation"), 5) + at(working, 1) - at(working, 6)
    return ratio(net, total(nopat, 5), True)


def _pricing_power(y: Callable[[str], Column], opm: Column) -> Column:
    """The margin's difference between the two years with the lowest sales growth, the later place in ascending growth minus the earlier."""
    sales = y("sales")
    grown = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(sales) - 1, F.lit(1))), lambda k: F.struct((F.try_divide(F.get(sales, k), F.get(sales, k - 1)) - 1).alias("g"), F.get(opm, k).alias("m"))), lambda x: x["g"].isNotNull() & x["m"].isNotNull())
    return once(F.slice(F.sort_array(grown), 1, 2), lambda low: F.when(F.size(low) == 2, F.get(low, F.lit(1))["m"] - F.get(low, F.lit(0))["m"]))


def metrics_long(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """(keys, metric, value, status) of a prepared frame, a row for each metric; each is computed once, whatever is read of it."""
    held = df.select(*keys, *[c.alias(f"__{n}") for n, c in columns.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"__{n}").alias("m")) for n in columns]))
    return held.select(*keys, rows.alias("__m")).select(*keys, "__m.metric", "__m.m.value", "__m.m.status")


def f_score(y: Callable[[str], Column], bank: Column | None = None) -> Column:
    """struct(score, known) of seven yes-or-no signals; unknown ones don't count, and a bank has no cash-flow and leverage signals."""
    bank = F.lit(False) if bank is None else bank
    roa = lambda k: ratio(at(y("net_profit"), k), at(y("total_assets"), k), True)
    lever = lambda k: ratio(at(y("borrowings"), k), at(y("total_assets"), k), True)
    turn = lambda k: ratio(at(y("sales"), k), at(y("total_assets"), k), True)
    non_bank = lambda c: F.when(~bank, c)
    signals = known(F.array(roa(1) > 0, non_bank(at(y("cfo"), 1) > 0), roa(1) > roa(2), non_bank(at(y("cfo"), 1) > at(y("net_profit"), 1)), non_bank(lever(1) <= lever(2)), at(y("equity_capital"), 1) <= 1.02 * at(y("equity_capital"), 2), turn(1) > turn(2)))
    return F.when(F.size(y("net_profit")) >= 2, F.struct(F.size(F.filter(signals, lambda x: x)).alias("score"), F.size(signals).alias("known")))


def triangulated(models: Column, least: int = 2) -> Column:
    """Of an array of (value, weight): the weighted median of two or more known models, else the one there is."""
    some = F.filter(models, lambda m: m["value"].isNotNull() & (m["value"] > 0))
    return F.when(F.size(some) >= least, weighted_median(some)).when(F.size(some) == 1, F.get(some, F.lit(0))["value"])
