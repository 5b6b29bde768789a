"""Queries on companies: metrics of statements and filings, fair values, flags and ratings, for all dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rating, statements, valuation
from ..operators.profiles import catalogue, profile_of
from ..sources.scratch import written
from . import roles
from .registry import query

R = lambda x, n=6: F.round(x, n)

#: Items of a company's statements from the sums of its orders by priority: sales, operating_profit, net_profit, borrowings and interest.
DERIVED = {
    "sales": "sales", "operating_profit": "0.5 * operating_profit", "net_profit": "net_profit", "interest": "interest", "borrowings": "borrowings", "expenses": "sales - 0.5 * operating_profit", "other_income": "0.05 * net_profit", "depreciation": "0.1 * operating_profit",
    "pbt": "1.3 * net_profit", "tax_pct": "25.0 + (sales % 7)", "payout_pct": "sales % 60", "equity_capital": "0.01 * sales", "reserves": "0.8 * sales", "other_liabilities": "0.3 * sales", "total_assets": "1.11 * sales + borrowings", "fixed_assets": "0.5 * sales", "cwip": "0.05 * sales + 0.01 * borrowings",
    "investments": "0.1 * borrowings", "other_assets": "0.4 * sales", "cfo": "1.1 * net_profit", "cfi": "-0.8 * net_profit", "fcf": "0.3 * net_profit - 0.02 * borrowings", "debtor_days": "30 + 90 * interest / sales", "inventory_days": "40 + 20 * operating_profit / sales", "payable_days": "35 + 30 * net_profit / sales", "roce_pct": "100 * operating_profit / sales",
    "eps": "net_profit / 1000", "working_capital_days": "20 + 8 * borrowings / sales", "deposits": "0.6 * borrowings", "financing_profit": "0.2 * operating_profit", "gross_npa_pct": "1 + 90 * interest / sales", "net_npa_pct": "0.3 + 20 * interest / sales",
}
#: What the latest filing of a company says, from its last year: null for every third company.
FILED = {
    "current_assets": "0.3 * y_sales", "current_liabilities": "0.2 * y_sales", "cash": "0.1 * y_sales", "borrowings_current": "0.4 * y_borrowings", "cet1": "7 + (y_sales % 9)", "capital_adequacy_ratio": "12 + (y_sales % 5)", "gross_npa": "0.03 * y_borrowings", "net_npa": "0.01 * y_borrowings",
    "return_on_assets": "1 + y_borrowings / y_sales", "advances": "0.7 * y_borrowings", "deposits": "0.6 * y_borrowings", "provisions": "0.02 * y_borrowings",
}
#: The items of which quarters are read, for sums of four and shares of bad loans, and borrowings, so that years and quarters come from the same sums of orders.
QUARTERLY = ["operating_profit", "depreciation", "interest", "net_profit", "other_income", "pbt", "sales", "borrowings", "gross_npa_pct", "net_npa_pct"]
#: Items of years that only the first step of the metrics reads.
UNREAD = ["investments", "roce_pct", "gross_npa_pct", "net_npa_pct"]
INDUSTRIES = ["Banks", "Power", "IT - Software", "Realty", "Pharmaceuticals & Biotechnology", "Finance", "Chemicals", "Insurance", "Automobiles", "something else"]

_BASE = [i for _, i, _ in roles.ITEMS]


def frames(spark, sf_dir) -> DataFrame:
    """(as_of, symbol, y_<item>, q_<item> of those read, x_<item>, ...): what was known of each company, 15 customers, 90 days after each year.

    A company's years and quarters are packed once; each date takes those visible by then, so facts don't meet dates one by one.
    """
    orders = roles.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    value = lambda p, s: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice") * (s * 0.98765432101)))
    quarters = orders.groupBy(F.floor(F.col("o_custkey") / 15).alias("symbol"), F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("period_end")).agg(*[value(p, s).alias(i) for p, i, s in roles.ITEMS])
    years = quarters.groupBy("symbol", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end")).agg(*[F.sum(i).alias(i) for i in _BASE])

    items = {"y": list(DERIVED), "q": QUARTERLY}

    def packed(rows: DataFrame, kind: str) -> DataFrame:
        held = rows.selectExpr("symbol", "period_end", "period_end + CAST(CASE WHEN month(period_end) IN (3, 12) THEN 60 ELSE 45 END AS INT) AS visible_from", *[f"CAST({DERIVED[c]} AS DOUBLE) AS {c}" for c in items[kind]])
        return held.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("period_end", "visible_from", *items[kind]))).alias(kind))

    dates = years.select(F.date_add("period_end", 90).alias("as_of")).distinct()
    both = packed(years, "y").join(packed(quarters, "q"), "symbol").withColumn("__first", F.array_min("y.visible_from"))
    both = both.join(F.broadcast(dates), F.col("as_of") >= F.col("__first")).drop("__first")  # a date meets the companies known by then
    for kind, n in (("y", 12), ("q", 13)):
        both = both.withColumn(kind, F.filter(kind, lambda x: x["visible_from"] <= F.col("as_of"))).withColumn(kind, F.slice(kind, F.greatest(F.size(kind) - n + 1, F.lit(1)), n))
    # by transform: the code of so many fields of arrays in one generated method would be too long for the JVM to compile
    field = lambda kind, i: F.transform(kind, lambda x: x[i])
    flat = both.select("as_of", "symbol", *[c for kind in "yq" for c in (field(kind, "period_end").alias(f"{kind}_period"), *[field(kind, i).alias(f"{kind}_{i}") for i in items[kind]])])
    s, net = F.col("symbol"), statements.at(F.col("y_net_profit"), 1)
    face = F.element_at(F.array(*[F.lit(v) for v in (1.0, 2.0, 5.0, 10.0)]), (1 + s % 4).cast("int"))
    flat = flat.withColumn("face_value", face).withColumn("shares", statements.at(F.col("y_equity_capital"), 1) / F.col("face_value"))
    industry = F.element_at(F.array(*[F.lit(v) for v in INDUSTRIES]), (1 + s % 10).cast("int"))
    flat = flat.withColumns({
        "price": (8.37 + s % 25 + 0.001 * s) * net / F.col("shares"), "beta": 0.5 + 0.05 * (s % 30), "vol_250": 0.2 + 0.01 * (s % 30), "history_days": (100 + s % 400).cast("double"), "stmt_age_days": F.datediff("as_of", F.greatest(F.element_at("y_period", -1), F.element_at("q_period", -1))).cast("double"),
        "promoter_chg_1y": (s % 9 - 6).cast("double"), "ofs_deals": s % 2, "pledged_pct_of_promoter": F.when(s % 4 == 1, (s % 60).cast("double")), "asm_stage": s % 3, "p": profile_of(industry),
        "y_mcap": F.transform(F.arrays_zip("y_period", "y_net_profit"), lambda x: F.when((s + F.year(x["y_period"])) % 7 != 3, (8 + (s + F.year(x["y_period"])) % 25) * x["y_net_profit"])),
    }).select("*", "p.profile", "p.notes").drop("p")
    last = {i: e.replace("y_sales", "element_at(y_sales, -1)").replace("y_borrowings", "element_at(y_borrowings, -1)") for i, e in FILED.items()}
    opinion = F.when(s % 3 != 0, F.element_at(F.array(*[F.lit(v) for v in ("Unmodified opinion", "Qualified opinion", "A clean report", "Adverse")]), (1 + s % 4).cast("int")))
    return flat.select("*", *[F.when(s % 3 != 0, F.expr(e)).cast("double").alias(f"x_{i}") for i, e in last.items()], opinion.alias("x_auditor_opinion"))


def measured(spark, sf_dir) -> tuple[DataFrame, dict]:
    """The frames with the steps of all metrics, each written once, and the metrics as columns."""
    company = ~F.col("profile").isin("BANK", "NBFC_FIN")
    base = statements.metric_columns(company)
    df = statements.prepared(frames(spark, sf_dir))
    df = written(df.drop(*[f"q_{i}" for i in QUARTERLY if not i.endswith("_pct")], *[f"y_{i}" for i in UNREAD]))
    df = written(valuation.valued(df, base["fundamental_growth"]["value"]))
    df = df.withColumn("net_debt_ebitda", base["net_debt_ebitda"]["value"])
    return df, base | valuation.valuation_columns() | valuation.filing_columns()


def _frames_sql() -> str:
    """The frames as lists, in the order of their periods."""
    shares = ", ".join(f"sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice * ({s} * 0.98765432101) END) AS {i}" for p, i, s in [("1-URGENT", "sales", "1e0"), ("2-HIGH", "operating_profit", "0.2e0"), ("3-MEDIUM", "net_profit", "0.1e0"), ("4-NOT SPECIFIED", "borrowings", "0.5e0"), ("5-LOW", "interest", "0.02e0")])
    lists = lambda k: ", ".join(f"list({i} ORDER BY period_end) AS {k}_{i}" for i in DERIVED)
    items = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in DERIVED.items())
    filed = ", ".join(f"CASE WHEN symbol % 3 <> 0 THEN CAST({e.replace('y_sales', 'y_sales[-1]').replace('y_borrowings', 'y_borrowings[-1]')} AS DOUBLE) END AS x_{i}" for i, e in FILED.items())
    names = ", ".join(f"'{v}'" for v in INDUSTRIES)
    return f"""quarters AS (SELECT CAST(floor(o_custkey / 15) AS BIGINT) AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, {shares} FROM orders GROUP BY ALL),
years AS (SELECT symbol, make_date(year(period_end), 12, 31) AS period_end, {", ".join(f"sum({i}) AS {i}" for i in _BASE)} FROM quarters GROUP BY ALL),
dates AS (SELECT DISTINCT period_end + 90 AS as_of FROM years),
yr AS (SELECT as_of, symbol, period_end, row_number() OVER (PARTITION BY as_of, symbol ORDER BY period_end DESC) AS rn, {items} FROM years JOIN dates ON period_end + CAST(CASE WHEN month(period_end) IN (3, 12) THEN 60 ELSE 45 END AS INTEGER) <= as_of),
qr AS (SELECT as_of, symbol, period_end, row_number() OVER (PARTITION BY as_of, symbol ORDER BY period_end DESC) AS rn, {items} FROM quarters JOIN dates ON period_end + CAST(CASE WHEN month(period_end) IN (3, 12) THEN 60 ELSE 45 END AS INTEGER) <= as_of),
fy AS (SELECT as_of, symbol, list(period_end ORDER BY period_end) AS y_period, {lists("y")} FROM yr WHERE rn <= 12 GROUP BY ALL), fq AS (SELECT as_of, symbol, list(period_end ORDER BY period_end) AS q_period, {lists("q")} FROM qr WHERE rn <= 13 GROUP BY ALL),
f0 AS (SELECT *, [1.0, 2.0, 5.0, 10.0][1 + symbol % 4] AS face_value, y_equity_capital[-1] / [1.0, 2.0, 5.0, 10.0][1 + symbol % 4] AS shares, [{names}][1 + symbol % 10] AS industry FROM fy JOIN fq USING (as_of, symbol)),
f AS (SELECT *, CASE industry WHEN 'Banks' THEN 'BANK' WHEN 'Finance' THEN 'NBFC_FIN' WHEN 'Insurance' THEN 'NBFC_FIN' WHEN 'IT - Software' THEN 'IT_SERVICES' WHEN 'Pharmaceuticals & Biotechnology' THEN 'PHARMA' WHEN 'Realty' THEN 'CYCLICAL' ELSE 'GENERAL' END AS profile,
    (8.37 + symbol % 25 + 0.001 * symbol) * y_net_profit[-1] / shares AS price, 0.5 + 0.05 * (symbol % 30) AS beta, 0.2 + 0.01 * (symbol % 30) AS vol_250, CAST(100 + symbol % 400 AS DOUBLE) AS history_days, CAST(date_diff('day', greatest(y_period[-1], q_period[-1]), as_of) AS DOUBLE) AS stmt_age_days,
    CAST(symbol % 9 - 6 AS DOUBLE) AS promoter_chg_1y, symbol % 2 AS ofs_deals, CASE WHEN symbol % 4 = 1 THEN CAST(symbol % 60 AS DOUBLE) END AS pledged_pct_of_promoter, symbol % 3 AS asm_stage,
    [CASE WHEN (symbol + year(y_period[i])) % 7 <> 3 THEN (8 + (symbol + year(y_period[i])) % 25) * y_net_profit[i] END FOR i IN range(1, len(y_period) + 1)] AS y_mcap, {filed}, CASE WHEN symbol % 3 <> 0 THEN ['Unmodified opinion', 'Qualified opinion', 'A clean report', 'Adverse'][1 + symbol % 4] END AS x_auditor_opinion FROM f0)"""


def _last(x: str, n: int) -> str:
    return f"list_slice({x}, greatest(len({x}) - {n - 1}, 1), len({x}))"


def _total(x: str, n: int) -> str:
    return f"(CASE WHEN len({x}) >= {n} AND list_aggregate({_last(x, n)}, 'count') = {n} THEN list_sum({_last(x, n)}) END)"


def _median(x: str, least: int = 1) -> str:
    return f"(CASE WHEN list_aggregate({x}, 'count') >= {least} THEN list_aggregate({x}, 'median') END)"


def _over(a: str, b: str, positive: bool = True) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END)" if positive else f"(({a}) / nullif({b}, 0))"


def _each(e: str, of: str = "y_period") -> str:
    """A list of an expression in which [i] stands for the place."""
    return f"[{e} FOR i IN range(1, len({of}) + 1)]"


def _two(x: str) -> str:
    return f"coalesce(({x}[-1] + {x}[-2]) / 2, {x}[-1])"


def _clip(x: str, a: float, b: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a}), {b}) END)"


def _slope(x: str) -> str:
    s = lambda e: f"list_sum([{e} FOR k IN range(0, len({x})) IF {x}[k + 1] IS NOT NULL])"
    n = f"list_aggregate({x}, 'count')"
    return f"(CASE WHEN {n} >= 3 THEN ({n} * {s(f'k * {x}[k + 1]')} - {s('k')} * {s(f'{x}[k + 1]')}) / ({n} * {s('k * k')} - {s('k')} * {s('k')}) END)"


def _cagr(x: str, n: int, periods: str = "y_period") -> str:
    return f"(CASE WHEN {x}[-{n + 1}] > 0 AND {x}[-1] > 0 THEN pow({x}[-1] / {x}[-{n + 1}], 365.25 / date_diff('day', {periods}[-{n + 1}], {periods}[-1])) - 1 END)"


def _share(x: str) -> str:
    return f"(CASE WHEN list_aggregate({x}, 'count') > 0 THEN len([b FOR b IN {x} IF b]) / list_aggregate({x}, 'count') END)"


def _beneish_sql(k: int) -> str:
    n, o = (lambda i: f"y_{i}[-{1 + k}]"), (lambda i: f"y_{i}[-{2 + k}]")
    change = lambda e: _over(e(n), e(o), False)
    margin = lambda t: _over(t("operating_profit"), t("sales"))
    rate = lambda t: _over(t("depreciation"), f"{t('depreciation')} + {t('fixed_assets')}")
    parts = [
        (0.92, change(lambda t: t("debtor_days")), 1), (0.528, _over(margin(o), margin(n), False), 1), (0.404, change(lambda t: "(1 - " + _over(f"{t('other_assets')} + {t('fixed_assets')}", t("total_assets")) + ")"), 1), (0.892, change(lambda t: t("sales")), 1),
        (0.115, _over(rate(o), rate(n), False), 1), (4.679, _over(f"{n('net_profit')} - {n('cfo')}", n("total_assets")), 0), (-0.327, change(lambda t: _over(f"{t('borrowings')} + {t('other_liabilities')}", t("total_assets"))), 1),
    ]
    known = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for _, p, _ in parts)
    return f"(CASE WHEN {known} >= 6 THEN -4.84 - 0.172 + {' + '.join(f'({w}) * coalesce({p}, {d})' for w, p, d in parts)} END)"


def _dcf(g: str) -> str:
    ev = f"""(CASE WHEN m_wacc > 0.05 AND v_fcf0 > 0 THEN list_sum([v_fcf0 * pow((1 + {g}) / (1 + m_wacc), t) FOR t IN range(1, 6)]) + list_sum([v_fcf0 * pow(1 + {g}, 5) * pow(1 + {g} + (0.05 - {g}) * t / 5.0, t) / pow(1 + m_wacc, 5 + t) FOR t IN range(1, 6)])
        + v_fcf0 * pow(1 + {g}, 5) * pow(1.05, 6) / (m_wacc - 0.05) / pow(1 + m_wacc, 10) END)"""
    return f"(CASE WHEN NOT lender AND {ev} - m_net > 0 AND shares > 0 THEN ({ev} - m_net) / shares END)"


def _steps_sql() -> str:
    """The steps of the metrics, a table after another."""
    t = ", ".join(f"coalesce(CASE WHEN date_diff('day', q_period[-4], q_period[-1]) <= 300 THEN {_total(f'q_{n}', 4)} END, y_{n}[-1]) AS t_{n}" for n in ("operating_profit", "depreciation", "interest", "net_profit", "other_income", "pbt", "sales"))
    one = {
        "lender": "profile IN ('BANK', 'NBFC_FIN')", "m_book": _each("y_equity_capital[i] + y_reserves[i]"), "m_nopat": _each("(y_operating_profit[i] - y_depreciation[i]) * 0.75"), "m_opm": _each(_over("y_operating_profit[i]", "y_sales[i]")),
        "m_debt": _each("CASE WHEN y_borrowings[i] <= 0 THEN 0 ELSE y_borrowings[i] - coalesce(y_investments[i], 0) END"), "m_roce": _each("y_roce_pct[i] / 100"), "m_dep_rate": _each(_over("y_depreciation[i]", "y_fixed_assets[i]")), "m_retained": _each("y_net_profit[i] * (1 - coalesce(y_payout_pct[i], 0) / 100)"),
        "m_dividends": _each("greatest(y_net_profit[i], 0) * coalesce(y_payout_pct[i], 0) / 100"), "m_paid": f"[v FOR v IN {_last('y_payout_pct', 5)} IF v IS NOT NULL]", "m_fcf3": _median(_last("y_fcf", 3)), "m_mcap": "price * shares", "m_ke": "0.06 + (0.67 * least(greatest(coalesce(beta, 1), 0.6), 1.6) + 0.33) * 0.055",
        "m_kd": _clip(_over("t_interest", _two("y_borrowings")), 0.06, 0.14), "m_accrual": _over("y_net_profit[-1] - y_cfo[-1]", "y_total_assets[-1]"), "m_beneish0": _beneish_sql(0), "m_beneish1": _beneish_sql(1), "m_nopat_ttm": "(t_operating_profit - t_depreciation) * 0.75",
    }
    d = "coalesce(y_borrowings[-1], 0)"
    two = {
        "m_capital": _each("CASE WHEN m_book[i] + y_borrowings[i] - coalesce(y_investments[i], 0) > 0 THEN m_book[i] + y_borrowings[i] - coalesce(y_investments[i], 0) END"), "m_net": "m_debt[-1]",
        "m_wacc": f"greatest({_over('m_mcap', f'{d} + m_mcap', False)} * m_ke + {_over(d, f'{d} + m_mcap', False)} * coalesce(m_kd, 0.08) * 0.75, 0.08)", "m_roe": _over("t_net_profit", _two("m_book")), "m_working": _each("y_other_assets[i] - y_other_liabilities[i]"), "m_spent": _each("greatest(-y_cfi[i], 0)"),
    }
    three = {
        "m_reinvested": _over(f"{_total('m_spent', 5)} - {_total('y_depreciation', 5)} + m_working[-1] - m_working[-6]", _total("m_nopat", 5)), "m_roic": _over("m_nopat_ttm", _two("m_capital")), "m_spreads": _each(_over("m_nopat[i]", "m_capital[i]") + " - m_wacc"),
        "m_incremental": _over("m_nopat[-1] - m_nopat[-6]", "m_capital[-1] - m_capital[-6]"),
    }
    mult = f"[i FOR i IN range(1, len(y_mcap) + 1) IF y_mcap[i] IS NOT NULL]"
    four = {"v_fg": "CASE WHEN NOT lender THEN " + _clip("m_reinvested * m_incremental", -0.10, 0.30) + " END", "v_years": _last(mult, 10), "v_fcf3": _median(_last("[v FOR v IN y_fcf IF v IS NOT NULL]", 3)), "v_opm5": _median(_last("[v FOR v IN m_opm IF v IS NOT NULL]", 5)), "v_ev": "m_mcap + m_net", "v_payout": "y_payout_pct[-1]",
            "v_roe": _over("t_net_profit", "coalesce(CASE WHEN m_book[-1] > 0 AND m_book[-2] > 0 THEN (m_book[-1] + m_book[-2]) / 2 END, m_book[-1])"),
            "v_stand_in": "least(coalesce(CASE WHEN y_sales[-1] > 0 AND y_sales[-6] > 0 THEN pow(y_sales[-1] / y_sales[-6], 0.2) - 1 END, 0.08), 0.15)"}
    ev = "(y_mcap[i] + coalesce(m_debt[i], 0))"
    five = {
        "v_ev_ebitda": f"[{ev} / y_operating_profit[i] FOR i IN v_years IF y_operating_profit[i] > 0]", "v_ev_ebitda_positive": f"[{ev} / y_operating_profit[i] FOR i IN v_years IF y_operating_profit[i] > 0 AND {ev} > 0]", "v_p_fcf": "[y_mcap[i] / y_fcf[i] FOR i IN v_years IF y_fcf[i] > 0]",
        "v_pe": "[y_mcap[i] / y_net_profit[i] FOR i IN v_years IF y_net_profit[i] > 0]", "v_fcf0": "coalesce(CASE WHEN v_fcf3 > 0 THEN v_fcf3 END, CASE WHEN m_nopat_ttm > 0 THEN m_nopat_ttm * 0.5 END, v_fcf3)", "v_g1": _clip("coalesce(v_fg, v_stand_in)", -0.05, 0.25),
        "v_g": "least(least(greatest(1 - coalesce(v_payout / 100, 0), 0), 1) * v_roe, m_ke - 0.01)",
    }
    pb = "CASE WHEN m_ke > v_g AND (v_roe - v_g) / (m_ke - v_g) > 0 THEN (v_roe - v_g) / (m_ke - v_g) END"
    eq = lambda e: f"(CASE WHEN NOT lender AND {e} - m_net > 0 AND shares > 0 THEN ({e} - m_net) / shares END)"
    six = {
        "v_justified_pb": pb, "model_dcf_base": _dcf("v_g1"), "model_dcf_bull": _dcf("(v_g1 + 0.05)"), "model_dcf_bear": _dcf("(v_g1 - 0.05)"), "model_ev_ebitda": eq(f"({_clip(_median('v_ev_ebitda_positive', 3), 4, 30)} * v_opm5 * t_sales)"),
        "model_p_fcf": f"CASE WHEN NOT lender AND v_fcf3 > 0 AND shares > 0 THEN {_clip(_median('v_p_fcf', 3), 5, 60)} * v_fcf3 / shares END", "model_epv": eq("(CASE WHEN m_nopat_ttm > 0 AND m_wacc > 0 THEN m_nopat_ttm / m_wacc END)"),
    }
    seven = {
        "model_justified_pb": f"CASE WHEN lender THEN v_justified_pb * {_over('m_book[-1]', 'shares')} END",
        "model_ddm": f"CASE WHEN lender AND v_payout >= 30 AND m_ke > v_g AND {_over('t_net_profit', 'shares')} * v_payout / 100 > 0 THEN {_over('t_net_profit', 'shares')} * v_payout / 100 / (m_ke - v_g) END",
    }
    cyclical = "CASE WHEN profile = 'CYCLICAL' THEN {} ELSE {} END"
    eight = {"v_models": f"[m FOR m IN [{{'v': model_dcf_base, 'w': {cyclical.format(0.20, 0.40)}}}, {{'v': model_ev_ebitda, 'w': {cyclical.format(0.55, 0.35)}}}, {{'v': model_p_fcf, 'w': 0.25}}, {{'v': model_justified_pb, 'w': 0.70}}, {{'v': model_ddm, 'w': 0.30}}] IF m.v > 0]"}
    nine = {"v_sorted": "list_sort([m.v FOR m IN v_models])", "v_n": "len(v_models)", "v_base": "CASE WHEN len(v_models) >= 1 THEN list_min([m.v FOR m IN v_models IF list_sum([o.w FOR o IN v_models IF o.v <= m.v]) >= list_sum([o.w FOR o IN v_models]) / 2 - 1e-12]) END"}
    above = lambda x: f"(list_sum([pow((1 + {x}) / (1 + m_wacc), n) FOR n IN range(1, 11)]) + pow((1 + {x}) / (1 + m_wacc), 10) * 1.05 / (m_wacc - 0.05))"
    ten = {
        "v_bull": f"CASE WHEN v_base IS NOT NULL THEN CASE WHEN lender THEN v_sorted[-1] ELSE greatest(model_dcf_base, model_dcf_bull, model_ev_ebitda, model_p_fcf) END END", "v_bear": "CASE WHEN v_base IS NOT NULL THEN CASE WHEN lender THEN v_sorted[1] ELSE least(model_dcf_base, model_dcf_bear, model_ev_ebitda, model_p_fcf, model_epv) END END",
        "v_dispersion": "CASE WHEN v_n >= 2 THEN (v_sorted[-1] - v_sorted[1]) / list_aggregate(v_sorted, 'median') END",
        # the growth is sought by halves of the bounds, as there is no closed form
        "v_implied": f"CASE WHEN NOT lender AND v_ev > 0 AND v_fcf0 > 0 AND m_wacc > 0.05 AND {above('-0.5')} <= v_ev / v_fcf0 THEN list_reduce(list_concat([CAST(-0.5 AS DOUBLE)], [1.1 / pow(2, k) FOR k IN range(1, 22)]), lambda g, step: CASE WHEN g + step < m_wacc AND {above('(g + step)')} <= v_ev / v_fcf0 THEN g + step ELSE g END) + 1.1 / pow(2, 22) END",
    }
    out, before = [], "f"
    for k, step in enumerate([t, one, two, three, four, five, six, seven, eight, nine, ten]):
        columns = step if isinstance(step, str) else ", ".join(f"{e} AS {n}" for n, e in step.items())
        out.append(f"s{k} AS (SELECT *, {columns} FROM {before})")
        before = f"s{k}"
    return ",\n".join(out) + f", s AS (SELECT * FROM {before})"


def _metrics_sql() -> dict[str, tuple[str, str]]:
    """Of each metric its expression and whom it applies to: all, companies, lenders or banks."""
    all_, co, le, ba = "true", "NOT lender", "lender", "profile = 'BANK'"
    y = lambda n, k=1: f"y_{n}[-{k}]"
    rising = lambda n: f"(y_{n}[k] > y_{n}[k - 1] AND y_{n}[k - 1] > 0)"
    pe, ebitda = _over("m_mcap", "t_net_profit"), _over("v_ev", "t_operating_profit")
    usual = _median("v_pe", 3)
    back = f"CASE WHEN {usual} > 0 AND {pe} > 0 THEN least(greatest(ln({usual} / {pe}) / 3, -0.15), 0.15) ELSE 0 END"
    mid = f"(CASE WHEN {pe} IS NOT NULL AND {usual} IS NOT NULL THEN {_over('t_net_profit', 'm_mcap')} + {_clip('v_fg', -0.10, 0.20)} + {back} END)"
    width = "greatest(0.10, vol_250 / sqrt(3))"
    band = lambda h, now: f"(CASE WHEN {now} IS NOT NULL AND len({h}) >= 3 THEN len([v FOR v IN {h} IF v <= {now}]) / len({h}) END)"
    low_growth = "list_sort([{'g': y_sales[k] / y_sales[k - 1] - 1, 'm': m_opm[k]} FOR k IN range(2, len(y_sales) + 1) IF y_sales[k] / nullif(y_sales[k - 1], 0) IS NOT NULL AND m_opm[k] IS NOT NULL])"
    earned = "[{'p': y_period[i], 'v': coalesce(y_financing_profit[i], 0) + coalesce(y_other_income[i], 0)} FOR i IN range(1, len(y_period) + 1) IF y_financing_profit[i] IS NOT NULL OR y_other_income[i] IS NOT NULL]"
    leak = f"({_total('m_retained', 5)} - ({y('reserves')} - {y('reserves', 6)}))"
    paid_years = "len([v FOR v IN m_paid IF v > 0])"
    kept = _last("y_equity_capital", 5)
    # a rise by half or more without a fall of the profit is taken off its year
    growth_of = f"""(SELECT CASE WHEN len(o) >= 2 THEN pow(o[-1] / o[1], 1.0 / (len(o) - 1)) - 1 END FROM (SELECT list_filter(list_reduce(list_concat([{{'b': NULL::DOUBLE, 'p': NULL::DOUBLE, 'o': []::DOUBLE[]}}], [{{'b': c[i], 'p': p[i], 'o': []::DOUBLE[]}} FOR i IN range(1, len(c) + 1)]), lambda d, r: {{
        'b': CASE WHEN d.b > 0 AND r.b / d.b >= 1.5 AND (d.p IS NULL OR d.p <= 0 OR r.p IS NULL OR r.p / d.p >= 1) THEN d.b ELSE r.b END, 'p': r.p, 'o': list_append(d.o, CASE WHEN d.b > 0 AND r.b / d.b >= 1.5 AND (d.p IS NULL OR d.p <= 0 OR r.p IS NULL OR r.p / d.p >= 1) THEN d.b ELSE r.b END)}}).o, lambda v: v > 0) AS o FROM (SELECT {kept} AS c, {_last("y_net_profit", 5)} AS p)))"""
    nde = _over("m_net", "t_operating_profit")
    return {
        "roic_ttm": ("m_roic", co), "wacc": ("m_wacc", co), "spread_ttm": ("m_roic - m_wacc", co), "spread_median_5y": (_median(_last("m_spreads", 5), 3), co), "spread_trend_5y": (_slope(_last("m_spreads", 5)), co), "roce_median_10y": (_median(_last("m_roce", 10), 3), co), "roce_min_10y": (f"list_min({_last('m_roce', 10)})", co),
        "opm_median_8y": (_median(_last("m_opm", 8), 3), co), "opm_cv_8y": (_over(f"list_aggregate({_last('m_opm', 8)}, 'stddev_samp')", f"abs(list_avg({_last('m_opm', 8)}))", False), co), "opm_chg_3y": ("m_opm[-1] - m_opm[-4]", co), "sales_growth_3y_pos": (f"CAST({y('sales')} > {y('sales', 4)} AS DOUBLE)", all_),
        "moat_persistence": (_share(f"[r > m_wacc FOR r IN {_last('m_roce', 10)}]"), co), "pricing_power_proxy": (f"(CASE WHEN len({low_growth}) >= 2 THEN {low_growth}[2].m - {low_growth}[1].m END)", co), "gross_margin_median_5y": ("NULL", co), "gm_stability_5y": ("NULL", co),
        "roa_ttm": (_over("t_net_profit", _two("y_total_assets")), le), "roe_coe_spread": ("m_roe - m_ke", le), "nim_pct": (_over(f"{y('sales')} - {y('interest')}", _two("y_total_assets")), le), "cost_to_income": (_over(y("expenses"), f"{y('sales')} - {y('interest')} + coalesce({y('other_income')}, 0)"), le),
        "roe_median_5y": (_median(_last(_each(_over("y_net_profit[i]", "m_book[i]")), 5), 3), le), "net_debt": ("m_net", co), "net_debt_ebitda": (nde, co), "net_debt_ebitda_prev": (_over("m_debt[-2]", y("operating_profit", 2)), co),
        "net_debt_fcf_years": ("CASE WHEN m_net <= 0 THEN 0 WHEN m_fcf3 <= 0 THEN 10 ELSE least(m_net / nullif(m_fcf3, 0), 10) END", co), "int_cover_ttm": (_over("t_operating_profit", "t_interest"), co), "int_cover_min_5y": (f"list_min({_last(_each(_over('y_operating_profit[i]', 'y_interest[i]')), 5)})", co),
        "altman_zpp": (f"3.25 + 6.56 * {_over('m_working[-1]', y('total_assets'))} + 3.26 * {_over(y('reserves'), y('total_assets'))} + 6.72 * {_over(f'{y('operating_profit')} - {y('depreciation')} + coalesce({y('other_income')}, 0)', y('total_assets'))} + 1.05 * {_over('m_book[-1]', f'{y('borrowings')} + {y('other_liabilities')}')}", co),
        "debt_equity": (_over(y("borrowings"), "m_book[-1]"), co), "de_trend_3y": (_slope(_last(_each(_over("y_borrowings[i]", "m_book[i]")), 3)), co), "fin_leverage": (_over(y("borrowings"), "m_book[-1]"), le), "borrowing_cost": (_over("t_interest", _two("y_borrowings")), le),
        "cfo_to_pat_5y": (_over(_total("y_cfo", 5), _total("y_net_profit", 5)), co), "fcf_conversion_5y": (_over(_total("y_fcf", 5), _total("y_net_profit", 5)), co), "cfo_to_ebitda_5y": (_over(_total("y_cfo", 5), _total("y_operating_profit", 5)), co), "accrual_ratio_sloan": ("m_accrual", co), "accrual_ratio_sloan_abs": ("abs(m_accrual)", co),
        "beneish_m": ("m_beneish0", co), "beneish_m_prev": ("m_beneish1", co), "beneish_level": ("CASE WHEN m_beneish0 < -2.22 THEN 100 WHEN m_beneish0 <= -1.78 THEN 50 WHEN m_beneish0 IS NOT NULL THEN 0 END", co), "other_income_share": (_over("t_other_income", "t_pbt"), all_), "other_income_share_prev": (_over(y("other_income", 2), y("pbt", 2)), all_),
        "cash_tax_gap": (f"list_avg([abs(v / 100 - 0.25) FOR v IN {_last('y_tax_pct', 3)}])", all_), "capitalisation_proxy": (_over(y("cwip"), f"{y('fixed_assets')} + {y('cwip')}"), co), "receivable_days_delta_3y": (f"{y('debtor_days')} - {y('debtor_days', 4)}", co), "inventory_days_delta_3y": (f"{y('inventory_days')} - {y('inventory_days', 4)}", co),
        "payable_days_delta_3y": (f"{y('payable_days')} - {y('payable_days', 4)}", co), "ccc_delta_3y": (f"({y('debtor_days')} - {y('debtor_days', 4)}) + ({y('inventory_days')} - {y('inventory_days', 4)}) - ({y('payable_days')} - {y('payable_days', 4)})", co),
        "depreciation_rate_cv_5y": (_over(f"list_aggregate({_last('m_dep_rate', 5)}, 'stddev_pop')", f"list_avg({_last('m_dep_rate', 5)})", False), co), "reserves_leakage_5y": (_clip(_over(leak, _total("m_retained", 5), False), -1, 1), co), "reinvestment_rate_5y": ("m_reinvested", co), "incremental_roic_5y": ("m_incremental", co), "fundamental_growth": (_clip("m_reinvested * m_incremental", -0.10, 0.30), co),
        "sales_cagr_3y": (_cagr("y_sales", 3), all_), "sales_cagr_5y": (_cagr("y_sales", 5), all_), "pat_cagr_5y": (_cagr("y_net_profit", 5), all_), "eps_cagr_5y": (_cagr("y_eps", 5), all_), "bvps_cagr_5y": (_cagr("m_book", 5), le),
        "growth_consistency_5y": (_share(f"[{rising('sales')} AND {rising('net_profit')} FOR k IN range(greatest(len(y_period) - 4, 2), greatest(len(y_period), 2) + 1)]"), all_), "sales_yoy_ttm": (f"{_over('t_sales', y('sales', 2))} - 1", all_), "pat_yoy_ttm": (_over(f"t_net_profit - {y('net_profit', 2)}", f"abs({y('net_profit', 2)})", False), all_),
        "capex_return_test": (_over(f"{y('operating_profit')} - {y('operating_profit', 6)}", f"-{_total('y_cfi', 5)}"), co), "self_funding_5y": (_share(_last(_each("y_cfo[i] + y_cfi[i] - m_dividends[i] >= 0"), 5)), co), "payout_discipline": (f"CASE WHEN len(m_paid) = 5 THEN CASE WHEN {paid_years} >= 4 AND list_avg(m_paid) BETWEEN 20 AND 60 THEN 100 WHEN {paid_years} <= 2 THEN 0 ELSE 50 END END", all_),
        "mcap": ("m_mcap", all_), "bvps": (_over("m_book[-1]", "shares"), all_), "eps_ttm": (_over("t_net_profit", "shares"), all_), "pe_ttm": (pe, all_), "pb": (_over("m_mcap", "m_book[-1]"), all_), "earnings_yield": (_over("t_net_profit", "m_mcap"), all_), "ev": ("v_ev", co), "fcf_yield": (_over("m_fcf3", "m_mcap"), co), "div_yield": (_over("m_dividends[-1]", "m_mcap"), all_),
        "ev_ebitda_ttm": (ebitda, co), "coe": ("m_ke", all_), "model_epv": ("model_epv", co), "shares_cr": ("shares", all_), "mcap_cr": ("m_mcap", all_), "pe_band_pos_10y": (band("v_pe", pe), all_), "ev_ebitda_band_pos": (band("v_ev_ebitda", ebitda), co), "fcf0": ("v_fcf0", co), "nopat_ttm_val": ("m_nopat_ttm", co), "implied_growth": ("v_implied", co), "dcf_g1": ("v_g1", co),
        "own_ev_ebitda_median": (_median("v_ev_ebitda_positive", 3), co), "own_p_fcf_median": (_median("v_p_fcf", 3), co), "model_dcf_base": ("model_dcf_base", co), "model_dcf_bull": ("model_dcf_bull", co), "model_dcf_bear": ("model_dcf_bear", co), "model_ev_ebitda": ("model_ev_ebitda", co), "model_p_fcf": ("model_p_fcf", co),
        "model_justified_pb": ("model_justified_pb", le), "model_ddm": ("model_ddm", le), "justified_pb": ("v_justified_pb", le), "pb_vs_justified": (_over(_over("m_mcap", "m_book[-1]"), "v_justified_pb"), le), "fv_base": ("v_base", all_), "fv_bull": ("v_bull", all_), "fv_bear": ("v_bear", all_), "val_dispersion": ("v_dispersion", all_), "n_models": ("v_n", all_),
        "mos_base": (f"{_over('v_base', 'price')} - 1", all_), "er_lo": (f"{mid} - {width}", all_), "er_mid": (mid, all_), "er_hi": (f"{mid} + {width}", all_), "growth_gap": ("v_implied - v_fg", co), "growth_gap_val": ("v_implied - v_fg", co), "pe_ttm_feat": (pe, all_), "pat_ttm": ("t_net_profit", all_),
        "wc_days_delta_3y": (f"{y('working_capital_days')} - y_working_capital_days[greatest(len(y_period) - 3, 1)]", co), "current_ratio": (_over("x_current_assets", "x_current_liabilities"), co), "cash_to_debt": (_over("x_cash", y("borrowings")), co), "st_debt_share": (_over("x_borrowings_current", y("borrowings")), co),
        "contingent_to_networth": ("NULL", "false"), "accrual_ratio_bs_abs": ("NULL", co), "moat_grade_llm": ("NULL", all_), "mgmt_grade_llm": ("NULL", all_), "gnpa_pct": ("q_gross_npa_pct[-1]", le), "nnpa_pct": ("q_net_npa_pct[-1]", le), "gnpa_trend_4q": ("q_gross_npa_pct[-1] - q_gross_npa_pct[-5]", le), "gnpa_delta_4q_neg": ("q_gross_npa_pct[-1] - q_gross_npa_pct[-5]", le),
        "cet1_pct": ("x_cet1", ba), "provision_coverage": (_over("x_provisions", "x_gross_npa"), le), "deposit_vs_advance_growth": (f"{_over(y('deposits'), y('deposits', 2))} - 1", ba), "credit_cost": (_over("x_provisions", "x_advances"), le), "accrual_ratio_sloan_prev": (_over(f"{y('net_profit', 2)} - {y('cfo', 2)}", y("total_assets", 2)), co),
        "audit_opinion_clean": ("CAST(lower(x_auditor_opinion) LIKE '%unmodified%' OR lower(x_auditor_opinion) LIKE '%clean%' AS DOUBLE)", all_), "ppop_growth_3y": (f"(SELECT CASE WHEN e[-4].v > 0 AND e[-1].v > 0 THEN pow(e[-1].v / e[-4].v, 365.25 / date_diff('day', e[-4].p, e[-1].p)) - 1 END FROM (SELECT {earned} AS e))", le),
        "dilution_5y": (growth_of, all_), "ofs_matched": ("CAST(promoter_chg_1y < -2 AND ofs_deals > 0 AS DOUBLE)", all_), "leveraged_buyback": (f"CAST(coalesce({y('equity_capital')} < 0.98 * {y('equity_capital', 2)} AND NOT lender AND {nde} > 3, false) AS DOUBLE)", all_),
        "su_cfo_5y": (f"list_sum({_last('y_cfo', 5)})", all_), "kpi_cet1": ("x_cet1 / 100", ba), "kpi_car": ("x_capital_adequacy_ratio / 100", ba), "kpi_gnpa": ("x_gross_npa", le), "kpi_nnpa": ("x_net_npa", le), "kpi_roa": ("x_return_on_assets / 100", le), "kpi_advances": ("x_advances", ba), "kpi_deposits": ("x_deposits", ba), "kpi_provisions": ("x_provisions", ba),
    }


def _wide_sql() -> str:
    columns = ", ".join(f"CASE WHEN {who} THEN CAST({e} AS DOUBLE) END AS {n}" for n, (e, who) in _metrics_sql().items() if not n.startswith("model_"))
    models = ", ".join(f"CASE WHEN {who} THEN CAST({e} AS DOUBLE) END AS x{n}" for n, (e, who) in _metrics_sql().items() if n.startswith("model_"))
    return f"{_frames_sql()},\n{_steps_sql()}, w AS (SELECT as_of, symbol, profile, lender, price, vol_250, history_days, stmt_age_days, promoter_chg_1y, ofs_deals, pledged_pct_of_promoter, asm_stage, industry, {columns}, {models} FROM s)"


_LONG = " UNION ALL ".join(f"SELECT as_of, symbol, '{n}' AS metric, {'x' if n.startswith('model_') else ''}{n} AS v, {who.replace('lender', 'w.lender')} AS here FROM w" for n, (_, who) in _metrics_sql().items())


def places(x):
    """Nine places, or nine digits where there are more: what is equal but for rounding is equal."""
    return F.when(F.abs(x) < 1, F.round(x, 9)).otherwise(F.format_string("%.8e", x).cast("double")) + 0.0


def _places_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1 THEN round({x}, 9) ELSE CAST(printf('%.8e', {x}) AS DOUBLE) END + 0"


@query(f"WITH {_wide_sql()} SELECT as_of, symbol, metric, CASE WHEN v IS NOT NULL THEN {_places_sql('v')} END AS value, CASE WHEN NOT here THEN 'NA' WHEN v IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS status FROM ({_LONG})")
def company_metrics(spark, sf_dir) -> DataFrame:
    """All metrics of statements, filings and fair values in long form, of every company on every date."""
    df, columns = measured(spark, sf_dir)
    found = statements.metrics_long(df, ["as_of", "symbol"], columns)
    return found.select("as_of", "symbol", "metric", F.when(F.col("value").isNotNull(), places(F.col("value"))).alias("value"), "status")


def measured_wide(spark, sf_dir) -> DataFrame:
    """A row for each company and date with the values of all metrics, written once: scores, flags and ratings read it."""
    df, columns = measured(spark, sf_dir)
    return written(df.select("as_of", "symbol", "profile", "notes", "price", "history_days", "stmt_age_days", "pledged_pct_of_promoter", "asm_stage", "promoter_chg_1y", *[c["value"].alias(n) for n, c in columns.items()], F.col("profile").isin("BANK", "NBFC_FIN").alias("financial")))


#: Fixed values, as SQL has them: code, tier, the worst verdict that a soft one allows, condition.
_FLAGS_SQL = """[
    {'code': 'FORENSIC_BENEISH_2Y', 'tier': 'HARD', 'cap': 'SELL', 'on': beneish_m > -1.78 AND beneish_m_prev > -1.78 AND accrual_ratio_sloan > 0.10},
    {'code': 'FORENSIC_CASH_DIVERGENCE', 'tier': 'HARD', 'cap': 'SELL', 'on': NOT lender AND accrual_ratio_sloan_abs > 0.15 AND cfo_to_pat_5y < 0.5},
    {'code': 'SOLVENCY_BREACH', 'tier': 'HARD', 'cap': 'SELL', 'on': NOT lender AND ((altman_zpp < 1.1 AND int_cover_ttm < 1.5) OR (net_debt_ebitda > 6 AND int_cover_ttm < 1))},
    {'code': 'CAPITAL_BREACH_BANK', 'tier': 'HARD', 'cap': 'SELL', 'on': lender AND (coalesce(gnpa_pct > 10, false) OR coalesce(cet1_pct < 8, false))},
    {'code': 'AUDIT_QUALIFIED_OR_RESIGNED', 'tier': 'HARD', 'cap': 'SELL', 'on': audit_opinion_clean < 0.5},
    {'code': 'PLEDGE_GT_50', 'tier': 'HARD', 'cap': 'SELL', 'on': pledged_pct_of_promoter > 50},
    {'code': 'BENEISH_1Y', 'tier': 'SOFT', 'cap': 'HOLD', 'on': beneish_m > -1.78 AND NOT beneish_m_prev > -1.78},
    {'code': 'STALE_STATEMENTS', 'tier': 'SOFT', 'cap': 'HOLD', 'on': stmt_age_days > 200 AND stmt_age_days <= 400},
    {'code': 'PROMOTER_SELLING', 'tier': 'SOFT', 'cap': 'HOLD', 'on': promoter_chg_1y <= -5 AND NOT ofs_matched > 0},
    {'code': 'MOAT_EROSION', 'tier': 'SOFT', 'cap': 'HOLD', 'on': coalesce(spread_ttm < 0 AND spread_median_5y > 0.05, false) OR coalesce(opm_chg_3y < -0.05 AND sales_growth_3y_pos > 0, false)},
    {'code': 'DEBT_SPIKE', 'tier': 'SOFT', 'cap': 'HOLD', 'on': net_debt_ebitda - net_debt_ebitda_prev > 2},
    {'code': 'OTHER_INCOME_DEPENDENCE', 'tier': 'SOFT', 'cap': 'HOLD', 'on': other_income_share > 0.5 AND other_income_share_prev > 0.5},
    {'code': 'LEVERAGED_BUYBACK', 'tier': 'SOFT', 'cap': 'TRIM', 'on': leveraged_buyback > 0},
    {'code': 'PLEDGE_GT_25', 'tier': 'SOFT', 'cap': 'TRIM', 'on': pledged_pct_of_promoter > 25 AND pledged_pct_of_promoter <= 50},
    {'code': 'ASM_STAGE_2_PLUS', 'tier': 'SOFT', 'cap': 'HOLD', 'on': asm_stage >= 2},
    {'code': 'OTHER_INCOME_25_50', 'tier': 'WATCH', 'cap': NULL, 'on': other_income_share BETWEEN 0.25 AND 0.50},
    {'code': 'PLEDGE_10_25', 'tier': 'WATCH', 'cap': NULL, 'on': pledged_pct_of_promoter > 10 AND pledged_pct_of_promoter <= 25},
    {'code': 'PROMOTER_SELLING_2_5PP', 'tier': 'WATCH', 'cap': NULL, 'on': promoter_chg_1y > -5 AND promoter_chg_1y <= -2},
    {'code': 'BENEISH_WATCH', 'tier': 'WATCH', 'cap': NULL, 'on': beneish_m > -2.22 AND beneish_m <= -1.78},
    {'code': 'WC_DAYS_UP_20', 'tier': 'WATCH', 'cap': NULL, 'on': wc_days_delta_3y > 20},
    {'code': 'TAX_GAP', 'tier': 'WATCH', 'cap': NULL, 'on': cash_tax_gap > 0.10},
    {'code': 'DEBT_UP_1_TURN', 'tier': 'WATCH', 'cap': NULL, 'on': net_debt_ebitda - net_debt_ebitda_prev > 0 AND net_debt_ebitda - net_debt_ebitda_prev <= 2},
    {'code': 'VALUATION_DISPERSION_GT_50', 'tier': 'WATCH', 'cap': NULL, 'on': val_dispersion > 0.50}
]"""


@query(f"WITH {_wide_sql()} SELECT as_of, symbol, f.code AS code, f.tier AS tier, f.cap AS cap FROM (SELECT as_of, symbol, unnest({_FLAGS_SQL}) AS f FROM w) WHERE f.on")
def flagged_companies(spark, sf_dir) -> DataFrame:
    """The flags of every company on every date."""
    wide = measured_wide(spark, sf_dir)
    return wide.select("as_of", "symbol", F.explode(rating.flags(wide.columns)).alias("f")).select("as_of", "symbol", "f.code", "f.tier", "f.cap")


#: Fixed values, as SQL has them: pillar, component, whose it is, weight, scale, sign, points of a map.
_CATALOGUE = """(VALUES
    ('P1', 'spread_ttm', 'companies', 1, 'map', 1, [[-0.05, 0], [0, 40], [0.05, 65], [0.1, 80], [0.2, 100]]),
    ('P1', 'spread_median_5y', 'companies', 2, 'map', 1, [[-0.05, 0], [0, 40], [0.05, 65], [0.1, 80], [0.2, 100]]),
    ('P1', 'spread_trend_5y', 'companies', 1, 'map', 1, [[-0.03, 0], [0, 50], [0.03, 100]]),
    ('P1', 'roce_median_10y', 'companies', 1, 'pct', 1, NULL),
    ('P1', 'roce_min_10y', 'companies', 1, 'pct', 1, NULL),
    ('P1', 'opm_median_8y', 'companies', 1, 'pct', 1, NULL),
    ('P1', 'opm_cv_8y', 'companies', 1, 'pct', -1, NULL),
    ('P1', 'pricing_power_proxy', 'companies', 1, 'map', 1, [[-0.03, 0], [0, 60], [0.01, 100]]),
    ('P1', 'moat_persistence', 'companies', 1, 'map', 1, [[0, 0], [0.5, 40], [0.8, 75], [1, 100]]),
    ('P1', 'roa_ttm', 'lenders', 1, 'pct', 1, NULL),
    ('P1', 'roe_coe_spread', 'lenders', 2, 'map', 1, [[-0.05, 0], [0, 40], [0.05, 70], [0.1, 100]]),
    ('P1', 'nim_pct', 'lenders', 1, 'pct', 1, NULL),
    ('P1', 'cost_to_income', 'lenders', 1, 'pct', -1, NULL),
    ('P1', 'roe_median_5y', 'lenders', 1, 'pct', 1, NULL),
    ('P2', 'net_debt_ebitda', 'companies', 2, 'map', 1, [[0, 100], [1, 85], [2, 65], [3, 45], [4, 25], [6, 0]]),
    ('P2', 'net_debt_fcf_years', 'companies', 1, 'map', 1, [[0, 100], [3, 70], [6, 40], [10, 0]]),
    ('P2', 'int_cover_ttm', 'companies', 1, 'map', 1, [[1, 0], [2, 30], [4, 60], [8, 85], [15, 100]]),
    ('P2', 'int_cover_min_5y', 'companies', 1, 'map', 1, [[1, 0], [2, 30], [4, 60], [8, 85], [15, 100]]),
    ('P2', 'altman_zpp', 'companies', 1, 'map', 1, [[1.1, 0], [2.6, 80], [5, 100]]),
    ('P2', 'wc_days_delta_3y', 'companies', 1, 'pct', -1, NULL),
    ('P2', 'de_trend_3y', 'companies', 1, 'map', 1, [[-0.2, 100], [0, 60], [0.3, 0]]),
    ('P2', 'debt_equity', 'companies', 1, 'map', 1, [[0, 100], [0.5, 75], [1, 50], [2, 20], [3, 0]]),
    ('P2', 'gnpa_pct', 'lenders', 2, 'map', 1, [[1, 100], [2, 75], [4, 40], [8, 0]]),
    ('P2', 'nnpa_pct', 'lenders', 1, 'map', 1, [[0.5, 100], [1, 75], [2, 40], [4, 0]]),
    ('P2', 'gnpa_trend_4q', 'lenders', 1, 'map', 1, [[-1, 100], [0, 60], [1, 20], [2, 0]]),
    ('P2', 'deposit_vs_advance_growth', 'banks', 1, 'pct', 1, NULL),
    ('P2', 'fin_leverage', 'other lenders', 2, 'map', 1, [[4, 100], [7, 50], [10, 0]]),
    ('P2', 'borrowing_cost', 'other lenders', 1, 'pct', -1, NULL),
    ('P3', 'cfo_to_pat_5y', 'companies', 2, 'map', 1, [[0.5, 0], [0.8, 50], [1, 80], [1.2, 100]]),
    ('P3', 'fcf_conversion_5y', 'companies', 1, 'map', 1, [[0, 0], [0.4, 40], [0.7, 75], [1, 100]]),
    ('P3', 'cfo_to_ebitda_5y', 'companies', 1, 'pct', 1, NULL),
    ('P3', 'accrual_ratio_sloan_abs', 'companies', 2, 'map', 1, [[0.02, 100], [0.05, 60], [0.1, 20], [0.15, 0]]),
    ('P3', 'beneish_level', 'companies', 2, 'map', 1, [[0, 0], [50, 50], [100, 100]]),
    ('P3', 'other_income_share', 'all', 1, 'map', 1, [[0.1, 100], [0.25, 50], [0.5, 0]]),
    ('P3', 'cash_tax_gap', 'all', 1, 'map', 1, [[0, 100], [0.05, 80], [0.1, 40], [0.2, 0]]),
    ('P3', 'capitalisation_proxy', 'companies', 1, 'pct', -1, NULL),
    ('P3', 'receivable_days_delta_3y', 'companies', 1, 'map', 1, [[-10, 100], [0, 70], [20, 30], [40, 0]]),
    ('P3', 'inventory_days_delta_3y', 'companies', 1, 'map', 1, [[-10, 100], [0, 70], [20, 30], [40, 0]]),
    ('P3', 'payable_days_delta_3y', 'companies', 1, 'map', 1, [[-10, 100], [0, 70], [20, 30], [40, 0]]),
    ('P3', 'depreciation_rate_cv_5y', 'companies', 1, 'pct', -1, NULL),
    ('P3', 'reserves_leakage_5y', 'companies', 1, 'map', 1, [[0.05, 100], [0.15, 50], [0.3, 0]]),
    ('P3', 'gnpa_delta_4q_neg', 'lenders', 1, 'map', 1, [[-1, 100], [0, 60], [1, 20], [2, 0]]),
    ('P4', 'reinvestment_rate_5y', 'companies', 1, 'map', 1, [[0, 40], [0.4, 100], [0.8, 100], [1.2, 40], [2, 20]]),
    ('P4', 'incremental_roic_5y', 'companies', 2, 'map', 1, [[0, 0], [0.1, 40], [0.2, 75], [0.3, 100]]),
    ('P4', 'fundamental_growth', 'companies', 1, 'pct', 1, NULL),
    ('P4', 'growth_gap', 'companies', 1, 'map', 1, [[-0.05, 100], [0, 60], [0.05, 30], [0.1, 0]]),
    ('P4', 'sales_cagr_3y', 'all', 1, 'pct', 1, NULL),
    ('P4', 'sales_cagr_5y', 'all', 1, 'pct', 1, NULL),
    ('P4', 'pat_cagr_5y', 'all', 1, 'pct', 1, NULL),
    ('P4', 'eps_cagr_5y', 'all', 1, 'pct', 1, NULL),
    ('P4', 'growth_consistency_5y', 'all', 1, 'map', 1, [[0.4, 20], [0.8, 70], [1, 100]]),
    ('P4', 'sales_yoy_ttm', 'all', 1, 'pct', 1, NULL),
    ('P4', 'pat_yoy_ttm', 'all', 1, 'pct', 1, NULL),
    ('P4', 'bvps_cagr_5y', 'lenders', 1, 'pct', 1, NULL),
    ('P4', 'ppop_growth_3y', 'lenders', 1, 'pct', 1, NULL),
    ('P5', 'capex_return_test', 'companies', 1, 'map', 1, [[0, 0], [0.1, 40], [0.2, 70], [0.3, 100]]),
    ('P5', 'self_funding_5y', 'companies', 1, 'map', 1, [[0, 20], [0.6, 60], [1, 100]]),
    ('P5', 'dilution_5y', 'all', 1, 'map', 1, [[-0.02, 100], [0, 70], [0.05, 0]]),
    ('P5', 'payout_discipline', 'all', 1, 'map', 1, [[0, 0], [50, 50], [100, 100]]),
    ('P5', 'promoter_pct', 'all', 1, 'map', 1, [[10, 20], [20, 40], [35, 70], [50, 100]]),
    ('P5', 'promoter_chg_1y', 'all', 1, 'map', 1, [[-5, 0], [-2, 40], [0, 70], [2, 100]]),
    ('P5', 'promoter_chg_3y', 'all', 1, 'map', 1, [[-10, 0], [-3, 40], [0, 70], [3, 100]]),
    ('P5', 'pledged_pct_of_promoter', 'all', 2, 'map', 1, [[0, 100], [10, 80], [25, 50], [50, 20], [60, 0]]),
    ('P5', 'pledge_delta_4q', 'all', 1, 'map', 1, [[-5, 100], [0, 70], [5, 30], [10, 0]]),
    ('P5', 'insider_net_buy_12m', 'all', 1, 'map', 1, [[-0.005, 20], [0, 60], [0.005, 100]]),
    ('P5', 'inst_chg_1y', 'all', 1, 'pct', 1, NULL),
    ('P5', 'rating_migration_12m', 'all', 1, 'map', 1, [[-3, 0], [-1, 30], [0, 70], [1, 100]]),
    ('P5', 'adverse_events_90d_clean', 'all', 1, 'binary', 1, NULL),
    ('P6', 'pe_band_pos_10y', 'all', 1, 'map', 1, [[0, 100], [0.5, 50], [1, 0]]),
    ('P6', 'ev_ebitda_band_pos', 'companies', 1, 'map', 1, [[0, 100], [0.5, 50], [1, 0]]),
    ('P6', 'earnings_yield', 'all', 1, 'pct', 1, NULL),
    ('P6', 'fcf_yield', 'companies', 1, 'pct', 1, NULL),
    ('P6', 'div_yield', 'all', 1, 'pct', 1, NULL),
    ('P6', 'growth_gap_val', 'companies', 1, 'map', 1, [[-0.05, 100], [0, 60], [0.05, 30], [0.1, 0]]),
    ('P6', 'mos_base', 'all', 2, 'map', 1, [[-0.4, 0], [-0.2, 20], [0, 50], [0.2, 75], [0.5, 100]]),
    ('P6', 'pb_vs_justified', 'lenders', 1, 'map', 1, [[0.5, 100], [1, 50], [1.5, 20], [2, 0]])
) k(pillar, c, whose, wt, kind, sign, pts)"""


def _scored_sql() -> str:
    """Component scores and priors as rows, from the table of the components."""
    pct = lambda by: f"100 * (rank() OVER (PARTITION BY {by}, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0) / count(x) OVER (PARTITION BY {by})"
    return f"""l AS (UNPIVOT (SELECT as_of, symbol, CAST(COLUMNS(* EXCLUDE (as_of, symbol, profile, lender, industry)) AS DOUBLE) FROM w) ON COLUMNS(* EXCLUDE (as_of, symbol)) INTO NAME c VALUE v),
c00 AS (
    SELECT w.as_of, w.symbol, profile, pillar, k.c, wt, kind, sign * v AS x, v, pts, list_filter(range(1, len(pts)), lambda i: v <= pts[i + 1][1])[1] AS i
    FROM w JOIN {_CATALOGUE} ON whose = 'all' OR (whose = 'companies' AND NOT lender) OR (whose = 'lenders' AND lender) OR (whose = 'banks' AND profile = 'BANK') OR (whose = 'other lenders' AND profile = 'NBFC_FIN')
    LEFT JOIN l ON l.as_of = w.as_of AND l.symbol = w.symbol AND l.c = k.c
), c0 AS (
    SELECT as_of, symbol, profile, pillar, c, wt, kind, x, CASE WHEN v IS NULL THEN NULL WHEN kind = 'binary' THEN CASE WHEN v >= 0.5 THEN 100.0 ELSE 0 END WHEN kind = 'pct' THEN NULL WHEN v <= pts[1][1] THEN pts[1][2] WHEN i IS NULL THEN pts[-1][2]
        ELSE pts[i][2] + (v - pts[i][1]) * (pts[i + 1][2] - pts[i][2]) / (pts[i + 1][1] - pts[i][1]) END AS d FROM c00
), c1 AS (SELECT *, median(x) OVER (PARTITION BY as_of, c) AS md FROM c0), c2 AS (SELECT *, median(abs(x - md)) OVER (PARTITION BY as_of, c) * 1.4826 * 3 AS sd FROM c1),
c3 AS (SELECT * EXCLUDE (x), CASE WHEN x IS NOT NULL AND sd > 0 THEN least(greatest(x, md - sd), md + sd) ELSE x END AS x FROM c2),
c4 AS (SELECT *, CASE WHEN kind <> 'pct' THEN d WHEN x IS NULL THEN NULL WHEN count(x) OVER (PARTITION BY as_of, c, profile) >= 8 THEN {pct('as_of, c, profile')} ELSE {pct('as_of, c')} END AS score FROM c3),
c AS (SELECT *, coalesce(CASE WHEN count(score) OVER (PARTITION BY as_of, c, profile) >= 8 THEN median(score) OVER (PARTITION BY as_of, c, profile) END, median(score) OVER (PARTITION BY as_of, c), 50) AS prior FROM c4)"""


#: Weights of the pillars by profile, and what the variants add to them; no_valuation leaves P6 out.
_PILLAR_WEIGHTS = """{'GENERAL': [0.20, 0.15, 0.15, 0.15, 0.10, 0.25], 'BANK': [0.25, 0.25, 0.15, 0.10, 0.10, 0.15], 'NBFC_FIN': [0.20, 0.30, 0.15, 0.10, 0.10, 0.15],
    'IT_SERVICES': [0.25, 0.05, 0.15, 0.20, 0.15, 0.20], 'PHARMA': [0.20, 0.10, 0.20, 0.15, 0.15, 0.20], 'CYCLICAL': [0.15, 0.25, 0.15, 0.10, 0.10, 0.25]}"""
_VARIANT_WEIGHT = """CASE variant WHEN 'quality_tilt' THEN pw + CASE pillar WHEN 'P1' THEN 0.05 WHEN 'P3' THEN 0.05 WHEN 'P6' THEN -0.10 ELSE 0 END
    WHEN 'value_tilt' THEN pw + CASE pillar WHEN 'P6' THEN 0.10 WHEN 'P1' THEN -0.05 WHEN 'P4' THEN -0.05 ELSE 0 END WHEN 'no_valuation' THEN CASE pillar WHEN 'P6' THEN 0 ELSE pw END ELSE pw END"""


def decided_sql(variants: str = "'base'") -> str:
    """Scores, flags, confidence and verdicts before hysteresis (r6) of all companies, dates and the variants listed."""
    return f"""{_wide_sql()}, {_scored_sql()}, p0 AS (SELECT as_of, symbol, profile, pillar, sum(wt * coalesce(score, prior)) / sum(wt) AS s, sum(wt * prior) / sum(wt) AS pr, sum(CASE WHEN score IS NOT NULL THEN wt ELSE 0 END) AS k, sum(wt) AS t FROM c GROUP BY ALL),
p AS (SELECT *, CASE WHEN k / t >= 0.5 THEN s ELSE pr END AS score, k / t >= 0.5 AS ok, map_extract(map {_PILLAR_WEIGHTS}, profile)[1][CAST(pillar[2:2] AS INTEGER)] AS pw FROM p0),
pv AS (SELECT *, {_VARIANT_WEIGHT} AS vw FROM p, (SELECT unnest([{variants}]) AS variant)),
r0 AS (SELECT as_of, symbol, variant, sum(vw * score) / sum(vw) AS S, sum(k) / sum(t) AS cov, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS pcov, max(score) FILTER (WHERE pillar = 'P2') AS p2, max(score) FILTER (WHERE pillar = 'P4') AS p4, bool_and(ok) FILTER (WHERE pillar IN ('P1', 'P6')) AS sound FROM pv GROUP BY ALL),
r1 AS (SELECT *, [f FOR f IN {_FLAGS_SQL} IF f.on] AS fl, len([n FOR n IN [pe_ttm_feat > 200 OR (pe_ttm_feat < 0 AND pat_ttm > 0), abs(pat_cagr_5y) > 1.5, history_days < 240, industry = 'something else'] IF n]) AS nf FROM w JOIN r0 USING (as_of, symbol)),
r2 AS (SELECT *, greatest(0, least(1, (0.45 * cov + 0.15 * pcov + 0.40) * CASE WHEN stmt_age_days <= 120 THEN 1 WHEN stmt_age_days <= 200 THEN 0.85 ELSE 0.70 END * 0.90 * CASE WHEN coalesce(n_models, 0) < 2 OR val_dispersion IS NULL THEN 0.70 WHEN val_dispersion <= 0.25 THEN 1 WHEN val_dispersion <= 0.50 THEN 0.85 ELSE 0.70 END * pow(0.90, nf))) AS dci FROM r1),
r3 AS (SELECT *, CASE WHEN dci >= 0.75 THEN 'HIGH' WHEN dci >= 0.50 THEN 'MED' WHEN dci >= 0.35 THEN 'LOW' ELSE 'NONE' END AS band, NOT (cov < 0.60 OR NOT sound OR coalesce(history_days < 120, false) OR stmt_age_days IS NULL OR stmt_age_days > 400 OR dci < 0.35) AS fit, len([f FOR f IN fl IF f.tier = 'HARD']) AS hard, len([f FOR f IN fl IF f.tier = 'SOFT']) AS soft, len([f FOR f IN fl IF f.tier = 'WATCH']) AS watch,
    coalesce(p4 >= 70, false) AND (coalesce(fundamental_growth >= 0.12 AND growth_gap <= 0, false) OR coalesce(pat_yoy_ttm >= 0.20 AND sales_yoy_ttm >= 0.10, false) OR coalesce(eps_cagr_5y >= 0.15 AND growth_consistency_5y >= 0.8, false)) AS cat FROM r2),
r4 AS (SELECT *, CASE WHEN hard > 0 THEN 'R1' WHEN S < 35 THEN 'R2' WHEN mos_base <= -0.25 THEN 'R3' WHEN S < 50 THEN 'R4' WHEN S >= 80 AND mos_base >= 0.20 AND soft = 0 AND watch = 0 AND band = 'HIGH' THEN 'R5' WHEN S >= 80 AND mos_base >= 0.20 AND soft = 0 AND watch <= 1 AND band IN ('HIGH', 'MED') THEN 'R5B'
    WHEN S >= 70 AND cat AND p2 >= 40 AND soft = 0 AND watch <= 1 AND band IN ('HIGH', 'MED') AND coalesce(mos_base > -0.10, true) THEN 'R6' WHEN S >= 80 AND coalesce(mos_base >= -0.10 AND mos_base < 0.20, true) THEN 'R7' WHEN S < 70 OR coalesce(abs(mos_base) <= 0.10, false) THEN 'R8' ELSE 'R9' END AS rule0 FROM r3),
r5 AS (SELECT *, least(CASE rule0 WHEN 'R1' THEN 0 WHEN 'R2' THEN 0 WHEN 'R3' THEN 1 WHEN 'R4' THEN 1 WHEN 'R5' THEN 4 WHEN 'R5B' THEN 3 WHEN 'R6' THEN 3 ELSE 2 END, coalesce(list_min([CASE f.cap WHEN 'SELL' THEN 0 WHEN 'TRIM' THEN 1 ELSE 2 END FOR f IN fl IF f.tier = 'SOFT']), 5)) AS v0 FROM r4),
r6 AS (SELECT *, CASE WHEN band = 'MED' AND v0 = 4 THEN 3 WHEN band = 'LOW' AND v0 >= 3 THEN v0 - 1 ELSE v0 END AS v,
    coalesce(S >= CASE rule0 WHEN 'R5' THEN 82 WHEN 'R5B' THEN 82 WHEN 'R6' THEN 72 WHEN 'R7' THEN 82 WHEN 'R8' THEN 52 WHEN 'R4' THEN 37 ELSE 0 END AND (rule0 <> 'R5' OR mos_base >= 0.23), false) AS may, row_number() OVER (PARTITION BY symbol, variant, fit ORDER BY as_of) AS turn FROM r5)"""


_WALK = """walk AS (SELECT symbol, turn, v FROM r6 WHERE fit AND turn = 1 UNION ALL SELECT r6.symbol, r6.turn, CASE WHEN r6.v > walk.v AND NOT r6.may THEN walk.v ELSE r6.v END FROM walk JOIN r6 ON r6.symbol = walk.symbol AND r6.turn = walk.turn + 1 AND r6.fit)"""


@query(f"""WITH RECURSIVE {decided_sql()},
{_WALK} SELECT as_of, r6.symbol AS symbol, profile, CASE WHEN fit THEN ['SELL', 'TRIM', 'HOLD', 'SPECULATIVE_BUY', 'CONVICTION_BUY'][walk.v + 1] ELSE 'NO_RATING' END AS verdict, CASE WHEN fit THEN rule0 ELSE 'R0' END AS rule, round(S, 4) AS score, round(cov, 6) AS coverage, round(dci, 6) AS dci, band, len(fl) AS n_flags
FROM r6 LEFT JOIN walk ON walk.symbol = r6.symbol AND walk.turn = r6.turn AND fit""")
def rated_companies(spark, sf_dir) -> DataFrame:
    """The rating of every company on every date, in one job."""
    rows = rating.rated(measured_wide(spark, sf_dir), ["as_of"])
    return rows.select("as_of", "symbol", "profile", "verdict", "rule", R("S", 4).alias("score"), R("component_coverage").alias("coverage"), R("dci").alias("dci"), "band", F.size("flags").alias("n_flags"))


@query(f"WITH {_wide_sql()}, {_scored_sql()} SELECT as_of, symbol, c AS component, round(score, 4) + 0 AS score, round(prior, 4) + 0 AS prior FROM c")
def component_scores(spark, sf_dir) -> DataFrame:
    """The score and the prior of every component of the catalogue, of every company on every date."""
    found = rating.component_scores(measured_wide(spark, sf_dir), ["as_of"], "profile", catalogue(1))
    return found.select("as_of", "symbol", "component", (R("score", 4) + 0.0).alias("score"), (R("prior", 4) + 0.0).alias("prior"))


@query(f"""WITH {_frames_sql()}, {_steps_sql()}, g AS (SELECT as_of, symbol, [{_over("y_net_profit[-1]", "y_total_assets[-1]")} > 0, CASE WHEN NOT lender THEN y_cfo[-1] > 0 END, {_over("y_net_profit[-1]", "y_total_assets[-1]")} > {_over("y_net_profit[-2]", "y_total_assets[-2]")}, CASE WHEN NOT lender THEN y_cfo[-1] > y_net_profit[-1] END,
    CASE WHEN NOT lender THEN {_over("y_borrowings[-1]", "y_total_assets[-1]")} <= {_over("y_borrowings[-2]", "y_total_assets[-2]")} END, y_equity_capital[-1] <= 1.02 * y_equity_capital[-2], {_over("y_sales[-1]", "y_total_assets[-1]")} > {_over("y_sales[-2]", "y_total_assets[-2]")}] AS l FROM s WHERE len(y_net_profit) >= 2)
SELECT as_of, symbol, CAST(len([b FOR b IN l IF b]) AS INTEGER) AS score, CAST(list_aggregate(l, 'count') AS INTEGER) AS known FROM g""")
def piotroski_score(spark, sf_dir) -> DataFrame:
    """Seven signals of two years, of every company that has them."""
    found = frames(spark, sf_dir).select("as_of", "symbol", statements.f_score(lambda n: F.col(f"y_{n}"), F.col("profile").isin("BANK", "NBFC_FIN")).alias("f"))
    return found.where("f is not null").select("as_of", "symbol", "f.score", "f.known")
