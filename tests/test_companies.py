import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kairopanel.operators import acceptance, asof, profiles, rating, selection, statements, valuation
from kairopanel.sources import feeds

D = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=n)


def frame(spark, **changes):
    items = {"sales": 1000, "expenses": 800, "operating_profit": 200, "other_income": 10, "interest": 20, "depreciation": 50, "pbt": 140, "net_profit": 100, "tax_pct": 30, "payout_pct": 40, "equity_capital": 50, "reserves": 450, "borrowings": 200, "other_liabilities": 100, "total_assets": 800, "fixed_assets": 400, "cwip": 100, "investments": 50, "other_assets": 250, "cfo": 120, "cfi": -60, "fcf": 60, "debtor_days": 40, "inventory_days": 30, "payable_days": 20, "roce_pct": 20, "eps": 2, "mcap": 1500, "deposits": 90, "financing_profit": 30, "working_capital_days": 25, "gross_npa_pct": 3, "net_npa_pct": 1}
    row = {"symbol": "a", "profile": "GENERAL", "price": 40.0, "shares": 50.0, "beta": 1.0, "vol_250": 0.3} | {f"{p}_{i}": [float(v)] * 7 for i, v in items.items() for p in "yq"} | {"y_period": [D(366 * k) for k in range(7)], "q_period": [D(90 * k) for k in range(7)]} | changes
    kinds = {str: "string", float: "double", int: "long", type(None): "double"}
    kind = lambda k, v: "array<date>" if k.endswith("_period") else "array<double>" if isinstance(v, list) else kinds[type(v)]
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(k, v)}" for k, v in row.items()))


def values(df, growth=None):
    v = valuation.valued(statements.prepared(df), F.lit(growth).cast("double"))
    r = v.select(*[c.alias(n) for n, c in valuation.valuation_columns().items()]).first().asDict(recursive=True)
    return {n: x["value"] for n, x in r.items()}, {n: x["status"] for n, x in r.items()}


def test_fair_values_of_a_company(spark):
    v, status = values(frame(spark), 0.08)
    ke, d = 0.06 + 0.055, 200 / 2200
    wacc = 2000 / 2200 * ke + d * 0.14 * 0.75
    net = 150.0
    flows = [60 * 1.08**t / (1 + wacc) ** t for t in range(1, 6)] + [60 * 1.08**5 * (1 + 0.08 - 0.03 * k / 5) ** k / (1 + wacc) ** (5 + k) for k in range(1, 6)]
    dcf = (sum(flows) + 60 * 1.08**5 * 1.05**6 / (wacc - 0.05) / (1 + wacc) ** 10 - net) / 50
    assert v["model_dcf_base"] == pytest.approx(dcf) and v["model_dcf_bull"] > dcf > v["model_dcf_bear"]
    multiple = (1500 + 150) / 200
    ebitda, fcf = (multiple * 0.2 * 4000 - net) / 50, 1500 / 60 * 60 / 50
    assert v["model_ev_ebitda"] == pytest.approx(ebitda) and v["model_p_fcf"] == pytest.approx(fcf) and v["own_ev_ebitda_median"] == pytest.approx(multiple)
    models = sorted([(dcf, 0.40), (ebitda, 0.35), (fcf, 0.25)])
    base = next(x for k, (x, _) in enumerate(models) if sum(w for _, w in models[: k + 1]) >= 0.5)
    assert v["fv_base"] == pytest.approx(base) and v["mos_base"] == pytest.approx(base / 40 - 1) and v["n_models"] == 3
    assert v["fv_bull"] == pytest.approx(max(v["model_dcf_bull"], ebitda, fcf)) and v["fv_bear"] == pytest.approx(min(v["model_dcf_bear"], v["model_epv"] or 1e9, ebitda, fcf))
    assert v["val_dispersion"] == pytest.approx((models[2][0] - models[0][0]) / models[1][0])
    pe = 2000 / 400
    assert v["pe_band_pos_10y"] == 0 and v["er_mid"] == pytest.approx(400 / 2000 + 0.08 + 0.15) and v["er_hi"] - v["er_mid"] == pytest.approx(0.3 / 3**0.5) and v["pe_ttm_feat"] == pe
    assert status["model_ddm"] == "NA" and v["growth_gap"] == pytest.approx(v["implied_growth"] - 0.08)


def test_fair_values_of_a_lender_and_of_nothing(spark):
    v, status = values(frame(spark, profile="BANK"))
    ke, roe = 0.115, 400 / 500
    g = min(0.6 * roe, ke - 0.01)
    pb = (roe - g) / (ke - g)
    assert v["justified_pb"] == pytest.approx(pb) and v["model_justified_pb"] == pytest.approx(pb * 500 / 50) and v["model_ddm"] == pytest.approx(8 * 0.4 / (ke - g)) and v["fv_bear"] == pytest.approx(min(v["model_justified_pb"], v["model_ddm"]))
    assert status["model_dcf_base"] == "NA" and v["er_mid"] is None
    none, status = values(frame(spark, **{f"y_{i}": [] for i in ("mcap", "sales", "net_profit", "operating_profit", "fcf", "equity_capital")}, **{f"q_{i}": [] for i in ("sales", "net_profit", "operating_profit")}))
    assert none["fv_base"] is None and status["fv_base"] == "UNKNOWN" and none["n_models"] == 0


def test_metrics_of_filings(spark):
    df = frame(spark, profile="BANK", face_value=10.0, promoter_chg_1y=-3.0, ofs_deals=1, y_equity_capital=[50.0, 50.0, 50.0, 100.0, 103.0, 103.0, 90.0], q_gross_npa_pct=[2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0], net_debt_ebitda=4.0, **{f"x_{i}": 12.0 for i in ("current_assets", "current_liabilities", "cash", "borrowings_current", "cet1", "capital_adequacy_ratio", "gross_npa", "net_npa", "return_on_assets", "advances", "deposits", "provisions")}, x_auditor_opinion="Qualified")
    r = statements.prepared(df).select(*[c.alias(n) for n, c in valuation.filing_columns().items()]).first().asDict(recursive=True)
    v = lambda n: r[n]["value"]
    assert v("gnpa_pct") == 6.0 and v("gnpa_trend_4q") == 2.5 and v("gnpa_delta_4q_neg") == 2.5 and v("cet1_pct") == 12.0 and v("provision_coverage") == 1 and v("kpi_advances") == 12
    assert v("audit_opinion_clean") == 0 and v("ofs_matched") == 1 and v("leveraged_buyback") == 1 and v("su_cfo_5y") == 600 and v("ppop_growth_3y") == pytest.approx(0)
    # the doubled capital, without a fall of the profit, is a bonus issue, and so is what follows, as it is compared with the capital before
    assert v("dilution_5y") == 0.0 and r["current_ratio"]["status"] == "NA" and r["contingent_to_networth"]["status"] == "NA"


def test_growth_of_shares(spark):
    row = spark.createDataFrame([([50.0, 50.0, 51.0, 52.0, 60.0], [1.0] * 5), ([50.0, 80.0, 81.0, None, 82.0], [2.0, 1.0, 1.0, 1.0, 1.0]), ([50.0], [1.0]), ([None, 0.0], [1.0, 1.0])], "c array<double>, p array<double>")
    got = [r[0] for r in row.select(valuation.share_growth(F.col("c"), F.col("p"))).collect()]
    assert got[:2] == [pytest.approx(1.2**0.25 - 1), pytest.approx(1.64 ** (1 / 3) - 1)] and got[2:] == [None, None]


def test_profiles_and_catalogue(spark):
    rows = spark.createDataFrame([("Banks", False), ("Finance", True), ("Power", True), (None, False), (None, True), ("Insurance", False), ("no such", False)], "industry string, deposits boolean")
    got = [(r["p"]["profile"], r["p"]["notes"]) for r in rows.select(profiles.profile_of(F.col("industry"), F.col("deposits")).alias("p")).collect()]
    assert got == [("BANK", []), ("BANK", []), ("GENERAL", ["deposits_outside_financial_industry", "regulated"]), ("GENERAL", ["profile_unmapped"]), ("BANK", []), ("NBFC_FIN", ["insurance_metrics_partial"]), ("GENERAL", ["profile_unmapped"])]
    assert sum(map(len, profiles.INDUSTRIES.values())) == 73 and len({c["name"] for c in profiles.COMPONENTS}) == len(profiles.COMPONENTS) and not any(c["qualitative"] for c in profiles.catalogue(3))
    for c in profiles.COMPONENTS:
        assert [x for x, _ in c.get("points", [])] == sorted(x for x, _ in c.get("points", []))


def test_rating_needs_data(spark):
    names = [(f"n{k}", "GENERAL", float(k), 0.3, 300.0, 50.0, 10.0 + k) for k in range(12)]
    df = spark.createDataFrame(names, "symbol string, profile string, spread_ttm double, mos_base double, history_days double, stmt_age_days double, price double").withColumn("as_of", F.lit(D(0))).withColumn("notes", F.array().cast("array<string>"))
    rows = rating.rated(df, ["as_of"]).collect()
    assert all(r["verdict"] == "NO_RATING" and r["rule"] == "R0" and "component_coverage" in r["errors"] for r in rows) and len({r["manifest_sha"] for r in rows}) == 12
    full = df.select("as_of", "symbol", "profile", "notes", "history_days", "stmt_age_days", "price", *[F.lit(0.5).alias(c["name"]) if c["kind"] != "pct" else F.col("spread_ttm").alias(c["name"]) for c in profiles.catalogue(1)], F.lit(0.1).alias("val_dispersion"), F.lit(3).alias("n_models"))
    rated = rating.rated(full, ["as_of"])
    assert rated.where("status = 'RATED'").count() == 12 and {r["of"] for r in rating.summary(rated).collect()} == {"verdict", "band", "profile"}
    worst = rating.drivers(rating.component_scores(full, ["as_of"], "profile", profiles.catalogue(1)), ["as_of"], 2)
    assert worst.groupBy("symbol", "side").count().where("count <> 2").count() == 0


def test_eligible_and_short_scores(spark):
    rows = [(0, f"n{k}", "x" if k < 9 else None, float(k), -0.01 if k % 2 else -0.2, float(k), None if k == 3 else float(k), 2e7, 50.0, 300, 2, 0, 0, 0, 1.0) for k in range(10)]
    df = spark.createDataFrame(rows, "as_of int, symbol string, industry string, mom_1 double, dist_52w_high double, vol_ratio_20_120 double, deliv_ratio double, turnover_med120 double, close double, history_days int, buckets_known int, in_gsm int, in_asm int, in_fo_ban int, pat_ttm double")
    out = {(r["symbol"], r["variant"]): r["score"] for r in selection.short_scores(df, ["as_of"]).collect()}
    assert len(out) == 30 and out["n3", "base"] is None and out["n7", "base"] > out["n1", "base"]
    assert df.where(selection.eligible()).count() == 10 and df.withColumn("pat_ttm", F.lit(None).cast("double")).where(selection.eligible()).count() == 0 and df.withColumn("in_asm", F.lit(1)).where(selection.eligible()).count() == 0


def test_answers_of_feeds(spark):
    odd = ["no json", '"no data"', "{}", None, "[]", '[{"symbol": " A ", "exDate": "05-Jan-2024", "faceVal": "1,000"}, {"symbol": "B", "exDate": "-"}, "x"]']
    bodies = spark.createDataFrame([(b,) for b in odd], "body string")
    assert [(r["symbol"], r["ex_date"], r["face_value"], r["subject"]) for r in feeds.corporate_actions(bodies).collect()] == [("A", dt.date(2024, 1, 5), 1000.0, "")]
    filed = json.dumps([{"symbol": "A", "params": "01-Jan-202431-Mar-2024Q", "filingDate": "02-May-2024 10:00", "xbrl": "-"}, {"symbol": "A", "toDate": "31-Mar-2024", "broadCastDate": "01-May-2024 10:00:00", "xbrl": "u"}])
    out = feeds.results(spark.createDataFrame([(filed,)], "body string")).collect()
    assert [(r["period_end"], r["consolidated"], r["filed"], r["url"]) for r in out] == [(dt.date(2024, 3, 31), "Unknown", dt.datetime(2024, 5, 1, 10), "u")]
    facts = spark.createDataFrame([("f", 2, "auditor_opinion", "A modified opinion"), ("f", 1, "auditor_opinion", "Unmodified"), ("f", 3, "auditor_name", "X & Co"), ("g", 1, "auditor_opinion", "Adverse"), ("h", 1, "auditor_opinion", "see note")], "filing string, place int, item string, raw string")
    assert sorted((r["filing"], r["auditor_name"], r["modified"]) for r in feeds.auditor(facts).collect()) == [("f", "X & Co", False), ("g", None, True), ("h", None, None)]


def test_facts_known_by_intervals(spark):
    facts = spark.createDataFrame([("a", "standalone", 1.0, D(10)), ("a", "consolidated", 2.0, D(10)), ("a", "standalone", 3.0, D(20)), ("a", "consolidated", 4.0, D(30)), ("b", "standalone", 5.0, D(25))], "symbol string, basis string, value double, visible_from date")
    dates = spark.createDataFrame([(D(n),) for n in (5, 10, 22, 40)], "as_of date")
    out = asof.known_at(facts, dates, ["symbol"], [F.when(F.col("basis") == "consolidated", 0).otherwise(1)])
    assert sorted((r["as_of"], r["symbol"], r["value"]) for r in out.collect()) == [(D(10), "a", 2.0), (D(22), "a", 2.0), (D(40), "a", 4.0), (D(40), "b", 5.0)]
    calendar = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (29, 30, 31)] + [(dt.date(2024, 2, 1),)], "trade_date date")
    assert [r["is_month_end"] for r in asof.month_end_sessions(calendar).orderBy("trade_date").collect()] == [False, False, True, None]
    closed = asof.closed_days(F.lit(dt.date(2024, 1, 26)), F.lit(dt.date(2024, 1, 31)), calendar)
    assert sorted((r["day"].day, r["kind"]) for r in closed.collect()) == [(26, "holiday"), (27, "weekend"), (28, "weekend")]
    assert asof.last_sessions(calendar.withColumn("x", F.lit(1)), F.lit(dt.date(2024, 1, 31)), 2).count() == 2


def test_claims_and_acceptance(spark):
    rows = spark.createDataFrame([("VALIDATED", False, False, 1), ("VALIDATED", False, False, 0), ("VALIDATED", False, True, 1), ("VALIDATED", True, True, 0), ("NOT VALIDATED", False, True, 0), (None, None, None, 0)], "v string, f boolean, p boolean, n int")
    got = [r[0] for r in rows.select(acceptance.claim_state(F.col("v"), F.col("f"), F.col("p"), F.col("n"))).collect()]
    assert got == ["PROVISIONAL", "BACKTEST_PASS", "PROSPECTIVE_VALIDATED", "DIAGNOSTIC", "DIAGNOSTIC", "DIAGNOSTIC"]
    ledger = spark.createDataFrame([("s", D(31 * k), "hit", 0.1 + k * 0.0, 0.0) for k in range(12)] + [("t", D(31 * k), "miss", -0.1, 0.0) for k in range(12)] + [("u", D(0), "hit", 0.1, 0.0)] * 12 + [("s", D(0), "pending", None, None)], "sleeve string, as_of date, status string, fwd double, bench double")
    assert {r["sleeve"]: r["proven"] for r in acceptance.proven(ledger, ["sleeve"], least=12).collect()} == {"s": True, "t": False, "u": False}
    good = {b[1]: 1.0 for b in acceptance.CALIBRATION} | {"hit_sell": 0.6, "brier": 0.2, "score_coverage_corr": -0.05, "sector_max_share_conviction": 0.3, "sector_ls_positive_profiles": 4.0, "monthly_transition": 0.1, "dsr_p": 0.01, "long_short_t": 3.0, "ic_t": 3.0, "mos_ic_t": 2.0}
    df = spark.createDataFrame([(1, *good.values()), (2, *(v if k != "ic_mean" else None for k, v in good.items()))], "k int, " + ", ".join(f"{k} double" for k in good))
    out = {r["k"]: (r["verdict"], r["n_pass"], r["n_unknown"]) for r in acceptance.verdicts(acceptance.checked(df, ["k"], acceptance.CALIBRATION), ["k"]).collect()}
    assert out == {1: ("VALIDATED", 23, 0), 2: ("NOT VALIDATED", 22, 1)}
    assert spark.range(1).select(acceptance.tiers_in_order([F.lit(3), F.lit(2), F.lit(1)])).first()[0]
