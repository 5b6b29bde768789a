import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairopanel.operators import calibration, ledger, quantiles, rating, walkforward
from kairopanel.plans import roles

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(("accuracy", "direct"), [(20, 0), (2000, 0), (2000, 50_000)])
def test_quantiles_are_exact(spark, accuracy, direct):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=3000), 2: np.repeat([1.0, 2.0, 2.0, 5.0], 400), 3: np.array([7.0]), 4: rng.integers(0, 9, 777) / 1.0, 5: np.array([])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None), (5, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: (r["q"], r["n"]) for r in quantiles.group_quantiles(df, ["g"], "x", fractions, accuracy=accuracy, direct=direct).collect()}
    assert set(found) == {1, 2, 3, 4}
    for g, (q, n) in found.items():
        assert n == len(groups[g]) and q == pytest.approx([float(np.quantile(groups[g], f)) for f in fractions], abs=1e-12)
    every = quantiles.group_quantiles(df, [], "x", [0.5], accuracy=accuracy, direct=direct).first()
    assert every["q"][0] == pytest.approx(float(np.median(np.concatenate(list(groups.values())))))


def history(spark, score=lambda v, k, d: k, years=(2016, 2017, 2018, 2019), names=40):
    """Months of names whose excess rises with their number; variants differ by their scores."""
    rows = []
    for y in years:
        for m in range(1, 13):
            for v in ("a", "b"):
                for k in range(names):
                    s = float(score(v, k, (y, m)))
                    verdict = ["SELL", "TRIM", "HOLD", "SPECULATIVE_BUY", "CONVICTION_BUY"][min(4, int(5 * k / names))]
                    e = (k - names / 2) / names + 0.01 * m
                    rows.append((dt.date(y, m, 28), v, k, ["GENERAL", "BANK", "PHARMA"][k % 3], "RATED", s, verdict, k / names, "HIGH" if k % 2 else "LOW", 0.5 + (k * 7 % 11) / 100, ["SOLVENCY_BREACH"] if k < 2 else [], e, 0.0, e, e, dt.date(y + 1, m, 28)))
    return spark.createDataFrame(rows, "as_of date, variant string, symbol int, profile string, status string, score double, verdict string, mos double, band string, coverage double, hard array<string>, fwd double, bench double, excess double, excess_long double, matured_on date")


def test_folds_learn_from_what_had_matured(spark):
    # variant b is right until 2017 and wrong from 2018 on; a year's returns mature a year later
    rows = history(spark, lambda v, k, d: k if (v == "b") == (d[0] < 2018) else -k)
    found = {r["fold"]: r for r in calibration.folds(rows, ["a", "b"], [2017, 2018, 2019], "2019-01-01").collect()}
    # no return had matured when 2017 began; 2018 knows those of 2016 alone; the holdout those of 2016 and 2017; 2019 lies in the holdout
    assert set(found) == {"2018", "holdout"}
    assert found["2018"]["selected"] == "b" and found["2018"]["n_train"] == 2 * 12 * 40 and found["2018"]["train_ic"] == pytest.approx(1.0) and found["2018"]["n_test"] == 2 * 12 * 40
    assert found["holdout"]["selected"] == "b" and found["holdout"]["n_train"] == 2 * 24 * 40 and found["holdout"]["test_from"] == dt.date(2019, 1, 1)
    met = calibration.stitched(rows, calibration.folds(rows, ["a", "b"], [2017, 2018, 2019], "2019-01-01"), "2019-01-01")
    assert {(r["fold"], r["variant"], r["as_of"].year) for r in met.collect()} == {("2018", "b", 2018), ("holdout", "b", 2019)}


def test_ties_go_to_the_first_variant_and_nothing_gives_nothing(spark):
    rows = history(spark, lambda v, k, d: k)
    assert {r["selected"] for r in calibration.folds(rows, ["b", "a"], [2018], "2019-01-01").collect()} == {"b"}
    assert calibration.folds(rows.limit(0), ["a"], [2018], "2019-01-01").count() == 0


def test_statistics_of_a_planted_history(spark):
    rows = history(spark).where("variant = 'a'")
    tests, held = rows.where("year(as_of) < 2019"), rows.where("year(as_of) = 2019")
    s = calibration.statistics(tests, held, trials=3).first().asDict()
    assert s["decile_monotonic_overall"] and s["decile_monotonic_years_share"] == 1.0 and s["tiers_ordered"] and s["ic_mean"] == pytest.approx(1.0) and s["mos_ic_mean"] == pytest.approx(1.0)
    top, low = np.mean([(k - 20) / 40 for k in range(24, 40)]), np.mean([(k - 20) / 40 for k in range(16)])
    assert s["long_short_pp"] == pytest.approx(top - low) and s["holdout_long_short"] == pytest.approx(top - low) and s["hit_conviction_buy"] == 1.0 and s["hit_all_buy"] == 1.0
    assert s["hit_sell"] == 1.0 and s["hard_flag_precision"] == 1.0 and s["brier"] < 0.05 < s["brier"] + s["brier_gain_vs_climatology"]
    assert s["sector_ls_positive_profiles"] == 3 and s["monthly_transition"] == 0.0 and s["min_tier_share"] == pytest.approx(0.2) and s["n_obs"] == 36 * 40 and s["n_dates"] == 36
    assert s["sector_max_share_conviction"] == pytest.approx(3 / 8) and s["dci_informative"] is None  # 20 names a band are too few for a correlation
    few = calibration.statistics(tests.limit(0), held.limit(0), trials=1).first().asDict()
    assert few["ic_mean"] is None and few["tiers_ordered"] is None and few["brier"] is None and few["n_obs"] == 0


def test_deflated_probability(spark):
    rng = random.Random(2)
    x = [rng.gauss(0.01, 0.05) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in x], "s double")
    m, sd, n = np.mean(x), np.std(x, ddof=1), len(x)
    sr = m / sd
    skew, kurt = np.mean((np.array(x) - m) ** 3) / np.std(x) ** 3, np.mean((np.array(x) - m) ** 4) / np.std(x) ** 4
    from statistics import NormalDist

    g, N = 0.5772156649015329, NormalDist()
    sr0 = abs(sr) / 2 * ((1 - g) * N.inv_cdf(1 - 1 / 3) + g * N.inv_cdf(1 - 1 / (3 * math.e)))
    z = (sr - sr0) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    assert calibration.deflated_p(df, "s", 3).first()["dsr_p"] == pytest.approx(1 - N.cdf(z))
    assert calibration.deflated_p(df.limit(9), "s", 3).first()["dsr_p"] is None


def calendar_of(spark, n):
    return spark.createDataFrame([(D(k), k + 1) for k in range(n)], "trade_date date, session_no int")


def test_returns_of_several_horizons(spark):
    panel = spark.createDataFrame([("a", D(k), 100.0 + k) for k in range(60)] + [("b", D(k), 50.0) for k in range(15)], "symbol string, trade_date date, close double")
    dates = spark.createDataFrame([(D(5),), (D(40),)], "as_of date")
    out = {(r["symbol"], r["as_of"]): r for r in calibration.returns_ahead(panel, dates, calendar_of(spark, 60), {"near": 10, "far": 30}, delisted=True).collect()}
    a = out["a", D(5)]
    assert a["near"] == pytest.approx(115 / 105 - 1) and a["far"] == pytest.approx(135 / 105 - 1) and a["matured_on"] == D(15) and a["far_on"] == D(35) and not a["far_delisted"]
    b = out["b", D(5)]
    assert b["near"] == 0.0 and not b["near_delisted"] and b["far"] == pytest.approx(-0.01) and b["far_delisted"]
    assert out["a", D(40)]["near"] == pytest.approx(150 / 140 - 1) and out["a", D(40)]["far"] is None and ("b", D(40)) not in out


def test_ledger_says_things_once_and_matures_by_horizon(spark):
    said = lambda *rows: spark.createDataFrame([("r1", s, d, "base", st, v, 50.0, 0.5, 0.1) for s, d, st, v in rows], "engine string, symbol string, as_of date, variant string, status string, verdict string, score double, dci double, mos double")
    one = said(("a", D(1), "RATED", "HOLD"), ("b", D(1), "RATED", "SELL"), ("c", D(1), "NO_RATING", "NO_RATING"))
    book = ledger.publish(one, None, [10, 30])
    assert book.count() == 4 and {r["verdict_before"] for r in book.collect()} == {None}
    assert ledger.publish(one, book, [10, 30]).count() == 0
    two = said(("a", D(1), "RATED", "SELL"), ("a", D(5), "RATED", "CONVICTION_BUY"), ("d", D(5), "RATED", "TRIM"))
    fresh = ledger.publish(two, book, [10, 30])
    assert {(r["symbol"], r["as_of"], r["verdict_before"]) for r in fresh.collect()} == {("a", D(5), "HOLD"), ("d", D(5), None)}
    book = book.unionByName(fresh)
    panel = spark.createDataFrame([("a", D(k), 100.0 + k) for k in range(40)] + [("b", D(k), 10.0) for k in range(40)] + [("d", D(k), 10.0) for k in range(8)], "symbol string, trade_date date, close double")
    index = spark.createDataFrame([(D(k), 100.0 + 0.5 * k) for k in range(40)], "trade_date date, close double")
    first = ledger.mature(book, panel, index, calendar_of(spark, 40), [10, 30], today=str(D(12)))
    assert {(r["symbol"], r["as_of"], r["horizon"]): r["outcome"] for r in first.collect() if r["outcome"] != "pending"} == {("a", D(1), 10): "hit", ("b", D(1), 10): "miss"}
    done = {(r["symbol"], r["as_of"], r["horizon"]): r for r in ledger.mature(first, panel, index, calendar_of(spark, 40), [10, 30]).collect()}
    assert {k: r["outcome"] for k, r in done.items() if k[0] == "a"} == {("a", D(1), 10): "hit", ("a", D(1), 30): "hit", ("a", D(5), 10): "hit", ("a", D(5), 30): "hit"}
    gone = done["d", D(5), 30]
    assert gone["outcome"] == "delisted" and gone["fwd"] == pytest.approx(-0.01) and gone["excess"] == pytest.approx(-0.01 - (117.5 / 102.5 - 1)) and done["a", D(1), 30]["matured_on"] == D(31)
    # prices that change later change nothing that has matured
    again = ledger.mature(spark.createDataFrame(list(done.values()), first.schema), panel.withColumn("close", F.lit(1.0)), index, calendar_of(spark, 40), [10, 30])
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, done.values()), key=repr)
    assert ledger.report(first, least=3).count() == 0
    assert {(r["horizon"], r["verdict"], r["n"], r["quotable"]) for r in ledger.report(first, least=2, least_tier=1).collect()} == {(10, "HOLD", 1, True), (10, "SELL", 1, True)}


def test_walk_forward_purges_and_holds_out(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=k) for k in range(5 * 365) if (dt.date(2015, 1, 1) + dt.timedelta(days=k)).weekday() < 5]
    good = {"a": lambda d: d.year < 2017, "b": lambda d: d.year >= 2017}
    rows = [(v, d, float(rng.normal(0.002 if up(d) else -0.002, 0.001))) for v, up in good.items() for d in days]
    rets = spark.createDataFrame(rows, "variant string, day date, ret double")
    each = walkforward.fold_table(spark, "2015-01-01", [2017, 2018, 2019], "2019-01-01", 30)
    assert [r["fold"] for r in each.orderBy("test_from").collect()] == ["2017", "2018", "holdout"]
    chosen = walkforward.chosen_variants(rets, each, "variant", "day", "ret")
    assert {r["fold"]: r["selected"] for r in chosen.collect()}["2017"] == "a"
    path = walkforward.stitched_path(rets, chosen, "variant", "day", "ret", purge=21).collect()
    by_fold = {f: sorted(r["day"] for r in path if r["fold"] == f) for f in ("2017", "2018", "holdout")}
    for f, first in (("2017", dt.date(2017, 1, 1)), ("2018", dt.date(2018, 1, 1)), ("holdout", dt.date(2019, 1, 1))):
        own = [d for d in days if d >= first and (f == "holdout" or d.year == first.year)]
        assert by_fold[f] == own[21:]
    ret = {(r["variant"], r["day"]): r["ret"] for r in path}
    assert all(ret[v, d] == x for v, d, x in rows if (v, d) in ret)
    bench = rets.groupBy("day").agg(F.avg("ret").alias("bench"))
    judged = walkforward.judged(walkforward.stitched_path(rets, chosen, "variant", "day", "ret"), bench, ["fold"], "day", "ret").where("fold = '2017'").first()
    x = np.array([r["ret"] for r in path if r["fold"] == "2017"])
    assert judged["n"] == len(x) and judged["sharpe"] == pytest.approx((x - 0.06 / 252).mean() / x.std(ddof=1) * 252**0.5) and judged["cagr"] == pytest.approx(np.exp(np.log1p(x).sum() * 252 / len(x)) - 1)
    assert walkforward.chosen_variants(rets, each, "variant", "day", "ret", least_train=10**6).count() == 0


def test_sound_and_unsound_banks(spark):
    rows = spark.createDataFrame([("sound", True, 2.0, 13.0), ("thin", True, 2.0, 7.5), ("bad", True, 11.0, 13.0), ("unknown", True, None, None), ("company", False, 11.0, 7.0)], "symbol string, financial boolean, gnpa_pct double, cet1_pct double")
    found = {r["symbol"]: [f["code"] for f in r["f"]] for r in rows.select("symbol", rating.flags(rows.columns).alias("f")).collect()}
    assert found == {"sound": [], "thin": ["CAPITAL_BREACH_BANK"], "bad": ["CAPITAL_BREACH_BANK"], "unknown": [], "company": []}


def test_lines_meet_by_supplier_before_they_are_summed(spark):
    plan = roles.supplier_months(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_suppkey") == 1
    below = plan.split("hashpartitioning(l_suppkey")[1].split("l_returnflag")[0]
    assert "Aggregate" in plan and "Aggregate" not in below
