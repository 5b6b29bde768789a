import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kairopanel.operators import adjust, readers

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_a_slice_of_one_index(spark):
    rows = spark.createDataFrame([(D(k), n, float(k)) for k in (3, 1, 2, 5) for n in ("x", "y")], "trade_date date, index_name string, close double")
    assert [(r["trade_date"], r["close"]) for r in readers.index_series(rows, "x", str(D(2)), str(D(3))).collect()] == [(D(2), 2.0), (D(3), 3.0)]
    assert readers.index_series(rows, "z").count() == 0 and readers.index_series(rows, "y").count() == 4


def test_lists_joined_and_compared(spark):
    a, b, c = (spark.createDataFrame([(s,) for s in names], "symbol string") for names in ("abb", "bc", "bd"))
    assert sorted(r[0] for r in readers.excluded([a, b, c]).collect()) == list("abcd") and [r[0] for r in readers.in_all([a, b, c]).collect()] == ["b"]


def test_the_configuration_in_force(spark):
    runs = spark.createDataFrame([("L", D(1), "VALIDATED", "L-N20-base-T1cr"), ("L", D(5), "FORCED", "L-N99-base-T1cr"), ("L", D(3), "NOT VALIDATED", "L-N30-momentum_tilt-T3cr"), ("S", D(1), "VALIDATED", "what?")], "sleeve string, created_at date, verdict string, selected string")
    assert sorted(map(tuple, readers.validated_configuration(runs).collect())) == [("L", "NOT VALIDATED", 30, "momentum_tilt", 3e7), ("S", "VALIDATED", None, None, None)]


def test_states_of_evidence(spark):
    rows = spark.createDataFrame([(1, D(0), 3), (2, D(-60), 3), (3, D(0), None), (4, None, None)], "k int, latest date, rank int")
    found = rows.select("k", readers.evidence_status(F.col("latest"), F.lit(D(10)), F.col("rank")).alias("s"), readers.rank_percentile(F.col("rank"), F.lit(4)).alias("p")).collect()
    assert {r["k"]: (r["s"], r["p"]) for r in found} == {1: ("OK", 0.25), 2: ("STALE", 0.25), 3: ("UNKNOWN", None), 4: ("UNKNOWN", None)}


def test_features_of_statements(spark):
    ends = [dt.date(2020 + k // 4, 3 * (k % 4) + 3, 30) for k in range(12)]
    rows = [("a", e, 100.0 + 10 * k, 20.0 + k, 10.0 + k, 5.0, 4000.0, None) for k, e in enumerate(ends)] + [("bank", e, 100.0, 20.0, 10.0, 5.0, 0.0, 7.0) for e in ends[:4]] + [("gap", e, 1.0, 1.0, 1.0, 1.0, 1.0, None) for e in (ends[0], ends[1], ends[4], ends[8])]
    q = spark.createDataFrame(rows, "symbol string, period_end date, sales double, operating_profit double, net_profit double, fcf double, mcap double, deposits double")
    found = {(r["symbol"], r["period_end"]): r for r in readers.statement_features(q).collect()}
    a = found["a", ends[11]]
    sales, before = sum(100 + 10 * k for k in range(8, 12)), sum(100 + 10 * k for k in range(4, 8))
    opm = lambda s: sum(20 + k for k in s) / sum(100 + 10 * k for k in s)
    assert a["sales_ttm"] == sales and a["sales_yoy_ttm"] == pytest.approx(sales / before - 1) and a["opm_chg_1y"] == pytest.approx(opm(range(8, 12)) - opm(range(4, 8)))
    assert a["fcf_ttm"] == 20.0 and a["ps"] == pytest.approx(4000 / sales) and a["earnings_yield"] == pytest.approx(sum(10 + k for k in range(8, 12)) / 4000)
    assert found["a", ends[2]]["sales_ttm"] is None and found["a", ends[6]]["sales_yoy_ttm"] is None
    bank = found["bank", ends[3]]
    assert bank["sales_ttm"] == 400.0 and bank["fcf_ttm"] is None and bank["ps"] is None and bank["earnings_yield"] is None
    assert found["gap", ends[8]]["sales_ttm"] is None  # four quarters, but not of one year


def test_one_series_is_adjusted_once(spark):
    prices = spark.createDataFrame([("a", D(0), "BE", 50.0), ("a", D(0), "EQ", 100.0), ("a", D(1), "ZZ", 7.0), ("a", D(1), "BE", 60.0), ("a", D(2), "ZZ", 8.0), ("a", D(2), "AA", 9.0)], "symbol string, trade_date date, series string, close double")
    factors = spark.createDataFrame([("a", D(1), 0.5), ("a", D(2), 0.2)], "symbol string, ex_date date, factor double")
    found = {r["trade_date"]: (r["series"], r["close"]) for r in adjust.adjusted_series(prices, factors).collect()}
    assert found == {D(0): ("EQ", pytest.approx(10.0)), D(1): ("BE", pytest.approx(12.0)), D(2): ("AA", 9.0)}


def test_the_logarithm_of_very_many_factors(spark):
    prices = spark.createDataFrame([("a", D(k), "EQ", 100.0, 7.0) for k in range(400)], "symbol string, trade_date date, series string, close double, volume double")
    factors = spark.createDataFrame([("a", D(k), 0.1) for k in range(400)], "symbol string, ex_date date, factor double")
    for found in (adjust.adjusted(prices, factors), adjust.adjusted_series(prices, factors)):
        by = {r["trade_date"]: r for r in found.collect()}
        assert by[D(0)]["log_adj"] == pytest.approx(399 * math.log(0.1)) and (by[D(0)]["close"], by[D(0)]["volume"]) == (0.0, math.inf)
        assert by[D(397)]["close"] == pytest.approx(1.0) and by[D(397)]["volume"] == pytest.approx(700.0) and by[D(399)]["adj"] == 1.0


def test_a_consolidation_without_volumes_before_it(spark):
    up = [("a", D(k), 100.0 if k < 2 else 200.0, 100.0 if k < 2 else 200.0, 10.0) for k in range(8)]
    down = [("b", D(k), 100.0 if k < 2 else 50.0, 100.0 if k < 2 else 50.0, 10.0) for k in range(8)]
    tape = spark.createDataFrame(up + down, "symbol string, trade_date date, open double, close double, volume double")
    found = adjust.gap_candidates(tape, spark.createDataFrame([], "symbol string, ex_date date")).collect()
    assert [(r["symbol"], r["ex_date"], r["factor"]) for r in found] == [("a", D(2), 2.0)]
