import datetime as dt

from kairopanel.operators import ownership

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def dates(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "as_of date")


def test_holders_by_what_was_visible(spark):
    rows = [("a", D(91 * k), h, p + k * (1 if h == "promoters" else 0), D(91 * k + 21)) for k in range(6) for h, p in (("promoters", 40.0), ("fii", 10.0), ("dii", 5.0))]
    h = spark.createDataFrame(rows, "symbol string, period_end date, holder string, pct double, visible_from date")
    out = {r["as_of"]: r for r in ownership.holder_changes(h, dates(spark, D(470), D(480))).collect()}
    assert out[D(470)]["promoter_pct"] == 44.0 and out[D(480)]["promoter_pct"] == 45.0 and out[D(480)]["promoter_chg_1y"] == 4.0 and out[D(480)]["promoter_chg_3y"] is None and out[D(480)]["inst_chg_1y"] == 0


def test_events(spark):
    on = dates(spark, D(400))
    p = spark.createDataFrame([("a", D(10), 5.0), ("a", D(300), 20.0), ("a", D(500), 90.0)], "symbol string, period_end date, pledged_pct double")
    r = ownership.pledges(p, on).first()
    assert (r["pledged_pct_of_promoter"], r["pledge_delta_4q"]) == (20.0, 15.0)
    t = spark.createDataFrame([("a", D(390), "Buy", 10.0), ("a", D(380), "SELL", 4.0), ("a", D(1), "BUY", 99.0)], "symbol string, trade_date date, side string, value double")
    assert ownership.insider_net_buy(t, on, spark.createDataFrame([(D(400), "a", 100.0)], "as_of date, symbol string, mcap double")).first()["insider_net_buy_12m"] == 0.06
    a = spark.createDataFrame([("a", D(390), "Penalty imposed", "by SEBI Order"), ("b", D(390), "Board meeting", None), ("c", D(10), "Fraud", ""), ("d", D(401), "x", ""), ("e", D(310), "NCLT", "")], "symbol string, ann_dt date, subject string, details string")
    assert {r["symbol"]: r["adverse_events_90d_clean"] for r in ownership.adverse_events(a, on).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0, "e": 0.0}
    m = spark.createDataFrame([("a", D(200), -1, "Stable"), ("a", D(300), -1, "Negative")], "symbol string, action_date date, notches int, outlook string")
    assert tuple(ownership.rating_migration(m, on).first())[2:] == (-2, True)


def test_face_values_and_mcaps(spark):
    today = spark.createDataFrame([("a", 2.0), ("b", 10.0)], "symbol string, face_value double")
    splits = spark.createDataFrame([("a", D(100), 0.2)], "symbol string, ex_date date, factor double")
    faces = ownership.face_values(splits, today)
    assert sorted((r["symbol"], r["face_value"]) for r in faces.collect()) == [("a", 2.0), ("a", 10.0), ("b", 10.0)]
    periods = spark.createDataFrame([("a", D(50), 100.0), ("a", D(150), 100.0), ("b", D(90), 50.0)], "symbol string, period_end date, equity_capital double")
    closes = spark.createDataFrame([("a", D(48), 500.0), ("a", D(150), 100.0), ("b", D(10), 7.0)], "symbol string, trade_date date, close double")
    out = {(r["symbol"], r["period_end"]): r["mcap"] for r in ownership.historical_mcaps(periods, closes, faces).collect()}
    assert out == {("a", D(50)): 5000.0, ("a", D(150)): 5000.0, ("b", D(90)): None}


def test_canonical_facts_and_restamping(spark):
    f = spark.createDataFrame([("a", "FY", D(0), "sales", 1.0, "standalone", "", D(5)), ("a", "FY", D(0), "sales", 2.0, "consolidated", "", D(6)), ("a", "FY", D(0), "debt", 3.0, "standalone", "", D(5)), ("a", "FY", D(-365), "sales", 9.0, "consolidated", "", D(-300))], "symbol string, kind string, period_end date, item string, value double, basis string, dims string, visible_from date")
    r = ownership.canonical_facts(f, dates(spark, D(10)), ["sales", "debt"]).first()
    assert (r["sales"], r["debt"], r["period_end"]) == (2.0, 3.0, D(0))
    moved = ownership.restamped(f.where("item = 'debt'"), spark.createDataFrame([("a", D(0), dt.datetime(2024, 1, 4, 9)), ("a", D(0), dt.datetime(2024, 1, 9))], "symbol string, period_end date, filed timestamp")).first()
    assert moved["visible_from"] == D(3) and moved["changed"]
    prices = spark.createDataFrame([("a", D(0), "BE", 1.0), ("a", D(0), "EQ", 2.0), ("b", D(0), "SM", 3.0)], "symbol string, trade_date date, series string, close double")
    assert sorted(r["close"] for r in ownership.one_series(prices).collect()) == [2.0, 3.0]


def test_a_face_value_before_very_many_splits(spark):
    splits = spark.createDataFrame([("a", D(k), 0.1) for k in range(400)], "symbol string, ex_date date, factor double")
    faces = {r["to_date"]: r["face_value"] for r in ownership.face_values(splits, spark.createDataFrame([("a", 1.0)], "symbol string, face_value double")).collect()}
    assert len(faces) == 401 and faces[D(-1)] == float("inf") and abs(faces[D(397)] / 100 - 1) < 1e-9 and faces[None] == 1.0
