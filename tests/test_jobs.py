import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairopanel.operators import asof, builds, digest, filings, ownership, rolling

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_slices_are_made_once_resumed_and_replaced(spark, tmp_path):
    schema = StructType.fromDDL("as_of date, symbol string, x double, never double")
    dates = spark.createDataFrame([(D(k),) for k in range(4)], "as_of date")
    made = []

    def make(todo, shift=0.0):
        made.append(sorted(r["as_of"] for r in todo.collect()))
        return todo.select("as_of", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("symbol"), (F.dayofmonth("as_of") + F.lit(shift)).alias("x"), F.lit("left out").alias("more"))

    path = str(tmp_path / "table")
    builds.build_slices(make, dates.limit(0).union(dates.where("day(as_of) <= 2")), path, schema)
    full = builds.build_slices(make, dates, path, schema)
    assert made == [[D(0), D(1)], [D(2), D(3)]] and full.columns == ["as_of", "symbol", "x", "never"]
    assert sorted((r["as_of"], r["symbol"], r["x"], r["never"]) for r in full.collect()) == [(D(k), s, k + 1.0, None) for k in range(4) for s in "ab"]
    again = builds.build_slices(make, dates, path, schema)
    assert made[-1] == [] and again.count() == 8
    # a slice that is made again replaces its own rows alone
    new = builds.build_slices(lambda t: make(t, 10.0), dates.where("day(as_of) = 2"), path, schema, resume=False)
    assert sorted((r["as_of"], r["x"]) for r in new.collect()) == [(D(k), k + 1.0 + 10 * (k == 1)) for k in range(4) for _ in "ab"]


def test_columns_are_aligned(spark):
    df = spark.createDataFrame([(1, float("inf"), float("nan"), 2.5)], "k int, a double, b double, c double")
    out = builds.aligned(df, StructType.fromDDL("c double, k long, a double, b double, d string"))
    assert out.dtypes == [("c", "double"), ("k", "bigint"), ("a", "double"), ("b", "double"), ("d", "string")] and tuple(out.first()) == (2.5, 1, None, None, None)


def test_ranks_follow_the_gate_and_the_caps(spark):
    rows = [(D(30 * d), s, "i", 0.2, float(10 - k if d == 0 else (k if d == 1 else 10 - k)), True) for d in range(3) for k, s in enumerate("abcdef")]
    features = spark.createDataFrame(rows + [(D(0), "z", "i", 0.2, 99.0, False)], "as_of date, symbol string, industry string, vol_60 double, z double, fit boolean")
    gate = spark.createDataFrame([(D(0), "RISK_ON", 1.0), (D(30), "RISK_OFF", 0.4), (D(60), "NEUTRAL", 0.7)], "as_of date, regime string, exposure double")
    out = builds.rank_table(features.withColumn("z2", F.col("z")), "L", "base", {"z": 1.0, "z2": 1.0}, n=2, gate=gate, fit="fit")
    held = {}
    for r in out.collect():
        if r["held"]:
            held.setdefault(r["as_of"], set()).add(r["symbol"])
        assert (r["weight"] > 0) == r["held"] and r["universe_size"] == 6
    # on the second date the order is turned round: nobody held stays and no one new may enter
    assert held == {D(0): {"a", "b"}, D(60): {"a", "b"}}
    assert {r["rank"] for r in out.where("as_of = date'2020-01-01'").collect()} == set(range(1, 7)) and out.where("symbol = 'z'").count() == 0


def test_running_sums_equal_windows(spark):
    rng = random.Random(4)
    rows, gone = [], lambda: rng.random() < 0.1
    for s, n in (("a", 400), ("b", 300), ("c", 5)):
        price = 100.0
        for k in range(n):
            price *= 1 + rng.gauss(0, 0.02)
            known = not gone()
            rows.append((s, D(k), k + 1, price if known else None, price * 1.01 if known else None, price * 0.98 if known else None, float(rng.randint(1, 99)) if known else None, float(rng.choice([0, 5000, 80000])) if known else None, 50.0 * (1 + 0.1 * rng.random()) if not gone() else None, rng.random() if known else None))
    panel = spark.createDataFrame(rows, "symbol string, trade_date date, session_no int, close double, high double, low double, volume double, turnover double, index double, dp double")
    dates = spark.createDataFrame([(D(k),) for k in (3, 29, 130, 260, 299, 399)], "as_of date")
    found = {(r["symbol"], r["as_of"]): r.asDict() for r in rolling.sampled_features(panel, dates, benchmark="index", delivery="dp").collect()}
    w = rolling.frame("symbol", "session_no", 251)
    plain = rolling.price_features(panel, benchmark="index").withColumn("dd_250", rolling.drawdown_in(F.collect_list("close").over(w)))
    plain = plain.withColumn("deliv_pct_20", F.avg("dp").over(rolling.frame("symbol", "session_no", 20))).withColumn("lrs", F.collect_list(F.when(F.col("log_return").isNotNull(), F.struct("log_return", "bench_return"))).over(rolling.frame("symbol", "session_no", 250)))
    some = plain.join(dates, F.col("trade_date") == F.col("as_of")).where("close is not null").collect()
    assert len(found) == len(some) > 10
    for r in some:
        mine = found[r["symbol"], r["as_of"]]
        for c in ("history_days", "mom_12_1", "mom_6_1", "mom_1", "vol_60", "vol_250", "dist_52w_high", "dma50_ratio", "dma200_ratio", "atr14_pct", "adv20", "turnover_med120", "vol_ratio_20_120", "amihud_60", "beta_250", "dd_250", "deliv_pct_20"):
            assert mine[c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-7, abs=1e-9)), (c, r["symbol"], r["as_of"])
        beta = r["beta_250"] or 0.0
        left = [x["log_return"] - beta * (x["bench_return"] or 0.0) for x in r["lrs"]]
        if mine["idio_vol_250"] is not None:
            m = sum(left) / len(left)
            assert mine["idio_vol_250"] == pytest.approx((sum((x - m) ** 2 for x in left) / (len(left) - 1) * 252) ** 0.5, rel=1e-6)


def test_a_ring_of_quarters_against_all_facts(spark):
    rng = random.Random(6)
    facts, dates = [], [D(50 * k) for k in range(40)]
    for s in "abc":
        for q in range(20):
            for h in ("promoters", "fii", "dii"):
                if rng.random() < 0.9:
                    facts.append((s, D(91 * q), h, float(rng.randint(1, 60)), D(91 * q + rng.choice([20, 45, 300]))))
    df = spark.createDataFrame(facts, "symbol string, period_end date, holder string, pct double, visible_from date")
    found = {(r["as_of"], r["symbol"]): tuple(r)[2:] for r in ownership.holder_changes(df, spark.createDataFrame([(d,) for d in dates], "as_of date")).collect()}
    expected = {}
    for d in dates:
        for s in "abc":
            periods = {}
            for x, p, h, v, seen in facts:
                if x == s and seen <= d:
                    periods.setdefault(p, {})[h] = v
            if periods:
                last = sorted(periods)[::-1]
                p = lambda k: periods[last[k]].get("promoters") if k < len(last) else None
                i = lambda k: periods[last[k]]["fii"] + periods[last[k]]["dii"] if k < len(last) and {"fii", "dii"} <= set(periods[last[k]]) else None
                minus = lambda a, b: None if a is None or b is None else a - b
                expected[d, s] = (p(0), minus(p(0), p(4)), minus(p(0), p(12)), i(0), minus(i(0), i(4)))
    assert found == expected and len(found) > 100


def filed(spark, *rows):
    full = [(path, "s", "standalone", dt.datetime(2024, 1, day), word, tag, D(0), D(90), "Q", "", "INR", value, None) for path, day, word, tag, value in rows]
    return spark.createDataFrame(full, "path string, symbol string, basis string, filed_at timestamp, rounding string, tag string, period_start date, period_end date, kind string, dims string, unit string, value double, text string")


def test_scales_by_agreement(spark):
    sales = spark.createDataFrame([("s", D(90), "pl_q", "sales", 120.0), ("s", D(90), "pl_a", "sales", 100.0)], "symbol string, period_end date, stmt string, line_item string, value double")
    facts = filed(spark, ("right", 1, "Lakhs", "RevenueFromOperations", 10500.0), ("right", 1, "Lakhs", "OtherIncome", 50.0), ("wrong", 1, "Crores", "RevenueFromOperations", 1.05e9), ("hopeless", 1, "Crores", "RevenueFromOperations", 7.0), ("odd", 1, None, "RevenueFromOperations", 9900.0))
    out = {(r["path"], r["item"]): (r["scale"], r["scale_inferred"], r["value"]) for r in filings.scaled(filings.named(facts), sales).collect()}
    assert out == {("right", "revenue"): (0.01, False, 105.0), ("right", "other_income"): (0.01, False, 0.5), ("wrong", "revenue"): (1e-7, True, pytest.approx(105.0)), ("hopeless", "revenue"): (1.0, False, 7.0), ("odd", "revenue"): (0.01, False, 99.0)}


def test_bank_items_in_banks_only(spark):
    facts = filed(spark, ("bank", 1, "Crores", "Advances", 5.0), ("bank", 1, "Crores", "Provisions", 1.0), ("company", 1, "Crores", "Provisions", 2.0), ("company", 1, "Crores", "NoSuchTag", 2.0))
    assert {(r["path"], r["tag"]): r["item"] for r in filings.named(facts).collect()} == {("bank", "Advances"): "advances", ("bank", "Provisions"): "provisions", ("company", "Provisions"): None, ("company", "NoSuchTag"): None}


def test_loads_keep_the_first_and_log_the_later(spark, tmp_path):
    none = spark.createDataFrame([], "symbol string, period_end date, stmt string, line_item string, value double")
    ready = lambda *rows: filings.scaled(filings.named(filed(spark, *rows)), none)
    one = ready(("one", 5, "Crores", "RevenueFromOperations", 10.0), ("one", 5, "Crores", "OtherIncome", 1.0), ("early", 2, "Crores", "OtherIncome", 1.5))
    two = ready(("two", 9, "Crores", "RevenueFromOperations", 11.0), ("two", 9, "Crores", "OtherIncome", 1.5 * (1 + 1e-12)), ("two", 9, "Crores", "TotalIncome", 3.0))
    for batch in (one, two, one, two):
        filings.load_filings(batch, str(tmp_path))
    facts = {r["tag"]: (r["value"], r["path"]) for r in filings.loaded(spark, str(tmp_path), "facts").collect()}
    assert facts == {"RevenueFromOperations": (10.0, "one"), "OtherIncome": (1.5, "early"), "TotalIncome": (3.0, "two")}
    revisions = sorted((r["tag"], r["value"], r["path"]) for r in filings.loaded(spark, str(tmp_path), "revisions").collect())
    assert revisions == [("OtherIncome", 1.0, "one"), ("RevenueFromOperations", 11.0, "two")]
    rows = {r["path"]: (r["facts"], r["revised"], r["period_end"]) for r in filings.loaded(spark, str(tmp_path), "filings").collect()}
    assert rows == {"one": (2, True, D(90)), "early": (1, False, D(90)), "two": (3, True, D(90))}


def test_digests(spark):
    r = spark.createDataFrame([(D(0), "a", "HOLD"), (D(0), "b", "SELL"), (D(30), "a", "SELL"), (D(30), "b", "SELL"), (D(30), "c", "HOLD"), (D(60), "b", "CONVICTION_BUY")], "as_of date, symbol string, verdict string")
    assert sorted(map(tuple, digest.verdict_changes(r).collect())) == [(D(30), "a", "HOLD", "SELL", "down"), (D(60), "b", "SELL", "CONVICTION_BUY", "up")]
    ranks = spark.createDataFrame([("L", D(0), "a", 0.5), ("L", D(0), "b", 0.5), ("L", D(30), "b", 0.5), ("L", D(30), "c", 0.5), ("L", D(30), "d", 0.0)], "sleeve string, as_of date, symbol string, weight double")
    assert {r["as_of"]: (r["entered"], r["left"]) for r in digest.entries(ranks).collect()} == {D(0): (["a", "b"], []), D(30): (["c"], ["a"])}
    f = spark.createDataFrame([("a", D(30), "x"), ("b", D(30), "y"), ("b", D(28), "z"), ("d", D(30), "w")], "symbol string, filed_on date, title string")
    assert {(r["symbol"], r["title"], r["as_of"]) for r in digest.filings_of_held(f, ranks).collect()} == {("b", "y", D(30))}
    page = digest.pages(r.where("as_of = date'2020-01-01'"), {"history": (r, "as_of", 1)}).where("symbol = 'a'").first()
    assert [tuple(x) for x in page["history"]] == [(D(30), "SELL")]


def test_items_known_of_the_newest_period(spark):
    f = spark.createDataFrame(
        [("s", "Q", D(0), "revenue", "standalone", "", 1.0, D(40)), ("s", "Q", D(0), "revenue", "consolidated", "", 2.0, D(50)), ("s", "Q", D(91), "revenue", "standalone", "", 3.0, D(130)), ("s", "Q", D(91), "pat", "standalone", "", 4.0, D(150)), ("s", "Q", D(0), "pat", "standalone", "Segment=A", 9.0, D(40))],
        "symbol string, kind string, period_end date, item string, basis string, dims string, value double, visible_from date",
    )
    on = spark.createDataFrame([(D(k),) for k in (30, 45, 60, 140, 160)], "as_of date")
    found = sorted((r["as_of"], r["period_end"], r["revenue"], r["pat"]) for r in ownership.canonical_facts(f, on, ["revenue", "pat"]).collect())
    assert found == [(D(45), D(0), 1.0, None), (D(60), D(0), 2.0, None), (D(140), D(91), 3.0, None), (D(160), D(91), 3.0, 4.0)]
    assert asof.known_at(f.where("item = 'revenue'"), on, ["symbol"], [-F.unix_date("period_end")]).where(F.col("as_of") == F.lit(D(160))).first()["value"] == 3.0
