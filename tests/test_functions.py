import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kairopanel.functions import scalars as S


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [("1,234.5", 1234.5), ("-", None), ("NA", None), ("", None), (" -.34", -0.34), (None, None)])
def test_lenient_number(spark, text, value):
    assert one(spark, S.lenient_number(F.col("t")), t=text) == value


def test_texts(spark):
    assert one(spark, S.first_number(F.col("t")), t="about -1,200.5 units") == -1200.5
    assert one(spark, S.slug(F.col("t")), t="Net Profit + (A & B) %") == "net_profit_a_and_b_pct"
    assert str(one(spark, S.month_end_of_label(F.col("t")), t="Feb 2024")) == "2024-02-29" and one(spark, S.month_end_of_label(F.col("t")), t="TTM") is None
    assert [one(spark, S.stage_number(F.col("t")), t=t) for t in ("LT-ASM Stage II", "Stage 1", "GSM 3", "none", "ESM - III (x)", "gsm  4", "ASM 4", "Stage XX")] == [2, 1, 3, 0, 3, 4, 0, 0]
    assert one(spark, S.stage_number(F.col("t").cast("string")), t=None) == 0
    assert [one(spark, S.announcement_kind(F.col("t")), t=t) for t in ("Outcome of Board Meeting", "Earnings Call Transcript of audited results", "Analyst meet: presentation", "Annual Report", "CREDIT RATING", "Pledge of shares", "Insider Trading", "dividend")] == ["results", "transcript", "presentation", "annual_report", "rating", "pledge", "insider", "other"]
    assert one(spark, S.announcement_kind(F.lit(None).cast("string"), F.col("t")), t="the annual report") == "annual_report"
    assert one(spark, S.clean_html(F.col("t")), t="<p>a &amp;amp; b</p><script>x<y</script>  c") == "a &amp; b c"
    assert one(spark, S.canonical_url(F.col("t")), t="https://a.example/x?utm_source=q&b=2&UTM_id=1&c=3#top") == "https://a.example/x?b=2&c=3"
    assert one(spark, S.host_allowed(F.col("t"), ["b.example"]), t="https://a.b.example/x") and not one(spark, S.host_allowed(F.col("t"), ["b.example"]), t="https://ab.example/")
    assert one(spark, S.placeholder_to_null(F.col("t")), t="https://x/-") is None
    assert one(spark, S.excerpt(F.col("t"), 3), t="abcdef") == "abc [...]"


@pytest.mark.parametrize("subject,kind,factor", [("Bonus 1:1", "bonus", 0.5), ("Bonus 3:2", "bonus", 0.4), ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share", "split", 0.2), ("Consolidation From Re 1/- To Rs 10/-", "consolidation", 10.0), ("Dividend - Rs 5", None, None), ("Rights 1:4", None, None), ("Split from 10 to 2", "split", 0.2), ("Split From Rs 2 To Rs 10", None, None), ("Sub-Division of Re.1/- into ₹ 0.5", "split", 0.5), ("Consolidation from Rs 10 to Rs 1", None, None), ("Bonus 0:1 and split of Rs 10/- to Re 1/-", "split", 0.1)])
def test_action_factor(spark, subject, kind, factor):
    got = one(spark, S.action_factor(F.col("t")), t=subject)
    assert (got and (got["kind"], got["factor"])) == (kind and (kind, pytest.approx(factor)))


def test_numbers(spark):
    points = [(0.0, 0), (0.5, 40), (1.0, 100)]
    assert [one(spark, S.piecewise(F.col("x"), points), x=x) for x in (-1.0, 0.25, 0.75, 2.0)] == [0, 20, 70, 100]
    assert [one(spark, S.half_even_int(F.col("x")), x=x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, S.nearest_ratio(F.col("x"), [0.5, 0.2]), x=0.47)["ratio"] == 0.5
    assert one(spark, S.weighted_mean([(F.col("x"), 0.3), (F.lit(None).cast("double"), 0.5), (F.lit(4.0), 0.1)], 2), x=2.0) == pytest.approx(2.5)
    pairs = F.array(*[F.struct(F.lit(v).cast("double").alias("value"), F.lit(w).alias("weight")) for v, w in ((5, 0.2), (1, 0.3), (None, 9.0), (3, 0.5))])
    assert one(spark, S.weighted_median(pairs)) == 3
    value = one(spark, S.two_stage_value(F.lit(100.0), F.lit(0.1), F.lit(0.12), F.lit(0.05)))
    flows = [100 * 1.1**t / 1.12**t for t in range(1, 6)]
    base = 100 * 1.1**5
    for t in range(1, 6):
        last = base * (1 + 0.1 + (0.05 - 0.1) * t / 5) ** t
        flows.append(last / 1.12 ** (5 + t))
    assert value == pytest.approx(sum(flows) + last * 1.05 / 0.07 / 1.12**10)
    steady = sum((1.1 / 1.12) ** n for n in range(1, 11)) * 100 + 100 * (1.1 / 1.12) ** 10 * 1.05 / 0.07
    assert one(spark, S.implied_growth(F.lit(steady), F.lit(100.0), F.lit(0.12), F.lit(0.05))) == pytest.approx(0.1, abs=1e-6)
    assert one(spark, S.implied_growth(F.lit(1e9), F.lit(100.0), F.lit(0.12), F.lit(0.05))) == pytest.approx(0.12, abs=1e-6)
    assert one(spark, S.implied_growth(F.lit(1.0), F.lit(100.0), F.lit(0.12), F.lit(0.05))) is None and one(spark, S.implied_growth(F.lit(-1.0), F.lit(100.0), F.lit(0.12), F.lit(0.05))) is None
    assert one(spark, S.earnings_power(F.lit(12.0), F.lit(0.1))) == pytest.approx(120) and one(spark, S.dividend_value(F.lit(5.0), F.lit(0.12), F.lit(0.02))) == pytest.approx(50)
    assert one(spark, S.justified_pb(F.lit(0.2), F.lit(0.12), F.lit(0.05))) == pytest.approx(0.15 / 0.07) and one(spark, S.justified_pb(F.lit(0.2), F.lit(0.05), F.lit(0.05))) is None
    runs = one(spark, S.day_ranges(F.lit(dt.date(2023, 12, 15)), F.lit(dt.date(2024, 2, 10))))
    assert [(r["first"], r["last"]) for r in runs] == [(dt.date(2023, 12, 15), dt.date(2024, 1, 14)), (dt.date(2024, 1, 15), dt.date(2024, 2, 10))] and one(spark, S.day_ranges(F.lit(dt.date(2024, 1, 2)), F.lit(dt.date(2024, 1, 1)))) is None
    assert one(spark, S.gates_of_tier(F.col("t"), "HARD"), t='[{"code": "a", "tier": "HARD"}, {"tier": "SOFT"}]') == 1 and one(spark, S.gates_of_tier(F.col("t"), "HARD"), t="no json") == 0
    assert one(spark, S.two_stage_value(F.lit(100.0), F.lit(0.1), F.lit(0.04), F.lit(0.05))) is None and not math.isnan(value)


def test_timestamps_are_parsed_once(spark):
    texts = ["01-APR-2019", "01-Apr-2019 10:11", "01-Apr-2019 10:11:12", "2019-04-01", " 2019-04-01 10:11:12 ", "01-04-2019", "01/04/2019", "1-Apr-2019", "01-Apr-2019 10", "2019-04-01 10:11", "01/Apr/2019", "31-04-2019", "-", "", None]
    read = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.any_timestamp(F.col("t")).cast("string").alias("v"))
    day, minute, second = "2019-04-01 00:00:00", "2019-04-01 10:11:00", "2019-04-01 10:11:12"
    assert [r["v"] for r in read.orderBy("k").collect()] == [day, minute, second, day, second, day, day] + [None] * 8
    plan = read._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "coalesce" not in plan and plan.count("gettimestamp") <= 4  # no text goes from format to format
