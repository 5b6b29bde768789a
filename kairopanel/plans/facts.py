"""Queries on dated facts, statements, ratings, writes, quality, text, edges and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, edges, evidence, quality, rating, statements
from ..sources import documents as pages_source
from ..sources import sinks
from ..streaming import jobs
from . import roles
from .registry import query

R = lambda x, n=6: F.round(x, n)


def year_ends(spark, sf_dir) -> DataFrame:
    d = roles.statements(spark, sf_dir).select("period_end").distinct()
    return d.where("month(period_end) = 12").select(F.date_add("period_end", 90).alias("as_of"))


DATES = f"{roles.STATEMENTS}, dates AS (SELECT DISTINCT period_end + 90 AS as_of FROM statements WHERE month(period_end) = 12)"


def basis_first():
    return F.when(F.col("basis") == "consolidated", 0).otherwise(1)


@query(f"""WITH {DATES} SELECT as_of, symbol, period_end, line_item, basis, round(value, 4) AS value FROM dates JOIN statements ON visible_from <= as_of AND period_end > as_of - 500
QUALIFY row_number() OVER (PARTITION BY as_of, symbol, period_end, line_item ORDER BY CASE WHEN basis = 'consolidated' THEN 0 ELSE 1 END, visible_from DESC) = 1""")
def statements_known_at(spark, sf_dir) -> DataFrame:
    facts = roles.statements(spark, sf_dir)
    found = asof.known_at(facts, year_ends(spark, sf_dir), ["symbol", "period_end", "line_item"], [basis_first()])
    return found.where("period_end > date_sub(as_of, 500)").select("as_of", "symbol", "period_end", "line_item", "basis", R("value", 4).alias("value"))


@query(f"""WITH {roles.STATEMENTS}, f AS (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY symbol, period_end, line_item ORDER BY basis) = 1), w AS (
    SELECT symbol, period_end, {", ".join(f"max(value) FILTER (WHERE line_item = '{i}') AS {i}" for _, i, _ in roles.ITEMS)} FROM f GROUP BY ALL), t AS (
    SELECT symbol, period_end, {", ".join(f"CASE WHEN count(*) OVER w4 = 4 AND count({i}) OVER w4 = 4 AND date_diff('day', min(period_end) OVER w4, period_end) <= 300 THEN sum({i}) OVER w4 END AS {i}_ttm" for i in ("sales", "net_profit", "operating_profit"))}
    FROM w WINDOW w4 AS (PARTITION BY symbol ORDER BY period_end ROWS 3 PRECEDING))
SELECT symbol, period_end, round(sales_ttm, 4) AS sales_ttm, round(net_profit_ttm, 4) AS net_profit_ttm, round(operating_profit_ttm / nullif(sales_ttm, 0), 6) AS opm_ttm, round(sales_ttm / nullif(lag(sales_ttm, 4) OVER (PARTITION BY symbol ORDER BY period_end), 0) - 1, 6) AS sales_yoy FROM t""")
def trailing_sums(spark, sf_dir) -> DataFrame:
    one = asof.keep_first(roles.statements(spark, sf_dir), ["symbol", "period_end", "line_item"], ["basis"])
    flat = statements.wide(one, ["symbol", "period_end"], [i for _, i, _ in roles.ITEMS])
    t = statements.trailing(flat, ["sales", "net_profit", "operating_profit"], ["symbol"])
    before = F.lag("sales_ttm", 4).over(Window.partitionBy("symbol").orderBy("period_end"))
    return t.select("symbol", "period_end", R("sales_ttm", 4).alias("sales_ttm"), R("net_profit_ttm", 4).alias("net_profit_ttm"), R(F.try_divide("operating_profit_ttm", F.nullif("sales_ttm", F.lit(0.0)))).alias("opm_ttm"), R(F.try_divide(F.col("sales_ttm"), before) - 1).alias("sales_yoy"))


@query(f"""WITH {roles.STATEMENTS}, y AS (SELECT symbol, year(period_end) AS y, {", ".join(f"sum(value) FILTER (WHERE line_item = '{i}') AS {i}" for _, i, _ in roles.ITEMS)} FROM statements GROUP BY ALL), h AS (
    SELECT *, operating_profit / sales AS opm, operating_profit / interest AS cover, lag(sales, 3) OVER w AS s3, row_number() OVER (PARTITION BY symbol ORDER BY y DESC) AS k, row_number() OVER w AS n FROM y WINDOW w AS (PARTITION BY symbol ORDER BY y))
SELECT symbol, round(max(CASE WHEN k = 1 THEN pow(sales / s3, 1.0 / 3) - 1 END), 4) AS sales_cagr_3y, round(median(opm) FILTER (WHERE k <= 8), 6) AS opm_median_8y, round(stddev_samp(opm) FILTER (WHERE k <= 8) / abs(avg(opm) FILTER (WHERE k <= 8)), 6) AS opm_cv_8y,
    round(min(cover) FILTER (WHERE k <= 5), 6) AS int_cover_min_5y, round(CASE WHEN count(operating_profit) FILTER (WHERE k <= 5) = 5 AND count(net_profit) FILTER (WHERE k <= 5) = 5 THEN sum(operating_profit) FILTER (WHERE k <= 5) / sum(net_profit) FILTER (WHERE k <= 5) END, 6) AS op_to_pat_5y, round(regr_slope(opm, n) FILTER (WHERE k <= 5), 6) AS opm_trend_5y FROM h GROUP BY symbol""")
def history_metrics(spark, sf_dir) -> DataFrame:
    facts = roles.statements(spark, sf_dir).groupBy("symbol", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end"), "line_item").agg(F.sum("value").alias("value"))
    h = statements.histories(facts, ["symbol"], [i for _, i, _ in roles.ITEMS], "y", 10)
    y = lambda n: F.col(f"y_{n}")
    opm = statements.each(lambda a, b: a / b, y("operating_profit"), y("sales"))
    cover = statements.each(lambda a, b: a / b, y("operating_profit"), y("interest"))
    growth = F.pow(statements.at(y("sales"), 1) / statements.at(y("sales"), 4), 1 / 3) - 1
    return h.select(
        "symbol", R(growth, 4).alias("sales_cagr_3y"), R(statements.median(statements.last(opm, 8))).alias("opm_median_8y"), R(statements.deviation(statements.last(opm, 8), True) / F.abs(statements.mean(statements.last(opm, 8)))).alias("opm_cv_8y"),
        R(F.array_min(statements.last(cover, 5))).alias("int_cover_min_5y"), R(statements.total(y("operating_profit"), 5) / statements.total(y("net_profit"), 5)).alias("op_to_pat_5y"), R(statements.slope(statements.last(opm, 5))).alias("opm_trend_5y"),
    )


@query(f"""WITH {roles.TAPE}, b AS (SELECT DISTINCT p_brand AS symbol FROM part), reqs AS (SELECT o_orderkey, 'Brand#' || CAST(1 + o_custkey % 5 AS VARCHAR) || CAST(1 + o_orderkey % 5 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, r.symbol, d, CASE WHEN date_diff('day', trade_date, d) <= 10 THEN round(close, 6) END AS close FROM reqs r ASOF LEFT JOIN tape t ON r.symbol = t.symbol AND r.d >= t.trade_date""")
def asof_close(spark, sf_dir) -> DataFrame:
    orders = roles.table(spark, sf_dir, "orders")
    symbol = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 5).cast("string"), (1 + F.col("o_orderkey") % 5).cast("string"))
    wanted = orders.select("o_orderkey", symbol.alias("symbol"), F.to_date("o_orderdate").alias("d"))
    prices = roles.tape(spark, sf_dir).select("symbol", "trade_date", R("close").alias("close"))
    return asof.asof_join(wanted, prices, ["symbol"], "d", "trade_date", ["close"], tolerance_days=10).select("o_orderkey", "symbol", "d", "close")


@query(f"WITH {roles.TAPE} SELECT a.trade_date, b.trade_date AS ahead FROM calendar a LEFT JOIN calendar b ON b.session_no = a.session_no + 21")
def session_ahead(spark, sf_dir) -> DataFrame:
    return asof.session_ahead(asof.sessions(roles.tape(spark, sf_dir)), 21)


SNAP = """snaps AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS snap, o_custkey AS symbol, max(o_totalprice) AS top FROM orders GROUP BY ALL), dates AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of FROM orders)"""


def snapshots(spark, sf_dir) -> DataFrame:
    orders = roles.table(spark, sf_dir, "orders")
    return orders.groupBy(F.last_day(F.to_date("o_orderdate")).alias("snap"), F.col("o_custkey").alias("symbol")).agg(F.max("o_totalprice").alias("top"))


@query(f"WITH {SNAP}, l AS (SELECT as_of, max(snap) AS snap FROM dates JOIN (SELECT DISTINCT snap FROM snaps) ON snap <= as_of GROUP BY as_of) SELECT as_of, snap, symbol, top FROM l JOIN snaps USING (snap)")
def latest_snapshot(spark, sf_dir) -> DataFrame:
    dates = roles.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "quarter").alias("as_of")).distinct()
    return asof.latest_snapshot(snapshots(spark, sf_dir), dates, "snap").select("as_of", "snap", "symbol", "top")


@query(f"""WITH {SNAP}, d AS (SELECT snap, lag(snap) OVER (ORDER BY snap) AS before FROM (SELECT DISTINCT snap FROM snaps)) SELECT s.snap, s.symbol, s.top, p.top AS previous_top FROM snaps s JOIN d USING (snap) LEFT JOIN snaps p ON p.snap = d.before AND p.symbol = s.symbol""")
def previous_states(spark, sf_dir) -> DataFrame:
    return asof.previous_state(snapshots(spark, sf_dir), ["symbol"], "top", "snap").select("snap", "symbol", "top", "previous_top")


@query(f"""WITH {SNAP}, d AS (SELECT snap, lead(snap) OVER (ORDER BY snap) AS next FROM (SELECT DISTINCT snap FROM snaps)), n AS (SELECT next AS snap, symbol FROM snaps JOIN d USING (snap) WHERE next IS NOT NULL)
SELECT snap, symbol, 'in' AS change FROM (SELECT snap, symbol FROM snaps WHERE snap > (SELECT min(snap) FROM snaps) EXCEPT SELECT snap, symbol FROM n) UNION ALL SELECT snap, symbol, 'out' FROM (SELECT * FROM n EXCEPT SELECT snap, symbol FROM snaps)""")
def entries_and_exits(spark, sf_dir) -> DataFrame:
    s = snapshots(spark, sf_dir).select("snap", "symbol")
    days = s.select("snap").distinct().withColumn("next", F.lead("snap").over(Window.orderBy("snap")))
    old = s.join(F.broadcast(days), "snap").where("next is not null").select(F.col("next").alias("snap"), "symbol")
    new = s.join(F.broadcast(days.where("next is not null").select(F.col("next").alias("snap"))), "snap")
    return new.join(old, ["snap", "symbol"], "left_anti").withColumn("change", F.lit("in")).unionByName(old.join(s, ["snap", "symbol"], "left_anti").withColumn("change", F.lit("out")))


@query(f"""WITH {roles.SUPPLIER_MONTHS} SELECT a.as_of, a.symbol, b.symbol AS peer, row_number() OVER (PARTITION BY a.as_of, a.symbol ORDER BY b.turnover DESC, b.symbol) AS place FROM supplier_months a JOIN supplier_months b ON a.as_of = b.as_of AND a.industry = b.industry AND a.symbol <> b.symbol
QUALIFY place <= 8""")
def largest_peers(spark, sf_dir) -> DataFrame:
    """Of every name the eight largest of its group: nine a group are ranked once, not all pairs."""
    rows = roles.supplier_months(spark, sf_dir).select("as_of", "symbol", "industry", "turnover")
    top = asof.keep_first(rows, ["as_of", "industry"], [F.desc("turnover"), "symbol"], 9).select("as_of", "industry", F.col("symbol").alias("peer"), "turnover")
    met = rows.drop("turnover").join(top, ["as_of", "industry"]).where("symbol <> peer")
    place = F.row_number().over(Window.partitionBy("as_of", "symbol").orderBy(F.desc("turnover"), "peer"))
    return met.withColumn("place", place).where("place <= 8").select("as_of", "symbol", "peer", "place")


@query("""WITH s AS (SELECT *, 100 * percent_rank() OVER (ORDER BY p_retailprice, p_partkey) AS s, (p_size - 20) / 40.0 AS mos FROM part) SELECT p_partkey, round(s, 4) AS s, round(CASE WHEN mos <= -0.4 THEN 0 WHEN mos <= -0.2 THEN (mos + 0.4) * 100 WHEN mos <= 0 THEN 20 + (mos + 0.2) * 150 WHEN mos <= 0.2 THEN 50 + mos * 125 WHEN mos <= 0.5 THEN 75 + (mos - 0.2) * (25 / 0.3) ELSE 100 END, 6) AS mapped,
CASE WHEN p_size % 11 = 0 THEN 'SELL' WHEN s < 35 THEN 'SELL' WHEN mos <= -0.25 THEN 'TRIM' WHEN s < 50 THEN 'TRIM' WHEN s >= 80 AND mos >= 0.20 AND p_size % 7 <> 0 AND p_size % 3 = 0 THEN 'CONVICTION_BUY' WHEN s >= 80 AND mos >= 0.20 AND p_size % 7 <> 0 AND p_size % 3 <> 2 THEN 'SPECULATIVE_BUY'
    WHEN s >= 70 AND p_size % 2 = 0 AND p_size % 7 <> 0 AND p_size % 3 <> 2 AND mos > -0.10 THEN 'SPECULATIVE_BUY' ELSE 'HOLD' END AS verdict FROM s""")
def rating_decisions(spark, sf_dir) -> DataFrame:
    """Ordered rules and a piecewise map on scores made of parts: the rank of the price, and sizes as flags and bands."""
    rows = roles.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    # ranks in the range of a price bucket plus the number of rows before it: no task sorts all rows
    bucket = F.floor("p_retailprice")
    counts = rows.groupBy(bucket.alias("b")).count().withColumn("before", F.sum("count").over(Window.orderBy("b")) - F.col("count"))
    total = F.sum("count").over(Window.partitionBy())
    counts = counts.select("b", "before", total.alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("p_retailprice", "p_partkey")) - 1
    rows = rows.withColumn("b", bucket).join(F.broadcast(counts), "b").withColumn("s", 100 * F.try_divide(rank, F.col("total") - 1))
    rows = rows.withColumn("mos", (F.col("p_size") - 20) / 40)
    flag = lambda c, tier: F.when(c, F.struct(F.lit("X").alias("code"), F.lit(tier).alias("tier"), F.lit("HOLD").alias("cap")))
    f = F.array_compact(F.array(flag(F.col("p_size") % 11 == 0, "HARD"), flag(F.col("p_size") % 7 == 0, "SOFT")))
    band = F.when(F.col("p_size") % 3 == 0, "HIGH").when(F.col("p_size") % 3 == 1, "MED").otherwise("LOW")
    decision = rating.decide(F.col("s"), F.col("mos"), band, f, F.col("p_size") % 2 == 0, F.lit(None).cast("double"))
    points = [(-0.4, 0), (-0.2, 20), (0.0, 50), (0.2, 75), (0.5, 100)]
    return rows.select("p_partkey", R("s", 4).alias("s"), R(scalars.piecewise(F.col("mos"), points)).alias("mapped"), decision["verdict"].alias("verdict"))


_COMPONENTS = [
    {"pillar": "P1", "name": "roe", "kind": "pct", "sign": 1, "weight": 2}, {"pillar": "P1", "name": "roce", "kind": "map", "weight": 1, "points": [(0.0, 0), (0.05, 60), (0.1, 100)]},
    {"pillar": "P2", "name": "beta_250", "kind": "pct", "sign": -1, "weight": 1}, {"pillar": "P2", "name": "vol_250", "kind": "binary", "weight": 1},
]


@query(f"""WITH {roles.SUPPLIER_MONTHS}, long AS (SELECT as_of, symbol, industry, 'P1' AS pillar, 'roe' AS c, 2.0 AS w, roe AS x, NULL::DOUBLE AS d FROM supplier_months
    UNION ALL SELECT as_of, symbol, industry, 'P1', 'roce', 1.0, roce, CASE WHEN roce <= 0 THEN 0 WHEN roce <= 0.05 THEN roce * 1200 WHEN roce <= 0.1 THEN 60 + (roce - 0.05) * 800 ELSE 100 END FROM supplier_months
    UNION ALL SELECT as_of, symbol, industry, 'P2', 'beta_250', 1.0, -beta_250, NULL FROM supplier_months UNION ALL SELECT as_of, symbol, industry, 'P2', 'vol_250', 1.0, vol_250, CASE WHEN vol_250 >= 0.5 THEN 100 ELSE 0 END FROM supplier_months
), m AS (SELECT *, median(x) OVER (PARTITION BY as_of, c) AS md FROM long), s AS (SELECT *, median(abs(x - md)) OVER (PARTITION BY as_of, c) * 1.4826 * 3 AS sd FROM m), v AS (SELECT *, CASE WHEN sd > 0 THEN least(greatest(x, md - sd), md + sd) ELSE x END AS y FROM s
), p AS (SELECT *, CASE WHEN c NOT IN ('roe', 'beta_250') THEN d WHEN count(*) OVER (PARTITION BY as_of, c, industry) >= 8 THEN 100 * (rank() OVER (PARTITION BY as_of, c, industry ORDER BY y) + (count(*) OVER (PARTITION BY as_of, c, industry, y) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of, c, industry)
    ELSE 100 * (rank() OVER (PARTITION BY as_of, c ORDER BY y) + (count(*) OVER (PARTITION BY as_of, c, y) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of, c) END AS score FROM v)
SELECT as_of, symbol, pillar, round(sum(w * score) / sum(w), 4) AS score FROM p GROUP BY ALL""")
def pillar_scores(spark, sf_dir) -> DataFrame:
    long = rating.component_scores(roles.supplier_months(spark, sf_dir), ["as_of"], "industry", _COMPONENTS)
    return rating.pillar_scores(long, ["as_of"]).select("as_of", "symbol", "pillar", R("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {roles.SUPPLIER_MONTHS}, r AS (SELECT as_of, symbol, roce * 900 AS s, pb * 4 - 0.1 AS mos, row_number() OVER (PARTITION BY symbol ORDER BY as_of) AS k FROM supplier_months), d AS (
    SELECT *, CASE WHEN s < 35 THEN 'R2' WHEN mos <= -0.25 THEN 'R3' WHEN s < 50 THEN 'R4' WHEN s >= 80 AND mos >= 0.20 THEN 'R5' WHEN s >= 70 AND mos > -0.10 THEN 'R6' WHEN s >= 80 AND mos >= -0.10 AND mos < 0.20 THEN 'R7' WHEN s < 70 OR abs(mos) <= 0.10 THEN 'R8' ELSE 'R9' END AS rule FROM r
), v AS (SELECT *, CASE rule WHEN 'R2' THEN 0 WHEN 'R3' THEN 1 WHEN 'R4' THEN 1 WHEN 'R5' THEN 4 WHEN 'R6' THEN 3 ELSE 2 END AS n, s >= CASE rule WHEN 'R5' THEN 82 WHEN 'R6' THEN 72 WHEN 'R7' THEN 82 WHEN 'R8' THEN 52 WHEN 'R4' THEN 37 ELSE 0 END AND (rule <> 'R5' OR mos >= 0.23) AS may FROM d
), walk AS (SELECT symbol, k, n AS f FROM v WHERE k = 1 UNION ALL SELECT v.symbol, v.k, CASE WHEN v.n > walk.f AND NOT v.may THEN walk.f ELSE v.n END FROM walk JOIN v ON v.symbol = walk.symbol AND v.k = walk.k + 1), names AS (SELECT ['SELL', 'TRIM', 'HOLD', 'SPECULATIVE_BUY', 'CONVICTION_BUY'] AS l)
SELECT as_of, v.symbol AS symbol, rule, l[n + 1] AS verdict, l[f + 1] AS final FROM v JOIN walk USING (symbol, k), names""")
def verdicts_with_hysteresis(spark, sf_dir) -> DataFrame:
    """A state passes from date to date."""
    rows = roles.supplier_months(spark, sf_dir).select("as_of", "symbol", (F.col("roce") * 900).alias("S"), (F.col("pb") * 4 - 0.1).alias("mos"))
    decided = rows.withColumn("d", rating.decide(F.col("S"), F.col("mos"), F.lit("HIGH"), F.array().cast("array<struct<code:string,tier:string,cap:string>>"), F.lit(True), F.lit(None).cast("double")))
    final = rating.with_hysteresis(decided.select("as_of", "symbol", "S", "mos", "d.rule", "d.verdict"), ["symbol"])
    return final.select("as_of", "symbol", "rule", "verdict", "final")


@query("""WITH g AS (SELECT p_partkey, p_retailprice AS flow, 0.02 * (p_size % 10) AS g, 0.10 + 0.001 * (p_size % 7) AS r FROM part)
SELECT p_partkey, round(list_sum([flow * pow((1 + g) / (1 + r), t) FOR t IN range(1, 6)]) + list_sum([flow * pow(1 + g, 5) * pow(1 + g + (0.05 - g) * t / 5.0, t) / pow(1 + r, 5 + t) FOR t IN range(1, 6)]) + flow * pow(1 + g, 5) * pow(1.05, 5) * 1.05 / (r - 0.05) / pow(1 + r, 10), 2) AS value FROM g""")
def two_stage_values(spark, sf_dir) -> DataFrame:
    p = roles.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("flow"), (0.02 * (F.col("p_size") % 10)).alias("g"), (0.10 + 0.001 * (F.col("p_size") % 7)).alias("r"))
    return p.select("p_partkey", R(scalars.two_stage_value(F.col("flow"), F.col("g"), F.col("r"), F.lit(0.05)), 2).alias("value"))


@query("""WITH g AS (SELECT p_partkey, [p_retailprice, CASE WHEN p_size % 4 <> 0 THEN p_retailprice * p_size / 20 END, p_retailprice * 1.3] AS v, [0.4, 0.35, 0.25] AS w FROM part), u AS (SELECT p_partkey, unnest(v) AS v, unnest(w) AS w FROM g), c AS (
    SELECT p_partkey, v, sum(w) OVER (PARTITION BY p_partkey ORDER BY v, w) AS cw, sum(w) OVER (PARTITION BY p_partkey) AS t FROM u WHERE v IS NOT NULL) SELECT p_partkey, round(min(v) FILTER (WHERE cw >= t / 2 - 1e-12), 6) AS fair FROM c GROUP BY 1""")
def weighted_medians(spark, sf_dir) -> DataFrame:
    x = F.col("p_retailprice")
    pair = lambda v, w: F.struct(v.alias("value"), F.lit(w).alias("weight"))
    models = F.array(pair(x, 0.4), pair(F.when(F.col("p_size") % 4 != 0, x * F.col("p_size") / 20), 0.35), pair(x * 1.3, 0.25))
    return roles.table(spark, sf_dir, "part").select("p_partkey", R(statements.triangulated(models)).alias("fair"))


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0), new AS (SELECT o_orderkey AS k, o_totalprice + o_orderkey % 2 AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NOT NULL THEN new.v ELSE old.v END AS v, s FROM old FULL JOIN new ON old.k = new.k""")
def upserted_rows(spark, sf_dir) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return sinks.upserted(old, new, ["k"])


def _old_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = roles.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 4 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("s"))
    return old, o.where(k % 5 != 0).select(k.alias("k"), (F.col("o_totalprice") + k % 2).alias("v"))


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 0), new AS (SELECT o_orderkey AS k, o_totalprice + o_orderkey % 2 AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT k, NULL::DOUBLE AS old, v AS new FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT k, old.v, new.v FROM old JOIN new USING (k) WHERE old.v IS DISTINCT FROM new.v""")
def first_seen_and_revisions(spark, sf_dir) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    fresh = sinks.absent(old, new, ["k"]).select("k", F.lit(None).cast("double").alias("old"), F.col("v").alias("new"))
    return fresh.unionByName(sinks.revisions(old, new, ["k"], "v").select("k", "old", "new"))


@query("""WITH old AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0) SELECT old.k, coalesce(s, o_orderpriority) AS s FROM old JOIN orders ON o_orderkey = k""")
def filled_columns(spark, sf_dir) -> DataFrame:
    old, _ = _old_new(spark, sf_dir)
    new = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("s"))
    return sinks.filled(old.select("k", "s"), new, ["k"], ["s"])


@query(f"""WITH {roles.TAPE} SELECT 'row_count' AS check_name, CAST((SELECT count(*) FROM (SELECT count(*) AS n FROM tape GROUP BY trade_date) WHERE n NOT BETWEEN 5 AND 25) AS DOUBLE) AS value UNION ALL
SELECT 'duplicate_keys', CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS DOUBLE) UNION ALL SELECT 'jumps', CAST((SELECT count(*) FROM (SELECT abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1) AS r FROM tape) WHERE r > 0.5) AS DOUBLE) UNION ALL
SELECT 'coverage:close', 1.0 UNION ALL SELECT 'freshness', (SELECT round(avg(CASE WHEN date_diff('day', l, DATE '2001-12-31') > 60 THEN 1.0 ELSE 0 END), 6) FROM (SELECT max(trade_date) AS l FROM tape GROUP BY symbol))""")
def quality_checks(spark, sf_dir) -> DataFrame:
    t = roles.tape(spark, sf_dir)
    none = t.limit(0).select("symbol", F.col("trade_date").alias("ex_date"))
    found = quality.all_checks([
        quality.row_count_band(t, "trade_date", 5, 25), quality.duplicate_keys(roles.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]), quality.unexplained_jumps(t, none, "symbol", "trade_date", "close"),
        quality.coverage(t, "close", 0.9), quality.freshness(t, "symbol", "trade_date", F.lit("2001-12-31").cast("date"), 60, 0.3),
    ])
    return found.select("check_name", R("value").alias("value"))


@query("""SELECT page_id, u AS url, regexp_extract(u, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host, left(sha1(u), 10) AS id FROM (
    SELECT page_id, split_part(url, '?', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS u FROM (
        SELECT page_id, url, [p FOR p IN string_split(split_part(url, '?', 2), '&') IF NOT starts_with(lower(p), 'utm_') AND p <> ''] AS kept FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages)))""")
def canonical_urls(spark, sf_dir) -> DataFrame:
    u = scalars.canonical_url(F.concat("url", F.lit("#top")))
    return roles.table(spark, sf_dir, "pages").select("page_id", u.alias("url"), F.regexp_extract(u, r"^[a-zA-Z]+://([^/:?#]+)", 1).alias("host"), F.substring(F.sha1(u), 1, 10).alias("id"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha256 FROM pages""")
def page_texts(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "pages").select("page_id", F.sha2(scalars.clean_html(F.col("html")), 256).alias("text_sha256"))


@query()
def page_table_cells(spark, sf_dir) -> DataFrame:
    """Cells of tables in pages, parsed by batches; tested on pages with tables."""
    return pages_source.page_cells(roles.table(spark, sf_dir, "pages"))


#: What turns of conversations announce, by the last digit of their conversation and turn.
SUBJECTS = ["Transcript of the call", "Investor Presentation", "Analysts' meet and presentation", "Outcome of Board Meeting", "Un-audited figures", "Annual Report 2020", "Credit Rating", "Creation of PLEDGE", "Disclosure under SAST", "Board meeting"]


@query(f"""WITH a AS (SELECT role, [{", ".join("'" + x.replace("'", "''") + "'" for x in SUBJECTS)}][1 + (conv_id + turn) % 10] || ' ' || coalesce(text, '') AS t FROM conversations)
SELECT role, CASE WHEN t ILIKE '%transcript%' THEN 'transcript' WHEN t ILIKE '%investor presentation%' OR regexp_matches(t, '(?i)analyst.*presentation') OR t ILIKE '%earnings presentation%' THEN 'presentation' WHEN t ILIKE '%outcome of board meeting%' OR t ILIKE '%financial result%' OR t ILIKE '%audited%' THEN 'results'
    WHEN t ILIKE '%annual report%' THEN 'annual_report' WHEN t ILIKE '%credit rating%' THEN 'rating' WHEN t ILIKE '%pledge%' THEN 'pledge' WHEN t ILIKE '%insider trading%' OR t ILIKE '%sast%' OR t ILIKE '%substantial acquisition%' THEN 'insider' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY ALL""")
def announcement_kinds(spark, sf_dir) -> DataFrame:
    """How often each kind is announced, by subject and text."""
    subject = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (1 + (F.col("conv_id") + F.col("turn")) % 10).cast("int"))
    rows = roles.table(spark, sf_dir, "conversations").select("role", scalars.announcement_kind(subject, F.col("text")).alias("kind"))
    return rows.groupBy("role", "kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, contains(lower(text), q) AS exact FROM (SELECT d.doc_id, trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')) AS text, trim(regexp_replace(lower(substr(s.text, 20, 60)), '\\s+', ' ', 'g')) AS q FROM documents d JOIN documents s ON s.doc_id = d.doc_id - d.doc_id % 2)""".replace("\\\\", "\\"))
def exact_quotes(spark, sf_dir) -> DataFrame:
    """Which documents hold a quote: their own for even ids, that of the document before for odd ones."""
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "text")
    quotes = docs.where("doc_id % 2 = 0").select("doc_id", F.substring("text", 20, 60).alias("quote"))
    quotes = quotes.unionByName(quotes.withColumn("doc_id", F.col("doc_id") + 1)).join(docs.select("doc_id"), "doc_id", "left_semi")
    both = quotes.join(docs, "doc_id")
    return both.select("doc_id", F.contains(scalars.normal_text(F.col("text")), scalars.normal_text(F.col("quote"))).alias("exact"))


@query()
def quote_similarity(spark, sf_dir) -> DataFrame:
    """Best similarity of benchmark texts, each second word of them left out, within a document each; tested by hand."""
    items = roles.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", r"(\S+) \S+", "$1").alias("quote"))
    found = evidence.verify_quotes(items, roles.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "exact", R("similarity", 4).alias("similarity"), "supported")


EDGES = "edges AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, 'supplies' AS kind FROM lineitem UNION ALL SELECT DISTINCT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR), 'contains' FROM supplier)"


def edge_table(spark, sf_dir) -> DataFrame:
    a = roles.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("supplies").alias("kind")).distinct()
    b = roles.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("contains").alias("kind"))
    return a.unionByName(b)


@query(f"WITH {EDGES} SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) WHERE node NOT IN (SELECT src FROM edges WHERE kind = 'contains') ORDER BY degree DESC, node LIMIT 50")
def top_degrees(spark, sf_dir) -> DataFrame:
    return edges.degrees(edge_table(spark, sf_dir), top=50)


@query(f"WITH {EDGES} SELECT src AS node, 'out' AS direction, dst AS other, kind FROM edges UNION ALL SELECT dst, 'in', src, kind FROM edges")
def node_neighbours(spark, sf_dir) -> DataFrame:
    """Of every node all neighbours."""
    found = edge_table(spark, sf_dir)
    wanted = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return edges.neighbours(found, wanted)


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 15 MINUTE * k FOR k IN range(0, 4)]) AS start FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_activity(spark, sf_dir) -> DataFrame:
    return jobs.activity(roles.table(spark, sf_dir, "events"), "event_type", "ts", "value").select("event_type", "start", "n", R("total", 4).alias("total"))


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE AND ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def user_visits(spark, sf_dir) -> DataFrame:
    return jobs.visits(roles.table(spark, sf_dir, "events"), "user_id", "ts")


@query("""SELECT user_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, round(last(value ORDER BY ts, value), 6) AS close FROM events GROUP BY ALL""")
def weekly_closes(spark, sf_dir) -> DataFrame:
    return jobs.weekly_closes(roles.table(spark, sf_dir, "events"), "user_id", "ts", "value").select("user_id", "week", R("close").alias("close"))


@query("SELECT event_type, count(*) AS n, count(k) AS with_k, count(DISTINCT k) AS kinds FROM (SELECT event_type, props, json_extract_string(props, '$.k') AS k FROM events) GROUP BY event_type")
def json_properties(spark, sf_dir) -> DataFrame:
    rows = roles.table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.countDistinct("k").alias("kinds"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT c_custkey AS symbol, CAST(count(k) FILTER (WHERE k <= 5) AS BIGINT) AS n, round(sum(o_totalprice) FILTER (WHERE k <= 5), 2) AS total FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1""")
def evidence_packs(spark, sf_dir) -> DataFrame:
    """Of every customer the last five orders as a nested array, summed up here."""
    keys = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))
    orders = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), "o_orderkey", "o_orderdate", "o_totalprice", F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey").alias("place"))
    packed = sinks.packs(keys, {"orders": (orders, F.col("place"), 5)})
    total = F.aggregate("orders", F.lit(0.0), lambda s, x: s + x["o_totalprice"])
    return packed.select("symbol", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n"), R(total, 2).alias("total"))
