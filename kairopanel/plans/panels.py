"""Queries on price panels, cross-sections, selection, portfolios and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import action_factor
from ..operators import adjust, asof, cross_section, portfolio, rolling, selection, validation
from ..sources.scratch import written
from . import roles
from .registry import query

R = lambda x, n=6: F.round(x, n)


@query(f"WITH {roles.TAPE} SELECT symbol, trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(turnover, 2) AS turnover, trades FROM tape")
def daily_tape(spark, sf_dir) -> DataFrame:
    return roles.tape(spark, sf_dir).select("symbol", "trade_date", *[R(c).alias(c) for c in ("open", "high", "low", "close")], "volume", R("turnover", 2).alias("turnover"), "trades")


@query(f"""WITH {roles.TAPE}, weeks AS (SELECT max(trade_date) AS as_of FROM calendar GROUP BY date_trunc('week', trade_date))
SELECT 'month' AS unit, as_of FROM month_ends UNION ALL SELECT 'week', as_of FROM weeks""")
def period_ends(spark, sf_dir) -> DataFrame:
    calendar = asof.sessions(roles.tape(spark, sf_dir))
    return asof.last_session_of(calendar, "month").select(F.lit("month").alias("unit"), "as_of").unionByName(asof.last_session_of(calendar, "week").select(F.lit("week").alias("unit"), "as_of"))


FEATURES = ["mom_12_1", "mom_6_1", "mom_1", "vol_60", "vol_250", "dist_52w_high", "dma50_ratio", "dma200_ratio", "atr14_pct", "vol_ratio_20_120", "amihud_60"]

PRICE_FEATURES = f"""WITH {roles.PANEL}, a AS (
    SELECT *, ln(close / lag(close) OVER w) AS lr, lag(close) OVER w AS pc, lag(close, 21) OVER w AS c21, lag(close, 252) OVER w AS c252, lag(close, 126) OVER w AS c126 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY session_no)
), b AS (
    SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, abs(exp(lr) - 1) / nullif(turnover, 0) AS il FROM a
), f AS (
    SELECT symbol, trade_date, close, count(close) OVER (PARTITION BY symbol ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS history_days, c21 / c252 - 1 AS mom_12_1, c21 / c126 - 1 AS mom_6_1, close / c21 - 1 AS mom_1,
        stddev_samp(lr) OVER w60 * sqrt(252) AS vol_60, stddev_samp(lr) OVER w250 * sqrt(252) AS vol_250, close / max(close) OVER w251 - 1 AS dist_52w_high, close / avg(close) OVER w50 - 1 AS dma50_ratio, close / avg(close) OVER w200 - 1 AS dma200_ratio,
        avg(tr) OVER w14 / close AS atr14_pct, avg(turnover) OVER w20 AS adv20, median(turnover) OVER w120 AS turnover_med120, avg(volume) OVER w20 / avg(volume) OVER w120 AS vol_ratio_20_120, avg(il) OVER w60 * 1e9 AS amihud_60
    FROM b WINDOW w14 AS (PARTITION BY symbol ORDER BY session_no ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY session_no ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY session_no ROWS 49 PRECEDING),
        w60 AS (PARTITION BY symbol ORDER BY session_no ROWS 59 PRECEDING), w120 AS (PARTITION BY symbol ORDER BY session_no ROWS 119 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY session_no ROWS 199 PRECEDING),
        w250 AS (PARTITION BY symbol ORDER BY session_no ROWS 249 PRECEDING), w251 AS (PARTITION BY symbol ORDER BY session_no ROWS 250 PRECEDING)
)"""


@query(PRICE_FEATURES + f" SELECT symbol, trade_date AS as_of, history_days, round(adv20, 6) AS adv20, round(turnover_med120, 4) AS turnover_med120, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM f JOIN month_ends ON trade_date = as_of WHERE close IS NOT NULL")
def price_features(spark, sf_dir) -> DataFrame:
    tape = roles.market(spark, sf_dir)
    at = rolling.sampled_features(roles.panel(tape), roles.month_ends(tape))
    return at.select("symbol", "as_of", "history_days", R("adv20").alias("adv20"), R("turnover_med120", 4).alias("turnover_med120"), *[R(f).alias(f) for f in FEATURES])


@query(f"""WITH {roles.PANEL}, daily AS (SELECT trade_date, sum(turnover) / sum(volume) AS index FROM tape GROUP BY trade_date), a AS (
    SELECT p.*, 0.1 + trades % 3 * 0.123456789 AS dp, ln(close / lag(close) OVER w) AS lr, ln(index / lag(index) OVER w) AS b FROM panel p JOIN daily USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY session_no)
), c AS (
    SELECT symbol, trade_date, close, avg(dp) OVER w20 AS d20, avg(dp) OVER w120 AS d120, count(b) OVER w250 AS nb, covar_samp(lr, b) OVER w250 / nullif(var_samp(b) OVER w250, 0) AS beta,
        list({{'l': lr, 'b': b}}) FILTER (WHERE lr IS NOT NULL) OVER w250 AS rows, list(close) FILTER (WHERE close IS NOT NULL) OVER w251 AS cs
    FROM a WINDOW w20 AS (PARTITION BY symbol ORDER BY session_no ROWS 19 PRECEDING), w120 AS (PARTITION BY symbol ORDER BY session_no ROWS 119 PRECEDING),
        w250 AS (PARTITION BY symbol ORDER BY session_no ROWS 249 PRECEDING), w251 AS (PARTITION BY symbol ORDER BY session_no ROWS 250 PRECEDING)
), e AS (SELECT *, CASE WHEN nb > 30 THEN beta END AS bt FROM c JOIN month_ends ON trade_date = as_of WHERE close IS NOT NULL)
SELECT symbol, as_of, round(d20, 6) AS deliv_pct_20, round(d20 / nullif(d120, 0), 6) AS deliv_ratio, round(bt, 6) + 0 AS beta_250,
    CASE WHEN nb > 30 THEN round((SELECT stddev_samp(r.l - coalesce(bt, 0) * coalesce(r.b, 0)) FROM (SELECT unnest(rows) AS r)) * sqrt(252), 6) END AS idio_vol_250,
    round((SELECT min(c / m - 1) FROM (SELECT c, max(c) OVER (ORDER BY i) AS m FROM (SELECT unnest(cs) AS c, unnest(range(len(cs))) AS i))), 6) + 0 AS dd_250 FROM e""")
def market_features(spark, sf_dir) -> DataFrame:
    """Beta and residual volatility against all brands, delivery and the year's drawdown at month ends, from running sums."""
    tape = roles.market(spark, sf_dir)
    index = tape.groupBy("trade_date").agg((F.sum("turnover") / F.sum("volume")).alias("index"))
    rows = roles.panel(tape).join(F.broadcast(index), "trade_date").withColumn("delivered", 0.1 + F.col("trades") % 3 * 0.123456789)
    at = rolling.sampled_features(rows, roles.month_ends(tape), benchmark="index", delivery="delivered")
    return at.select("symbol", "as_of", R("deliv_pct_20").alias("deliv_pct_20"), R("deliv_ratio").alias("deliv_ratio"), (R("beta_250") + 0.0).alias("beta_250"), R("idio_vol_250").alias("idio_vol_250"), (R("dd_250") + 0.0).alias("dd_250"))


@query(f"""WITH {roles.PANEL} SELECT symbol, trade_date, round((below + (same + 1) / 2.0) / n, 6) AS volume_rank, round(worst, 6) AS drawdown FROM (
    SELECT symbol, trade_date, len(list_filter(vs, lambda v: v < volume)) AS below, len(list_filter(vs, lambda v: v = volume)) AS same, len(vs) AS n, (
        SELECT min(c / m - 1) FROM (SELECT c, max(c) OVER (ORDER BY i) AS m FROM (SELECT unnest(cs) AS c, unnest(range(len(cs))) AS i))) AS worst
    FROM (SELECT symbol, trade_date, volume, list(volume) FILTER (WHERE volume IS NOT NULL) OVER w AS vs, list(close) FILTER (WHERE close IS NOT NULL) OVER w AS cs FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY session_no ROWS 29 PRECEDING))
    JOIN month_ends ON trade_date = as_of WHERE volume IS NOT NULL)""")
def rolling_rank_and_drawdown(spark, sf_dir) -> DataFrame:
    w = rolling.frame("symbol", "session_no", 30)
    tape = roles.market(spark, sf_dir)
    rows = roles.panel(tape).select("symbol", "trade_date", "volume", rolling.rolling_rank(F.col("volume"), w, 1).alias("r"), rolling.drawdown_in(F.collect_list("close").over(w)).alias("d"))
    at = rows.join(F.broadcast(roles.month_ends(tape)), F.col("trade_date") == F.col("as_of")).where("volume is not null")
    return at.select("symbol", "trade_date", R("r").alias("volume_rank"), R("d").alias("drawdown"))


@query(f"""WITH {roles.TAPE}, daily AS (SELECT trade_date, sum(turnover) / sum(volume) AS close, stddev_samp(close) AS vix FROM tape GROUP BY trade_date), held AS (
    SELECT trade_date, close, last_value(vix IGNORE NULLS) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS vix FROM daily
), r AS (
    SELECT trade_date, close, CASE WHEN count(close) OVER w200 >= 120 THEN avg(close) OVER w200 END AS dma, vix, list(vix) OVER w250 AS vs FROM held
    WINDOW w200 AS (ORDER BY trade_date ROWS 199 PRECEDING), w250 AS (ORDER BY trade_date ROWS 249 PRECEDING)
), p AS (
    SELECT trade_date, close, dma, CASE WHEN len(list_filter(vs, lambda v: v IS NOT NULL)) >= 120 AND vix IS NOT NULL THEN (len(list_filter(vs, lambda v: v < vix)) + (len(list_filter(vs, lambda v: v = vix)) + 1) / 2.0) / len(list_filter(vs, lambda v: v IS NOT NULL)) END AS pct FROM r
) SELECT trade_date, regime, CASE regime WHEN 'RISK_ON' THEN 1.0 WHEN 'RISK_OFF' THEN 0.4 ELSE 0.7 END AS exposure FROM (
    SELECT trade_date, CASE WHEN dma IS NULL THEN 'NEUTRAL' WHEN close > dma AND coalesce(pct < 0.8, false) THEN 'RISK_ON' WHEN close <= dma AND NOT coalesce(pct < 0.8, false) THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM p)""")
def market_regime(spark, sf_dir) -> DataFrame:
    daily = roles.tape(spark, sf_dir).groupBy("trade_date").agg((F.sum("turnover") / F.sum("volume")).alias("close"), F.stddev_samp("close").alias("vix"))
    return rolling.market_regime(daily).select("trade_date", "regime", "exposure")


UNIVERSE = f"""{roles.TAPE}, {roles.INDUSTRIES}, ends AS (SELECT as_of, session_no AS e FROM month_ends JOIN calendar ON trade_date = as_of), windowed AS (
    SELECT as_of, symbol, count(*) AS sessions, max(trade_date) AS last_date, median(turnover) AS turnover_med120, avg(turnover) FILTER (WHERE session_no > e - 20) AS adv20
    FROM tape JOIN calendar USING (trade_date) JOIN ends ON session_no BETWEEN e - 119 AND e GROUP BY as_of, symbol
), history AS (
    SELECT as_of, symbol, count(*) AS history_days FROM tape JOIN calendar USING (trade_date) JOIN ends ON session_no <= e GROUP BY as_of, symbol
), universe AS (
    SELECT w.*, h.history_days, t.close, i.industry FROM windowed w JOIN history h USING (as_of, symbol) JOIN tape t ON t.symbol = w.symbol AND t.trade_date = w.last_date LEFT JOIN industries i ON i.symbol = w.symbol
    WHERE sessions >= 60 AND history_days >= 250 AND close >= 20 AND w.symbol NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING min(p_size) > 45)
)"""


def universe(spark, sf_dir) -> DataFrame:
    """Names by date with enough sessions, history, price and turnover; all dates in one job."""
    rows = roles.market(spark, sf_dir)
    calendar = asof.sessions(rows)
    ends = roles.month_ends(rows).join(calendar.withColumnRenamed("trade_date", "as_of"), "as_of").select("as_of", F.col("session_no").alias("e"))
    held = rows.join(F.broadcast(calendar), "trade_date").withColumn("history_days", F.count("*").over(Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))
    met = held.join(F.broadcast(ends), F.col("session_no").between(F.col("e") - 119, F.col("e")))
    last = F.max_by(F.struct("close", "history_days"), "trade_date")
    found = met.groupBy("as_of", "symbol").agg(F.count("*").alias("sessions"), F.max("trade_date").alias("last_date"), F.percentile("turnover", F.lit(0.5)).alias("turnover_med120"), F.avg(F.when(F.col("session_no") > F.col("e") - 20, F.col("turnover"))).alias("adv20"), last.alias("x"))
    excluded = roles.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_size").alias("m")).where("m > 45").select("symbol")
    found = found.select("*", "x.*").drop("x").join(excluded, "symbol", "left_anti").join(roles.industries(spark, sf_dir), "symbol", "left")
    return found.where("sessions >= 60 and history_days >= 250 and close >= 20")


@query(f"WITH {UNIVERSE} SELECT as_of, symbol, sessions, last_date, round(turnover_med120, 4) AS turnover_med120, round(adv20, 4) AS adv20, history_days, round(close, 6) AS close, industry FROM universe")
def liquidity_universe(spark, sf_dir) -> DataFrame:
    return universe(spark, sf_dir).select("as_of", "symbol", "sessions", "last_date", R("turnover_med120", 4).alias("turnover_med120"), R("adv20", 4).alias("adv20"), "history_days", R("close").alias("close"), "industry")


WINSOR = f"""{roles.SUPPLIER_MONTHS}, m AS (SELECT *, median(roe) OVER (PARTITION BY as_of) AS md FROM supplier_months), s AS (
    SELECT *, median(abs(roe - md)) OVER (PARTITION BY as_of) * 1.4826 * 3 AS sd FROM m
), x AS (SELECT as_of, symbol, industry, turnover, roe, CASE WHEN sd > 0 THEN least(greatest(roe, md - sd), md + sd) ELSE roe END AS v FROM s), zs AS (
    SELECT *, greatest(least(CASE WHEN count(v) OVER g >= 8 THEN (v - avg(v) OVER g) / nullif(stddev_pop(v) OVER g, 0) ELSE (v - avg(v) OVER a) / nullif(stddev_pop(v) OVER a, 0) END, 4), -4) AS z
    FROM x WINDOW g AS (PARTITION BY as_of, industry), a AS (PARTITION BY as_of)
)"""


@query(f"WITH {WINSOR} SELECT as_of, symbol, round(v, 4) AS winsorised, round(z, 6) AS z FROM zs")
def grouped_zscores(spark, sf_dir) -> DataFrame:
    rows = cross_section.winsorise(roles.supplier_months(spark, sf_dir), "roe", ["as_of"], "v")
    return cross_section.zscore_grouped(rows, "v", ["as_of"], "industry", "z").select("as_of", "symbol", R("v", 4).alias("winsorised"), R("z").alias("z"))


@query(f"""WITH {roles.SUPPLIER_MONTHS} SELECT as_of, symbol, round((rank() OVER (PARTITION BY as_of, industry ORDER BY beta_250) + (count(*) OVER (PARTITION BY as_of, industry, beta_250) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of, industry), 6) AS pct,
    CAST(greatest(1, ceil((row_number() OVER (PARTITION BY as_of ORDER BY turnover, symbol) - 1) * 10 / nullif(CAST(count(*) OVER (PARTITION BY as_of) - 1 AS DOUBLE), 0))) AS INTEGER) AS decile FROM supplier_months""")
def percentile_and_decile(spark, sf_dir) -> DataFrame:
    rows = roles.supplier_months(spark, sf_dir)
    return rows.select("as_of", "symbol", R(cross_section.percentile_grouped(F.col("beta_250"), ["as_of", "industry"])).alias("pct"), cross_section.deciles(["turnover", "symbol"], ["as_of"]).alias("decile"))


_PARTS = [c for c in cross_section.COMPONENTS if c[0] in ("roe", "roce", "accruals", "debt_equity", "mom_12_1", "mom_6_1", "dist_52w_high", "earnings_yield", "pb", "vol_250", "beta_250")]
BUCKETS = f"""{roles.SUPPLIER_MONTHS}, long AS ({" UNION ALL ".join(f"SELECT as_of, symbol, industry, '{n}' AS component, '{b}' AS bucket, {s} * {f'greatest({n}, {a})' if a is not None else n} AS x FROM supplier_months" for n, b, s, a, z in _PARTS)}
), m AS (SELECT *, median(x) OVER (PARTITION BY as_of, component) AS md FROM long), s AS (SELECT *, median(abs(x - md)) OVER (PARTITION BY as_of, component) * 1.4826 * 3 AS sd FROM m
), v AS (SELECT as_of, symbol, industry, component, bucket, CASE WHEN sd > 0 THEN least(greatest(x, md - sd), md + sd) ELSE x END AS x FROM s), z AS (
    SELECT *, CASE WHEN count(x) OVER a >= 8 THEN greatest(least(CASE WHEN count(x) OVER g >= 8 THEN (x - avg(x) OVER g) / nullif(stddev_pop(x) OVER g, 0) ELSE (x - avg(x) OVER a) / nullif(stddev_pop(x) OVER a, 0) END, 4), -4) END AS z
    FROM v WINDOW g AS (PARTITION BY as_of, component, industry), a AS (PARTITION BY as_of, component)
), buckets AS (
    SELECT as_of, symbol, {", ".join(f"CASE WHEN count(z) FILTER (WHERE bucket = '{b}') >= 2 THEN avg(z) FILTER (WHERE bucket = '{b}') END AS z_{b}" for b in ("quality", "value", "momentum", "lowrisk"))} FROM z GROUP BY as_of, symbol
)"""
# a bucket's mean over two components may be near the rounding edge: components of constant value are null on either side


@query(f"WITH {BUCKETS} SELECT as_of, symbol, round(z_quality, 4) AS z_quality, round(z_value, 4) AS z_value, round(z_momentum, 4) AS z_momentum, round(z_lowrisk, 4) AS z_lowrisk FROM buckets")
def bucket_scores(spark, sf_dir) -> DataFrame:
    found = cross_section.bucket_scores(roles.supplier_months(spark, sf_dir), ["as_of"], "symbol", "industry")
    return found.select("as_of", "symbol", *[R(f"z_{b}", 4).alias(f"z_{b}") for b in ("quality", "value", "momentum", "lowrisk")])


def _score_sql(w: dict) -> str:
    total = " + ".join(f"coalesce({c} * {x}, 0)" for c, x in w.items())
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {x} END" for c, x in w.items())
    known = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in w)
    return f"CASE WHEN {known} >= 2 THEN ({total}) / nullif({weight}, 0) END"


@query(f"""WITH {BUCKETS}, scored AS ({" UNION ALL ".join(f"SELECT as_of, symbol, '{v}' AS variant, {_score_sql(w)} AS score FROM buckets" for v, w in selection.LONG_WEIGHTS.items())})
SELECT as_of, symbol, variant, round(score, 4) AS score FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY as_of, variant ORDER BY score DESC, symbol) <= 20""")
def ranked_composites(spark, sf_dir) -> DataFrame:
    found = cross_section.bucket_scores(roles.supplier_months(spark, sf_dir), ["as_of"], "symbol", "industry")
    top = selection.ranked(selection.variants(found, selection.LONG_WEIGHTS), ["as_of", "variant"]).where("rank <= 20")
    return top.select("as_of", "symbol", "variant", R("score", 4).alias("score"))


#: Sleeves of suppliers: in each region the largest by turnover, and those with the most lines.
_SLEEVES = {"turnover": "turnover", "lines": "beta_250 * 1000 + turnover / 1e6"}


def held_names(spark, sf_dir) -> DataFrame:
    rows = roles.supplier_months(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sleeve"), F.expr(e).alias("score")) for s, e in _SLEEVES.items()]))
    rows = rows.select("as_of", "symbol", "industry", each.alias("s")).select("as_of", "symbol", "industry", "s.*")
    return selection.select_with_hysteresis(selection.ranked(rows, ["sleeve", "industry", "as_of"]), ["sleeve", "industry"], n=8)


@query(f"""WITH RECURSIVE {roles.SUPPLIER_MONTHS}, sc AS (SELECT as_of, symbol, industry, 'turnover' AS sleeve, turnover AS score FROM supplier_months UNION ALL SELECT as_of, symbol, industry, 'lines', beta_250 * 1000 + turnover / 1e6 FROM supplier_months),
r AS (SELECT sleeve, industry, as_of, symbol, row_number() OVER (PARTITION BY sleeve, industry, as_of ORDER BY score DESC, symbol) AS rank FROM sc), d AS (
    SELECT sleeve, industry, as_of, list({{'s': symbol, 'r': rank}} ORDER BY rank) AS names, row_number() OVER (PARTITION BY sleeve, industry ORDER BY as_of) AS k FROM r WHERE rank <= 12 GROUP BY sleeve, industry, as_of
), walk AS (
    SELECT sleeve, industry, as_of, k, names[1:8] AS held, []::BIGINT[] AS old FROM d WHERE k = 1 UNION ALL
    SELECT d.sleeve, d.industry, d.as_of, d.k, list_concat([n FOR n IN d.names IF list_contains([h.s FOR h IN walk.held], n.s)], list_slice([n FOR n IN d.names IF NOT list_contains([h.s FOR h IN walk.held], n.s)], 1, 8 - len([n FOR n IN d.names IF list_contains([h.s FOR h IN walk.held], n.s)]))), [h.s FOR h IN walk.held]
    FROM walk JOIN d ON d.sleeve = walk.sleeve AND d.industry = walk.industry AND d.k = walk.k + 1
) SELECT sleeve, industry, as_of, n.s AS symbol, CAST(n.r AS INTEGER) AS rank, list_contains(old, n.s) AS kept FROM (SELECT *, unnest(held) AS n FROM walk)""")
def hysteresis_selection(spark, sf_dir) -> DataFrame:
    """Names held through time, in sleeves of regions."""
    return held_names(spark, sf_dir).select("sleeve", "industry", "as_of", "symbol", F.col("rank").cast("int").alias("rank"), "kept")


@query()
def capped_inverse_vol_weights(spark, sf_dir) -> DataFrame:
    """Iterative: tested by hand."""
    names = held_names(spark, sf_dir).select("sleeve", "as_of", "symbol")
    rows = names.join(roles.supplier_months(spark, sf_dir).select("as_of", "symbol", (F.col("vol_250") / 10).alias("vol_60"), F.col("industry").cast("string").alias("industry")), ["as_of", "symbol"])
    return selection.inverse_vol_weights(rows, ["sleeve", "as_of"], name_cap=0.05, industry_cap=0.22).select("sleeve", "as_of", "symbol", R("weight").alias("weight"))


_SHORT = f"""{roles.SUPPLIER_MONTHS}, x AS (SELECT as_of, symbol, industry, roce AS mom_1, CASE WHEN dist_52w_high / 30 - 1 >= -0.05 THEN least(greatest(accruals * 50, 0), 5) ELSE 0 END AS surge, least(greatest(pb * 60, 0), 5) AS deliv, turnover, vol_250 FROM supplier_months),
xl AS (UNPIVOT x ON mom_1, surge, deliv INTO NAME c VALUE v), m AS (SELECT *, median(v) OVER (PARTITION BY as_of, c) AS md FROM xl)"""


@query(f"""WITH {_SHORT}, z AS (SELECT *, greatest(least(CASE WHEN count(v) OVER g >= 8 THEN (v - avg(v) OVER g) / nullif(stddev_pop(v) OVER g, 0) ELSE (v - avg(v) OVER a) / nullif(stddev_pop(v) OVER a, 0) END, 4), -4) AS z FROM xl WINDOW g AS (PARTITION BY as_of, industry, c), a AS (PARTITION BY as_of, c)),
w AS (SELECT as_of, symbol, turnover, vol_250, max(z) FILTER (WHERE c = 'mom_1') AS m, max(z) FILTER (WHERE c = 'surge') AS b, max(z) FILTER (WHERE c = 'deliv') AS d FROM z GROUP BY ALL), v AS (SELECT *, unnest(['base', 'breakout_tilt', 'flow_tilt']) AS variant, unnest([0.40, 0.30, 0.30]) AS wm, unnest([0.30, 0.45, 0.25]) AS wb, unnest([0.30, 0.25, 0.45]) AS wd FROM w)
SELECT as_of, symbol, variant, round(wm * m + wb * b + wd * d, 4) + 0 AS score FROM v WHERE turnover >= 100000 AND vol_250 < 5""")
def short_horizon_scores(spark, sf_dir) -> DataFrame:
    """Momentum, breakouts near the high and deliveries, by three variants, of the eligible names."""
    x = roles.supplier_months(spark, sf_dir).select(
        "as_of", "symbol", "industry", F.col("roce").alias("mom_1"), (F.col("dist_52w_high") / 30 - 1).alias("dist_52w_high"), (F.col("accruals") * 50).alias("vol_ratio_20_120"), (F.col("pb") * 60).alias("deliv_ratio"), F.col("turnover").alias("turnover_med120"),
        F.lit(3).alias("buckets_known"), F.lit(0).alias("in_gsm"), (F.col("vol_250") >= 5).cast("int").alias("in_asm"), F.lit(0).alias("in_fo_ban"), F.lit(100.0).alias("close"), F.lit(300).alias("history_days"),
    )
    found = selection.short_scores(x, ["as_of"]).where(selection.eligible(min_turnover=100_000.0, positive_profit=False))
    return found.select("as_of", "symbol", "variant", (R("score", 4) + 0.0).alias("score"))


@query(f"WITH {roles.ACTIONS} SELECT symbol, ex_date, round(factor, 6) AS factor FROM factors")
def action_factors(spark, sf_dir) -> DataFrame:
    parsed = roles.actions(spark, sf_dir).withColumn("f", action_factor(F.col("subject"))).select("symbol", "ex_date", "f.factor")
    return adjust.day_factors(parsed).select("symbol", "ex_date", R("factor").alias("factor"))


def factors(spark, sf_dir) -> DataFrame:
    return adjust.day_factors(roles.actions(spark, sf_dir).withColumn("f", action_factor(F.col("subject"))).select("symbol", "ex_date", "f.factor"))


@query(f"""WITH {roles.TAPE}, {roles.ACTIONS} SELECT t.symbol, t.trade_date, round(ln(close) + coalesce(sum(ln(factor)), 0), 6) AS log_close, round(ln(volume) - coalesce(sum(ln(factor)), 0), 6) AS log_volume
FROM tape t LEFT JOIN factors f ON f.symbol = t.symbol AND f.ex_date > t.trade_date GROUP BY t.symbol, t.trade_date, close, volume""")
def split_adjusted_tape(spark, sf_dir) -> DataFrame:
    tape = roles.tape(spark, sf_dir).withColumns({"raw_close": F.col("close"), "raw_volume": F.col("volume")})
    rows = adjust.adjusted(tape, factors(spark, sf_dir))
    return rows.select("symbol", "trade_date", R(F.ln("raw_close") + F.col("log_adj")).alias("log_close"), R(F.ln("raw_volume") - F.col("log_adj")).alias("log_volume"))


@query(f"""WITH {roles.TAPE}, {roles.ACTIONS}, gaps AS (SELECT symbol, trade_date AS confirmed_on, open / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS gap FROM tape), near AS (
    SELECT f.symbol, f.ex_date, confirmed_on, gap FROM factors f JOIN gaps g ON f.symbol = g.symbol AND abs(date_diff('day', f.ex_date, confirmed_on)) <= 8 AND abs(gap / factor - 1) <= 0.35
    QUALIFY row_number() OVER (PARTITION BY f.symbol, f.ex_date ORDER BY abs(date_diff('day', f.ex_date, confirmed_on)), confirmed_on) = 1
) SELECT symbol, ex_date, round(factor, 6) AS factor, confirmed_on, round(gap, 6) AS gap FROM factors LEFT JOIN near USING (symbol, ex_date)""")
def confirmed_factors(spark, sf_dir) -> DataFrame:
    found = adjust.confirmed_actions(factors(spark, sf_dir), roles.tape(spark, sf_dir))
    return found.select("symbol", "ex_date", R("factor").alias("factor"), "confirmed_on", R("gap").alias("gap"))


@query(f"""WITH {roles.TAPE}, {roles.ACTIONS}, r AS (SELECT symbol, trade_date, open, lag(close) OVER w AS prior, lead(close, 3) OVER w AS later, lead(trade_date, 3) OVER w AS later_on,
    median(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 25 PRECEDING AND 5 PRECEDING) AS vb, median(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 FOLLOWING AND 25 FOLLOWING) AS va
    FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), g AS (SELECT *, open / prior AS gap FROM r), n AS (
    SELECT g.*, k.ratio, abs(gap / k.ratio - 1) AS off FROM g, (SELECT unnest([0.02, 0.04, 0.05, 0.1, 0.2, 0.25, 1 / 3, 0.5, 2 / 3, 2, 3, 4, 5, 10]) AS ratio) k WHERE (gap <= 0.7 OR gap >= 1.4) AND prior >= 5
    QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY off, k.ratio) = 1)
SELECT symbol, trade_date AS ex_date, round(gap, 6) AS gap, round(ratio, 6) AS factor FROM n WHERE off <= 0.08 AND date_diff('day', trade_date, later_on) <= 12 AND abs(later / prior / ratio - 1) <= 0.25
    AND CASE WHEN ratio < 1 THEN va / vb >= 0.6 / ratio ELSE coalesce(va / vb <= 1.6 / ratio, true) END AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.symbol = n.symbol AND abs(date_diff('day', n.trade_date, a.ex_date)) <= 5)""")
def unannounced_gaps(spark, sf_dir) -> DataFrame:
    found = adjust.gap_candidates(roles.tape(spark, sf_dir), roles.actions(spark, sf_dir))
    return found.select("symbol", "ex_date", R("gap").alias("gap"), R("factor").alias("factor"))


FORWARD = f"""{roles.PANEL}, ends AS (SELECT as_of, session_no AS s, session_no + 60 AS t FROM month_ends JOIN calendar ON trade_date = as_of), steps AS (
    SELECT symbol, session_no AS s, close, coalesce(lead(session_no) OVER (PARTITION BY symbol ORDER BY session_no), 1 << 30) AS n FROM panel WHERE close IS NOT NULL
), fwd AS (
    SELECT e.as_of, a.symbol, t <= (SELECT max(session_no) FROM calendar) AS matured, a.close AS c0, b.close AS c1, t - b.s > 5 AS late FROM ends e JOIN steps a ON a.s = e.s JOIN steps b ON b.symbol = a.symbol AND b.s <= t AND t < b.n
), forward AS (
    SELECT as_of, symbol, matured, matured AND late AS delisted, CASE WHEN matured THEN c1 / c0 * CASE WHEN late THEN 0.99 ELSE 1 END - 1 END AS fwd FROM fwd
)"""


def forward(tape: DataFrame) -> DataFrame:
    return validation.forward_returns(tape, roles.month_ends(tape), asof.sessions(tape), 60)


@query(f"WITH {FORWARD} SELECT as_of, symbol, matured, delisted, round(fwd, 6) AS fwd FROM forward")
def forward_returns(spark, sf_dir) -> DataFrame:
    return forward(roles.market(spark, sf_dir)).select("as_of", "symbol", "matured", "delisted", R("fwd").alias("fwd"))


SCORED = f"{FORWARD}, scored AS (SELECT as_of, f.symbol, t.volume AS score, fwd FROM forward f JOIN tape t ON t.symbol = f.symbol AND t.trade_date = f.as_of WHERE fwd IS NOT NULL)"


def scored(spark, sf_dir) -> DataFrame:
    tape = roles.market(spark, sf_dir)
    now = tape.select("symbol", F.col("trade_date").alias("as_of"), F.col("volume").alias("score"))
    return forward(tape).where("fwd is not null").join(now, ["as_of", "symbol"]).select("as_of", "symbol", "score", "fwd")


IC = f"""{SCORED}, ranks AS (SELECT as_of, rank() OVER (PARTITION BY as_of ORDER BY score) + (count(*) OVER (PARTITION BY as_of, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY as_of ORDER BY fwd) + (count(*) OVER (PARTITION BY as_of, fwd) - 1) / 2.0 AS b FROM scored),
ics AS (SELECT as_of, corr(a, b) AS ic, count(*) AS n FROM ranks GROUP BY as_of HAVING count(*) >= 8)"""


@query(f"WITH {IC} SELECT as_of, round(ic, 6) AS ic, n FROM ics")
def rank_correlations(spark, sf_dir) -> DataFrame:
    return validation.rank_ic(scored(spark, sf_dir), ["as_of"], "score", "fwd", least=8).select("as_of", R("ic").alias("ic"), "n")


@query(f"""WITH {IC}, e AS (SELECT as_of, ic, ic - avg(ic) OVER () AS e FROM ics), l AS (SELECT e, {", ".join(f"lag(e, {k}) OVER (ORDER BY as_of) AS l{k}" for k in range(1, 12))} FROM e)
SELECT round((SELECT avg(ic) FROM ics), 6) AS mean, round((SELECT avg(ic) FROM ics) / (sqrt(sum(e * e) + {" + ".join(f"2 * {1 - k / 12} * sum(e * l{k})" for k in range(1, 12))}) / count(*)), 4) AS t, count(*) AS n FROM l""")
def newey_west_t(spark, sf_dir) -> DataFrame:
    ics = validation.rank_ic(scored(spark, sf_dir), ["as_of"], "score", "fwd", least=8).withColumn("all", F.lit(1))
    return validation.newey_west(ics, ["all"], "ic", "as_of").select(R("mean").alias("mean"), R("t", 4).alias("t"), "n")


@query(f"""WITH {SCORED}, d AS (SELECT fwd, CAST(greatest(1, ceil((row_number() OVER (PARTITION BY as_of ORDER BY score, symbol) - 1) * 10 / nullif(CAST(count(*) OVER (PARTITION BY as_of) - 1 AS DOUBLE), 0))) AS INTEGER) AS decile FROM scored), m AS (
    SELECT decile, avg(fwd) AS mean, count(*) AS names FROM d GROUP BY decile) SELECT decile, round(mean, 6) AS mean, names, mean > lag(mean) OVER (ORDER BY decile) AS rises FROM m""")
def decile_returns(spark, sf_dir) -> DataFrame:
    return validation.decile_means(scored(spark, sf_dir), ["as_of"], "score", "fwd").select("decile", R("mean").alias("mean"), "names", "rises")


VERDICTS = f"{SCORED}, v AS (SELECT *, CASE WHEN p >= 0.8 THEN 'BUY' WHEN p >= 0.3 THEN 'HOLD' ELSE 'SELL' END AS verdict FROM (SELECT *, (rank() OVER (PARTITION BY as_of ORDER BY score) + (count(*) OVER (PARTITION BY as_of, score) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of) AS p FROM scored))"


def verdicts(spark, sf_dir) -> DataFrame:
    p = cross_section.percentile_grouped(F.col("score"), ["as_of"])
    return scored(spark, sf_dir).withColumn("p", p).withColumn("verdict", F.when(F.col("p") >= 0.8, "BUY").when(F.col("p") >= 0.3, "HOLD").otherwise("SELL"))


@query(f"WITH {VERDICTS}, c AS (SELECT as_of, verdict, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT verdict, n / sum(n) OVER (PARTITION BY as_of) AS s FROM c) SELECT verdict, round(sum(s) / (SELECT count(DISTINCT as_of) FROM v), 6) AS share FROM s GROUP BY verdict")
def verdict_shares(spark, sf_dir) -> DataFrame:
    return validation.verdict_shares(verdicts(spark, sf_dir), ["as_of"], "verdict").select("verdict", R("share").alias("share"))


@query(f"WITH {VERDICTS} SELECT as_of, round(avg(fwd) FILTER (WHERE verdict = 'BUY') - avg(fwd) FILTER (WHERE verdict = 'SELL'), 6) AS spread FROM v GROUP BY as_of HAVING count(*) FILTER (WHERE verdict = 'BUY') >= 2 AND count(*) FILTER (WHERE verdict = 'SELL') >= 2")
def long_short_spread(spark, sf_dir) -> DataFrame:
    return validation.long_short(verdicts(spark, sf_dir), ["as_of"], F.col("verdict") == "BUY", F.col("verdict") == "SELL", "fwd", least=2).select("as_of", R("spread").alias("spread"))


@query(f"WITH {VERDICTS} SELECT count(*) AS transitions, count(*) FILTER (WHERE verdict <> b) AS changed, round(count(*) FILTER (WHERE verdict <> b) / count(*), 6) AS rate FROM (SELECT verdict, lag(verdict) OVER (PARTITION BY symbol ORDER BY as_of) AS b FROM v) WHERE b IS NOT NULL")
def verdict_transitions(spark, sf_dir) -> DataFrame:
    return validation.transition_rate(verdicts(spark, sf_dir), ["symbol"], "as_of", "verdict").select("transitions", "changed", R("rate").alias("rate"))


@query(f"""WITH {SCORED}, tr AS (SELECT * FROM scored WHERE as_of < DATE '1999-01-01'), te AS (SELECT * FROM scored WHERE as_of >= DATE '1999-01-01'), e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) AS base FROM tr),
trb AS (SELECT len(list_filter(e.e, lambda x: x < score)) AS b, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) AS r FROM tr, e GROUP BY 1), mono AS (SELECT b, max(r) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS p FROM trb),
s AS (SELECT CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END AS y, coalesce(p, base) AS p, base FROM (SELECT te.*, e.base, len(list_filter(e.e, lambda x: x < score)) AS b FROM te, e) LEFT JOIN mono USING (b))
SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg((base - y) * (base - y)), 6) AS climatology, count(*) AS n FROM s""")
def brier_score(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("up", F.col("fwd") > 0)
    found = validation.brier(rows.where("as_of < date'1999-01-01'"), rows.where("as_of >= date'1999-01-01'"), "score", "up")
    return found.select(R("brier").alias("brier"), R("climatology").alias("climatology"), "n")


WEIGHTS = f"""{roles.PANEL}, rets AS (SELECT symbol, trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret FROM tape), weights AS (
    SELECT 'top' AS sleeve, as_of, symbol, 0.18 AS weight FROM month_ends JOIN tape ON trade_date = as_of QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY turnover DESC, symbol) <= 5)"""


def weights(tape: DataFrame) -> DataFrame:
    now = tape.join(F.broadcast(roles.month_ends(tape)), F.col("trade_date") == F.col("as_of"))
    top = selection.ranked(now.select("as_of", "symbol", F.col("turnover").alias("score")), ["as_of"]).where("rank <= 5")
    return top.select(F.lit("top").alias("sleeve"), "as_of", "symbol", F.lit(0.18).alias("weight"))


def daily_returns(tape: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return tape.select("symbol", "trade_date", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))


PORTFOLIO = f"""{WEIGHTS}, spans AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS u FROM (SELECT DISTINCT as_of FROM weights)), held AS (
    SELECT w.as_of, w.symbol, c.trade_date, weight, exp(sum(ln(greatest(1 + coalesce(ret, 0), 1e-9))) OVER (PARTITION BY w.as_of, w.symbol ORDER BY c.trade_date ROWS UNBOUNDED PRECEDING)) AS g
    FROM weights w JOIN spans s USING (as_of) JOIN calendar c ON c.trade_date > w.as_of AND (u IS NULL OR c.trade_date <= u) LEFT JOIN rets r ON r.symbol = w.symbol AND r.trade_date = c.trade_date
), val AS (SELECT as_of, trade_date, sum(weight * g) + 1 - sum(weight) AS v FROM held GROUP BY ALL), port AS (SELECT trade_date, round(v / coalesce(lag(v) OVER (PARTITION BY as_of ORDER BY trade_date), 1) - 1, 9) AS ret FROM val)"""


def portfolio_of(tape: DataFrame) -> DataFrame:
    found = portfolio.portfolio_returns(weights(tape), daily_returns(tape), ["sleeve"], asof.sessions(tape))
    return found.withColumn("ret", R("ret", 9))


@query(f"WITH {PORTFOLIO} SELECT trade_date, round(ret, 6) + 0 AS ret FROM port")
def portfolio_returns(spark, sf_dir) -> DataFrame:
    return portfolio_of(roles.market(spark, sf_dir)).select("trade_date", (R("ret") + 0.0).alias("ret"))


@query(f"""WITH {PORTFOLIO}, bench AS (SELECT trade_date, avg(ret) AS b FROM rets GROUP BY trade_date), x AS (SELECT trade_date, ret, coalesce(b, 0) AS b, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS v FROM port LEFT JOIN bench USING (trade_date)), y AS (
    SELECT *, v / greatest(max(v) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd, ret - 0.06 / 252 AS e FROM x)
SELECT count(*) AS n, round(stddev_samp(ret) * sqrt(252), 4) AS vol, round(avg(e) / stddev_samp(ret) * sqrt(252), 4) AS sharpe, round(avg(e) / stddev_samp(e) FILTER (WHERE e < 0) * sqrt(252), 4) AS sortino, round(min(dd), 4) AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 4) AS hit,
    round(stddev_samp(ret - b) * sqrt(252), 4) AS tracking_error, round(covar_samp(ret, b) / var_samp(b), 4) AS beta FROM y""")
def performance_statistics(spark, sf_dir) -> DataFrame:
    tape = roles.market(spark, sf_dir)
    bench = daily_returns(tape).groupBy("trade_date").agg(F.avg("ret").alias("bench"))
    rows = portfolio_of(tape).join(bench, "trade_date", "left").fillna(0.0, ["bench"])
    found = portfolio.performance(rows, ["sleeve"], bench="bench")
    return found.select("n", *[R(c, 4).alias(c) for c in ("vol", "sharpe", "sortino", "max_drawdown", "hit", "tracking_error", "beta")])


@query(f"""WITH {WEIGHTS}, nx AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS n FROM (SELECT DISTINCT as_of FROM weights)), old AS (SELECT n AS as_of, symbol, weight AS before FROM weights JOIN nx USING (as_of) WHERE n IS NOT NULL), ch AS (
    SELECT as_of, symbol, coalesce(before, 0) AS before, coalesce(weight, 0) AS weight FROM weights FULL JOIN old USING (as_of, symbol)), o AS (SELECT *, abs(weight - before) * 1e7 AS v, weight > before AS buy FROM ch)
SELECT o.as_of, o.symbol, round(weight - before, 6) AS change, round(CASE WHEN v > 0 THEN 20 + v * 0.001 + v * 0.0000297 + v * 1e-6 + CASE WHEN buy THEN v * 0.00015 ELSE 15.34 END + (20 + v * 0.0000297 + v * 1e-6) * 0.18
    + v * least(100, 10 + 50 * sqrt(coalesce(v / CASE WHEN turnover > 0 THEN turnover END, 0.05))) / 1e4 END, 4) AS cost FROM o LEFT JOIN tape t ON t.symbol = o.symbol AND t.trade_date = o.as_of""")
def turnover_and_cost(spark, sf_dir) -> DataFrame:
    tape = roles.market(spark, sf_dir)
    moved = portfolio.turnover(weights(tape), ["sleeve"])
    adv = tape.select("symbol", F.col("trade_date").alias("as_of"), "turnover")
    cost = portfolio.order_cost(F.abs("change") * 1e7, F.col("change") > 0, F.col("turnover"))
    return moved.join(adv, ["symbol", "as_of"], "left").select("as_of", "symbol", R("change").alias("change"), R(cost["total"], 4).alias("cost"))


@query(f"""WITH {roles.TAPE}, d AS (SELECT trade_date, sum(turnover) / sum(volume) AS close FROM tape GROUP BY trade_date), r AS (SELECT trade_date, coalesce(close / lag(close) OVER (ORDER BY trade_date) - 1 + 0.013 / 252, 0) AS ret FROM d)
SELECT trade_date, round(ret, 6) AS ret, round(sum(ln(1 + ret)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 6) AS log_level FROM r""")
def total_return_benchmark(spark, sf_dir) -> DataFrame:
    daily = roles.tape(spark, sf_dir).groupBy("trade_date").agg((F.sum("turnover") / F.sum("volume")).alias("close"))
    return portfolio.total_return_index(daily).select("trade_date", R("ret").alias("ret"), R(F.ln("level")).alias("log_level"))


@query(f"""WITH {roles.TAPE}, rets AS (SELECT symbol, trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM tape), ys AS (SELECT DISTINCT year(trade_date) AS year FROM tape), tr AS (
    SELECT ys.year, symbol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS s FROM ys JOIN rets ON trade_date < make_date(ys.year, 1, 1) - 30 AND trade_date >= make_date(ys.year - 3, 1, 1) GROUP BY ALL
), best AS (SELECT * FROM tr WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year ORDER BY s DESC, symbol) = 1)
SELECT b.year, b.symbol, round(s, 6) AS train_sharpe, count(*) AS oos_n, round(avg(r), 6) AS oos_mean FROM best b JOIN rets ON rets.symbol = b.symbol AND year(trade_date) = b.year GROUP BY ALL""")
def walk_forward_choice(spark, sf_dir) -> DataFrame:
    found = validation.walk_forward(daily_returns(roles.market(spark, sf_dir)), "symbol", "ret", "trade_date")
    return found.select("year", "symbol", R("train_sharpe").alias("train_sharpe"), "oos_n", R("oos_mean").alias("oos_mean"))


@query()
def deflated_sharpe_ratios(spark, sf_dir) -> DataFrame:
    """The normal distribution isn't in SQL: tested by hand."""
    r = daily_returns(roles.tape(spark, sf_dir)).where("ret is not null")
    stats = r.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"))
    return validation.deflated_sharpe(stats).select("symbol", "n", R("sr").alias("sr"), R("sr0").alias("sr0"), R("dsr").alias("dsr"))


@query(f"""WITH {FORWARD}, pub AS (SELECT f.as_of, f.symbol FROM forward f JOIN tape t ON t.symbol = f.symbol AND t.trade_date = f.as_of QUALIFY row_number() OVER (PARTITION BY f.as_of ORDER BY turnover DESC, f.symbol) <= 5), bench AS (SELECT as_of, avg(fwd) AS bench FROM forward GROUP BY as_of), led AS (
    SELECT as_of, symbol, fwd, bench, CASE WHEN NOT matured THEN 'pending' WHEN delisted THEN 'delisted' WHEN fwd > bench THEN 'hit' ELSE 'miss' END AS status FROM pub JOIN forward USING (as_of, symbol) JOIN bench USING (as_of))
SELECT year(as_of) AS year, count(*) FILTER (WHERE status <> 'pending') AS matured, CASE WHEN count(*) FILTER (WHERE status <> 'pending') >= 20 THEN round(avg(CASE WHEN status = 'hit' THEN 1.0 ELSE 0 END) FILTER (WHERE status <> 'pending'), 6) END AS hit_rate,
    CASE WHEN count(*) FILTER (WHERE status <> 'pending') >= 20 THEN round(avg(fwd - bench) FILTER (WHERE status <> 'pending'), 6) + 0 END AS mean_excess FROM led GROUP BY 1""")
def prospective_ledger(spark, sf_dir) -> DataFrame:
    tape = roles.market(spark, sf_dir)
    outcomes = written(forward(tape))
    bench = outcomes.groupBy("as_of").agg(F.avg("fwd").alias("bench"))
    now = tape.select("symbol", F.col("trade_date").alias("as_of"), F.col("turnover").alias("score"))
    top = selection.ranked(outcomes.select("as_of", "symbol").join(now, ["as_of", "symbol"]), ["as_of"]).where("rank <= 5").select("as_of", "symbol")
    ledger = validation.publish(top, top.limit(0), ["as_of", "symbol"])
    done = validation.mature(ledger, outcomes.join(bench, "as_of"), ["as_of", "symbol"]).withColumn("year", F.year("as_of"))
    return validation.ledger_report(done, ["year"], least=20).select("year", "matured", R("hit_rate").alias("hit_rate"), (R("mean_excess") + 0.0).alias("mean_excess"))
