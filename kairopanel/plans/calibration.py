"""Queries that calibrate ratings: histories of variants, folds with an embargo, a holdout read once, the statistics and their bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import acceptance, asof, calibration, rating, walkforward
from ..operators.cross_section import with_percentiles
from ..sources.scratch import written
from . import companies, roles
from .registry import query

R = lambda x, n=6: F.round(x, n)

#: What the variants of the suppliers' score give to low prices, a low least price and turnover, by their places among a month's suppliers.
WEIGHTS = {"base": (0.5, 0.3, 0.2), "quality_tilt": (0.8, 0.1, 0.1), "value_tilt": (0.1, 0.8, 0.1)}
PROFILES = ["GENERAL", "BANK", "NBFC_FIN", "IT_SERVICES", "PHARMA"]
YEARS, HOLDOUT = [1997, 1998, 1999], "2000-01-01"


def supplier_ratings(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers rated each month by three variants, their mean prices, and those of all suppliers."""
    months = written(roles.supplier_months(spark, sf_dir).withColumns({"roe": F.round("roe", 4), "turnover": F.round("turnover", 2)}))
    places = {c: f"p_{c}" for c in ("roe", "mom_12_1", "turnover", "debt_equity")}
    rows = months.select("as_of", "symbol", "industry", "roce", "beta_250", *places)
    for c, p in places.items():  # a sort of a date at a time in a task
        rows = written(with_percentiles(rows, {c: p}, ["as_of"]).drop(c))
    sums = [F.round(a * (1 - F.col("p_roe")) + b * (1 - F.col("p_mom_12_1")) + c * F.col("p_turnover"), 9) for a, b, c in WEIGHTS.values()]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), x.alias("x")) for v, x in zip(WEIGHTS, sums)]))
    rows = with_percentiles(rows.select("*", each.alias("e")).select("*", "e.*").drop("e"), {"x": "p_x"}, ["as_of", "variant"])
    score, mos = 100 * F.col("p_x"), F.round(F.col("p_debt_equity") - 0.3, 9)
    none = F.array().cast("array<struct<code:string,tier:string,cap:string>>")
    breach = F.array(F.struct(F.lit("SOLVENCY_BREACH").alias("code"), F.lit("HARD").alias("tier"), F.lit("SELL").alias("cap")))
    rows = rows.withColumns({"score": score, "mos": mos, "flags": F.when(F.round("roce", 6) < 0.02, breach).otherwise(none)})
    rows = rows.withColumn("band", F.when(F.col("beta_250") >= 8, "HIGH").when(F.col("beta_250") >= 4, "MED").otherwise("LOW"))
    decided = rating.decide(F.col("score"), F.col("mos"), F.col("band"), F.col("flags"), F.col("p_turnover") >= 0.9, 100 * F.col("p_roe"))
    ratings = rows.select(
        "as_of", "variant", "symbol", F.element_at(F.array(*[F.lit(p) for p in PROFILES]), (F.col("industry") + 1).cast("int")).alias("profile"),
        F.when(F.col("beta_250") >= 2, "RATED").otherwise("NO_RATING").alias("status"), "score", decided["verdict"].alias("verdict"), "mos", "band",
        F.least(F.lit(1.0), F.col("beta_250") / 10).alias("coverage"), F.transform("flags", lambda f: f["code"]).alias("hard"),
    )
    prices = months.select("symbol", F.col("as_of").alias("trade_date"), (F.col("turnover") / F.col("mom_6_1")).alias("close"))
    index = months.groupBy(F.col("as_of").alias("trade_date")).agg((F.sum("turnover") / F.sum("mom_6_1")).alias("close"))
    return ratings, prices, index


def supplier_history(spark, sf_dir) -> DataFrame:
    """The ratings of suppliers with what followed over 12 and 36 months; written once."""
    ratings, prices, index = supplier_ratings(spark, sf_dir)
    calendar = asof.sessions(index)
    dates = index.select(F.col("trade_date").alias("as_of"))
    ahead = calibration.returns_ahead(prices, dates, calendar, {"fwd": 12, "fwd_long": 36})
    bench = calibration.benchmark_ahead(index, dates, calendar, {"bench": 12, "bench_long": 36}, annual=0.013)
    return written(calibration.history(ratings, ahead, bench))


_place = lambda c, by="as_of": f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by})"
_ahead = lambda name, n: f"""{name} AS (  -- noqa
    SELECT a.as_of, a.symbol, e.as_of AS ends_on, b.close * CASE WHEN a.no + {n} - b.no > 5 THEN 0.99 ELSE 1 END / a.close - 1 AS ret
    FROM px a JOIN cal e ON e.no = a.no + {n} JOIN px b ON b.symbol = a.symbol AND b.no <= a.no + {n} AND a.no + {n} < b.nxt
), {name}_bench AS (
    SELECT a.as_of, b.close / a.close - 1 + 0.013 * date_diff('day', a.as_of, b.as_of) / 365 AS ret FROM idx a JOIN idx b ON b.no = a.no + {n}
)"""  # noqa: E731

VERDICT = """CASE WHEN hard OR score < 35 THEN 'SELL' WHEN mos <= -0.25 OR score < 50 THEN 'TRIM' WHEN score >= 80 AND mos >= 0.2 AND band = 'HIGH' THEN 'CONVICTION_BUY'
            WHEN score >= 80 AND mos >= 0.2 AND band = 'MED' THEN 'SPECULATIVE_BUY' WHEN score >= 70 AND cat AND p2 >= 40 AND band <> 'LOW' AND mos > -0.1 THEN 'SPECULATIVE_BUY' ELSE 'HOLD' END"""

HISTORY = f"""{roles.SUPPLIER_MONTHS}, months AS (
    SELECT as_of, symbol, industry, round(roe, 4) AS roe, round(turnover, 2) AS turnover, debt_equity, mom_12_1, mom_6_1, roce, beta_250 FROM supplier_months
), cal AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS no FROM (SELECT DISTINCT as_of FROM months)
), px AS (
    SELECT symbol, as_of, no, turnover / mom_6_1 AS close, coalesce(lead(no) OVER (PARTITION BY symbol ORDER BY no), 100000) AS nxt FROM months JOIN cal USING (as_of)
), idx AS (SELECT as_of, no, sum(turnover) / sum(mom_6_1) AS close FROM months JOIN cal USING (as_of) GROUP BY ALL
), {_ahead("year", 12)}, {_ahead("three", 36)}, placed AS (
    SELECT *, {_place("roe")} AS p_roe, {_place("mom_12_1")} AS p_min, {_place("turnover")} AS p_turnover, {_place("debt_equity")} AS p_max FROM months
), summed AS (
    SELECT *, 'base' AS variant, round(0.5 * (1 - p_roe) + 0.3 * (1 - p_min) + 0.2 * p_turnover, 9) AS x FROM placed UNION ALL
    SELECT *, 'quality_tilt', round(0.8 * (1 - p_roe) + 0.1 * (1 - p_min) + 0.1 * p_turnover, 9) FROM placed UNION ALL
    SELECT *, 'value_tilt', round(0.1 * (1 - p_roe) + 0.8 * (1 - p_min) + 0.1 * p_turnover, 9) FROM placed
), ratings AS (
    SELECT as_of, variant, symbol, ['GENERAL', 'BANK', 'NBFC_FIN', 'IT_SERVICES', 'PHARMA'][industry + 1] AS profile, beta_250 >= 2 AS rated,
        100 * {_place("x", "as_of, variant")} AS score, round(p_max - 0.3, 9) AS mos, round(roce, 6) < 0.02 AS hard, p_turnover >= 0.9 AS cat, 100 * p_roe AS p2,
        CASE WHEN beta_250 >= 8 THEN 'HIGH' WHEN beta_250 >= 4 THEN 'MED' ELSE 'LOW' END AS band, least(1, beta_250 / 10) AS coverage FROM summed
), hist AS (
    SELECT r.*, {VERDICT} AS verdict,
        y.ret AS fwd, yb.ret AS bench, y.ret - yb.ret AS excess, t.ret - tb.ret AS excess_long, m.ends_on AS matured_on
    FROM ratings r JOIN (SELECT DISTINCT as_of, ends_on FROM year) m USING (as_of) LEFT JOIN year y USING (as_of, symbol) LEFT JOIN year_bench yb USING (as_of)
        LEFT JOIN three t USING (as_of, symbol) LEFT JOIN three_bench tb USING (as_of)
)"""


@query(f"""WITH {HISTORY} SELECT as_of, variant, symbol, profile, rated, round(score, 4) AS score, verdict, round(mos, 6) AS mos, band, hard, matured_on, round(excess, 6) + 0 AS excess, round(excess_long, 6) + 0 AS excess_long FROM hist""")
def calibration_history(spark, sf_dir) -> DataFrame:
    """Every supplier's ratings of all matured months and variants, with what followed."""
    rows = supplier_history(spark, sf_dir)
    return rows.select(
        "as_of", "variant", "symbol", "profile", (F.col("status") == "RATED").alias("rated"), R("score", 4).alias("score"), "verdict", R("mos").alias("mos"), "band",
        (F.size("hard") > 0).alias("hard"), "matured_on", (R("excess") + 0.0).alias("excess"), (R("excess_long") + 0.0).alias("excess_long"),
    )


_ic = lambda name, of, by, score, outcome: f"""{name} AS (
    SELECT {by}, corr(a, b) AS ic, count(*) AS n FROM (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY {by} ORDER BY {outcome}) + (count(*) OVER (PARTITION BY {by}, {outcome}) - 1) / 2.0 AS b FROM {of} WHERE {score} IS NOT NULL AND {outcome} IS NOT NULL)
    GROUP BY {by} HAVING count(*) >= 30)"""  # noqa: E731

FOLDS = f"""{HISTORY}, {_ic("ics", "hist", "variant, as_of", "score", "excess")}, by_date AS (SELECT variant, as_of, matured_on, count(*) AS n FROM hist GROUP BY ALL
), each AS (
    SELECT '1997' AS fold, DATE '1996-12-31' AS train_to, DATE '1997-01-01' AS test_from, DATE '1997-12-31' AS test_to UNION ALL SELECT '1998', DATE '1997-12-31', DATE '1998-01-01', DATE '1998-12-31'
    UNION ALL SELECT '1999', DATE '1998-12-31', DATE '1999-01-01', DATE '1999-12-31' UNION ALL SELECT 'holdout', DATE '2000-01-01', DATE '2000-01-01', DATE '9999-12-31'
), seen AS (
    SELECT fold, d.variant, coalesce(avg(ic), 0) AS ic, sum(d.n) AS n FROM by_date d LEFT JOIN ics i ON i.variant = d.variant AND i.as_of = d.as_of
    JOIN each e ON d.as_of <= train_to AND matured_on <= test_from AND d.as_of < DATE '2000-01-01' GROUP BY ALL
), chosen AS (
    SELECT fold, variant AS selected, ic AS train_ic, sum(n) OVER (PARTITION BY fold) AS n_train FROM seen
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ic DESC, list_position(['base', 'quality_tilt', 'value_tilt'], variant)) = 1
), tests AS (
    SELECT fold, sum(n) AS n_test FROM by_date JOIN each ON as_of BETWEEN test_from AND test_to AND (fold = 'holdout' OR as_of < DATE '2000-01-01') GROUP BY ALL
), folds AS (SELECT * FROM chosen JOIN tests USING (fold) JOIN each USING (fold)
), st AS (SELECT h.*, fold FROM hist h JOIN folds ON variant = selected AND as_of BETWEEN test_from AND test_to AND (fold = 'holdout' OR as_of < DATE '2000-01-01'))"""


def protocol(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = supplier_history(spark, sf_dir)
    return rows, written(calibration.folds(rows, list(WEIGHTS), YEARS, HOLDOUT))


@query(f"WITH {FOLDS} SELECT fold, selected, round(train_ic, 6) + 0 AS train_ic, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test FROM folds")
def calibration_folds(spark, sf_dir) -> DataFrame:
    """Which variant each year and the holdout are judged with."""
    _, chosen = protocol(spark, sf_dir)
    return chosen.select("fold", "selected", (R("train_ic") + 0.0).alias("train_ic"), "n_train", "n_test")


@query(f"""WITH {FOLDS} SELECT fold, verdict, count(*) AS n, round(avg(excess), 6) + 0 AS mean_excess, round(avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END), 6) AS hit
FROM st WHERE rated AND excess IS NOT NULL GROUP BY ALL""")
def calibration_tiers(spark, sf_dir) -> DataFrame:
    """What followed each verdict in the test years and the holdout, under the variants selected."""
    rows, chosen = protocol(spark, sf_dir)
    found = calibration.tier_statistics(calibration.stitched(rows, chosen, HOLDOUT), ["fold"])
    return found.select("fold", "verdict", "n", (R("mean_excess") + 0.0).alias("mean_excess"), R("hit").alias("hit"))


_DECILE = """CAST(greatest(1, ceil((row_number() OVER (PARTITION BY variant, as_of ORDER BY score, symbol) - 1) * 10
    / nullif(CAST(count(*) OVER (PARTITION BY variant, as_of) - 1 AS DOUBLE), 0))) AS INTEGER)"""


@query(f"""WITH {FOLDS}, d AS (SELECT year(as_of) AS year, {_DECILE} AS decile, excess FROM st WHERE fold <> 'holdout' AND rated AND excess IS NOT NULL),
m AS (SELECT year, decile, avg(excess) AS m FROM d GROUP BY ALL), s AS (SELECT year, coalesce(m > lag(m) OVER (PARTITION BY year ORDER BY decile), true) AS up FROM m)
SELECT year, CAST(count(*) AS INTEGER) AS deciles, bool_and(up) AS rises FROM s GROUP BY year""")
def calibration_deciles(spark, sf_dir) -> DataFrame:
    """Whether the mean return rises from decile to decile of the score, for each test year."""
    rows, chosen = protocol(spark, sf_dir)
    tests = calibration.stitched(rows, chosen, HOLDOUT).where("fold <> 'holdout'").withColumn("year", F.year("as_of"))
    return calibration.rises(calibration.decile_table(tests, ["year"]), ["year"]).select("year", "deciles", "rises")


_spread = lambda name, of, by="": f"""{name} AS (SELECT {by}as_of, avg(excess) FILTER (WHERE verdict IN ('CONVICTION_BUY', 'SPECULATIVE_BUY')) - avg(excess) FILTER (WHERE verdict IN ('SELL', 'TRIM')) AS v
    FROM {of} WHERE excess IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE verdict IN ('CONVICTION_BUY', 'SPECULATIVE_BUY')) >= 5 AND count(*) FILTER (WHERE verdict IN ('SELL', 'TRIM')) >= 5)"""  # noqa: E731


@query(f"""WITH {HISTORY}, {_ic("ics", "(SELECT * FROM hist WHERE as_of < DATE '2000-01-01')", "variant, as_of", "score", "excess")}, rated AS (SELECT * FROM hist WHERE rated AND as_of < DATE '2000-01-01'), {_spread("sp", "rated", "variant, ")}
SELECT variant, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic) / sqrt(count(*)), 6) AS ic_se, (SELECT round(avg(v), 6) + 0 FROM sp WHERE sp.variant = ics.variant) AS long_short_pp, count(*) AS n_dates FROM ics GROUP BY variant""")
def variant_diagnostics(spark, sf_dir) -> DataFrame:
    """Rank correlation and spread of every variant before the holdout."""
    found = calibration.variant_diagnostics(supplier_history(spark, sf_dir), HOLDOUT)
    return found.select("variant", R("ic_mean").alias("ic_mean"), R("ic_se").alias("ic_se"), (R("long_short_pp") + 0.0).alias("long_short_pp"), "n_dates")


def _newey_west_sql(name: str, of: str, value: str) -> str:
    lags = ", ".join(f"lag(e, {k}) OVER (ORDER BY as_of) AS l{k}" for k in range(1, 12))
    total = " + ".join(f"2 * {1 - k / 12} * coalesce(sum(e * l{k}), 0)" for k in range(1, 12))
    return f"""{name} AS (SELECT m, CASE WHEN n >= 6 AND v > 0 THEN m / (sqrt(v) / n) END AS t FROM (SELECT max(m) AS m, count(*) AS n, sum(e * e) + {total} AS v
    FROM (SELECT e, m, {lags} FROM (SELECT as_of, {value} - avg({value}) OVER () AS e, avg({value}) OVER () AS m FROM {of}))))"""


_STATISTICS = f"""{FOLDS}, oos AS (SELECT * FROM st WHERE fold <> 'holdout'), r AS (SELECT * FROM oos WHERE rated), kept AS (SELECT * FROM st WHERE fold = 'holdout' AND rated),
dd AS (SELECT year(as_of) AS year, {_DECILE} AS decile, excess FROM r WHERE excess IS NOT NULL), dm AS (SELECT decile, avg(excess) AS m FROM dd GROUP BY ALL), dy AS (SELECT year, decile, avg(excess) AS m FROM dd GROUP BY ALL),
du AS (SELECT year, bool_and(up) AS up FROM (SELECT year, coalesce(m > lag(m) OVER (PARTITION BY year ORDER BY decile), true) AS up FROM dy) GROUP BY year HAVING count(*) = 10),
ti AS (SELECT list_position(['CONVICTION_BUY', 'SPECULATIVE_BUY', 'HOLD', 'TRIM', 'SELL'], verdict) AS k, avg(excess) AS m, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) AS hit FROM r WHERE excess IS NOT NULL GROUP BY ALL),
{_spread("ls", "r")}, {_spread("hs", "kept")}, {_spread("ps", "r", "profile, ")}, {_ic("ic1", "r", "as_of", "score", "excess")}, {_ic("ic3", "r", "as_of", "mos", "excess_long")},
{_ic("icb", "(SELECT * FROM r WHERE band IN ('HIGH', 'LOW'))", "band, as_of", "score", "excess")}, {_newey_west_sql("nls", "ls", "v")}, {_newey_west_sql("nic", "ic1", "ic")}, {_newey_west_sql("nmo", "ic3", "ic")},
ed AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) AS base FROM r WHERE excess IS NOT NULL),
tb AS (SELECT len(list_filter(e, lambda x: x < score)) AS b, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) AS rate FROM r, ed WHERE excess IS NOT NULL GROUP BY 1), mono AS (SELECT b, max(rate) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS p FROM tb),
br AS (SELECT avg(pow(coalesce(p, base) - y, 2)) AS brier, avg(pow(base - y, 2)) AS clim, count(*) AS n FROM (SELECT CASE WHEN excess > 0 THEN 1.0 ELSE 0 END AS y, base, len(list_filter(e, lambda x: x < score)) AS b FROM kept, ed WHERE excess IS NOT NULL) LEFT JOIN mono USING (b)),
bands AS (SELECT avg(ic) FILTER (WHERE band = 'HIGH') AS hi, avg(ic) FILTER (WHERE band = 'LOW') AS lo FROM icb),
cs AS (SELECT as_of, profile, n, n / sum(n) OVER (PARTITION BY as_of) AS s FROM (SELECT as_of, profile, count(*) AS n FROM r WHERE verdict = 'CONVICTION_BUY' GROUP BY ALL)), cp AS (SELECT profile, avg(s) AS s, sum(n) AS n FROM cs GROUP BY ALL),
mv AS (SELECT verdict, lag(verdict) OVER (PARTITION BY symbol ORDER BY as_of) AS b FROM r), vs AS (SELECT verdict, avg(s) AS s FROM (SELECT verdict, n / sum(n) OVER (PARTITION BY as_of) AS s FROM (SELECT as_of, verdict, count(*) AS n FROM r GROUP BY ALL)) GROUP BY ALL),
g AS (SELECT count(*) FILTER (WHERE verdict LIKE '%BUY' AND excess IS NOT NULL) AS nb, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE verdict LIKE '%BUY' AND excess IS NOT NULL) AS hb, corr(score, coverage) AS cc, count(*) AS n,
    count(*) FILTER (WHERE verdict = 'SELL' AND excess IS NOT NULL) AS ns, avg(CASE WHEN excess < 0 THEN 1.0 ELSE 0 END) FILTER (WHERE verdict = 'SELL' AND excess IS NOT NULL) AS hs FROM r),
hf AS (SELECT count(*) AS n, avg(CASE WHEN excess < 0 THEN 1.0 ELSE 0 END) AS p FROM oos WHERE hard AND fwd IS NOT NULL),
x AS (
    SELECT 'decile_monotonic_overall' AS c, CAST((SELECT bool_and(up) FROM (SELECT coalesce(m > lag(m) OVER (ORDER BY decile), true) AS up FROM dm)) AS DOUBLE) AS v, NULL AS bar, 't' AS how
    UNION ALL SELECT 'decile_monotonic_years_min_share', (SELECT avg(CASE WHEN up THEN 1.0 ELSE 0 END) FROM du), 0.70, '>'
    UNION ALL SELECT 'tiers_ordered', (SELECT CASE WHEN count(*) >= 2 THEN CAST(bool_and(up) AS DOUBLE) END FROM (SELECT coalesce(m <= lag(m) OVER (ORDER BY k), true) AS up FROM ti)), NULL, 't'
    UNION ALL SELECT 'long_short_min_pp', (SELECT m FROM nls), 0.06, '>' UNION ALL SELECT 'long_short_t_min', (SELECT t FROM nls), 2.0, '>'
    UNION ALL SELECT 'ic_mean_min', (SELECT m FROM nic), 0.05, '>' UNION ALL SELECT 'ic_t_min', (SELECT t FROM nic), 2.0, '>'
    UNION ALL SELECT 'mos_ic_min', (SELECT m FROM nmo), 0.03, '>' UNION ALL SELECT 'mos_ic_t_min', (SELECT t FROM nmo), 1.5, '>'
    UNION ALL SELECT 'hit_conviction_buy_min', (SELECT hit FROM ti WHERE k = 1), 0.60, '>'
    UNION ALL SELECT 'hit_all_buy_min', (SELECT CASE WHEN nb >= 20 THEN hb END FROM g), 0.55, '>' UNION ALL SELECT 'hit_sell_min', (SELECT CASE WHEN ns >= 20 THEN hs END FROM g), 0.55, '>'
    UNION ALL SELECT 'hard_flag_precision_min', (SELECT CASE WHEN n >= 30 THEN p END FROM hf), 0.65, '>'
    UNION ALL SELECT 'brier_max', (SELECT CASE WHEN n >= 30 THEN brier END FROM br), 0.24, '<' UNION ALL SELECT 'brier_vs_climatology_min_gain', (SELECT CASE WHEN n >= 30 THEN clim - brier END FROM br), 0.01, '>'
    UNION ALL SELECT 'coverage_neutral_abs_corr_max', (SELECT CASE WHEN n > 50 THEN cc END FROM g), 0.10, 'a' UNION ALL SELECT 'dci_informative', (SELECT CAST(hi >= lo AS DOUBLE) FROM bands), NULL, 't'
    UNION ALL SELECT 'sector_max_share_conviction', (SELECT CASE WHEN sum(n) >= 20 THEN max(s) END FROM cp), 0.40, '<'
    UNION ALL SELECT 'sector_ls_positive_min_profiles', (SELECT count(*) FILTER (WHERE s > 0) FROM (SELECT avg(v) AS s FROM ps GROUP BY profile)), 3, '>'
    UNION ALL SELECT 'monthly_transition_max', (SELECT avg(CASE WHEN verdict <> b THEN 1.0 ELSE 0 END) FROM mv WHERE b IS NOT NULL), 0.25, '<'
    UNION ALL SELECT 'min_tier_share', (SELECT CASE WHEN count(*) = 5 THEN min(s) ELSE 0 END FROM vs), 0.05, '>' UNION ALL SELECT 'holdout_long_short_positive', (SELECT avg(v) FROM hs), 0.0, '+'
)"""


@query(f"""WITH {_STATISTICS} SELECT c AS "check", round(v, 4) + 0 AS value, CASE how WHEN 't' THEN v = 1 WHEN '>' THEN v >= bar WHEN '<' THEN v <= bar WHEN 'a' THEN abs(v) <= bar ELSE v > bar END AS passed FROM x""")
def calibration_acceptance(spark, sf_dir) -> DataFrame:
    """All statistics of the bar but the deflated ratio, which SQL doesn't have, from the test years and the holdout."""
    rows, chosen = protocol(spark, sf_dir)
    met = written(calibration.stitched(rows, chosen, HOLDOUT))
    found = written(calibration.statistics(met.where("fold <> 'holdout'"), met.where("fold = 'holdout'"), trials=len(WEIGHTS)))
    checks = acceptance.checked(found, [], acceptance.CALIBRATION).where(F.col("check") != "dsr_p_max")
    return checks.select("check", (R("value", 4) + 0.0).alias("value"), "passed")


_COMPANY_PRICES = """orders_q AS (
    SELECT CAST(floor(o_custkey / 15) AS BIGINT) AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS q, avg(o_totalprice) AS close FROM orders GROUP BY ALL
), px AS (SELECT symbol, CASE WHEN month(q) = 3 THEN make_date(year(q) - 1, 12, 31) + 90 ELSE q END AS d, close FROM orders_q
), cal AS (SELECT d, row_number() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT d FROM px)), pn AS (SELECT *, coalesce(lead(no) OVER (PARTITION BY symbol ORDER BY no), 100000) AS nxt FROM px JOIN cal USING (d)
), idx AS (SELECT d, no, avg(close) AS close FROM pn GROUP BY ALL), spans AS (SELECT unnest([4, 12]) AS n
), ahead AS (
    SELECT a.d AS as_of, a.symbol, n, e.d AS ends_on, b.close * CASE WHEN a.no + n - b.no > 5 THEN 0.99 ELSE 1 END / a.close - 1 AS ret
    FROM pn a, spans JOIN cal e ON e.no = a.no + n JOIN pn b ON b.symbol = a.symbol AND b.no <= a.no + n AND a.no + n < b.nxt
), bench AS (SELECT a.d AS as_of, n, b.close / a.close - 1 + 0.013 * date_diff('day', a.d, b.d) / 365 AS ret FROM idx a, spans JOIN idx b ON b.no = a.no + n)"""

_ALL_VARIANTS = ["base", "quality_tilt", "value_tilt", "no_valuation"]


@query(f"""WITH {companies.decided_sql(", ".join(f"'{v}'" for v in _ALL_VARIANTS))}, {_COMPANY_PRICES}
SELECT r.as_of, variant, r.symbol, profile, CASE WHEN fit THEN ['SELL', 'TRIM', 'HOLD', 'SPECULATIVE_BUY', 'CONVICTION_BUY'][v + 1] ELSE 'NO_RATING' END AS verdict, CASE WHEN fit THEN rule0 ELSE 'R0' END AS rule, round(S, 4) AS score, band,
    round(cov, 6) AS coverage, hard, soft, m.ends_on AS matured_on, round(y.ret - yb.ret, 6) + 0 AS excess, round(t.ret - tb.ret, 6) + 0 AS excess_long
FROM r6 r JOIN (SELECT DISTINCT as_of, ends_on FROM ahead WHERE n = 4) m ON m.as_of = r.as_of LEFT JOIN ahead y ON y.as_of = r.as_of AND y.symbol = r.symbol AND y.n = 4 LEFT JOIN bench yb ON yb.as_of = r.as_of AND yb.n = 4
    LEFT JOIN ahead t ON t.as_of = r.as_of AND t.symbol = r.symbol AND t.n = 12 LEFT JOIN bench tb ON tb.as_of = r.as_of AND tb.n = 12""")
def rating_history(spark, sf_dir) -> DataFrame:
    """Every company on every matured date under four variants, with the returns of a year and of three, in one job: scores are made once."""
    ratings = rating.rated_variants(companies.measured_wide(spark, sf_dir), ["as_of"], _ALL_VARIANTS)
    ratings = ratings.withColumnsRenamed({"S": "score", "mos_base": "mos", "component_coverage": "coverage"})
    orders = roles.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 15).alias("symbol"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    quarters = orders.groupBy("symbol", F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("q")).agg(F.avg("o_totalprice").alias("close"))
    day = F.when(F.month("q") == 3, F.date_add(F.make_date(F.year("q") - 1, F.lit(12), F.lit(31)), 90)).otherwise(F.col("q"))
    prices = written(quarters.select("symbol", day.alias("trade_date"), "close"))
    index = prices.groupBy("trade_date").agg(F.avg("close").alias("close"))
    calendar, dates = asof.sessions(index), index.select(F.col("trade_date").alias("as_of"))
    ahead = calibration.returns_ahead(prices, dates, calendar, {"fwd": 4, "fwd_long": 12})
    bench = calibration.benchmark_ahead(index, dates, calendar, {"bench": 4, "bench_long": 12}, annual=0.013)
    rows = calibration.history(ratings, ahead, bench)
    return rows.select(
        "as_of", "variant", "symbol", "profile", "verdict", "rule", R("score", 4).alias("score"), "band", R("coverage").alias("coverage"), F.size("hard").alias("hard"), F.size("soft").alias("soft"),
        "matured_on", (R("excess") + 0.0).alias("excess"), (R("excess_long") + 0.0).alias("excess_long"),
    )


_WALK_FORWARD = f"""{roles.TAPE}, rets AS (
    SELECT symbol, trade_date, r FROM (SELECT symbol, trade_date, 0.02 * ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)) AS r FROM tape) WHERE r IS NOT NULL
), bench AS (SELECT trade_date, avg(r) AS b FROM rets GROUP BY trade_date), each AS (
    SELECT CAST(y AS VARCHAR) AS fold, DATE '1995-01-01' AS train_from, make_date(y, 1, 1) - 30 AS train_to, make_date(y, 1, 1) AS test_from, make_date(y, 12, 31) AS test_to FROM (SELECT unnest([1997, 1998, 1999]) AS y)
    UNION ALL SELECT 'holdout', DATE '1995-01-01', DATE '2000-01-01' - 30, DATE '2000-01-01', DATE '9999-12-31'
), train AS (
    SELECT fold, test_from, test_to, symbol, avg(r - 0.06 / 252) / nullif(stddev_samp(r), 0) * sqrt(252) AS s, count(*) AS n FROM rets JOIN each ON trade_date BETWEEN train_from AND train_to GROUP BY ALL
), pick AS (SELECT * FROM train WHERE n >= 250 AND s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY s DESC, symbol) = 1
), placed AS (
    SELECT fold, trade_date, rets.symbol, r, row_number() OVER (PARTITION BY fold ORDER BY trade_date) AS k, s, n FROM rets JOIN pick ON pick.symbol = rets.symbol AND trade_date BETWEEN test_from AND test_to
), path AS (SELECT * FROM placed WHERE k > 21 QUALIFY count(*) OVER (PARTITION BY fold) >= 40)"""


def _judged_sql(of: str, by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""valued AS (SELECT {key}trade_date, r, coalesce(b, 0) AS b, exp(sum(ln(1 + r)) OVER ({part}ORDER BY trade_date)) AS v FROM {of} LEFT JOIN bench USING (trade_date)),
    fallen AS (SELECT *, v / greatest(max(v) OVER ({part}ORDER BY trade_date), 1) - 1 AS dd FROM valued),
    monthly AS (SELECT {key}exp(sum(ln(1 + r))) - 1 AS m FROM valued GROUP BY {key}date_trunc('month', trade_date)),
    ms AS (SELECT {key}max(m) AS best, min(m) AS worst, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS hit FROM monthly {f"GROUP BY {by}" if by else ""}),
    js AS (SELECT {key}count(*) AS n, avg(r - 0.06 / 252) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r - b) / stddev_samp(r - b) * sqrt(252) AS information_ratio, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS cagr,
        exp(sum(ln(1 + r)) * 252 / count(*)) - exp(sum(ln(1 + b)) * 252 / count(*)) AS excess_cagr, min(dd) AS max_drawdown FROM fallen {f"GROUP BY {by}" if by else ""})"""


_JUDGED = ["sharpe", "information_ratio", "cagr", "excess_cagr", "max_drawdown", "best", "worst", "hit"]
_JUDGED_SQL = ", ".join(f"round({c}, 4) + 0 AS {c}" for c in _JUDGED)


def walked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily returns of brands (a fiftieth of their log change: their prices jump), the brand chosen for each fold, and the mean return of all."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    rets = roles.tape(spark, sf_dir).select("symbol", "trade_date", (0.02 * F.ln(F.col("close") / before)).alias("ret"))
    rets = written(rets.where("ret is not null"))
    each = walkforward.fold_table(spark, "1995-01-01", YEARS, HOLDOUT, 30)
    return rets, written(walkforward.chosen_variants(rets, each, "symbol", "trade_date", "ret")), rets.groupBy("trade_date").agg(F.avg("ret").alias("bench"))


@query(f"""WITH {_WALK_FORWARD}, {_judged_sql("path", "fold")}, p AS (SELECT fold, any_value(symbol) AS selected, any_value(s) AS train_sharpe, CAST(any_value(n) AS BIGINT) AS n_train FROM path GROUP BY fold)
SELECT fold, selected, round(train_sharpe, 4) AS train_sharpe, n_train, n, {_JUDGED_SQL} FROM p JOIN js USING (fold) JOIN ms USING (fold)""")
def walk_forward_folds(spark, sf_dir) -> DataFrame:
    """Each fold's choice, and how it did in its test period after the purge."""
    rets, chosen, bench = walked(spark, sf_dir)
    found = walkforward.judged(walkforward.stitched_path(rets, chosen, "symbol", "trade_date", "ret"), bench, ["fold"], "trade_date", "ret")
    return found.join(chosen, "fold").select("fold", "selected", R("train_sharpe", 4).alias("train_sharpe"), "n_train", "n", *[(R(c, 4) + 0.0).alias(c) for c in _JUDGED])


@query(f"WITH {_WALK_FORWARD} SELECT fold, trade_date, symbol, round(r, 6) + 0 AS ret, round(exp(sum(ln(1 + r)) OVER (ORDER BY trade_date)), 6) AS level FROM path WHERE fold <> 'holdout'")
def walk_forward_path(spark, sf_dir) -> DataFrame:
    """The stitched path of all test years: one series of returns and its level (a row a session, so one task adds it up)."""
    rets, chosen, _ = walked(spark, sf_dir)
    path = walkforward.stitched_path(rets, chosen, "symbol", "trade_date", "ret").where("fold <> 'holdout'")
    level = F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))
    return path.select("fold", "trade_date", "symbol", (R("ret") + 0.0).alias("ret"), R(level).alias("level"))


@query(f"""WITH {_WALK_FORWARD}, tested AS (SELECT * FROM rets WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'), {_judged_sql("tested", "symbol")} SELECT symbol, n, {_JUDGED_SQL} FROM js JOIN ms USING (symbol)""")
def walk_forward_robustness(spark, sf_dir) -> DataFrame:
    """Every variant over all test years, chosen or not."""
    rets, _, bench = walked(spark, sf_dir)
    tested = rets.where("trade_date between date'1997-01-01' and date'1999-12-31'")
    found = walkforward.judged(tested, bench, ["symbol"], "trade_date", "ret")
    return found.select("symbol", "n", *[(R(c, 4) + 0.0).alias(c) for c in _JUDGED])
