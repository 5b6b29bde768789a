"""Queries that run jobs on tables of their own: slices built and resumed, ranks, a ledger of ratings, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import asof, builds, cross_section, filings, ledger, selection
from ..operators.digest import verdict_changes
from ..sources.scratch import shared_folder, written
from . import roles
from .calibration import HISTORY, VERDICT, supplier_ratings
from .panels import BUCKETS, _score_sql
from .registry import query

R = lambda x, n=6: F.round(x, n)

_Z = ["z_quality", "z_value", "z_momentum", "z_lowrisk"]
FEATURES = "as_of date, symbol long, industry long, z_quality double, z_value double, z_momentum double, z_lowrisk double, buckets_known int, vol_60 double, ps double"


def built_features(spark, sf_dir) -> DataFrame:
    """Bucket scores of suppliers as a table of slices, built in two runs of which the second makes what the first left out."""
    months = written(roles.supplier_months(spark, sf_dir))  # the dates and both runs read it
    dates = months.select("as_of").distinct()

    def make(todo: DataFrame) -> DataFrame:
        some = written(months.join(F.broadcast(todo), "as_of"))
        found = cross_section.bucket_scores(some, ["as_of"], "symbol", "industry")
        return found.drop("industry").join(some.select("as_of", "symbol", "industry", (1 + F.col("vol_250")).alias("vol_60")), ["as_of", "symbol"])

    path, schema = shared_folder(spark), StructType.fromDDL(FEATURES)
    builds.build_slices(make, dates.where("as_of < date'1997-01-01'"), path, schema)
    return builds.build_slices(make, dates, path, schema)


_KNOWN = " + ".join(f"CASE WHEN {z} IS NULL THEN 0 ELSE 1 END" for z in _Z)


@query(f"WITH {BUCKETS} SELECT as_of, symbol, industry, {', '.join(f'round({z}, 4) AS {z}' for z in _Z)}, CAST({_KNOWN} AS INTEGER) AS buckets_known, CAST(NULL AS DOUBLE) AS ps FROM buckets JOIN supplier_months USING (as_of, symbol)")
def feature_slices(spark, sf_dir) -> DataFrame:
    """The features table as it stands after both runs."""
    return built_features(spark, sf_dir).select("as_of", "symbol", "industry", *[R(z, 4).alias(z) for z in _Z], "buckets_known", "ps")


@query(f"""WITH {BUCKETS}, scored AS (SELECT as_of, symbol, CASE WHEN {_KNOWN} >= 2 THEN {_score_sql(selection.LONG_WEIGHTS["base"])} END AS score FROM buckets)
SELECT as_of, symbol, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS INTEGER) AS rank, count(*) OVER (PARTITION BY as_of) AS universe_size FROM scored WHERE score IS NOT NULL""")
def rank_slices(spark, sf_dir) -> DataFrame:
    """Ranks of all dates, made from the features table and written as slices; held names and weights, which SQL lacks, are tested by hand."""
    features = built_features(spark, sf_dir).withColumn("fit", F.col("buckets_known") >= 2)
    columns = "as_of date, sleeve string, variant string, symbol long, score double, rank int, universe_size long, held boolean, weight double, regime string"
    make = lambda todo: builds.rank_table(features.join(F.broadcast(todo), "as_of"), "L", "base", selection.LONG_WEIGHTS["base"], n=20, fit="fit")
    found = builds.build_slices(make, features.select("as_of", F.lit("L").alias("sleeve")), shared_folder(spark), StructType.fromDDL(columns), by=("sleeve", "as_of"), resume=False)
    return found.select("as_of", "symbol", R("score", 4).alias("score"), "rank", "universe_size")


HORIZONS = [12, 36]

_SAID = f"{HISTORY}, said AS (SELECT as_of, symbol, {VERDICT} AS verdict FROM ratings WHERE variant = 'base' AND rated)"
_LEDGER = f"""{_SAID}, lagged AS (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS before FROM (SELECT DISTINCT as_of FROM said)
), spans AS (SELECT unnest([12, 36]) AS horizon
), turned AS (
    SELECT a.as_of, a.symbol, horizon, b.close * CASE WHEN a.no + horizon - b.no > 5 THEN 0.99 ELSE 1 END / a.close - 1 AS fwd, a.no + horizon - b.no > 5 AS gone
    FROM px a, spans JOIN cal e ON e.no = a.no + horizon JOIN px b ON b.symbol = a.symbol AND b.no <= a.no + horizon AND a.no + horizon < b.nxt
), market AS (SELECT a.as_of, horizon, b.close / a.close - 1 AS bench FROM idx a, spans JOIN idx b ON b.no = a.no + horizon
), led AS (
    SELECT s.symbol, s.as_of, spans.horizon, s.verdict, p.verdict AS verdict_before, CASE WHEN t.fwd IS NULL THEN 'pending' WHEN gone THEN 'delisted' WHEN t.fwd > bench THEN 'hit' ELSE 'miss' END AS outcome, t.fwd - bench AS excess
    FROM said s JOIN lagged l ON l.as_of = s.as_of CROSS JOIN spans LEFT JOIN said p ON p.symbol = s.symbol AND p.as_of = l.before
    LEFT JOIN turned t ON t.symbol = s.symbol AND t.as_of = s.as_of AND t.horizon = spans.horizon LEFT JOIN market m ON m.as_of = s.as_of AND m.horizon = spans.horizon
)"""


def published(spark, sf_dir) -> DataFrame:
    """The ledger after two publications and two maturings: each adds what the one before could not know."""
    ratings, prices, index = supplier_ratings(spark, sf_dir)
    ratings = written(ratings.withColumns({"engine": F.lit("r1"), "dci": F.col("coverage")}))
    prices, index = written(prices), written(index)
    calendar = asof.sessions(index)
    book = ledger.publish(ratings.where("as_of < date'1998-01-01'"), None, HORIZONS)
    book = written(ledger.mature(book, prices, index, calendar, HORIZONS, today="1999-06-30"))
    book = book.unionByName(ledger.publish(ratings, book, HORIZONS))
    return written(ledger.mature(book, prices, index, calendar, HORIZONS))


@query(f"WITH {_LEDGER} SELECT symbol, as_of, CAST(horizon AS INTEGER) AS horizon, verdict, verdict_before, outcome, round(excess, 6) + 0 AS excess FROM led")
def rating_ledger(spark, sf_dir) -> DataFrame:
    """Every published rating, the one before, and how it turned out after 12 and 36 months."""
    return published(spark, sf_dir).select("symbol", "as_of", "horizon", "verdict", "verdict_before", "outcome", (R("excess") + 0.0).alias("excess"))


@query(f"""WITH {_LEDGER}, t AS (SELECT horizon, verdict, count(*) AS n, avg(excess) AS m, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0 END) AS h FROM led WHERE outcome <> 'pending' GROUP BY ALL)
SELECT CAST(horizon AS INTEGER) AS horizon, verdict, n, round(m, 6) + 0 AS mean_excess, round(h, 6) AS hit_rate, n >= 20 AS quotable FROM t QUALIFY sum(n) OVER (PARTITION BY horizon) >= 100""")
def rating_ledger_report(spark, sf_dir) -> DataFrame:
    """How the verdicts of the ledger did, a row a tier and horizon."""
    found = ledger.report(published(spark, sf_dir))
    return found.select("horizon", "verdict", "n", (R("mean_excess") + 0.0).alias("mean_excess"), R("hit_rate").alias("hit_rate"), "quotable")


@query(f"""WITH {_SAID}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM said)
SELECT symbol, as_of, verdict, CAST(place AS INTEGER) AS place FROM k WHERE place <= 24""")
def recent_verdicts(spark, sf_dir) -> DataFrame:
    """The last 24 verdicts of each supplier, newest first."""
    ratings, _, _ = supplier_ratings(spark, sf_dir)
    rated = ratings.where("variant = 'base' and status = 'RATED'").withColumn("engine", F.lit("r1"))
    return ledger.verdict_history(rated).select("symbol", "as_of", "verdict", F.col("place").cast("int").alias("place"))


_RANK = "list_position(['SELL', 'TRIM', 'HOLD', 'SPECULATIVE_BUY', 'CONVICTION_BUY'], {})"


@query(f"""WITH {_SAID}, d AS (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS before FROM (SELECT DISTINCT as_of FROM said))
SELECT a.as_of, a.symbol, b.verdict AS verdict_before, a.verdict, CASE WHEN {_RANK.format('a.verdict')} > {_RANK.format('b.verdict')} THEN 'up' ELSE 'down' END AS direction
FROM said a JOIN d USING (as_of) JOIN said b ON b.symbol = a.symbol AND b.as_of = before WHERE a.verdict <> b.verdict""")
def verdict_change_digest(spark, sf_dir) -> DataFrame:
    """For every date the names whose verdict differs from the one of the date before."""
    ratings, _, _ = supplier_ratings(spark, sf_dir)
    rated = ratings.where("variant = 'base' and status = 'RATED'")
    return verdict_changes(rated).select("as_of", "symbol", "verdict_before", "verdict", "direction")


#: Filings of nations' quarters: what the three runs hand in. The second has later filings, some with other values; the third is the first once more.
_STATED = {0: ("Crores", 1.0), 1: ("Lakhs", 0.01), 2: ("Absolute", 1e-7), 3: ("Lakhs", 1e-7)}


def filed_quarters(spark, sf_dir, run: int) -> tuple[DataFrame, DataFrame]:
    """(facts, statements): each quarter of a hundred groups of customers as a filing at one of four scales; the fourth states a wrong one."""
    orders = roles.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("period_end"), "o_totalprice")
    q = orders.groupBy("k", "period_end").agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count("*").cast("double").alias("orders"))
    statements = q.select("k", F.col("k").alias("symbol"), "period_end", F.lit("pl_q").alias("stmt"), F.lit("sales").alias("line_item"), F.col("sales").alias("value"))
    way = F.col("k") % 4
    stated = F.element_at(F.create_map(*[F.lit(x) for k, (word, _) in _STATED.items() for x in (k, word)]), way)
    scale = F.element_at(F.create_map(*[F.lit(x) for k, (_, s) in _STATED.items() for x in (k, s)]), way)
    changed = F.when((F.lit(run) == 2) & (F.month("period_end") == 6), 100.0).otherwise(0.0)
    filed = q.where("k % 5 <> 0") if run == 2 else q
    value = lambda tag, unit, v: F.struct(F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), v.alias("value"))
    each = F.explode(F.array(value("RevenueFromOperations", "INR", (F.col("sales") + changed) / scale), value("Orders", "pure", F.col("orders"))))
    later = F.to_timestamp(F.date_add("period_end", 30 if run != 2 else 400))
    facts = filed.select(
        F.concat_ws("-", F.lit("f" if run != 2 else "g"), "k", "period_end").alias("path"), F.col("k").alias("symbol"), F.lit("standalone").alias("basis"), later.alias("filed_at"), stated.alias("rounding"), each.alias("x"),
        F.trunc("period_end", "quarter").alias("period_start"), "period_end", F.lit("Q").alias("kind"), F.lit("").alias("dims"), F.lit(None).cast("string").alias("text"),
    )
    return facts.select("*", "x.*").drop("x"), statements


def loaded_folder(spark, sf_dir) -> str:
    folder = shared_folder(spark)
    for run in (1, 2, 3):
        facts, statements = filed_quarters(spark, sf_dir, run)
        filings.load_filings(written(filings.scaled(filings.named(facts), statements)), folder)
    return folder


_FILED = """q AS (SELECT o_custkey % 100 AS k, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, round(sum(o_totalprice), 2) AS sales, count(*) AS orders FROM orders GROUP BY ALL)"""


@query(f"""WITH {_FILED} SELECT k AS symbol, period_end, 'RevenueFromOperations' AS tag, 'revenue' AS item, round(sales, 2) AS value, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 ELSE 1e-7 END AS scale, k % 4 = 3 AS scale_inferred FROM q
UNION ALL SELECT k, period_end, 'Orders', NULL, CAST(orders AS DOUBLE), CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 ELSE 1e-7 END, k % 4 = 3 FROM q""")
def loaded_facts(spark, sf_dir) -> DataFrame:
    """The facts as first filed, scaled, after three loads of which the last repeats the first."""
    facts = filings.loaded(spark, loaded_folder(spark, sf_dir), "facts")
    return facts.select("symbol", "period_end", "tag", "item", R("value", 2).alias("value"), "scale", "scale_inferred")


@query(f"""WITH {_FILED} SELECT k AS symbol, period_end, 'RevenueFromOperations' AS tag, round(sales + 100, 2) AS value, 'g-' || k || '-' || period_end AS path FROM q WHERE month(period_end) = 6 AND k % 5 <> 0""")
def loaded_revisions(spark, sf_dir) -> DataFrame:
    """Values that a later filing changed: logged once, the facts stay."""
    return filings.loaded(spark, loaded_folder(spark, sf_dir), "revisions").select("symbol", "period_end", "tag", R("value", 2).alias("value"), "path")


@query(f"""WITH {_FILED} SELECT 'f-' || k || '-' || period_end AS path, period_end, CAST(2 AS BIGINT) AS facts, k % 4 = 3 AS scale_inferred, false AS revised FROM q
UNION ALL SELECT 'g-' || k || '-' || period_end, period_end, 2, k % 4 = 3, month(period_end) = 6 FROM q WHERE k % 5 <> 0""")
def loaded_filings(spark, sf_dir) -> DataFrame:
    """A row a filing: what it held, how it was scaled, whether it revised anything."""
    return filings.loaded(spark, loaded_folder(spark, sf_dir), "filings").select("path", "period_end", "facts", "scale_inferred", "revised")
