"""Role tables on the given tables: what the operators need, built by joins and groupings, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import densify, keep_first, last_session_of, sessions
from ..sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of brands: (symbol, trade_date, open, high, low, close, volume, turnover, trades)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("trade_date"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = lines.join(parts, "l_partkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "price")
    return rows.groupBy("symbol", "trade_date").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"), F.count("*").alias("trades"))


TAPE = """tape AS (
    SELECT symbol, trade_date, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, price) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, count(*) AS trades
    FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey)
    GROUP BY symbol, trade_date
), calendar AS (
    SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_no FROM (SELECT DISTINCT trade_date FROM tape)
), month_ends AS (
    SELECT max(trade_date) AS as_of FROM calendar GROUP BY date_trunc('month', trade_date)
)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape, written once: a query that also needs its calendar, spans or month ends reads lines and parts once."""
    return written(tape(spark, sf_dir))


def panel(rows: DataFrame) -> DataFrame:
    """The tape with a row for each symbol and session between its first and last one, and session_no."""
    return densify(rows, sessions(rows), "symbol")


PANEL = (
    TAPE
    + """, span AS (
    SELECT symbol, min(trade_date) AS a, max(trade_date) AS z FROM tape GROUP BY symbol
), panel AS (
    SELECT s.symbol, c.trade_date, c.session_no, t.open, t.high, t.low, t.close, t.volume, t.turnover, t.trades
    FROM span s JOIN calendar c ON c.trade_date BETWEEN s.a AND s.z LEFT JOIN tape t ON t.symbol = s.symbol AND t.trade_date = c.trade_date
)"""
)


def month_ends(rows: DataFrame) -> DataFrame:
    return last_session_of(sessions(rows), "month").select("as_of")


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, industry): the first word of the type that most parts of a brand have."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"), F.split("p_type", " ")[0].alias("industry")).count()
    return keep_first(n, ["symbol"], [F.desc("count"), "industry"]).select("symbol", "industry")


INDUSTRIES = """industries AS (
    SELECT symbol, industry FROM (SELECT p_brand AS symbol, string_split(p_type, ' ')[1] AS industry, count(*) AS n FROM part GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, industry) = 1
)"""


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section of suppliers by month: (as_of, symbol, industry: the region, and a dozen measures)."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.last_day(F.to_date("l_shipdate")).alias("as_of"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    lines = lines.repartition("l_suppkey")  # a task then holds its own groups alone, not one for nearly each row of a large split
    x = F.col("l_extendedprice")
    rows = lines.groupBy("as_of", F.col("l_suppkey").alias("symbol")).agg(
        F.sum(x).alias("turnover"), F.avg(x).alias("roe"), F.avg("l_discount").alias("roce"), F.avg("l_tax").alias("accruals"), F.max(x).alias("debt_equity"), F.min(x).alias("mom_12_1"),
        F.sum("l_quantity").alias("mom_6_1"), F.avg("l_quantity").alias("dist_52w_high"), F.try_divide(F.sum(x * F.col("l_discount")), F.sum(x)).alias("earnings_yield"), F.max("l_tax").alias("pb"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("vol_250"), F.count("*").cast("double").alias("beta_250"),
    )
    where = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_nationkey").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("industry"))), "s_nationkey")
    return rows.join(where.select("symbol", "industry"), "symbol")


SUPPLIER_MONTHS = """supplier_months AS (
    SELECT * FROM (
        SELECT last_day(CAST(l_shipdate AS DATE)) AS as_of, l_suppkey AS symbol, sum(l_extendedprice) AS turnover, avg(l_extendedprice) AS roe, avg(l_discount) AS roce, avg(l_tax) AS accruals, max(l_extendedprice) AS debt_equity,
            min(l_extendedprice) AS mom_12_1, sum(l_quantity) AS mom_6_1, avg(l_quantity) AS dist_52w_high, sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0) AS earnings_yield, max(l_tax) AS pb,
            CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS vol_250, CAST(count(*) AS DOUBLE) AS beta_250
        FROM lineitem GROUP BY ALL
    ) JOIN (SELECT s_suppkey AS symbol, n_regionkey AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey) USING (symbol)
)"""

#: Which item an order's priority stands for, and the share of its price that counts.
ITEMS = [("1-URGENT", "sales", 1.0), ("2-HIGH", "operating_profit", 0.2), ("3-MEDIUM", "net_profit", 0.1), ("4-NOT SPECIFIED", "borrowings", 0.5), ("5-LOW", "interest", 0.02)]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of nations: (symbol, basis, period_end, line_item, value, visible_from)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("symbol"))
    item = F.create_map(*[F.lit(x) for p, i, _ in ITEMS for x in (p, i)])
    share = F.create_map(*[F.lit(x) for p, _, s in ITEMS for x in (p, s)])
    rows = orders.join(who, "o_custkey").select(
        "symbol", F.when(F.col("o_orderstatus") == "F", "consolidated").otherwise("standalone").alias("basis"), F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("period_end"),
        item[F.col("o_orderpriority")].alias("line_item"), (F.col("o_totalprice") * share[F.col("o_orderpriority")]).alias("v"),
    )
    facts = rows.groupBy("symbol", "basis", "period_end", "line_item").agg(F.sum("v").alias("value"))
    return facts.withColumn("visible_from", F.date_add("period_end", F.when(F.month("period_end") == 3, 60).otherwise(45)))


STATEMENTS = """statements AS (
    SELECT *, period_end + CAST(CASE WHEN month(period_end) = 3 THEN 60 ELSE 45 END AS INTEGER) AS visible_from FROM (
        SELECT c_nationkey AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'consolidated' ELSE 'standalone' END AS basis, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
            CASE o_orderpriority {item} END AS line_item, sum(o_totalprice * CASE o_orderpriority {share} END) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
)""".format(item=" ".join(f"WHEN '{p}' THEN '{i}'" for p, i, _ in ITEMS), share=" ".join(f"WHEN '{p}' THEN {s}" for p, _, s in ITEMS))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions of brands: (symbol, ex_date, subject), picked from returned lines with round quantities."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity = 50 and l_linenumber = 1").select("l_partkey", "l_orderkey", F.to_date("l_shipdate").alias("ex_date"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), "p_size")
    subject = F.when(F.col("p_size") % 3 == 0, "Bonus 1:1").when(F.col("p_size") % 3 == 1, "Face Value Split From Rs 10 To Rs 2").otherwise("Interim Dividend - Rs 5")
    return lines.join(parts, "l_partkey").select("symbol", "ex_date", subject.alias("subject")).distinct()


ACTIONS = """actions AS (
    SELECT DISTINCT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ex_date, CASE p_size % 3 WHEN 0 THEN 'Bonus 1:1' WHEN 1 THEN 'Face Value Split From Rs 10 To Rs 2' ELSE 'Interim Dividend - Rs 5' END AS subject
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_linenumber = 1
), factors AS (
    SELECT symbol, ex_date, exp(sum(ln(CASE WHEN subject LIKE 'Bonus%' THEN 0.5 ELSE 0.2 END))) AS factor FROM actions WHERE subject NOT LIKE 'Interim%' GROUP BY ALL
)"""
