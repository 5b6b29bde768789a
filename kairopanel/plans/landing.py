"""Queries that land files and answers made of the tables, read them back and give typed rows; and metrics of holdings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acceptance, ownership
from ..sources import feeds, landed
from ..sources.scratch import shared_folder
from . import roles
from .registry import query

R = lambda x, n=6: F.round(x, n)


def _answers(rows: DataFrame, fields: dict, keys: list, wrap: bool = False) -> DataFrame:
    """Rows as the answers of a feed, arrays of objects for each key, written as text files and read again; one more answer is no JSON.

    A key's rows are cut into answers by a hash, some 1,000 rows each where a key is busy: Spark's readers take no text of 20 MB in a JSON file.
    """
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    items = rows.groupBy(*keys, F.pmod(F.xxhash64(*rows.columns), F.lit(max(16, most // 1000 + 1))).alias("__part")).agg(F.collect_list(F.struct(*[e.alias(n) for n, e in fields.items()])).alias("x"))
    body = F.to_json(F.struct(F.col("x").alias("data"))) if wrap else F.to_json("x")
    path = shared_folder(rows.sparkSession)
    held = items.select(*[k.alias(f"k{i}") if not isinstance(k, str) else F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], body.alias("body"))
    odd = held.limit(1).withColumn("body", F.lit('"no data"'))
    held.unionByName(odd).write.json(path)
    return rows.sparkSession.read.schema("k0 string, body string").json(path)


def _orders(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("d"))


@query("""SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS ex_date, 'Dividend ' || o_orderpriority AS subject, CAST(o_orderdate AS DATE) + 1 AS record_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1000.0 + o_orderkey % 7 END AS face_value, o_orderstatus AS series FROM orders WHERE o_orderkey % 5 <> 0""")
def landed_actions(spark, sf_dir) -> DataFrame:
    """Corporate actions of a JSON feed, an answer a month; some have no ex-date."""
    o = _orders(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM"))
    day = lambda c: F.date_format(c, "dd-MMM-yyyy")
    k = F.col("o_orderkey")
    bodies = _answers(o, {"symbol": F.concat(F.lit(" C"), "o_custkey"), "exDate": F.when(k % 5 != 0, day("d")).otherwise("-"), "subject": F.concat(F.lit("Dividend "), "o_orderpriority"), "recDate": day(F.date_add("d", 1)), "faceVal": F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("1,00"), (k % 7).cast("string"))), "series": F.col("o_orderstatus")}, ["month"])
    return feeds.corporate_actions(bodies)


_FILED = """o AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 200) AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Consolidated' ELSE 'Non-Consolidated' END AS consolidated,
    CAST(o_orderdate AS DATE) + INTERVAL 100 DAY + INTERVAL 1 MINUTE * (o_orderkey % 1400) AS filed, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'https://x.example/' || o_orderkey || '.xml' END AS url FROM orders)"""


def _filed(spark, sf_dir) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    end = F.last_day(F.add_months(F.trunc("d", "quarter"), 2))
    filed = F.date_add("d", 100).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1400).cast("int"), F.lit(0))
    return o.select(k.alias("k"), F.concat(F.lit("C"), (F.col("o_custkey") % 200).cast("string")).alias("symbol"), end.alias("period_end"), F.when(k % 4 == 0, " ").when(F.col("o_orderstatus") == "F", "Consolidated").otherwise("Non-Consolidated").alias("kind"), filed.alias("filed"), F.when(k % 6 == 0, "-").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string"), F.lit(".xml"))).alias("url"), F.date_format("d", "yyyy").alias("year"))


@query(f"""WITH {_FILED} SELECT symbol, period_end, consolidated, filed, url FROM o QUALIFY row_number() OVER (PARTITION BY symbol, period_end, consolidated ORDER BY filed, url NULLS LAST) = 1""")
def landed_results(spark, sf_dir) -> DataFrame:
    """The first filing of each period of a JSON feed; every third names its period in the parameters only."""
    rows = _filed(spark, sf_dir)
    day, at = (lambda c: F.date_format(c, "dd-MMM-yyyy")), F.date_format("filed", "dd-MMM-yyyy HH:mm")
    odd = F.col("k") % 3 == 0
    bodies = _answers(rows, {"symbol": F.col("symbol"), "toDate": F.when(~odd, day("period_end")), "params": F.when(odd, F.concat(day(F.date_sub("period_end", 90)), day("period_end"), F.lit("Q"))), "filingDate": F.when(F.col("k") % 2 == 0, at), "broadCastDate": at, "consolidated": F.col("kind"), "audited": F.lit("Un-Audited"), "xbrl": F.col("url")}, ["year"])
    return feeds.results(bodies).select("symbol", "period_end", "consolidated", "filed", "url")


@query(f"""WITH {_FILED} SELECT symbol, period_end, consolidated, filed, url, CAST(k AS VARCHAR) AS seq_id FROM o QUALIFY row_number() OVER (PARTITION BY symbol, period_end, consolidated ORDER BY filed, url NULLS LAST) = 1""")
def landed_integrated_results(spark, sf_dir) -> DataFrame:
    """The same of the newer feed, whose rows lie below a name."""
    rows = _filed(spark, sf_dir)
    at = F.date_format("filed", "dd-MMM-yyyy HH:mm:ss")
    bodies = _answers(rows, {"symbol": F.col("symbol"), "qe_Date": F.date_format("period_end", "dd-MMM-yyyy"), "broadcast_Date": F.when(F.col("k") % 2 == 0, at), "creation_Date": at, "consolidated": F.col("kind"), "audited": F.lit("Audited"), "xbrl": F.when(F.col("k") % 5 != 0, F.col("url")), "ixbrl": F.col("url"), "seq_Id": F.col("k").cast("string"), "type_Sub": F.lit("Original")}, ["year"], True)
    return feeds.integrated_results(bodies).select("symbol", "period_end", "consolidated", "filed", "url", "seq_id")


@query("""SELECT DATE '2024-03-28' AS as_of, 'S' || s_suppkey AS symbol, ['ASM_LT', 'ASM_ST', 'GSM', 'ESM'][1 + s_suppkey % 4] AS list_name, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 + s_suppkey % 4 END AS INTEGER) AS stage FROM supplier""")
def landed_surveillance(spark, sf_dir) -> DataFrame:
    """Three reports, in several answers each, with stages in words, roman and other numbers."""
    s = roles.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    k = F.col("s_suppkey")
    roman = F.element_at(F.array(*[F.lit(v) for v in ("I", "II", "III", "IV")]), (1 + k % 4).cast("int"))
    number = (1 + k % 4).cast("string")
    stage = F.when(k % 7 == 0, "none").when(k % 3 == 0, F.concat(F.lit("Stage "), roman)).when(k % 3 == 1, F.concat(F.lit("LT - "), roman, F.lit(" (x)"))).otherwise(F.concat(F.lit("stage  "), number))
    one = lambda m, field: F.collect_list(F.when(k % 4 == m, F.struct(F.col("symbol").alias("symbol"), F.when(k % 2 == 0, stage).alias(field), stage.alias("survCode"))))
    lists = s.groupBy(F.pmod(F.xxhash64("s_suppkey"), F.lit(16))).agg(one(0, "asmSurvIndicator").alias("lt"), one(1, "asmSurvIndicator").alias("st"), one(2, "gsmStage").alias("g"), one(3, "esmSurvIndicator").alias("e"))
    asm = F.to_json(F.struct(F.struct(F.col("lt").alias("data")).alias("longterm"), F.struct(F.col("st").alias("data")).alias("shortterm")))
    bodies = lists.select(F.explode(F.array(*[F.struct(F.lit(r).alias("report"), b.alias("body")) for r, b in (("asm", asm), ("gsm", F.to_json("g")), ("esm", F.to_json("e")))])).alias("x")).select("x.*", F.lit("2024-03-28").cast("date").alias("as_of"))
    path = shared_folder(spark)
    bodies.write.parquet(path)
    return feeds.surveillance_lists(spark.read.parquet(path))


@query("""SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR AS ann_dt, o_orderpriority AS subject, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE repeat('word ', CAST(o_orderkey % 300 AS INTEGER))[1:1000] END AS details, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://a.example/' || o_orderkey || '.pdf' END AS url FROM orders""")
def landed_announcements(spark, sf_dir) -> DataFrame:
    """Announcements of a JSON feed, an answer a name; texts are cut."""
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    rows = o.withColumn("symbol", F.concat(F.lit("C"), "o_custkey"))
    bodies = _answers(rows, {"an_dt": F.concat(F.date_format("d", "dd-MMM-yyyy"), F.lit(" 09:00:00")), "desc": F.col("o_orderpriority"), "attchmntText": F.when(k % 4 != 0, F.repeat(F.lit("word "), (k % 300).cast("int"))), "attchmntFile": F.when(k % 3 != 0, F.concat(F.lit("https://a.example/"), k.cast("string"), F.lit(".pdf"))).otherwise("")}, ["symbol"])
    return feeds.announcements(bodies.withColumnRenamed("k0", "symbol")).select("symbol", "ann_dt", "subject", "details", "url")


@query("""SELECT 'C' || o_custkey AS symbol, 'annual_report' AS kind, 'https://r.example/' || o_orderkey AS url, 'FY' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) AS period, CAST(o_orderdate AS DATE) AS visible_from FROM orders WHERE o_orderkey % 2 = 0""")
def landed_annual_reports(spark, sf_dir) -> DataFrame:
    """Annual reports of a JSON feed; those without a file are left out."""
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    rows, at = o.withColumn("symbol", F.concat(F.lit("C"), "o_custkey")), F.concat(F.date_format("d", "dd-MMM-yyyy"), F.lit(" 10:00:00"))
    bodies = _answers(rows, {"fileName": F.when(k % 2 == 0, F.concat(F.lit("https://r.example/"), k.cast("string"))), "broadcast_dttm": F.when(k % 3 == 0, at), "disseminationDateTime": at, "fromYr": F.year("d").cast("string"), "toYr": (F.year("d") + 1).cast("string")}, ["symbol"], True)
    return feeds.annual_reports(bodies.withColumnRenamed("k0", "symbol")).select("symbol", "kind", "url", "period", "visible_from")


@query("""SELECT 'P' || p_partkey AS symbol, p_name[1:120] AS underlying, make_date(2000 + p_size % 20, 1 + p_size % 12, 1 + p_size % 28) AS listing_date FROM part""")
def landed_etf_list(spark, sf_dir) -> DataFrame:
    """A list of funds as a CSV file with blanks around its values."""
    p, z = roles.table(spark, sf_dir, "part"), F.col("p_size")
    path = shared_folder(spark)
    p.select(F.concat(F.lit(" P"), "p_partkey").alias("Symbol"), F.concat(F.col("p_name"), F.lit("  ")).alias("Underlying Asset"), F.date_format(F.make_date(2000 + z % 20, 1 + z % 12, 1 + z % 28), "dd-MMM-yy").alias("DateofListing")).write.csv(path, header=True)
    return feeds.etf_list(landed.read_csv(spark, path))


@query("""SELECT CAST(l_shipdate AS DATE) AS trade_date, 'L' || l_orderkey || '-' || l_linenumber AS symbol, ['EQ', 'BE', 'BZ', 'SM'][1 + l_linenumber % 4] AS series, CAST(l_extendedprice AS DOUBLE) AS close, CAST(l_quantity AS BIGINT) AS volume FROM lineitem WHERE l_linenumber % 5 <> 0""")
def landed_prices(spark, sf_dir) -> DataFrame:
    """Daily prices of the old layout, a file a part, with thousands separators and series that aren't kept."""
    l, n = roles.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    series = F.when(n % 5 == 0, "N2").otherwise(F.element_at(F.array(*[F.lit(v) for v in ("EQ", "BE", "BZ", "SM")]), (1 + n % 4).cast("int")))
    price = F.format_number("l_extendedprice", 2)
    path = shared_folder(spark)
    l.select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("SYMBOL"), series.alias("SERIES"), *[price.alias(c) for c in ("OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE")], F.format_number("l_quantity", 0).alias("TOTTRDQTY"), price.alias("TOTTRDVAL"), F.upper(F.date_format("l_shipdate", "dd-MMM-yyyy")).alias("TIMESTAMP"), F.lit("-").alias("ISIN")).write.csv(path, header=True)
    return landed.prices_old(landed.read_csv(spark, path)).select("trade_date", "symbol", "series", "close", "volume")


_DATES = "dates AS (SELECT DISTINCT last_day(CAST(date_trunc('year', o_orderdate) AS DATE) + INTERVAL 5 MONTH) AS as_of FROM orders)"


def _dates(spark, sf_dir) -> DataFrame:
    return roles.table(spark, sf_dir, "orders").select(F.last_day(F.add_months(F.trunc("o_orderdate", "year"), 5)).alias("as_of")).distinct()


@query(f"""WITH {_DATES}, h AS (SELECT o_custkey % 150 AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CASE o_orderpriority WHEN '1-URGENT' THEN 'promoters' WHEN '2-HIGH' THEN 'fii' WHEN '3-MEDIUM' THEN 'dii' ELSE 'public' END AS holder, max(o_totalprice) / 10000 AS pct FROM orders GROUP BY ALL),
w AS (SELECT as_of, symbol, period_end, max(pct) FILTER (WHERE holder = 'promoters') AS p, max(pct) FILTER (WHERE holder = 'fii') + max(pct) FILTER (WHERE holder = 'dii') AS i FROM h JOIN dates ON period_end + 21 <= as_of GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY as_of, symbol ORDER BY period_end DESC) AS k FROM w)
SELECT as_of, symbol, round(max(p) FILTER (WHERE k = 1), 6) AS promoter_pct, round(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 5), 6) AS promoter_chg_1y, round(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 13), 6) AS promoter_chg_3y, round(max(i) FILTER (WHERE k = 1) - max(i) FILTER (WHERE k = 5), 6) AS inst_chg_1y FROM k WHERE k <= 13 GROUP BY ALL""")
def holder_changes(spark, sf_dir) -> DataFrame:
    """What was known of each name's holders on each date, and how it changed."""
    o = _orders(spark, sf_dir)
    holder = F.when(F.col("o_orderpriority") == "1-URGENT", "promoters").when(F.col("o_orderpriority") == "2-HIGH", "fii").when(F.col("o_orderpriority") == "3-MEDIUM", "dii").otherwise("public")
    h = o.groupBy((F.col("o_custkey") % 150).alias("symbol"), F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("period_end"), holder.alias("holder")).agg((F.max("o_totalprice") / 10000).alias("pct")).withColumn("visible_from", F.date_add("period_end", 21))
    found = ownership.holder_changes(h, _dates(spark, sf_dir))
    return found.select("as_of", "symbol", *[R(c).alias(c) for c in ("promoter_pct", "promoter_chg_1y", "promoter_chg_3y", "inst_chg_1y")])


@query(f"""WITH {_DATES}, p AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS period_end, max(o_totalprice) / 5000 AS pct FROM orders GROUP BY ALL), n AS (SELECT as_of, symbol, arg_max(pct, period_end) AS now FROM p JOIN dates ON period_end <= as_of GROUP BY ALL), b AS (SELECT as_of, symbol, arg_max(pct, period_end) AS before FROM p JOIN dates ON period_end <= as_of - 365 GROUP BY ALL)
SELECT as_of, symbol, round(now, 6) AS pledged_pct_of_promoter, round(now - before, 6) AS pledge_delta_4q FROM n LEFT JOIN b USING (as_of, symbol)""")
def pledges(spark, sf_dir) -> DataFrame:
    p = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("symbol"), F.col("d").alias("period_end")).agg((F.max("o_totalprice") / 5000).alias("pledged_pct"))
    found = ownership.pledges(p, _dates(spark, sf_dir))
    return found.select("as_of", "symbol", R("pledged_pct_of_promoter").alias("pledged_pct_of_promoter"), R("pledge_delta_4q").alias("pledge_delta_4q"))


@query(f"""WITH {_DATES} SELECT as_of, o_custkey AS symbol, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN -o_totalprice END) / (1e6 + o_custkey), 9) AS insider_net_buy_12m FROM orders JOIN dates ON CAST(o_orderdate AS DATE) <= as_of AND CAST(o_orderdate AS DATE) > as_of - 365 GROUP BY as_of, o_custkey""")
def insider_net_buys(spark, sf_dir) -> DataFrame:
    """What insiders bought less what they sold in a year, over the market value."""
    o, k, dates = _orders(spark, sf_dir), F.col("o_orderkey"), _dates(spark, sf_dir)
    trades = o.select(F.col("o_custkey").alias("symbol"), F.col("d").alias("trade_date"), F.when(k % 3 == 0, "Buy").when(k % 3 == 1, "SELL").otherwise("Pledge").alias("side"), F.col("o_totalprice").alias("value"))
    mcaps = trades.select("symbol").distinct().crossJoin(F.broadcast(dates)).withColumn("mcap", 1e6 + F.col("symbol"))
    return ownership.insider_net_buy(trades, dates, mcaps).select("as_of", "symbol", R("insider_net_buy_12m", 9).alias("insider_net_buy_12m"))


@query(f"""WITH {_DATES}, a AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 - 2 AS notches, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Negative' ELSE 'Stable' END AS outlook FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1)
SELECT as_of, symbol, CAST(sum(notches) AS BIGINT) AS rating_migration_12m, arg_max(outlook, d) = 'Negative' AS outlook_negative FROM a JOIN dates ON d <= as_of AND d > as_of - 365 GROUP BY ALL""")
def rating_migrations(spark, sf_dir) -> DataFrame:
    """Notches of a year's rating actions, and whether the last outlook is negative."""
    from ..operators.asof import keep_first

    o = keep_first(_orders(spark, sf_dir), ["o_custkey", "d"], ["o_orderkey"])
    actions = o.select(F.col("o_custkey").alias("symbol"), F.col("d").alias("action_date"), (F.col("o_orderkey") % 4 - 2).alias("notches"), F.when(F.col("o_orderpriority") == "1-URGENT", "Negative").otherwise("Stable").alias("outlook"))
    return ownership.rating_migration(actions, _dates(spark, sf_dir)).select("as_of", "symbol", F.col("rating_migration_12m").cast("long").alias("rating_migration_12m"), "outlook_negative")


_WORDS = ["Board meeting", "SEBI Order received", "Auditor resigns", "Press release", "Import Alert by the authority", "Newspaper advertisement", "NCLT hearing", "Change of address"]


@query(f"""WITH {_DATES}, a AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 IN (1, 2, 4, 6) AS bad FROM orders), b AS (SELECT symbol, min(d) AS first FROM a GROUP BY 1)
SELECT as_of, b.symbol AS symbol, CAST(NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND bad AND d <= as_of AND d >= as_of - 90) AS DOUBLE) AS adverse_events_90d_clean FROM b JOIN dates ON first <= as_of""")
def adverse_events(spark, sf_dir) -> DataFrame:
    """Whether a name's announcements of 90 days are free of adverse words."""
    o = _orders(spark, sf_dir)
    subject = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (1 + F.col("o_orderkey") % 8).cast("int"))
    rows = o.select(F.col("o_custkey").alias("symbol"), F.col("d").alias("ann_dt"), subject.alias("subject"), F.lit(None).cast("string").alias("details"))
    return ownership.adverse_events(rows, _dates(spark, sf_dir))


_QUARTERS = """q AS (SELECT o_custkey % 100 AS k, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS sales, count(*) AS orders FROM orders GROUP BY ALL)"""


def _quarters(spark, sf_dir) -> DataFrame:
    rows = _orders(spark, sf_dir).groupBy((F.col("o_custkey") % 100).alias("k"), F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count("*").alias("orders"))
    return rows


@query(f"""WITH {_QUARTERS} SELECT k AS page_id, 'quarters' AS stmt, period_end, 'net_sales_pct' AS line_item, sales AS value FROM q UNION ALL SELECT k, 'quarters', period_end, 'orders_and_more', CAST(orders AS DOUBLE) FROM q WHERE orders % 5 <> 0""")
def landed_page_statements(spark, sf_dir) -> DataFrame:
    """Statements of pages: tables with a column a period, labels with marks, separators and missing cells; a page a company."""
    from ..sources import documents

    rows = _quarters(spark, sf_dir)
    cell = lambda x: F.concat(F.lit("<td> "), x, F.lit("</td>"))
    held = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("period_end", "sales", "orders"))).alias("x"))
    row = lambda label, f: F.concat(F.lit(f"<tr><td>{label}</td>"), F.array_join(F.transform("x", f), ""), F.lit("</tr>\n"))
    heads = F.concat(F.lit("<tr><th></th>"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("<th>"), F.date_format(r["period_end"], "MMM yyyy"), F.lit("</th>"))), ""), F.lit("</tr>"))
    html = F.concat(F.lit("<html><body><p>text</p><section id='quarters'><table>"), heads, row("Net Sales %", lambda r: cell(F.format_number(r["sales"], 2))), row("Orders &amp; more", lambda r: cell(F.when(r["orders"] % 5 == 0, "-").otherwise(r["orders"].cast("string")))), F.lit("</table></section></body></html>"))
    path = shared_folder(spark)
    held.select(F.col("k").alias("page_id"), html.alias("html")).write.parquet(path)
    cells = documents.page_cells(spark.read.parquet(path))
    return documents.page_statements(cells)


@query(f"""WITH {_QUARTERS} SELECT k, 'Revenue' AS tag, CAST(date_trunc('quarter', period_end) AS DATE) AS period_start, period_end, 'Q' AS kind, '' AS dims, -2 AS decimals, sales AS value FROM q UNION ALL SELECT k, 'Orders', NULL, period_end, 'I', 'Segment=A' || k % 3, 0, CAST(orders AS DOUBLE) FROM q""")
def landed_filings(spark, sf_dir) -> DataFrame:
    """Facts of XML filings with contexts of spans and instants and a dimension; a file a company."""
    from ..sources import documents

    held = _quarters(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("period_end", "sales", "orders"))).alias("x"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    n = lambda r: day(r["period_end"])
    contexts = F.transform("x", lambda r: F.concat(
        F.lit('<context id="D'), n(r), F.lit('"><period><startDate>'), day(F.trunc(r["period_end"], "quarter")), F.lit("</startDate><endDate>"), n(r), F.lit('</endDate></period></context><context id="I'), n(r),
        F.lit('"><scenario><explicitMember dimension="x:Segment">x:A'), (F.col("k") % 3).cast("string"), F.lit("</explicitMember></scenario><period><instant>"), n(r), F.lit("</instant></period></context>"),
    ))
    facts = F.transform("x", lambda r: F.concat(F.lit('<x:Revenue contextRef="D'), n(r), F.lit('" unitRef="u" decimals="-2">'), F.format_number(r["sales"], 2), F.lit('</x:Revenue><x:Orders contextRef="I'), n(r), F.lit('" decimals="0">'), r["orders"].cast("string"), F.lit("</x:Orders>")))
    xml = F.concat(F.lit('<xbrl xmlns:x="urn:x"><unit id="u"><measure>iso:INR</measure></unit>'), F.array_join(contexts, ""), F.array_join(facts, ""), F.lit("</xbrl>"))
    path = shared_folder(spark)
    held.select(F.col("k").cast("string").alias("path"), xml.cast("binary").alias("content")).write.parquet(path)
    return documents.filings(spark.read.parquet(path)).select(F.col("path").cast("long").alias("k"), "tag", "period_start", "period_end", "kind", "dims", "decimals", "value")


@query("""SELECT year(o_orderdate) AS year, round(quantile_cont(o_totalprice / (10000 + 500 * (o_custkey % 100)), 0.5), 6) AS p50, round(quantile_cont(o_totalprice / (10000 + 500 * (o_custkey % 100)), 0.9), 6) AS p90 FROM orders WHERE o_custkey % 100 <> 7 GROUP BY 1""")
def order_capacity(spark, sf_dir) -> DataFrame:
    """How much of a day's turnover orders take, a year; of some names none is known."""
    adv = F.when(F.col("o_custkey") % 100 != 7, 10000.0 + 500 * (F.col("o_custkey") % 100))
    o = _orders(spark, sf_dir).select(F.year("d").alias("year"), F.col("o_totalprice").alias("value"), adv.alias("adv"))
    return acceptance.capacity(o, ["year"]).select("year", R("p50").alias("p50"), R("p90").alias("p90"))


@query("""WITH m AS (SELECT p_brand AS k, avg(p_retailprice) / 1500 AS ic, avg(p_size) / 100 AS b, corr(p_size, p_retailprice) AS c, CASE WHEN min(p_size) = 1 THEN NULL ELSE max(p_size) / 60.0 END AS h FROM part GROUP BY 1), x AS (
    SELECT k, unnest([ic >= 0.05, b <= 0.24, abs(c) <= 0.10, h >= 0.60]) AS p FROM m UNION ALL SELECT k, NULL FROM m, range(19))
SELECT k, CAST(count(*) FILTER (WHERE p) AS BIGINT) AS n_pass, CAST(count(*) FILTER (WHERE NOT p) AS BIGINT) AS n_fail, CAST(count(*) FILTER (WHERE p IS NULL) AS BIGINT) AS n_unknown, 'NOT VALIDATED' AS verdict FROM x GROUP BY k""")
def acceptance_verdicts(spark, sf_dir) -> DataFrame:
    """Checks of statistics of brands against the bars of a calibration; most of their statistics are unknown."""
    m = roles.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(
        (F.avg("p_retailprice") / 1500).alias("ic_mean"), (F.avg("p_size") / 100).alias("brier"), F.corr("p_size", "p_retailprice").alias("score_coverage_corr"), F.when(F.min("p_size") != 1, F.max("p_size") / 60.0).alias("hit_conviction_buy"))
    found = acceptance.verdicts(acceptance.checked(m, ["k"], acceptance.CALIBRATION), ["k"])
    return found.select("k", "n_pass", "n_fail", "n_unknown", "verdict")


@query("""WITH t AS (SELECT o_orderpriority AS sleeve, unnest(['N' || o_custkey % 40, 'T' || o_orderkey % 30]) AS k FROM orders) SELECT sleeve, CAST(count(DISTINCT k) AS BIGINT) AS trials FROM t WHERE k NOT IN ('N1', 'T2') GROUP BY 1""")
def distinct_trials(spark, sf_dir) -> DataFrame:
    """Different keys of all trials of a sleeve, but for two of them."""
    t = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("sleeve"), F.array(F.concat(F.lit("N"), (F.col("o_custkey") % 40).cast("string")), F.concat(F.lit("T"), (F.col("o_orderkey") % 30).cast("string"))).alias("grid"))
    return acceptance.distinct_trials(t, ["sleeve"], but=["N1", "T2"])


@query("""WITH r AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part), e AS (SELECT *, round(1 - rank / n, 3) AS pct, [f FOR f IN [CASE WHEN p_size % 10 = 1 THEN 'GSM' END, CASE WHEN p_size / 10.0 < 1.1 THEN 'ALTMAN_DISTRESS' END, CASE WHEN p_size * 6 > 200 THEN 'STALE_STATEMENTS' END, CASE WHEN p_size % 7 = 0 THEN 'NOT_RANKABLE' END] IF f IS NOT NULL] AS fl FROM r),
p AS (SELECT *, CASE WHEN len(fl) > 0 THEN 0 ELSE round(3.0 * greatest(0, (pct - 0.5) / 0.5), 2) END AS pts FROM e) SELECT p_partkey, pct, array_to_string(fl, ',') AS flags, pts AS points, CASE WHEN pts >= 2.1 THEN 'PASS' WHEN pts > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM p""")
def evidence_lines(spark, sf_dir) -> DataFrame:
    """Of every part its rank among its brand as evidence, what warns of it, and the points that it earns."""
    from pyspark.sql import Window

    p, z = roles.table(spark, sf_dir, "part"), F.col("p_size")
    brand = Window.partitionBy("p_brand")
    rank = F.row_number().over(brand.orderBy(F.desc("p_retailprice"), "p_partkey"))
    rows = p.select("p_partkey", F.round(1 - rank / F.count("*").over(brand), 3).alias("pct"), (z % 10 == 1).cast("int").alias("in_gsm"), (z / 10).alias("altman_zpp"), (z * 6).alias("stmt_age_days"), (z % 7 != 0).cast("int").alias("rankable"))
    rows = rows.withColumn("flags", acceptance.evidence_flags(rows.columns)).withColumn("e", acceptance.evidence_points(F.col("pct"), F.col("flags")))
    return rows.select("p_partkey", "pct", F.array_join("flags", ",").alias("flags"), "e.points", "e.status")
