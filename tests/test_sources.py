import pytest
from pyspark.sql import functions as F

from kairopanel.plans import landing
from kairopanel.sources import documents, feeds, landed, sinks
from kairopanel.streaming import jobs


def put(path, text):
    path.write_text(text)
    return str(path)


def test_price_layouts(spark, tmp_path):
    old = landed.prices_old(landed.read_csv(spark, put(tmp_path / "old.csv", "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\nABC,EQ,10,12,9,11,11,10,100,1100.5,01-APR-2019,7,IN1,\nGLD,GS,1,1,1,1,1,1,1,1,01-APR-2019,1,IN2,\n")))
    r = old.collect()
    assert len(r) == 1 and (str(r[0]["trade_date"]), r[0]["close"], r[0]["volume"], r[0]["trades"]) == ("2019-04-01", 11.0, 100, 7) and old.columns == landed.PRICE_COLUMNS
    full = landed.prices_full(landed.read_csv(spark, put(tmp_path / "full.csv", "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER\nABC, EQ, 01-Apr-2019, 10, 10, 12, 9, 11, 11.5, 10.5, 100, 2.5, 7, -, 40.5\n"))).first()
    assert full["turnover"] == 250000 and full["deliv_qty"] is None and full["deliv_pct"] == 40.5
    best = landed.best_source([landed.prices_full(landed.read_csv(spark, str(tmp_path / "full.csv"))), old]).collect()
    assert len(best) == 1 and best[0]["source"] == "full"
    with pytest.raises(landed.MissingColumns):
        landed.prices_new(landed.read_csv(spark, str(tmp_path / "old.csv")))


def test_text_records(spark, tmp_path):
    lines = spark.read.text(put(tmp_path / "d.dat", "10,header\n20,1,ABC,EQ,100,40,40.0\n20,2,X\n"))
    assert [tuple(r) for r in landed.delivery_records(lines).collect()] == [("ABC", "EQ", 100, 40, 40.0)]
    ban = spark.read.text(put(tmp_path / "ban.csv", "Securities in Ban For Trade Date 11-SEP-2026: \n1,ABC\n2,M&M\n")).withColumn("file", F.lit("f"))
    assert sorted((str(r["as_of"]), r["symbol"]) for r in landed.ban_list(ban).collect()) == [("2026-09-11", "ABC"), ("2026-09-11", "M&M")]
    index = landed.index_closes(landed.read_csv(spark, put(tmp_path / "i.csv", "Index Name,Index Date,Closing Index Value,P/E\nNifty 50,11-09-2026,\"24,000.5\",-\n"))).first()
    assert index["close"] == 24000.5 and index["pe"] is None and index["pb"] is None


PAGE = '<section id="profit-loss"><table><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr><tr><td>Sales +</td><td>1,000</td><td>1,200</td></tr><tr><td>OPM %</td><td>20%</td><td></td></tr></table></section>'
XML = b"""<?xml version="1.0"?><x xmlns:i="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:a="urn:a">
<i:context id="c1"><i:entity><i:identifier scheme="s">A</i:identifier></i:entity><i:period><i:startDate>2024-01-01</i:startDate><i:endDate>2024-03-31</i:endDate></i:period></i:context>
<i:context id="c2"><i:entity><i:segment><d:explicitMember dimension="a:Axis">a:Part</d:explicitMember></i:segment></i:entity><i:period><i:instant>2024-03-31</i:instant></i:period></i:context>
<i:unit id="u"><i:measure>iso4217:INR</i:measure></i:unit><a:Revenue contextRef="c1" unitRef="u" decimals="-5">123400000</a:Revenue><a:Assets contextRef="c2" unitRef="u">5</a:Assets></x>"""


def test_pages_and_filings(spark):
    cells = documents.page_cells(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"))
    facts = {(str(r["period_end"]), r["line_item"]): r["value"] for r in documents.page_statements(cells).collect()}
    assert facts == {("2023-03-31", "sales"): 1000.0, ("2024-03-31", "sales"): 1200.0, ("2023-03-31", "opm_pct"): 20.0}
    files = spark.createDataFrame([("f", bytearray(XML)), ("bad", bytearray(b"<x"))], "path string, content binary")
    rows = {r["tag"]: r for r in documents.filings(files).collect()}
    assert rows["Revenue"]["kind"] == "Q" and rows["Revenue"]["value"] == 123400000 and rows["Revenue"]["unit"] == "INR" and rows["Assets"]["kind"] == "I" and rows["Assets"]["dims"] == "Axis=Part" and rows["!error"]["path"] == "bad"
    facts = documents.filings(files).where("tag <> '!error'")
    assert {r["tag"]: r["scale"] for r in documents.scaled(facts, spark.createDataFrame([("f", "Revenue", 12.34)], "path string, tag string, expected double")).collect()} == {"Revenue": 1e-7, "Assets": 1e-7}
    assert str(documents.filing_period(facts).first()["period_end"]) == "2024-03-31"


def test_upsert_and_revisions(spark):
    old = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    new = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (3, 7.0, 1)], "k int, v double, at int")
    assert sorted((r["k"], r["v"], r["s"]) for r in sinks.upserted(old, new.drop("at").where("v <> 5"), ["k"]).where("k < 3").collect()) == [(1, 6.0, "x"), (2, None, "y")]
    assert [(r["k"], r["old"], r["new"]) for r in sinks.revisions(old, new.where("v = 5").drop("at"), ["k"], "v").collect()] == [(1, 1.0, 5.0)]
    assert [r["k"] for r in sinks.absent(old, new, ["k"]).collect()] == [3]


def test_slices_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, as_of string")
    sinks.replace_slices(df, path, ["as_of"])
    sinks.replace_slices(spark.createDataFrame([(9, "b")], "v int, as_of string"), path, ["as_of"])
    assert sorted((r["v"], r["as_of"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_streams(spark, tmp_path):
    source, table, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "k long, v double"
    for rows in ([(1, 1.0), (1, 1.0), (2, 2.0)], [(2, 9.0), (3, 3.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.load_new(spark.readStream.schema(schema).parquet(source), table, ["k"], check).awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(table).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    seen = jobs.first_seen(spark.readStream.schema(schema).parquet(source), "k", "v")
    q = seen.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    events = [(r["k"], r["event"]) for r in spark.table("seen").collect()]
    assert sorted(e for e in events if e[1] == "new") == [(1, "new"), (2, "new"), (3, "new")] and [e[0] for e in events if e[1] == "revision"] == [2]


def test_answers_of_a_busy_key(spark):
    bodies = landing._answers(spark.range(60_000).withColumn("year", F.lit("2024")), {"k": F.col("id").cast("string")}, ["year"], True)
    sizes = [r[0] for r in bodies.where("body <> '\"no data\"'").select(F.size(F.from_json("body", "data array<string>")["data"])).collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2000


def test_the_least_sequence_number_of_one_moment(spark):
    one = '{"symbol":"A","qe_Date":"31-Mar-2024","creation_Date":"01-May-2024 10:00:00","seq_Id":"%s"}'
    bodies = spark.createDataFrame([('{"data":[' + ",".join(one % k for k in p) + "]}",) for p in ((100, 12), (9, 1000), (11,))], "body string")
    assert feeds.integrated_results(bodies).first()["seq_id"] == "9"


def test_landed_prices_are_compressed_and_move_once(spark):
    from kairopanel.plans import reads

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = reads.merged_prices(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert found.inputFiles() and all(f.endswith(".gz") for f in found.inputFiles())
    assert plan.count("Exchange hashpartitioning") == 2  # prices and delivery records


def test_compressed_files_are_cut(spark, tmp_path):
    landed.write_csv(spark.range(10, numPartitions=1).select(F.col("id").cast("string").alias("x")), str(tmp_path / "t"), most=4)
    assert len(list((tmp_path / "t").glob("*.csv.gz"))) == 3
    assert sorted(r["x"] for r in landed.read_csv(spark, str(tmp_path / "t")).collect()) == [str(k) for k in range(10)]
