import datetime as dt

from kairopanel.streaming import jobs

T = lambda day, hour=0: dt.datetime(2024, 1, day, hour)


def test_late_facts_are_revisions_and_never_the_fact(spark, tmp_path):
    schema = "fact string, value double, filed timestamp, arrived timestamp"
    batches = [
        [("a", 5.0, T(3), T(10)), ("b", 1.0, T(1), T(10))],
        [("a", 4.0, T(2), T(10, 6)), ("b", 1.0, T(2), T(10, 7))],  # filed earlier, come later, while the fact is open
        [("c", 7.0, T(1), T(12))],  # a day has passed: a and b close
        [("a", 3.0, T(1), T(13)), ("a", 5.0, T(4), T(13)), ("b", 2.0, T(1), T(13))],  # too late to be first, whatever they say
        [("a", 3.0, T(1), T(14)), ("z", 0.0, T(1), T(20))],
        [("z", 9.0, T(1), T(28))],
    ]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4, 5):  # three runs, each with what has come by then
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            found = jobs.first_filed(stream, "fact", "value", "filed", "arrived")
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(180)
    said = sorted((r["fact"], r["event"], r["value"]) for r in spark.read.parquet(out).collect())
    assert said == [("a", "new", 4.0), ("a", "revision", 3.0), ("a", "revision", 5.0), ("b", "new", 1.0), ("b", "revision", 2.0), ("c", "new", 7.0), ("z", "new", 0.0), ("z", "revision", 9.0)]


def test_loads_read_the_slices_they_touch(spark, tmp_path):
    schema = "k int, year int, v string"
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    for rows in ([(1, 2020, "a"), (2, 2021, "b")], [(1, 2020, "later"), (3, 2021, "c"), (3, 2021, "c")], [(4, 2022, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.load_new(spark.readStream.schema(schema).parquet(source), table, ["k", "year"], check, by=["year"]).awaitTermination(180)
    assert sorted((r["k"], r["year"], r["v"]) for r in spark.read.parquet(table).collect()) == [(1, 2020, "a"), (2, 2021, "b"), (3, 2021, "c"), (4, 2022, "d")]
