"""Landed price, index, deal and membership files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_timestamp, lenient_number, stage_number

#: Equity series that are kept.
EQUITY_SERIES = ["EQ", "BE", "BZ", "SM", "ST"]
#: Columns of the price table.
PRICE_COLUMNS = ["trade_date", "symbol", "series", "isin", "prev_close", "open", "high", "low", "close", "last", "vwap", "volume", "turnover", "trades", "deliv_qty", "deliv_pct", "source"]
DOUBLES = {"prev_close", "open", "high", "low", "close", "last", "vwap", "turnover", "deliv_pct"}


class MissingColumns(ValueError):
    """A landed file lacks columns that its layout requires."""


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, names and values trimmed; files without a common header are read one layout at a time."""
    df = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*[c.strip() or f"_c{k}" for k, c in enumerate(df.columns)])


def write_csv(df: DataFrame, path: str, most: int = 500_000) -> None:
    """Files with a header, compressed; a compressed file is read by one task, so each has at most ``most`` rows."""
    df.write.option("maxRecordsPerFile", most).csv(path, header=True, compression="gzip")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"missing {lost}, found {df.columns}")
    return df


def aligned(df: DataFrame, schema: str | Sequence[tuple[str, str]]) -> DataFrame:
    """The columns of the schema, missing ones null, others dropped."""
    pairs = [tuple(p.strip().split(" ", 1)) for p in schema.split(",")] if isinstance(schema, str) else schema
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in pairs])


def _prices(df: DataFrame, source: str, date: Column, columns: dict[str, Column]) -> DataFrame:
    rows = df.select(date.alias("trade_date"), *[c.alias(n) for n, c in columns.items()], F.lit(source).alias("source"))
    kinds = [(c, "date" if c == "trade_date" else "string" if c in ("symbol", "series", "isin", "source") else "double" if c in DOUBLES else "bigint") for c in PRICE_COLUMNS]
    return aligned(rows.where(F.col("series").isin(EQUITY_SERIES) & F.col("close").isNotNull() & F.col("trade_date").isNotNull()), kinds)


def _numbers(names: dict[str, str]) -> dict[str, Column]:
    return {to: lenient_number(F.col(f"`{of}`")) for to, of in names.items()}


def prices_old(df: DataFrame) -> DataFrame:
    """The old daily layout."""
    require(df, ["SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL", "TIMESTAMP", "ISIN"])
    numbers = _numbers({"open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "last": "LAST", "prev_close": "PREVCLOSE", "volume": "TOTTRDQTY", "turnover": "TOTTRDVAL"})
    if "TOTALTRADES" in df.columns:
        numbers["trades"] = lenient_number(F.col("TOTALTRADES"))
    return _prices(df, "old", any_timestamp(F.initcap("TIMESTAMP")).cast("date"), {"symbol": F.trim("SYMBOL"), "series": F.trim("SERIES"), "isin": F.trim("ISIN"), **numbers})


def prices_new(df: DataFrame) -> DataFrame:
    """The newer layout: one segment, ISO dates."""
    require(df, ["TradDt", "Sgmt", "ISIN", "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "LastPric", "PrvsClsgPric", "TtlTradgVol", "TtlTrfVal"])
    numbers = _numbers({"open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "last": "LastPric", "prev_close": "PrvsClsgPric", "volume": "TtlTradgVol", "turnover": "TtlTrfVal"})
    if "TtlNbOfTxsExctd" in df.columns:
        numbers["trades"] = lenient_number(F.col("TtlNbOfTxsExctd"))
    rows = df.where(F.trim("Sgmt") == "CM")
    return _prices(rows, "new", any_timestamp(F.col("TradDt")).cast("date"), {"symbol": F.trim("TckrSymb"), "series": F.trim("SctySrs"), "isin": F.trim("ISIN"), **numbers})


def prices_full(df: DataFrame) -> DataFrame:
    """Prices with delivery; turnover comes in units of 100,000."""
    require(df, ["SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "LAST_PRICE", "CLOSE_PRICE", "AVG_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS", "NO_OF_TRADES", "DELIV_QTY", "DELIV_PER"])
    numbers = _numbers({"prev_close": "PREV_CLOSE", "open": "OPEN_PRICE", "high": "HIGH_PRICE", "low": "LOW_PRICE", "last": "LAST_PRICE", "close": "CLOSE_PRICE", "vwap": "AVG_PRICE", "volume": "TTL_TRD_QNTY", "trades": "NO_OF_TRADES", "deliv_qty": "DELIV_QTY", "deliv_pct": "DELIV_PER"})
    numbers["turnover"] = lenient_number(F.col("TURNOVER_LACS")) * 1e5
    return _prices(df, "full", any_timestamp(F.col("DATE1")).cast("date"), {"symbol": F.trim("SYMBOL"), "series": F.trim("SERIES"), **numbers})


def delivery_records(lines: DataFrame) -> DataFrame:
    """Typed records of a text table (value): those of type 20 with seven fields or more."""
    p = F.split("value", ",")
    rows = lines.select(p.alias("p")).where((F.trim(F.get("p", F.lit(0))) == "20") & (F.size("p") >= 7))
    field = lambda k: F.trim(F.get("p", F.lit(k)))
    return rows.select(field(2).alias("symbol"), field(3).alias("series"), lenient_number(field(4)).cast("long").alias("volume"), lenient_number(field(5)).cast("long").alias("deliv_qty"), lenient_number(field(6)).alias("deliv_pct"))


def merge_delivery(prices: DataFrame, delivery: DataFrame) -> DataFrame:
    """prices with delivery figures where they have none; of repeated records the largest quantity counts."""
    one = delivery.groupBy("symbol", "series").agg(F.max(F.struct("deliv_qty", "deliv_pct")).alias("__d"))
    joined = prices.join(one, ["symbol", "series"], "left")
    return joined.withColumns({c: F.coalesce(c, F.col("__d")[c]) for c in ("deliv_qty", "deliv_pct")}).select(*prices.columns)


def index_closes(df: DataFrame) -> DataFrame:
    """(trade_date, index_name, close, pe, pb, div_yield); optional columns may be missing, the smallest of repeated rows stays."""
    require(df, ["Index Name", "Index Date", "Closing Index Value"])
    optional = {"pe": "P/E", "pb": "P/B", "div_yield": "Div Yield"}
    rows = df.select(any_timestamp(F.col("Index Date")).cast("date").alias("trade_date"), F.trim("Index Name").alias("index_name"), lenient_number(F.col("Closing Index Value")).alias("close"), *[(lenient_number(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")).alias(n) for n, c in optional.items()])
    return rows.where("close is not null").groupBy("trade_date", "index_name").agg(F.min(F.struct("close", "pe", "pb", "div_yield")).alias("x")).select("trade_date", "index_name", "x.*")


def instruments(df: DataFrame) -> DataFrame:
    require(df, ["SYMBOL", "NAME OF COMPANY", "SERIES", "DATE OF LISTING", "ISIN NUMBER", "FACE VALUE"])
    return df.select(F.trim("SYMBOL").alias("symbol"), F.trim("NAME OF COMPANY").alias("name"), F.trim("SERIES").alias("series"), any_timestamp(F.initcap("DATE OF LISTING")).cast("date").alias("listed"), F.trim("ISIN NUMBER").alias("isin"), lenient_number(F.col("FACE VALUE")).alias("face_value"))


def ban_list(lines: DataFrame) -> DataFrame:
    """(as_of, symbol) of a text table (value, file): a title line with the date and numbered symbols."""
    text = F.trim("value")
    dates = lines.select("file", any_timestamp(F.initcap(F.regexp_extract("value", r"([0-9]{1,2}-[A-Za-z]{3}-[0-9]{4})", 1))).cast("date").alias("as_of")).where("as_of is not null").groupBy("file").agg(F.min("as_of").alias("as_of"))
    rows = lines.select("file", F.regexp_extract(text, r"^[0-9]+\s*,\s*([A-Z0-9&-]+)$", 1).alias("symbol")).where("symbol <> ''")
    return rows.join(F.broadcast(dates), "file").select("as_of", "symbol")


def deals(df: DataFrame, kind: str) -> DataFrame:
    require(df, ["Date", "Symbol", "Client Name", "Buy/Sell", "Quantity Traded"])
    price = next(c for c in df.columns if c.startswith("Trade Price"))
    return df.select(any_timestamp(F.initcap("Date")).cast("date").alias("deal_date"), F.trim("Symbol").alias("symbol"), F.lit(kind).alias("kind"), F.substring(F.trim("Client Name"), 1, 120).alias("client"), F.upper(F.trim("`Buy/Sell`")).alias("side"), lenient_number(F.col("Quantity Traded")).cast("long").alias("quantity"), lenient_number(F.col(f"`{price}`")).alias("price"))


def members(df: DataFrame) -> DataFrame:
    require(df, ["Symbol", "Industry"])
    return df.select(F.trim("Symbol").alias("symbol"), F.trim("Industry").alias("industry"))


def surveillance(df: DataFrame, list_name: str) -> DataFrame:
    """(as_of, symbol, list_name, stage) of JSON rows (symbol, stage, as_of)."""
    return df.select(any_timestamp(F.col("as_of")).cast("date").alias("as_of"), "symbol", F.lit(list_name).alias("list_name"), stage_number(F.col("stage")).alias("stage"))


def holdings_long(df: DataFrame, holders: Sequence[str] = ("promoters", "fii", "dii", "public")) -> DataFrame:
    """(symbol, period_end, holder, pct, visible_from) of wide JSON rows (symbol, period_end, broadcast, a column a holder)."""
    period = any_timestamp(F.col("period_end")).cast("date")
    seen = F.coalesce(any_timestamp(F.col("broadcast")).cast("date"), F.date_add(period, 21))
    rows = df.select("symbol", period.alias("period_end"), seen.alias("visible_from"), *[lenient_number(F.col(h).cast("string")).alias(h) for h in holders if h in df.columns])
    return rows.unpivot(["symbol", "period_end", "visible_from"], [h for h in holders if h in df.columns], "holder", "pct").where("pct is not null")


def earliest_filing(df: DataFrame) -> DataFrame:
    """(symbol, period_end, consolidated, filed, url): the first filing of each period; the period's end may stand in the parameters only."""
    inside = any_timestamp(F.initcap(F.regexp_extract("params", r"([0-9]{1,2}-[A-Za-z]{3}-[0-9]{4})", 1))).cast("date")
    rows = df.select("symbol", F.coalesce(any_timestamp(F.col("period_end")).cast("date"), inside).alias("period_end"), "consolidated", F.coalesce(any_timestamp(F.col("filed")), any_timestamp(F.col("broadcast"))).alias("filed"), "url")
    w = Window.partitionBy("symbol", "period_end", "consolidated").orderBy(F.col("filed").asc_nulls_last(), "url")
    return rows.where("period_end is not null").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def best_source(layouts: Sequence[DataFrame]) -> DataFrame:
    """The rows of the first layout that has a (trade_date, symbol, series); they lie in the order of symbol and series, so a join by these neither moves nor sorts them again."""
    rows = None
    for k, df in enumerate(layouts):
        one = df.withColumn("__p", F.lit(k))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "series", "trade_date").orderBy("__p", F.desc("turnover"))
    return rows.repartition("symbol", "series").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__p")


def dated_as_named(rows: DataFrame, file: str, expected: Column, date: str = "trade_date") -> DataFrame:
    """Rows of the files whose most frequent date (ties: the smallest) is the one their name says."""
    counts = rows.groupBy(file, expected.alias("__e"), date).count()
    mode = counts.groupBy(file, "__e").agg(F.min_by(date, F.struct(-F.col("count"), F.col(date))).alias("__m"))
    return rows.join(mode.where("__m = __e").select(file), file, "left_semi")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
