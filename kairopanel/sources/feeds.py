"""Answers of JSON feeds: a table with a text column ``body``, an answer a row, to typed rows.

Answers that aren't of the expected form (a bare string, an empty object, broken text) yield no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_timestamp, lenient_number, placeholder_to_null, stage_number


def _items(bodies: DataFrame, fields: list[str], path: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each object of the array at the path of an answer, its fields as text."""
    schema = f"struct<{', '.join(f'`{f}`: string' for f in fields)}>"
    text = F.get_json_object("body", f"$.{path}") if path else F.col("body")
    each = bodies.select(*keep, F.explode(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})).alias("x"))
    # what isn't an object is left out, not the whole answer
    found = each.where(F.startswith(F.trim("x"), F.lit("{"))).select(*keep, F.from_json("x", schema, {"mode": "PERMISSIVE"}).alias("x"))
    return found.select(*keep, "x.*")


def _day(name: str) -> Column:
    return any_timestamp(F.initcap(F.col(name))).cast("date")


def _moment(*names: str) -> Column:
    return F.coalesce(*[any_timestamp(F.initcap(F.col(n))) for n in names])


def corporate_actions(bodies: DataFrame) -> DataFrame:
    """(symbol, ex_date, subject, record_date, face_value, series) of arrays of actions; those without a symbol or an ex-date are left out."""
    rows = _items(bodies, ["symbol", "exDate", "subject", "recDate", "faceVal", "series"])
    out = rows.select(F.trim("symbol").alias("symbol"), _day("exDate").alias("ex_date"), F.substring(F.coalesce("subject", F.lit("")), 1, 200).alias("subject"), _day("recDate").alias("record_date"), lenient_number(F.col("faceVal")).alias("face_value"), "series")
    return out.where("ex_date is not null and symbol <> ''")


def _earliest(rows: DataFrame, *ties: Column) -> DataFrame:
    w = Window.partitionBy("symbol", "period_end", "consolidated").orderBy("filed", F.col("url").asc_nulls_last(), *ties)
    return rows.where("period_end is not null and filed is not null and symbol <> ''").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def results(bodies: DataFrame) -> DataFrame:
    """(symbol, period_end, consolidated, filed, audited, url): the first filing of each period; its end may stand in the parameters only, as the second of two dates."""
    rows = _items(bodies, ["symbol", "toDate", "params", "filingDate", "broadCastDate", "consolidated", "audited", "xbrl"])
    inside = any_timestamp(F.initcap(F.regexp_extract("params", r"[0-9]{2}-[A-Za-z]{3}-[0-9]{4}([0-9]{2}-[A-Za-z]{3}-[0-9]{4})", 1))).cast("date")
    kind = F.coalesce(F.nullif(F.trim("consolidated"), F.lit("")), F.lit("Unknown"))
    return _earliest(rows.select(F.trim("symbol").alias("symbol"), F.coalesce(_day("toDate"), inside).alias("period_end"), kind.alias("consolidated"), _moment("filingDate", "broadCastDate").alias("filed"), "audited", placeholder_to_null(F.col("xbrl")).alias("url")))


def integrated_results(bodies: DataFrame) -> DataFrame:
    """The same of the newer feed, whose rows lie below ``data``, with sequence and type; of filings of one moment and url, the least sequence number."""
    rows = _items(bodies, ["symbol", "qe_Date", "broadcast_Date", "creation_Date", "consolidated", "audited", "xbrl", "ixbrl", "seq_Id", "type_Sub"], "data")
    kind = F.coalesce(F.nullif(F.trim("consolidated"), F.lit("")), F.lit("Unknown"))
    url = F.coalesce(placeholder_to_null(F.col("xbrl")), placeholder_to_null(F.col("ixbrl")))
    return _earliest(rows.select(F.trim("symbol").alias("symbol"), _day("qe_Date").alias("period_end"), kind.alias("consolidated"), _moment("broadcast_Date", "creation_Date").alias("filed"), "audited", url.alias("url"), F.col("seq_Id").alias("seq_id"), F.col("type_Sub").alias("type_sub")), F.col("seq_id").try_cast("long").asc_nulls_last(), F.col("seq_id"))


def surveillance_lists(bodies: DataFrame) -> DataFrame:
    """(as_of, symbol, list_name, stage) of the answers of three reports (report, as_of, body): asm with a long and a short list, gsm and esm."""
    code = ["symbol", "asmSurvIndicator", "gsmStage", "esmSurvIndicator", "survCode"]
    of = lambda report, path, name, field: _items(bodies.where(F.col("report") == report), code, path, ("as_of",)).select("as_of", "symbol", F.lit(name).alias("list_name"), stage_number(F.coalesce(F.nullif(F.col(field), F.lit("")), "survCode")).alias("stage"))
    long, short = of("asm", "longterm.data", "ASM_LT", "asmSurvIndicator"), of("asm", "shortterm.data", "ASM_ST", "asmSurvIndicator")
    return long.unionByName(short).unionByName(of("gsm", "", "GSM", "gsmStage")).unionByName(of("esm", "", "ESM", "esmSurvIndicator"))


def announcements(bodies: DataFrame) -> DataFrame:
    """(symbol, ann_dt, subject, details, url, industry) of answers by symbol (symbol, body)."""
    rows = _items(bodies, ["an_dt", "desc", "attchmntText", "attchmntFile", "smIndustry"], "", ("symbol",))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return rows.select("symbol", _moment("an_dt").alias("ann_dt"), text("desc", 200).alias("subject"), text("attchmntText", 1000).alias("details"), F.nullif("attchmntFile", F.lit("")).alias("url"), F.col("smIndustry").alias("industry")).where("ann_dt is not null")


def annual_reports(bodies: DataFrame) -> DataFrame:
    """(symbol, kind, url, period, title, visible_from) of answers by symbol (symbol, body); reports without a file are left out."""
    rows = _items(bodies, ["fileName", "broadcast_dttm", "disseminationDateTime", "fromYr", "toYr"], "data", ("symbol",)).where("fileName <> ''")
    period = F.concat(F.lit("FY"), "fromYr", F.lit("-"), "toYr")
    return rows.select("symbol", F.lit("annual_report").alias("kind"), F.col("fileName").alias("url"), period.alias("period"), F.concat(F.lit("Annual Report "), period).alias("title"), _moment("broadcast_dttm", "disseminationDateTime").cast("date").alias("visible_from"))


def etf_list(df: DataFrame) -> DataFrame:
    """(symbol, underlying, listing_date) of a landed list; only the symbol has to be there."""
    from .landed import require

    require(df, ["Symbol"])
    at = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    listed = F.try_to_timestamp(F.initcap(F.trim(at("DateofListing"))), F.lit("dd-MMM-yy")).cast("date")
    return df.select(F.trim("Symbol").alias("symbol"), F.substring(F.trim(at("Underlying Asset")), 1, 120).alias("underlying"), listed.alias("listing_date"))


def auditor(facts: DataFrame) -> DataFrame:
    """(filing, auditor_name, auditor_opinion, modified) of the facts (filing, place, item, raw): the first name, and the first opinion with whether it is modified, null where it doesn't say."""
    first = lambda item: F.min(F.when((F.col("item") == item) & (F.col("raw") != ""), F.struct("place", "raw")))["raw"]
    out = facts.groupBy("filing").agg(first("auditor_name").alias("auditor_name"), first("auditor_opinion").alias("auditor_opinion"))
    says = lambda words: F.rlike(F.lower("auditor_opinion"), F.lit(words))
    return out.withColumn("modified", F.when(says("unmodified|unqualified|clean"), False).when(says("qualified|adverse|disclaimer|modified"), True))
