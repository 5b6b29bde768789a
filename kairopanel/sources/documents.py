"""Archived pages and XML filings to long facts; each file is parsed by itself, in batches."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lenient_number, month_end_of_label, period_kind, slug


class _Tables(HTMLParser):
    """Cells of the tables within the sections of a page: (section id, row, column, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.section, self.row, self.column, self.cell, self.cells = "", -1, -1, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "section":
            self.section, self.row = dict(attrs).get("id") or "", -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.column, self.cell = self.column + 1, []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.cells.append((self.section, self.row, self.column, " ".join("".join(self.cell).split())))
            self.cell = None


def page_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section, row, col, text) of all table cells."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html]):
                parser = _Tables()
                parser.feed(text or "")
                out += [(k, *c) for c in parser.cells]
            yield pd.DataFrame(out, columns=[key, "section", "row", "col", "text"])

    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, section string, row int, col int, text string")


def page_statements(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, stmt, period_end, line_item, value): cells under period labels, by row label."""
    heads = cells.where("row = 0 and col > 0").select(key, "section", "col", month_end_of_label(F.col("text")).alias("period_end")).where("period_end is not null")
    labels = cells.where("row > 0 and col = 0").select(key, "section", "row", slug(F.col("text")).alias("line_item"))
    values = cells.where("row > 0 and col > 0").select(key, "section", "row", "col", lenient_number(F.regexp_replace("text", "%", "")).alias("value")).where("value is not null")
    return values.join(heads, [key, "section", "col"]).join(labels, [key, "section", "row"]).select(key, F.col("section").alias("stmt"), "period_end", "line_item", "value")


def preferred_page(pages: DataFrame) -> DataFrame:
    """Of a (symbol, day) the consolidated page, unless it is empty: pages have (symbol, day, basis, empty)."""
    w = Window.partitionBy("symbol", "day").orderBy("empty", F.when(F.col("basis") == "consolidated", 0).otherwise(1), "basis")
    return pages.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def filing_facts(xml: bytes) -> list[tuple]:
    """(tag, context, start, end, dims, unit, decimals, value) of an XBRL instance."""
    root = ET.fromstring(xml)
    contexts: dict[str, tuple] = {}
    units: dict[str, str] = {}
    for e in root:
        if _local(e.tag) == "context":
            found = {_local(x.tag): (x.text or "").strip() for x in e.iter()}
            dims = sorted(f"{(x.get('dimension') or '').split(':')[-1]}={(x.text or '').strip().split(':')[-1]}" for x in e.iter() if _local(x.tag) == "explicitMember")
            contexts[e.get("id")] = (found.get("startDate"), found.get("endDate") or found.get("instant"), "|".join(dims))
        elif _local(e.tag) == "unit":
            units[e.get("id")] = "/".join((x.text or "").strip().split(":")[-1] for x in e.iter() if _local(x.tag) == "measure")
    out = []
    for e in root:
        if (c := e.get("contextRef")) in contexts and (e.text or "").strip():
            out.append((_local(e.tag), c, *contexts[c], units.get(e.get("unitRef") or ""), e.get("decimals"), e.text.strip()))
    return out


def filings(files: DataFrame) -> DataFrame:
    """(path, tag, period_start, period_end, kind, dims, unit, decimals, value, text) of binary files (path, content); unreadable files yield one row with tag ``!error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "tag", "context", "start", "end", "dims", "unit", "decimals", "text"]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, *f) for f in filing_facts(bytes(content))]
                except ET.ParseError as e:
                    out.append((path, "!error", None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names)

    rows = files.select("path", "content").mapInPandas(parse, "path string, tag string, context string, start string, end string, dims string, unit string, decimals string, text string")
    start, end = F.try_to_date("start"), F.try_to_date("end")
    return rows.select("path", "tag", start.alias("period_start"), end.alias("period_end"), period_kind(start, end).alias("kind"), "dims", "unit", F.col("decimals").try_cast("int").alias("decimals"), lenient_number(F.col("text")).alias("value"), "text")


def scaled(facts: DataFrame, anchors: DataFrame, within: float = 0.20) -> DataFrame:
    """facts with scale, to units of ten million: by the filing's rounding (decimals), unless another scale agrees with the anchors.

    anchors: (path, tag, expected). Candidates are 1, 1e-2, 1e-5 and 1e-7; another one wins only where it comes within a share of the anchor and the first doesn't.
    """
    own = facts.where("dims = '' and value is not null").join(anchors, ["path", "tag"])
    tries = own.select("path", "decimals", F.explode(F.array(*[F.lit(s) for s in (1.0, 1e-2, 1e-5, 1e-7)])).alias("s"), "value", "expected")
    tries = tries.groupBy("path", "s").agg(F.avg(F.abs(F.try_divide(F.col("value") * F.col("s"), "expected") - 1)).alias("off"))
    best = tries.groupBy("path").agg(F.min(F.struct("off", "s")).alias("b"), F.max(F.when(F.abs(F.ln("s") - F.ln(F.lit(1e-7))) < 1e-6, F.col("off"))).alias("plain"))
    joined = facts.join(best, "path", "left")
    scale = F.when(F.coalesce((F.col("b.off") <= within) & ~(F.col("plain") <= within), F.lit(False)), F.col("b.s")).otherwise(1e-7)
    return joined.withColumn("scale", F.when(F.col("unit") == "INR", scale)).drop("b", "plain")


def canonical_items(facts: DataFrame, names: DataFrame, bank_markers: list[str]) -> DataFrame:
    """facts with bank and item: names (tag, item, bank_only) is a fixed list and broadcast; an unknown tag keeps a null item."""
    bank = facts.groupBy("path").agg(F.max(F.col("tag").isin(bank_markers)).alias("bank"))
    joined = facts.join(bank, "path").join(F.broadcast(names), "tag", "left")
    return joined.withColumn("item", F.when(F.coalesce("bank_only", F.lit(False)) & ~F.col("bank"), None).otherwise(F.col("item"))).drop("bank_only")


def filing_period(facts: DataFrame) -> DataFrame:
    """(path, period_end): the latest end of a duration, else the latest instant."""
    return facts.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("kind") != "I", F.col("period_end"))), F.max("period_end")).alias("period_end"))
