"""Metrics of holdings and dated events: shares of holders, pledges, insiders, credit ratings, adverse announcements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import known_at, known_spans

#: Words of adverse announcements.
ADVERSE = ["sebi order", "fraud", "forensic audit", "default", "resignation of auditor", "auditor resign", "resignation of cfo", "warning letter", "oai", "import alert", "insolvency", "nclt", "winding up"]


def newest_periods(facts: DataFrame, dates: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, period: str = "period_end", visible: str = "visible_from", as_of: str = "as_of") -> DataFrame:
    """(as_of, keys, periods): for each date the newest n periods known by then, as an array of (period, values), oldest first.

    A key's facts are walked once in the order in which they became visible, carrying a **ring** of n periods: a fact of a period in the
    ring adds the values that are still unknown, or larger, another one enters and the oldest leaves. So a key's state changes as often
    as it has facts, each state holds until the next, and a date meets one state a key, however many facts there are. dates is a small
    table; it is broadcast.
    """
    kind = facts.select(F.struct(F.col(period).alias("period"), *[F.col(v) for v in values])).schema[0].dataType.simpleString()
    row = F.struct(F.col(visible).alias("visible"), F.struct(F.col(period).alias("period"), *[F.col(v) for v in values]).alias("x"))
    path = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__path"))  # one key's facts: a few hundred
    merged = lambda r, x: F.struct(r["period"].alias("period"), *[F.greatest(r[v], x[v]).alias(v) for v in values])

    def step(done: Column, e: Column) -> Column:
        ring, x = done["ring"], e["x"]
        there = F.exists(ring, lambda r: r["period"] == x["period"])
        grown = F.array_sort(F.array_append(ring, x))
        grown = F.slice(grown, F.greatest(F.size(grown) - n + 1, F.lit(1)), n)
        ring = F.when(there, F.transform(ring, lambda r: F.when(r["period"] == x["period"], merged(r, x)).otherwise(r))).otherwise(grown)
        return F.struct(ring.alias("ring"), F.array_append(done["out"], F.struct(e["visible"].alias("from"), ring.alias("ring"))).alias("out"))

    day = facts.schema[visible].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("ring"), F.array().cast(f"array<struct<from:{day},ring:array<{kind}>>>").alias("out"))
    states = path.select(*keys, F.aggregate("__path", start, step, lambda d: d["out"]).alias("__s"))
    each = F.posexplode(F.transform("__s", lambda s, i: F.struct(s["from"].alias("from"), F.get(F.col("__s"), i + 1)["from"].alias("next"), s["ring"].alias("ring"))))
    spans = states.select(*keys, each).select(*keys, "col.*").where(F.col("next").isNull() | (F.col("next") > F.col("from")))
    met = spans.join(F.broadcast(dates.select(as_of)), (F.col("from") <= F.col(as_of)) & (F.col("next").isNull() | (F.col("next") > F.col(as_of))))
    return met.select(as_of, *keys, F.col("ring").alias("periods"))


def holder_changes(holdings: DataFrame, dates: DataFrame, quarters: Sequence[int] = (4, 12)) -> DataFrame:
    """(as_of, symbol, promoter_pct, promoter_chg_1y, promoter_chg_3y, inst_pct, inst_chg_1y) of what was visible by each date.

    holdings: (symbol, period_end, holder, pct, visible_from); institutions are fii and dii. A change compares with 4 and 12 quarters before the last.
    """
    held = lambda h: F.max(F.when(F.col("holder") == h, F.col("pct")))
    facts = holdings.groupBy("symbol", "period_end", "visible_from").agg(held("promoters").alias("p"), held("fii").alias("f"), held("dii").alias("d"))
    rings = newest_periods(facts, dates, ["symbol"], ["p", "f", "d"], max(quarters) + 1)
    back = lambda k: F.get("periods", F.size("periods") - 1 - k)
    promoters, institutions = (lambda k: back(k)["p"]), (lambda k: back(k)["f"] + back(k)["d"])
    year, three = quarters
    return rings.select(
        "as_of", "symbol", promoters(0).alias("promoter_pct"), (promoters(0) - promoters(year)).alias("promoter_chg_1y"), (promoters(0) - promoters(three)).alias("promoter_chg_3y"),
        institutions(0).alias("inst_pct"), (institutions(0) - institutions(year)).alias("inst_chg_1y"),
    )


def within_days(events: DataFrame, dates: DataFrame, day: str, days: int, visible: str | None = None) -> DataFrame:
    """The events of the last days before each date, and visible by then."""
    on = (F.col(day) <= F.col("as_of")) & (F.col(day) > F.date_sub(F.col("as_of"), days))
    return events.join(F.broadcast(dates.select("as_of")), on if visible is None else on & (F.col(visible) <= F.col("as_of")))


def pledges(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, symbol, pledged_pct_of_promoter, pledge_delta_4q): the last pledge by each date, and its change over that of 365 days before.

    A pledge (symbol, period_end, pledged_pct) is what is known until the next one; a date, and the day a year before it, meet one each.
    """
    rows = rows.select("symbol", "period_end", "pledged_pct")
    now = known_at(rows, dates, ["symbol"], visible="period_end").select("as_of", "symbol", F.col("pledged_pct").alias("pledged_pct_of_promoter"))
    past = dates.select(F.date_sub("as_of", 365).alias("as_of")).distinct()
    before = known_at(rows, past, ["symbol"], visible="period_end").select(F.date_add("as_of", 365).alias("as_of"), "symbol", F.col("pledged_pct").alias("__b"))
    out = now.join(before, ["as_of", "symbol"], "left")
    return out.withColumn("pledge_delta_4q", F.col("pledged_pct_of_promoter") - F.col("__b")).drop("__b")


def insider_net_buy(trades: DataFrame, dates: DataFrame, mcaps: DataFrame) -> DataFrame:
    """(as_of, symbol, insider_net_buy_12m): purchases less sales of 365 days over the market value (as_of, symbol, mcap)."""
    some = within_days(trades, dates, "trade_date", 365)
    net = some.groupBy("as_of", "symbol").agg(F.sum(F.when(F.upper("side") == "BUY", F.col("value")).when(F.upper("side") == "SELL", -F.col("value"))).alias("n"))
    return net.join(mcaps, ["as_of", "symbol"]).select("as_of", "symbol", F.try_divide("n", F.when(F.col("mcap") > 0, F.col("mcap"))).alias("insider_net_buy_12m"))


def rating_migration(actions: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, symbol, rating_migration_12m, outlook_negative) of rating actions (symbol, action_date, notches, outlook)."""
    some = within_days(actions, dates, "action_date", 365)
    return some.groupBy("as_of", "symbol").agg(F.sum("notches").alias("rating_migration_12m"), (F.max_by(F.lower("outlook"), "action_date") == "negative").alias("outlook_negative"))


def adverse_events(announcements: DataFrame, dates: DataFrame, days: int = 90) -> DataFrame:
    """(as_of, symbol, adverse_events_90d_clean): 0 where an announcement (symbol, ann_dt, subject, details) of the last days has an adverse word, else 1.

    A name has a row on each date by which it has announced anything.
    """
    rows = announcements.withColumn("__d", F.to_date("ann_dt"))
    text = F.lower(F.concat_ws(" ", "subject", "details"))
    rows = rows.select("symbol", "__d", reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ADVERSE]).alias("__bad"))
    begun = rows.groupBy("symbol").agg(F.min("__d").alias("__first"))
    known = begun.join(F.broadcast(dates.select("as_of")), F.col("__first") <= F.col("as_of")).select("as_of", "symbol")
    bad = within_days(rows.where("__bad"), dates, "__d", days + 1).select("as_of", "symbol", F.lit(0.0).alias("__v")).distinct()
    return known.join(bad, ["as_of", "symbol"], "left").select("as_of", "symbol", F.coalesce("__v", F.lit(1.0)).alias("adverse_events_90d_clean"))


def face_values(splits: DataFrame, today: DataFrame) -> DataFrame:
    """(symbol, from_date, to_date, face_value): face values through time from today's (symbol, face_value) and the splits (symbol, ex_date, factor) since.

    Before a split from 10 to 2 (factor 0.2) the face value was 5 times what it was after it. One that a double can't hold, after very many
    splits, is infinite.
    """
    w = Window.partitionBy("symbol").orderBy("ex_date")
    later = Window.partitionBy("symbol").orderBy(F.desc("ex_date")).rowsBetween(Window.unboundedPreceding, 0)
    product = F.exp(F.sum(F.ln("factor")).over(later))
    before = splits.join(today, "symbol").select("symbol", F.lag("ex_date").over(w).alias("from_date"), F.date_sub("ex_date", 1).alias("to_date"), F.when(product > 0, F.try_divide("face_value", product)).otherwise(float("inf")).alias("face_value"))
    last = today.join(splits.groupBy("symbol").agg(F.max("ex_date").alias("from_date")), "symbol", "left").select("symbol", "from_date", F.lit(None).cast("date").alias("to_date"), "face_value")
    return before.unionByName(last)


def historical_mcaps(periods: DataFrame, closes: DataFrame, faces: DataFrame, tolerance_days: int = 10) -> DataFrame:
    """(symbol, period_end, mcap): equity capital (symbol, period_end, equity_capital) over the face value of the day, times the raw close on or shortly before it."""
    from .asof import asof_join

    priced = asof_join(periods, closes, ["symbol"], "period_end", "trade_date", ["close"], tolerance_days)
    inside = (F.col("from_date").isNull() | (F.col("period_end") >= F.col("from_date"))) & (F.col("to_date").isNull() | (F.col("period_end") <= F.col("to_date")))
    met = priced.join(faces, "symbol").where(inside)
    return met.select("symbol", "period_end", (F.try_divide("equity_capital", "face_value") * F.col("close")).alias("mcap"))


def canonical_facts(facts: DataFrame, dates: DataFrame, items: Sequence[str]) -> DataFrame:
    """(as_of, symbol, kind, period_end, <items>): of each kind of period the latest one visible, consolidated before standalone, for each item.

    Of a (symbol, kind) a date meets the newest period, and of that period's items those known by then: a fact meets only the dates on
    which its period is the newest.
    """
    facts = facts.where("dims = '' and item is not null")
    newest = known_at(facts.select("symbol", "kind", "period_end", "visible_from").distinct(), dates, ["symbol", "kind"], [-F.unix_date("period_end")])
    basis = F.when(F.col("basis") == "consolidated", 0).otherwise(1)
    spans = known_spans(facts.select("symbol", "kind", "period_end", "item", "basis", "value", "visible_from"), ["symbol", "kind", "period_end", "item"], [basis, -F.unix_date("visible_from"), -F.col("value")])
    held = spans.select("__from", "__next", "__best.symbol", "__best.kind", "__best.period_end", "__best.item", "__best.value")
    met = newest.select("as_of", "symbol", "kind", "period_end").join(held, ["symbol", "kind", "period_end"])
    met = met.where((F.col("__from") <= F.col("as_of")) & (F.col("__next").isNull() | (F.col("__next") > F.col("as_of"))))
    return met.groupBy("as_of", "symbol", "kind", "period_end").pivot("item", list(items)).agg(F.first("value"))


def restamped(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """facts with visible_from moved to the earliest filing of their period (symbol, period_end, filed) where one is known, and changed."""
    first = calendar.groupBy("symbol", "period_end").agg(F.to_date(F.min("filed")).alias("__f"))
    joined = facts.join(first, ["symbol", "period_end"], "left")
    moved = F.coalesce(F.col("__f") != F.col("visible_from"), F.lit(False))
    return joined.withColumn("changed", moved).withColumn("visible_from", F.coalesce("__f", "visible_from")).drop("__f")


def one_series(prices: DataFrame, order: Sequence[str] = ("EQ", "BE")) -> DataFrame:
    """One row for each symbol and date: the first series of the order, then by name."""
    place: Column = F.lit(len(order))
    for k, s in enumerate(order):
        place = F.when(F.col("series") == s, k).otherwise(place)
    w = Window.partitionBy("symbol", "trade_date").orderBy(place, "series")
    return prices.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
