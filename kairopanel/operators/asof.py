"""Point-in-time reads: what was known on a date, latest snapshots, as-of joins and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order given, which should break all ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def known_spans(facts: DataFrame, keys: Sequence[str], order: Sequence[Column], visible: str = "visible_from") -> DataFrame:
    """(__best, __from, __next): of each key the fact that is least by the order among those visible, from the day that makes it so to the next day with a fact."""
    by_day = Window.partitionBy(*keys).orderBy(visible)
    least = F.struct(*[c.alias(f"__o{k}") for k, c in enumerate(order)], F.struct(*[F.col(c) for c in facts.columns]).alias("__row"))
    best = F.min(least).over(by_day.rowsBetween(Window.unboundedPreceding, 0))["__row"]
    spans = facts.select(F.col(visible).alias("__from"), F.lead(visible).over(by_day).alias("__next"), best.alias("__best"))
    return spans.where(F.col("__next").isNull() | (F.col("__next") > F.col("__from")))


def known_at(facts: DataFrame, dates: DataFrame, keys: Sequence[str], prefer: Sequence[Column | str] = (), visible: str = "visible_from", as_of: str = "as_of") -> DataFrame:
    """For each date the facts visible by then, one row for each key: the preferred one, else the last to become visible.

    Each fact is turned into the days on which it, or a better one that came before it, is what is known of its key: so a date meets
    one row a key, however many facts there are. dates is a small table of as-of dates; it is broadcast.
    """
    order = [F.col(p) if isinstance(p, str) else p for p in prefer] + [-F.unix_date(visible)]
    spans = known_spans(facts, keys, order, visible)
    met = spans.join(F.broadcast(dates.select(as_of)), (F.col("__from") <= F.col(as_of)) & (F.col("__next").isNull() | (F.col("__next") > F.col(as_of))))
    return met.select("__best.*", as_of)


def latest_snapshot(snapshots: DataFrame, dates: DataFrame, snapshot: str, as_of: str = "as_of") -> DataFrame:
    """All rows of the last snapshot on or before each date."""
    days = snapshots.select(snapshot).distinct()
    last = dates.join(days, F.col(snapshot) <= F.col(as_of)).groupBy(as_of).agg(F.max(snapshot).alias(snapshot))
    return last.join(snapshots, snapshot)


def sessions(rows: DataFrame, date: str = "trade_date") -> DataFrame:
    """(trade_date, session_no) of all dates seen, from 1. A calendar has a row a day, so one task numbers it."""
    return rows.select(date).distinct().withColumn("session_no", F.row_number().over(Window.orderBy(date)))


def last_session_of(calendar: DataFrame, unit: str, date: str = "trade_date") -> DataFrame:
    """The last session of each month or week."""
    return calendar.groupBy(F.trunc(date, unit).alias("period")).agg(F.max(date).alias("as_of"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, values: Sequence[str], tolerance_days: int | None = None) -> DataFrame:
    """left with the values of the last row of right on or before its date, by keys; null beyond the tolerance.

    The two sides are put one after another and the last known values carried on, so each key's rows are sorted once and
    no pairs are made. right has one row for each key and date.
    """
    held = [c for c in left.columns if c not in keys]
    if right_date in values:
        raise ValueError("values are columns beside the date")
    a = left.select(*keys, F.col(left_date).alias("__d"), F.lit(1).alias("__side"), F.struct(*held).alias("__left"), F.lit(None).cast(right.select(F.struct(F.col(right_date), *values)).schema[0].dataType).alias("__right"))
    b = right.select(*keys, F.col(right_date).alias("__d"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(F.col(right_date), *values).alias("__right"))
    w = Window.partitionBy(*keys).orderBy("__d", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    near = F.lit(True) if tolerance_days is None else F.datediff("__d", F.col("__right")[right_date]) <= tolerance_days
    return both.select(*keys, "__left.*", *[F.when(near, F.col("__right")[v]).alias(v) for v in values])


def session_ahead(calendar: DataFrame, n: int, date: str = "trade_date") -> DataFrame:
    """(trade_date, ahead): the n-th session after each."""
    later = calendar.select((F.col("session_no") - n).alias("session_no"), F.col(date).alias("ahead"))
    return calendar.join(later, "session_no", "left").select(date, "ahead")


def densify(rows: DataFrame, calendar: DataFrame, key: str, date: str = "trade_date") -> DataFrame:
    """A row for each key and session, from the key's first to its last one; null where there was none.

    The calendar (a row a day) is broadcast; the rows meet it by key, so a shuffle by key serves the windows that follow.
    """
    span = rows.groupBy(key).agg(F.min(date).alias("__a"), F.max(date).alias("__z"))
    grid = span.join(F.broadcast(calendar), F.col(date).between(F.col("__a"), F.col("__z"))).drop("__a", "__z")
    return grid.join(rows, [key, date], "left")


def previous_state(states: DataFrame, keys: Sequence[str], value: str, as_of: str = "as_of") -> DataFrame:
    """With the value at the date published before, over all dates: null where the key had none at that date."""
    dates = states.select(as_of).distinct().withColumn("__before", F.lag(as_of).over(Window.orderBy(as_of)))
    before = states.select(*keys, F.col(as_of).alias("__before"), F.col(value).alias(f"previous_{value}"))
    return states.join(F.broadcast(dates), as_of).join(before, [*keys, "__before"], "left").drop("__before")


def month_end_sessions(calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """calendar with is_month_end: whether the next session lies in another month; null for the last one, whose next isn't known."""
    following = F.lead(date).over(Window.orderBy(date))
    return calendar.withColumn("is_month_end", F.when(following.isNotNull(), F.trunc(following, "month") != F.trunc(date, "month")))


def closed_days(first: Column, last: Column, calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """(day, kind) of the days between two dates without a session: weekend or holiday."""
    one = calendar.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    kind = F.when(F.dayofweek("day").isin(1, 7), "weekend").otherwise("holiday")
    return one.join(calendar.select(F.col(date).alias("day")).distinct(), "day", "left_anti").withColumn("kind", kind)


def last_sessions(panel: DataFrame, end: Column, n: int, date: str = "trade_date") -> DataFrame:
    """The rows of the last n sessions of a panel on or before a date."""
    days = panel.select(date).distinct().where(F.col(date) <= end)
    some = days.withColumn("__k", F.row_number().over(Window.orderBy(F.desc(date)))).where(F.col("__k") <= n).drop("__k")
    return panel.join(F.broadcast(some), date)
