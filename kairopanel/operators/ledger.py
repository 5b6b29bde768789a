"""The ledger of published ratings: what was said when, once and for all, and how it turned out at each horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import keep_first
from .calibration import returns_ahead

KEYS = ["engine", "symbol", "as_of", "horizon"]
COLUMNS = [*KEYS, "verdict", "verdict_before", "score", "dci", "mos", "matured_on", "fwd", "bench", "excess", "outcome"]


def publish(ratings: DataFrame, ledger: DataFrame | None, horizons: Sequence[int], variant: str = "base") -> DataFrame:
    """The rows to append: rated rows of one variant that the ledger lacks, pending, a row for each horizon in sessions.

    ``verdict_before`` is the verdict that the engine published for the name on the date published before, over all names; null
    where the name had none. Publishing again adds nothing, and what stands is never rewritten.
    """
    rated = ratings.where((F.col("variant") == variant) & (F.col("status") == "RATED")).select("engine", "symbol", "as_of", "verdict", "score", "dci", "mos")
    known = ["engine", "symbol", "as_of", "verdict"]
    if ledger is None:
        said, fresh = rated.select(*known), rated
    else:
        stands = ledger.select(*known).distinct()
        fresh = rated.join(stands.select(*known[:-1]), known[:-1], "left_anti")
        said = stands.unionByName(fresh.select(*known))
    dates = said.select("engine", "as_of").distinct()  # a row a date: one task numbers an engine's
    dates = dates.withColumn("__before", F.lag("as_of").over(Window.partitionBy("engine").orderBy("as_of")))
    before = said.select("engine", "symbol", F.col("as_of").alias("__before"), F.col("verdict").alias("verdict_before"))
    out = fresh.join(F.broadcast(dates), ["engine", "as_of"]).join(before, ["engine", "symbol", "__before"], "left")
    none = {c: F.lit(None).cast(k) for c, k in (("matured_on", "date"), ("fwd", "double"), ("bench", "double"), ("excess", "double"))}
    return out.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumns(none | {"outcome": F.lit("pending")}).select(*COLUMNS)


def mature(ledger: DataFrame, panel: DataFrame, index: DataFrame, calendar: DataFrame, horizons: Sequence[int], today: str | None = None) -> DataFrame:
    """The ledger with the pending rows filled in whose horizon has passed by ``today`` (else by the calendar's end): hit, miss or delisted.

    panel: (symbol, trade_date, close), adjusted; index: (trade_date, close). A hit beats the index, or 0 where the index isn't known. Rows
    that have matured stay as they are, whatever prices say now, so running it twice changes nothing.
    """
    if today:
        calendar = calendar.where(F.col("trade_date") <= F.lit(today).cast("date"))
    open_ = ledger.where("outcome = 'pending'")
    dates = open_.select("as_of").distinct()
    names = {f"h{h}": h for h in horizons}
    ahead = returns_ahead(panel, dates, calendar, names, delisted=True)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(n).alias("fwd"), F.col(f"{n}_on").alias("matured_on"), F.col(f"{n}_delisted").alias("delisted")) for n, h in names.items()]))
    ahead = ahead.select("symbol", "as_of", each.alias("x")).select("symbol", "as_of", "x.*").where("matured_on is not null")
    level = calendar.join(index.select("trade_date", F.col("close").alias("__c")), "trade_date")
    ends = level.select(F.col("trade_date").alias("as_of"), F.col("__c").alias("__a"), "session_no").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    ends = ends.join(level.select(F.col("session_no").alias("__to"), F.col("__c").alias("__b")), F.col("session_no") + F.col("horizon") == F.col("__to"))
    bench = ends.select("as_of", "horizon", F.try_divide("__b", "__a").alias("__r")).select("as_of", "horizon", (F.col("__r") - 1).alias("bench"))
    met = open_.drop("matured_on", "fwd", "bench", "excess").join(ahead, ["symbol", "as_of", "horizon"], "left").join(F.broadcast(bench), ["as_of", "horizon"], "left")
    beats = F.when(F.col("fwd") > F.coalesce("bench", F.lit(0.0)), "hit").otherwise("miss")
    outcome = F.when(F.col("matured_on").isNull(), "pending").when(F.col("delisted") | F.col("fwd").isNull(), "delisted").otherwise(beats)
    done = met.withColumn("outcome", outcome).withColumn("excess", F.col("fwd") - F.col("bench"))
    done = done.withColumn("bench", F.when(F.col("outcome") != "pending", F.col("bench"))).withColumn("excess", F.when(F.col("outcome") != "pending", F.col("excess")))
    return ledger.where("outcome <> 'pending'").select(*COLUMNS).unionByName(done.select(*COLUMNS))


def report(ledger: DataFrame, least: int = 100, least_tier: int = 20) -> DataFrame:
    """(engine, horizon, verdict, n, mean_excess, hit_rate, quotable) of matured rows of the engines and horizons that have ``least`` of them.

    A tier may be quoted from ``least_tier`` rows on.
    """
    done = ledger.where("outcome <> 'pending' and fwd is not null")
    tiers = done.groupBy("engine", "horizon", "verdict").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit_rate"))
    total = F.sum("n").over(Window.partitionBy("engine", "horizon"))
    return tiers.withColumn("__t", total).where(F.col("__t") >= least).withColumn("quotable", F.col("n") >= least_tier).drop("__t")


def latest(ratings: DataFrame, keys: Sequence[str] = ("engine", "symbol")) -> DataFrame:
    """The last rating of each name."""
    return keep_first(ratings, list(keys), [F.desc("as_of"), "variant"])


def verdict_history(ratings: DataFrame, keys: Sequence[str] = ("engine", "symbol"), most: int = 24) -> DataFrame:
    """Each name's last ratings, newest first, with ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("as_of")))
    return ratings.withColumn("place", place).where(F.col("place") <= most)
