"""Digests for readers: what changed since the date before, what was filed for names that are held, a page for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import keep_first, previous_state
from .rating import verdict_rank


def verdict_changes(ratings: DataFrame, key: str = "symbol") -> DataFrame:
    """(as_of, key, verdict_before, verdict, direction) of names whose verdict differs from that of the date before, for all dates."""
    both = previous_state(ratings.select("as_of", key, "verdict"), [key], "verdict").withColumnRenamed("previous_verdict", "verdict_before")
    moved = both.where("verdict_before is not null and verdict_before <> verdict")
    up = verdict_rank(F.col("verdict")) > verdict_rank(F.col("verdict_before"))
    return moved.select("as_of", key, "verdict_before", "verdict", F.when(up, "up").otherwise("down").alias("direction"))


def filings_of_held(filings: DataFrame, ranks: DataFrame, days: int = 1, key: str = "symbol") -> DataFrame:
    """The filings (key, filed_on, ...) of the last days before each date of the ranks, of names held on it (weight above 0), with that date."""
    held = ranks.where("weight > 0").select(key, "as_of").distinct()
    # a filing meets the dates of its own name only
    return filings.join(held, key).where((F.col("filed_on") <= F.col("as_of")) & (F.col("filed_on") > F.date_sub("as_of", days)))


def entries(ranks: DataFrame, key: str = "symbol") -> DataFrame:
    """(sleeve, as_of, entered, left): names that came into and left a sleeve (weight above 0) since its date before, as sorted arrays."""
    names = ranks.where("weight > 0").groupBy("sleeve", "as_of").agg(F.array_sort(F.collect_set(key)).alias("now"))  # a few dozen a sleeve
    both = previous_state(names, ["sleeve"], "now")
    none = F.array_except("now", "now")
    return both.select("sleeve", "as_of", F.array_except("now", F.coalesce("previous_now", none)).alias("entered"), F.array_except(F.coalesce("previous_now", none), "now").alias("left"))


def pages(latest: DataFrame, slices: dict[str, tuple[DataFrame, str, int]], key: str = "symbol") -> DataFrame:
    """A nested row for each name: its latest row and of every slice (rows, date, most) its newest rows, newest first.

    Slices are cut to ``most`` rows a name before they are packed.
    """
    out = latest
    for name, (rows, day, most) in slices.items():
        rest = [c for c in rows.columns if c != key]
        some = keep_first(rows, [key], [F.desc(day), *[c for c in rest if c != day]], most)
        packed = some.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(day, *[c for c in rest if c != day])), asc=False).alias(name))
        out = out.join(packed, key, "left")
    return out
