"""Exact quantiles of groups of any size, in two passes: where an order statistic lies, then which of the few values there it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float] = (0.5,), name: str = "q", accuracy: int = 2000, direct: int = 50_000) -> DataFrame:
    """(by, name, n): an array of the exact quantiles of the known values of each group, interpolated between neighbours, and how many there are; groups without one have no row.

    The first pass sums sketches of bounded size: two values for each fraction between which its order statistics must lie, as a sketch is off by
    1 / accuracy of the ranks at most and the two are taken twice as far apart (all values of groups of up to twice the accuracy). The second
    counts what lies below, and the values between by value, so ties are one row each; only these, a five-hundredth or so of a large
    group, are put in order. No task or window holds a group. df is read three times: hand in a written table.

    Where no group has more than ``direct`` values, which is counted first, each group's are summed up in one aggregate of that bounded size
    instead: the same numbers by fewer shuffles.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= direct:
        found = rows.groupBy(*by).agg(F.percentile("__x", F.array(*[F.lit(float(f)) for f in fractions])).alias(name), F.count("*").alias("n"))
        return found.where("n > 0")
    wide = 2 / accuracy
    ends = [max(0.0, f - wide) for f in fractions] + [min(1.0, f + wide) for f in fractions]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__a"), F.max("__x").alias("__z"), F.percentile_approx("__x", ends, accuracy).alias("__e"))
    small = F.col("__n") <= 2 * accuracy
    spans = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(small, F.col("__a")).otherwise(F.get("__e", F.lit(i))).alias("low"), F.when(small, F.col("__z")).otherwise(F.get("__e", F.lit(len(fractions) + i))).alias("high"), (f * (F.col("__n") - 1)).alias("at"), F.col("__n").alias("n"))
        for i, f in enumerate(fractions)
    ])
    spans = sketch.select(*by, spans.alias("__s"))
    met = rows.join(spans, list(by)) if by else rows.crossJoin(F.broadcast(spans))
    # a value below a span is counted, one inside it kept; what lies above doesn't matter
    near = F.filter("__s", lambda s: F.col("__x") <= s["high"])
    each = met.select(*by, "__x", F.explode(near).alias("s")).select(*by, "s.i", "s.at", "s.n", F.when(F.col("__x") < F.col("s.low"), None).otherwise(F.col("__x")).alias("v"))
    counts = each.groupBy(*by, "n", "i", "at", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__c", upto).where("v is not null")
    rank = F.floor("at")
    found = placed.groupBy(*by, "n", "i", "at").agg(F.min(F.when(F.col("__c") > rank, F.col("v"))).alias("x"), F.min(F.when(F.col("__c") > rank + 1, F.col("v"))).alias("y"))
    part = F.col("at") - rank
    q = F.when(part == 0, F.col("x")).otherwise((1 - part) * F.col("x") + part * F.col("y"))
    out = found.select(*by, "n", F.struct("i", q.alias("q")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["q"]).alias(name)  # one for each fraction
    return out.groupBy(*by, "n").agg(listed).select(*by, name, "n")


def medians(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, name, <name>_n): the exact median of each group's known values and how many there are."""
    return group_quantiles(df, by, value, (0.5,), "__q").select(*by, F.get("__q", F.lit(0)).alias(name), F.col("n").alias(f"{name}_n"))
