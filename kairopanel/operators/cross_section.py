"""Cross-sections: outliers, scores within groups, ranks and deciles, for all dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .quantiles import medians


def winsorise(df: DataFrame, column: str, by: Sequence[str], out: str | None = None, k: float = 3.0) -> DataFrame:
    """The column within median +/- k * 1.4826 * MAD of its group; unchanged where the MAD is 0.

    df is written once, as both medians and the result read it; the medians are a row a group and are joined back.
    """
    df = written(df)
    held = df.join(written(medians(df, by, column, "__m")).drop("__m_n"), list(by), "left")
    far = written(medians(held.select(*by, F.abs(F.col(column) - F.col("__m")).alias("__d")), by, "__d", "__s")).drop("__s_n")
    held, bound = held.join(far, list(by), "left"), F.col("__s") * 1.4826 * k
    bounded = F.least(F.greatest(F.col(column), F.col("__m") - bound), F.col("__m") + bound)
    return held.withColumn(out or column, F.when(F.col(column).isNotNull() & (bound > 0), bounded).otherwise(F.col(column))).drop("__m", "__s")


def zscore_grouped(df: DataFrame, column: str, by: Sequence[str], group: str, out: str, least: int = 8, bound: float = 4.0) -> DataFrame:
    """z-score within by + group where it has ``least`` known values, else within by; population deviation, clipped. A null group is one of its own.

    Counts, means and deviations are summed before they travel, written (a row a group, so their size is known before the join is planned: rows of df
    stay where they are while it is small) and joined back.
    """
    x = F.col(column)
    rows = df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    facts = lambda keys, p: written(rows.groupBy(*keys).agg(F.count(x).alias(f"__n{p}"), F.avg(x).alias(f"__a{p}"), F.stddev_pop(x).alias(f"__d{p}")))
    rows = rows.join(facts([*by, "__g"], "i"), [*by, "__g"], "left").join(facts(list(by), "o"), list(by), "left")
    z = lambda p: F.try_divide(x - F.col(f"__a{p}"), F.nullif(F.col(f"__d{p}"), F.lit(0.0)))
    chosen = F.when(F.col("__ni") >= least, z("i")).otherwise(z("o"))
    chosen = F.when(chosen.isNotNull(), F.least(F.greatest(chosen, F.lit(-bound)), F.lit(bound)))
    return rows.withColumn(out, chosen).select(*[c for c in df.columns if c != out], out)


def average_rank(x: Column, by: Sequence[Column | str]) -> Column:
    """Rank in ascending order, ties sharing their mean rank; null for null. The first and the last place of equal values come from one sort."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())  # only known values are counted
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2)


def percentile_grouped(x: Column, by: Sequence[Column | str]) -> Column:
    """The average rank over the number of known values: above 0, at most 1."""
    whole = Window.partitionBy(*by).orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the sort of the ranks serves it
    return average_rank(x, by) / F.nullif(F.count(x).over(whole), F.lit(0))


def with_percentiles(df: DataFrame, columns: dict[str, str], by: Sequence[str]) -> DataFrame:
    """df with the percentile within by (average rank over the number of known values) of each column, under the name given; null for null.

    A column after the other, each from one sort of a group's rows. No column of by is null.
    """
    for c, out in columns.items():
        df = df.withColumn(out, percentile_grouped(F.col(c), by))
    return df


def value_percentiles(df: DataFrame, x: str, by: Sequence[str], group: str, least: int) -> DataFrame:
    """(by, group, x, pct): of each known value the average rank over the number of values, within by + group where it has ``least`` of them, else within by.

    Values are counted first, so ranks are running sums over the distinct ones; rows of df travel once, to be counted. No group is null.
    """

    def ranked(values: DataFrame, keys: list, p: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        upto = F.sum("__c").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
        return values.select(*keys, x, "__c", (upto - (F.col("__c") - 1) / 2).alias(f"__r{p}"), F.sum("__c").over(w).alias(f"__n{p}"))

    values = written(df.where(F.col(x).isNotNull()).groupBy(*by, group, x).agg(F.count("*").alias("__c")))
    own = ranked(values, [*by, group], "i").drop("__c")
    all_ = ranked(values.groupBy(*by, x).agg(F.sum("__c").alias("__c")), list(by), "o").drop("__c")
    pct = F.when(F.col("__ni") >= least, F.col("__ri") / F.col("__ni")).otherwise(F.col("__ro") / F.col("__no"))
    return own.join(all_, [*by, x]).select(*by, group, x, pct.alias("pct"))


def deciles(order: Sequence[Column | str], by: Sequence[str], n: int = 10) -> Column:
    """Quantile groups of near-equal size from 1, by the position in the order: edges are interpolated, so they differ from ntile."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(total > 1, F.greatest(F.lit(1), F.ceil((r - 1) * n / (total - 1)))).otherwise(1).cast("int")


#: The components of the buckets: (component, bucket, sign, lower cap, upper cap).
COMPONENTS = [
    ("roe", "quality", 1, None, None), ("roce", "quality", 1, None, None), ("accruals", "quality", -1, None, None), ("f_score", "quality", 1, None, None),
    ("debt_equity", "quality", -1, None, None), ("int_cover", "quality", 1, None, 50), ("opm_chg_1y", "quality", 1, None, None), ("altman_zpp", "quality", 1, -10, 20),
    ("earnings_yield", "value", 1, None, None), ("fcf_yield", "value", 1, None, None), ("pb", "value", -1, 0, None), ("div_yield", "value", 1, None, None), ("ps", "value", -1, 0, None),
    ("mom_12_1", "momentum", 1, None, None), ("mom_6_1", "momentum", 1, None, None), ("dist_52w_high", "momentum", 1, None, None), ("pat_yoy_ttm", "momentum", 1, None, None), ("sales_yoy_ttm", "momentum", 1, None, None),
    ("vol_250", "lowrisk", -1, None, None), ("dd_250", "lowrisk", 1, None, None), ("beta_250", "lowrisk", -1, None, None), ("amihud_60", "lowrisk", -1, None, None),
]


def bucket_scores(df: DataFrame, by: Sequence[str], key: str, group: str, components: list[tuple] = COMPONENTS, least_names: int = 8, least_components: int = 2) -> DataFrame:
    """(by, key, z_<bucket>..., buckets_known): means of the z-scores of each bucket's components that the table has.

    A component is capped, signed, winsorised over all names of a date and scored within its group. It is skipped where
    fewer than ``least_names`` names have it; a bucket needs ``least_components`` of a name.
    """
    here = [c for c in components if c[0] in df.columns]
    buckets = list(dict.fromkeys(c[1] for c in here))

    def signed(name, sign, low, high):
        x = F.col(name).cast("double")
        x = x if low is None else F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))
        x = x if high is None else F.when(x.isNotNull(), F.least(x, F.lit(float(high))))
        return x * sign

    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.lit(b).alias("bucket"), signed(n, s, a, z).alias("x")) for n, b, s, a, z in here]))
    long = df.select(*by, key, group, rows.alias("__c")).select(*by, key, group, "__c.*")
    long = written(winsorise(long, "x", [*by, "component"]))
    enough = written(long.groupBy(*by, "component").agg((F.count("x") >= least_names).alias("__enough")))
    long = zscore_grouped(long, "x", [*by, "component"], group, "z")
    long = long.join(enough, [*by, "component"]).withColumn("z", F.when(F.col("__enough"), F.col("z")))
    means = long.groupBy(*by, key).agg(*[F.when(F.count(F.when(F.col("bucket") == b, F.col("z"))) >= least_components, F.avg(F.when(F.col("bucket") == b, F.col("z")))).alias(f"z_{b}") for b in buckets])
    known = sum((F.col(f"z_{b}").isNotNull().cast("int") for b in buckets), F.lit(0))
    return means.withColumn("buckets_known", known)
