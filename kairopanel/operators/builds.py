"""Jobs that keep dated tables up to date: a slice a date, written once, resumed where it stopped, replaced when made again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..sources.sinks import replace_slices
from . import selection


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there, in any store that Spark reads."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table))


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema in its order: what nobody has yet is null, infinite and undefined numbers are null, other columns are left out."""

    def one(field):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        return c.alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def missing_slices(dates: DataFrame, spark: SparkSession, path: str, schema: StructType, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """The rows of dates (by) that the table has no slice of; partition names are read, no data."""
    if not exists(spark, path):
        return dates.select(*by).distinct()
    there = spark.read.schema(schema).parquet(path).select(*by).distinct()
    return dates.select(*by).distinct().join(there, list(by), "left_anti")


def build_slices(make: Callable[[DataFrame], DataFrame], dates: DataFrame, path: str, schema: StructType, by: Sequence[str] = ("as_of",), resume: bool = True) -> DataFrame:
    """Make the slices of dates and write them, all in one job; the whole table, read again.

    make gets the dates to make and returns their rows. With ``resume`` only missing slices are made, else all of them, each
    replacing what stands there; slices of other dates stay. A job that is lost halfway leaves whole slices or none, as the
    commit of a dynamic overwrite moves finished partitions, and is simply run again.
    """
    spark = dates.sparkSession
    todo = missing_slices(dates, spark, path, schema, by) if resume else dates.select(*by).distinct()
    rest = [f for f in schema.fields if f.name not in by]
    stored = StructType(rest + [f for f in schema.fields if f.name in by])  # partition columns come last
    replace_slices(aligned(make(todo), stored).repartition(*by), path, list(by))
    return spark.read.schema(stored).parquet(path).select(*schema.names)


def rank_table(features: DataFrame, sleeve: str, variant: str, weights: dict[str, float], n: int, gate: DataFrame | None = None, hold: float = 1.5, fit: str | None = None) -> DataFrame:
    """(as_of, sleeve, variant, symbol, score, rank, universe_size, held, weight, regime) of all dates of a features table.

    Names that may not be held (``fit`` names a boolean column) have no score. Held names follow through the dates with hysteresis; gate has
    (as_of, regime, exposure): on RISK_OFF dates no new names enter, and weights add up to the exposure. weights: inverse to vol_60, within
    the caps of :func:`selection.inverse_vol_weights`. Every name with a score has a row, held or not.
    """
    score = selection.composite(weights)
    rows = features.withColumn("score", F.when(F.coalesce(F.col(fit), F.lit(False)), score) if fit else score)
    rows = rows.select("as_of", "symbol", "industry", "vol_60", "score", F.lit(sleeve).alias("sleeve"))
    ranked = selection.ranked(rows, ["sleeve", "as_of"])
    sizes = ranked.groupBy("as_of").agg(F.count("*").alias("universe_size"))
    ranked = ranked.join(F.broadcast(sizes), "as_of")
    if gate is not None:
        ranked = ranked.join(F.broadcast(gate.select("as_of", "regime", "exposure")), "as_of", "left")
    else:
        ranked = ranked.withColumns({"regime": F.lit(None).cast("string"), "exposure": F.lit(1.0)})
    ranked = ranked.withColumn("__new", F.coalesce(F.col("regime") != "RISK_OFF", F.lit(True)))
    held = selection.select_with_hysteresis(ranked, ["sleeve"], n=n, hold=hold, new="__new").select("sleeve", "as_of", "symbol", F.lit(True).alias("held"))
    some = ranked.join(held, ["sleeve", "as_of", "symbol"])
    weight = selection.inverse_vol_weights(some, ["sleeve", "as_of"], exposure="exposure")
    out = ranked.join(held, ["sleeve", "as_of", "symbol"], "left").join(weight, ["sleeve", "as_of", "symbol"], "left")
    return out.select(
        "as_of", "sleeve", F.lit(variant).alias("variant"), "symbol", "score", "rank", "universe_size", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "regime",
    )
