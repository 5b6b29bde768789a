"""Writes: upserts, slices, first-seen facts with revisions, logs and packs. A table is a folder of Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """existing with the rows of new put in: by key the last of new (by ``order``) wins; columns that new lacks keep their old value."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in new.columns if c != order and c not in keys])
        new = new.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    given = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in given], F.lit(True).alias("__new"))
    both = existing.join(n, list(keys), "full")
    return both.select(*[F.col(c) if c in keys else F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in existing.columns])


def absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose key isn't there: the first source wins."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


def filled(existing: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """existing with null columns filled from new; known values stay."""
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns])
    joined = existing.join(n, list(keys), "left")
    return joined.select(*[F.coalesce(c, f"__n_{c}").alias(c) if c in columns else F.col(c) for c in existing.columns])


def revisions(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, old, new) of known facts that new reports with another value, null included."""
    o = existing.select(*keys, F.col(value).alias("old"))
    return new.select(*keys, F.col(value).alias("new")).join(o, list(keys)).where(~F.col("old").eqNullSafe(F.col("new")))


def replace_slices(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the partitions (by) that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> str:
    """Write a new version of a table beside the old ones and return its path: readers of an old one aren't disturbed."""
    to = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(to)
    return to


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def run_log(spark: SparkSession, path: str, run_id: str, event: str) -> None:
    """Append the start or end of a run."""
    append(spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(event).alias("event"), F.current_timestamp().alias("at")), path)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as csv or json."""
    (df.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else df.write.mode("overwrite").json(path))


def packs(keys: DataFrame, slices: dict[str, tuple[DataFrame, Column, int]], key: str = "symbol") -> DataFrame:
    """One nested row for each key: of every slice (rows, order, most) an array of its first rows."""
    out = keys.select(key).distinct()
    for name, (rows, order, most) in slices.items():
        w = Window.partitionBy(key).orderBy(order)
        some = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
        rest = [c for c in rows.columns if c != key]
        one = some.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", *rest))), lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias(name))
        out = out.join(one, key, "left")
    return out
