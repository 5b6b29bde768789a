"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialized


def word_count(text: Column | str) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), a row a source.

    Sources in the order of their code points, null last, weigh ``weights``, repeating. They share ``share`` times the sum of
    all sizes by weight; no target exceeds ``most`` times its source's size, and what is above is shared by weight among the
    others until none is above. That is min(most * size, level * weight), whose level follows from the sources in the
    order of most * size / weight.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("w"))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / F.sum("w").over(after))
    # the first source whose cap the level doesn't exceed fixes it for all from there on
    level = level.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def whole_copies(sizes: np.ndarray, rate: float, most: int) -> np.ndarray:
    """Copies, from 0 to ``most``, of documents in about descending order of size, each such that the words taken so far come nearest to ``rate`` times those seen."""
    copies, owed = np.zeros(len(sizes), np.int64), 0.0
    for k, s in enumerate(sizes.tolist()):
        owed += rate * s
        copies[k] = min(most, max(0, round(owed / s))) if s else 0
        owed -= copies[k] * s
    return copies


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 0, size: Column | None = None, large: float = 0.01, most_large: int = 10_000, prefix: str = "") -> DataFrame:
    """docs (doc_id, text, source and any others) with size, source_size, target and copies, these four named with the prefix.

    Within a source the documents are put in descending order of size classes; the prefix sums of their expected copies,
    moved by one random offset of the source, cross integer boundaries, and a document is emitted once for each boundary that it
    crosses. The expected copies of the documents that are ``large`` times the target or more, at most ``most_large``
    of them, are whole numbers that follow the target, as one such document more or less would miss it. All others have equal
    ones, so that what is left of the target is theirs; no neighbour in the order is much larger, so the words
    taken come within about one such document of it. The offset comes from the seed and the source's name: reruns agree.

    size: what a document counts, the number of its words unless given. Null and empty texts have size 0 and come last; null is a source
    of its own, after all others. Repeated rows are documents of their own. Columns with the names of the four are replaced.

    Prefix sums are computed in two steps, counts of small size classes and ranks within them, so the hottest source
    is spread over many tasks.
    """
    names = {n: prefix + n for n in ("size", "source_size", "target", "copies")}
    docs = docs.drop(*names.values())
    size = word_count("text") if size is None else size
    held = docs.columns
    group = ["__none", "__source", "__class", "__salt"]
    n = docs.count()
    rows = docs.select(
        *held, size.cast("long").alias("__size"), F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__h"),
    ).withColumns({"__class": F.floor(F.log2(F.col("__size") + 1) * 8).cast("int"), "__salt": F.pmod("__h", F.lit(max(4, math.ceil(n / 2_000_000)))).cast("int")})
    per = materialized(rows.groupBy(*group).agg(F.count("*").alias("__n"), F.sum("__size").alias("__w"), F.min("__size").alias("__least")))
    sizes = per.groupBy("__none", "__source").agg(F.sum("__w").alias("source_size")).select(F.when(~F.col("__none"), F.col("__source")).alias("source"), "source_size")
    aim = targets(sizes, weights, share, most).select(F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    source = Window.partitionBy("__none", "__source")
    per = per.join(aim, ["__none", "__source"])
    per = per.withColumn("__before", F.sum("__n").over(source.orderBy(F.desc("__class"), "__salt")) - F.col("__n"))
    with_class = F.sum("__n").over(source.orderBy(F.desc("__class")).rangeBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("__large", (with_class <= most_large) & (F.min("__least").over(Window.partitionBy("__none", "__source", "__class")) >= large * F.col("__target")) & (F.col("__least") > 0))
    per = materialized(per.drop("__n", "__least"))

    def placed(table: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("__size"), "__h", "doc_id")) - 1
        return table.withColumn("__rank", rank).join(per, group).withColumn("__at", F.col("__before") + F.col("__rank"))

    def decide(table: pd.DataFrame) -> pd.DataFrame:  # at most most_large rows
        table = table.sort_values("__at")
        copies = whole_copies(table["__size"].to_numpy(), float(table["__rate"].iloc[0]), int(most))
        return pd.DataFrame({"__none": table["__none"], "__source": table["__source"], "__at": table["__at"], "__whole": copies, "__taken": copies * table["__size"]})

    some = placed(rows.select(*group, "__h", "doc_id", "__size")).where("__large").select("__none", "__source", "__at", "__size", (F.col("__target") / F.col("__source_size")).alias("__rate"))
    whole = materialized(some.groupBy("__none", "__source").applyInPandas(decide, "__none boolean, __source string, __at long, __whole long, __taken long"))
    taken = whole.groupBy("__none", "__source").agg(F.sum("__taken").alias("__taken"))
    rest = per.groupBy("__none", "__source").agg(F.first("__target").alias("__target"), F.sum(F.when(~F.col("__large"), F.col("__w"))).alias("__left")).join(taken, ["__none", "__source"], "left")
    rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("__target") - F.coalesce("__taken", F.lit(0))) / F.col("__left")))
    rest = rest.select("__none", "__source", F.when(F.col("__left") > 0, rate).otherwise(0.0).alias("__rate"))
    facts = rest.agg(F.count("*")).first()[0], whole.count()
    # a row of a few bytes a source or large document may be broadcast; else they are joined
    rest, whole = (F.broadcast(t) if k <= 500_000 else t for t, k in zip((rest, whole.drop("__taken")), facts))
    rows = placed(rows).join(rest, ["__none", "__source"]).join(whole, ["__none", "__source", "__at"], "left")
    offset = F.pmod(F.xxhash64(F.lit(seed), "__none", "__source"), F.lit(1 << 20)) / float(1 << 20)
    # whole numbers before a document move no boundary
    crossed = F.floor((F.col("__at") + 1) * F.col("__rate") + offset) - F.floor(F.col("__at") * F.col("__rate") + offset)
    made = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "copies": F.coalesce("__whole", crossed).cast("long")}
    return rows.select(*held, *[c.alias(names[k]) for k, c in made.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as :func:`mix_sources` says, with their own columns, whatever these are called."""
    columns = docs.columns
    found = mix_sources(docs, prefix="__mix_", **options).where("__mix_copies > 0")
    return found.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__copy")).drop("__copy")
