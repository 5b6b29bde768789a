"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merged
from .shared import groups, materialized, partitions


def spread(units: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """The rows of unit vectors in their order, without those that have ``most`` kept rows at this cosine or above."""
    kept, n = np.empty_like(units), 0
    for x in units:
        if np.count_nonzero(kept[:n] @ x >= cosine) < most:
            kept[n] = x
            n += 1
    return kept[:n].copy()


def common(a: np.ndarray, b: np.ndarray, below: int | None = None) -> np.ndarray:
    """How many reference points each row of a shares with each row of b; only those numbered below a limit, if one is given."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(a.shape[1]):
        x = a[:, i] if below is None else np.where(a[:, i] < below, a[:, i], -1)
        for j in range(b.shape[1]):
            out += x[:, None] == b[None, :, j]
    return out


def embedding_near_dups(vectors: DataFrame, threshold: float = 0.95, nearest: int = 8, listed: int = 6, shared: int = 3, pivots: int | None = None, most_members: int = 4_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id long, embedding array of float; other columns are ignored).

    Vectors link when their cosine, in double precision, is at least ``threshold``. n_links counts the other vectors that one links
    with directly, component_id is the smallest vec_id reachable by links, and kept tells whether it is the row's own. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths with each other.
    Repeated rows are vectors of their own; a null vec_id counts in no minimum.

    Index: each vector is described by its ``nearest`` reference points in the order of their cosine. The reference points are a
    sample of distinct vectors: as many as the square root of their number, twice, rounded up to a power of 2, from 64 to
    4,096 (those with the least hash), without those that have ``nearest`` others of them within one and a half times the threshold's angle:
    the members of a dense group, however large, are all nearest to the same few. The inverted list of a reference point holds
    the vectors that have it among their first ``listed``. Vectors that meet in a list and share ``shared`` of their
    points or more are compared, in the list of the first point by number that lists both. Every vector is indexed; equal vectors
    travel once. A list with more than ``most_members`` members is compared in pairs of blocks, each in a task of its own. What
    the index misses are links whose vectors order the points too differently: see the README for the recall.
    """
    held = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    fine = F.coalesce((F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    held = held.withColumn("fine", fine)
    # 0.0 and -0.0 are one value; equal vectors get one key
    same = held.where("fine").withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    same = same.withColumn("k", F.xxhash64("e", F.lit(1)))
    each = materialized(same.groupBy("k").agg(F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    known = each.select(F.size("e").alias("dim")).groupBy("dim").count().collect()
    n = sum(r["count"] for r in known)
    few = pivots or min(4096, max(64, 1 << int(np.ceil(np.log2(2 * max(n, 1) ** 0.5)))))
    near = float(np.cos(min(np.pi, 1.5 * np.arccos(np.clip(threshold, -1, 1)))))
    found = {}
    for row in known:  # a row a dimension
        sample = each.where(F.size("e") == row["dim"]).select("k", "e").orderBy(F.xxhash64("k"), "k").limit(few).select("e").collect()
        p = np.array([r[0] for r in sample])
        found[row["dim"]] = spread(p / np.linalg.norm(p, axis=1)[:, None], nearest, near)

    def describe(batches):
        for batch in batches:
            k, lists = batch.column(0).to_numpy(), batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            values, begin = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for a in range(0, len(rows), 2000):
                    some = rows[a : a + 2000]
                    order = np.argsort(-(values[begin[some][:, None] + np.arange(dim)] @ found[dim].T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(np.full(len(some), dim, np.int32)), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * order.shape[1], order.ravel())], ["k", "dim", "points"])

    index = materialized(each.select("k", "e").mapInArrow(describe, "k long, dim int, points array<int>"))
    lists = index.select("k", "dim", "points", F.explode(F.slice("points", 1, listed)).alias("point"))
    blocks = lists.groupBy("dim", "point").agg(F.count("*").alias("n")).where("n > 1").select("dim", "point", F.ceil(F.col("n") / most_members).cast("int").alias("blocks"))
    keyed = lists.join(blocks, ["dim", "point"]).withColumn("own", F.expr("cast(pmod(xxhash64(k), blocks) as int)"))
    keyed = keyed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", "dim", "point", "points", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def verify(batches):
        for table in groups(batches, ["dim", "point", "i", "j"]):
            if table.num_rows < 2:
                continue
            point, across = table["point"][0].as_py(), table["i"][0].as_py() != table["j"][0].as_py()
            k, own, copies = (table[c].to_numpy() for c in ("k", "own", "copies"))
            matrix = lambda c: (lambda x: x.flatten().to_numpy().reshape(len(k), -1))(table[c].combine_chunks())
            x, points = matrix("e"), matrix("points").astype(np.int16)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            links, labels = np.zeros(len(k), np.int64), np.arange(len(k))
            for a in range(0, len(k), 512):
                some = slice(a, a + 512)
                ok = common(points[some], points) >= min(shared, points.shape[1])
                ok[np.arange(len(ok)), np.arange(a, a + len(ok))] = False
                if across:
                    ok &= own[some][:, None] != own[None, :]
                rows = np.flatnonzero(ok.any(1))
                if not len(rows):
                    continue
                # a pair that an earlier point lists too is compared there
                ok[rows] &= common(points[a + rows, :listed], points[:, :listed], point) == 0
                ok[rows] &= x[a + rows] @ x.T >= threshold
                u, v = np.nonzero(ok)
                labels = merged(labels, a + u, v)
                links[some] += ok @ copies
            moved = np.flatnonzero((links > 0) | (labels != np.arange(len(k))))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(k[moved]), pa.array(k[labels[moved]]), pa.array(links[moved])], ["a", "b", "n"])

    met = keyed.join(each.select("k", "e", "copies"), "k").repartition(partitions(vectors), "dim", "point", "i", "j").sortWithinPartitions("dim", "point", "i", "j", "k")
    links = materialized(met.select("dim", "point", "i", "j", "k", "own", "copies", "points", "e").mapInArrow(verify, "a long, b long, n long"))
    whole = connected_components(links.select("a", "b"))
    direct = links.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    named = each.select("k", "least").join(whole.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = named.join(smallest, "component").join(each.select("k", "copies"), "k").join(direct, "k", "left").select("k", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = same.select("vec_id", "k").join(result, "k").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(held.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
