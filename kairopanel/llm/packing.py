"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import groups, partitions


def sequence_cost(per_sequence: float = 256.0, per_token: float = 1.0, per_pair: float = 1 / 16384) -> Callable[[int], float]:
    """Cost of computing on a sequence: a fixed part, one for each token and one for each pair of tokens."""
    return lambda length: per_sequence + per_token * length + per_pair * length * length


def pack(lengths: np.ndarray, capacities: list[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its start in the bin, and capacity and contents of each bin; no piece exceeds the largest capacity.

    Pieces in descending order go to the open bin that they leave the least room in. A piece that fits none opens a bin.
    Which size is the cheapest to open depends on what else comes, so each size is tried as the least one to open,
    and so is the size with the least cost a token that holds the piece; in the end each bin shrinks to the smallest
    capacity that holds its contents, and the cheapest of these packings stays.
    """
    order = np.argsort(-lengths, kind="stable")
    fit = lambda n: capacities[bisect.bisect_left(capacities, n)]
    least_unit = sorted(capacities, key=lambda c: (cost(c) / c, c))
    policies = [lambda n, c=c: max(c, fit(n)) for c in capacities] + [lambda n: next(c for c in least_unit if c >= n)]
    best = None
    for opens in policies:
        room: list[tuple[int, int]] = []
        bins, starts, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
        for k in order.tolist():
            n = int(lengths[k])
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = opens(n), len(filled)
                filled.append(0)
            bins[k], starts[k] = b, filled[b]
            filled[b] += n
            if left > n:
                bisect.insort(room, (left - n, b))
        total = sum(cost(fit(n)) for n in filled)
        if best is None or total < best[0]:
            best = total, bins, starts, np.array([fit(n) for n in filled], np.int64), np.array(filled, np.int64)
    return best[1:]


def best_fit_pack(docs: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), cost: Callable[[int], float] | None = None, length: Column | None = None, shard_docs: int = 2_000) -> DataFrame:
    """(doc_id, piece, piece_start, piece_length, bin_id, bin_capacity, bin_fill, bin_start): where each piece of docs goes.

    A document (doc_id, text; other columns are ignored) has the given length, or its number of words and one for an end
    mark; null counts as 0. It is cut into pieces of the largest capacity and a rest. Every piece is in one bin, from bin_start on; a bin
    has the smallest permitted length that holds its contents. A document of length 0 takes no room: one piece of
    length 0. Repeated rows are packed each.

    Documents are dealt by a hash to shards of about ``shard_docs`` documents, each packed by itself: a shard wastes
    at most a few bins. Texts don't travel, only their lengths.
    """
    capacities = sorted({int(c) for c in capacities})
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities have to be positive")
    cost = cost or sequence_cost()
    length = word_count("text") + 1 if length is None else length
    shards = max(1, -(-docs.count() // shard_docs))

    def packed(batches):
        for table in groups(batches, ["shard"]):
            shard = table["shard"][0].as_py()
            ids, n = table["doc_id"], table["n"].to_numpy()
            whole, rest = n // capacities[-1], n % capacities[-1]
            count = whole + ((rest > 0) | (n == 0))
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            size = np.where(piece < whole[doc], capacities[-1], rest[doc])
            bins, starts, capacity, filled = pack(size, capacities, cost)
            out = [ids.take(pa.array(doc)).combine_chunks(), piece, piece * capacities[-1], size, bins + (shard << 32), capacity[bins], filled[bins], starts]
            yield pa.RecordBatch.from_arrays([out[0], *(pa.array(x.astype(np.int64)) for x in out[1:])], ["doc_id", "piece", "piece_start", "piece_length", "bin_id", "bin_capacity", "bin_fill", "bin_start"])

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    rows = docs.select(shard.alias("shard"), "doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    rows = rows.repartition(partitions(docs), "shard").sortWithinPartitions("shard", "doc_id", "n")
    return rows.mapInArrow(packed, "doc_id long, piece long, piece_start long, piece_length long, bin_id long, bin_capacity long, bin_fill long, bin_start long")
