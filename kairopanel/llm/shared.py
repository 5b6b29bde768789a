"""Small helpers of the text operators: shared folders, numpy views of Arrow text, word hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# freed memory goes back to the system, not to a pool of the worker's
pa.set_memory_pool(pa.system_memory_pool())

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a session on one machine gets one of its own.

    All folders of an application lie in one that has its id, so that they can be removed together when it has ended.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kairopanel-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = held.get()
    return f"{top.rstrip('/')}/kairopanel-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: later steps don't repeat the work."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most this many rows: a worker's memory follows the length of its batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def place_of(column: Column | str, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below a number, by halving; 0 for null."""
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    column = F.col(column) if isinstance(column, str) else column

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        beyond = (s["low"] < s["high"]) & (column > F.get(held, mid))
        return F.struct(F.when(beyond, mid + 1).otherwise(s["low"]).alias("low"), F.when(beyond | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length()))), start, halve, lambda s: s["low"])
    return F.when(column.isNotNull(), found).otherwise(0)


def id_cuts(docs: DataFrame, parts: int, column: str = "doc_id") -> list[int]:
    """At most ``parts`` - 1 numbers that split the rows into parts of about equal size, clustered or not."""
    if parts < 2:
        return []
    found = docs.where(F.col(column).isNotNull()).agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 20 * parts).alias("c")).first()["c"]
    return sorted(set(found or []))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < max(n, 1):
        row = np.full(max(n, 1 << 19), base, np.uint64)
        row[0] = 1
        _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[name][:n]


def chunks(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows with about ``most`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * _powers("up", _BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("down", _BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive word hashes, over the row borders too."""
    m = max(0, len(words) - n + 1)
    out, scale = np.zeros(m, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += words[j : j + m] * scale
            scale = scale * np.uint64(0xD1342543DE82EF95)
    return mix(out + np.uint64(n))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a stream of batches that is sorted by them, each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
