"""Streams: incremental loads, first-seen facts, duplicates, sampled closes and activity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import absent


def load_new(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, once: bool = True, by: Sequence[str] = ()):
    """Append rows whose keys the table at ``path`` lacks; the checkpoint remembers which files were read.

    A batch that is repeated after a failure finds its rows there and adds nothing. by: columns that the table is partitioned by, keys
    among them; of the table only the slices that a batch touches are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(list(keys)).persist()
        try:
            spark, fresh = batch.sparkSession, batch
            table = spark._jvm.org.apache.hadoop.fs.Path(path)
            if table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table):
                there = spark.read.schema(batch.schema).parquet(path)
                for c in by:  # a value a slice
                    there = there.where(F.col(c).isin([r[c] for r in batch.select(c).distinct().collect()]))
                fresh = absent(there, batch, keys)
            fresh.write.mode("append").partitionBy(*by).parquet(path)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_filed(stream: DataFrame, key: str, value: str, filed: str, arrived: str, wait: str = "1 day") -> DataFrame:
    """(key, value, filed, event): ``new`` once for each key, the value filed first, and ``revision`` for each other value, once.

    A fact stays open for ``wait`` after its first row has arrived, so that rows which come out of order can still be the first filed; then a
    timer closes it for good. Rows that come later, however early they were filed, are revisions and never change what was said. Time
    is that of arrival, so no row is late for the watermark and none is dropped; a key's state has its values until it closes, then
    those logged.
    """
    kind = stream.schema[key].dataType.simpleString()
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    to_time = lambda us: pd.Timestamp(us, unit="us")

    def closed_rows(k: tuple, at: list, values: list, logged: list) -> tuple[list, list]:
        """What closing says: the first filed, then the others."""
        by = sorted(range(len(at)), key=lambda i: (at[i], values[i]))
        first, out = values[by[0]], [(k[0], values[by[0]], to_time(at[by[0]]), "new")]
        for i in by[1:]:
            if values[i] != first and values[i] not in logged:
                logged = [*logged, values[i]]
                out.append((k[0], values[i], to_time(at[i]), "revision"))
        return out, [first, *logged]

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, until, at, values, said = state.get if state.exists else (False, 0, [], [], [])
        at, values, said, out = list(at), list(values), list(said), []
        if state.hasTimedOut:
            out, said = closed_rows(k, at, values, [])
            closed, at, values = True, [], []
        else:
            for batch in batches:
                for a, f, v in sorted(zip(batch[arrived], batch[filed], batch[value])):
                    ms = int(pd.Timestamp(a).value // 1_000_000)
                    if not closed and at and ms >= until:  # it has come after the wait, though the timer hasn't fired yet
                        out, said = closed_rows(k, at, values, [])
                        closed, at, values = True, [], []
                    if closed:
                        if v not in said:
                            said.append(float(v))
                            out.append((k[0], float(v), f, "revision"))
                        continue
                    at.append(int(pd.Timestamp(f).value // 1000))
                    values.append(float(v))
                    until = until or ms + wait_ms
            if not closed and until <= state.getCurrentWatermarkMs():
                out, said = closed_rows(k, at, values, [])
                closed, at, values = True, [], []
        state.update((closed, until, at, values, said))
        if not closed:
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=[key, "value", "filed", "event"])

    rows = stream.withWatermark(arrived, "0 seconds")
    kept = "closed boolean, until long, at array<long>, values array<double>, said array<double>"
    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, value double, filed timestamp, event string", kept, "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, first, event): ``new`` for a key's first value and ``revision`` for each later one that differs from the last logged.

    Late values aren't dropped: they become revisions. The state of a key is two numbers.
    """
    kind = stream.schema[key].dataType.simpleString()

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, None)
        known = state.exists
        out = []
        for batch in batches:
            for v in batch.sort_values("__at", kind="stable")[value] if "__at" in batch else batch[value]:
                v = None if pd.isna(v) else float(v)
                if not known:
                    first = last = v
                    known = True
                    out.append((k[0], v, first, "new"))
                elif v != last:
                    last = v
                    out.append((k[0], v, first, "revision"))
        state.update((first, last))
        yield pd.DataFrame(out, columns=[key, "value", "first", "event"])

    return stream.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, value double, first double, event string", "first double, last double", "append", GroupStateTimeout.NoTimeout)


def without_duplicates(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def weekly_closes(stream: DataFrame, key: str, time: str, value: str, late: str = "1 day") -> DataFrame:
    """The last value of each key in weeks from Monday."""
    return stream.withWatermark(time, late).groupBy(key, F.window(time, "7 days", startTime="4 days").alias("week")).agg(F.max_by(value, F.struct(time, value)).alias("close")).select(key, F.col("week.start").alias("week"), "close")


def activity(rows: DataFrame, kind: str, time: str, value: str, length: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(kind, start, n, total) over sliding windows; the same on a stream and on a table."""
    held = rows.withWatermark(time, late) if rows.isStreaming else rows
    return held.groupBy(kind, F.window(time, length, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(kind, F.col("w.start").alias("start"), "n", "total")


def visits(rows: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions that a pause ends."""
    held = rows.withWatermark(time, late) if rows.isStreaming else rows
    return held.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
