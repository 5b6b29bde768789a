"""Stretches of words that repeat with a period, by recursive frequency splitting and a scan of lags.

In a run of at least ``times`` periods each word occurs ``times`` times or more. A word that occurs less often within a
segment is therefore in no run of it, and **splits** it; in the shorter segments more words are too rare, so splitting
goes on until nothing changes, for all texts of a batch at once. Segments shorter than ``least`` words go. What survives is
**scanned by lags**: a run of period q covers a multiple of q, counted from the segment's start, from which three
periods lie in the run; so only these places are compared for each q (their number for all q is m log m of m words),
and only where first and last words of the periods agree is the whole segment compared with itself q words on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import chunks, mix, text_batches, word_hashes, words_of

_ENTRIES = 1_000_000


def segments(words: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the segments in which every word is frequent enough; ``first`` has each text's first word and the end."""
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    while len(at):
        key = mix(words[at] ^ (segment + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(at)))
        keep = np.empty(len(at), bool)
        keep[order] = np.repeat(count >= times, count)
        held, segment_ = at[keep], segment[keep]
        new = np.append(True, (np.diff(held) > 1) | (segment_[1:] != segment_[:-1]))[: len(held)]
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= least if len(held) else np.zeros(0, bool)
        settled = len(held) == len(at) and long.all()
        at, segment = held[long], number[long].astype(np.uint64)
        if settled:
            break
    begins = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])[: len(at)])
    return at[begins], at[np.append(begins[1:], len(at)) - 1] + 1 if len(at) else at


def _promising(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, times: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(segment, period, places) where three periods seem to follow each other, periods in ascending order for each segment."""
    size = ends - begins
    n_lags = size // times
    segment = np.repeat(np.arange(len(begins)), n_lags)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(n_lags) - n_lags, n_lags) + 1
    places = size[segment] // lag - 2
    ends_ = np.cumsum(places)
    a = 0
    while a < len(segment):
        z = max(a + 1, int(np.searchsorted(ends_, (ends_[a - 1] if a else 0) + _ENTRIES, "right")))
        number = np.repeat(np.arange(a, z), places[a:z])
        q = lag[number]
        c = begins[segment[number]] + (np.arange(len(number)) - np.repeat(np.cumsum(places[a:z]) - places[a:z], places[a:z])) * q
        for shift in (0, -1):
            for period in (0, 1):
                x = c + period * q + (shift * 1 + q if shift else 0)
                same = words[x] == words[x + q]
                number, q, c = number[same], q[same], c[same]
        cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(number)]):
            yield int(segment[number[x]]), int(q[x]), c[x:y]
        a = z


def periodic_runs(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(first word, length, least period) of all runs, in ascending order, of texts given by hashes of their words."""
    begins, ends = segments(words, first, least, times)
    found: list[tuple[int, int, int]] = []
    last, mine = -1, []
    for segment, q, places in _promising(words, begins, ends, times):
        if segment != last:
            last, mine = segment, []
        for start, length, period in mine:  # a multiple of a known run's period
            if q % period == 0:
                places = places[(places < start) | (places + 3 * q > start + length)]
        if not len(places):
            continue
        a, z = int(begins[segment]), int(ends[segment])
        same = np.concatenate([[False], words[a : z - q] == words[a + q : z], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x + q >= max(least, times * q) and not any(s == a + x and n == y - x + q for s, n, _ in mine):
                mine.append((a + x, y - x + q, q))
                found.append(mine[-1])
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, least: int = 6, times: int = 4, before: Callable[[list, list], list] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of docs (doc_id long, text string; other columns are ignored).

    Words are runs of anything but ASCII white space, numbered from 0. ``runs`` has (start, length, period) of every stretch whose least
    period is ``period`` words, of at least ``least`` words and ``times`` periods (4 or more), that no neighbouring word extends;
    they are sorted by start, then period, and may overlap. ``collapsed`` has the words joined by single spaces, without those that
    some run holds after its first period. Null and empty texts have no words. Each row is a text of its own: repeated rows and ids
    get equal results, a null id stays null; an empty table gives no rows. ``before`` may change texts: it gets lists of ids and texts
    and returns texts. Words are told apart by 64-bit hashes. Nothing is shuffled; a text is handled by one task.
    """
    if times < 4 or least < 2:
        raise ValueError("a run needs at least 4 periods and 2 words")
    text_batches(docs.sparkSession)

    def collapse(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if before:
                texts = pa.array(before(ids.to_pylist(), texts.to_pylist()), pa.large_string())
            for a, z, data, offsets in chunks(texts):
                starts, ends, first = words_of(data, offsets)
                runs = periodic_runs(word_hashes(data, starts, ends), first, least, times)
                depth = np.zeros(len(starts) + 1, np.int64)
                for start, length, period in runs:
                    depth[start + period] += 1
                    depth[start + length] -= 1
                kept = np.cumsum(depth[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~kept)])
                held = data.tobytes()
                out = []
                for k in range(z - a):
                    words = held[offsets[k] : offsets[k + 1]].split()
                    if gone[first[k + 1]] > gone[first[k]]:
                        words = [w for w, keep in zip(words, kept[first[k] : first[k + 1]].tolist()) if keep]
                    out.append(b" ".join(words))
                begin = np.array([r[0] for r in runs], np.int64)
                text = np.searchsorted(first, begin, "right") - 1
                fields = [begin - first[text], np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)]
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
                cuts = pa.array(np.searchsorted(text, np.arange(z - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(cuts, each), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(collapse, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
