"""Removal of long byte strings that occur anywhere else, by suffix arrays of shards.

Documents travel in **shards** of a few MB, each with its distinct texts once. A shard's **suffix array** is sorted by
Larsson-Sadakane refinement: suffixes start in the order of their first seven bytes, and groups that are still equal, and
only these, are sorted by the ranks of what follows, at twice the depth each round. **Kasai's** rule gives the common
prefix of neighbours: where the bytes before two neighbouring suffixes agree too, their common prefix is that of the
position before less one, so only the other positions compare bytes. Runs of neighbours with at least ``length`` common
bytes are the classes of a shard: a class of several suffixes repeats within the shard. **Between shards** each class is
known by one 64-bit label; a range of labels gets a sorted run from each shard, merges them, and finds by binary search
what each run has in common with the others.

Which suffixes can repeat at all is settled before any array is built: each window of ``length`` bytes is led by the
least hash of the strings of half its length in it. Equal windows are led by equal hashes in equal places, so a window
whose leading hash leads in one place only, of all documents, occurs once. The same exchange of labels finds these, and whole
texts that several shards hold: these are removed whole, and one shard keeps them in its array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _BASE, _BASE_INVERSE, _powers, groups, materialized, mix, partitions, text_batches
from .substring_dedup import _LAST

#: A byte takes nine bits of a key, so that the end of a text sorts before every byte.
_DEPTH, _BITS = 7, 9
_TEXT = np.uint64(0x5851F42D4C957F2D)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _opened(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _sorted_bytes(labels: np.ndarray) -> bytes:
    """Sorted labels as their differences, a plane a byte: the upper planes are nearly empty."""
    steps = np.diff(labels, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _sorted_labels(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the bytes of every window."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * _powers("up", _BASE, len(data)), out=total[1:])
    n = max(0, len(data) - length + 1)
    return mix((total[length : length + n] - total[:n]) * _powers("down", _BASE_INVERSE, len(data) + 1)[:n])


def _sliding(x: np.ndarray, width: int, best, worst: int) -> np.ndarray:
    """The least or largest of every ``width`` consecutive numbers."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, worst, np.uint64)]).reshape(-1, width)
    up = best.accumulate(rows, axis=1).ravel()
    down = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(down[:n], up[width - 1 : width - 1 + n])


def leaders(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What leads the windows of texts: (first window, number of windows, leading hash) of runs, and the hash of every place that leads."""
    part = max(1, length // 2)
    width = length - part + 1
    none = np.zeros(0, np.uint64)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none
    hashes = window_hashes(data, part)
    lead = _sliding(hashes, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    depth = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(depth, offsets[long], 1)
    np.add.at(depth, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(depth[: len(lead)]) > 0
    lead[~inside] = 0
    edge = np.zeros(width - 1, np.uint64)
    leads = hashes[_sliding(np.concatenate([edge, lead, edge]), width, np.maximum, 0)[: len(hashes)] == hashes]
    new = inside.copy()
    new[1:] &= (lead[1:] != lead[:-1]) | ~inside[:-1]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[long]] = True
    new |= begins[: len(new)] & inside
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return first, last - first + 1, lead[first], leads


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of texts in order, their ranks, the bytes left to each in its text, and the keys of their first bytes.

    A text's end sorts before all bytes; of ends, that of the earlier text comes first.
    """
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    wide = np.zeros(n + _DEPTH, np.uint64)
    wide[:n] = data
    wide[:n] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(_DEPTH):
        key <<= np.uint64(_BITS)
        key |= np.where(left > k, wide[k : k + n], np.uint64(0))
    order = np.argsort(key)
    held = key[order]
    new = np.ones(n, bool)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = _DEPTH
    while len(slots):
        at = order[slots]
        follows = np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)], at - n)
        both = (rank[at] << 32) + (follows + (1 << 31))
        by = np.argsort(both)
        both, at = both[by], at[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, rank, left, key


def _agree(data: np.ndarray, a: int, b: int, most: int) -> int:
    """How many bytes from two places on are equal."""
    at, step = 0, 256
    while at < most:
        size = min(step, most - at)
        differ = data[a + at : a + at + size] != data[b + at : b + at + size]
        if differ.any():
            return at + int(differ.argmax())
        at += size
        step *= 2
    return most


def common_prefixes(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, left: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place in the order the bytes that its suffix has in common with the one before."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    begins = np.zeros(n, bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    follows = (before >= 0) & ~begins & ~begins[before]
    follows &= data[np.arange(n) - 1] == data[before - 1]
    found = np.zeros(n, np.int64)
    a = np.flatnonzero(~follows & (before >= 0))
    while len(a):
        b, at = before[a], found[a]
        if len(a) <= 32:
            for x, y, z in zip(a.tolist(), b.tolist(), at.tolist()):
                found[x] = z + _agree(data, x + z, y + z, min(int(left[x]), int(left[y])) - z)
            break
        x, y = key[a + at], key[b + at]
        same = np.zeros(len(a), np.int64)
        for k in range(1, _DEPTH + 1):
            shift = np.uint64(_BITS * (_DEPTH - k))
            same += (x >> shift == y >> shift)
        room = np.minimum(left[a], left[b]) - at
        found[a] += np.minimum(same, room)
        a = a[(same == _DEPTH) & (room > _DEPTH)]
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    along = found[start] - (np.arange(n) - start)
    return along[order]


def repeats(data: np.ndarray, offsets: np.ndarray, open_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels in order, whether several suffixes have it) of the classes of windows that begin in open places."""
    if not open_.any():
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    order, _, left, key = suffix_array(data, offsets)
    new = common_prefixes(data, offsets, order, left, key) < length
    held = open_[order] & (left[order] >= length)
    number = np.cumsum(new)[held]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    several = np.diff(np.append(first, len(number))) > 1
    labels = window_hashes(data, length)[order[held][first]]
    by = np.argsort(labels, kind="stable")
    labels, several = labels[by], several[by]
    new = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.zeros(0, np.int64)
    return labels[new], np.logical_or.reduceat(several, new) if len(new) else several


class _Shard:
    """A shard's row, with its texts and what leads their windows."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.text_of = np.frombuffer(row["text_of"], np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
        self.bytes = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(self.offsets[-1]) + 1) if self.offsets[-1] else b""
        self.data = np.frombuffer(self.bytes, np.uint8)
        many, first = _answer(row["leading"])
        label = np.frombuffer(row["text_label"], np.int32)
        long = label >= 0
        self.copied = long.copy()
        self.copied[long] = many[label[long]]
        mine = long.copy()
        mine[long] = first[label[long]]
        begin, count, lead = (_opened(row[c], np.int32).astype(np.int64) for c in ("run_begin", "run_count", "run_lead"))
        begin = np.cumsum(begin)
        text = np.searchsorted(self.offsets, begin, "right") - 1
        use = many[lead] & mine[text]
        self.begin, self.count = begin[use], count[use]

    def regions(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes under windows that may repeat: (bytes, offsets of regions, which places are open, each open place in the shard)."""
        n = len(self.data)
        open_, under = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        np.add.at(open_, self.begin, 1)
        np.add.at(open_, self.begin + self.count, -1)
        np.add.at(under, self.begin, 1)
        np.add.at(under, self.begin + self.count + length - 1, -1)
        open_, under = np.cumsum(open_[:n]) > 0, np.cumsum(under[:n]) > 0
        begins = np.zeros(n, bool)
        begins[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        at = np.flatnonzero(under)
        new = np.flatnonzero(np.append(True, np.diff(at) > 1) | begins[at]) if len(at) else np.zeros(0, np.int64)
        return self.data[at], np.append(new, len(at)), open_[at], at[open_[at]]

    def kept(self, hit: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
        """What is left of each row when the windows that begin in the places of ``hit`` are gone, and texts with copies."""
        depth = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + length, -1)
        whole = np.flatnonzero(self.copied)
        np.add.at(depth, self.offsets[whole], 1)
        np.add.at(depth, self.offsets[whole + 1], -1)
        gone = np.cumsum(depth[:-1]) > 0
        cuts = self.offsets
        left = [self.data[a:z][~gone[a:z]].tobytes() if gone[a:z].any() else self.bytes[a:z] for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[cuts[:-1][np.diff(cuts) > 0]] = gone[cuts[:-1][np.diff(cuts) > 0]]
        spans = np.concatenate([[0], np.cumsum(opens)])
        n_spans, sizes = spans[cuts[1:]] - spans[cuts[:-1]], np.diff(cuts)
        removed = sizes - np.array([*map(len, left)], np.int64)
        for a in range(0, len(self.ids), 1000):
            ids, text = self.ids[a : a + 1000], self.text_of[a : a + 1000]
            yield _batch_of(doc_id=pa.array(ids, pa.int64(), mask=ids == _LAST), n_bytes=sizes[text], n_removed=removed[text], n_spans=n_spans[text], kept=pa.array([left[t] for t in text.tolist()], pa.binary()))


def _batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], list(columns))


_RUN = "grp int, shard long, n int, labels binary, several binary"
_RUN_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
_FOUND = "grp int, shard long, n int, repeated binary, first binary"


def _batch(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in names.split(", ")])


def _runs(shard: int, labels: np.ndarray, several: np.ndarray, n_groups: int) -> Iterator[pa.RecordBatch]:
    """A shard's sorted labels, cut into the ranges of labels, with a bit for those that it has several times."""
    group = (((labels >> np.uint64(32)) * np.uint64(n_groups)) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    if cuts:
        each = zip(cuts, [*cuts[1:], len(labels)])
        yield _batch([(int(group[a]), shard, z - a, _sorted_bytes(labels[a:z]), np.packbits(several[a:z]).tobytes()) for a, z in each], _RUN, _RUN_TYPES)


def _merged(runs: DataFrame, n_parts: int, name: str) -> DataFrame:
    """(shard, ``name``) of runs of sorted labels: which labels are several in a run or in other runs too, and which a run holds first."""

    def merge(batches):
        for table in groups(batches, ["grp"]):
            rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
            each = [_sorted_labels(r["labels"]) for r in rows]
            every = np.sort(np.concatenate(each), kind="stable")
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            seen = np.zeros(len(twice), bool)
            out = []
            for r, labels in zip(rows, each):
                at = np.searchsorted(twice, labels)
                shared = np.zeros(len(labels), bool)
                near = at < len(twice)
                shared[near] = twice[at[near]] == labels[near]
                first = ~shared
                first[shared] = ~seen[at[shared]]
                seen[at[shared]] = True
                shared |= np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(labels)).astype(bool)
                out.append((r["grp"], r["shard"], r["n"], np.packbits(shared).tobytes(), np.packbits(first).tobytes()))
            yield _batch(out, _FOUND, _RUN_TYPES)

    met = runs.repartition(n_parts, "grp").sortWithinPartitions("grp").mapInArrow(merge, _FOUND)
    return met.groupBy("shard").agg(F.collect_list(F.struct("grp", "n", "repeated", "first")).alias(name))


def _answer(parts: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of a shard's sorted labels are repeated, and of which it is the first shard."""
    parts = sorted(parts or (), key=lambda p: p["grp"])
    bits = lambda c: np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(p[c], np.uint8), count=p["n"]) for p in parts)]).astype(bool)
    return bits("repeated"), bits("first")


_SHARD = "shard long, n_bytes long, texts binary, lengths binary, ids binary, text_of binary, text_label binary, labels binary, many binary, run_begin binary, run_count binary, run_lead binary"
_SHARD_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 10)


def _pack(length: int, shard_bytes: int):
    """Rows (doc_id, text) to shards of about this size."""

    def shard(number: int, rows: list[tuple]) -> tuple:
        place: dict[bytes, int] = {}
        text_of = np.array([place.setdefault(t, len(place)) for _, t in rows], np.int32)
        texts = list(place)
        offsets = np.cumsum([0, *map(len, texts)])
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        copies = np.bincount(text_of, minlength=len(texts))
        begin, count, lead, leads = [], [], [], []
        first = 0
        while first < len(texts):  # half a MB at a time
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 500_000, "right")) - 1)
            x = leaders(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], length)
            begin.append(x[0] + offsets[first])
            count.append(x[1])
            lead.append(x[2])
            leads.append(x[3])
            first = end
        long = np.flatnonzero(np.diff(offsets) >= length)
        whole = np.array([window_hashes(data[offsets[k] : offsets[k + 1]], offsets[k + 1] - offsets[k])[0] for k in long], np.uint64)
        whole = mix((whole ^ _TEXT) + np.diff(offsets)[long].astype(np.uint64))
        begin, count, lead, leads = (np.concatenate(x) for x in (begin, count, lead, leads))
        labels, n = np.unique(np.concatenate([leads, np.repeat(whole, copies[long])]), return_counts=True)
        label = np.full(len(texts), -1, np.int32)
        label[long] = np.searchsorted(labels, whole)
        ids = np.array([_LAST if i is None else i for i, _ in rows], np.int64)
        return (
            number, len(joined), zstandard.compress(joined, 6), np.diff(offsets).astype(np.int64).tobytes(), ids.tobytes(), text_of.tobytes(), label.tobytes(), labels.tobytes(), np.packbits(n > 1).tobytes(),
            _squeeze(np.diff(begin, prepend=0).astype(np.int32)), _squeeze(count.astype(np.int32)), _squeeze(np.searchsorted(labels, lead).astype(np.int32)),
        )

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                if rows and size + len(text) > shard_bytes:
                    number += 1
                    yield _batch([shard(number, rows)], _SHARD, _SHARD_TYPES)
                    rows, size = [], 0
                rows.append((i, text))
                size += len(text)
        if rows:
            yield _batch([shard(number + 1, rows)], _SHARD, _SHARD_TYPES)

    return pack


def repeated_bytes(docs: DataFrame, length: int = 400, shard_bytes: int = 3_000_000, range_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of docs (doc_id long, text string; other columns are ignored).

    Each byte of a text's UTF-8 form that lies in a string of ``length`` bytes which also starts anywhere else, in this text
    or another, is removed; strings overlap freely, never cross texts, and are judged on the input. ``kept`` is binary, as a cut may
    fall within a character. Null and empty texts have no bytes. Every row is a text of its own, so rows that are repeated or
    share an id and a text remove each other, whatever their ids; a row without an id is treated like the others. An empty table gives no rows.
    Strings are told apart by 64-bit hashes between shards, and within a shard by their bytes. A text is held whole by one task.
    """
    if length < 2:
        raise ValueError("a string needs at least 2 bytes")
    n_parts = partitions(docs)
    text_batches(docs.sparkSession)
    shards = materialized(docs.select("doc_id", "text").mapInArrow(_pack(length, shard_bytes), _SHARD))
    total = shards.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    n_groups = max(n_parts, -(-total // range_bytes))

    def leading(batches):
        for batch in batches:
            for r in batch.to_pylist():
                labels = np.frombuffer(r["labels"], np.uint64)
                yield from _runs(r["shard"], labels, np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(labels)), n_groups)

    def classes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets, open_, _ = _Shard(row).regions(length)
                yield from _runs(row["shard"], *repeats(data, offsets, open_, length), n_groups)

    def apply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                data, _, open_, at = shard.regions(length)
                every, number = np.unique(window_hashes(data, length)[np.flatnonzero(open_)], return_inverse=True)
                hit = at[_answer(row["answers"])[0][number]] if len(at) else at
                yield from shard.kept(hit, length)

    led = materialized(_merged(shards.select("shard", "labels", "many").mapInArrow(leading, _RUN), n_parts, "leading"))
    known = shards.drop("labels", "many").join(led, "shard", "left")
    answers = _merged(known.mapInArrow(classes, _RUN), n_parts, "answers")
    return known.join(answers, "shard", "left").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
