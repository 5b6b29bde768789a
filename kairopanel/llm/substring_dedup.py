"""Removal of word sequences that a document with a smaller id holds too, by prefix-partitioned suffix trees.

Every word position that has enough words after it starts a suffix. Suffixes are split by **variable-length prefixes**:
one pass counts them by the classes of their first two words; first words with few suffixes share a group, frequent
ones are split by the second word, and very frequent pairs by all words of the window: what such a group holds more than its
share of is one sequence, of which a block sends one. A group's
**subtree** is cut at the wanted depth: its leaves are the suffixes in the order of their path labels (a 64-bit hash of
the first ``words`` words), and a run of equal labels is an internal node at that depth. A node whose suffixes come from
several documents is a repeat; the nodes of consecutive positions make up the maximal repeats, whose words are removed
from all documents but the one with the smallest id.

Documents travel in compressed blocks. A block sends each distinct suffix once, however many of its documents hold it,
so a passage that a third of all documents share is one row a block; and a group answers with one flag for a suffix of a
block. Blocks are written once to the shared folder, so that a repeated task numbers them alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grams, groups, materialized, partitions, text_batches, word_hashes, words_of

_CLASSES = 256
_LAST = np.iinfo(np.int64).max


def _least(x: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest type, which is named by the first byte, compressed: most are far below the largest."""
    most = int(x.max()) if len(x) else 0
    kind = next(k for k, top in ((1, 1 << 8), (2, 1 << 16), (4, 1 << 32), (8, 1 << 64)) if most < top)
    return zstandard.compress(bytes([kind]) + x.astype(f"<u{kind}").tobytes(), 1)


def _wide(x: bytes) -> np.ndarray:
    x = zstandard.decompress(x)
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


def _pack(block_bytes: int):
    """Rows (doc_id, text) to blocks of about this size, the documents of each in ascending order of their ids."""

    def pack(batches):
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId()) << 32
        squeeze = zstandard.ZstdCompressor(level=6)

        def block():
            nonlocal number
            rows.sort(key=lambda r: (_LAST if r[0] is None else r[0], r[2]))
            number += 1
            columns = [[number], [squeeze.compress(b"".join(r[2] for r in rows))], [np.array([len(r[2]) for r in rows], np.int64).tobytes()], [np.array([_LAST if r[0] is None else r[0] for r in rows], np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["block", "texts", "lengths", "ids"])

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                if rows and size + len(text) > block_bytes:
                    yield block()
                    rows, size = [], 0
                rows.append((i, t.is_valid, text))
                size += len(text)
        if rows:
            yield block()

    return pack


class _Block:
    """The suffixes of a block: distinct labels in the order of their first document, so in ascending order of ids."""

    def __init__(self, texts: bytes, lengths: bytes, ids: bytes, words: int):
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
        self.ids = np.frombuffer(ids, np.int64)
        self.bytes = zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(self.offsets[-1]) + 1) if self.offsets[-1] else b""
        data = np.frombuffer(self.bytes, np.uint8)
        labels, at, docs, self.words = [], [], [], []
        first = 0
        self.word_count = np.zeros(len(self.ids), np.int64)
        while first < len(self.ids):  # half a MB at a time
            end = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + 500_000, "right")) - 1)
            base = int(self.offsets[first])
            starts, ends, word = words_of(data[base : self.offsets[end]], self.offsets[first : end + 1] - base)
            with np.errstate(over="ignore"):
                hashed = word_hashes(data[base : self.offsets[end]], starts, ends)
                label = grams(hashed, words)
            before = int(self.word_count.sum())
            self.word_count[first:end] = np.diff(word)
            n = np.maximum(np.diff(word) - words + 1, 0)
            doc = np.repeat(np.arange(first, end), n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(word[:-1], n)
            labels.append(label[place])
            docs.append(doc)
            at.append(place + before)
            self.words.append(hashed)
            first = end
        self.label, self.doc, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (labels, docs, at))
        self.words = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        order = np.argsort(self.label, kind="stable")  # stable: of equal labels the one of the smallest id comes first
        new = np.ones(len(order), bool)
        new[1:] = self.label[order[1:]] != self.label[order[:-1]]
        firsts = order[new]
        rank = np.empty(len(firsts), np.int64)
        rank[np.argsort(firsts, kind="stable")] = np.arange(len(firsts))
        self.node = np.empty(len(order), np.int64)
        self.node[order] = rank[np.cumsum(new) - 1]
        self.first = np.sort(firsts)  # of each node the first suffix

    def prefix(self, suffix: np.ndarray) -> np.ndarray:
        """The classes of the first two words."""
        at = self.at[suffix]
        return (self.words[at] % np.uint64(_CLASSES)).astype(np.int64) * _CLASSES + (self.words[at + 1] % np.uint64(_CLASSES)).astype(np.int64)

    def further(self, suffix: np.ndarray) -> np.ndarray:
        """A number for the words of the whole window."""
        return self.label[suffix] >> np.uint64(17)


def plan_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each two-word prefix its first group and how many groups it is split into; the number of groups."""
    first, split = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, filled = 0, 0
    for a in range(0, len(counts), _CLASSES):
        whole = int(counts[a : a + _CLASSES].sum())
        for b, n in [(slice(a, a + _CLASSES), whole)] if whole <= most else [(slice(i, i + 1), int(counts[i])) for i in range(a, a + _CLASSES)]:
            if n > most:
                group += bool(filled)
                first[b], split[b] = group, -(-n // most)
                group, filled = group + -(-n // most), 0
                continue
            if filled + n > most:
                group, filled = group + 1, 0
            first[b] = group
            filled += n
    return first, split, group + 1


def substring_dedup(docs: DataFrame, words: int = 50, block_bytes: int = 6_000_000, group_suffixes: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of docs (doc_id long, text string; other columns are ignored).

    Words are runs of anything but ASCII white space. A window is ``words`` (at least 4) consecutive words of one
    document; all words of a window whose sequence also starts in a document with a smaller doc_id are removed, and the
    kept ones are joined by single spaces. Windows are judged on the input. Null and empty texts have no words. Rows with
    equal ids take nothing from each other; a null doc_id counts as larger than all others.
    """
    if words < 4:
        raise ValueError("a window needs at least 4 words")
    n_parts = partitions(docs)
    text_batches(docs.sparkSession)
    blocks = materialized(docs.select("doc_id", "text").mapInArrow(_pack(block_bytes), "block long, texts binary, lengths binary, ids binary"))

    def opened(batches) -> Iterator[tuple[int, _Block, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row["block"], _Block(row["texts"], row["lengths"], row["ids"], words), row

    def count(batches):
        for _, b, _ in opened(batches):
            n = np.bincount(b.prefix(b.first), minlength=1)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["prefix", "n"])

    counts = np.zeros(_CLASSES * _CLASSES, np.int64)
    for prefix, n in blocks.mapInArrow(count, "prefix int, n long").groupBy("prefix").sum("n").collect():  # 65,536 rows at most
        counts[prefix] = n
    first, split, n_groups = plan_groups(counts, max(1, min(group_suffixes, int(counts.sum()) // (2 * n_parts))))

    def suffixes(batches):
        for block, b, _ in opened(batches):
            prefix = b.prefix(b.first)
            group = first[prefix]
            more = split[prefix]
            large = more > 1
            group = group + np.where(large, (b.further(b.first) % more.astype(np.uint64)).astype(np.int64), 0)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            out = []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                node = order[a:z]
                suffix = b.first[node]
                docs_, n = np.unique(b.doc[suffix], return_counts=True)
                ids = b.ids[docs_]
                out.append((int(group[node[0]]), block, b.label[suffix].tobytes(), _least(np.diff(node, prepend=0)), int(ids[0]), _least((ids - ids[0]).astype(np.uint64)), _least(n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["grp", "block", "labels", "nodes", "least", "ids", "n"])

    def subtrees(batches):
        for table in groups(batches, ["grp"]):
            rows = table.to_pylist()
            label = np.concatenate([np.frombuffer(r["labels"], np.uint64) for r in rows])
            node = np.concatenate([np.cumsum(_wide(r["nodes"]).astype(np.int64)) for r in rows])
            doc = np.concatenate([np.repeat(_wide(r["ids"]).astype(np.int64) + r["least"], _wide(r["n"])) for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(r["labels"]) // 8 for r in rows])
            order = np.argsort(label, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = label[order[1:]] != label[order[:-1]]
            least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            later = order[doc[order] > least]
            later = later[np.argsort(row[later], kind="stable")]
            cuts = np.searchsorted(row[later], np.arange(len(rows) + 1))
            out = [(r["block"], np.sort(node[later[a:z]]).astype(np.int32).tobytes()) for r, a, z in zip(rows, cuts, cuts[1:]) if z > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["block", "nodes"])

    def apply(batches):
        for _, b, row in opened(batches):
            later = np.zeros(len(b.first), bool)
            for nodes in row["later"] or ():
                later[np.frombuffer(nodes, np.int32)] = True
            gone = later[b.node] | (b.ids[b.doc] > b.ids[b.doc[b.first]][b.node])
            depth = np.zeros(len(b.words) + 1, np.int64)
            np.add.at(depth, b.at[gone], 1)
            np.add.at(depth, b.at[gone] + words, -1)
            kept = np.cumsum(depth[:-1]) == 0
            ends = np.cumsum(b.word_count)
            total = np.concatenate([[0], np.cumsum(~kept)])
            removed = total[ends] - total[ends - b.word_count]
            texts = []
            for k in range(len(b.ids)):
                each = b.bytes[b.offsets[k] : b.offsets[k + 1]].split()
                if removed[k]:
                    each = [w for w, keep in zip(each, kept[ends[k] - b.word_count[k] : ends[k]].tolist()) if keep]
                texts.append(b" ".join(each))
                if len(texts) >= 2000 or k == len(b.ids) - 1:
                    at = slice(k + 1 - len(texts), k + 1)
                    ids = pa.array(b.ids[at], pa.int64(), mask=b.ids[at] == _LAST)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(b.word_count[at]), pa.array(removed[at], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
                    texts = []

    sent = blocks.mapInArrow(suffixes, "grp int, block long, labels binary, nodes binary, least long, ids binary, n binary")
    nodes = sent.repartition(n_parts, "grp").sortWithinPartitions("grp").mapInArrow(subtrees, "block long, nodes binary")
    later = nodes.groupBy("block").agg(F.collect_list("nodes").alias("later"))
    return blocks.join(later, "block", "left").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
