"""Binary token-id shards with a minimal perfect hash index.

A shard holds the documents of a range of ids in ascending order, in two files:

* ``<shard>.ids``: all token ids, little-endian, without separators; 2 bytes each if the vocabulary allows it, else 4.
* ``<shard>.idx``: a header (magic, version, bytes an id, numbers of documents, keys and hash levels), the number of the
  first id of each document and of the end, the sizes and bit vectors of the hash levels, and for each key, at the place
  that the hash gives it, a stored 32-bit fingerprint, the key's first document and its number of documents.

The hash is minimal and perfect: at each level the keys fall into a bit vector twice their number; a key that is alone
in its slot sets the bit and stays, the others go to the next level; a key's place is the number of bits set before
its own. A look-up touches one bit a level, one table entry and the payload: constant time, however many documents a
shard has. The keys aren't stored; fingerprints tell a foreign key (but for one in 2^32).

Files are written under another name and renamed, so a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, id_cuts, mix, partitions, place_of, text_batches, word_hashes

_MAGIC, _HEADER = b"TOKIDX01", struct.Struct("<8sIIQQI")
_SPREAD = 2


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) for b in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            slot = _slot(keys, len(levels), size := max(1, _SPREAD * len(keys)))
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[slot]]
        return cls(levels)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, from 0; of a foreign key any place, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            slot = _slot(keys[rest], level, len(bits))
            hit = bits[slot]
            out[rest[hit]] = self.before[level] + self.ranks[level][slot[hit]]
            rest = rest[~hit]
        return out


def index_bytes(keys: np.ndarray, known: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """keys: of each document, ascending where known."""
    own, first, n = np.unique(keys[known], return_index=True, return_counts=True)
    first = np.flatnonzero(known)[first] if len(own) else first
    perfect = PerfectHash.of(own)
    place = perfect.place(own)
    table = np.zeros(len(own), np.dtype([("print", "<u4"), ("first", "<u4"), ("n", "<u4")]))
    table["print"][place], table["first"][place], table["n"][place] = _fingerprint(own), first, n
    out = io.BytesIO()
    out.write(_HEADER.pack(_MAGIC, 1, width, len(keys), len(own), len(perfect.levels)))
    out.write(offsets.astype("<u8").tobytes())
    for bits in perfect.levels:
        out.write(struct.pack("<Q", len(bits)) + np.packbits(bits, bitorder="little").tobytes())
    out.write(table.tobytes())
    return out.getvalue()


class Shard:
    """Random access to a shard's documents by key."""

    def __init__(self, files: fs.FileSystem, path: str):
        with files.open_input_stream(f"{path}.idx") as f:
            raw = f.read()
        magic, _, self.width, n, keys, levels = _HEADER.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError(f"{path}.idx is not an index of token ids")
        at = _HEADER.size
        self.offsets = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        found = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            found.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at + 8), count=size, bitorder="little").astype(bool))
            at += 8 + -(-size // 8)
        self.hash = PerfectHash(found)
        self.table = np.frombuffer(raw, np.dtype([("print", "<u4"), ("first", "<u4"), ("n", "<u4")]), keys, at)
        self.ids = files.open_input_file(f"{path}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 of them for a key that the shard doesn't have."""
        place = self.hash.place(keys)
        known = place >= 0
        known[known] = self.table["print"][place[known]] == _fingerprint(keys[known])
        entry = self.table[np.where(known, place, 0)] if len(self.table) else np.zeros(len(keys), self.table.dtype)
        return entry["first"].astype(np.int64), np.where(known, entry["n"], 0)

    def read(self, document: int, documents: int = 1) -> np.ndarray:
        a, b = int(self.offsets[document]), int(self.offsets[document + documents])
        return np.frombuffer(self.ids.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


class Encoder:
    """The tokenizer's ids of whole texts; each distinct piece of text is encoded once.

    A byte-level pre-tokenizer cuts before a blank, and before and after a line end, that stands between characters
    other than white space; so the ids of a text are those of the pieces between such cuts, in order. Pieces are told
    apart by 64-bit hashes. Texts that hold a special token's string are encoded whole, and so are all texts of a
    tokenizer of another kind.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 2_000_000):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"].encode() for t in described["added_tokens"]]
        pre = described["pre_tokenizer"] or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not described["normalizer"] and not pre.get("add_prefix_space")
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("Ġ")
        self.clear()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def clear(self) -> None:
        self.hashes, self.begins, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _many(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [x.ids for x in encode(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], alone: np.ndarray) -> None:
        """alone: pieces that begin with a blank and hold no other white space; many of these are encoded as one text."""
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(pieces), np.int64)
        order: list[int] = []
        each = np.flatnonzero(~alone).tolist()
        joined = np.flatnonzero(alone)
        parts = [joined[a : a + 500] for a in range(0, len(joined), 500)]
        for part, got in zip(parts, self._many([b"".join(pieces[k] for k in part.tolist()).decode() for part in parts])):
            got = np.array(got, np.uint32)
            cuts = np.append(np.flatnonzero(self.opens[got]), len(got))
            if len(cuts) != len(part) + 1 or cuts[0]:
                each += part.tolist()
                continue
            ids.append(got)
            lengths[part] = np.diff(cuts)
            order += part.tolist()
        got = self._many([pieces[k].decode() for k in each])
        lengths[each] = [len(x) for x in got]
        ids += [np.array(x, np.uint32) for x in got]
        order += each
        begins = np.zeros(len(pieces), np.int64)
        begins[order] = len(self.flat) + np.cumsum(lengths[order]) - lengths[order]
        self.flat = np.concatenate([self.flat, *ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begins, self.lengths = np.insert(self.hashes, at, hashes), np.insert(self.begins, at, begins), np.insert(self.lengths, at, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; null is empty."""
        flat, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in chunks(texts):
            a, b = self._chunk(data, offsets)
            flat.append(a)
            n.append(b)
        return np.concatenate(flat), np.concatenate(n)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        whole = np.array([not self.by_piece or any(s in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) if not self.by_piece or any(s in raw for s in self.special) else np.zeros(len(offsets) - 1, bool)
        white = white_bytes(data)
        starts = piece_starts(data, offsets, white)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        with np.errstate(over="ignore"):
            hashed = word_hashes(data, starts, ends)
        if whole.any():
            keep = ~np.repeat(whole, np.diff(first))
            starts, ends, hashed = starts[keep], ends[keep], hashed[keep]
            first = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(first)))])
        own, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, own)
        fresh = at == len(self.hashes)
        fresh[~fresh] = self.hashes[at[~fresh]] != own[~fresh]
        if fresh.any():
            a, b = starts[where[fresh]], ends[where[fresh]]
            total = np.concatenate([[0], np.cumsum(white)])
            self._learn(own[fresh], [raw[x:y] for x, y in zip(a.tolist(), b.tolist())], (data[a] == 32) & (total[b] - total[a] == 1) & (b - a > 1))
            at = np.searchsorted(self.hashes, own)
        begin, length = self.begins[at][inverse], self.lengths[at][inverse]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        n = total[first[1:]] - total[first[:-1]]
        if whole.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.array(self._many([raw[offsets[k] : offsets[k + 1]].decode()])[0], np.uint32)
                n[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, n


#: ASCII white space and the separators next to it, and the UTF-8 forms of the other white space characters.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space characters."""
    white = _WHITE[data]
    for lead in {c[0] for c in _WIDE_WHITE}:
        at = np.flatnonzero(data == lead)
        for c in (c for c in _WIDE_WHITE if c[0] == lead) if len(at) else ():
            inside = at[at + len(c) <= len(data)]
            for k in range(1, len(c)):
                inside = inside[data[inside + k] == c[k]]
            for k in range(len(c)):
                white[inside + k] = True
    return white


def piece_starts(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin."""
    cut = np.zeros(len(data) + 2, bool)
    single = np.zeros(len(data), bool)
    single[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
    edges = offsets[offsets < len(data)]
    single[edges] = False
    single[offsets[offsets > 0] - 1] = False
    cut[: len(data)] = single & ((data == 32) | (data == 10))
    cut[np.flatnonzero(single & (data == 10)) + 1] = True
    cut[edges] = True
    return np.flatnonzero(cut[: len(data)])


def _folder(spark: SparkSession, path: str) -> str:
    """The path with its scheme, also where it names the session's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _shard_of(folder: str, shard: int) -> str:
    return f"{folder}/{shard:08d}"


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, shard_docs: int = 20_000) -> DataFrame:
    """Encode docs (doc_id long, text string; other columns are ignored) and write them below ``path``.

    Each document is encoded whole (null as empty) and ``end_id`` is appended to it unless None. Shards cover ranges of
    doc_id; rows with one doc_id stay together, in the order of their texts, and rows without a doc_id come first and
    have no key. Returns the manifest (shard, least, most, n_docs, n_ids), of a row a shard.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = _folder(spark, path)
    docs = docs.select("doc_id", "text")
    n = docs.count()
    n_shards = max(1, -(-n // shard_docs), min(partitions(docs), -(-n // 500)))
    shard = place_of("doc_id", id_cuts(docs, n_shards))

    def write(batches):
        files, top = _open(folder)
        files.create_dir(top, recursive=True)
        encoder = Encoder.at(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
        current: int | None = None

        def close():
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            keys = np.concatenate(ids)
            known_ = np.concatenate(has)
            with files.open_output_stream(f"{made}.idx") as f:
                f.write(index_bytes(keys, known_, offsets, width))
            payload.close()
            for kind in ("ids", "idx"):
                files.move(f"{made}.{kind}", f"{_shard_of(top, current)}.{kind}")
            return (current, int(keys[known_].min()) if known_.any() else None, int(keys[known_].max()) if known_.any() else None, len(keys), int(offsets[-1]))

        out = []
        for batch in batches:
            number = batch.column(0).to_numpy()
            a = 0
            while a < batch.num_rows:
                if number[a] != current:
                    if current is not None:
                        out.append(close())
                    current = int(number[a])
                    made = f"{top}/.{current:08d}-{uuid.uuid4().hex}"
                    payload = files.open_output_stream(f"{made}.ids")
                    ids, has, lengths = [], [], []
                z = a + int((number[a:] == current).sum())
                flat, n = encoder.encode(batch.column(2).slice(a, z - a))
                if end_id is not None:
                    flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                payload.write(flat.astype(f"<u{width}").tobytes())
                key = batch.column(1).slice(a, z - a)
                ids.append(key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                has.append(key.is_valid().to_numpy(zero_copy_only=False))
                lengths.append(n)
                a = z
        if current is not None:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "least", "most", "n_docs", "n_ids"])

    placed = docs.select(shard.alias("shard"), "doc_id", "text").repartition(partitions(docs), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    manifest = placed.mapInArrow(write, "shard int, least long, most long, n_docs long, n_ids long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_shards(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents with the given keys (doc_id), each looked up in its shard's index.

    start counts the ids of all documents before it, ids are the bytes of its ids as little-endian unsigned 32-bit integers. A key with several documents yields a row for each,
    an unknown or null key none.
    """
    folder = _folder(spark, path)
    # one row a shard: thousands for terabytes of text
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("before", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))
    shards = [(r["shard"], r["least"], r["most"], r["before"]) for r in manifest.where("least is not null").orderBy("shard").collect()]
    least, most = np.array([r[1] for r in shards], np.int64), np.array([r[2] for r in shards], np.int64)
    number, before = np.array([r[0] for r in shards], np.int64), np.array([r[3] for r in shards], np.int64)

    def route(batches):
        for batch in batches:
            key = batch.column(0).drop_null().to_numpy().astype(np.int64)
            at = np.maximum(np.searchsorted(least, key, "right") - 1, 0) if len(least) else np.zeros(0, int)
            key = key[: len(at)]
            inside = (key >= least[at]) & (key <= most[at]) if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(at[inside], pa.int32()), pa.array(key[inside])], ["at", "doc_id"])

    def look_up(batches):
        files, top = _open(folder)
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            at, keys_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                k = int(at[a])
                if opened is None or opened[0] != k:
                    opened = k, Shard(files, _shard_of(top, int(number[k])))
                shard = opened[1]
                first, n = shard.find(keys_[a:z])
                out = []
                for key, f, m in zip(keys_[a:z].tolist(), first.tolist(), n.tolist()):
                    for d in range(f, f + m):
                        out.append((key, int(before[k] + shard.offsets[d]), shard.read(d).astype("<u4")))
                        if len(out) == 500:
                            yield _found(out)
                            out = []
                if out:
                    yield _found(out)

    routed = keys.select("doc_id").distinct().mapInArrow(route, "at int, doc_id long")
    return routed.repartition(partitions(keys), "at").sortWithinPartitions("at", "doc_id").mapInArrow(look_up, "doc_id long, start long, n_tokens long, ids binary")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
