"""Groups of spelling variants: words one edit apart, found by bit-sliced position indexes of the vocabulary.

An index has, for words of one length, a **bitset** over these words for each (position, letter). A query word walks through its
letters once for all words of the index at a time: the set that agrees so far with no error and the set with one are
narrowed together, by the bitset of the same position for replaced letters and of the next position after an
inserted one; a deleted letter is an inserted one seen from the other word.

The vocabulary is split so that each pair one edit apart meets in an index: the edit lies in the first or in the last
half of the shorter word, so the other half is shared. Words meet by the length of the shorter word and a shared half. Where
more than ``most`` words share one, the edit lies in either half of what is left, and so on, so that no group
grows with the vocabulary: at the end words agree in all letters but one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import groups, materialized, partitions, text_batches

_LETTERS = "a-zÀ-ÿ"
_QUERIES = 512


def word_counts(docs: DataFrame, least_length: int = 6, before: Callable[[object, dict], Iterable] | None = None, most_held: int = 200_000) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` letters of docs (doc_id, text), each task's counts added up first.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z become lower case. ``before`` may change a document's words: it gets
    the id and the counts of its words and returns (word, n).
    """
    text_batches(docs.sparkSession)
    run = re.compile(f"[{_LETTERS}]{{{least_length},}}")

    def count(batches):
        held: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                found = Counter(run.findall(text.as_buffer().to_pybytes().lower().decode()))
                for word, n in before(i, found) if before else found.items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > most_held:
                    yield flushed()
        if held:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Index:
    """Words of one length as bitsets by position and letter."""

    def __init__(self, words: list[str]):
        self.words = words
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        self.length = self.letters.shape[1]
        code = self.codes(self.letters)
        self.known, row = np.unique(code, return_inverse=True)
        width = -(-len(words) // 64)
        bits = np.zeros((len(self.known) + 1, 64 * width), bool)  # the last row: no word
        bits[row.reshape(code.shape), np.arange(len(words))[:, None]] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.all = np.packbits(np.arange(64 * width) < len(words), bitorder="little").view(np.uint64)

    def codes(self, letters: np.ndarray, shift: int = 0) -> np.ndarray:
        return letters.astype(np.int64) + (np.arange(letters.shape[1]) + shift) * 0x110000

    def rows(self, letters: np.ndarray, shift: int = 0) -> np.ndarray:
        """Which bitset is that of each letter ``shift`` places on."""
        code = self.codes(letters, shift)
        at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        return np.where(self.known[at] == code, at, len(self.known))

    def replaced(self, letters: np.ndarray) -> np.ndarray:
        """Bitsets of the words that differ from each query, of the same length, in one letter."""
        rows = self.rows(letters)
        none, one = np.repeat(self.all[None], len(letters), 0), np.zeros((len(letters), len(self.all)), np.uint64)
        for j in range(self.length):
            here = self.bits[rows[:, j]]
            one = (one & here) | (none & ~here)
            none &= here
        return one

    def longer(self, letters: np.ndarray) -> np.ndarray:
        """Bitsets of the words that have one letter more than each query."""
        here, next_ = self.rows(letters), self.rows(letters, 1)
        none, one = np.repeat(self.all[None], len(letters), 0), np.zeros((len(letters), len(self.all)), np.uint64)
        for j in range(letters.shape[1]):
            one = (one | none) & self.bits[next_[:, j]]
            none &= self.bits[here[:, j]]
        return one | none


def _set_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, column = np.nonzero(bits)
    each = np.unpackbits(bits[row, column].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(each)
    return row[k], column[k] * 64 + bit


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All ordered pairs of distinct words that are one inserted, deleted or replaced letter apart."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    indexes = {length: _Index(held) for length, held in by_length.items() if length}
    for length, index in indexes.items():
        for a in range(0, len(index.words), _QUERIES):
            queries = index.letters[a : a + _QUERIES]
            for q, v in zip(*_set_bits(index.replaced(queries))):
                yield index.words[a + q], index.words[v]
            if longer := indexes.get(length + 1):
                for q, v in zip(*_set_bits(longer.longer(queries))):
                    yield index.words[a + q], longer.words[v]
                    yield longer.words[v], index.words[a + q]


_KEY = ["size", "head", "tail"]


def _halves() -> Column:
    """The two groups for a shared half of what the letters in ``head`` and ``tail`` leave of the shorter word."""
    left = F.col("size") - F.length("head") - F.length("tail")
    first = F.floor(left / 2).cast("int")
    head, tail = F.length("head") + first, F.length("tail") + left - first
    return F.array(
        F.struct(F.expr("size").alias("size"), F.substring("word", F.lit(1), head).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.expr("size").alias("size"), F.col("head").alias("head"), F.substring("word", F.length("word") - tail + 1, tail).alias("tail")),
    )


def near_words(vocabulary: DataFrame, least_length: int, most: int = 4096) -> DataFrame:
    """(word, near, near_n): all pairs of words of the vocabulary (word, n), one edit apart, each once in either order."""
    split = lambda df: df.select(F.explode(_halves()).alias("k"), "word", "n").select("k.*", "word", "n")
    sizes = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= least_length)
    open_ = materialized(split(vocabulary.select("word", "n", F.explode(sizes).alias("size"), F.lit("").alias("head"), F.lit("").alias("tail"))))
    settled: list[DataFrame] = []
    while True:
        large = materialized(open_.groupBy(_KEY).count().where((F.col("count") > most) & (F.col("size") - F.length("head") - F.length("tail") > 1)).select(_KEY))
        if large.isEmpty():
            settled.append(open_)
            break
        settled.append(open_.join(large, _KEY, "left_anti"))
        open_ = materialized(split(open_.join(large, _KEY, "left_semi")))
    met = settled[0]
    for df in settled[1:]:
        met = met.unionByName(df)
    met = materialized(met)
    n_groups = max(1, -(-met.count() // most))

    def pairs(batches):
        for table in groups(batches, ["grp"]):
            n = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
            found = list(near_pairs(list(n)))
            for a in range(0, len(found), 50_000):
                held = found[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([y for _, y in held], pa.string()), pa.array([n[y] for _, y in held], pa.int64())], ["word", "near", "near_n"])

    dealt = met.select(F.pmod(F.xxhash64(*_KEY), F.lit(n_groups)).alias("grp"), "word", "n")
    found = dealt.repartition(partitions(vocabulary), "grp").sortWithinPartitions("grp").mapInArrow(pairs, "word string, near string, near_n long")
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that is reached from form to form; each round doubles the steps."""
    ends = materialized(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialized(ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, before: Callable[[object, dict], Iterable] | None = None, most: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text; other columns are ignored).

    Words are those of :func:`word_counts` with ``least_n`` occurrences or more. Words are near when one inserted, deleted or
    replaced code point turns one into the other. A word's ``form`` is its near word with the largest n, of equal ones the
    smallest in code-point order, if that occurs ``times`` times as often or more, else null; ``root`` is where following forms
    ends, the word itself without a form. Null and empty texts have no words, every row counts, repeated or not, and a row
    without an id counts like the others; an empty table gives no rows.
    """
    words = materialized(word_counts(docs, least_length, before).where(F.col("n") >= least_n))
    near = near_words(words, least_length, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    seen = materialized(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best")))
    roots = _roots(seen.where("best is not null").select("word", F.col("best.near").alias("form")))
    return seen.join(roots, "word", "left").select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), (-F.col("best.n")).alias("form_n"))
