"""I-Match fingerprints over randomised lexicons, with DataFrame functions only.

Terms are the distinct lower-cased words. The lexicon holds those whose inverse document frequency is in a band: held by at
least ``least`` and at most ``most`` of all documents. At most (mean number of distinct terms of a document) / ``least`` terms
can be in it, however many documents there are, so it is broadcast.

``SUBSETS`` random lexicons are drawn, each as a series that halves: a term is in lexicon i at level l with probability
2 ** -l. A text with m terms in the band is fingerprinted at the level where a lexicon keeps about half a term or one of it, and at the
next one: its terms in the lexicon, distinct and sorted, are hashed to one signature a lexicon. Two fingerprints are
compared at a level that both have: likeness is the share of equal signatures among the lexicons that keep
something of either text.

Where a large family of near copies puts its own terms above the band, or a text has only frequent or only rare words,
fewer than ``FEW`` of its terms are in it. Such a text is fingerprinted by the terms of an unbanded lexicon that follows
its size: the ``SUBSETS`` of all its terms with the least hashes. Two fingerprints of which either is of this kind are
compared by these: the share of the least hashes of both together that both have. A text without terms has the hash of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_cuts, materialized, place_of

SUBSETS = 16
FEW = 4
_TOP = 15


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    words = F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, least: float, most: float) -> DataFrame:
    """(t, p, q): hashes of the terms in the band, for each random lexicon four bits: the highest level the term is in, and the highest of these.

    A term with hash 0 and no levels stands for what every text has.
    """
    n = docs.select("doc_id").count()
    held = docs.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("t")).groupBy("t").count()
    held = held.where(F.col("count").between(max(2, math.ceil(least * n)), max(2, math.floor(most * n)))).where("t <> 0").select("t")

    def level(i: int) -> Column:
        u = F.pmod(F.xxhash64("t", F.lit(i)), F.lit(1 << 30)) + 1
        return F.least(F.floor(30 - F.log2(u)), F.lit(_TOP)).cast("long")

    held = held.withColumns({f"l{i}": level(i) for i in range(SUBSETS)})
    packed = F.lit(0).cast("long")
    for i in range(SUBSETS):
        packed = packed.bitwiseOR(F.shiftleft(F.col(f"l{i}"), 4 * i))
    top = F.greatest(*[F.col(f"l{i}") for i in range(SUBSETS)])
    return held.select("t", packed.alias("p"), top.cast("int").alias("q")).unionByName(docs.sparkSession.sql("SELECT 0L AS t, 0L AS p, 0 AS q"))


def _level(x: Column, i: Column) -> Column:
    """The highest level at which the term x is in lexicon i."""
    return F.call_function("shiftrightunsigned", x["p"], (i * 4).cast("int")).bitwiseAND(F.lit(15))


def _signatures(kept: Column, level: Column) -> Column:
    """A hash of the sorted terms that each lexicon has at the level; kept holds all it has at a level below or at this one."""

    def one(i: Column) -> Column:
        own = F.filter(F.get(kept, i), lambda x: _level(x, i) >= level)
        signature = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.array_sort(F.transform(own, lambda x: x["t"]))))), 16, "0"), 9, 8)
        return F.when(F.size(own) > 0, signature).otherwise(F.lit("-"))

    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)


def likeness(x: Column, y: Column) -> Column:
    """Of two (level, a, b, u, w): the share of equal signatures at the finer level, among the lexicons that keep something of either; of the unbanded terms where either has level 0."""
    both = F.slice(F.array_sort(F.array_union(x["u"], y["u"])), 1, SUBSETS)
    shared = F.size(F.filter(both, lambda h: F.array_contains(x["u"], h) & F.array_contains(y["u"], h)))
    unbanded = F.when(F.size(both) == 0, (x["w"] == y["w"]).cast("double")).otherwise(shared / F.size(both))
    finer = F.greatest(x["level"], y["level"])
    of = lambda z: F.when(z["level"] == finer, z["a"]).otherwise(z["b"])
    pairs = F.arrays_zip(of(x).alias("u"), of(y).alias("v"))
    used = F.filter(pairs, lambda p: (p["u"] != "-") | (p["v"] != "-"))
    same = F.filter(used, lambda p: p["u"] == p["v"])
    banded = F.when((x["a"] == y["a"]) & (x["b"] == y["b"]), 1.0).when((F.abs(x["level"] - y["level"]) > 1) | (F.size(used) == 0), 0.0).otherwise(F.size(same) / F.size(used))
    return F.when(x["w"] == y["w"], 1.0).when((x["level"] == 0) | (y["level"] == 0), unbanded).otherwise(banded)


def as_text(x: Column) -> Column:
    unbanded = F.when(F.size(x["u"]) > 0, F.array_join(F.transform(x["u"], lambda h: F.lower(F.hex(h))), ".")).otherwise(x["w"])
    return F.when(x["level"] > 0, F.concat_ws(":", x["level"].cast("string"), F.array_join(x["a"], "."), F.array_join(x["b"], "."))).otherwise(F.concat(F.lit("0:"), unbanded))


def fingerprints(rows: DataFrame, words: DataFrame, keys: list[str], texts: list[str], most_broadcast: int = 2_000_000) -> DataFrame:
    """rows with, in place of each of the named text columns, its fingerprint (level, a, b, u, w); keys tell the rows apart.

    No shuffle where the rows are already dealt by some of the keys: a text's terms meet the lexicon where the text is. A lexicon
    of more than ``most_broadcast`` terms isn't broadcast, but joined by term.
    """
    words = materialized(words)
    lexicon_ = F.broadcast(words) if words.count() <= most_broadcast else words
    others = [c for c in rows.columns if c not in texts and c not in keys]
    whole = [F.xxhash64(F.coalesce(c, F.lit(""))).alias(f"__whole{k}") for k, c in enumerate(texts)]
    n = range(len(texts))
    rows = rows.select(*keys, *others, *whole, *[term_hashes(F.coalesce(c, F.lit(""))).alias(f"__hashes{k}") for k, c in enumerate(texts)])

    def tagged(k: int) -> Column:
        """The terms of the k-th text, and the one that every text has, with the least of them."""
        own = F.transform(f"__hashes{k}", lambda h: F.struct(F.lit(k).alias("k"), h.alias("t"), F.lit(None).cast("array<bigint>").alias("u")))
        return F.array_append(own, F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("t"), F.slice(F.array_sort(f"__hashes{k}"), 1, SUBSETS).alias("u")))

    def high_enough(terms: Column, level: Column) -> Column:
        """The terms that some lexicon has at the level."""
        return F.filter(terms, lambda x: x["q"] >= level)

    def at_level(terms: Column, level: Column) -> Column:
        """For each lexicon the terms that it has at the level."""
        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: F.filter(terms, lambda x: _level(x, i) >= level))

    kept_columns = [*keys, *others, *[f"__whole{k}" for k in n]]
    long = rows.select(*kept_columns, F.explode(F.concat(*[tagged(k) for k in n])).alias("__x")).select(*kept_columns, "__x.k", "__x.t", "__x.u").join(lexicon_, "t")
    own = [F.collect_list(F.when((F.col("k") == k) & (F.col("t") != 0), F.struct("t", "p", "q"))).alias(f"__terms{k}") for k in n]
    least = [F.first(F.when(F.col("k") == k, F.col("u")), ignorenulls=True).alias(f"__u{k}") for k in n]
    met = long.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others], *[F.first(f"__whole{k}").alias(f"__whole{k}") for k in n], *own, *least)
    for k, c in enumerate(texts):
        terms, level, kept = F.col(f"__terms{k}"), F.col(f"__level{k}"), F.col(f"__kept{k}")
        met = met.withColumn(f"__level{k}", F.when(F.size(terms) >= FEW, F.least(F.floor(F.log2(F.size(terms))) + 1, F.lit(_TOP - 1)).cast("int")).otherwise(0))
        met = met.withColumn(f"__kept{k}", F.when(level > 0, high_enough(terms, level))).drop(f"__terms{k}")  # a dozen terms
        met = met.withColumn(f"__kept{k}", at_level(kept, level))
        none = F.array().cast("array<string>")
        met = met.withColumn(c, F.struct(
            level.alias("level"), F.when(level > 0, _signatures(kept, level)).otherwise(none).alias("a"), F.when(level > 0, _signatures(kept, level + 1)).otherwise(none).alias("b"),
            F.col(f"__u{k}").alias("u"), F.lower(F.hex(f"__whole{k}")).alias("w"),
        ))
    return met.select(*keys, *others, *texts)


def document_fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.1) -> DataFrame:
    """(doc_id, fingerprint) of docs (doc_id, text; other columns are ignored); equal texts have equal fingerprints, null is like an empty text, whatever their length.

    Repeated rows yield a row each.
    """
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    found = fingerprints(rows, lexicon(docs, least, most), ["__row"], ["text"])
    return found.select("doc_id", as_text(F.col("text")).alias("fingerprint"))


def fingerprint_report(docs: DataFrame, least: float = 0.001, most: float = 0.1, block_docs: int = 256) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs (doc_id long, text).

    The documents are taken in descending order of doc_id, equal ids in the order of their texts and null ids last; after the last comes
    the first. A document's edited text has its last third (rounded down) replaced by as many code points from the start of the
    next document, or all of them. Likeness to the edited text and to the next document is between 0 and 1. Null is an empty text.

    Documents are dealt by ranges of doc_id with about as many documents each, however the ids lie; only the first document of a range is also sent to the range before it.
    """
    docs = docs.select("doc_id", "text")
    words = lexicon(docs, least, most)
    block = F.when(F.col("doc_id").isNull(), -1).otherwise(place_of("doc_id", id_cuts(docs, min(4096, docs.count() // block_docs)))).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    # a row a range, some 4,096 at most; the inverted bits of an id are in the opposite order
    heads = rows.groupBy("block").agg(F.min(F.struct(F.bitwise_not("doc_id"), "text"))["text"].alias("text"))
    places = rows.select("block").distinct()
    following = F.coalesce(F.lead("block").over(Window.orderBy(F.desc("block"))), F.max("block").over(Window.partitionBy()))
    after = places.select("block", following.alias("next_block")).join(heads.select(F.col("block").alias("next_block"), F.col("text").alias("head")), "next_block")

    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    rows = rows.join(after, "block").withColumn("last", F.col("next").isNull()).withColumn("next", F.coalesce("next", "head"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    rows = rows.select("block", "rn", "doc_id", "last", "next_block", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("block", "rn", "doc_id", "last", "next_block", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    met = fingerprints(rows, words, ["block", "rn"], ["text", "edited"])
    met = met.withColumn("near_edited", likeness(F.col("text"), F.col("edited"))).withColumn("edited_fingerprint", as_text(F.col("edited"))).drop("edited")
    met = materialized(met.withColumn("following", F.lead("text").over(Window.partitionBy("block").orderBy("rn"))))
    heads = met.where("rn = 1").select(F.col("block").alias("next_block"), F.col("text").alias("head"))
    inner = met.where("not last").withColumn("near_next", likeness(F.col("text"), F.col("following")))
    outer = met.where("last").join(heads, "next_block").withColumn("near_next", likeness(F.col("text"), F.col("head")))
    return inner.unionByName(outer, allowMissingColumns=True).select("doc_id", "n_chars", "edited_sha256", as_text(F.col("text")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
