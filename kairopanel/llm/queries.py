"""The queries of the text operators: thin wrappers with production parameters, over whole tables."""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .embedding_dedup import embedding_near_dups
from .imatch import fingerprint_report
from .jaccard_join import ngram_jaccard_join
from .licenses import scan_licenses
from .mixing import mix_sources, word_count
from .packing import best_fit_pack
from .periodic_runs import collapse_runs
from .pii import RULES, find_pii
from .shared import materialized, shared_folder
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_arrays import repeated_bytes
from .token_store import read_token_shards, write_token_shards
from .toxicity import held_out, learn_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    """The path of the byte-level vocabulary; TOKENIZER_FILE names another."""
    if path := os.environ.get("TOKENIZER_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a word a token and an end mark, in sequences of 512 to 4,096 tokens."""
    return best_fit_pack(_table(spark, sf_dir, "documents"), capacities=(512, 1024, 2048, 4096))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to shards and read back by key."""
    docs = _table(spark, sf_dir, "documents")
    path = shared_folder(spark)
    write_token_shards(docs, path, default_tokenizer(), end_id=0)
    found = read_token_shards(spark, path, docs)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts or lines of documents are a known licence notice."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are 85 % alike."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of edited texts."""
    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.95 or more."""
    return embedding_near_dups(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of the sources takes of each document."""
    docs = _table(spark, sf_dir, "documents")
    # texts are read once and don't travel: their hash tells equal documents apart
    slim = materialized(docs.select("doc_id", F.xxhash64("text").cast("string").alias("text"), "source", word_count("text").alias("words")))
    taken = mix_sources(slim, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, size=F.col("words"))
    return taken.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in RULES], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.concat("base", "added")).alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word sequences that a document with a smaller id has."""
    found = substring_dedup(_table(spark, sf_dir, "documents"), words=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that also start anywhere else."""
    found = repeated_bytes(_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_losses(i: int | None, counts: dict) -> list[tuple[str, int]]:
    """A document's words, of which one in 199 loses a letter; which one follows from the crc32 of id and word."""
    if i is None:
        return list(counts.items())
    seed, out = zlib.crc32(f"{i}:".encode()), []
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), seed)
        if h % 199 == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out.append((word, n))
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them misspelt, with the near word they are a form of."""
    return spelling_variants(_table(spark, sf_dir, "documents"), before=with_planted_losses)


def with_planted_runs(ids: list, texts: list) -> list[bytes]:
    """Texts in which the words of one in ten repeat with a period from some word on; place and period follow from the id's crc32."""
    out = []
    for i, text in zip(ids, texts):
        raw = (text or "").encode()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and (words := raw.split()):
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            raw = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
        out.append(raw)
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of them planted, and the texts without their repeats."""
    found = collapse_runs(_table(spark, sf_dir, "documents"), before=with_planted_runs)
    more = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(more(r, best), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_token_store, op3_license_scan, op4_ngram_jaccard_join, op5_toxicity, op6_imatch, op7_embedding_dedup, op8_source_mix, op9_pii, op10_substring_dedup, op11_suffix_arrays, op12_spelling_variants, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force."""
    notices = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.NOTICES)
    scan = f"""
WITH known AS (
    SELECT min(license) AS license, digest FROM (SELECT license, sha256({licenses.canonical_sql("text")}) AS digest FROM (VALUES {notices}) t(license, text)) GROUP BY digest
), lines AS (
    SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS x FROM documents
), units AS (
    SELECT doc_id, 'text' AS unit, 0 AS line, text AS x FROM documents UNION ALL SELECT doc_id, 'line', line, x FROM lines
), canonical AS (
    SELECT doc_id, unit, line, {licenses.canonical_sql("x")} AS c FROM units
)
SELECT doc_id, unit, CAST(line AS BIGINT) AS line, license, digest FROM (SELECT *, sha256(c) AS digest FROM canonical WHERE c <> '') JOIN known USING (digest)"""
    return {
        "op3_license_scan": scan,
        "op4_ngram_jaccard_join": _JACCARD,
        "op10_substring_dedup": _SUBSTRINGS,
    }


_WORDS = r"""SELECT doc_id, text, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents"""

_JACCARD = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

_SUBSTRINGS = rf"""
WITH words AS ({_WORDS}), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) > 12)
), firsts AS (
    SELECT g, min(doc_id) AS least FROM windows GROUP BY g
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (g) WHERE least < doc_id
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) u
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = u.doc_id AND gone.i = u.p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""
