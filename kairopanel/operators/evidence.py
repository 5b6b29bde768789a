"""Text evidence: quotes that a source has to contain, citations, candidates of documents."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import announcement_kind, canonical_url, host_allowed, normal_text, source_id


def similarity(quote: str, window: str) -> Column:
    """Twice the characters of the matching blocks over those of both texts."""

    @F.pandas_udf("double")
    def each(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(q, w)], dtype=float)

    return each(quote, window)


def most_alike(quote: Column, window: Column) -> Column:
    """An upper bound of :func:`similarity`: by the characters that both have, however they are ordered."""
    shared = F.aggregate(F.array_distinct(F.split(quote, "")), F.lit(0), lambda n, c: n + F.least(_times(quote, c), _times(window, c)))
    return 2 * shared / (F.length(quote) + F.length(window))


def _times(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def verify_quotes(quotes: DataFrame, sources: DataFrame, source: str = "doc_id", quote: str = "quote", text: str = "text", least: float = 0.90) -> DataFrame:
    """quotes with exact, similarity (to three places) and supported.

    Texts are compared in lower case with single blanks. A quote that its source holds is exact. Others are compared with
    the source's windows of their length, a quarter of it apart, the last one not beyond the end; similarity is the best of
    them. Windows are rows: their characters bound what they can reach, the one with the highest bound is compared first,
    and then only those that could still be better. Empty quotes and quotes without a source have similarity 0.
    """
    both = quotes.withColumn("__k", F.monotonically_increasing_id()).join(sources.select(source, normal_text(F.col(text)).alias("__t")), source, "left").withColumn("__q", normal_text(F.col(quote)))
    both = both.withColumn("exact", F.coalesce(F.contains("__t", "__q") & (F.col("__q") != ""), F.lit(False)))
    n = F.length("__q")
    open_ = both.where(~F.col("exact") & (n > 0) & (F.length("__t") > 0)).select("__k", "__q", "__t")
    starts = F.sequence(F.lit(0), F.greatest(F.length("__t") - n, F.lit(0)), F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))
    windows = open_.select("__k", "__q", "__t", F.explode(starts).alias("__at")).select("__k", "__q", F.substring(F.col("__t"), F.col("__at") + 1, n).alias("__w"))
    windows = windows.withColumn("__bound", most_alike(F.col("__q"), F.col("__w")))
    first = windows.groupBy("__k").agg(F.max(F.struct("__bound", "__q", "__w")).alias("x")).select("__k", "x.*").withColumn("__reached", similarity("__q", "__w")).select("__k", "__reached")
    rest = windows.join(first, "__k").where(F.col("__bound") > F.col("__reached")).withColumn("__s", similarity("__q", "__w")).groupBy("__k").agg(F.max("__s").alias("__s"))
    best = first.join(rest, "__k", "left").select("__k", F.greatest("__reached", "__s").alias("__best"))
    found = both.join(best, "__k", "left").withColumn("__best", F.when(F.col("exact"), 1.0).otherwise(F.coalesce("__best", F.lit(0.0))))
    return found.withColumn("similarity", F.round("__best", 3)).withColumn("supported", F.col("__best") >= least).drop("__t", "__q", "__k", "__best")


def strike(claims: DataFrame, document: str = "run_id", most: float = 0.25) -> DataFrame:
    """(document, claims, struck, share, rejected)."""
    out = claims.groupBy(document).agg(F.count("*").alias("claims"), F.count_if(~F.col("supported")).alias("struck"))
    return out.withColumn("share", F.col("struck") / F.col("claims")).withColumn("rejected", F.col("share") > most)


def citation_kind(citation: Column) -> Column:
    """table, doc or web by the form of a citation; null where it has none of them."""
    return F.when(F.rlike(citation, F.lit(r"^table:[a-z_]+$")), "table").when(F.rlike(citation, F.lit(r"^doc:[^#]+(#p[0-9]+)?$")), "doc").when(F.rlike(citation, F.lit(r"^web:.+$")), "web")


def check_citations(claims: DataFrame, documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(claim_id, citation, problem) of the citations (claim_id, quote, citations) that are malformed, unknown, beyond the pages, or of the web without a quote.

    documents: (doc_id, pages). With by, columns of both tables such as a run's id, a claim knows the documents of its own run only.
    """
    rows = claims.select(*by, "claim_id", "quote", F.explode("citations").alias("citation")).withColumn("kind", citation_kind(F.col("citation")))
    rows = rows.withColumn("doc_id", F.when(F.col("kind") == "doc", F.regexp_extract("citation", r"^doc:([^#]+)", 1)))
    rows = rows.withColumn("page", F.nullif(F.regexp_extract("citation", r"#p([0-9]+)$", 1), F.lit("")).try_cast("int"))
    rows = rows.join(documents.select(*by, "doc_id", "pages"), [*by, "doc_id"], "left")
    problem = F.when(F.col("kind").isNull(), "malformed").when((F.col("kind") == "doc") & F.col("pages").isNull(), "unknown document").when(F.col("page") > F.col("pages"), "page out of range").when((F.col("kind") == "web") & (F.coalesce(F.trim("quote"), F.lit("")) == ""), "no quote")
    return rows.withColumn("problem", problem).where("problem is not null").select("claim_id", "citation", "problem")


def document_candidates(announcements: DataFrame, known: DataFrame, caps: dict[str, int], other: int = 1, total: int = 4) -> DataFrame:
    """(symbol, ann_dt, subject, url, kind, doc_id): the latest PDF documents of each kind up to its cap, that aren't known."""
    rows = announcements.where(F.rlike(F.lower("url"), F.lit(r"\.pdf($|\?)"))).withColumn("kind", announcement_kind(F.col("subject"), F.col("details") if "details" in announcements.columns else None))
    rows = rows.withColumn("doc_id", F.concat("symbol", F.lit("-"), F.substring(F.sha1("url"), 1, 10)))
    cap = F.lit(other)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    in_kind = Window.partitionBy("symbol", "kind").orderBy(F.desc("ann_dt"), "url")
    of_all = Window.partitionBy("symbol").orderBy(F.desc("ann_dt"), "url")
    rows = rows.withColumn("__k", F.row_number().over(in_kind)).where(F.col("__k") <= cap)
    rows = rows.withColumn("__n", F.row_number().over(of_all)).where(F.col("__n") <= total).drop("__k", "__n")
    return rows.join(known.select("doc_id"), "doc_id", "left_anti")


def search_results(rows: DataFrame, hosts: list[str], as_of: Column, lookback_days: int) -> DataFrame:
    """rows (symbol, facet, facet_no, url, published) with src_id, url and undated: from allowed hosts, not after the date nor too old; the first facet wins."""
    when = F.coalesce(F.try_to_timestamp("published", F.lit("yyyy-MM-dd")), F.try_to_timestamp("published")).cast("date")
    kept = rows.where(host_allowed(F.col("url"), hosts)).withColumn("published", when).withColumn("undated", F.col("published").isNull())
    kept = kept.where(F.col("undated") | ((F.col("published") <= as_of) & (F.col("published") >= F.date_sub(as_of, lookback_days))))
    kept = kept.withColumn("src_id", source_id(F.col("symbol"), F.col("url"))).withColumn("url", canonical_url(F.col("url")))
    return kept.withColumn("__k", F.row_number().over(Window.partitionBy("src_id").orderBy("facet_no", "published"))).where("__k = 1").drop("__k")
