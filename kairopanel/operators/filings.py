"""Facts of filings: names of items, scale by agreement with statements, and one idempotent load with revisions.

A fact: (path, symbol, basis, filed_at, rounding, tag, period_start, period_end, kind, dims, unit, value, text); ``kind`` is I for an
instant, whose period_start is its period_end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .builds import exists

#: The item that a tag stands for.
ITEMS = {
    "RevenueFromOperations": "revenue", "RevenueFromOperationsGross": "revenue", "TotalRevenueFromOperations": "revenue", "IncomeFromOperations": "revenue",
    "OtherIncome": "other_income", "TotalIncome": "total_income", "Income": "total_income",
    "CostOfMaterialsConsumed": "cost_of_materials", "PurchasesOfStockInTrade": "purchases", "ChangesInInventoriesOfFinishedGoodsWorkInProgressAndStockInTrade": "inventory_change",
    "EmployeeBenefitExpense": "employee_cost", "EmployeeBenefitsExpense": "employee_cost", "FinanceCosts": "finance_cost",
    "DepreciationAndAmortisationExpense": "depreciation", "DepreciationDepletionAndAmortisationExpense": "depreciation", "OtherExpenses": "other_expenses", "TotalExpenses": "total_expenses",
    "ProfitBeforeExceptionalItemsAndTax": "pbt_before_exceptional", "ProfitBeforeTax": "pbt", "TaxExpense": "tax", "TotalTaxExpense": "tax", "CurrentTax": "current_tax",
    "ProfitLoss": "pat", "ProfitAfterTax": "pat", "ProfitLossForPeriod": "pat",
    "BasicEarningsPerShare": "eps_basic", "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations": "eps_basic",
    "DilutedEarningsPerShare": "eps_diluted", "DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations": "eps_diluted",
    "ShareCapital": "equity_capital", "EquityShareCapital": "equity_capital", "PaidUpValueOfEquityShareCapital": "equity_capital",
    "Reserves": "reserves", "ReservesAndSurplus": "reserves", "OtherEquity": "reserves",
    "Inventories": "inventories", "TradeReceivables": "trade_receivables", "TradeReceivablesCurrent": "trade_receivables", "CashAndCashEquivalents": "cash", "CashAndBankBalances": "cash",
    "CurrentAssets": "current_assets", "TotalCurrentAssets": "current_assets", "Assets": "total_assets", "TotalAssets": "total_assets", "Goodwill": "goodwill",
    "CapitalWorkInProgress": "cwip", "PropertyPlantAndEquipment": "gross_block", "GrossBlock": "gross_block",
    "Borrowings": "borrowings", "BorrowingsCurrent": "borrowings_current", "CurrentBorrowings": "borrowings_current",
    "BorrowingsNoncurrent": "borrowings_noncurrent", "NoncurrentBorrowings": "borrowings_noncurrent", "LongTermBorrowings": "borrowings_noncurrent",
    "CashFlowsFromUsedInOperatingActivities": "cfo", "NetCashFlowsFromUsedInOperatingActivities": "cfo", "CashFlowsFromUsedInInvestingActivities": "cfi", "NetCashFlowsFromUsedInInvestingActivities": "cfi",
    "CashFlowsFromUsedInFinancingActivities": "cff", "NetCashFlowsFromUsedInFinancingActivities": "cff",
    "AuditorsFirmName": "auditor_name", "NameOfTheAuditor": "auditor_name", "NameOfAuditFirm": "auditor_name",
    "TypeOfAuditQualification": "auditor_opinion", "AuditorsOpinion": "auditor_opinion", "AuditQualification": "auditor_opinion", "TypeOfReviewObservation": "auditor_opinion",
    "SegmentRevenue": "segment_revenue", "RevenueFromOperationsSegment": "segment_revenue", "SegmentResult": "segment_result", "SegmentAssets": "segment_assets",
}
#: The items of tags in filings of banks.
BANK_ITEMS = {
    "CET1Ratio": "cet1", "CommonEquityTier1CapitalRatio": "cet1", "CommonEquityTierOneCapitalRatio": "cet1", "CapitalAdequacyRatio": "car",
    "GrossNonPerformingAssets": "gnpa", "GrossNPA": "gnpa", "PercentageOfGrossNPA": "gnpa_pct", "NetNonPerformingAssets": "nnpa", "NetNPA": "nnpa", "PercentageOfNetNPA": "nnpa_pct",
    "ReturnOnAssets": "roa", "Advances": "advances", "GrossAdvances": "advances", "Deposits": "deposits", "TotalDeposits": "deposits",
    "ProvisionsAndContingencies": "provisions", "Provisions": "provisions", "InterestEarned": "interest_earned", "InterestIncome": "interest_earned",
}
#: Tags that mark a bank's filing.
BANK_MARKERS = ["CET1Ratio", "CommonEquityTier1CapitalRatio", "GrossNonPerformingAssets", "GrossNPA", "NetNonPerformingAssets", "Advances", "Deposits", "InterestEarned"]
#: Scales to units of ten million by the word that a filing gives, and those tried where it is wrong, in order.
ROUNDING = {
    "lakhs": 0.01, "lakh": 0.01, "crores": 1.0, "crore": 1.0, "millions": 0.1, "million": 0.1, "thousands": 1e-4, "thousand": 1e-4, "absolute": 1e-7, "units": 1e-7, "unit": 1e-7, "actuals": 1e-7,
}
SCALES = [0.01, 1.0, 0.1, 1e-4, 1e-7]

KEY = ["symbol", "basis", "period_end", "period_start", "kind", "tag", "dims"]


def _lookup(column: Column, held: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), column)


def named(facts: DataFrame) -> DataFrame:
    """facts with is_bank and item, by the tag; a bank's items only in filings with a bank's tag. An unknown tag keeps a null item."""
    banks = facts.groupBy("path").agg(F.max(F.col("tag").isin(BANK_MARKERS)).alias("is_bank"))
    item = F.coalesce(F.when(F.col("is_bank"), _lookup(F.col("tag"), BANK_ITEMS)), _lookup(F.col("tag"), ITEMS))
    return facts.join(banks, "path").withColumn("item", item)


def scaled(facts: DataFrame, statements: DataFrame, within: float = 0.20) -> DataFrame:
    """Named facts with scale and scale_inferred, monetary values (unit INR) multiplied: by the rounding that the filing states, unless a statement disagrees.

    The anchor is a filing's largest revenue, compared with the sales of the same symbol and period (statements: symbol, period_end, stmt,
    line_item, value; the annual statement before the quarterly). Where the stated scale misses it by more than a share, the candidate
    that comes nearest is taken if it comes within the share; else the stated one stays. An unknown rounding counts as lakhs.
    """
    base = F.coalesce(_lookup(F.lower(F.trim("rounding")), ROUNDING), F.lit(0.01))
    revenue = facts.where("item = 'revenue' and unit = 'INR' and value is not null")
    anchor = revenue.groupBy("path", "symbol").agg(F.max(F.struct("value", "period_end")).alias("a"), F.first(base).alias("base")).select("path", "symbol", "a.value", "a.period_end", "base")
    place = F.when(F.col("stmt") == "pl_a", 0).when(F.col("stmt") == "pl_q", 1).otherwise(2)
    sales = statements.where(F.col("line_item").isin("sales", "revenue") & F.col("value").isNotNull())
    sales = sales.groupBy("symbol", "period_end").agg(F.min_by("value", F.struct(place, "line_item", "value")).alias("expected"))
    off = lambda s: F.abs(F.col("value") * s - F.col("expected")) / F.col("expected")
    tries = F.array(*[F.struct(off(F.lit(s)).alias("off"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SCALES)])
    best = anchor.join(sales, ["symbol", "period_end"]).where("expected > 0 and value <> 0").withColumn("b", F.array_min(tries))
    wrong = (off(F.col("base")) > within) & (F.col("b.off") < off(F.col("base"))) & (F.col("b.off") <= within) & (F.col("b.s") != F.col("base"))
    other = best.where(wrong).select("path", F.col("b.s").alias("__other"))
    out = facts.join(other, "path", "left").withColumn("scale", F.coalesce("__other", base)).withColumn("scale_inferred", F.col("__other").isNotNull()).drop("__other")
    return out.withColumn("value", F.when(F.col("unit") == "INR", F.col("value") * F.col("scale")).otherwise(F.col("value")))


def _differs(value: Column, other: Column, text: Column, other_text: Column) -> Column:
    both = value.isNotNull() & other.isNotNull()
    near = F.abs(value - other) / F.greatest(F.abs(value), F.abs(other), F.lit(1e-9)) > 1e-9
    return F.when(both, near).when(value.isNotNull() | other.isNotNull(), True).otherwise(F.coalesce(text, F.lit("")) != F.coalesce(other_text, F.lit("")))


def first_and_later(existing: DataFrame | None, logged: DataFrame | None, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, revisions): the facts to add and the differing later values to log, of a batch of filings against what stands.

    Of facts with one key (KEY) the first filed stands for good; a later value that differs is a revision, logged once however often it comes.
    All filings of the batch are taken at once, in the order in which they were filed.
    """
    held = [c for c in facts.columns if c not in KEY]
    first = facts.groupBy(*KEY).agg(F.min(F.struct("filed_at", "path", *[c for c in held if c not in ("filed_at", "path")])).alias("__f"))
    if existing is None:
        fresh, stands = first, first.select(*KEY, F.col("__f.value").alias("__v"), F.col("__f.text").alias("__t"))
    else:
        fresh = first.join(existing.select(*KEY), KEY, "left_anti")
        known = existing.select(*KEY, F.col("value").alias("__v"), F.col("text").alias("__t"))
        stands = known.unionByName(fresh.select(*KEY, F.col("__f.value").alias("__v"), F.col("__f.text").alias("__t")))
    met = facts.join(stands, KEY).where(_differs(F.col("value"), F.col("__v"), F.col("text"), F.col("__t")))
    later = met.groupBy(*KEY, "value", "text").agg(F.min(F.struct("filed_at", "path")).alias("__r")).select(*KEY, "value", "text", "__r.filed_at", "__r.path")
    if logged is not None:
        seen = logged.select(*[F.col(c).alias(f"__{c}") for c in (*KEY, "value", "text")])
        same = [F.col(c) == F.col(f"__{c}") for c in KEY] + [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("value", "text")]
        later = later.join(seen, same, "left_anti")
    return fresh.select(*KEY, *[F.col(f"__f.{c}").alias(c) for c in held]), later


def load_filings(facts: DataFrame, folder: str) -> None:
    """Add a batch of scaled facts to the tables ``facts``, ``revisions`` and ``filings`` below a folder; a batch that comes again changes nothing.

    Tables lie in slices of the year of period_end, and only those of the batch's years are read. The row of a filing (path, symbol, basis,
    filed_at, period_end: the latest of a duration, else of an instant, facts, scale, scale_inferred, is_bank, revised) is replaced when it is
    loaded again; ``revised`` stays true once a value of it was logged. The three writes may be repeated in any state between them.
    """
    spark = facts.sparkSession
    facts = facts.withColumn("year", F.year("period_end"))
    years = [r["year"] for r in facts.select("year").distinct().collect()]  # a number a year

    logged_columns = [*KEY, "value", "text", "filed_at", "path", "year"]

    def slices(name: str, columns: list[str]) -> DataFrame | None:
        path = f"{folder}/{name}"
        return spark.read.schema(facts.select(*columns).schema).parquet(path).where(F.col("year").isin(years)) if exists(spark, path) else None

    fresh, later = first_and_later(slices("facts", facts.columns), slices("revisions", logged_columns), facts)
    later = later.withColumn("year", F.year("period_end"))
    # revisions first: when the facts have been added too, a repeated batch still finds what it had logged
    later.write.mode("append").partitionBy("year").parquet(f"{folder}/revisions")
    fresh.write.mode("append").partitionBy("year").parquet(f"{folder}/facts")
    logged = slices("revisions", logged_columns).select("path").distinct().withColumn("revised", F.lit(True))
    period = F.coalesce(F.max(F.when(F.col("kind") != "I", F.col("period_end"))), F.max("period_end"))
    rows = facts.groupBy("path", "symbol", "basis", "filed_at").agg(
        period.alias("period_end"), F.count("*").alias("facts"), F.first("scale").alias("scale"), F.first("scale_inferred").alias("scale_inferred"), F.first("is_bank").alias("is_bank")
    )
    rows = rows.join(logged, "path", "left").withColumn("revised", F.coalesce("revised", F.lit(False))).withColumn("filed_year", F.year("filed_at"))
    known = f"{folder}/filings"
    if exists(spark, known):
        old = spark.read.parquet(known).select(*rows.columns)
        before = [r["filed_year"] for r in rows.select("filed_year").distinct().collect()]
        rows = rows.unionByName(old.where(F.col("filed_year").isin(before)).join(rows.select("path"), "path", "left_anti"))
        rows = written(rows)  # what is replaced below is read here
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filed_year").parquet(known)


def loaded(spark: SparkSession, folder: str, name: str, drop: Sequence[str] = ("year", "filed_year")) -> DataFrame:
    """A table of :func:`load_filings`; that of the revisions may have no file yet."""
    reader = spark.read
    if name == "revisions":
        reader = reader.schema(spark.read.parquet(f"{folder}/facts").select(*KEY, "value", "text", "filed_at", "path", "year").schema)
    return reader.parquet(f"{folder}/{name}").drop(*drop)
