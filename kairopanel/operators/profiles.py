"""Profiles of industries and the catalogue of rating components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The industries of each profile.
INDUSTRIES = {
    "BANK": ["Banks"],
    "NBFC_FIN": ["Finance", "Financial Services", "Financial Technology (Fintech)", "Capital Markets", "Insurance"],
    "IT_SERVICES": ["IT - Software", "IT - Services", "Information Technology"],
    "PHARMA": ["Pharmaceuticals & Biotechnology", "Healthcare", "Healthcare Services", "Healthcare Equipment & Supplies"],
    "CYCLICAL": [
        "Metals & Mining", "Ferrous Metals", "Non - Ferrous Metals", "Diversified Metals", "Minerals & Mining", "Metals & Minerals Trading", "Cement & Cement Products", "Construction Materials", "Other Construction Materials",
        "Oil", "Oil Gas & Consumable Fuels", "Petroleum Products", "Consumable Fuels", "Chemicals & Petrochemicals", "Fertilizers & Agrochemicals", "Paper, Forest & Jute Products", "Textiles", "Textiles & Apparels", "Realty",
    ],
    "GENERAL": [
        "Aerospace & Defense", "Agricultural Food & other Products", "Agricultural, Commercial & Construction Vehicles", "Auto Components", "Automobile and Auto Components", "Automobiles", "Beverages", "Capital Goods", "Chemicals",
        "Cigarettes & Tobacco Products", "Commercial Services & Supplies", "Construction", "Consumer Durables", "Consumer Services", "Diversified", "Diversified FMCG", "Electrical Equipment", "Engineering Services", "Entertainment",
        "Fast Moving Consumer Goods", "Food Products", "Gas", "Household Products", "IT - Hardware", "Industrial Manufacturing", "Industrial Products", "Leisure Services", "Media", "Media Entertainment & Publication",
        "Other Consumer Services", "Other Utilities", "Personal Products", "Power", "Printing & Publication", "Retailing", "Services", "Telecom - Equipment & Accessories", "Telecom - Services", "Telecommunication",
        "Transport Infrastructure", "Transport Services",
    ],
}
#: Industries whose prices are regulated.
REGULATED = ["Power", "Gas", "Other Utilities", "Telecom - Services", "Transport Infrastructure"]

LENDERS = ["BANK", "NBFC_FIN"]
COMPANIES = ["GENERAL", "IT_SERVICES", "PHARMA", "CYCLICAL"]


def profile_of(industry: Column, has_deposits: Column | None = None, bank_filing: Column | None = None) -> Column:
    """struct(profile, notes) of an industry; deposits or a bank's filing make a bank of a financial or unknown industry.

    An unknown industry is GENERAL, with that note alone; notes also mark deposits outside the financial industries, insurers and
    regulated industries.
    """
    marks = F.coalesce(has_deposits if has_deposits is not None else F.lit(False), F.lit(False)) | F.coalesce(bank_filing if bank_filing is not None else F.lit(False), F.lit(False))
    mapped = reduce(lambda rest, p: F.when(industry.isin(INDUSTRIES[p]), p).otherwise(rest), INDUSTRIES, F.lit(None).cast("string"))
    bank = marks & (industry.isNull() | mapped.isin("BANK", "NBFC_FIN"))
    note = lambda c, text: F.when(c, F.lit(text))
    notes = F.array_compact(F.array(note(marks, "deposits_outside_financial_industry"), note(industry == "Insurance", "insurance_metrics_partial"), note(industry.isin(REGULATED), "regulated")))
    none = F.array().cast("array<string>")
    notes = F.when(bank, none).when(mapped.isNull(), F.array(F.lit("profile_unmapped"))).otherwise(notes)
    return F.struct(F.when(bank, "BANK").otherwise(F.coalesce(mapped, F.lit("GENERAL"))).alias("profile"), notes.alias("notes"))


def _map(pillar: str, name: str, points: list[tuple], profiles: Sequence[str] = (), weight: float = 1.0, engine: int = 1, qualitative: bool = False) -> dict:
    return {"pillar": pillar, "name": name, "kind": "map", "points": [(float(x), float(y)) for x, y in points], "profiles": list(profiles), "weight": weight, "engine": engine, "qualitative": qualitative}


def _pct(pillar: str, name: str, profiles: Sequence[str] = (), sign: int = 1, engine: int = 1) -> dict:
    return {"pillar": pillar, "name": name, "kind": "pct", "sign": sign, "profiles": list(profiles), "weight": 1.0, "engine": engine, "qualitative": False}


def _binary(pillar: str, name: str, engine: int = 1) -> dict:
    return {"pillar": pillar, "name": name, "kind": "binary", "profiles": [], "weight": 1.0, "engine": engine, "qualitative": False}


_SPREAD, _DAYS, _COVER, _CLOSE, _HALF = [(-0.05, 0), (0.0, 40), (0.05, 65), (0.10, 80), (0.20, 100)], [(-10, 100), (0, 70), (20, 30), (40, 0)], [(1.0, 0), (2.0, 30), (4.0, 60), (8.0, 85), (15.0, 100)], [(0.02, 100), (0.05, 60), (0.10, 20), (0.15, 0)], [(0.0, 100), (0.5, 50), (1.0, 0)]
_GAP, _TREND, _GRADE = [(-0.05, 100), (0.0, 60), (0.05, 30), (0.10, 0)], [(-1.0, 100), (0.0, 60), (1.0, 20), (2.0, 0)], [(1, 0), (5, 100)]

#: The components of the pillars: scales, signs, weights, the profiles that they apply to (all, if none is named), and the first engine that has them.
COMPONENTS = [
    _map("P1", "spread_ttm", _SPREAD, COMPANIES), _map("P1", "spread_median_5y", _SPREAD, COMPANIES, 2.0), _map("P1", "spread_trend_5y", [(-0.03, 0), (0.0, 50), (0.03, 100)], COMPANIES),
    _pct("P1", "roce_median_10y", COMPANIES), _pct("P1", "roce_min_10y", COMPANIES), _pct("P1", "opm_median_8y", COMPANIES), _pct("P1", "opm_cv_8y", COMPANIES, -1), _pct("P1", "gross_margin_median_5y", COMPANIES, 1, 2), _pct("P1", "gm_stability_5y", COMPANIES, -1, 2),
    _map("P1", "pricing_power_proxy", [(-0.03, 0), (0.0, 60), (0.01, 100)], COMPANIES), _map("P1", "moat_persistence", [(0.0, 0), (0.5, 40), (0.8, 75), (1.0, 100)], COMPANIES),
    _pct("P1", "roa_ttm", LENDERS), _map("P1", "roe_coe_spread", [(-0.05, 0), (0.0, 40), (0.05, 70), (0.10, 100)], LENDERS, 2.0), _pct("P1", "nim_pct", LENDERS), _pct("P1", "cost_to_income", LENDERS, -1), _pct("P1", "roe_median_5y", LENDERS),
    _map("P1", "moat_grade_llm", _GRADE, engine=3, qualitative=True),
    _map("P2", "net_debt_ebitda", [(0.0, 100), (1.0, 85), (2.0, 65), (3.0, 45), (4.0, 25), (6.0, 0)], COMPANIES, 2.0), _map("P2", "net_debt_fcf_years", [(0.0, 100), (3.0, 70), (6.0, 40), (10.0, 0)], COMPANIES),
    _map("P2", "int_cover_ttm", _COVER, COMPANIES), _map("P2", "int_cover_min_5y", _COVER, COMPANIES), _map("P2", "altman_zpp", [(1.1, 0), (2.6, 80), (5.0, 100)], COMPANIES), _map("P2", "current_ratio", [(1.0, 20), (1.5, 70), (2.0, 100)], COMPANIES, engine=2),
    _pct("P2", "cash_to_debt", COMPANIES, 1, 2), _map("P2", "st_debt_share", [(0.2, 100), (0.5, 60), (0.8, 20)], COMPANIES, engine=2), _pct("P2", "wc_days_delta_3y", COMPANIES, -1), _map("P2", "de_trend_3y", [(-0.2, 100), (0.0, 60), (0.3, 0)], COMPANIES),
    _map("P2", "debt_equity", [(0.0, 100), (0.5, 75), (1.0, 50), (2.0, 20), (3.0, 0)], COMPANIES), _map("P2", "contingent_to_networth", [(0.1, 100), (0.5, 50), (1.0, 0)], COMPANIES, engine=3),
    _map("P2", "cet1_pct", [(8, 0), (10, 40), (13, 75), (16, 100)], ["BANK"], 2.0, 2), _map("P2", "gnpa_pct", [(1, 100), (2, 75), (4, 40), (8, 0)], LENDERS, 2.0), _map("P2", "nnpa_pct", [(0.5, 100), (1, 75), (2, 40), (4, 0)], LENDERS),
    _map("P2", "gnpa_trend_4q", _TREND, LENDERS), _pct("P2", "provision_coverage", LENDERS, 1, 2), _pct("P2", "deposit_vs_advance_growth", ["BANK"]), _map("P2", "fin_leverage", [(4.0, 100), (7.0, 50), (10.0, 0)], ["NBFC_FIN"], 2.0), _pct("P2", "borrowing_cost", ["NBFC_FIN"], -1),
    _map("P3", "cfo_to_pat_5y", [(0.5, 0), (0.8, 50), (1.0, 80), (1.2, 100)], COMPANIES, 2.0), _map("P3", "fcf_conversion_5y", [(0.0, 0), (0.4, 40), (0.7, 75), (1.0, 100)], COMPANIES), _pct("P3", "cfo_to_ebitda_5y", COMPANIES),
    _map("P3", "accrual_ratio_sloan_abs", _CLOSE, COMPANIES, 2.0), _map("P3", "accrual_ratio_bs_abs", _CLOSE, COMPANIES, engine=2), _map("P3", "beneish_level", [(0, 0), (50, 50), (100, 100)], COMPANIES, 2.0),
    _map("P3", "other_income_share", [(0.10, 100), (0.25, 50), (0.50, 0)]), _map("P3", "cash_tax_gap", [(0.0, 100), (0.05, 80), (0.10, 40), (0.20, 0)]), _pct("P3", "capitalisation_proxy", COMPANIES, -1),
    _map("P3", "receivable_days_delta_3y", _DAYS, COMPANIES), _map("P3", "inventory_days_delta_3y", _DAYS, COMPANIES), _map("P3", "payable_days_delta_3y", _DAYS, COMPANIES), _pct("P3", "depreciation_rate_cv_5y", COMPANIES, -1),
    _map("P3", "reserves_leakage_5y", [(0.05, 100), (0.15, 50), (0.30, 0)], COMPANIES), _binary("P3", "audit_opinion_clean", 2), _pct("P3", "credit_cost", LENDERS, -1, 2), _map("P3", "gnpa_delta_4q_neg", _TREND, LENDERS),
    _map("P4", "reinvestment_rate_5y", [(0.0, 40), (0.4, 100), (0.8, 100), (1.2, 40), (2.0, 20)], COMPANIES), _map("P4", "incremental_roic_5y", [(0.0, 0), (0.10, 40), (0.20, 75), (0.30, 100)], COMPANIES, 2.0), _pct("P4", "fundamental_growth", COMPANIES),
    _map("P4", "growth_gap", _GAP, COMPANIES), _pct("P4", "sales_cagr_3y"), _pct("P4", "sales_cagr_5y"), _pct("P4", "pat_cagr_5y"), _pct("P4", "eps_cagr_5y"), _map("P4", "growth_consistency_5y", [(0.4, 20), (0.8, 70), (1.0, 100)]),
    _pct("P4", "sales_yoy_ttm"), _pct("P4", "pat_yoy_ttm"), _pct("P4", "bvps_cagr_5y", LENDERS), _pct("P4", "ppop_growth_3y", LENDERS), _map("P4", "tam_headroom_llm", _GRADE, engine=3, qualitative=True),
    _map("P5", "capex_return_test", [(0.0, 0), (0.1, 40), (0.2, 70), (0.3, 100)], COMPANIES), _map("P5", "self_funding_5y", [(0.0, 20), (0.6, 60), (1.0, 100)], COMPANIES), _map("P5", "dilution_5y", [(-0.02, 100), (0.0, 70), (0.05, 0)]), _map("P5", "payout_discipline", [(0, 0), (50, 50), (100, 100)]),
    _map("P5", "promoter_pct", [(10, 20), (20, 40), (35, 70), (50, 100)]), _map("P5", "promoter_chg_1y", [(-5, 0), (-2, 40), (0, 70), (2, 100)]), _map("P5", "promoter_chg_3y", [(-10, 0), (-3, 40), (0, 70), (3, 100)]),
    _map("P5", "pledged_pct_of_promoter", [(0, 100), (10, 80), (25, 50), (50, 20), (60, 0)], weight=2.0), _map("P5", "pledge_delta_4q", [(-5, 100), (0, 70), (5, 30), (10, 0)]), _map("P5", "insider_net_buy_12m", [(-0.005, 20), (0.0, 60), (0.005, 100)]), _pct("P5", "inst_chg_1y"),
    _map("P5", "rating_migration_12m", [(-3, 0), (-1, 30), (0, 70), (1, 100)]), _binary("P5", "adverse_events_90d_clean"), _map("P5", "mgmt_grade_llm", _GRADE, engine=3, qualitative=True),
    _map("P6", "pe_band_pos_10y", _HALF), _map("P6", "ev_ebitda_band_pos", _HALF, COMPANIES), _pct("P6", "earnings_yield"), _pct("P6", "fcf_yield", COMPANIES), _pct("P6", "div_yield"), _map("P6", "growth_gap_val", _GAP, COMPANIES),
    _map("P6", "mos_base", [(-0.40, 0), (-0.20, 20), (0.0, 50), (0.20, 75), (0.50, 100)], weight=2.0), _map("P6", "pb_vs_justified", [(0.5, 100), (1.0, 50), (1.5, 20), (2.0, 0)], LENDERS),
]


def catalogue(engine: int = 1, qualitative: bool = False) -> list[dict]:
    """The components that an engine has; grades of texts only where asked for."""
    return [c for c in COMPONENTS if c["engine"] <= engine and (qualitative or not c["qualitative"])]


def applies(component: dict, profile: Column) -> Column:
    return profile.isin(component["profiles"]) if component["profiles"] else F.lit(True)


def mapped_share(df: DataFrame, industry: str = "industry") -> DataFrame:
    """(profile, names, unmapped) of the names of a table by their industries."""
    found = df.select(profile_of(F.col(industry)).alias("p"))
    return found.groupBy("p.profile").agg(F.count("*").alias("names"), F.count_if(F.array_contains("p.notes", "profile_unmapped")).alias("unmapped"))
