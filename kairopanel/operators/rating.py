"""Ratings: component and pillar scores, flags, confidence, decisions with hysteresis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_digest, first_match, piecewise
from ..sources.scratch import written
from .cross_section import value_percentiles, winsorise
from .profiles import applies, catalogue
from .quantiles import medians

#: Pillar weights (P1..P6) of the profiles.
PILLARS = ["P1", "P2", "P3", "P4", "P5", "P6"]
PROFILE_WEIGHTS = {
    "GENERAL": [0.20, 0.15, 0.15, 0.15, 0.10, 0.25], "BANK": [0.25, 0.25, 0.15, 0.10, 0.10, 0.15], "NBFC_FIN": [0.20, 0.30, 0.15, 0.10, 0.10, 0.15],
    "IT_SERVICES": [0.25, 0.05, 0.15, 0.20, 0.15, 0.20], "PHARMA": [0.20, 0.10, 0.20, 0.15, 0.15, 0.20], "CYCLICAL": [0.15, 0.25, 0.15, 0.10, 0.10, 0.25],
}
#: What the variants add to the pillar weights; no_valuation leaves P6 out and rescales.
VARIANTS = {"base": {}, "quality_tilt": {"P1": 0.05, "P3": 0.05, "P6": -0.10}, "value_tilt": {"P6": 0.10, "P1": -0.05, "P4": -0.05}, "with_qual": {}}
#: Verdicts from worst to best.
VERDICTS = ["SELL", "TRIM", "HOLD", "SPECULATIVE_BUY", "CONVICTION_BUY"]


def pillar_weights(profile: str, variant: str = "base") -> dict[str, float]:
    w = dict(zip(PILLARS, PROFILE_WEIGHTS[profile]))
    if variant == "no_valuation":
        w["P6"] = 0.0
        total = sum(w.values())
        return {p: x / total for p, x in w.items()}
    for p, x in VARIANTS[variant].items():
        w[p] += x
    return w


def weights_table(spark: SparkSession, variants: Sequence[str] = ("base", "quality_tilt", "value_tilt", "no_valuation")) -> DataFrame:
    """(profile, variant, pillar, weight)."""
    rows = [(p, v, k, w) for p in PROFILE_WEIGHTS for v in variants for k, w in pillar_weights(p, v).items()]
    return spark.createDataFrame(rows, "profile string, variant string, pillar string, weight double")


def component_scores(df: DataFrame, by: Sequence[str], group: str, components: list[dict], least: int = 8) -> DataFrame:
    """(by, symbol, group, pillar, component, weight, score, prior) in long form, scores from 0 to 100, of the components that apply to the row's group.

    df: (by..., symbol, group, a column for each component; a component without one is unknown to all). A component has pillar, name,
    kind, sign, weight, for maps points, and the groups that it applies to, if not all. pct: the percentile of the signed, winsorised value within
    the group where ``least`` names have one, else within all; map: piecewise linear; binary: 100 from 0.5 on. The prior is the group's median score
    where ``least`` names have one, else that of all, else 50.
    """

    def row(c: dict) -> Column:
        x = F.col(c["name"]).cast("double") if c["name"] in df.columns else F.lit(None).cast("double")
        direct = {"map": lambda: piecewise(x, c["points"]), "binary": lambda: F.when(x.isNotNull(), F.when(x >= 0.5, 100.0).otherwise(0.0)), "pct": lambda: F.lit(None).cast("double")}[c["kind"]]()
        one = F.struct(F.lit(c["pillar"]).alias("pillar"), F.lit(c["name"]).alias("component"), F.lit(float(c["weight"])).alias("weight"), F.lit(c["kind"]).alias("kind"), (x * c.get("sign", 1)).alias("x"), direct.alias("direct"))
        return F.when(applies(c, F.col(group)), one) if c.get("profiles") else one

    long = df.select(*by, "symbol", group, F.explode(F.array_compact(F.array(*[row(c) for c in components]))).alias("__c")).select(*by, "symbol", group, "__c.*")
    long = winsorise(long, "x", [*by, "component"]).withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    long = written(long.withColumn("__x", F.when(F.col("kind") == "pct", F.col("x"))))
    # only rows with a rank travel to it, by their value, so that no task needs a whole date
    placed = written(value_percentiles(long, "__x", [*by, "component"], "__g", least))
    held = long.where("__x is not null").join(placed, [*by, "component", "__g", "__x"])
    long = held.unionByName(long.where("__x is null"), allowMissingColumns=True)
    long = long.withColumn("score", F.when(F.col("kind") == "pct", F.col("pct") * 100).otherwise(F.col("direct")))
    long = written(long.select(*by, "symbol", group, "pillar", "component", "weight", "score"))  # the medians below read it too
    own, all_ = [*by, "component", group], [*by, "component"]
    long = long.join(written(medians(long, own, "score", "__own")), own, "left").join(written(medians(long, all_, "score", "__all")), all_, "left")
    prior = F.coalesce(F.when(F.col("__own_n") >= least, F.col("__own")), F.col("__all"), F.lit(50.0))
    return long.withColumn("prior", prior).select(*by, "symbol", group, "pillar", "component", "weight", "score", "prior")


def pillar_scores(components: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, symbol, pillar, score, coverage, status): weighted means in which an unknown component has its prior.

    The weights are never renormalised. A pillar with less than half its weight known is UNKNOWN and has the mean of the priors.
    """
    known, total = F.sum(F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(0.0)), F.sum("weight")
    of_all, of_priors = F.sum(F.col("weight") * F.coalesce("score", "prior")) / total, F.sum(F.col("weight") * F.col("prior")) / total
    out = components.groupBy(*by, "symbol", "pillar").agg(of_all.alias("__s"), of_priors.alias("__p"), known.alias("known_weight"), total.alias("weight")).withColumn("coverage", F.col("known_weight") / F.col("weight"))
    out = out.withColumn("status", F.when(F.col("coverage") >= 0.5, "OK").otherwise("UNKNOWN"))
    return out.withColumn("score", F.when(F.col("status") == "OK", F.col("__s")).otherwise(F.col("__p"))).drop("__s", "__p")


def composite_score(pillars: DataFrame, weights: DataFrame, profiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, symbol, variant, S, coverage) of pillar scores, the weights table (broadcast: a fixed list) and (symbol, profile)."""
    joined = pillars.join(profiles, "symbol").join(F.broadcast(weights), ["profile", "pillar"])
    return joined.groupBy(*by, "symbol", "profile", "variant").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("S"), (F.sum(F.col("weight") * F.col("coverage")) / F.sum("weight")).alias("coverage"))


def _flag(code: str, tier: str, cap: str | None, condition: Column) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(tier).alias("tier"), F.lit(cap).cast("string").alias("cap")))


def flags(columns: Sequence[str]) -> Column:
    """Array of (code, tier, cap) of the rules whose inputs are among the columns and hold; an unknown input never fires."""
    have = set(columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    b = lambda n: (F.col(n).cast("boolean") if n in have else F.lit(None).cast("boolean"))
    fin = F.coalesce(b("financial"), F.lit(False))
    rise = c("net_debt_ebitda") - c("net_debt_ebitda_prev")
    unmatched = ~F.coalesce(b("ofs_matched"), F.lit(False))
    m, before = c("beneish_m"), c("beneish_m_prev")
    return F.array_compact(F.array(
        _flag("FORENSIC_BENEISH_2Y", "HARD", "SELL", (m > -1.78) & (before > -1.78) & (c("accrual_ratio_sloan") > 0.10)),
        _flag("FORENSIC_CASH_DIVERGENCE", "HARD", "SELL", ~fin & (c("accrual_ratio_sloan_abs") > 0.15) & (c("cfo_to_pat_5y") < 0.5)),
        _flag("SOLVENCY_BREACH", "HARD", "SELL", ~fin & (((c("altman_zpp") < 1.1) & (c("int_cover_ttm") < 1.5)) | ((c("net_debt_ebitda") > 6) & (c("int_cover_ttm") < 1)))),
        _flag("CAPITAL_BREACH_BANK", "HARD", "SELL", fin & (F.coalesce(c("gnpa_pct") > 10, F.lit(False)) | F.coalesce(c("cet1_pct") < 8, F.lit(False)))),
        _flag("AUDIT_QUALIFIED_OR_RESIGNED", "HARD", "SELL", (c("audit_opinion_clean") < 0.5) | b("auditor_resigned")),
        _flag("DEFAULT_EVENT", "HARD", "SELL", b("default_event")), _flag("PLEDGE_GT_50", "HARD", "SELL", c("pledged_pct_of_promoter") > 50), _flag("GSM", "HARD", "SELL", b("gsm")),
        _flag("BENEISH_1Y", "SOFT", "HOLD", (m > -1.78) & ~(before > -1.78)), _flag("STALE_STATEMENTS", "SOFT", "HOLD", (c("stmt_age_days") > 200) & (c("stmt_age_days") <= 400)),
        _flag("PROMOTER_SELLING", "SOFT", "HOLD", (c("promoter_chg_1y") <= -5) & unmatched),
        _flag("MOAT_EROSION", "SOFT", "HOLD", F.coalesce((c("spread_ttm") < 0) & (c("spread_median_5y") > 0.05), F.lit(False)) | F.coalesce((c("opm_chg_3y") < -0.05) & (c("sales_growth_3y_pos") > 0), F.lit(False))),
        _flag("DEBT_SPIKE", "SOFT", "HOLD", rise > 2), _flag("OTHER_INCOME_DEPENDENCE", "SOFT", "HOLD", (c("other_income_share") > 0.5) & (c("other_income_share_prev") > 0.5)),
        _flag("LEVERAGED_BUYBACK", "SOFT", "TRIM", b("leveraged_buyback")), _flag("PLEDGE_GT_25", "SOFT", "TRIM", (c("pledged_pct_of_promoter") > 25) & (c("pledged_pct_of_promoter") <= 50)),
        _flag("ASM_STAGE_2_PLUS", "SOFT", "HOLD", c("asm_stage") >= 2), _flag("FO_BAN", "SOFT", "HOLD", b("fo_ban")), _flag("RATING_DOWNGRADE_2N", "SOFT", "HOLD", c("rating_migration_12m") <= -2),
        _flag("PHARMA_USFDA_OAI", "SOFT", "HOLD", b("usfda_event")),
        _flag("OTHER_INCOME_25_50", "WATCH", None, c("other_income_share").between(0.25, 0.50)), _flag("PLEDGE_10_25", "WATCH", None, (c("pledged_pct_of_promoter") > 10) & (c("pledged_pct_of_promoter") <= 25)),
        _flag("PROMOTER_SELLING_2_5PP", "WATCH", None, (c("promoter_chg_1y") > -5) & (c("promoter_chg_1y") <= -2)), _flag("BENEISH_WATCH", "WATCH", None, (m > -2.22) & (m <= -1.78)),
        _flag("WC_DAYS_UP_20", "WATCH", None, c("wc_days_delta_3y") > 20), _flag("TAX_GAP", "WATCH", None, c("cash_tax_gap") > 0.10), _flag("DEBT_UP_1_TURN", "WATCH", None, (rise > 0) & (rise <= 2)),
        _flag("VALUATION_DISPERSION_GT_50", "WATCH", None, c("val_dispersion") > 0.50),
    ))


def confidence(component_coverage: Column, pillar_coverage: Column, age_days: Column, source: Column, dispersion: Column, models: Column, name_flags: Column) -> Column:
    """The data confidence index, from 0 to 1."""
    stale = F.when(age_days <= 120, 1.0).when(age_days <= 200, 0.85).otherwise(0.70)
    origin = F.when(source == "xbrl", 1.0).when(source == "disagree", 0.765).otherwise(0.90)
    spread = F.when((models < 2) | dispersion.isNull(), 0.70).when(dispersion <= 0.25, 1.0).when(dispersion <= 0.50, 0.85).otherwise(0.70)
    return (0.45 * component_coverage + 0.15 * pillar_coverage + 0.40) * stale * origin * spread * F.pow(F.lit(0.90), name_flags)


def confidence_band(index: Column) -> Column:
    return F.when(index >= 0.75, "HIGH").when(index >= 0.50, "MED").when(index >= 0.35, "LOW").otherwise("NONE")


def count_tier(f: Column, tier: str) -> Column:
    return F.size(F.filter(f, lambda x: x["tier"] == tier))


def decide(s: Column, mos: Column, band: Column, f: Column, catalyst: Column, p2: Column) -> Column:
    """struct(rule, verdict) of the first rule that holds; unknown values fail a comparison unless the rule says otherwise."""
    hard, soft, watch = (count_tier(f, t) for t in ("HARD", "SOFT", "WATCH"))
    sure, fair = band == "HIGH", band.isin("HIGH", "MED")
    rules = [
        ("R1", "SELL", hard > 0), ("R2", "SELL", s < 35), ("R3", "TRIM", mos <= -0.25), ("R4", "TRIM", (s >= 35) & (s < 50)),
        ("R5", "CONVICTION_BUY", (s >= 80) & (mos >= 0.20) & (soft == 0) & (watch == 0) & sure),
        ("R5B", "SPECULATIVE_BUY", (s >= 80) & (mos >= 0.20) & (soft == 0) & (watch <= 1) & fair),
        ("R6", "SPECULATIVE_BUY", (s >= 70) & catalyst & F.coalesce(p2 >= 40, F.lit(True)) & (soft == 0) & (watch <= 1) & fair & F.coalesce(mos > -0.10, F.lit(True))),
        ("R7", "HOLD", (s >= 80) & F.coalesce((mos >= -0.10) & (mos < 0.20), F.lit(True))), ("R8", "HOLD", ((s >= 50) & (s < 70)) | F.coalesce(F.abs(mos) <= 0.10, F.lit(False))),
    ]
    both = lambda r, v: F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    return F.when(s.isNotNull(), first_match([(cond, both(r, v)) for r, v, cond in rules], both("R9", "HOLD")))


def verdict_rank(v: Column) -> Column:
    return first_match([(v == name, k) for k, name in enumerate(VERDICTS)])


def verdict_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in VERDICTS]), rank)


def capped(verdict: Column, f: Column, band: Column) -> Column:
    """The verdict under the worst cap of the soft flags, then under the confidence: MED steps a conviction down, LOW any purchase; null stays null."""
    cap = F.array_min(F.transform(F.filter(f, lambda x: (x["tier"] == "SOFT") & x["cap"].isNotNull()), lambda x: verdict_rank(x["cap"])))
    r = F.least(verdict_rank(verdict), F.coalesce(cap, F.lit(len(VERDICTS))))
    return F.when(verdict.isNotNull(), verdict_of(F.when((band == "MED") & (r == 4), 3).when((band == "LOW") & (r >= 3), r - 1).otherwise(r)))


#: The scores above which a rule may raise a verdict, without the margin.
UPGRADES = {"R5": 80.0, "R5B": 80.0, "R6": 70.0, "R7": 80.0, "R8": 50.0, "R4": 35.0}


def with_hysteresis(df: DataFrame, keys: Sequence[str], as_of: str = "as_of", margin: float = 2.0) -> DataFrame:
    """df (rule, verdict, S, mos) with final: an upgrade over the final verdict before needs the rule's score plus a margin, and R5 a safety of 0.23.

    The state passes from date to date, so each key's dates are folded in order, in one array expression.
    """
    least = first_match([(F.col("rule") == r, F.lit(x + margin)) for r, x in UPGRADES.items()], F.lit(0.0))
    may = F.coalesce((F.col("S") >= least) & ((F.col("rule") != "R5") | (F.col("mos") >= 0.23)), F.lit(False))
    row = F.struct(F.col(as_of), verdict_rank(F.col("verdict")).alias("r"), may.alias("may"))
    path = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__p"))

    def step(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)["r"]
        r = F.when((F.size(done) > 0) & (x["r"] > F.when(F.size(done) > 0, before)) & ~x["may"], F.when(F.size(done) > 0, before)).otherwise(x["r"])
        return F.array_append(done, F.struct(x[as_of].alias(as_of), r.alias("r")))

    kind = df.select(as_of).schema[0].dataType.simpleString()
    safe = lambda done, x: F.when(F.size(done) == 0, F.array(F.struct(x[as_of].alias(as_of), x["r"].alias("r")))).otherwise(step(done, x))
    folded = path.select(*keys, F.explode(F.aggregate("__p", F.array().cast(f"array<struct<{as_of}:{kind},r:int>>"), safe)).alias("__x"))
    final = folded.select(*keys, F.col(f"__x.{as_of}").alias(as_of), verdict_of(F.col("__x.r")).alias("final"))
    return df.join(final, [*keys, as_of])


def catalyst(columns: Sequence[str]) -> Column:
    """Growth that may raise a price: a high growth pillar with one of three kinds of support."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("double")
    support = [(c("fundamental_growth") >= 0.12) & (c("growth_gap") <= 0), (c("pat_yoy_ttm") >= 0.20) & (c("sales_yoy_ttm") >= 0.10), (c("eps_cagr_5y") >= 0.15) & (c("growth_consistency_5y") >= 0.8)]
    return F.coalesce(c("P4") >= 70, F.lit(False)) & reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in support])


def name_flags(columns: Sequence[str]) -> Column:
    """Array of what makes a name's own figures doubtful; each lowers the confidence."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("double")
    noted = lambda n: F.array_contains("notes", n) if "notes" in columns else F.lit(False)
    rules = [
        ("NAME_IMPLAUSIBLE_PE", (c("pe_ttm_feat") > 200) | ((c("pe_ttm_feat") < 0) & (c("pat_ttm") > 0))), ("NAME_PAT_CAGR_DISCONTINUITY", F.abs(c("pat_cagr_5y")) > 1.5), ("NAME_HISTORY_LT_240", c("history_days") < 240),
        ("NAME_BORROWING_CONFLICT", noted("borrowing_conflict")), ("NAME_PROFILE_UNMAPPED", noted("profile_unmapped")),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def data_errors(columns: Sequence[str], coverage: Column, index: Column, least_coverage: float = 0.60, least_sessions: int = 120, most_age: int = 400, least_index: float = 0.35) -> Column:
    """Array of the reasons for not rating a name: too little known, no moat or valuation pillar, a short history, no or old statements, an ambiguous profile, low confidence.

    Needs P1_status and P6_status among the columns; history_days and stmt_age_days where they are known.
    """
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("double")
    noted = lambda n: F.array_contains("notes", n) if "notes" in columns else F.lit(False)
    rules = [
        ("component_coverage", coverage < least_coverage), ("P1 UNKNOWN", F.coalesce(F.col("P1_status") != "OK", F.lit(True))), ("P6 UNKNOWN", F.coalesce(F.col("P6_status") != "OK", F.lit(True))), ("history", c("history_days") < least_sessions),
        ("no statements visible", c("stmt_age_days").isNull()), ("statements too old", c("stmt_age_days") > most_age), ("sector profile ambiguous", noted("deposits_outside_financial_industry") & noted("profile_unmapped")), ("confidence", index < least_index),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]))


def composite(profile: Column, variant: str) -> Column:
    """The weighted mean of the pillar scores in columns P1 to P6, by the weights of a row's profile; a missing pillar doesn't count."""
    picked = {p: reduce(lambda rest, k: F.when(profile == k, F.lit(pillar_weights(k, variant)[p])).otherwise(rest), PROFILE_WEIGHTS, F.lit(None).cast("double")) for p in PILLARS}
    some = [(F.when(F.col(p).isNotNull(), w), F.col(p)) for p, w in picked.items()]
    total = lambda xs: reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    return F.try_divide(total([w * x for w, x in some]), total([w for w, _ in some]))


def rated(df: DataFrame, by: Sequence[str], variant: str = "base", engine: int = 1, source: str = "screener", hysteresis: bool = True) -> DataFrame:
    """The rating row of each name of df under one variant: see :func:`rated_variants`."""
    return rated_variants(df, by, [variant], engine, source, hysteresis)


def rated_variants(df: DataFrame, by: Sequence[str], variants: Sequence[str] = ("base", "quality_tilt", "value_tilt", "no_valuation"), engine: int = 1, source: str = "screener", hysteresis: bool = False) -> DataFrame:
    """The rating row of each name of df (by..., symbol, profile, metrics, features) and variant: score, verdict, rule, confidence, flags, errors and a digest of all of it.

    by ends with the date. Pillars are scored once, over each date's names, the profile giving groups and catalogue; the variants
    differ by the weights of the pillars only, so a name's row is repeated for each after that. A name with
    data errors has NO_RATING; else rules, caps of soft flags, the confidence's step down and, with hysteresis, over the dates, the
    verdict of the name's rated date before decide. Unknown metrics are columns that are missing or null. with_qual, which has components of
    its own, is rated alone.
    """
    if "with_qual" in variants and len(variants) > 1:
        raise ValueError("with_qual has components of its own")
    components = component_scores(df, by, "profile", catalogue(engine, "with_qual" in variants))
    pillars = pillar_scores(components, by)
    at = lambda p, c: F.max(F.when(F.col("pillar") == p, F.col(c)))
    wide = pillars.groupBy(*by, "symbol").agg(
        (F.sum("known_weight") / F.sum("weight")).alias("component_coverage"), F.avg((F.col("status") == "OK").cast("double")).alias("pillar_coverage"),
        *[at(p, "score").alias(p) for p in PILLARS], *[at(p, "status").alias(f"{p}_status") for p in PILLARS],
    )
    met = df.join(wide, [*by, "symbol"]).withColumn("financial", F.col("profile").isin("BANK", "NBFC_FIN"))
    met = met.withColumn("red_flags", flags(met.columns)).withColumn("name_flags", name_flags(met.columns))
    c = lambda n: F.col(n) if n in met.columns else F.lit(None).cast("double")
    index = confidence(F.col("component_coverage"), F.col("pillar_coverage"), c("stmt_age_days"), F.lit(source), c("val_dispersion"), F.coalesce(c("n_models"), F.lit(0)), F.size("name_flags"))
    met = met.withColumn("dci", F.greatest(F.lit(0.0), F.least(F.lit(1.0), index))).withColumn("band", confidence_band(F.col("dci")))
    met = met.withColumn("errors", data_errors(met.columns, F.col("component_coverage"), F.col("dci")))
    met = met.withColumn("catalyst", catalyst(met.columns))
    used = [n for n in ("mos_base", "fv_base", "fv_bull", "fv_bear", "price") if n in met.columns]
    scores = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), composite(F.col("profile"), v).alias("S")) for v in variants]))
    met = met.select(*by, "symbol", "profile", *PILLARS, "component_coverage", "dci", "band", *used, "red_flags", "name_flags", "errors", "catalyst", scores.alias("v")).select("*", "v.*").drop("v")
    mos = F.col("mos_base") if "mos_base" in used else F.lit(None).cast("double")
    first = decide(F.col("S"), mos, F.col("band"), F.col("red_flags"), F.col("catalyst"), F.col("P2"))
    met = met.withColumn("d", F.when((F.size("errors") == 0) & F.col("S").isNotNull(), first))
    met = met.withColumn("rule", F.coalesce("d.rule", F.lit("R0"))).withColumn("verdict", capped(F.col("d.verdict"), F.col("red_flags"), F.col("band"))).drop("d")
    if hysteresis:
        sound = met.where("verdict is not null").select(*by, "symbol", "variant", "S", mos.alias("mos"), "rule", "verdict")
        final = with_hysteresis(sound, [*by[:-1], "symbol", "variant"], by[-1]).select(*by, "symbol", "variant", "final")
        met = met.join(final, [*by, "symbol", "variant"], "left").withColumn("verdict", F.col("final")).drop("final")
    met = met.withColumn("status", F.when(F.col("verdict").isNull(), "NO_RATING").otherwise("RATED")).withColumn("verdict", F.coalesce("verdict", F.lit("NO_RATING")))
    codes = lambda tier: F.transform(F.filter("red_flags", lambda f: f["tier"] == tier), lambda f: f["code"])
    kept = [*by, "symbol", "profile", "status", "verdict", "rule", "S", *PILLARS, "component_coverage", "dci", "band", *used, F.transform("red_flags", lambda f: f["code"]).alias("flags"), "name_flags", "errors", "variant"]
    rows = met.select(*kept, codes("HARD").alias("hard"), codes("SOFT").alias("soft")).withColumn("engine", F.lit(f"r{engine}"))
    return rows.withColumn("manifest_sha", canonical_digest([n for n in rows.columns]))


def summary(rows: DataFrame) -> DataFrame:
    """(of, value, names): how many names have each verdict, band and profile."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.col(n).alias("value")) for n in ("verdict", "band", "profile")]))
    return rows.select(each.alias("x")).groupBy("x.of", "x.value").agg(F.count("*").alias("names"))


def drivers(components: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """(by, symbol, side, place, component, score): of each name the known components with the highest and the lowest scores."""
    some = components.where("score is not null")
    out = None
    for side, order in (("driver", F.desc("score")), ("risk", F.asc("score"))):
        placed = some.withColumn("place", F.row_number().over(Window.partitionBy(*by, "symbol").orderBy(order, F.desc("weight"), "component"))).where(F.col("place") <= n)
        one = placed.select(*by, "symbol", F.lit(side).alias("side"), "place", "component", "score")
        out = one if out is None else out.unionByName(one)
    return out
