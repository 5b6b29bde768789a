"""Scalar column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds; null conditions don't."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def lenient_number(text: Column) -> Column:
    """A double from text with thousands separators; ``-``, ``NA``, blanks and anything else that is no number: null."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def first_number(text: Column) -> Column:
    """The first number within a text, sign and separators included, or null."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), ",", "").try_cast("double")


def half_even_int(x: Column) -> Column:
    """Rounded to the nearest integer, halves to the even one."""
    return F.bround(x, 0).cast("long")


def slug(text: Column) -> Column:
    """A line-item key: lower-cased, marks dropped, ``&`` and ``%`` spelled out, words joined by underscores."""
    spelled = F.regexp_replace(F.regexp_replace(F.lower(text), "%", " pct "), "&", " and ")
    return F.regexp_replace(F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " ")), " +", "_")


def month_end_of_label(label: Column) -> Column:
    """``Mar 2024`` to the last day of that month; anything else null."""
    return F.last_day(F.try_to_timestamp(F.concat(F.lit("1 "), F.trim(label)), F.lit("d MMM yyyy")).cast("date"))


#: Formats of the dates in landed files.
DATE_FORMATS = ["dd/MM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy[ HH:mm[:ss]]", "yyyy-MM-dd[ HH:mm:ss]"]


def any_timestamp(text: Column) -> Column:
    """The time that one of the formats reads in the text; null if none does.

    The marks after two digits of a day tell which format alone can fit, so a text is parsed once: a parse that fails costs as much as many that don't.
    """
    text = F.trim(text)
    third, digit = F.substring(text, 3, 1), F.substring(text, 4, 1).between("0", "9")
    forms = zip([third == "/", (third == "-") & digit, third == "-", F.lit(True)], DATE_FORMATS)
    return first_match([(form, F.try_to_timestamp(text, F.lit(f))) for form, f in forms])


def period_kind(start: Column, end: Column) -> Column:
    """Q, H, 9M or FY by the days that a period spans; I for an instant without a start."""
    days = F.datediff(end, start)
    return F.when(start.isNull(), "I").when(days <= 115, "Q").when(days <= 210, "H").when(days <= 305, "9M").otherwise("FY")


def visible_from(period_end: Column, annual: Column, filed: Column) -> Column:
    """The first day on which a fact could be known: the filing, else 45 days after a quarter and 60 after a year or a March quarter."""
    late = annual | (F.month(period_end) == 3)
    return F.coalesce(filed, F.date_add(period_end, F.when(late, 60).otherwise(45)))


#: Forms of the subjects of corporate actions that change the number of shares.
BONUS = r"(?i)bonus\s*(\d+)\s*:\s*(\d+)"
SPLIT = r"(?i)(?:split|sub-?division).*?(?:from|of)\s*(?:rs\.?|re\.?|₹)?\s*(\d+(?:\.\d+)?)\s*/?-?.*?(?:to|into)\s*(?:rs\.?|re\.?|₹)?\s*(\d+(?:\.\d+)?)"
CONSOLIDATION = r"(?i)consolidat.*?(?:from|of)\s*(?:rs\.?|re\.?|₹)?\s*(\d+(?:\.\d+)?)\s*/?-?.*?(?:to|into)\s*(?:rs\.?|re\.?|₹)?\s*(\d+(?:\.\d+)?)"


def action_factor(subject: Column) -> Column:
    """struct(kind, factor) of a corporate action's subject; null for one that doesn't change the number of shares.

    Bonus a:b gives b / (a + b), a split from x to y gives y / x, a consolidation from x to y likewise. A split has to
    lower the face value and a consolidation to raise it; what fails one form is tried by the next.
    """

    def numbers(pattern: str) -> tuple[Column, Column]:
        return tuple(F.regexp_extract(subject, pattern, k).try_cast("double") for k in (1, 2))

    (a, b), (x, y), (u, v) = numbers(BONUS), numbers(SPLIT), numbers(CONSOLIDATION)
    found = lambda kind, factor: F.struct(F.lit(kind).alias("kind"), factor.alias("factor"))
    return first_match([((a > 0) & (b > 0), found("bonus", b / (a + b))), ((x > 0) & (y > 0) & (y < x), found("split", y / x)), ((u > 0) & (v > 0) & (v > u), found("consolidation", v / u))])


#: Roman numerals of stages.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}


def stage_number(text: Column) -> Column:
    """The stage in a text such as ``Stage II``, ``LT-ASM Stage 1``, ``ASM - II (...)`` or ``GSM 3``; 0 without one."""
    s = F.upper(text)
    named, bracketed = F.regexp_extract(s, r"STAGE\s+([IVX]+|[0-9]+)", 1), F.regexp_extract(s, r"-\s*([IVX]+)\s*\(", 1)
    roman = lambda c: first_match([(c == k, v) for k, v in ROMAN.items()], 0)
    grade = F.regexp_extract(s, r"GSM\s+([0-9])", 1).try_cast("int")
    return F.coalesce(F.when(named != "", F.coalesce(named.try_cast("int"), roman(named))).when(bracketed != "", roman(bracketed)).otherwise(grade), F.lit(0))


#: Kinds of announcements by their first matching pattern, whatever the case.
ANNOUNCEMENTS = [
    (r"transcript", "transcript"),
    (r"investor presentation|analyst.*presentation|earnings presentation", "presentation"),
    (r"outcome of board meeting|financial result|un-?audited|audited", "results"),
    (r"annual report", "annual_report"),
    (r"credit rating", "rating"),
    (r"pledge", "pledge"),
    (r"insider trading|SAST|substantial acquisition", "insider"),
]


def announcement_kind(subject: Column, details: Column | None = None) -> Column:
    """The kind of an announcement by its subject and details; other if no pattern matches."""
    blob = F.concat_ws(" ", subject, details) if details is not None else subject
    return first_match([(F.rlike(blob, F.lit("(?i)" + p)), kind) for p, kind in ANNOUNCEMENTS], "other")


def clean_html(html: Column) -> Column:
    """Visible text: without scripts, styles and tags, entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normal_text(text: Column) -> Column:
    """Lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def canonical_url(url: Column) -> Column:
    """Without the fragment and the utm_ parameters; the rest of the query stays in order."""
    bare = F.regexp_replace(url, "#.*$", "")
    parts = F.split(bare, r"\?", 2)
    kept = F.filter(F.split(F.get(parts, F.lit(1)), "&"), lambda p: ~F.startswith(F.lower(p), F.lit("utm_")) & (p != ""))
    return F.concat(F.get(parts, F.lit(0)), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def source_id(symbol: Column, url: Column) -> Column:
    return F.concat(symbol, F.lit("-w"), F.substring(F.sha1(canonical_url(url)), 1, 10))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether the host of a URL is one of the domains or below one of them."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit("")))
    return F.coalesce(reduce(lambda a, b: a | b, [(host == h) | F.endswith(host, F.lit("." + h)) for h in hosts]), F.lit(False))


def placeholder_to_null(url: Column) -> Column:
    return F.when((F.trim(url) == "-") | F.endswith(F.trim(url), F.lit("/-")) | (F.trim(url) == ""), None).otherwise(url)


def short_tokens(text: Column, most: int) -> Column:
    """The first words of a text."""
    return F.array_join(F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, most), " ")


def excerpt(text: Column, most: int, mark: str = " [...]") -> Column:
    """Blank lines collapsed; a text that is too long is cut and marked."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(mark))).otherwise(flat)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points (x ascending), flat beyond them; null for null."""
    rules = [(x <= points[0][0], F.lit(float(points[0][1])))]
    for (a, ya), (b, yb) in zip(points, points[1:]):
        rules.append((x <= b, ya + (x - a) * ((yb - ya) / (b - a))))
    return F.when(x.isNotNull(), first_match(rules, F.lit(float(points[-1][1]))))


def nearest_ratio(x: Column, ratios: list[float]) -> Column:
    """struct(off, ratio): of the constants the one that x is relatively closest to; ties go to the smaller one."""
    return F.array_min(F.array(*[F.struct(F.abs(x / r - 1).alias("off"), F.lit(float(r)).alias("ratio")) for r in sorted(ratios)]))


def clip(x: Column, low: float, high: float) -> Column:
    """x between the bounds; null for null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def weighted_mean(pairs: list[tuple[Column, float]], least: int = 1) -> Column:
    """Mean of the known values, weights renormalised; null if fewer than ``least`` are known."""
    known = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x, _ in pairs])
    total = reduce(lambda a, b: a + b, [F.coalesce(x * w, F.lit(0.0)) for x, w in pairs])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), float(w)).otherwise(0.0) for x, w in pairs])
    return F.when(known >= least, F.try_divide(total, weight))


def weighted_median(pairs: Column) -> Column:
    """Of an array of (value, weight): the smallest value at which half of the weight is reached; null entries don't count."""
    known = F.sort_array(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["weight"] > 0)))
    half = F.aggregate(known, F.lit(0.0), lambda a, p: a + p["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))
    step = lambda a, p: F.struct((a["sum"] + p["weight"]).alias("sum"), F.when(a["value"].isNull() & (a["sum"] + p["weight"] >= half), p["value"]).otherwise(a["value"]).alias("value"))
    return F.aggregate(known, start, step, lambda a: a["value"])


def two_stage_value(flow: Column, growth: Column, rate: Column, terminal: Column, years: int = 5) -> Column:
    """Present value of a flow that grows at ``growth`` for some years, then as long again while growth fades linearly to the terminal rate, then for ever.

    In the second stage the power restarts from the end of the first. Null unless the rate exceeds the terminal growth.
    """
    first = reduce(lambda a, b: a + b, [flow * F.pow(1 + growth, t) / F.pow(1 + rate, t) for t in range(1, years + 1)])
    base = flow * F.pow(1 + growth, years)
    second, last = F.lit(0.0), base
    for t in range(1, years + 1):
        g = growth + (terminal - growth) * (t / years)
        last = base * F.pow(1 + g, t)
        second = second + last / F.pow(1 + rate, years + t)
    end = last * (1 + terminal) / (rate - terminal) / F.pow(1 + rate, 2 * years)
    return F.when((rate > terminal) & (flow > 0), first + second + end)


def implied_growth(value: Column, flow: Column, rate: Column, terminal: Column, years: int = 10, low: float = -0.5, high: float = 0.6, steps: int = 21) -> Column:
    """The growth over some years, and at the terminal rate from then on, at which a flow is worth the value, by bisection.

    A growth at the rate or above counts as worth more. Null unless value and flow are positive, the rate exceeds the terminal
    growth, and the value lies between those at the bounds.
    """
    target = value / flow

    def worth(g: Column) -> Column:
        q = (1 + g) / (1 + rate)
        stage = reduce(lambda a, b: a + b, [F.pow(q, n) for n in range(1, years + 1)])
        return F.when(g >= rate, F.lit(1e10)).otherwise(stage + F.pow(q, years) * (1 + terminal) / (rate - terminal))

    def step(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        above = worth(mid) > target
        return F.struct(F.when(above, s["low"]).otherwise(mid).alias("low"), F.when(above, mid).otherwise(s["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")), step, lambda s: (s["low"] + s["high"]) / 2)
    return F.when((value > 0) & (flow > 0) & (rate > terminal) & (worth(F.lit(low)) <= target) & (worth(F.lit(high)) >= target), found)


def earnings_power(profit: Column, rate: Column) -> Column:
    """What a profit without growth is worth."""
    return F.when((profit > 0) & (rate > 0), profit / rate)


def justified_pb(roe: Column, coe: Column, growth: Column) -> Column:
    """The price to book at which a return is worth its cost; null unless positive and the cost exceeds the growth."""
    multiple = F.when(coe > growth, (roe - growth) / (coe - growth))
    return F.when(multiple > 0, multiple)


def dividend_value(dividend: Column, coe: Column, growth: Column) -> Column:
    """What a dividend that grows for ever is worth."""
    return F.when((coe > growth) & (dividend > 0), dividend / (coe - growth))


def day_ranges(start: Column, end: Column, days: int = 31) -> Column:
    """Array of (first, last) of the runs of so many days between two dates; the last one ends with them."""
    firsts = F.sequence(start, end, F.expr(f"interval {days} days"))
    return F.when(start <= end, F.transform(firsts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last"))))


def gates_of_tier(gates: Column, tier: str) -> Column:
    """How many entries of a JSON array of (code, tier, ...) have the tier; 0 for anything else."""
    found = F.from_json(gates, "array<struct<code:string,tier:string>>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.size(F.filter(found, lambda g: g["tier"] == tier)), F.lit(0))


def canonical_digest(columns: list[str]) -> Column:
    """sha-256 of the JSON of the columns in the order of their names: equal values, equal digest."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
