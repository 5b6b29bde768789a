"""Personal data by candidate spans and gradient-boosted trees, with DataFrame functions only.

Exact rules find e-mail and IP addresses, card and phone numbers; these spans always stand. High-recall generators
propose more spans, which overlap each other and those of the rules: long mixed tokens, runs of digits with separators,
and anything around an @. Boosted trees score a candidate by its format and by the characters around it; candidates at or
above the threshold of their kind are added.

The trees are fitted on all candidates with a label, counted by what the trees see of them, with labels from evidence that they don't see: check digits and ranges of the
rules, and the **words** around a candidate. Personal is what shares characters with a valid span, and what a word before it
names (``token``, ``password``, ``tel``, ``ssn``, ...) where its size is possible for that. Not personal are dates, versions, amounts
with a unit or currency, tokens without such a name, numbers as long as a card's whose check digit is wrong, and four dotted
numbers of which one is no byte. Other bare numbers and addresses without evidence are not learned from.
So a telephone number without a plus sign is found by its likeness to named ones and to those of the rules. Each half of
the values is also scored by trees that were grown on the other half: the lowest score of a kind from which on the wanted
precision holds there becomes its threshold. The trees run as one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, written so that a match costs time in proportion to the text: same matches as the plain forms
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]``.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[0-9]++(?:[\x20-][0-9]++)*+|(?:[\x20-][0-9]++)++)",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20().-]{6,40}[0-9]",
    "address": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++",
}
ASSIGNED = r"(?i)(token|key|secret|passw(or)?d|pwd|auth|credential|api)[\w.-]{0,20}[\x20\x22']{0,3}[:=]?[\x20\x22']{0,3}$"
NAMED = r"(?i)\b(phone|tel|telephone|mobile|cell|fax|call|card|account|acct|iban|ssn|social security|passport)[\w.-]{0,12}[\x20:.=#(\x22']{0,4}(is|no|number|nr)?[\x20:.=#(\x22']{0,4}$"
#: Forms of numbers that are no personal data.
DATE = r"^\(?((19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2})([ .-][0-9]{1,2})*$|^(19|20)[0-9]{2} ?-+ ?(19|20)[0-9]{2}$"
VERSION = r"(?i)(\b(v|ver|version|release|build|revision|rev|isbn|issn|page|pages|chapter|figure|no|number|id)\.?|#)[\x20:=#]{0,3}$"
AMOUNT_BEFORE, AMOUNT_AFTER = r"([$€£¥₹]|\b(usd|eur|gbp|rs)\.?)\x20?$", r"(?i)^\x20?(%|°|(kg|g|mg|km|m|cm|mm|ms|s|h|kb|mb|gb|tb|hz|khz|mhz|w|kw|v|usd|eur|dollars?|euros?|bytes?|years?|days?|people)\b)"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as (start, end, value), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)

    def add(done: Column, k: Column) -> Column:
        start = done["at"] + F.get(between, k)
        end = start + F.length(F.get(found, k))
        return F.struct(end.alias("at"), F.array_append(done["out"], F.struct(start.alias("start"), end.alias("end"), F.get(found, k).alias("value"))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    return F.when(F.size(found) > 0, walked).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether the last of the digits is their check digit."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid spans of a rule; matches that fail are dropped without a second try."""
    may = F.contains(text, F.lit({"email": "@", "phone": "+", "ip": "."}.get(kind, "")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(may, F.filter(matches(text, RULES[kind]), lambda m: _valid(kind, m["value"]))).otherwise(none)


def _count(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", ""))


#: What the trees see of a candidate: its format, and the characters next to it, but no words.
FEATURES = {
    "length": lambda c: F.length(c["value"]),
    "digits": lambda c: _count(c["value"], "0-9"),
    "capitals": lambda c: _count(c["value"], "A-Z"),
    "small": lambda c: _count(c["value"], "a-z"),
    "hex": lambda c: _count(c["value"], "0-9a-fA-F"),
    "blanks": lambda c: _count(c["value"], " "),
    "dots": lambda c: _count(c["value"], "."),
    "hyphens": lambda c: _count(c["value"], "-"),
    "ats": lambda c: _count(c["value"], "@"),
    "brackets": lambda c: _count(c["value"], "()"),
    "plus": lambda c: F.startswith(c["value"], F.lit("+")).cast("int"),
    "turns": lambda c: F.size(F.regexp_extract_all(c["value"], F.lit("[0-9]+"), F.lit(0))),
    "longest": lambda c: F.array_max(F.transform(F.regexp_extract_all(c["value"], F.lit("[0-9]+"), F.lit(0)), F.length)),
    "distinct": lambda c: F.size(F.array_distinct(F.split(c["value"], ""))),
    "quoted": lambda c: F.rlike(c["before"], F.lit("[\"'`]$")).cast("int"),
    "given": lambda c: F.rlike(c["before"], F.lit("[:=][\\x20\"'`]{0,3}$")).cast("int"),
    "joined": lambda c: F.rlike(c["before"], F.lit("[\\p{L}\\p{N}_/.-]$")).cast("int"),
    "closed": lambda c: F.rlike(c["after"], F.lit("^[\"'`,;)]")).cast("int"),
    "followed": lambda c: F.rlike(c["after"], F.lit("^[\\p{L}\\p{N}_/%-]")).cast("int"),
    "token": lambda c: (c["kind"] == "secret").cast("int"),
}


def evidence(c: Column, base: Column) -> Column:
    """1 for personal data, 0 for something else, null where nothing tells; see the module's text."""
    v, number, secret, digits = c["value"], c["kind"] == "number", c["kind"] == "secret", _count(c["value"], "0-9")
    date = F.rlike(v, F.lit(DATE))
    counted = F.rlike(c["before"], F.lit(AMOUNT_BEFORE)) | F.rlike(c["after"], F.lit(AMOUNT_AFTER)) | F.rlike(c["before"], F.lit(VERSION))
    dotted = F.rlike(v, F.lit(r"^[^@]+@[^@.]+(\.[^@.]+)+$"))
    return (
        F.when(_overlaps(c, base), 1)
        .when(secret, F.rlike(c["before"], F.lit(ASSIGNED)).cast("int"))
        .when(number & date, 0)
        .when(number & F.rlike(c["before"], F.lit(NAMED)) & digits.between(7, 19), 1)
        .when(number & counted, 0)
        .when(number & F.rlike(v, F.lit(r"^[0-9\x20-]+$")) & digits.between(13, 19), 0)
        .when(number & F.rlike(v, F.lit(r"^[0-9]+(\.[0-9]+){3}$")), 0)
        .when((c["kind"] == "address") & dotted, 1)
        .when((c["kind"] == "address") & ~F.contains(v, F.lit(".")), 0)
    )


def candidates(text: Column) -> Column:
    """What the generators propose: (kind, start, end, value, before, after), overlaps included; before and after are the characters around it."""
    with_digit = F.rlike(text, F.lit("[0-9@]"))

    def of(kind: str) -> Column:
        found = matches(text, GENERATORS[kind])
        if kind == "secret":
            found = F.filter(found, lambda m: F.rlike(m["value"], F.lit("[0-9].*[0-9]")) & F.rlike(m["value"], F.lit("[A-Za-z]")))
        before = lambda m: F.substring(text, F.greatest(m["start"] - 31, F.lit(1)), F.least(m["start"], F.lit(32)))
        after = lambda m: F.substring(text, m["end"] + 1, F.lit(12))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), before(m).alias("before"), after(m).alias("after")))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")
    return F.when(with_digit, F.concat(*[of(k) for k in GENERATORS])).otherwise(none)


def _overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


@dataclass
class SpanModel:
    """trees: (weight, tree); a tree is a prediction, or (feature, threshold, left, right). thresholds: the least score to add a span of a kind."""

    trees: list[tuple]
    thresholds: dict[str, float]


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit_spans(docs: DataFrame, rounds: int = 8, depth: int = 3, precision: float = 0.98, least_seen: int = 5, parts: int = 16) -> SpanModel:
    """Fit on the candidates of all documents that have a label; equal ones by features, label and half are one row with a weight.

    Without candidates of both labels nothing is added, nor is anything of a kind of which no score reaches the
    precision on ``least_seen`` or more candidates that the trees which scored them hadn't seen: on all of them, and on
    those that share no character with a valid span.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from .shared import materialized

    some = docs.select("text").where(F.rlike("text", F.lit("[0-9@]"))).withColumn("base", F.concat(*[base_spans(F.col("text"), k) for k in RULES]))
    some = some.select("base", F.explode(candidates(F.col("text"))).alias("c")).withColumn("label", evidence(F.col("c"), F.col("base"))).where("label is not null")
    half = F.pmod(F.xxhash64("c.value", F.lit(7)), F.lit(2)).alias("half")
    some = some.select("c.kind", half, "label", (~_overlaps(F.col("c"), F.col("base"))).cast("int").alias("fresh"), *[f(F.col("c")).cast("double").alias(n) for n, f in FEATURES.items()])
    alike = some.groupBy(*some.columns).agg(F.count("*").alias("n"))
    # the hash and the order fix the rows and their places: a new run grows the same trees
    some = materialized(alike.repartition(parts, *FEATURES).sortWithinPartitions(*some.columns))
    shown = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(some).persist(StorageLevel.DISK_ONLY)

    def grown(rows: DataFrame) -> list[tuple]:
        if rows.select("label").distinct().count() < 2:
            return []
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, weightCol="n").fit(rows)
        return [(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]

    try:
        trees, halves = grown(shown), [grown(shown.where(F.col("half") != k)) for k in (0, 1)]
    finally:
        shown.unpersist()
    held = {n: (lambda n: lambda c: c[n])(n) for n in FEATURES}
    row = F.struct(*[F.col(n) for n in FEATURES])
    scores = [F.when(F.col("half") == k, _score_of(t, row, held)) for k, t in enumerate(halves) if t]
    if not (trees and scores):
        return SpanModel([], {})
    # counts by score rounded to thousandths: at most 1,001 rows a kind
    rows = some.withColumn("p", F.round(F.coalesce(*scores), 3)).where("p is not null")
    sums = [F.sum(F.col("n") * x).alias(name) for name, x in (("good", F.col("label")), ("all", F.lit(1)), ("fresh_good", F.col("label") * F.col("fresh")), ("fresh_all", F.col("fresh")))]
    counts = rows.groupBy("kind", "p").agg(*sums).orderBy("kind", F.desc("p")).collect()
    thresholds: dict[str, float] = {}
    for kind in GENERATORS:
        total = dict.fromkeys(("good", "all", "fresh_good", "fresh_all"), 0)
        for r in (r for r in counts if r["kind"] == kind):
            total = {k: v + r[k] for k, v in total.items()}
            # of those that no rule has found, which are what is added, too
            sure = total["good"] >= precision * total["all"] and total["fresh_good"] >= precision * total["fresh_all"]
            if r["p"] >= 0.5 and total["all"] >= least_seen and sure:
                thresholds[kind] = r["p"] - 5e-4
    return SpanModel(trees, thresholds)


def _score_of(trees, c: Column, features) -> Column:
    names = list(features)

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(features[names[tree[0]]](c) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    return 1 / (1 + F.exp(-2 * reduce(lambda a, b: a + b, [w * of(t) for w, t in trees])))


def find_pii(docs: DataFrame, model: SpanModel | None = None, base: str = "base", added: str = "added") -> DataFrame:
    """docs with ``base`` and ``added`` (or the names given): arrays of (kind, start, end), in code points, end exclusive, by kind and start.

    base has the spans of the rules, by kind as in RULES; added those that the model (fitted on docs unless given) adds and
    that share no character with them, nor with an earlier added one. Null and empty texts have none, equal texts equal ones;
    repeated rows stay. Columns with the names of the two are replaced, others of any name stay.
    """
    model = model or fit_spans(docs)
    docs = docs.drop(base, added)
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    kinds = {k: base_spans(text, k) for k in RULES}
    bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    tagged = lambda kind, spans: F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = docs.withColumn(base, F.concat(*[tagged(k, s) for k, s in kinds.items()]))
    if not (model.trees and model.thresholds):
        return found.withColumn(added, none)
    found = found.withColumn("__candidates", candidates(text))
    fresh = F.filter("__candidates", lambda c: c["kind"].isin(list(model.thresholds)) & ~_overlaps(c, F.col(base)))
    measured = F.transform(fresh, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *[f(c).cast("double").alias(n) for n, f in FEATURES.items()]))
    least = lambda c: reduce(lambda rest, k: F.when(c["kind"] == k, model.thresholds[k]).otherwise(rest), model.thresholds, F.lit(2.0))
    good = F.filter(measured, lambda c: _score_of(model.trees, c, {n: (lambda n: lambda c: c[n])(n) for n in FEATURES}) >= least(c))
    apart = F.aggregate(F.transform(good, bare), none, lambda out, c: F.when(_overlaps(c, out), out).otherwise(F.array_append(out, c)))
    return found.select(*columns, base, apart.alias(added))


def redact(docs: DataFrame, model: SpanModel | None = None, mask: str = "[{}]") -> DataFrame:
    """docs with every span of :func:`find_pii` in text replaced by its kind; other columns, whatever their names, and texts without spans, stay."""
    columns = docs.columns
    found = find_pii(docs, model, "__base", "__added")
    spans = F.array_sort(F.transform(F.concat("__base", "__added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    # spans of different rules may overlap: what one has covered isn't repeated
    def add(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(s["end"], done["at"]).alias("at"), F.when(fresh, F.concat(done["out"], gap, F.format_string(mask.replace("{}", "%s"), s["kind"]))).otherwise(done["out"]).alias("out"))

    walked = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    found = found.withColumn("__spans", spans)
    return found.select(*[F.when(F.size("__spans") > 0, walked).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns])
