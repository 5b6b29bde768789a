"""Licence scan by canonical digests, with DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices of well-known licences.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
    ("Unlicense", "Released under the Unlicense."),
]

#: Lines that may stand before a full text.
TITLES = {
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License"],
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
}


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the full texts and standard headers in ``license_texts``, under each of their titles.

    The BSD texts are known with numbers and with bullets, with and without the line that reserves all rights.
    """
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = path.stem.split("--")[0], path.read_text(encoding="utf-8")
        for title in TITLES.get(name, [""]):
            bodies = [text]
            if name.startswith("BSD"):
                bodies += [re.sub(r"(?m)^ *[0-9]\. ", "* ", text)]
                bodies += ["All rights reserved.\n" + b for b in bodies]
            out += [(name, f"{title}\n{b}") for b in bodies]
    return out


#: The canonical form, step by step: (strings of which a text has one if the step changes it, pattern, replacement), in the
#: syntax that Java and RE2 share; the text is lower-cased first. Copyright lines go, punctuation becomes blanks, and
#: equivalent spellings one word.
STEPS = [
    (("copyright", "(c)", "©"), r"(?m)^[^a-z0-9\n]*(copyright\b|\(c\)|©)[^\n]*$", " "),
    (("http",), r"https?://", " "),
    (("&",), r"&", " and "),
    ((), r"[^\p{L}\p{N}]+", " "),
    (("licence",), r"\blicence", "license"),
    (("sub licen",), r"\bsub licen[cs]", "sublicens"),
    (("sublicenc",), r"\bsublicenc", "sublicens"),
    (("non commercial",), r"\bnon commercial", "noncommercial"),
    (("copyright ",), r"\bcopyright (owner|holder)s?\b", "copyright holder"),
    (("acknowledgement",), r"\backnowledgement", "acknowledgment"),
    (("authoris", "organis", "recognis", "utilis"), r"\b(author|organ|recogn|util)is(e|ation|ing)", "${1}iz${2}"),
    (("favour",), r"\bfavour", "favor"),
    (("whilst",), r"\bwhilst\b", "while"),
    (("creative commons",), r"\bcreative commons\b", "cc"),
    (("v",), r"\b(version|ver|v) ?([0-9])", "version ${2}"),
    (("version ",), r"\bversion ([0-9]+) 0( |$)", "version ${1} "),
    (("  ",), r" +", " "),
]


def canonical(text: Column) -> Column:
    """The text in the form whose digests are compared; null stays null."""
    held = F.array(F.lower(text))  # an array of one, so that each step is bound to a variable and computed once
    for marks, pattern, replacement in STEPS:
        held = F.transform(held, _step(marks, pattern, replacement.replace("${", "$").replace("}", "")))
    return F.trim(F.get(held, F.lit(0)))


def _step(marks: tuple[str, ...], pattern: str, to: str):
    def step(x: Column) -> Column:
        done = F.regexp_replace(x, pattern, to)
        return F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks]), done).otherwise(x) if marks else done

    return step


def canonical_sql(text: str) -> str:
    """The same as an expression of a dialect with RE2."""
    out = f"lower({text})"
    for _, pattern, replacement in STEPS:
        to = replacement.replace("${", "\\").replace("}", "").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"trim({out})"


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest) of licence texts (license, text), NOTICES and the full texts unless given; one licence for each digest: the first by name."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in (NOTICES + full_texts() if texts is None else texts)) + " AS t(license, text)")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, unit, line, license, digest): where whole texts or whole lines of docs (doc_id, text) are a known licence text.

    unit is ``text`` (line 0) or ``line`` (from 1, between line ends). Texts are compared by the sha-256 of their
    canonical form, whole: a licence among other words of its line isn't found. Null and empty texts, and those that nothing is left of, match nothing.
    Repeated rows are reported each. known: (digest, license), for example of :func:`known_licenses`; it is broadcast if it has at most
    ``most_broadcast`` rows, else joined by digest.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known.select("digest", "license")
    few = known.limit(most_broadcast + 1).count() <= most_broadcast
    lines = docs.select("doc_id", "text", F.transform(F.split("text", "\n"), lambda line, k: F.struct(F.lit("line").alias("unit"), (k + 1).alias("line"), canonical(line).alias("c"))).alias("lines"))
    # steps after the one for punctuation look beyond a line's end: a text of more than one line has a canonical form of its own
    whole = F.when(F.size("lines") > 1, canonical(F.col("text"))).otherwise(F.get("lines", F.lit(0))["c"])
    units = lines.select("doc_id", F.explode(F.array_append("lines", F.struct(F.lit("text").alias("unit"), F.lit(0).alias("line"), whole.alias("c")))).alias("u"))
    found = units.select("doc_id", "u.unit", "u.line", "u.c").where("c <> ''").withColumn("digest", F.sha2("c", 256)).drop("c")
    return found.join(F.broadcast(known) if few else known, "digest").select("doc_id", "unit", F.col("line").cast("long").alias("line"), "license", "digest")
