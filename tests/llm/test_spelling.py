import random
import re
import zlib
from collections import Counter

import pytest
from text_tables import ROWS, documents

from kairopanel.llm import queries, spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def changed_by_hand(i, run):
    h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def neighbours(w):
    """All strings one edit away."""
    cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in ALPHABET} | {a + c + b for a, b in cuts for c in ALPHABET}
    return out - {w}


def variants_by_hand(rows, change=lambda i, w: w, length=6, least=5, times=5):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            n[change(i, re.sub("[A-Z]", lambda m: m[0].lower(), run))] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= least}
    near = {w: sorted(v for v in neighbours(w) if v in n) if len(w) < 200 else [] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return Counter(out)


def misspelt(rng, n_rows=300):
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["ñandúes", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    weights = [5 ** rng.randint(0, 3) for _ in stems]
    rows = []
    for k in range(n_rows):
        words = []
        for w in rng.choices(stems, weights, k=20):
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abé")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(rng.choice([w, w, w.upper(), w + "2" + w]))
        rows.append((k, " ".join(words)))
    return rows


def compared(found, expected):
    assert tuple(found.columns) == COLUMNS
    found = Counter(map(tuple, found.collect()))
    assert found == expected, (list((found - expected))[:5], list((expected - found))[:5])


@pytest.mark.parametrize("most", [3, 4096])
def test_variants_against_all_edits(spark, most):
    rows = misspelt(random.Random(1))
    expected = variants_by_hand(rows, least=2, times=3)
    assert sum(r[1] is not None for r in expected) > 100 and sum(r[1] not in (None, r[2]) for r in expected) > 5
    compared(spelling.spelling_variants(documents(spark, rows), least_n=2, times=3, most=most), expected)


def test_variants_of_messy_rows(messy, empty):
    compared(spelling.spelling_variants(messy, least_length=3, least_n=1, times=2), variants_by_hand(ROWS, length=3, least=1, times=2))
    assert spelling.spelling_variants(empty).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rows = misspelt(random.Random(7), 500) + [(None, "wording wording"), (900, None), (901, ""), (902, "Wörding × ÷ ÀÿÀÿÀÿ"), (902, "Wörding ÀÿÀÿÀÿ")] * 3
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    compared(queries.op12_spelling_variants(spark, str(tmp_path)), variants_by_hand(rows, changed_by_hand))


def test_counts_leave_a_task_before_they_grow(spark):
    rows = [(k, f"wordnumber{'abcdefghij'[k % 10]} wordcommon") for k in range(50)]
    found = {r["word"]: r["n"] for r in spelling.word_counts(documents(spark, rows), most_held=3).collect()}
    assert found == {"wordcommon": 50} | {f"wordnumber{c}": 5 for c in "abcdefghij"}


def test_pairs_beyond_a_bitset_word():
    words = [a + b + c for a in ALPHABET[:6] for b in ALPHABET[:6] for c in ("", *ALPHABET[:6])]
    expected = {(w, v) for w in words for v in neighbours(w) if v in set(words)}
    found = list(spelling.near_pairs(words))
    assert len(found) == len(set(found)) and set(found) == expected
