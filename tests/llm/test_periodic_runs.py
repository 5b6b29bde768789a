import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from text_tables import ROWS, documents

from kairopanel.llm import periodic_runs, queries
from kairopanel.llm.shared import mix


def runs_by_hand(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the least period comes first
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def digests_by_hand(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = runs_by_hand(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join("{},{},{}\n".format(*r) for r in runs)
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed.encode()), sha(b" ".join(collapsed_by_hand(w, runs))))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def some_words(rng):
    k = rng.choice([1, 2, 3, 8, 30])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        p, at = rng.randint(1, 7), rng.randint(0, len(w))
        w[at:at] = ([rng.randrange(k) for _ in range(p)] * 9)[: rng.randint(2 * p, 9 * p)]
    return w


def test_runs_against_all_lags():
    rng = random.Random(2)
    for _ in range(300):
        docs = [some_words(rng) for _ in range(3)]
        first = np.cumsum([0, *map(len, docs)])
        found = periodic_runs.periodic_runs(mix(np.array(sum(docs, []), np.uint64) + np.uint64(9)), first)
        assert found == [(int(f) + a, n, q) for f, d in zip(first, docs) for a, n, q in runs_by_hand(d)]


def test_many_slices_of_lags(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_ENTRIES", 50)
    test_runs_against_all_lags()


def test_rare_words_split_and_short_segments_go():
    w = mix(np.array([1, 2] * 5 + [3] + [1] * 3 + [4] * 7, np.uint64))
    begins, ends = periodic_runs.segments(w, np.array([0, len(w)]), 6, 4)
    assert list(zip(begins, ends)) == [(0, 10), (14, 21)]
    assert [x.tolist() for x in periodic_runs.segments(np.zeros(0, np.uint64), np.array([0, 0]), 6, 4)] == [[], []]


def test_collapsing_messy_rows(messy, empty):
    found = periodic_runs.collapse_runs(messy)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    expected = []
    for i, t, *_ in ROWS:
        w = (t or "").encode().split()
        runs = runs_by_hand(w[:400]) if len(w) < 5000 else [(0, len(w), 1)]
        expected.append((i, len(w), tuple(runs), b" ".join(collapsed_by_hand(w, runs)).decode()))
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found.collect()) == Counter(expected)
    assert periodic_runs.collapse_runs(empty).count() == 0
    with pytest.raises(ValueError, match="4 periods"):
        periodic_runs.collapse_runs(empty, times=3)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{x}" for x in some_words(rng))) for k in range(400)] + [(None, "a a a a a a a"), (500, None), (501, ""), (501, "x y " * 5), (501, "x y " * 5)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert tuple(found.columns) == COLUMNS
    assert Counter(map(tuple, found.collect())) == Counter(digests_by_hand(*r) for r in rows)
