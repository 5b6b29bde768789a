import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from text_tables import ROWS, documents

from kairopanel.llm import suffix_arrays


def kept_by_hand(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def compared(docs, rows, length, **how):
    found = suffix_arrays.repeated_bytes(docs, length=length, **how)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect())
    expected = kept_by_hand([r[1] for r in rows], length)
    assert found == Counter((r[0], *e[:3], hashlib.sha256(e[3]).hexdigest()) for r, e in zip(rows, expected))
    return expected


@pytest.mark.parametrize(("length", "shard", "ranges"), [(7, 300, 100), (40, 2000, 10**6), (400, 10**6, 10**6)])
def test_bytes_against_brute_force(messy, length, shard, ranges):
    expected = compared(messy, ROWS, length, shard_bytes=shard, range_bytes=ranges)
    assert sum(e[1] for e in expected) > 0


@pytest.mark.parametrize("shard", [500, 10**6])
def test_passages_in_a_third_of_the_documents(spark, shard):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "語", "zeta"]) + str(rng.randrange(50)) for _ in range(n))
    common, rows = prose(20), []
    for k in range(60):
        t = prose(30)
        rows.append((k, t + common + prose(5) if k % 3 == 0 else t + t[10:90] if k % 7 == 0 else t))
    rows += [(100 + k, rows[k][1][k:]) for k in range(0, 20, 4)] + [(200, rows[1][1]), (201, rows[1][1])]
    expected = compared(documents(spark, rows), rows, 50, shard_bytes=shard)
    assert sum(e[2] for e in expected) > 20


def test_no_documents_and_short_strings(empty):
    assert suffix_arrays.repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError, match="2 bytes"):
        suffix_arrays.repeated_bytes(empty, length=1)


def test_arrays_and_prefixes_against_sorting():
    rng = random.Random(5)
    for k in range(60):
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30))) for _ in range(4)] + [b"abcabc" * 12, b"cabcab" * 11] * (k % 2)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        places = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
        by = sorted(range(len(places)), key=lambda p: ([b + 1 for b in texts[places[p][0]][places[p][1] :]] + [0], places[p][0]))
        order, rank, left, key = suffix_arrays.suffix_array(data, offsets)
        assert order.tolist() == by and rank[order].tolist() == list(range(len(by)))
        held = [texts[i][j:] for i, j in (places[p] for p in by)]
        agree = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffix_arrays.common_prefixes(data, offsets, order, left, key).tolist() == [0] * bool(by) + [agree(a, b) for a, b in zip(held, held[1:])]
