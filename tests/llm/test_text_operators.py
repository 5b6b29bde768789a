import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_tables import BASE, ROWS, documents

from kairopanel.llm import embedding_dedup, imatch, jaccard_join, licenses, mixing, packing, pii, shared, substring_dedup, token_store, toxicity
from kairopanel.llm.components import connected_components
from kairopanel.llm.queries import default_tokenizer
from kairopanel.llm.shared import shared_folder


def words(text):
    return (text or "").encode().split()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# packing


def test_packing_places_every_token_once(spark, messy):
    out = packing.best_fit_pack(messy, capacities=(16, 64, 256)).collect()
    assert sum(r["piece_length"] for r in out) == sum(len(words(t)) + 1 for _, t, _ in ROWS)
    by_bin = defaultdict(list)
    for r in out:
        by_bin[r["bin_id"]].append(r)
    for held in by_bin.values():
        held.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in held:
            assert r["bin_start"] == at
            at += r["piece_length"]
        assert at == held[0]["bin_fill"] <= held[0]["bin_capacity"]
        assert held[0]["bin_capacity"] == min(c for c in (16, 64, 256) if c >= at)


def test_packing_takes_the_cheapest_policy():
    cost = packing.sequence_cost(per_sequence=1, per_token=1, per_pair=0)
    bins, starts, capacity, filled = packing.pack(np.array([6, 5, 4, 3, 2]), [8, 20], cost)
    assert sum(map(cost, capacity)) <= cost(20) and filled.sum() == 20
    assert packing.pack(np.zeros(0, int), [8], cost)[0].size == 0


def test_packing_of_nothing(empty):
    assert packing.best_fit_pack(empty).count() == 0


# token store


def test_tokens_round_trip(spark, messy):
    from tokenizers import Tokenizer

    path = shared_folder(spark)
    token_store.write_token_shards(messy, path, default_tokenizer(), end_id=0, shard_docs=5)
    out = token_store.read_token_shards(spark, path, messy).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    expected, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        if i is not None:
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in out) == sorted(expected)


def test_unknown_keys_and_empty_store(spark, messy, empty):
    path = shared_folder(spark)
    token_store.write_token_shards(empty, path, default_tokenizer())
    assert token_store.read_token_shards(spark, path, messy).count() == 0
    token_store.write_token_shards(messy, path, default_tokenizer())
    assert token_store.read_token_shards(spark, path, spark.range(500, 900).withColumnRenamed("id", "doc_id")).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    assert sorted(token_store.PerfectHash.of(keys).place(keys)) == list(range(len(keys)))


# licences


def test_licenses_are_found_in_any_spelling(spark, empty):
    docs = documents(spark, [(1, "Copyright 2020 Someone\nreleased   under the M.I.T? no"), (2, "text\nRELEASED under the MIT licence!"), (3, "Released under the MIT License."), (4, None), (5, ""), (6, "licensed under the Apache License -- version 2"), (7, "Not Released under the MIT License."), (3, "Released under the MIT License.")])
    out = licenses.scan_licenses(docs)
    assert rows(out, "doc_id", "unit", "line", "license") == sorted([(2, "line", 2, "MIT"), (3, "line", 1, "MIT"), (3, "text", 0, "MIT"), (3, "line", 1, "MIT"), (3, "text", 0, "MIT"), (6, "line", 1, "Apache-2.0"), (6, "text", 0, "Apache-2.0")], key=repr)
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_on_messy_rows(messy):
    found = licenses.scan_licenses(messy)
    assert {(r["doc_id"], r["unit"], r["license"]) for r in found.collect()} >= {(16, "text", "MIT"), (16, "line", "MIT")}
    assert {r["doc_id"] for r in found.collect()} == {16} and set(found.columns) == {"doc_id", "unit", "line", "license", "digest"}


def test_wrapped_notices_are_found(spark):
    docs = documents(spark, [(1, "Licensed under the Apache License, Version\n2.0."), (2, "Licensed under Creative\nCommons BY 4.0."), (3, "Licensed under the Mozilla Public License,\nver.\n2.0\n"), (4, "Licensed under the Apache License,\nCopyright (c) 2020 Version\n2.0.")])
    assert rows(licenses.scan_licenses(docs), "doc_id", "unit", "line", "license") == [(1, "text", 0, "Apache-2.0"), (2, "text", 0, "CC-BY-4.0"), (3, "text", 0, "MPL-2.0")]


def test_full_licence_texts_are_found(spark):
    texts = licenses.full_texts()
    docs = documents(spark, [(k, "Copyright (c) 2020 Someone\n\n" + " ".join(t.split(" ")).replace("http:", "https:")) for k, (_, t) in enumerate(texts)] + [(-1, dict(texts)["MIT"] + "and more")])
    found = licenses.scan_licenses(docs).where("unit = 'text'")
    assert rows(found, "doc_id", "license") == sorted(((k, n) for k, (n, _) in enumerate(texts)), key=repr)
    assert {n for n, _ in texts} >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"}


# n-gram Jaccard join


def components_by_hand(docs, n, percent):
    sets = []
    for i, t in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    return sorted(((i, len(s), least.get(v)) for (i, s), v in zip(sets, label)), key=repr)


def test_jaccard_join_on_messy_rows(messy, empty):
    out = jaccard_join.ngram_jaccard_join(messy, words=4, percent=85)
    assert rows(out, "doc_id", "n_shingles", "component_id") == components_by_hand([r[:2] for r in ROWS], 4, 85)
    assert jaccard_join.ngram_jaccard_join(empty).count() == 0


def test_jaccard_join_reads_texts_three_times(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghij"), 30)) for _ in range(40)]
    texts += [t + " z" for t in texts[:20]]
    docs = documents(spark, list(enumerate(texts))).select("doc_id", F.udf(seen, "string")("text").alias("text"))
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.ngram_jaccard_join(docs, words=4, percent=85).collect()}
    assert out == {k: k - 40 if k >= 40 else k for k in range(60)}
    assert read.value == 3 * 60


@pytest.mark.parametrize("hot_share", [0.0005, 2.0])
def test_jaccard_join_of_families_and_common_lines(spark, hot_share):
    rng = np.random.default_rng(5)
    docs = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in rng.integers(0, 400, 150)]
        for _ in range(rng.integers(1, 25)):
            w = list(base)
            for k in rng.integers(0, 150, rng.integers(0, 6)):
                w[k] = f"e{rng.integers(0, 9999)}"
            docs.append((len(docs), "a common line in every text of this table . " + " ".join(w)))
    out = jaccard_join.ngram_jaccard_join(documents(spark, docs), words=4, percent=85, hot_share=hot_share, most_elements=4000, most_compared=8)
    assert rows(out, "doc_id", "n_shingles", "component_id") == components_by_hand(docs, 4, 85)


def test_regions_join_like_all_pairs():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**60, 80).astype(np.uint64))
        for _ in range(20):
            keep = rng.random(len(base)) > 0.04
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**60, 2).astype(np.uint64)])))
    labels = jaccard_join.linked_sets(sets, 85)
    expected = jaccard_join._block(np.arange(len(sets)), sets, np.array([len(s) for s in sets]), np.arange(len(sets)), np.arange(len(sets)), 85)
    assert (labels == expected).all() and len(set(labels)) < 400
    linked = np.zeros(len(sets), bool)
    np.add.at(linked, labels[labels != np.arange(len(sets))], True)
    linked |= labels != np.arange(len(sets))
    may = jaccard_join.may_link(np.stack([jaccard_join.class_counts(s) for s in sets]), np.array([len(s) for s in sets]), 85)
    assert (may >= linked).all()


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(500, 500), (None, 3), (900, 800)], "a long, b long"))
    out = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(out[k] == 0 for k in range(200)) and out[900] == out[800] == 800 and 500 not in out


# toxicity


def toxic_tables(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [f"plain{k}" for k in rng.integers(0, 40, 20)] + (["idiot", "moron"] if bad else [])
        docs.append((i, " ".join(rng.permutation(w))))
        labels.append((i, 1, int(bad)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(out) > 60 and all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out)
    again = toxicity.learn_toxicity(docs.repartition(7), labels)
    assert np.allclose(again.weights, model.weights)


def test_pairs_of_terms_that_mean_nothing_alone():
    """Toxic are texts with both terms or neither: with one alone, as many are toxic as not."""
    rng = np.random.default_rng(0)
    x, others = rng.integers(0, 2, (8000, 2)), rng.integers(10, 60, (8000, 15))
    y = x[:, 0] == x[:, 1]
    data = [np.unique(np.concatenate([o, np.flatnonzero(r)])) for o, r in zip(others, x)]
    model = toxicity.fit(data[:6000], y[:6000])
    assert ((model.margins(data[6000:]) >= 0) == y[6000:]).mean() > 0.95


def test_toxicity_of_messy_rows(spark, messy, empty):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn_toxicity(docs, labels)
    out = toxicity.score_toxicity(messy, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.learn_toxicity(empty, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(messy, none).collect())
    assert toxicity.score_toxicity(empty, model).count() == 0


# fingerprints


def test_fingerprint_report(messy, empty):
    out = imatch.fingerprint_report(messy, block_docs=4)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (i, t, _) in enumerate(order):
        t, n = t or "", (order[(k + 1) % len(order)][1] or "")
        cut = len(t) // 3
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()))
    assert rows(out, "doc_id", "n_chars", "edited_sha256") == sorted(expected, key=repr)
    held = out.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in held)
    of = defaultdict(set)
    for r in held:
        if r["doc_id"] in (0, 1):
            of["base"].add(r["fingerprint"])
        if r["doc_id"] in (4, 5):
            of["empty"].add(r["fingerprint"])
    assert len(of["base"]) == len(of["empty"]) == 1
    assert imatch.fingerprint_report(empty).count() == 0


def test_likeness_follows_the_edit(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 200))) for i in range(400)]
    out = imatch.fingerprint_report(documents(spark, docs), least=0.002, most=0.5).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert out["e"] > 0.25 > 0.12 > out["n"]
    same = imatch.document_fingerprints(documents(spark, docs[:3] + docs[:3]))
    assert same.select("fingerprint").distinct().count() == 3


def test_near_copies_of_a_third_of_the_rows(spark):
    """Their own terms are above the band; ids lie far apart."""
    rng = np.random.default_rng(2)
    base = [f"c{k}" for k in range(80)]
    docs = [(2**62 if i == 299 else -(2**63) if i == 298 else i, " ".join(base[:40] + [f"odd{i}"] + base[41:]) if i % 3 == 0 else " ".join(f"w{k}" for k in rng.integers(0, 4000, 60))) for i in range(300)]
    out = imatch.fingerprint_report(documents(spark, docs + [(900, "?"), (901, "."), (902, "a")]), least=0.01, block_docs=16)
    order = sorted(docs, reverse=True)
    copies = {i for i, t in docs if t.startswith("c0 ")}
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["near_edited"] > 0.25 for i in copies) and np.mean([got[i]["near_edited"] for i in copies]) > 0.4
    for (i, _), (j, _) in zip(order, order[1:]):
        if 10 < i < 290:
            assert got[i]["near_next"] < 0.2 or (i in copies) == (j in copies)
    beside = [t for _, t in docs if t.startswith("c0 ")] + [t for _, t in docs if not t.startswith("c0 ")]
    out = imatch.fingerprint_report(documents(spark, list(enumerate(beside))), least=0.01, block_docs=16)
    assert all(r["near_next"] > 0.7 for r in out.where("doc_id between 1 and 99").collect())


def test_hashes_of_no_bytes_in_a_fresh_worker(monkeypatch):
    monkeypatch.setattr(shared, "_POWERS", {})
    none = np.zeros(0, np.int64)
    assert len(shared.word_hashes(np.zeros(0, np.uint8), none, none)) == 0


def test_places_among_cuts(spark):
    df = spark.createDataFrame([(x,) for x in (-(2**63), -5, 0, 3, 4, 9, 2**63 - 1, None)], "x long")
    assert [r[0] for r in df.select(shared.place_of("x", [-5, 3, 8])).collect()] == [0, 0, 1, 1, 2, 3, 3, 0]
    assert [r[0] for r in df.select(shared.place_of("x", [])).collect()] == [0] * 8 and shared.id_cuts(df, 1) == []


# embeddings


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 16))
    x = np.repeat(centers, 5, axis=0) + rng.normal(scale=0.02, size=(300, 16))
    x[10] = x[11]
    data = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (306, [2.0, 4.0]), (None, data[0][1])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumns({"k": F.lit(1), "n": F.lit(2)})
    out = embedding_dedup.embedding_near_dups(df, most_members=3)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    links = (y.astype(np.float64) @ y.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r for r in out.where("vec_id is not null").collect()}
    assert len(got) == 307 and out.count() == 309
    exact = sum(got[i]["n_links"] == links[i] + (1 if i < 5 else 0) for i in range(300))
    assert exact >= 290 and all(got[i]["n_links"] <= links[i] + (1 if i < 5 else 0) for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(300, 305))
    assert got[305]["n_links"] == 2 and got[305]["component_id"] == got[306]["component_id"] == 305 and not got[306]["kept"]
    assert embedding_dedup.embedding_near_dups(df.limit(0)).count() == 0


def test_links_of_a_group_with_a_third_of_the_vectors(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    center = unit(rng.normal(size=64))
    noise = rng.normal(size=(1000, 64))
    group = 0.97 * center + math.sqrt(1 - 0.97**2) * unit(noise - (noise @ center)[:, None] * center)
    x = np.concatenate([group, unit(rng.normal(size=(2000, 64)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = embedding_dedup.embedding_near_dups(df, pivots=1024, most_members=400)
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = dict(rows(out, "vec_id", "n_links"))
    assert 0.99 * sum(links) <= sum(got.values()) and sum(links) > 10_000 and all(got[i] <= links[i] for i in range(3000))


# mixing


def targets_by_hand(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]} if open_ else set()
        if not over:
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out | {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}


def copies_by_hand(table, seed=0, large=0.01, most=2):
    """Document by document, in the order of the prefix sums; (doc_id, copies)."""
    held = table.withColumns({"h": F.xxhash64(F.lit(seed), "doc_id", "text"), "u": F.pmod(F.xxhash64(F.lit(seed), F.col("source").isNull(), F.coalesce("source", F.lit(""))), F.lit(1 << 20)) / float(1 << 20)}).collect()
    by_source, out = defaultdict(list), []
    for r in held:
        by_source[r["source"]].append((len(words(r["text"])), r["h"], r["doc_id"], r["u"]))
    aim = targets_by_hand({s: sum(d[0] for d in docs) for s, docs in by_source.items()})
    for s, docs in by_source.items():
        size_class = lambda d: math.floor(math.log2(d[0] + 1) * 8)
        docs.sort(key=lambda d: (-size_class(d), d[1] % 4, -d[0], d[1], math.inf if d[2] is None else d[2]))
        least = {c: min(d[0] for d in docs if size_class(d) == c) for c in set(map(size_class, docs))}
        total, owed, taken, rest = sum(d[0] for d in docs), 0.0, 0, []
        for k, d in enumerate(docs):
            if d[0] and least[size_class(d)] >= large * aim[s]:
                owed += aim[s] / total * d[0]
                copies = min(most, max(0, round(owed / d[0])))
                owed, taken = owed - copies * d[0], taken + copies * d[0]
                out.append((d[2], copies))
            else:
                rest.append((k, d))
        left = sum(d[0] for _, d in rest)
        rate = max(0.0, min(most, (aim[s] - taken) / left)) if left else 0.0
        out += [(d[2], math.floor((k + 1) * rate + d[3]) - math.floor(k * rate + d[3])) for k, d in rest]
    return sorted(out, key=repr)


def test_mixing_meets_targets(spark, messy, empty):
    rng = np.random.default_rng(8)
    docs = documents(spark, [(i, "w " * int(rng.integers(0, 300)), [None, "b", "a", "ä", "z"][min(4, int(rng.integers(0, 9)))]) for i in range(3000)])
    few = documents(spark, [(i, "w " * n, "a") for i, n in enumerate([5000, 3000, 900, 700, 60, 55, 50, 45, 30, 20, 10, 5, 0, 1, 1])] + [(100, "w " * 9000, "b"), (101, "w", "b")])
    for table in (docs, messy, few):
        out = mixing.mix_sources(table).collect()
        sizes, taken, longest = Counter(), Counter(), Counter()
        for r in out:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["copies"]
            longest[r["source"]] = max(longest[r["source"]], r["size"])
            assert 0 <= r["copies"] <= 2 and r["size"] == len(words(r["text"]))
        aim = targets_by_hand(sizes)
        for r in out:
            assert math.isclose(r["target"], aim[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert all(abs(taken[s] - t) <= max(0.01 * t, longest[s] / 2) for s, t in aim.items())
        assert sorted(((r["doc_id"], r["copies"]) for r in out), key=repr) == copies_by_hand(table)
    out = mixing.mix_sources(docs.repartition(5))
    assert rows(out, "doc_id", "copies") == rows(mixing.mix_sources(docs), "doc_id", "copies")
    assert mixing.mixed(docs).count() == out.agg(F.sum("copies")).first()[0]
    clashing = mixing.mixed(messy.withColumn("source_size", F.lit("mine")))
    assert {tuple(r) for r in clashing.select("size", "source_size", "target", "copies").collect()} == {("clash", "mine", "clash", "clash")}
    assert mixing.mix_sources(empty).count() == 0


# PII

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_hand(text):
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(a) <= 255 for a in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_rules_find_what_the_plain_forms_find(spark, messy, empty):
    odd = [(100, "a@b.c_x@d.e.f"), (101, "1.2.3.4.5.6.7.8 0001.2.3.4 999.1.1.1 1.2.3"), (102, "4111 1111 1111 1111 5 4111111111111111 5500-0000-0000-0004"), (103, "+1 (234) 567-8901 +12 ++123456789 +1234567890123456"), (104, "é" * 5 + "x@y.zz😀 a@b.c@d.e"), (105, "1" * 3000 + " " + "1 " * 3000), (106, "a" * 9000 + "@" + "b." * 3000), (107, "1- 2 3--4 5")]
    model = pii.SpanModel([], {})
    for table in (documents(spark, odd), messy):
        for r in pii.find_pii(table, model).collect():
            assert [tuple(s) for s in r["base"]] == spans_by_hand(r["text"]) and r["added"] == []
    assert pii.find_pii(empty).count() == 0


def added_by_hand(text, model):
    """The spans that the trees add, candidate by candidate."""
    base, out = spans_by_hand(text), []
    shape = {
        "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}", lambda v: len(re.findall("[0-9]", v)) > 1 and re.search("[A-Za-z]", v)),
        "number": (r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().-]{6,40}[0-9]", lambda v: True),
        "address": (r"(?<!\S)[^\s@]+@\S+", lambda v: True),
    }
    for kind, (pattern, fits) in shape.items():
        for m in re.finditer(pattern, text):
            v, before, after = m[0], text[max(0, m.start() - 32) : m.start()], text[m.end() :]
            n = lambda cs: len(re.findall(f"[{cs}]", v))
            if not fits(v) or any(a < m.end() and m.start() < b for _, a, b in base + out):
                continue
            runs = re.findall("[0-9]+", v)
            x = [len(v), n("0-9"), n("A-Z"), n("a-z"), n("0-9a-fA-F"), n(" "), n("."), n("-"), n("@"), n("()"), v.startswith("+"), len(runs), max(map(len, runs), default=0), len(set(v)), before[-1:] in list("\"'`"), bool(re.search("[:=][ \"'`]{0,3}$", before)), bool(re.search(r"[\w/.-]$", before)), after[:1] in list("\"'`,;)"), bool(re.search(r"^[\w/%-]", after)), kind == "secret"]
            walk = lambda t: t if not isinstance(t, tuple) else walk(t[2] if x[t[0]] <= t[1] else t[3])
            if 1 / (1 + math.exp(-2 * sum(w * walk(t) for w, t in model.trees))) >= model.thresholds.get(kind, 2):
                out.append((kind, m.start(), m.end()))
    return out


def test_the_model_adds_what_looks_like_named_data(spark):
    rng = np.random.default_rng(6)
    number = lambda *parts: "-".join(str(rng.integers(10 ** (p - 1), 10**p)) for p in parts)
    docs = []
    for i in range(600):
        kind = i % 6
        odd = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ok', f"Tel: {number(3, 3, 4)} is mine", f"mail a{i}@b.example.com or call (415) 555-{i:04d}.", f"on 20{i % 90 + 10}-01-{i % 28 + 1:02d} we moved, ssn {number(3, 2, 4)}", f"file_name_of_report_{i:02d} in commit {hashlib.sha1(str(-i).encode()).hexdigest()} of version {i}.0.{i % 7}.12 and {i}00 000 000 bytes", f"on {i % 28 + 1:02d}.0{i % 9 + 1}.2019 there were {number(4)} 555 kg"][kind]
        docs.append((i, f"plain words of text number{i} and {odd}"))
    # the same forms, without any name
    docs += [(1000, "write to 212-555-0182 soon"), (1001, "reach (312) 555-0199"), (1002, "it is 536-22-8811, they say"), (1003, "met on 2021-03-04 and 05.06.2020"), (1004, "a_file_of_words_with_99_parts")]
    table = documents(spark, docs)
    model = pii.fit_spans(table)
    out = {r["doc_id"]: r for r in pii.find_pii(table, model).collect()}
    for i, r in out.items():
        assert [tuple(s) for s in r["added"]] == added_by_hand(r["text"], model), i
    assert all(any(s["kind"] == "secret" for s in out[i]["added"]) for i in range(0, 600, 6))
    assert sum(any(s["kind"] == "number" for s in out[i]["added"]) for i in range(1, 600, 6)) > 95
    assert all(out[i]["added"] for i in (1000, 1001, 1002)) and not any(out[i]["added"] for i in (1003, 1004)) and not any(out[i]["added"] for i in range(5, 600, 6))
    assert sum(any(s["kind"] == "secret" for s in out[i]["added"]) for i in range(4, 600, 6)) < 5
    names = list(pii.FEATURES)
    used = lambda t: {names[t[0]]} | used(t[2]) | used(t[3]) if isinstance(t, tuple) else set()
    assert set().union(*[used(t) for _, t in model.trees]) & {"quoted", "given", "joined", "closed", "followed"}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table, model).collect()}
    assert "[secret]" in clean[0] and "@" not in clean[2] and "[email]" in clean[2] and "plain words of text number2" in clean[2] and clean[1000] == "write to [number] soon"


def test_redaction_keeps_other_columns(messy):
    out = pii.redact(messy, pii.SpanModel([], {}))
    assert out.columns == messy.columns and {tuple(r) for r in out.select("base", "added", "score").collect()} == {("clash",) * 3}


# substrings


def kept_by_hand(docs, n):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            i_ = math.inf if i is None else i
            first[key] = min(first.get(key, math.inf), i_)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (math.inf if i is None else i):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,block,group", [(13, 8_000_000, 4_000_000), (5, 700, 40)])
def test_substrings_against_brute_force(spark, messy, empty, n, block, group):
    out = substring_dedup.substring_dedup(messy, n, block, group)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept") == kept_by_hand([r[:2] for r in ROWS], n)
    assert substring_dedup.substring_dedup(empty, n).count() == 0


def test_prefixes_fill_groups():
    counts = np.zeros(256 * 256, np.int64)
    counts[[3, 4, 260, 70_0, 65_535]] = [50, 60, 500, 30, 20]
    first, split, n = substring_dedup.plan_groups(counts, 100)
    assert split[260] == 5 and n > 5 and first[65_535] == n - 1
    assert BASE


def test_labels_of_one_class_add_nothing(spark):
    docs = documents(spark, [(i, f'words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and a{i}@b.example.com') for i in range(40)])
    model = pii.fit_spans(docs)
    assert model.trees == [] and model.thresholds == {}
    assert {(len(r["base"]), len(r["added"])) for r in pii.find_pii(docs).collect()} == {(1, 0)}


def test_wrong_check_digits_and_bytes_teach_what_is_not_personal(spark):
    rng = np.random.default_rng(8)
    docs = []
    for i in range(240):
        wrong = str(4000000000000000 + int(rng.integers(10**14)))
        wrong = wrong if not spans_by_hand(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
        odd = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"', f"+1 (415) 555-{i:04d}", f"number {wrong} and", f"host {300 + i}.1.2.{i % 250} or"][i % 4]
        docs.append((i, f"plain words {odd} more words"))
    table = documents(spark, docs)
    model = pii.fit_spans(table)
    assert model.trees and "secret" in model.thresholds
    for r in pii.find_pii(table, model).collect():
        assert [tuple(s) for s in r["added"]] == added_by_hand(r["text"], model)
        assert [s["kind"] for s in r["added"]] == ["secret"] * (r["doc_id"] % 4 == 0)


def test_trees_are_fitted_on_the_spans_of_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "materialized", lambda df: (seen.append(df.agg(F.sum("n")).first()[0]), df)[1])
    line = F.concat(F.lit("call 555-"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit("-4567\nfrom 2020-01-02 on\n"))
    pii.fit_spans(spark.range(2100).select(F.col("id").alias("doc_id"), F.repeat(line, 5).alias("text")), rounds=1, depth=1)
    assert seen == [21_000]
