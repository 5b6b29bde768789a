"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: Terms are hashed into this many buckets.
BUCKETS = 1 << 22


def terms(text: Column | str) -> Column:
    """The buckets of the distinct lower-cased runs of letters or digits, and of their first four and five characters; none for null.

    The beginnings stand for the inflected and compound forms of a word that are too rare to be learned one by one.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    longer = F.filter(words, lambda w: F.length(w) > 4)
    begins = F.array_distinct(F.concat(F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, 4))), F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, 5)))))
    return F.concat(F.transform(words, bucket), F.transform(begins, bucket))


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of their factors / number of terms), of the known terms of a text.

    The pair term learns what two terms mean together, such as an insult beside the name of a group, beyond the sum of
    what each means alone. Terms with too few learned rows have no weights.
    """

    bias: float
    buckets: np.ndarray  #: those with weights, ascending; their places are the rows of the tables
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        kept = [_places(self.buckets, r) for r in rows]
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return self.bias + _forward(self.weights, self.factors, at, np.array([len(k) for k in kept], np.int64))[0]


def _places(buckets: np.ndarray, terms_: np.ndarray) -> np.ndarray:
    """Where the terms stand among the sorted buckets; those that don't are left out."""
    if not len(buckets):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(buckets, terms_), len(buckets) - 1)
    return at[buckets[at] == terms_]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows of values that end there."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])[np.concatenate([[0], ends])]
    return np.diff(total, axis=0)


def _forward(weights, factors, at, lengths):
    """Each row's sum of weights and mean of pairs, and its sum of factors; at has the rows' places one after another."""
    ends, v = np.cumsum(lengths), factors[at]
    total = _sums(v, ends)
    return _sums(weights[at], ends) + 0.5 * ((total * total).sum(1) - _sums((v * v).sum(1), ends)) / np.maximum(lengths, 1), total


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 8, rate: float = 0.2, decay: float = 1e-3, least: int = 4, telling: float = 3.5, floor: float = 0.3, batch: int = 256, seed: int = 1) -> FactorizationMachine:
    """AdaGrad on the logistic loss with decay, for all terms in ``least`` rows or more; a row's terms are distinct.

    A term that goes with a label no more often than chance explains would fit noise: its weight counts by the eighth power
    of its deviation from chance, full from ``telling`` standard deviations on. Its factors count by ``floor`` at least,
    so pairs of terms that each mean nothing are learned. Without rows of both labels every text gets the prior's score;
    without any rows, nothing is toxic.
    """
    labels = np.asarray(labels, np.float64)
    prior = (labels.sum() + 0.1) / (len(labels) + 1)
    bias = float(np.log(prior / (1 - prior)))
    flat, lengths = np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array([len(r) for r in rows], np.int64)
    seen, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    toxic = np.bincount(where, np.repeat(labels, lengths), len(seen))
    trust = np.minimum(1, (np.abs(toxic - times * prior) / np.sqrt(times * prior * (1 - prior)) / telling) ** 8)[times >= least]
    some_trust = np.maximum(trust, floor)
    seen = seen[times >= least].astype(np.int32)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(seen)), rng.normal(0, 0.2, (len(seen), factors))
    gw, gv, gb = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2), 1e-2
    kept = [_places(seen, r).astype(np.int32) for r in rows]
    for _ in range(epochs if len(seen) and 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(kept))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            at, n = np.concatenate([kept[k] for k in some]), np.array([len(kept[k]) for k in some])
            margin, total = _forward(w * trust, v * some_trust[:, None], at, n)
            error = 1 / (1 + np.exp(-np.clip(bias + margin, -30, 30))) - labels[some]
            of_pairs = error / np.maximum(n, 1)
            met = np.bincount(at, minlength=len(w))
            used = np.flatnonzero(met)
            shrink = decay * met[used]
            dw = np.bincount(at, np.repeat(error, n), len(w))[used] * trust[used] + shrink * w[used]
            each = np.repeat(of_pairs[:, None] * total, n, axis=0)
            alone = np.bincount(at, np.repeat(of_pairs, n), len(w))[used]
            dv = np.stack([np.bincount(at, each[:, k], len(w))[used] for k in range(factors)], 1) * some_trust[used][:, None] + (shrink - alone * some_trust[used] ** 2)[:, None] * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            gb += (d := float(error.sum())) ** 2
            bias -= rate * d / np.sqrt(gb)
    return FactorizationMachine(bias, seen, w * trust, v * some_trust[:, None])


def learn_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 20_000, **options) -> FactorizationMachine:
    """Fit on labelled documents outside the held-out fold: at most ``most_rows`` of them, those with the least hash of the id.

    labels: (doc_id, toxic); an id with several labels has the largest, null labels and ids don't count. Of documents with
    one id all are learned from, in an order that their contents fix, so that a new run learns the same. One task fits the
    machine; only the machine comes to the driver.
    """
    given = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id", folds))
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id").select("doc_id", terms("text").alias("terms"), "toxic")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms")).limit(most_rows)

    def learn(batches):
        rows, toxic = [], []
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows += [np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            toxic += batch.column(1).to_pylist()
        model = fit(rows, np.array(toxic) > 0, **options)
        parts = [model.buckets.astype("<i4"), model.weights.astype("<f4"), model.factors.astype("<f4")]
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["bias", "buckets", "weights", "factors"])

    text_batches(docs.sparkSession)
    found = sample.select("terms", "toxic").mapInArrow(learn, "bias double, buckets binary, weights binary, factors binary").first()
    if found is None:
        return fit([], np.zeros(0), **options)
    buckets, weights = np.frombuffer(found["buckets"], "<i4"), np.frombuffer(found["weights"], "<f4")
    return FactorizationMachine(found["bias"], buckets, weights, np.frombuffer(found["factors"], "<f4").reshape(len(buckets), -1) if len(buckets) else np.zeros((0, 1), np.float32))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """docs with a score, 0 to 1, from the text alone; null and empty texts get the prior's, equal texts equal ones. A column of that name is replaced, others stay.

    The machine is broadcast: some 24 bytes for each term in ``least`` rows of the bounded sample it was fitted on.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margins([np.asarray(r, np.int32) for r in found]), -500, 500))))

    return docs.withColumn(name, score(terms("text")))
