"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between, hashed
into 2**BITS places.  Training takes at most MAX_ROWS labelled rows (those with the least hash of
doc_id; the bound is a documented parameter).  The rows are dealt to tasks of about SHARD_ROWS by a hash; each
runs FTRL-proximal with per-coordinate rates and L1 over its rows, and the shards' weights are
averaged by an aggregation and calibrated on the sample.  L1 leaves a few thousand weights: that is what is sent to the
scoring tasks.  More than MAX_WEIGHTS would mean that L1 is set too low; training then fails and says so, and drops none.
Scoring reads every whole text.

Null and empty texts have no features and get the score of the intercept.  Labels that are null,
or of unknown documents, are ignored; a document labelled twice counts once, as toxic if either says
so.  Without any label the score is 0 for all.  Repeated rows and ties score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textcodes as tc
from .steps import held_out

BITS = 26
MAX_ROWS = 20_000
MAX_WEIGHTS = 200_000
SHARD_ROWS = 2_500  #: rows that one task trains on
EPOCHS = 6
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
L1_ROW = 0.002  #: L1 for each row of a shard: a weight has to be worth as much in a small sample as in a large one
INTERCEPT = -1  #: the intercept's place


def features(words: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows), with repeats, in no order."""
    rows = np.repeat(np.arange(len(words.counts)), words.counts)
    codes, shift = words.codes, np.uint64(64 - BITS)
    places, at = [tc.mix(codes + np.uint64(1)) >> shift], [rows]
    for gap, salt in ((1, 2), (2, 3)):
        if len(codes) > gap:
            pair = tc.mix(codes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + codes[gap:] + np.uint64(salt)) >> shift
            same = rows[:-gap] == rows[gap:]
            places.append(pair[same])
            at.append(rows[:-gap][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(at)


def ftrl(docs: list[np.ndarray], labels: np.ndarray, size: int, epochs: int) -> np.ndarray:
    """FTRL-proximal weights of `size` coordinates and, last, the intercept."""
    l1 = max(0.5, L1_ROW * len(docs))
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(docs)):
            at = docs[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            wb = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(wi.sum() + wb, -30, 30)))
            g = p - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / ALPHA * wb
            n[size] += g * g
    w[:-1] = np.where(np.abs(z[:-1]) <= l1, 0.0, -(z[:-1] - np.sign(z[:-1]) * l1) / ((BETA + np.sqrt(n[:-1])) / ALPHA + L2))
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w


def _fit(batches):
    """A task's shards: rows (shard, label, text) to rows (shard, place, weight).

    Features are made slice by slice; a shard holds SHARD_ROWS rows or so."""
    shards: dict[int, list] = {}
    for batch in batches:
        for part in tc.slices(batch, "text"):
            places, rows = features(tc.Words(*tc.column_bytes(part.column("text"))))
            order = np.lexsort((places, rows))
            places, rows = places[order], rows[order]
            first = np.ones(len(places), dtype=bool)
            first[1:] = (places[1:] != places[:-1]) | (rows[1:] != rows[:-1])
            places, rows = places[first].astype(np.int32), rows[first]
            at = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for i, (shard, label) in enumerate(zip(part.column("shard").to_pylist(), part.column("label").to_pylist(), strict=True)):
                shards.setdefault(shard, []).append((label, places[at[i] : at[i + 1]]))
    for shard, docs in shards.items():
        every = np.concatenate([d for _, d in docs])
        known, count = np.unique(every, return_counts=True)
        known = known[count > 1]  # a place seen in one row of the shard can't be told from chance
        local = []
        for _, d in docs:
            at = np.minimum(np.searchsorted(known, d), max(len(known) - 1, 0))
            local.append(at[known[at] == d] if len(known) else np.zeros(0, np.int64))
        w = ftrl(local, np.array([y for y, _ in docs], dtype=float), len(known), EPOCHS)
        keep = np.flatnonzero(w[:-1])
        yield pa.record_batch(
            [pa.array(np.full(len(keep) + 1, shard, np.int32)), pa.array(np.concatenate([known[keep].astype(np.int64), [INTERCEPT]])), pa.array(np.concatenate([w[keep], w[-1:]]))],
            names=["shard", "place", "weight"],
        )


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept) learnt from rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    shards = max(1, sample.count() // SHARD_ROWS)
    rows = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").join(F.broadcast(sample), "doc_id")  # of max_rows rows at most
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(shards)).cast("int").alias("shard"), F.col("label"), "text")
    made = rows.repartition(shards, "shard").mapInArrow(_fit, "shard int, place long, weight double")
    mean = made.groupBy("place").agg((F.sum("weight") / F.lit(float(shards))).alias("weight"), F.count("*").alias("shards"))
    # a weight that one shard alone found is noise or a very rare word: half the shards have to agree
    mean = mean.filter((F.col("place") == INTERCEPT) | (F.col("shards") * 2 >= shards))
    got = mean.limit(MAX_WEIGHTS + 1).select("place", "weight").toArrow()
    if got.num_rows > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights; raise L1_ROW")
    places, weights = got.column("place").to_numpy(), got.column("weight").to_numpy()
    is_intercept = places == INTERCEPT
    if not is_intercept.any():
        return places, weights, -30.0
    order = np.argsort(places[~is_intercept])
    places, weights, intercept = places[~is_intercept][order], weights[~is_intercept][order], float(weights[is_intercept].sum())
    scored = rows.select("label", "text").mapInArrow(_score(places, weights, intercept), "label int, text string, score double").select("label", "score").toArrow()
    scale, shift = calibration(scored.column("score").to_numpy(), scored.column("label").to_numpy().astype(float))
    return places, weights * scale, intercept * scale + shift


def calibration(score: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of the log odds that fit the sample best: averaging shrinks weights that some shards lack.

    Newton steps with a little L2 towards (1, 0), which keeps them finite where the classes part."""
    odds = np.log(score / (1 - score))
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    theta, at = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - label) + 0.5 * (theta - at))
    return float(np.clip(theta[0], 0.1, 20)), float(np.clip(theta[1], -30, 30))


def _score(places: np.ndarray, weights: np.ndarray, intercept: float):
    def run(batches):
        known = np.zeros(1 << BITS - 3, dtype=np.uint8) if len(places) else None  # a bitmap of the places with weights
        if known is not None:
            np.bitwise_or.at(known, places >> 3, (1 << (places & 7)).astype(np.uint8))
        for batch in batches:
            for part in tc.slices(batch, "text"):
                total = np.full(part.num_rows, intercept)
                if known is not None:
                    at, rows = features(tc.Words(*tc.column_bytes(part.column("text"))))
                    hit = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                    pairs = np.unique(rows[hit] << BITS | at[hit])
                    found = np.searchsorted(places, pairs & ((1 << BITS) - 1))
                    np.add.at(total, pairs >> BITS, weights[found])
                score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.record_batch([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return run


def toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 if score >= 0.5); columns of these names are replaced."""
    model = train(documents, labels, max_rows)
    docs = documents.drop("score", "predicted")
    scored = docs.mapInArrow(_score(*model), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(documents.select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
