"""Operator 3: quality classifier, hashed word n-grams under logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.labelled import remainder, sample
from kerbside.llm.words import _MIX, blocks, mix, word_hashes
from kerbside.plans.scratch import Scratch

_U = np.uint64
#: Weights of the model, and labelled rows that it is fitted to at most.
WIDTH, LIMIT = 1 << 18, 12_000
#: Step size, its smoothing, and the two penalties of the regularised leader.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.2, 5
#: Value of the constant feature, which learns the share of label 1.
CONSTANT = 2.0
#: Bytes by kind: small letters and all beyond ASCII, capitals, digits; the rest stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[65:91] = 1
_KIND[48:58] = 48


def features(column: pa.Array):
    """Yields (row, places, values): word 1- and 2-grams of the words and of their shapes, hashed into WIDTH places.

    A shape has one character for each run of a kind; a 2-gram of shapes also says whether its words are equal.
    The value is the root of the n-gram's share of the document's words; place 0 is a constant.
    """
    for at, off, data in blocks(column):
        h, start, _, cut = word_hashes(off, data)
        kind = _KIND[data]
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[start] = True
        edge = off[:-1][off[:-1] < len(data)]
        keep[edge] = True
        shape, _, _, _ = word_hashes(np.concatenate([[0], np.cumsum(keep)])[off], kind[keep])
        one, two = mix(h + _MIX[5]), mix(shape + _MIX[6])
        pair = mix(h[:-1] * _MIX[0] + h[1:] * _MIX[1])
        equal = (h[:-1] == h[1:]).astype(np.uint64)
        shapes = mix(shape[:-1] * _MIX[2] + shape[1:] * _MIX[3] + equal * _MIX[4])
        one, two, pair, shapes = ((x % _U(WIDTH - 1)).astype(np.int64) + 1 for x in (one, two, pair, shapes))
        for i in range(len(off) - 1):
            a, b = cut[i], cut[i + 1]
            if a == b:
                yield at + i, np.zeros(1, np.int64), np.full(1, CONSTANT)
                continue
            x, c = np.unique(np.concatenate([one[a:b], two[a:b], pair[a : b - 1], shapes[a : b - 1]]), return_counts=True)
            yield at + i, np.concatenate([[0], x]), np.concatenate([[CONSTANT], np.sqrt(c / (b - a))])


def fit_ftrl(label: np.ndarray, cut: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """FTRL-proximal (McMahan et al. 2013), one update a document, EPOCHS times over in a seeded order; returns the weights.

    Document i has label[i] and the features places and values from cut[i] to cut[i + 1].
    """
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(EPOCHS):
        for i in order.permutation(len(label)):
            x, v = places[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]
            w = _weights(z[x], n[x])
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - label[i]) * v
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - s * w
            n[x] += g * g
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fitted_weights(rows: DataFrame) -> bytes | None:
    """Weights fitted to rows (doc_id, text, label) in doc_id order; None without rows.

    Features are made where the texts lie; what one task gathers is 12 bytes for each of them, at most four a word of
    the sample, whose characters are bounded.
    """

    def sparse(batches):
        for b in batches:
            ids, label = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, x, v in features(b.column(1)):
                row = [[ids[i]], [label[i]], [x.astype(np.int32)], [v]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())))], names=["doc_id", "label", "places", "values"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        flat = lambda c: np.concatenate([np.asarray(x.flatten()) for x in t.column(c).chunks])
        n = np.concatenate([np.diff(x.offsets.to_numpy()) for x in t.column("places").chunks])
        w = fit_ftrl(t.column("label").to_numpy(), np.concatenate([[0], np.cumsum(n)]), flat("places"), flat("values"))
        return pa.table({"model": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    made = rows.select("doc_id", "text", "label").mapInArrow(sparse, "doc_id long, label int, places array<int>, values array<double>")
    got = made.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "model binary").collect()
    return bytes(got[0].model) if got else None


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, at: float = 0.7, limit: int = LIMIT) -> DataFrame:
    """Probability of label 1 for every document.

    docs: columns doc_id, text; labels: doc_id, quality; others are ignored. Returns, for each row of docs, doc_id,
    held_out (crc32 of doc_id as text is held_out modulo mod: never learnt from), score, predicted (1 from at on).

    The model is fitted to at most limit labelled rows (and labelled.LIMIT_CHARS characters) in one task and has WIDTH
    weights, whatever the corpus; scoring is a sparse dot product where the document lies.

    Null or empty text: scored by the constant alone. No labels to learn from: 0.5 for all. Empty documents: no rows.
    """
    spark = docs.sparkSession
    model = fitted_weights(sample(docs, labels, "quality", remainder(mod) != held_out, limit, Scratch(spark)))
    shared = spark.sparkContext.broadcast(model or np.zeros(WIDTH, np.float32).tobytes())

    def run(batches):
        w = np.frombuffer(shared.value, np.float32)
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, x, v in features(b.column(1)):
                s[i] = 1 / (1 + np.exp(-np.clip(w[x] @ v, -30, 30)))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s), pa.array((s >= at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(mod) == held_out).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
