"""Operator 4: toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.labelled import remainder, sample
from kerbside.llm.words import PART, Table, blocks, word_hashes
from kerbside.plans.scratch import Scratch

#: Labelled rows that the model is fitted to at most. The model has a row for each of their tokens, so the bound on
#: rows and on characters (labelled.LIMIT_CHARS) bounds it and what is broadcast.
LIMIT = 24_000
#: Rows that the Dirichlet prior of a token weighs, split between the labels as all tokens are, and standard errors by
#: which log-odds may be drawn to 0; those by which left-out rows are told apart best are taken.
PRIOR, ERRORS = 1.0, (1.0, 2.0, 3.0, 4.0, 5.0)
#: What each token costs a segment beside its log-odds: passages end where words that are neither one begin.
COST = 0.25
#: Passages by chance in a document of its length that a significant one may have.
CHANCE = 0.05
PASSAGES = "array<struct<start:long,end:long,score:double>>"


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa 1999) of a sequence of scores: (score, first, end), end exclusive.

    Neighbours of one sign are taken together first, which leaves the segments the same. Linear in the sequence.
    """
    sign = score > 0
    cut = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1, [len(score)]]) if len(score) else np.zeros(1, np.int64)
    out: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, the nearest before with a smaller sum before
    total = 0.0
    for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), np.add.reduceat(score, cut[:-1]).tolist() if len(score) else ()):
        before, total = total, total + s
        if s <= 0:
            continue
        left, right, first = before, total, a
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= right:
                out.append((left, right, first, b, j))
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
    return [(r - x, f, e) for x, r, f, e, _ in out]


def best_scores(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Score of the best segment of each row, 0 if none is positive. cut: the place of each row's first token, one more at the end."""
    rows = len(cut) - 1
    n = np.diff(cut)
    out = np.zeros(rows)
    if not len(score):
        return out
    # Sums before and after each token; a step down between rows keeps minima from reaching over.
    step = np.abs(score).sum() + 1.0
    row = np.repeat(np.arange(rows), n)
    after = np.cumsum(score) - row * step
    before = np.minimum.accumulate(after - score)
    gain = after - before
    full = n > 0
    out[full] = np.maximum(np.maximum.reduceat(gain, cut[:-1][full]), 0.0)
    return out


def _tokens(column: pa.Array):
    """(first row, hashes, cut) of runs of rows: tokens are lower-cased runs of letters and digits."""
    for at, off, data in blocks(column):
        h, _, _, cut = word_hashes(off, data, PART)
        yield at, h, cut


def token_counts(rows: DataFrame) -> DataFrame:
    """rows: text, label -> token (hash), y1, y0: rows of either label that have it; t0: occurrences in rows of label 0.

    A token counts once a row: that a text repeats a word of its own tells nothing of other texts.
    """

    def run(batches):
        for b in batches:
            label = b.column(1).to_numpy()
            for at, h, cut in _tokens(b.column(0)):
                if not len(h):
                    continue
                words, inverse = np.unique(h, return_inverse=True)
                row = np.repeat(np.arange(at, at + len(cut) - 1), np.diff(cut))
                once = np.unique(row * len(words) + inverse)
                toxic = label[once // len(words)] == 1
                y = [np.bincount((once % len(words))[k], minlength=len(words)) for k in (toxic, ~toxic)]
                t0 = np.bincount(inverse[label[row] == 0], minlength=len(words))
                yield pa.record_batch([pa.array(x) for x in (words.view(np.int64), *y, t0)], names=["token", "y1", "y0", "t0"])

    sums = (F.sum(c).alias(c) for c in ("y1", "y0", "t0"))
    return rows.select("text", "label").mapInArrow(run, "token long, y1 long, y0 long, t0 long").groupBy("token").agg(*sums)


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, errors: float) -> np.ndarray:
    """Log-odds of tokens between the labels under a Dirichlet prior (Monroe et al. 2008): PRIOR more of each token, split as all tokens are. n1 and n0 are the sums of y1 and y0.

    Drawn to 0 by so many standard errors (those of the same paper), so that what few rows say counts little.
    """
    share = n1 / (n1 + n0)
    x1, x0 = y1 + PRIOR * share, y0 + PRIOR * (1 - share)
    odds = np.log(x1 / n1) - np.log(x0 / n0)
    return np.sign(odds) * np.maximum(np.abs(odds) - errors * np.sqrt(1 / x1 + 1 / x0), 0.0)


def karlin_lambda(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda for which exp(lambda * score) has mean 1 over tokens of these weights (Karlin and Altschul 1990)."""
    p = weight / weight.sum()
    lo, hi = 1e-3, 1.0
    mean = lambda x: float((p * np.exp(np.minimum(x * score, 700.0))).sum())
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def summary(tokens: np.ndarray, best: np.ndarray, excess: np.ndarray, lam: float, log_k: float) -> np.ndarray:
    """What a document's probability is of: evidence of its best segment (-log of the expected number by chance), evidence of all significant ones, and length."""
    n = np.maximum(tokens, 1)
    e = lam * best - log_k - np.log(n)
    return np.stack([np.ones(len(n)), np.log1p(np.maximum(e, 0)), np.log1p(np.maximum(-e, 0)), np.log1p(excess), np.log(n)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - q) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """Counts of tokens, their log-odds, and what calibrates segments."""

    def __init__(self, token: np.ndarray, y1: np.ndarray, y0: np.ndarray, t0: np.ndarray, errors: float):
        k = np.argsort(token.view(np.uint64))
        self.token, self.y1, self.y0 = token.view(np.uint64)[k], y1[k].astype(np.float64), y0[k].astype(np.float64)
        self.n1, self.n0, self.errors = float(self.y1.sum()), float(self.y0.sum()), errors
        self.score = log_odds(self.y1, self.y0, self.n1, self.n0, errors) - COST
        self.lam = karlin_lambda(self.score, t0[k])
        self.log_k, self.beta, self.loss = 0.0, np.zeros(5), np.inf

    def without(self, x: np.ndarray, toxic: bool) -> np.ndarray:
        """Scores of tokens, given by their places, by the counts of other rows than that of which they are all."""
        words, inverse = np.unique(x, return_inverse=True)
        y1, y0 = self.y1[words] - toxic, self.y0[words] - (not toxic)
        s = log_odds(y1, y0, max(self.n1 - len(words) * toxic, 1.0), max(self.n0 - len(words) * (not toxic), 1.0), self.errors)
        return s[inverse] - COST

    def excess(self, found: list, tokens: int) -> tuple[list, float]:
        """Significant ones of the segments, and their evidence together."""
        least = self.log_k + np.log(max(tokens, 1)) - np.log(CHANCE)
        good = [f for f in found if self.lam * f[0] >= least]
        return good, sum(self.lam * f[0] - least for f in good)

    def calibrate(self, label: np.ndarray, tokens: np.ndarray, scores: list) -> None:
        """K, the regression and its loss, from the scores of the segments of left-out rows."""
        best = np.array([max(x, default=0.0) for x in scores])
        chance = (self.lam * best - np.log(np.maximum(tokens, 1)))[(label == 0) & (tokens > 0)]
        self.log_k = float(chance.mean() - np.euler_gamma) if len(chance) else 0.0
        excess = np.array([self.excess([(s,) for s in x], n)[1] for x, n in zip(scores, tokens)])
        x = summary(tokens, best, excess, self.lam, self.log_k)
        self.beta = logistic(x, label)
        self.loss = float(np.logaddexp(0, np.where(label == 1, -1, 1) * (x @ self.beta)).sum())


def _lookup(table: Table, h: np.ndarray) -> np.ndarray:
    """Place of each token in the model, -1 if it isn't there."""
    out = np.full(len(h), -1, np.int64)
    k = np.flatnonzero(table.maybe(h))
    out[k] = table.find(h[k])
    return out


def _left_out(shared):
    """doc_id, label, errors, tokens, scores of the positive segments of labelled rows, each scored by the counts of the others."""

    def run(batches):
        models = shared.value
        table = Table(models[0].token)
        for b in batches:
            ids, label = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, h, cut in _tokens(b.column(1)):
                f = _lookup(table, h)
                rows = [(ids[at + i], label[at + i], m.errors, int(e - a), [s for s, _, _ in segments(m.without(f[a:e], label[at + i] == 1))]) for i, (a, e) in enumerate(zip(cut, cut[1:])) for m in models]
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "label", "errors", "tokens", "scores"])

    return run


def fit_model(rows: DataFrame) -> Model | None:
    """The model of labelled rows (doc_id, text, label); None unless there are rows of both labels with tokens.

    Tokens are counted where the texts lie. For lambda, the background is the tokens of label 0. K is read off the best
    segments of rows of label 0, whose excess has mean Euler's constant, and the probability is a logistic regression;
    both see each labelled row scored by the counts of the other rows, and so does the choice of ERRORS.
    """
    spark = rows.sparkSession
    counts = token_counts(rows).toArrow()  # bounded by the sample, as is what follows
    token, y1, y0, t0 = (counts.column(c).to_numpy() for c in ("token", "y1", "y0", "t0"))
    if not y1.sum() or not y0.sum():
        return None
    models = [Model(token, y1, y0, t0, p) for p in ERRORS]
    got = rows.select("doc_id", "text", "label").mapInArrow(_left_out(spark.sparkContext.broadcast(models)), "doc_id long, label int, errors double, tokens long, scores array<double>").toArrow().sort_by("doc_id")
    errors, label, tokens, scores = got.column("errors").to_numpy(), got.column("label").to_numpy(), got.column("tokens").to_numpy(), got.column("scores").to_pylist()
    for m in models:
        k = np.flatnonzero(errors == m.errors)
        m.calibrate(label[k], tokens[k], [scores[i] for i in k])
    return min(models, key=lambda m: m.loss)


def toxic_passages(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, at: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """Probability that a document is toxic, with its significant passages.

    docs: columns doc_id, text; labels: doc_id, toxic; others are ignored. Returns, for each row of docs, doc_id,
    held_out (crc32 of doc_id as text is held_out modulo mod: never learnt from), score, predicted (1 from at on),
    passages: (start, end, score) of the maximal segments of token log-odds with an expected number by chance of
    CHANCE or less, in tokens (lower-cased runs of letters and digits), end exclusive.

    Each token scores its log-odds, positive or negative, less COST; tokens that no labelled row has have none. One pass over sums gives
    the best segment of every document; all segments are sought where the best is significant, as others have no
    passages. Both are linear in the tokens of the whole text.

    Null or empty text: no passages, scored as such. No rows of both labels to learn from: 0 for all. Empty
    documents: no rows.
    """
    spark = docs.sparkSession
    rows = sample(docs, labels, "toxic", remainder(mod) != held_out, limit, Scratch(spark))
    shared = spark.sparkContext.broadcast(fit_model(rows))

    def run(batches):
        m = shared.value
        table = Table(m.token) if m else None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            p, passages = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for at_row, h, cut in _tokens(b.column(1)) if m else ():
                f = _lookup(table, h)
                score = np.where(f >= 0, m.score[f], -COST)
                tokens, best, excess = np.diff(cut), best_scores(score, cut), np.zeros(len(cut) - 1)
                least = m.log_k + np.log(np.maximum(tokens, 1)) - np.log(CHANCE)
                for i in np.flatnonzero(m.lam * best >= least - 1e-6):
                    good, excess[i] = m.excess(segments(score[cut[i] : cut[i + 1]]), int(tokens[i]))
                    passages[at_row + i] = [{"start": x, "end": y, "score": z} for z, x, y in good]
                p[at_row : at_row + len(tokens)] = 1 / (1 + np.exp(-np.clip(summary(tokens, best, excess, m.lam, m.log_k) @ m.beta, -500, 500)))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(p), pa.array((p >= at).astype(np.int32)), pa.array(passages, kind)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(mod) == held_out).alias("held_out"))
    return d.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, passages {PASSAGES}")
