"""Operator 5: secret scan by patterns and a battery of randomness tests."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.spans import SPANS, Cover, count, digest, joined
from kerbside.plans.scratch import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: Alphabets by which strings are encoded, smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Lengths from which a stratum of the false-discovery control begins, and p-values are counted in so many bins.
STRATA, BINS = (20, 28, 36, 52, 84), 200
#: Runs of all strata that weigh with those of a stratum in its estimate.
POOLED = 50.0
#: Bins between the places at which the density of random runs is tried.
STEP = 5
#: Random strings that calibrate the battery for each alphabet and length, and the length from which they serve all
#: longer strings: the distribution of the combined statistic no longer changes then.
SIMULATED, LONGEST = 4000, 256
#: Characters that a run must have without padding.
SHORTEST = 16


def _kinds(letters: str) -> np.ndarray:
    return np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in letters])


_TABLES = [(frozenset(letters), {c: i for i, c in enumerate(letters)}, _kinds(letters)) for _, letters in ALPHABETS]


def battery(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Combined statistic of strings of one length, a row of places in the alphabet each; large is unlike even draws.

    Chi-squared of the counts, the number of changes between digits, small letters, capitals and marks, and the
    correlation of neighbours' places, each on a normal scale; the sum of the squares of the first's excess and of
    the other two.
    """
    m, n = x.shape
    k = len(kinds)
    counts = np.zeros((m, k))
    np.add.at(counts, (np.repeat(np.arange(m), n), x.ravel()), 1)
    chi = (counts**2).sum(1) * k / n - n
    a = np.maximum((chi - (k - 1)) / np.sqrt(2 * (k - 1) * (1 - 1 / n)), 0.0)
    same = (np.bincount(kinds) / k) @ (np.bincount(kinds) / k)
    kind = kinds[x]
    change = (kind[:, 1:] != kind[:, :-1]).sum(1)
    b = (change - (n - 1) * (1 - same)) / np.sqrt((n - 1) * same * (1 - same)) if 0 < same < 1 else np.zeros(m)
    off = x - x.mean(1, keepdims=True)
    var = (off**2).sum(1)
    c = np.where(var > 0, (off[:, 1:] * off[:, :-1]).sum(1) / np.where(var > 0, var, 1), 1.0) * np.sqrt(n - 1)
    return a**2 + b**2 + c**2


_simulated: dict[tuple[int, int], np.ndarray] = {}


def calibration(alphabet: int, n: int) -> np.ndarray:
    """Sorted statistics of SIMULATED even draws of length n; the same in every task."""
    if (alphabet, n) not in _simulated:
        kinds = _TABLES[alphabet][2]
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(f"{alphabet}:{n}".encode())))
        _simulated[alphabet, n] = np.sort(battery(rng.integers(0, len(kinds), (SIMULATED, n)), kinds))
    return _simulated[alphabet, n]


def randomness(run: str) -> float:
    """p-value of the hypothesis that the characters are drawn evenly from the smallest alphabet that holds them all; 0 if none does or fewer than SHORTEST are left without padding.

    The share of simulated strings of that alphabet and length whose combined statistic is at least as large, so
    that tests of one string needn't be independent and small expected counts don't matter.
    """
    body = run.rstrip("=")
    held = set(body)
    if len(body) < SHORTEST:
        return 0.0
    for k, (letters, place, kinds) in enumerate(_TABLES):
        if held <= letters:
            x = np.array([[place[c] for c in body]])
            null = calibration(k, min(len(body), LONGEST))
            return float((1 + len(null) - np.searchsorted(null, battery(x, kinds)[0], "left")) / (1 + len(null)))
    return 0.0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the patterns, and the long runs that may be random."""
    spans, runs = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    for m in LONG.finditer(text):
        a, b = m.span()
        spans += [(1, x.start(), x.end()) for x in ACCESS.finditer(text, a, b)]
        spans += [(2, x.start(), x.end()) for x in HEX.finditer(text, a, b)]
        runs.append((a, b))
    return spans, runs


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Secrets of each document.

    docs: columns doc_id, text; others are ignored. Returns, for each row, doc_id, base, spans and backed: the first
    two arrays of (kind, start, end), kind a place in KINDS, in code points, end exclusive. base has the matches of the
    patterns, per kind leftmost and without overlap; spans has these and the random runs that overlap none of them;
    backed counts the random runs that do overlap one.

    Each run of 20 or more letters, digits and marks gets a p-value (randomness). Per stratum of length, truly random
    runs have even p-values: their number is read off where p-values lie evenly (thresholds), and runs count as random from the
    lowest p-value on at which no more than rate of those above it are estimated to be something else. p-values are
    counted in BINS bins over all documents; the bins of all strata weigh in like POOLED runs. A run in the lowest bin,
    with a p-value under 1 / BINS, fails the battery on its own account and counts as random in no case.

    Null text: empty. Rows that repeat count each. Empty input: no rows.
    """
    scratch = Scratch(docs.sparkSession)

    def run(batches):
        for b in batches:
            base, runs = [], []
            for text in b.column(1).to_pylist():
                spans, long = base_spans(text or "")
                base.append([{"kind": k, "start": x, "end": y} for k, x, y in spans])
                cover = Cover(spans)
                runs.append([{"stratum": sum(y - x >= s for s in STRATA), "bin": min(BINS - 1, int(randomness(text[x:y]) * BINS)), "start": x, "end": y, "backs": cover.touches(x, y)} for x, y in long])
            s = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
            r = pa.struct([("stratum", pa.int32()), ("bin", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("backs", pa.bool_())])
            yield pa.record_batch([b.column(0), pa.array(base, pa.list_(s)), pa.array(runs, pa.list_(r))], names=["doc_id", "base", "runs"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = scratch.write(d.mapInArrow(run, f"doc_id long, base {SPANS}, runs array<struct<stratum:int,bin:int,start:long,end:long,backs:boolean>>"), "secrets")
    bins = d.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bin").agg(F.count("*").alias("n")).collect()  # at most 6 * BINS rows
    from_bin = thresholds([(r.stratum, r.bin, r.n) for r in bins], rate)
    limit = F.array(*(F.lit(from_bin.get(s, BINS)) for s in range(len(STRATA) + 1)))
    random = F.filter("runs", lambda r: r["bin"] >= F.get(limit, r["stratum"]))
    added = F.transform(F.filter(random, lambda r: ~r["backs"]), lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    return d.select("doc_id", "base", F.concat("base", added).alias("spans"), F.size(F.filter(random, lambda r: r["backs"])).cast("long").alias("backed"))


def thresholds(bins: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Stratum -> first bin whose runs count as random. bins: stratum, bin, runs.

    Runs that aren't random pile up in the low bins, so the mean of the bins from some place on falls as the place
    moves up, until none but random runs are left. It is read off at the first place, STEP bins apart, where it falls no
    more (the right-boundary rule of Liang and Nettleton 2012), at the middle at the latest.
    """
    by: dict[int, np.ndarray] = {}
    for s, b, n in bins:
        by.setdefault(s, np.zeros(BINS))[b] += n
    pooled = sum(by.values(), np.zeros(BINS))
    out = {}
    for s, own in by.items():
        counts = own + POOLED * pooled / pooled.sum()
        above = np.cumsum(counts[::-1])[::-1]
        means = above / np.arange(BINS, 0, -1)
        places = range(STEP, BINS // 2 + 1, STEP)
        even = next((means[x] for x in places[1:] if means[x] >= means[x - STEP]), means[places[-1]])  # random runs a bin
        other = 1 - np.minimum(1.0, even * np.arange(BINS, 0, -1) / np.maximum(above, 1e-12))
        good = np.flatnonzero((other <= rate) & (above > 0))
        out[s] = max(1, int(good[0])) if even > 0 and len(good) else BINS
    return out


def secret_report(docs: DataFrame) -> DataFrame:
    """secret_spans as counts, digest and list; n_random: runs that the battery finds random, in base spans or not."""
    d = secret_spans(docs)
    more = F.size("spans") - F.size("base")
    return d.select("doc_id", *(count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)), digest(F.col("base"), KINDS, False).alias("base_sha256"), joined(F.col("spans"), KINDS, False).alias("spans"), (F.col("backed") + more).alias("n_random"))
