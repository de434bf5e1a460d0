"""Operator 11: ranked lexical search over shards of compressed postings."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch

#: Bytes of text from which a task closes a shard, and of a text that is cut into terms at once.
SHARD_BYTES, PIECE = 24_000_000, 1 << 20
#: Characters of queries that one pass over the index holds; more queries take more passes.
BLOCK_CHARS = 2_000_000
#: Byte by byte: what is no ASCII letter or digit and no part of a longer character parts terms; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Term of the row that holds a shard's documents rather than postings.
DOCUMENTS = b""
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("cf", pa.int64()), ("postings", pa.binary())])
_COLUMNS = "shard long, term binary, df long, cf long, postings binary"


def terms(text: bytes, piece: int = PIECE):
    """Lists of the terms of a text in UTF-8, in order; long texts a piece at a time, cut between terms."""
    folded = text.translate(_FOLD)
    if len(folded) <= piece:
        yield folded.split()
        return
    at = 0
    while at < len(folded):
        end = len(folded) if at + piece >= len(folded) else folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers as bytes of seven bits, lowest first, the last one without the high bit; and where each one ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = end - size
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        low = (v[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = low.astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, end


def unpacked(data: bytes) -> np.ndarray:
    """The integers of packed."""
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.append(0, end[:-1] + 1) if len(end) else end
    size, out = end - start + 1, np.zeros(len(end), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        out[some] |= (b[start[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def _encoded(shard: int, ids: list, lengths: list[int], codes: list[np.ndarray], vocabulary: list[bytes]):
    """A shard's rows: its documents, then its terms in order, each with the places of its documents among those of the shard in order of doc_id, as gaps, and the times it occurs in each."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    n = np.array(lengths, np.int64)
    known = np.array([ids[k] for k in order if ids[k] is not None], np.int64)
    steps = known.astype(np.uint64)
    if len(known):
        steps[1:] = steps[1:] - steps[:-1]
        steps[0] = (int(known[0]) << 1) if known[0] >= 0 else (-int(known[0]) << 1) - 1
    table, _ = packed(np.concatenate([np.array([len(ids), len(known)], np.uint64), steps, n[order].astype(np.uint64)]))
    yield pa.record_batch([pa.array([v], t) for v, t in zip((shard, DOCUMENTS, int((n > 0).sum()), int(n.sum()), table.tobytes()), _SCHEMA.types)], schema=_SCHEMA)
    if not vocabulary:
        return
    by_term = np.argsort(np.array(vocabulary, object), kind="stable")
    rank = np.empty(len(vocabulary), np.int64)
    rank[by_term] = np.arange(len(vocabulary))
    key, tf = np.unique(rank[np.concatenate(codes)] * len(ids) + np.repeat(place, n), return_counts=True)
    term, at = key // len(ids), key % len(ids)
    first = np.append(True, term[1:] != term[:-1])
    gaps = at - np.where(first, -1, np.append(0, at[:-1]))
    data, end = packed(np.stack([gaps, tf], 1).ravel())
    starts = np.flatnonzero(first)
    offsets = np.append(0, end[1::2][np.append(starts[1:] - 1, len(key) - 1)])
    postings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    df = np.diff(np.append(starts, len(key)))
    cf = np.add.reduceat(tf, starts)
    whole = pa.record_batch([pa.array(np.full(len(starts), shard)), pa.array([vocabulary[k] for k in by_term], pa.binary()), pa.array(df), pa.array(cf), postings], schema=_SCHEMA)
    for at in range(0, len(starts), 10_000):
        yield whole.slice(at, 10_000)


def _documents(data: bytes) -> tuple[list, np.ndarray]:
    """doc_ids in order, null last, and numbers of terms."""
    v = unpacked(data)
    n, known = int(v[0]), int(v[1])
    steps = v[2 : 2 + known].copy()
    if known:
        z = int(steps[0])
        steps[0] = np.uint64((z >> 1 if z % 2 == 0 else -((z + 1) >> 1)) % (1 << 64))
    return np.cumsum(steps, dtype=np.uint64).astype(np.int64).tolist() + [None] * (n - known), v[2 + known :].astype(np.int64)


def _shards(limit: int):
    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        ids, lengths, codes, size = [], [], [], 0
        for b in batches:
            for k, value in zip(b.column(0).to_pylist(), b.column(1)):
                n, text = 0, value.as_py()
                for words in terms(text):
                    codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                ids.append(k)
                lengths.append(n)
                size += len(text) + 16
                if size >= limit:
                    yield from _encoded(shard, ids, lengths, codes, list(vocabulary))
                    shard, ids, lengths, codes, size = shard + 1, [], [], [], 0
                    vocabulary.clear()
        if ids:
            yield from _encoded(shard, ids, lengths, codes, list(vocabulary))

    return run


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of all documents to path and returns it: shard, term, df (documents of the shard with the term), cf (occurrences), postings.

    docs: columns doc_id, text; others are ignored. Terms are runs of ASCII letters and digits and of all characters
    beyond ASCII, only A-Z lower-cased. Null texts have no terms; such documents count nowhere, but are in their shard.

    Each task makes shards of the documents it reads, of shard_bytes of text or, past that, one document; nothing is
    shuffled. Postings are sorted by doc_id and hold gaps and counts in as few bytes as they need. A shard's rows are sorted
    by term, so that readers skip row groups without the terms they seek. A lost executor's shards are made again.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    d.mapInArrow(_shards(shard_bytes), _COLUMNS).write.parquet(path)
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COLUMNS).parquet(path)


def top(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document), best first, the smaller document before an equal score; scores above 0 alone.

    lists: weight, documents in order, impacts; a document scores the sum of weight times impact. Document at a time: a
    heap merges the lists; a heap of k holds the best so far, by score, then document. Lists whose bounds together
    can't lift a document above the k-th best aren't merged any more, but asked for the documents that others name.
    """
    lists = sorted(((w * max(impact), w, docs, impact) for w, docs, impact in lists if docs), key=lambda x: x[0])
    reach = list(accumulate(x[0] for x in lists))
    at = [0] * len(lists)
    heads = [(docs[0], i) for i, (_, _, docs, _) in enumerate(lists)]
    heapq.heapify(heads)
    best: list[tuple[int, int]] = []
    floor, first = 0, 0
    while first < len(lists) and reach[first] <= floor:
        first += 1
    heads = [h for h in heads if h[1] >= first]
    heapq.heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            _, w, docs, impact = lists[i]
            here = at[i]
            score += w * impact[here]
            at[i] = here = here + 1
            if here < len(docs):
                heapq.heapreplace(heads, (docs[here], i))
            else:
                heapq.heappop(heads)
        for i in range(first - 1, -1, -1):
            if score + reach[i] <= floor:
                break
            _, w, docs, impact = lists[i]
            at[i] = here = bisect_left(docs, doc, at[i])
            if here < len(docs) and docs[here] == doc:
                score += w * impact[here]
        if score > floor:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > floor:
                floor, old = best[0][0], first
                while first < len(lists) and reach[first] <= floor:
                    first += 1
                if first > old:
                    heads = [h for h in heads if h[1] >= first]
                    heapq.heapify(heads)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _blocks(queries: DataFrame, chars: int):
    """Lists of (item_id, Counter of terms) of at most chars characters, or one item; the driver holds one at a time."""
    held, size = [], 0
    for r in queries.toLocalIterator():
        count: Counter = Counter()
        for words in terms(r.text.encode()):
            count.update(words)
        held.append((r.item_id, count))
        size += len(r.text) + 1
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: DataFrame, queries: DataFrame, k: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The k best documents of an index for each query: item_id, rank (from 1), doc_id, score.

    queries: columns item_id, text; others are ignored. Each row is a query of its own, be its item_id null or shared. A
    term weighs w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document scores the sum of w * ((10^9 * tf) div
    (1000 * tf + 12 * m)) over the query's terms, repeats included, with m = 75 + (25 * n * N) div L; N documents with
    terms, L terms of all, n of this one. Scores of 0 aren't listed; equal scores go by doc_id, null last. Queries
    without terms and an index without any give no rows.

    Queries are taken in blocks of block_chars characters, which the driver holds and broadcasts, each with one pass over
    the index for the counts of its terms and one for the postings of these: a shard's meet in a task, which merges
    them document at a time for each query (top). Each shard names k documents a query at most, and of those the k best
    are taken, first in each task, then over all.
    """
    spark = index.sparkSession
    scratch = Scratch(spark)
    all_docs = index.where(F.col("term") == F.lit(DOCUMENTS)).agg(F.sum("df").alias("n"), F.sum("cf").alias("l")).first()
    q = queries.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(q.dtypes)["item_id"]
    out, done = None, 0
    for block in _blocks(q, block_chars) if all_docs.l else ():
        wanted = sorted(set().union(*(c for _, c in block)))
        if wanted:
            sought = spark.createDataFrame([(t,) for t in [DOCUMENTS, *wanted]], "term binary")
            rows = index.join(F.broadcast(sought), "term", "left_semi")  # a block's terms, bounded by its characters
            df = {bytes(r.term): r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
            weight = {t: math.floor(1000 * math.log((2 * all_docs.n + 2) / (2 * df[t] + 1))) for t in wanted if t in df}
            asked = [(done + i, [(t, c * weight[t]) for t, c in count.items() if weight.get(t, 0) > 0]) for i, (_, count) in enumerate(block)]
            given = spark.sparkContext.broadcast([x for x in asked if x[1]])
            found = rows.select("shard", "term", "postings").repartition("shard").sortWithinPartitions("shard").mapInArrow(_scores(given, k, all_docs.n, all_docs.l), "item int, doc_id long, score long")
            rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
            names = spark.createDataFrame([(done + i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kind}")
            found = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item")  # a block's items
            found = scratch.write(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found")
            out = found if out is None else out.union(found)
        done += len(block)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _scores(given, k: int, n_docs: int, n_terms: int):
    def of_shard(held: dict[bytes, bytes]):
        ids, lengths = _documents(held.pop(DOCUMENTS))
        if 25 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
            m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in lengths], np.int64)
        else:
            m = 75 + 25 * lengths * n_docs // n_terms
        lists = {}
        for term, data in held.items():
            v = unpacked(data).astype(np.int64)
            at, tf = np.cumsum(v[::2]) - 1, v[1::2]
            lists[term] = at.tolist(), (1_000_000_000 * tf // (1000 * tf + 12 * m[at])).tolist()
        rows = []
        for item, asked in given.value:
            rows += [(item, ids[d], s) for s, d in top([(w, *lists[t]) for t, w in asked if t in lists], k)]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["item", "doc_id", "score"])

    def run(batches):
        shard, held = None, {}
        for b in batches:
            for s, term, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s != shard:
                    if held:
                        yield of_shard(held)
                    shard, held = s, {}
                held[term] = data
        if held:
            yield of_shard(held)

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """search over an index of all docs, built in the shared folder."""
    return search(build_index(docs, Scratch(docs.sparkSession).path("index")), queries, k)
