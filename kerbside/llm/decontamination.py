"""Operator 9: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.words import _MIX, PART, Table, blocks, mix, word_hashes
from kerbside.plans.scratch import Scratch

_U = np.uint64
#: Characters of benchmark items that one pass over the documents holds; a larger benchmark takes more passes.
BLOCK_CHARS = 8_000_000
#: Longest seed, in words, and the times that a seed may be met by chance for each word of the corpus: a rate, so that
#: seeds are alike at every size of the corpus.
LONGEST, CHANCE = 8, 3e-7
#: Alignment scores: an equal word, another word, a word left out or put in.
MATCH, MISS, GAP = 2, -1, -1
#: Cells of a row of the alignments that are made at once, and words of a piece of a long window, at least.
CELLS, PIECE = 1 << 20, 4096


def item_words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, off, data in blocks(pa.array(texts, pa.string())):
        h, _, _, cut = word_hashes(off, data, PART)
        out += [h[a:b] for a, b in zip(cut, cut[1:])]
    return out


def _ngram(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    s = np.full(len(at), n, np.uint64)
    for k in range(n):
        s += h[at + k] * _MIX[k]
    return mix(s)


def rare_seeds(items: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int) -> dict:
    """From each word of each item, the shortest run of 2 to LONGEST words that is met by chance at most CHANCE times a word.

    Chance is judged by single words: a passage that is copied often makes its runs frequent, not its words. Runs that
    stay likely up to LONGEST words are seeds of LONGEST words. An item of one word is a seed if the corpus has it
    at most CHANCE times a word, or once; else it is not searched, as it would name every text with a common word.
    """
    hashes, item, offset, lengths = [], [], [], set()
    log_p = np.log(np.maximum(counts, 0.5) / max(total, 1))
    for i, w in enumerate(items):
        p = log_p[np.searchsorted(vocabulary, w)]
        if len(w) == 1 and p[0] > max(np.log(CHANCE), -np.log(max(total, 1))):
            continue
        for at in range(len(w)):
            room = min(LONGEST, len(w) - at)
            if room < min(2, len(w)):
                continue
            e = np.cumsum(p[at : at + room])
            fit = np.flatnonzero(e[1:] <= np.log(CHANCE))
            n = int(fit[0]) + 2 if len(fit) else room
            if not len(fit) and n < LONGEST and len(w) > n:
                continue  # the end of an item: a longer run from the left covers it
            hashes.append(_ngram(w, np.array([at]), n)[0])
            item.append(i)
            offset.append(at)
            lengths.add(n)
    h = np.array(hashes, np.uint64)
    k = np.argsort(h, kind="stable")
    return {"h": h[k], "item": np.array(item, np.int64)[k], "offset": np.array(offset, np.int64)[k], "lengths": sorted(lengths)}


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman over words, many pairs at once: best local score, and the first and last place in the window (end exclusive); the first end, then the latest start, where several score alike.

    An alignment of m words spans less than 3 * m words of the window, as each gap costs what half a match brings. So
    long windows are cut into pieces that overlap by that, and memory is bounded by CELLS and the longest item.
    """
    pieces = []
    for k, (a, b) in enumerate(zip(items, windows)):
        step = max(PIECE, 8 * len(a))
        pieces += [(k, at, min(len(b), at + step + 3 * len(a))) for at in range(0, max(1, len(b) - 3 * len(a)), step)]
    pieces.sort(key=lambda p: (p[2] - p[1], len(items[p[0]])))
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(items)
    first = 0
    while first < len(pieces):
        last = first + 1
        while last < len(pieces) and (last - first + 1) * (pieces[last][2] - pieces[last][1] + 1) <= CELLS:
            last += 1
        for (k, at, _), (score, x, y) in zip(pieces[first:last], _align([items[k] for k, _, _ in pieces[first:last]], [windows[k][x:y] for k, x, y in pieces[first:last]])):
            if score > out[k][0] or (score == out[k][0] and at + y < out[k][2]):
                out[k] = (score, at + x, at + y)
        first = last
    return out


def _align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    rows, cols = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), rows), np.uint64), np.ones((len(items), cols), np.uint64)
    for r, (x, y) in enumerate(zip(items, windows)):
        a[r, : len(x)] = x | _U(2)
        b[r, : len(y)] = y | _U(2)
    # The start of an alignment travels in the low bits: among equal scores the latest start.
    bits = 32
    scale, base = 1 << bits, np.arange(cols + 1, dtype=np.int64)
    ramp = base * -GAP * scale
    h = np.broadcast_to(base, (len(items), cols + 1)).copy()
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(rows):
        new = np.broadcast_to(base, h.shape).copy()
        step = np.where(a[:, i : i + 1] == b, MATCH, MISS) * scale
        np.maximum(new[:, 1:], h[:, :-1] + step, out=new[:, 1:])
        np.maximum(new, h + GAP * scale, out=new)
        h = np.maximum(np.maximum.accumulate(new + ramp, axis=1) - ramp, base)
        j = (h >> bits).argmax(1)
        v = h[np.arange(len(items)), j]
        better = ((v >> bits) > (best >> bits)) | (((v >> bits) == (best >> bits)) & (v >> bits > 0) & (j < end))
        best[better], end[better] = v[better], j[better]
    return [(int(v >> bits), int(v & (scale - 1)), int(y)) for v, y in zip(best, end)]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4) -> DataFrame:
    """Passages of documents that hold a benchmark item, whole, in part or edited.

    docs: columns doc_id, text; benchmark: item_id, text; others are ignored. Returns one row for each row of docs and
    item whose best alignment scores least or more: doc_id, item_id, score (local Smith-Waterman score over words,
    as a share of the item's score against itself), start, end (words of the document, end exclusive).

    Words are lower-cased runs of letters and digits. The benchmark is taken in blocks of BLOCK_CHARS characters, each
    joined to all documents where they lie: one pass counts the items' words over all documents, from which seeds
    are chosen (rare_seeds); the next finds the seeds, lays a window around those near one diagonal, and aligns the
    item to it. No document is moved, and hits of a document stay in its task.

    Null or empty texts and items without words match nothing, nor do items of one common word (rare_seeds). Equal items each match; repeated rows each match. A
    null doc_id or item_id is returned as such. Empty documents or benchmark: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = 1 + int(chars // BLOCK_CHARS)
    schema = "doc_id long, item_id long, score double, start long, end long"
    out = None
    for k in range(n_blocks):
        block = b.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        names, items = [r.item_id for r in block], item_words([r.text for r in block])
        words = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        if not len(words):
            continue
        counted = d.select("text").mapInArrow(_count(spark.sparkContext.broadcast(words)), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
        counts, total = np.zeros(len(words)), 0
        for r in counted:
            if r.place < 0:
                total = r.n
            else:
                counts[r.place] = r.n
        seeds = rare_seeds(items, words, counts, total)
        found = scratch.write(d.mapInArrow(_search(spark.sparkContext.broadcast((names, items, words, seeds)), least), schema), "contaminated")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def _count(shared):
    def run(batches):
        table = Table(shared.value)
        counts, total = np.zeros(len(table.keys), np.int64), 0
        for b in batches:
            for _, off, data in blocks(b.column(0)):
                h, _, _, _ = word_hashes(off, data, PART)
                total += len(h)
                k = table.find(h[table.maybe(h)])
                counts += np.bincount(k[k >= 0], minlength=len(counts))
        k = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([-1, *k], pa.int32()), pa.array([total, *counts[k]], pa.int64())], names=["place", "n"])

    return run


def _search(shared, least: float):
    def run(batches):
        names, items, words, seeds = shared.value
        vocabulary, table = Table(words), Table(seeds["h"])
        first = np.searchsorted(seeds["h"], table.keys)
        last = np.searchsorted(seeds["h"], table.keys, "right")
        sizes = np.array([len(w) for w in items], np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = []
            for at, off, data in blocks(batch.column(1)):
                h, _, _, cut = word_hashes(off, data, PART)
                if not len(h):
                    continue
                row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
                known = vocabulary.maybe(h)
                place, key = [], []
                run_of = known.copy()
                for n in range(1, LONGEST + 1):
                    if n > 1:
                        if n > len(h):
                            break
                        run_of = run_of[: len(h) - n + 1] & known[n - 1 :] & (row[: len(h) - n + 1] == row[n - 1 :])
                    if n in seeds["lengths"]:
                        p = np.flatnonzero(run_of)
                        s = _ngram(h, p, n)
                        k = table.maybe(s)
                        p, s = p[k], table.find(s[k])
                        place.append(p[s >= 0])
                        key.append(s[s >= 0])
                if not place:  # fewer words than the shortest seed
                    continue
                place, key = np.concatenate(place), np.concatenate(key)
                if not len(place):
                    continue
                times = last[key] - first[key]
                which = np.repeat(first[key] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                place = np.repeat(place, times)
                item, shift = seeds["item"][which], place - seeds["offset"][which]
                doc = row[place]
                k = np.lexsort((shift, item, doc))
                doc, item, shift = doc[k], item[k], shift[k]
                pad = np.maximum(4, sizes[item] // 4)
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > pad[1:])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(doc)) - 1
                lo = np.maximum(cut[doc[head]], shift[head] - pad[head])
                hi = np.minimum(cut[doc[head] + 1], shift[tail] + sizes[item[head]] + pad[head])
                for s in range(0, len(head), 4096):
                    e = slice(s, s + 4096)
                    scores = align([items[i] for i in item[head][e]], [h[x:y] for x, y in zip(lo[e], hi[e])])
                    for (score, x, y), i, r, a in zip(scores, item[head][e], doc[head][e], lo[e]):
                        share = score / (MATCH * sizes[i])
                        if share >= least:
                            found.append((at + int(r), int(i), share, int(a + x - cut[r]), int(a + y - cut[r])))
            best: dict = {}
            for r, i, share, x, y in found:
                if (r, i) not in best or (share, -x) > (best[r, i][0], -best[r, i][1]):
                    best[r, i] = (share, x, y)
            if best:
                cols = [[ids[r] for r, _ in best], [names[i] for _, i in best], *zip(*best.values())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "start", "end"])

    return run
