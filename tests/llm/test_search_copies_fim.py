"""Lexical search, exact copies and fill-in-middle against plain loops, and on null, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbside.llm import exact_dedup, lexical_search
from kerbside.llm.exact_dedup import content_groups, deduplicated
from kerbside.llm.fill_in_middle import fill_in_middle, fim_report, restored
from kerbside.llm.lexical_search import build_index, packed, ranked_search, search, terms, top, unpacked

SCHEMA = "doc_id long, text string, term int, digest int, edge string, units int, key int, form int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "3", 4, 5, 6) for r in rows], SCHEMA)


def folded(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, item, k):
    """All documents by the definition, best first."""
    lists = [(i, Counter(folded(t))) for i, t in docs]
    some = [(i, c, sum(c.values())) for i, c in lists if c]
    n_docs, n_terms = len(some), sum(n for _, _, n in some)
    df = Counter(t for _, c, _ in some for t in c)
    out = []
    for i, c, n in some:
        m = 75 + 25 * n * n_docs // n_terms
        s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in folded(item) if t in c)
        if s > 0:
            out.append((-s, i is None, i or 0))
    return [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(out)[:k])]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "der", "Ñandú", "été", "x1", "the", "of", "日本", "İz"]
    weights = [1, 2, 3, 4, 1, 1, 1, 30, 30, 1, 1]
    return ["".join(w + rng.choice([" ", ", ", "-", "\n", "_"]) for w in rng.choices(words, weights, k=rng.randint(1, 30))) for _ in range(n)]


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aZ9 _-\x00\x7f~@[`{é日\x85\xa0 ") for _ in range(rng.randint(0, 60)))
        for piece in (1, 7, 1 << 20):
            assert [w.decode() for ws in terms(t.encode(), piece) for w in ws] == folded(t)


def test_packed_integers_return():
    rng = np.random.default_rng(5)
    v = np.concatenate([np.array([0, 1, 127, 128, 16383, 16384, 2**63, 2**64 - 1], np.uint64), rng.integers(0, 1 << 40, 500).astype(np.uint64) >> rng.integers(0, 40, 500).astype(np.uint64)])
    data, end = packed(v)
    assert (unpacked(data.tobytes()) == v).all() and end[-1] == len(data) and len(unpacked(b"")) == 0
    assert (unpacked(data[end[2] : end[5]].tobytes()) == v[3:6]).all()


@pytest.mark.parametrize("ids", [[], [None], [5, -3, None, 2**63 - 1, -(2**63), 5, None, 0]])
def test_documents_of_a_shard_return(ids):
    batches = list(lexical_search._encoded(9, ids, list(range(len(ids))), [np.arange(n, dtype=np.int32) for n in range(len(ids))], [b"%d" % k for k in range(max(0, len(ids) - 1))]))
    got, n = lexical_search._documents(batches[0].column("postings")[0].as_py())
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    assert got == [ids[k] for k in order] and n.tolist() == order


def test_best_documents_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        lists = []
        for _ in range(rng.randint(0, 7)):
            docs = sorted(rng.sample(range(60), rng.randint(0, 40)))
            lists.append((rng.randint(1, 5), docs, [rng.randint(0, 4) for _ in docs]))
        score = Counter()
        for w, docs, impact in lists:
            for d, i in zip(docs, impact):
                score[d] += w * i
        k = rng.randint(1, 12)
        assert top(lists, k) == sorted(((s, d) for d, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def test_common_lists_are_left_out_of_the_merge(monkeypatch):
    """The lists of common words are asked for documents, not merged: the heap meets few of their entries."""
    steps = Counter()
    real = lexical_search.heapq.heapreplace

    def counted(heap, item):
        steps[item[1]] += 1
        return real(heap, item)

    monkeypatch.setattr(lexical_search, "heapq", SimpleNamespace(heapify=lexical_search.heapq.heapify, heappop=lexical_search.heapq.heappop, heappush=lexical_search.heapq.heappush, heapreplace=counted))
    common = (1, list(range(20_000)), [1] * 20_000)
    rare = (1000, list(range(0, 20_000, 500)), [1 + k for k in range(40)])
    got = top([common, rare], 10)
    assert got == [(1000 * k + 1, 500 * (k - 1)) for k in range(40, 30, -1)]
    assert steps[0] < 6_000


@pytest.mark.parametrize("shard, block", [(1 << 30, 1 << 30), (400, 1 << 30), (1, 60)])
def test_search_equals_brute_force(spark, tmp_path, shard, block):
    docs = [(i * 7 - 40, t) for i, t in enumerate(texts(1, 90))] + [(None, "beta GAMMA"), (None, "beta GAMMA"), (1000, None), (1001, ""), (1002, " -_ "), (2, "alpha beta"), (2, "alpha beta"), (3, "alpha beta"), (4, "rare " * 50_000)]
    items = [(k, t) for k, t in enumerate(texts(2, 12))] + [(1, "alpha"), (None, "beta beta alpha"), (50, None), (51, ""), (52, "nowhere"), (53, "RARE rare")]
    found = search(build_index(frame(spark, docs).repartition(3), str(tmp_path / "index"), shard), frame(spark, items).withColumnRenamed("doc_id", "item_id"), 6, block).collect()
    want = Counter((item, *r) for item, t in items for r in ranked(docs, t, 6))
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found) == want


def test_search_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "alpha"), (2, "")])
    items = some.withColumnRenamed("doc_id", "item_id")
    for docs, queries in ((none, items), (some, items.where("false")), (frame(spark, [(1, None)]), items)):
        assert ranked_search(docs, queries).collect() == []
    assert [tuple(r) for r in ranked_search(frame(spark, [(7, "alpha")]), items).collect()] == [(1, 1, 7, 287 * (10**9 // (1000 + 1200)))]


def test_index_holds_every_row(spark, tmp_path):
    docs = frame(spark, [(i, t) for i, t in enumerate(texts(4, 200))] + [(500, None)])
    index = build_index(docs.repartition(4), str(tmp_path / "index"), 2000)
    rows = index.where(F.col("term") == F.lit(b"")).collect()
    assert len(rows) > 8 and sum(r.df for r in rows) == 200
    assert sorted(i for r in rows for i in lexical_search._documents(r.postings)[0]) == [*range(200), 500]
    want = Counter(t for _, x in enumerate(texts(4, 200)) for t in folded(x))
    assert {r.term.decode(): r.n for r in index.where(F.length("term") > 0).groupBy("term").agg(F.sum("cf").alias("n")).collect()} == want


def grouped(rows, largest=True, change=lambda t: t):
    by = defaultdict(list)
    for i, t in rows:
        by[change(t or "")].append(i)
    best = max if largest else min
    keep = {t: best((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return Counter((i, keep[change(t or "")], len(by[change(t or "")]), hashlib.sha256(change(t or "").encode()).hexdigest()) for i, t in rows), keep


def copies(seed):
    rng = random.Random(seed)
    long = "same start " * 4000
    pool = ["", None, "a", "A", "a ", "é", "é", "x" * 64, "x" * 65, "x" * 64 + "é", long, long + "!", "\x00", "hot " * 30]
    rows = [(i, rng.choice(pool)) for i in range(300)] + [(1000 + i, "hot " * 30) for i in range(400)]
    return rows + [(5, "a"), (5, "a"), (2000, "a"), (2000, "a"), (None, "a"), (None, None), (None, "only null"), (None, "only null"), (-7, "one")]


@pytest.mark.parametrize("largest", [True, False])
def test_copies_equal_brute_force(spark, largest):
    rows = copies(6)
    got = content_groups(frame(spark, rows).repartition(5), largest).collect()
    want, keep = grouped(rows, largest)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(keep)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_over_many_ranges(spark):
    """A text with most rows is spread over ranges, and its parts meet."""
    rows = copies(8)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = content_groups(frame(spark, rows).repartition(5), normalised=F.lower).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == grouped(rows, change=str.lower)[0]
    assert set(Counter(r.text_sha256 for r in got if r.kept).values()) == {1}


def test_texts_of_one_hash_are_told_apart(monkeypatch):
    """Different texts under one hash, over the bounds of batches and ranges: each is a run, and those of the first and last hash are edges."""
    monkeypatch.setattr(exact_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    rows = [(9, "a", 1), (8, "a", 1), (7, "b", 1), (3, "c", 2), (2, "c", 2), (1, "d", 3), (None, "d", 3), (4, "e", 3)]
    want = [(9, 9, 2, True, True), (8, 9, 2, False, True), (7, 7, 1, True, True), (3, 3, 2, True, False), (2, 3, 2, False, False), (1, 1, 2, True, True), (None, 1, 2, False, True), (4, 4, 1, True, True)]
    for step in range(1, 9):
        batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([None] * len(part), pa.int64()), pa.array([r[1].encode() for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64())], names=["doc_id", "row", "text", "digest"]) for at in range(0, 8, step) for part in [rows[at : at + step]]]
        got = [r for b in exact_dedup._runs(iter(batches)) for r in b.to_pylist()]
        assert [(r["doc_id"], r["keep_id"], r["group_size"], r["first"], r["edge"] is not None) for r in got] == want
        assert [r["text"] for r in got if r["text"]] == [b"a", b"b", b"d", b"e"] and len({r["edge"] for r in got} - {None}) == 4


def test_copies_of_empty_tables(spark, tmp_path):
    assert content_groups(frame(spark, [])).collect() == []
    frame(spark, []).write.parquet(str(tmp_path / "none"))
    assert deduplicated(spark.read.parquet(str(tmp_path / "none"))).collect() == []


def test_deduplicated_rows_keep_their_columns(spark, tmp_path):
    rows = copies(7)
    docs = spark.createDataFrame([(*r, k, k % 3, str(k), k, k) for k, r in enumerate(rows)], "doc_id long, text string, `row` int, _row int, _file string, _index int, _place int")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    got = deduplicated(read).collect()
    assert list(got[0].asDict()) == read.columns
    _, keep = grouped(rows)
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t) for t, i in keep.items())
    assert all(r._row == r.row % 3 and r._file == str(r.row) and rows[r.row] == (r.doc_id, r.text) for r in got)


def arranged(i, text, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    x, y, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in marks) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    p, s, m = marks
    if d % 100 < spm:
        return len(units), "spm", len(x), len(y), s + z + p + x + m + y
    return len(units), "psm", len(x), len(y), p + x + s + z + m + y


def middles(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(["a", "é😀", "\n", "\r", "<", "S>", "P", " ", "\n\n", "<M"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    special = [None, "", "\n", "\n\n\n", "no line end", "x<P>y", "<S>", "a\n<M>\nb", "<<S<", "P>", "line\n" * 50_000, "y" * 300_000]
    return list(enumerate(made + special)) + [(None, "a\nb\nc"), (None, None), (3, "again\nand again\n"), (3, "again\nand again\n")]


def test_arrangements_equal_a_plain_loop(spark):
    rows = middles(9)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        n, form, p, m, out = arranged(i, t)
        want[i, n, form, p, m, sha(out), sha(t or "")] += 1
    assert Counter(tuple(r) for r in fim_report(frame(spark, rows)).collect()) == want
    assert {"plain", "psm", "spm"} == {k[2] for k in want}
    assert fim_report(frame(spark, [])).collect() == []


def test_rates_and_marks_are_parameters(spark):
    rows = middles(10)
    marks = ("[a|b]", "(*)", "\\E$")
    got = fill_in_middle(frame(spark, rows), rate=60, spm=20, marks=marks)
    back = got.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert Counter((r.doc_id, r.form, r.output) for r in back) == Counter((i, *[arranged(i, t, 60, 20, marks)[k] for k in (1, 4)]) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in back) == Counter((i, t or "") for i, t in rows)
    assert all((r.prefix + r.middle + r.suffix == r.back) if r.form != "plain" else r.prefix is None for r in back)


def test_arrangements_stay_in_the_jvm(spark):
    plan = fim_report(frame(spark, [(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
