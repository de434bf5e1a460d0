"""Operator 1: n-gram Jaccard join over a prefix tree."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.words import mix, shingle_sets
from kerbside.plans.components import connected_components
from kerbside.plans.scratch import Scratch
from kerbside.plans.skew import join_groups

_U = np.uint64
#: Shingles that one bucket of the uniqueness test holds, and documents and shingles that one tile of the tree join
#: holds a side.
BUCKET = 3_000_000
TILE, TILE_GRAMS = 512, 2_000_000
#: A table of ids is broadcast up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def small_enough(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def prefix_size(n, num: int, den: int):
    """Elements of which a set of n must share one with any set of similarity num/den or more, whatever the common order."""
    return n - (num * n + den - 1) // den + 1


def ngram_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Connected components of the documents whose sets of word n-grams have a Jaccard similarity of num/den or more.

    docs: columns doc_id, text; others are ignored. Returns one row per doc_id: doc_id, n_shingles (distinct n-grams
    of the text, lower-cased in A-Z), component_id (smallest doc_id reachable by links, the document's own included).

    How links are found, none lost:

    1. Equal texts count once, as the smallest doc_id among them.
    2. A set that holds more unshared n-grams than prefix_size() allows to differ has no partner. That is tested on
       the half of the n-gram space whose hash is even, which can only keep too many sets. Each task sends one entry
       for an n-gram that it saw twice.
    3. Sets too small to be linked with any but an equal one (fewer than num / (den - num) n-grams) are grouped by
       their words.
    4. The rest are ordered by (document frequency, hash). By the prefix principle two partners share one of the
       first prefix_size() n-grams. All sets with such an n-gram go to one block, named by the smallest of them.
    5. In a block the sets form a prefix tree; linked_in_tree() walks it with all sets of the other side at once.
       Blocks above TILE sets or TILE_GRAMS n-grams are first compared with the set that names them and then, without
       pairs that are connected by then, tile against tile, so no task holds more than two tiles. Tiles hold sets of
       similar sizes, and only tiles whose sizes may be linked meet.

    n-grams are compared by 64-bit hashes of their words (words.py): a wrong link would take a chance of 2**-64 for
    one pair of n-grams beside the n-grams that a pair really shares.

    Nulls and texts without words: n_shingles 0, alone. Fewer words than width: one n-gram. Rows without doc_id are
    left out; repeated rows count once; a doc_id with several texts counts with the one of smallest MD5. Empty input:
    no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    key = F.unhex(F.sha2("text", 256))
    keyed = lambda d: scratch.write(d.select("doc_id", key.alias("key"), F.length("text").cast("long").alias("chars")), "copies")
    copies = keyed(docs)
    rows, chars = copies.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    if copies.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = copies.groupBy("doc_id").agg(F.min("key").alias("kept"))
        docs = docs.join(kept, "doc_id").where(key == F.col("kept")).drop("kept").dropDuplicates(["doc_id"])
        copies = keyed(docs)
    first = scratch.write(copies.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "first")
    sizes = scratch.write(_uniqueness(docs, width, max(1, math.ceil(chars * 0.07 / BUCKET))), "sizes")
    may = sizes.where("n > 0").where(F.col("alone") < _prefix(F.col("n"), num, den)).select("doc_id").join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    may = scratch.write(may, "may")
    least = -(-num // (den - num))
    sets = docs.join(small_enough(may, may.count()), "doc_id", "left_semi").mapInArrow(_sets(width, least), "doc_id long, n int, grams array<long>, words string")
    sets = scratch.write(sets, "sets")
    equal = sets.where("words IS NOT NULL").select("doc_id", "words")
    names = scratch.write(equal.groupBy("words").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1"), "equal")
    equal = join_groups(equal, names, "words", "c", rows).select("a", F.col("doc_id").alias("b"))
    more = sets.where("words IS NULL")
    shared = more.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ordered = more.select("doc_id", "n", F.explode("grams").alias("g")).join(shared, "g").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    reach = _prefix(F.col("n"), num, den) - (F.col("n") - F.size("o"))
    ordered = scratch.write(ordered.withColumn("reach", reach).where("reach > 0").select("doc_id", "n", "reach", F.col("o.df").alias("df"), F.col("o.g").alias("g")), "ordered")
    edges = _links(ordered, scratch, num, den).unionByName(equal)
    comp = scratch.write(connected_components(edges, scratch), "components")
    classes = first.join(comp, first.rep == comp.node, "left").select("key", "c", F.coalesce("component", "rep").alias("component_id"))
    classes = scratch.write(classes, "classes")
    scratch.drop(first, may, sets, names, ordered, comp)
    out = join_groups(copies, classes, "key", "c", rows).select("doc_id", "component_id").join(sizes, "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _prefix(n: Column, num: int, den: int) -> Column:
    return n - F.ceil(n * F.lit(num) / F.lit(den) - F.lit(1e-9)).cast("int") + 1


def _sets(width: int, least: int):
    """Sets of at least `least` n-grams as hashes; smaller ones also as sorted distinct n-grams in words."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def in_words(text: str) -> str:
        w = word.findall(text.translate(small))
        grams = {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
        return "\n".join(sorted(grams))

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rows, n, grams, words, held = [], [], [], [], 0

            def out():
                flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                return pa.record_batch([pa.array(ids[rows], pa.int64()), pa.array(n, pa.int32()), lists, pa.array(words, pa.string())], names=["doc_id", "n", "grams", "words"])

            for i, s in shingle_sets(b.column(1), width):
                rows.append(i)
                n.append(len(s))
                grams.append(s)
                words.append(in_words(b.column(1)[i].as_py()) if len(s) < least else None)
                held += len(s)
                if held > 500_000 or len(n) >= 2000:
                    yield out()
                    rows, n, grams, words, held = [], [], [], [], 0
            if rows:
                yield out()

    return run


_PACKED = "bucket int, ids binary, n binary, grams binary, owners binary, twice binary"


def _uniqueness(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """doc_id, n, alone: distinct n-grams, and how many of those with an even hash no other row holds."""

    def shard(ids):
        return (mix(ids.view(np.uint64)) % _U(buckets)).astype(np.int64)

    def scatter(batches):
        def pack(ids, n, grams):
            """One row for each part of the documents (negative) and for each bucket of n-grams."""
            ids, n = np.array(ids, np.int64), np.array(n, np.int32)
            rows = []
            part = shard(ids)
            for p in np.unique(part):
                k = part == p
                rows.append((-1 - int(p), ids[k].tobytes(), n[k].tobytes(), b"", b"", b""))
            h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            owner = np.repeat(ids, [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
            k = np.argsort(h, kind="stable")
            h, owner = h[k], owner[k]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            once = new.copy()
            once[:-1] &= new[1:]
            twice = h[new & ~once]
            h, owner = h[once], owner[once]
            at, at2 = (h >> _U(33)) % _U(buckets), (twice >> _U(33)) % _U(buckets)
            k, k2 = np.argsort(at, kind="stable"), np.argsort(at2, kind="stable")
            cut, cut2 = np.searchsorted(at[k], np.arange(buckets + 1)), np.searchsorted(at2[k2], np.arange(buckets + 1))
            h, owner, twice = (h[k] >> _U(1)).astype(np.uint32), owner[k], (twice[k2] >> _U(1)).astype(np.uint32)
            for j in np.flatnonzero((cut[1:] > cut[:-1]) | (cut2[1:] > cut2[:-1])):
                rows.append((int(j), b"", b"", h[cut[j] : cut[j + 1]].tobytes(), owner[cut[j] : cut[j + 1]].tobytes(), twice[cut2[j] : cut2[j + 1]].tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "ids", "n", "grams", "owners", "twice"), r)) for r in rows], schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "n", "grams", "owners", "twice"))]))

        ids, n, grams, held = [], [], [], 0
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for i, s in shingle_sets(b.column(1), width):
                ids.append(doc[i])
                n.append(len(s))
                grams.append(s[(s & _U(1)) == 0])
                held += len(grams[-1])
                if held > 3_000_000 or len(ids) > 200_000:
                    yield pack(ids, n, grams)
                    ids, n, grams, held = [], [], [], 0
        if ids:
            yield pack(ids, n, grams)

    out = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("alone", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        j = table.column("bucket")[0].as_py()
        if j < 0:
            rows = [{"part": -1 - j, "ids": a.as_py(), "n": b.as_py(), "alone": b""} for a, b in zip(table.column("ids"), table.column("n"))]
            return pa.Table.from_pylist(rows, schema=out)
        join = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        h, owner, twice = join("grams", np.uint32), join("owners", np.int64), join("twice", np.uint32)
        k = np.argsort(h, kind="stable")
        h, owner = h[k], owner[k]
        alone = np.ones(len(h), bool)
        alone[1:] = h[1:] != h[:-1]
        alone[:-1] &= h[:-1] != h[1:]
        alone &= ~np.isin(h, twice)
        ids, c = np.unique(owner[alone], return_counts=True)
        part, rows = shard(ids), []
        for p in np.unique(part):
            k = part == p
            rows.append({"part": int(p), "ids": ids[k].tobytes(), "n": b"", "alone": c[k].astype(np.int32).tobytes()})
        return pa.Table.from_pylist(rows, schema=out)

    final = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("alone", pa.int32())])

    def total(table: pa.Table) -> pa.Table:
        ids, n, ids2, c = [], [], [], []
        for a, b, d in zip(table.column("ids"), table.column("n"), table.column("alone")):
            x = np.frombuffer(a.as_buffer(), np.int64)
            if len(b.as_py()):
                ids.append(x)
                n.append(np.frombuffer(b.as_buffer(), np.int32))
            else:
                ids2.append(x)
                c.append(np.frombuffer(d.as_buffer(), np.int32))
        ids, k = np.unique(np.concatenate(ids), return_index=True)
        n = np.concatenate(n)[k]
        alone = np.zeros(len(ids), np.int64)
        if ids2:
            np.add.at(alone, np.searchsorted(ids, np.concatenate(ids2)), np.concatenate(c))
        return pa.Table.from_arrays([pa.array(ids), pa.array(n), pa.array(alone.astype(np.int32))], schema=final)

    packed = docs.select("doc_id", "text").mapInArrow(scatter, _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(count, "part int, ids binary, n binary, alone binary")
    return counted.groupBy("part").applyInArrow(total, "doc_id long, n int, alone int")


def _links(ordered: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Edges a, b between linked documents: enough of them to connect what is connected."""
    heads = ordered.select("doc_id", "n", F.explode(F.slice("g", F.lit(1), F.least("reach", F.size("g")))).alias("h"))
    heads = scratch.write(heads, "heads")
    names = scratch.write(heads.groupBy("h").agg(F.min("doc_id").alias("block"), F.count("*").alias("c")).where("c > 1"), "names")
    members = scratch.write(join_groups(heads, names, "h", "c", heads.count()).select("block", "doc_id", "n").distinct(), "members")
    scratch.drop(heads, names)
    held = scratch.write(members.groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("s")), "blocks")
    total = members.count()
    large = (F.col("m") > TILE) | (F.col("s") > TILE_GRAMS)
    tree = _tree_join(num, den)
    lists = ordered.select("doc_id", "n", "df", "g")
    conf = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def joined(rows: DataFrame) -> DataFrame:
        """rows: block, i, j (the tile), doc_id, left, right, label."""
        rows = scratch.write(rows, "tiles")
        parts = max(conf, math.ceil(rows.count() / (32 * TILE)))
        rows = rows.join(lists, "doc_id").select("block", "i", "j", "doc_id", "n", "left", "right", "label", "df", "g")
        return rows.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(tree, "a long, b long")

    one, nought = F.lit(True), F.lit(0).cast("long")
    small = join_groups(members, held.where(~large).drop("s"), "block", "m", total)
    edges = scratch.write(joined(small.select("block", nought.alias("i"), nought.alias("j"), "doc_id", one.alias("left"), one.alias("right"), F.col("doc_id").alias("label"))), "edges")
    if held.where(large).limit(1).count() == 0:
        return edges
    # Sets whose sizes allow a link are on one level or on neighbouring ones.
    level = F.floor(F.log(F.col("n")) / math.log(den / num * 1.01)).cast("long")
    widest = F.pow(F.lit(den / num * 1.01), F.col("level") + 1)
    fits = F.greatest(F.lit(1.0), F.least(F.lit(float(TILE)), TILE_GRAMS / widest))
    tiles_of = lambda c: F.ceil(c / fits).cast("long")
    k = F.ceil(F.greatest(F.col("x") / TILE, F.col("s") / TILE_GRAMS)).cast("long")
    big = scratch.write(join_groups(members, held.where(large).select("block", "m", F.col("m").alias("x"), "s"), "block", "m", total).select("block", "doc_id", "n", k.alias("k")), "big")
    own = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("long")
    head = F.col("doc_id") == F.col("block")
    star = big.select("block", F.explode(F.when(head, F.sequence(nought, F.col("k") - 1)).otherwise(F.array(own))).alias("i"), nought.alias("j"), "doc_id", head.alias("left"), (~head).alias("right"), F.col("doc_id").alias("label"))
    edges = scratch.write(edges.union(joined(star)), "edges")
    comp = scratch.write(connected_components(edges, scratch), "sofar")
    known = big.select("block", "doc_id", level.alias("level")).join(comp, F.col("doc_id") == F.col("node"), "left").select("block", "doc_id", "level", F.coalesce("component", "doc_id").alias("label"))
    known = scratch.write(known, "known")
    main = known.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("m"))
    main = scratch.write(main.where("x.c < m").select("block", "m", F.col("x.label").alias("main")), "main")
    rest = join_groups(known, main, "block", "m", total).withColumn("inner", (F.col("label") == F.col("main")).cast("long"))
    rest = scratch.write(rest, "rest")
    # Tiles of each block by 2 * level + inner; there are a few dozen levels.
    counts = rest.groupBy("block", "level", "inner").agg(F.count("*").alias("c")).withColumn("t", F.struct((2 * F.col("level") + F.col("inner")).alias("key"), tiles_of(F.col("c")).alias("value")))
    counts = scratch.write(counts.groupBy("block").agg(F.map_from_entries(F.collect_list("t")).alias("k"), F.sum("c").alias("m")), "counts")
    rest = join_groups(rest, counts, "block", "m", total)
    kind = lambda off, inner: 2 * (F.col("level") + off) + inner
    own = F.pmod(F.xxhash64("doc_id"), F.col("k")[kind(0, 0) + F.col("inner")])
    code = lambda off, inner, x: F.shiftleft(kind(off, inner), 32) + x

    def tiles(off: int, inner: int, make) -> Column:
        n = F.coalesce(F.col("k")[kind(off, inner)], nought)
        return F.when(n > 0, F.transform(F.sequence(nought, n - 1), make)).otherwise(F.array())

    def tile(i: Column, j: Column, left: Column, right: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    yes, no = F.lit(True), F.lit(False)
    outer = [tiles(0, 0, lambda t: tile(code(0, 0, F.least(t, F.col("own"))), code(0, 0, F.greatest(t, F.col("own"))), F.col("own") <= t, F.col("own") >= t))]
    outer.append(tiles(1, 0, lambda t: tile(code(0, 0, F.col("own")), code(1, 0, t), yes, no)))
    outer.append(tiles(-1, 0, lambda t: tile(code(-1, 0, t), code(0, 0, F.col("own")), no, yes)))
    outer += [tiles(o, 1, lambda t, o=o: tile(code(0, 0, F.col("own")), code(o, 1, t), yes, no)) for o in (-1, 0, 1)]
    inner = [tiles(o, 0, lambda t, o=o: tile(code(o, 0, t), code(0, 1, F.col("own")), no, yes)) for o in (-1, 0, 1)]
    rest = rest.withColumn("own", own).withColumn("t", F.explode(F.when(F.col("inner") == 1, F.concat(*inner)).otherwise(F.concat(*outer))))
    edges = scratch.write(edges.union(joined(rest.select("block", "t.i", "t.j", "doc_id", "t.left", "t.right", "label"))), "edges")
    scratch.drop(members, held, big, comp, known, main, counts)
    return edges


def _tree_join(num: int, den: int):
    def run(batches):
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for x, y in zip(at, at[1:]):
                if tuple(k[x]) != key and held:
                    yield from solve(held)
                    held = []
                key = tuple(k[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from solve(held)

    def solve(held):
        t = pa.Table.from_batches(held)
        ids, n, label = (t.column(c).to_numpy() for c in ("doc_id", "n", "label"))
        left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        sets = [(np.asarray(d.values), np.asarray(g.values)) for d, g in zip(t.column("df"), t.column("g"))]
        found = linked_in_tree(ids, n, label, left, right, sets, num, den)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def linked_in_tree(ids, n, label, left, right, sets, num: int = 4, den: int = 5, memory: int = 48_000_000, work: Counter | None = None) -> list[tuple[int, int]]:
    """Links between the sets marked left and those marked right; as few as connect what is connected.

    sets: (document frequencies, n-grams) of each, in the global order, without n-grams that are in one set only; n
    counts these too. The right sets are the prefix tree: sorted as sequences, they lie depth first, and each place where
    they fork is a node. A branch is walked once for all sets below it, with the overlaps of the left sets that are still
    on it. A left set leaves the branch when the sizes below can't fit its own, or when its overlap and all that remains
    would suffice for none below; a branch without left sets is cut with its whole subtree.
    Pairs with one label are connected already. work counts cells (an n-gram for a left set) that were read, and subtrees
    of two or more sets that were cut.
    """
    ids, n, label = np.asarray(ids), np.asarray(n, np.int64), np.asarray(label)
    L, R = np.flatnonzero(left), np.flatnonzero(right)
    parent: dict[int, int] = {int(x): int(x) for x in label}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    grams, inverse = np.unique(np.concatenate([sets[i][1] for i in [*L, *R]]), return_inverse=True)
    df = np.zeros(len(grams), np.int64)
    at = 0
    coded = {}
    for side in (L, R):
        for i in side:
            m = len(sets[i][1])
            c = inverse[at : at + m]
            df[c] = sets[i][0]
            coded[int(i)] = c
            at += m
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, df))] = np.arange(len(grams))
    paths = {i: np.sort(rank[c]) for i, c in coded.items()}
    order = sorted((int(i) for i in R), key=lambda i: paths[i].astype(">u4").tobytes())
    fork = [0]  # elements shared with the path before
    for a, b in zip(order, order[1:]):
        p, q = paths[a], paths[b]
        m = min(len(p), len(q))
        d = np.flatnonzero(p[:m] != q[:m])
        fork.append(int(d[0]) if len(d) else m)
    fork.append(0)
    below = [len(order)] * len(fork)  # the next place whose fork is nearer to the root
    later: list[int] = []
    for k in range(len(order), -1, -1):
        while later and fork[later[-1]] >= fork[k]:
            later.pop()
        if later:
            below[k] = later[-1]
        later.append(k)
    size = n[order]
    # A right set y links with x if (num + den) * overlap >= num * (nx + ny); at depth d, at best all len(y) - d that
    # remain are shared, so the largest of these over a subtree decides for all of it.
    best = (num + den) * np.array([len(paths[i]) for i in order], np.int64) - num * size
    found = []
    step = max(1, memory // max(1, len(grams)))
    for s in range(0, len(L), step):
        side = L[s : s + step]
        member = np.zeros((len(grams), len(side)), np.uint8)
        for c, i in enumerate(side):
            member[paths[int(i)], c] = 1
        nx = n[side]
        stack = [(0, np.arange(len(side)), np.zeros(len(side), np.int64))]  # depth, left sets on the branch, their overlaps
        k = 0
        while k < len(order):
            y, path = order[k], paths[order[k]]
            while stack[-1][0] > fork[k]:
                stack.pop()
            depth, alive, overlap = stack[-1]
            nodes, j = [(len(path), k + 1)], k + 1  # depth of each node down to the leaf, end of its subtree
            while fork[j] > depth:
                nodes.insert(1, (fork[j], below[j]))
                j = below[j]
            end = k + 1
            for to, end in [*nodes[1:], nodes[0]]:
                low, high, most = size[k:end].min(), size[k:end].max(), best[k:end].max()
                keep = (num * nx[alive] <= den * high) & (num * low <= den * nx[alive])
                while True:
                    keep &= (num + den) * (overlap - depth) + most >= num * nx[alive]
                    if not keep.all():
                        alive, overlap = alive[keep], overlap[keep]
                    if depth == to or not len(alive):
                        break
                    part = member[path[depth : min(depth + 48, to)]]
                    if work is not None:
                        work["cells"] += len(part) * len(alive)
                    part = part if len(alive) == len(side) else part[:, alive]
                    overlap = overlap + part.sum(0, dtype=np.int64)
                    depth += len(part)
                    keep = np.ones(len(alive), bool)
                if not len(alive):
                    break
                if to < len(path) or end > k + 1:
                    stack.append((to, alive, overlap))
            if not len(alive) and work is not None and end > k + 1:
                work["cut"] += 1
            for x in side[alive]:
                if x != y:
                    a, b = root(int(label[x])), root(int(label[y]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((int(ids[x]), int(ids[y])))
            k = k + 1 if len(alive) else end
    return found
