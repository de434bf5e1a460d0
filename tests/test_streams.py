import random

import numpy as np
import pandas as pd
import pytest

from kerbside import params as P
from kerbside.operators import cluster
from kerbside.streaming import links as live

SCHEMA = "job_id long, class string, entry_seq long, timestamp double, lat double, lon double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def entries(n=400, jobs=2, seed=3):
    """Cameras that pass assets, with numbers in no order of time, so that labels change when clusters meet."""
    r = random.Random(seed)
    seqs = list(range(n))
    r.shuffle(seqs)
    out = []
    for k, s in enumerate(seqs):
        t = k * 0.25 + r.random()
        out.append((k % jobs, r.choice(["pole", "sign"]), s, t, 30.0 + t * 3e-5 + r.random() * 6e-5, -86.0 + r.random() * 6e-5))
    return out


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def replay(spark, tmp_path, rows, files, late):
    src = tmp_path / "in"
    src.mkdir()
    rows = sorted(rows, key=lambda r: r[3])
    parts = [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    for k, part in enumerate([*parts, [(99, "sign", 10**6, 1e5, 0.0, 0.0)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    log = live.live_links(stream, P.class_params(spark), late)
    q = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(live.LOG).parquet(str(tmp_path / "out"))


def test_replayed_stream_gives_the_clusters_of_the_batch(spark, tmp_path, rocks):
    rows = entries()
    log = replay(spark, tmp_path, [*rows, (0, None, 5000, 1.0, 30.0, -86.0), (0, "pole", 5001, 1.0, None, -86.0)], 4, "2 seconds").cache()
    got = {r.entry_seq: r.cluster_id for r in live.settled(log).collect()}
    want = {r.entry_seq: r.cluster_id for r in cluster.linked(spark.createDataFrame(rows, SCHEMA), P.class_params(spark)).collect()}
    assert got == want and len(set(want.values())) < len(want) / 2
    assert log.count() <= 2 * len(rows)


def test_labels_told_before_are_joined():
    """Two clusters far apart until a row between them comes: labels that were written are said to be one."""
    step = 6 / 364_000
    rows = [(5, 0.0, 30.0, -86.0, 5, True), (3, 1.0, 30.0 + 2 * step, -86.0, 3, True), (9, 1.0, 31.0, -86.0, 9, False), (7, 2.0, 30.0 + step, -86.0, 7, False)]
    out, moved = live.linked(pd.DataFrame(rows, columns=live.NAMES), 3, 8.0, 6.0)
    assert moved == [(5, 3)] and out["label"].tolist() == [3, 3, 9, 3] and out["told"].tolist() == [True, True, False, True]


def test_links_of_rows_equal_all_pairs():
    rows = [(s, t, la, lo, s, False) for j, c, s, t, la, lo in entries(150, 1) if c == "sign"]
    frame = pd.DataFrame(rows, columns=live.NAMES)
    near = lambda a, b: abs(a[1] - b[1]) <= 6.0 and live._feet(a[2], a[3], np.array([b[2]]), np.array([b[3]]))[0] <= 10.0
    pairs = [(a[0], b[0]) for a in rows for b in rows if near(a, b)]
    label = {r[0]: r[0] for r in rows}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    half = len(rows) // 2
    first, _ = live.linked(frame[:half], 0, 10.0, 6.0)
    both, _ = live.linked(pd.concat([first, frame[half:]], ignore_index=True), half, 10.0, 6.0)
    assert dict(zip(both["entry_seq"].tolist(), both["label"].tolist())) == label
