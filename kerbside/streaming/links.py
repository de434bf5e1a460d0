"""An addition of ours: clusters of a stream of entries, as a log of labels whose state is bounded by the time gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside import params as P
from kerbside.operators.detect import with_params
from kerbside.plans.components import connected_components
from kerbside.plans.scratch import Scratch

#: An entry that a later one may still link to; told: whether an entry of its label was written already.
RECENT = "entry_seq long, sec double, lat double, lon double, label long, told boolean"
LOG = "job_id long, class string, entry_seq long, label long"
NAMES = ["entry_seq", "sec", "lat", "lon", "label", "told"]


def _feet(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    s, t = np.sin(np.radians(lats - lat) / 2), np.sin(np.radians(lons - lon) / 2)
    return 2 * P.EARTH_FT * np.arcsin(np.sqrt(np.minimum(s * s + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * t * t, 1.0)))


def linked(rows: pd.DataFrame, first_new: int, eps_ft: float, gate_s: float) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """rows (NAMES) with the labels that links of the rows from first_new on to any other give, and pairs (label told before, label it is now).

    A row meets the rows of nearly its latitude alone. Labels are the smallest entry_seq that links reach.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    by_lat = np.argsort(rows["lat"].to_numpy(), kind="stable")
    lat, lon, sec, label = (rows[c].to_numpy()[by_lat] for c in ("lat", "lon", "sec", "label"))
    reach = np.degrees(eps_ft / P.EARTH_FT) * (1 + 1e-9)
    for k in np.flatnonzero(by_lat >= first_new).tolist():
        a, e = np.searchsorted(lat, lat[k] - reach, "left"), np.searchsorted(lat, lat[k] + reach, "right")
        near = (np.abs(sec[a:e] - sec[k]) <= gate_s) & (_feet(lat[k], lon[k], lat[a:e], lon[a:e]) <= eps_ft)
        for x in np.unique(label[a:e][near]).tolist():
            x, y = root(x), root(int(label[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
    told = rows.loc[rows["told"], "label"].unique().tolist()
    moved = [(x, root(x)) for x in told if root(x) != x]
    rows = rows.assign(label=[root(x) for x in rows["label"].tolist()])
    return rows.assign(told=rows["label"].isin({root(x) for x in told})), moved


class Linker(StatefulProcessor):
    """State of one class of a job: the entries of the last gate_s seconds and their labels."""

    def __init__(self, gate_s: float):
        self._gate_s = gate_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._recent = handle.getListState("recent", RECENT)

    def _out(self, key: tuple, rows: pd.DataFrame, moved: list, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Writes the labels of rows that nothing can link to any more, keeps the others, and asks to be called when these are old too."""
        old = rows["sec"] + self._gate_s < watermark_ms / 1000
        gone, stay = rows[old], rows[~old]
        if len(stay):
            stay = stay.assign(told=stay["told"] | stay["label"].isin(set(gone["label"].tolist())))
            self._recent.put([tuple(r) for r in stay.astype(object).itertuples(index=False)])
            self._handle.registerTimer(int((stay["sec"].max() + self._gate_s) * 1000) + 2)
        else:
            self._recent.clear()
        log = [*moved, *zip(gone["entry_seq"].tolist(), gone["label"].tolist())]
        if log:
            yield pd.DataFrame([(*key, *x) for x in log], columns=["job_id", "class", "entry_seq", "label"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = pd.DataFrame(list(self._recent.get()), columns=NAMES)
        new = pd.concat(list(rows), ignore_index=True)
        added = new[["entry_seq", "sec", "lat", "lon"]].assign(label=new["entry_seq"], told=False)
        every = pd.concat([recent, added], ignore_index=True) if len(recent) else added
        every = every.astype({"entry_seq": "int64", "label": "int64", "told": "bool"})
        every, moved = linked(every, len(recent), float(new["eps_ft"].iloc[0]), self._gate_s)
        yield from self._out(key, every, moved, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        recent = pd.DataFrame(list(self._recent.get()), columns=NAMES)
        yield from self._out(key, recent, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_links(entries: DataFrame, params: DataFrame, late: str = "10 seconds", gate_s: float = P.TIME_GATE_S) -> DataFrame:
    """A log of job_id, class, entry_seq, label of a stream of entries (job_id, class, entry_seq, timestamp in seconds, lat, lon): settled() makes clusters of it.

    An entry is written once nothing can link to it any more, with the smallest entry_seq that it is then known to be
    linked with; where labels written before turn out to be one cluster's, a row says so. So the log is linear in the
    entries, and the state of a class of a job is its entries of gate_s and late, however long a cluster lasts. Entries
    later than the watermark are left out, as are those without job, class, number, time or position, which link with
    nothing. Repeated rows of an entry_seq change no cluster. Needs the RocksDB state store.
    """
    e = with_params(entries.select("job_id", "class", "entry_seq", "timestamp", "lat", "lon"), params.select("class", "eps_ft"))
    e = e.na.drop(subset=["job_id", "class", "entry_seq", "timestamp", "lat", "lon"])
    time = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    e = e.select("job_id", "class", "entry_seq", F.col("timestamp").cast("double").alias("sec"), "lat", "lon", F.coalesce("eps_ft", F.lit(P.DEFAULT_EPS_FT)).alias("eps_ft"), time.alias("event_time"))
    groups = e.withWatermark("event_time", late).groupBy("job_id", "class")
    return groups.transformWithStateInPandas(Linker(gate_s), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


def settled(log: DataFrame) -> DataFrame:
    """entry_seq, cluster_id of a log of live_links as far as it was written: the smallest entry_seq of each cluster."""
    comp = connected_components(log.where("entry_seq <> label").select(F.col("entry_seq").alias("a"), F.col("label").alias("b")), Scratch(log.sparkSession))
    c = comp.select(F.col("node").alias("entry_seq"), F.col("component").alias("_c"))
    return log.select("entry_seq").distinct().join(c, "entry_seq", "left").select("entry_seq", F.coalesce("_c", "entry_seq").alias("cluster_id"))
