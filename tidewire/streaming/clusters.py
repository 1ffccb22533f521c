"""Clusters of posts as keyed state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.cluster import OUT, WINDOW_MINUTES, OpenClusters, as_post, prepare, reach_of

#: The store of states that keeps lists and maps by key; a session's own setting of it has to be this one.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETS = ("words", "kept", "figures", "sources")


def _packed(c: dict[str, Any]) -> str:
    return json.dumps({k: sorted(v, key=str) if k in _SETS else v for k, v in c.items()})


def _unpacked(text: str) -> dict[str, Any]:
    c = json.loads(text)
    return c | {k: set(c[k]) if k == "sources" else frozenset(c[k]) for k in _SETS}


class Clusters(StatefulProcessor):
    """Folds a key's posts as they come: a list of its open clusters, each with its posts, which is written anew after each batch.

    A timer at the end of the newest cluster's window empties the state when the
    watermark has passed and the key gets no further posts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "number long, cluster string, posts array<string>")
        self.next = handle.getValueState("next", "number long")

    def _loaded(self) -> OpenClusters:
        held, of = {}, {}
        for number, cluster, posts in self.open.get():
            held[int(number)] = _unpacked(cluster)
            of |= dict.fromkeys(posts, int(number))
        number = self.next.get()
        return OpenClusters(held, of, int(number[0]) if number else 0)

    def _save(self, clusters: OpenClusters) -> None:
        posts: dict[int, list[str]] = {n: [] for n in clusters.clusters}
        for post, number in clusters.of.items():
            posts[number].append(post)
        if posts:
            self.open.put([(n, _packed(c), posts[n]) for n, c in clusters.clusters.items()])
        else:
            self.open.clear()
        self.next.update((clusters.next,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        posts = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        clusters, last = self._loaded(), int(posts["ms"].max())
        out = [clusters.take(as_post(p)) for p in posts.to_dict("records")]
        clusters.sweep(max(last, timerValues.getCurrentWatermarkInMs()))
        self._save(clusters)
        self.handle.registerTimer(last + WINDOW_MINUTES * 60_000 + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        clusters = self._loaded()
        clusters.sweep(expiredTimerInfo.getExpiryTimeInMs())
        self._save(clusters)
        return iter(())

    def close(self) -> None:
        pass


def cluster_stream(posts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of posts (as of ``cluster_posts``) to the rows that ``cluster_posts`` has for them.

    The key is ``block`` if it is there, else what a category can meet: in a stream it
    isn't known which posts will never meet, so a finer key (a desk, a region) has to
    be the caller's.  Within a micro-batch posts are taken in order of time, and batches
    as they come; posts later than ``late`` behind the newest are dropped.
    """
    spark: SparkSession = posts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = posts.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    if "block" not in posts.columns:
        rows = rows.withColumn("block", reach_of(F.col("category")))
    rows = prepare(rows, "_at").fillna(0.0, ["importance"]).fillna(0, ["ms"])
    return rows.groupBy("block").transformWithStateInPandas(statefulProcessor=Clusters(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
