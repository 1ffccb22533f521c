"""Streams with state by key: new items of feeds, health that changes when nothing comes, and retries.

Each processor takes a micro-batch's rows in order of time and lets what was due
before a row happen first, so results don't hang on how rows fall into batches;
timers do the rest when the watermark has passed and no row comes.  Rows are handled
as rows: most keys have a few in a batch, and a data frame a key would cost more than
they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.health import DISCONNECT_AFTER, EXPECTED_MS
from tidewire.streaming.clusters import STORE

#: Ids that a feed remembers; of a feed's first poll, items that count as news, and minutes that they may be old.
SEEN, FIRST_ITEMS, FIRST_MINUTES = 400, 5, 15
#: Milliseconds before an attempt, attempts in all, and milliseconds after which one without an outcome is taken back.
DELAYS_MS, ATTEMPTS, STUCK_MS = (0, 1_000, 3_000, 10_000), 4, 600_000


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _rows(rows: list[tuple], out: str) -> Iterator[Row]:
    named = Row(*(c.split()[0] for c in out.split(", ")))
    return iter([named(*r) for r in rows])


def _in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """In the order of some columns, nulls last; equal rows as they came."""
    return sorted(rows, key=lambda r: [(r[c] is None, 0 if r[c] is None else r[c]) for c in by])


# ---------------------------------------------------------------- new items


NEW_ITEMS = "source_id string, item_id string, polled_ms long, published_ms long, first boolean"


class NewItems(StatefulProcessor):
    """A feed's ids in order, a list, and the newest time among the items of the polls before."""

    def __init__(self, seen: int):
        self.most = seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "id string")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        items = [r for r in _in_order(rows, "polled_ms", "place") if r["polled_ms"] is not None]
        seen = dict.fromkeys(r[0] for r in self.seen.get())
        held = self.newest.get()
        newest = int(held[0]) if held else None
        out: list[tuple] = []
        for polled, together in groupby(items, key=lambda r: r["polled_ms"]):
            fresh, times = [], []
            for item, ms in ((r["item_id"], r["published_ms"]) for r in together):
                if ms is not None:
                    times.append(ms)
                # Strictly older than what came before is late; of equal times the id decides.
                if item in seen or newest is not None and ms is not None and ms < newest:
                    continue
                seen[item] = None
                fresh.append((key[0], item, polled, ms, newest is None))
            if newest is None:
                # The order of time, undated items at the poll's.
                fresh.sort(key=lambda r: r[2] if r[3] is None else r[3])
                fresh = [r for r in fresh if r[3] is None or r[2] - r[3] <= FIRST_MINUTES * 60_000][-FIRST_ITEMS:]
            out += fresh
            newest = max([newest or 0, *times])
            seen = dict.fromkeys([*seen][-self.most :])
        self.seen.put([(i,) for i in seen])
        self.newest.update((newest,))
        yield from _rows(out, NEW_ITEMS)

    def close(self) -> None:
        pass


def new_items_stream(items: DataFrame, late: str = "1 day", seen: int = SEEN) -> DataFrame:
    """Of items (source_id, item_id, polled_at, place, published_at) those that are new to their feed.

    An item is new if its id is not among the last ``seen`` of the feed and it is not
    older than the newest item of the polls before; undated items go by their id.  Of
    a feed's first poll only the newest few of the last minutes are put out, the others
    are known from then on.  Items of one poll have to come together.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = items.withColumn("_at", F.col("polled_at").cast("timestamp")).withWatermark("_at", late)
    rows = rows.select("source_id", "item_id", "_at", ms("polled_at").alias("polled_ms"), "place", ms("published_at").alias("published_ms"))
    return _with_state(rows, "source_id", NewItems(seen), NEW_ITEMS)


# ---------------------------------------------------------------- health


HEALTH = "source_id string, at_ms long, state string, consecutive_failures int"


class Health(StatefulProcessor):
    """A source's failures in a row, its last item, and what was last told of it."""

    def __init__(self, expected_ms: int):
        self.expected = expected_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "failures int, item long, state string, at long")

    def _due(self, failures: int, item: int | None) -> list[tuple[int, str]]:
        """When a source without failures is told late, and when stale; it has to have brought an item before."""
        return [] if failures or item is None else [(item + self.expected + 1, "DELAYED"), (item + 3 * self.expected + 1, "STALE")]

    def _until(self, key: tuple, ms: int, failures: int, item: int | None, state: str, at: int) -> tuple[str, list[tuple]]:
        """What falls due after ``at`` and before ``ms``."""
        out = []
        for due, told in self._due(failures, item):
            if at < due < ms and told != state:
                state = told
                out.append((key[0], due, told, failures))
        return state, out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        polls = _in_order(rows, "ms", "ok")
        failures, item, state, at = self.held.get() or (0, None, "ACTIVE", -1)
        out: list[tuple] = []
        for ms, ok, items in ((r["ms"], r["ok"], r["items"]) for r in polls):
            state, due = self._until(key, ms, failures, item, state, at)
            out += due
            failures, item, at = 0 if ok else failures + 1, ms if items > 0 else item, ms
            if failures:
                now = "DISCONNECTED" if failures >= DISCONNECT_AFTER else "ERROR"
            else:
                since = None if item is None else ms - item
                now = "STALE" if since is None or since > 3 * self.expected else "DELAYED" if since > self.expected else "ACTIVE"
            if now != state:
                state = now
                out.append((key[0], ms, now, failures))
        self.held.update((failures, item, state, at))
        for due, _ in self._due(failures, item):
            if due > at:
                self.handle.registerTimer(due)
        yield from _rows(out, HEALTH)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        failures, item, state, at = self.held.get() or (0, None, "ACTIVE", -1)
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        # A timer of an item that is no longer the last, or of a source that has failed since, has nothing to tell.
        told = dict(self._due(failures, item)).get(due)
        if told is None or told == state or due <= at:
            return iter(())
        self.held.update((failures, item, told, due))
        return _rows([(key[0], due, told, failures)], HEALTH)

    def close(self) -> None:
        pass


def health_timers_stream(polls: DataFrame, expected_ms: int = EXPECTED_MS, late: str = "10 minutes") -> DataFrame:
    """Changes of state of sources from polls (source_id, ts, ok, items), with DELAYED and STALE told when they fall due.

    State is as of ``health.evaluate``; a source that has brought no item is stale
    from its first good poll.  Polls of one time are taken failures first.
    """
    rows = polls.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    rows = rows.select("source_id", "_at", F.unix_millis("_at").alias("ms"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("items", F.lit(0)).cast("int").alias("items"))
    return _with_state(rows, "source_id", Health(expected_ms), HEALTH)


# ---------------------------------------------------------------- retries


RETRIES = "job_id string, at_ms long, attempt int, action string"


class Retries(StatefulProcessor):
    """A job's attempt and what it waits for: the next run, or an outcome."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "attempt int, running boolean, due long, done boolean")

    def _step(self, job: str, held: tuple, due: int) -> tuple[tuple, list[tuple]]:
        """What happens at the time that a job waits for."""
        attempt, running, _, _ = held
        if not running:
            return (attempt + 1, True, due + STUCK_MS, False), [(job, due, attempt + 1, "RUN")]
        # An attempt without an outcome is taken back, and counts.
        return self._failed(job, attempt, due, "STUCK")

    def _failed(self, job: str, attempt: int, ms: int, why: str) -> tuple[tuple, list[tuple]]:
        if attempt >= ATTEMPTS:
            return (attempt, False, -1, True), [(job, ms, attempt, why), (job, ms, attempt, "GIVEN_UP")]
        return (attempt, False, ms + DELAYS_MS[min(attempt, len(DELAYS_MS) - 1)], False), [(job, ms, attempt, why)]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, out = self.held.get(), []
        for ms, kind in ((r["ms"], r["kind"]) for r in _in_order(rows, "ms", "place")):
            while held and not held[3] and held[2] <= ms:
                held, told = self._step(key[0], tuple(held), held[2])
                out += told
            if kind == "queued" and (held is None or held[3]):
                # A job that was given up, or done, may be queued anew; one that is under way is not queued twice.
                held, told = self._step(key[0], (0, False, ms + DELAYS_MS[0], False), ms + DELAYS_MS[0])
                out += told
            elif held and held[1] and kind == "failed":
                held, told = self._failed(key[0], held[0], ms, "FAILED")
                out += told
            elif held and held[1] and kind == "ok":
                held = (held[0], False, -1, True)
                out.append((key[0], ms, held[0], "DONE"))
        if held:
            self.held.update(tuple(held))
            if not held[3]:
                self.handle.registerTimer(int(held[2]))
        yield from _rows(out, RETRIES)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.held.get()
        if not held or held[3] or held[2] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        out: list[tuple] = []
        # All that is due by now: a timer that is set here would wait for the next batch.
        while not held[3] and held[2] <= timerValues.getCurrentWatermarkInMs():
            held, told = self._step(key[0], tuple(held), held[2])
            out += told
        self.held.update(tuple(held))
        if not held[3]:
            self.handle.registerTimer(int(held[2]))
        return _rows(out, RETRIES)

    def close(self) -> None:
        pass


def retries_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """What happens to jobs, from events (job_id, ts, place, kind: queued, ok or failed).

    A queued job runs at once; a failed attempt is followed by another after 1, 3 and
    10 seconds, and by none after the fourth.  An attempt without an outcome for ten
    minutes is taken back as failed.  Outcomes of a job that doesn't run are passed over.
    """
    rows = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), "_at", F.unix_millis("_at").alias("ms"), "place", "kind")
    return _with_state(rows, "job_id", Retries(), RETRIES)
