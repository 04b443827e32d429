"""State that ends: entries with a time to live and a capacity, and entries of two parties that meet.

A store (a key) holds a limited number of entries.  An entry that is put again lives anew and becomes the youngest; one that
has lived for its time is gone, and so is the oldest one when a new one finds the store full.  What goes is told once, with
its time and reason.

The state is a value for each shelf of stores in Spark's state store, so a restart goes on where it stood; event-time timers end entries of
stores that nothing is put into any more.  Times are those of the events, so micro-batches of any size tell the same, as long as
no event is later than ``late``; later ones are left out.

Cases: events of one time go by entry; repeated events put the entry again; null stores are a store, null entries and times are
left out; a store holds ``capacity`` entries at most, whatever comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casemill.operators.context import correlated

from .folds import run_available

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GONE = "store string, entry string, put_at long, gone_at long, reason string"


class Entries:
    """The entries of one store: entry -> time of its last put, in microseconds."""

    def __init__(self, held: dict[str, int], ttl: int, capacity: int) -> None:
        self.held, self.ttl, self.capacity = held, ttl, capacity

    def expire(self, now: int) -> Iterator[tuple[str, int, int, str]]:
        for entry, at in sorted(((e, t) for e, t in self.held.items() if t + self.ttl <= now), key=lambda x: (x[1], x[0])):
            del self.held[entry]
            yield entry, at, at + self.ttl, "expired"

    def put(self, entry: str, now: int) -> Iterator[tuple[str, int, int, str]]:
        yield from self.expire(now)
        self.held[entry] = now
        while len(self.held) > self.capacity:
            oldest = min(self.held.items(), key=lambda x: (x[1], x[0] == entry, x[0]))[0]
            yield oldest, self.held.pop(oldest), now, "evicted"


class LiveStores(StatefulProcessor):
    """Many stores (a shelf) in one value: their entries, and when the shelf's timer is due (in milliseconds).

    A value is read and written once for all rows of a micro-batch, and a shelf has one timer, for its oldest entry: each call of
    the state store is a message to the JVM, and each group a Pandas frame.
    """

    def __init__(self, ttl: int, capacity: int) -> None:
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shelf", "store array<string>, entry array<string>, at array<bigint>, due bigint")

    def _shelf(self) -> tuple[dict[str, Entries], int | None]:
        store, entry, at, due = self.state.get() or ((), (), (), None)
        shelf: dict[str, Entries] = {}
        for s, e, t in zip(store, entry, at, strict=True):
            self._of(shelf, s).held[e] = t
        return shelf, due

    def _of(self, shelf: dict[str, Entries], store: str) -> Entries:
        if store not in shelf:
            shelf[store] = Entries({}, self.ttl, self.capacity)
        return shelf[store]

    def _kept(self, shelf: dict[str, Entries], due: int | None) -> None:
        """A timer that is due too early finds nothing, and sets the next one."""
        held = [(s, e, t) for s, entries in shelf.items() for e, t in entries.held.items()]
        if not held:
            return self.state.clear()
        store, entry, at = map(list, zip(*held, strict=True))
        first = -(-(min(at) + self.ttl) // 1000)
        if due is None or first < due:
            due = first
            self.handle.registerTimer(due)
        self.state.update((store, entry, at, due))

    def _told(self, gone: list) -> Iterator[pd.DataFrame]:
        if gone:
            yield pd.DataFrame(gone, columns=["store", "entry", "put_at", "gone_at", "reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        shelf, due = self._shelf()
        came = sorted(row for batch in rows for row in zip(batch["put_at"].tolist(), batch["entry"].tolist(), batch["store"].tolist(), strict=True))
        gone = [(store, *x) for at, entry, store in came for x in self._of(shelf, store).put(entry, at)]
        self._kept(shelf, due)
        yield from self._told(gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        shelf, _ = self._shelf()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        gone = [(store, *x) for store, entries in shelf.items() for x in entries.expire(now)]
        self._kept(shelf, None)
        yield from self._told(gone)

    def close(self) -> None:
        pass


def gone_entries(events: DataFrame, store: str, entry: str, at: str, *, ttl_seconds: int, capacity: int = 64, late: str = "0 seconds", shelves: int = 1024) -> DataFrame:
    """A stream of what goes: (store, entry, put_at, gone_at, reason), times in microseconds.

    Stores are dealt over ``shelves`` by a hash; a micro-batch reads the shelves of its rows, so their number should grow with
    that of the stores.  It belongs to the checkpoint: a restart must not change it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    put = events.where(F.col(entry).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    put = put.select(F.coalesce(F.col(store).cast("string"), F.lit("")).alias("store"), F.col(entry).cast("string").alias("entry"), F.unix_micros(F.col(at).cast("timestamp")).alias("put_at"), at)
    shelf = F.pmod(F.xxhash64("store"), F.lit(shelves)).cast("int")
    return put.withColumn("shelf", shelf).groupBy("shelf").transformWithStateInPandas(LiveStores(ttl_seconds * 1_000_000, capacity), GONE, "Append", "eventTime")


def kept_stream(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream in append mode over what is there, into files by batch number, so that a repeated batch replaces itself; returns all of them."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run_available(stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint"))
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{path}/out").parquet(f"{path}/out").select(*stream.columns)


def met(left: DataFrame, right: DataFrame, token: str, at: str, *, ttl: str, late: str = "0 seconds") -> DataFrame:
    """A stream-stream join of two parties' entries with one token, ``ttl`` apart at most in either direction.

    Both sides have a watermark, so an entry leaves the state once nothing can meet it any more.
    """
    return correlated(left.withWatermark(at, late), right.withWatermark(at, late), token, at, ttl)


def replay_files(events: DataFrame, at: str, path: str, slices: int = 4) -> None:
    """Past events as files that a stream reads in the order of time: one append for each slice of time."""
    cuts = events.approxQuantile(at, [i / slices for i in range(1, slices)], 0.001) if slices > 1 else []
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:], strict=False):
        events.where((F.col(at) > low) & (F.col(at) <= high)).coalesce(1).write.mode("append").parquet(path)
