"""Streaming forms: lateness, deduplication, daily windows, throttling, generations, archives, heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["lon", "lat", "acq_date", "acq_time", "source"]


def with_lateness(stream: DataFrame, late: str = "1 day", t: str = "acq_ts") -> DataFrame:
    """A day stays open until the newest event is a day past its end. Wall-clock columns become instants first."""
    return stream.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def dedupe_stream(stream: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key, however often it is pulled again while its state lives."""
    return stream.dropDuplicatesWithinWatermark(key)


def daily_windows(stream: DataFrame, t: str = "acq_ts") -> DataFrame:
    """Counts per UTC day; in append mode a day comes out once it is final."""
    return stream.groupBy(F.window(t, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")


def activity_stream(stream: DataFrame, fires: DataFrame) -> DataFrame:
    """I8: detections (fire, acq_ts) per fire-local day. fires is static: fire, zone."""
    local = stream.join(fires, "fire").withColumn("local_ts", F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("acq_ts").cast("timestamp_ntz")))
    day = F.to_date("local_ts")
    return local.groupBy(F.window("acq_ts", "1 day"), "fire", day.alias("local_day")).agg(F.count(F.lit(1)).alias("n")).drop("window")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within, streams that start keep their state in RocksDB, which processors with several states and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


MINUTE = 60_000_000


class Throttle(StatefulProcessor):
    """I9 for one actor: the running minute (its start and count), which a timer clears, and the session's total, which stays."""

    def __init__(self, per_minute: int, per_session: int) -> None:
        self.per_minute, self.per_session = per_minute, per_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minute, self.session = handle.getValueState("minute", "since long, n int"), handle.getValueState("session", "total int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, n = self.minute.get() if self.minute.exists() else (None, 0)
        total = self.session.get()[0] if self.session.exists() else 0
        before, kept = since, []
        events = pd.concat(list(rows)).sort_values(["ts", "ordinal"])
        for at, ordinal in zip(events["ts"].astype("datetime64[us]").astype("int64"), events["ordinal"], strict=True):
            if since is None or at - since > MINUTE:
                since, n = int(at), 0
            if n < self.per_minute and total < self.per_session:
                n, total = n + 1, total + 1
                kept.append(ordinal)
        self.minute.update((since, n))
        self.session.update((total,))
        if since != before:
            if before is not None:
                self.handle.deleteTimer(_over(before))
            self.handle.registerTimer(_over(since))
        yield pd.DataFrame({"actor": [key[0]] * len(kept), "ordinal": kept})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # no event of this minute can come any more: the next one begins a new minute in any case
        if self.minute.exists() and _over(self.minute.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.minute.clear()
        return iter(())

    def close(self) -> None:
        pass


def _over(since: int) -> int:
    """Milliseconds at which a minute that began then (microseconds) has passed."""
    return (since + MINUTE) // 1000 + 1


def throttle_stream(events: DataFrame, per_minute: int = 30, per_session: int = 300, late: str = "10 minutes") -> DataFrame:
    """Streaming form of the throttle. events: actor, ordinal, ts.

    An actor's minute lives until the newest event of all is `late` past its end and
    then leaves the state; the session's total stays. Start it within keyed_state.
    """
    timed = events.select("actor", "ordinal", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("actor").transformWithStateInPandas(Throttle(per_minute, per_session), "actor long, ordinal long", "Append", "EventTime")


BOX = "w double, s double, e double, n double, gen int"


class Generations(StatefulProcessor):
    """I4 for one fire: the archived box and its generation; I5: a lost state begins with the published one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.box = handle.getValueState("box", BOX)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.box.update((float(r.w), float(r.s), float(r.e), float(r.n), int(r.gen)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = tuple(self.box.get()) if self.box.exists() else None
        for part in rows:
            for r in part.itertuples():
                if have is None:
                    have = (r.w, r.s, r.e, r.n, 1)
                elif not (have[0] <= r.w and have[1] <= r.s and have[2] >= r.e and have[3] >= r.n):
                    have = (min(have[0], r.w), min(have[1], r.s), max(have[2], r.e), max(have[3], r.n), have[4] + 1)
        self.box.update(have)
        yield pd.DataFrame([(key[0], *have)], columns=["fire", "w", "s", "e", "n", "gen"])

    def close(self) -> None:
        pass


def generation_stream(boxes: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Per fire the archived box grows when a wanted box exceeds it, and its generation rises. boxes: fire, w, s, e, n.

    published (fire, w, s, e, n, gen) is the index that stands in where the state is
    lost: a stream that starts without a checkpoint begins with it, fire by fire on
    the executors. Start it within keyed_state.
    """
    begin = None if published is None else published.groupBy("fire")
    return boxes.groupBy("fire").transformWithStateInPandas(Generations(), f"fire long, {BOX}", "Update", "None", initialState=begin)


def archive_stream(detections: DataFrame, path: str, name: str):
    """Writer that adds each batch to the archive at path once, however often the batch is run again.

    detections: fire_slug, gen, acq_date, lon, lat and more. `name` tells apart
    streams of one archive, and a stream that starts over with a new checkpoint.
    """
    from ..sources.sinks import append_to_archive

    return detections.writeStream.foreachBatch(lambda batch, batch_id: append_to_archive(batch, path, name, batch_id))


def fold_heartbeats_stream(runs: DataFrame, path: str, keep: int = 40):
    """Writer that folds each batch of heartbeats into the last runs of each job, as a new version below path."""
    from ..sources.sinks import read_published, write_version

    def fold(batch: DataFrame, batch_id: int) -> None:
        from ..operators.incidents import keep_last

        old = read_published(batch.sparkSession, path)
        rows = batch if old is None else old.unionByName(batch)
        write_version(keep_last(rows.dropDuplicates(["job", "finished_at"]), keep, ["job"], F.col("finished_at").desc()), path, batch_id + 1)

    return runs.writeStream.foreachBatch(fold)


__all__ = ["activity_stream", "archive_stream", "daily_windows", "dedupe_stream", "fold_heartbeats_stream", "generation_stream", "keyed_state", "throttle_stream", "with_lateness"]
