"""Streams over searches, interactions, impressions, feedback and incoming papers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.text import title_key


def daily_searches(history: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, n): searches a day; a day is final once the watermark has passed it."""
    rows = history.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.to_date("w.start").alias("day"), "n")


def trending_windows(history: DataFrame, late: str = "1 day") -> DataFrame:
    """(start, topic, searches) in windows of seven days that move by one; append mode gives a window once, when it is final, so ``top_of_windows`` can pick its best batch by batch."""
    rows = history.filter(F.btrim("topic") != "").withWatermark("created_at", late)
    rows = rows.groupBy(F.window("created_at", "7 days", "1 day").alias("w"), "topic").agg(F.count("*").alias("searches"))
    return rows.select(F.col("w.start").alias("start"), "topic", "searches")


def top_of_windows(batch: DataFrame, k: int = 10) -> DataFrame:
    from ..operators.corpus import first_per

    return first_per(batch, ["start"], [F.desc("searches"), "topic"], k)


def latest_interactions(log: DataFrame) -> DataFrame:
    """(user_id, external_id, kind, ts): the newest time of each interaction; for update or complete mode."""
    return log.groupBy("user_id", "external_id", "kind").agg(F.max("ts").alias("ts"))


def quota_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, used): a user's uses a day."""
    rows = log.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used"))
    return rows.select("user_id", F.to_date("w.start").alias("day"), "used")


def browsing_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events with no pause longer than ``gap``."""
    rows = log.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def unknown_papers(incoming: DataFrame, known: DataFrame, late: str = "1 day") -> DataFrame:
    """Papers (title, landed_at) whose title key isn't among ``known`` (a static table), each key once within the watermark."""
    rows = incoming.withColumn("title_key", title_key(F.col("title")))
    rows = rows.join(known.select(title_key(F.col("title")).alias("title_key")).distinct(), "title_key", "left_anti")
    return rows.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["title_key"])


# The process that prepares a stateful stream doesn't get the files that executors get, so what is defined here travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that holds lists, maps and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


class _SeenRing(StatefulProcessor):
    """A user's ring of seen papers: ids with their newest times, and one timer that empties it; one read and one write of the state a batch."""

    def __init__(self, newest: int, days: int):
        self.newest, self.days = newest, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "items array<string>, times array<long>, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.ring.get()
        held = dict(zip(before[0], before[1], strict=True)) if before else {}
        for row in rows:
            held[row.external_id] = max(held.get(row.external_id, 0), row.at)
        last = max(held.values())
        kept = sorted(((i, t) for i, t in held.items() if last - t <= self.days * _DAY_MS * 1000), key=lambda x: (-x[1], x[0]))[: self.newest]
        timer = max(last // 1000 + self.days * _DAY_MS, timerValues.getCurrentWatermarkInMs() + 1)
        if before is None or before[2] != timer:
            if before is not None:
                self.handle.deleteTimer(before[2])
            self.handle.registerTimer(timer)
        self.ring.update(([i for i, _ in kept], [t for _, t in kept], timer))
        for item, at in kept:
            yield Row(user_id=key[0], external_id=item, at=at, expired=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """The user has been idle for as long as the ring lasts: the state goes, and a row says so."""
        self.ring.clear()
        yield Row(user_id=key[0], external_id=None, at=expiredTimerInfo.getExpiryTimeInMs() * 1000, expired=True)

    def close(self) -> None:
        pass


def seen_ring(log: DataFrame, newest: int = 1000, days: int = 21, late: str = "1 day") -> DataFrame:
    """(user_id, external_id, ts, expired): the ring of each user's seen papers after every batch that touches it.

    The state of a user is at most ``newest`` ids with their times, none older than ``days`` before the
    user's newest.  When the watermark has passed a user's newest time by ``days``, the state is dropped
    without any row of that user, and one row without a paper is given (``expired``).  Rows later than
    ``late`` don't count.  The session needs the RocksDB state store (``ROCKSDB``).
    """
    rows = log.withWatermark("ts", late).select("user_id", "external_id", "ts", F.unix_micros("ts").alias("at"))
    rows = rows.groupBy("user_id").transformWithState(_SeenRing(newest, days), "user_id long, external_id string, at long, expired boolean", "update", "eventTime")
    return rows.select("user_id", "external_id", F.timestamp_micros("at").alias("ts"), "expired")


#: The fields that a feedback patch may set; in ``clear`` it names those that it empties.
FEEDBACK_FIELDS = ("vote", "note", "addressed_by")


def feedback_fold(log: DataFrame) -> DataFrame:
    """(user_id, gap_id, vote, note, addressed_by, pursue, updated_at): each (user, gap) after every batch that patches it.

    A patch sets the fields that it has and empties those that its ``clear`` (array of names) holds; '' empties
    as well, null leaves as it is.  Patches count in the order of (updated_at, event_id), whenever they come.
    Each field is the one of the latest patch that touches it, so the state is an aggregate; for update or complete mode.
    """
    none = {"note": F.lit(None).cast("string"), "addressed_by": F.lit(None).cast("string"), "clear": F.lit(None).cast("array<string>")}
    rows = log.select("user_id", "gap_id", "vote", "pursue", "updated_at", "event_id", *[F.col(c) if c in log.columns else v.alias(c) for c, v in none.items()])
    order = F.struct("updated_at", "event_id")

    def latest(field: str) -> Column:
        cleared = F.coalesce(F.array_contains("clear", field), F.lit(False))
        value = F.struct(F.when(~cleared, F.nullif(F.col(field), F.lit(""))).alias("value"))
        return F.max_by(value, F.when(F.col(field).isNotNull() | cleared, order))["value"].alias(field)

    pursue = F.max_by(F.coalesce("pursue", F.lit(False)), order).alias("pursue")
    return rows.groupBy("user_id", "gap_id").agg(*[latest(c) for c in FEEDBACK_FIELDS], pursue, F.max("updated_at").alias("updated_at"))


def drained(stream: DataFrame, checkpoint: str, path: str, mode: str = "append", each=None) -> None:
    """Runs a stream over all input that is there and ends.

    Every batch is written to a folder of its own, by its number and in place of what is there, so a batch
    that is run again after a loss leaves no row twice; ``each`` may turn a batch's rows into others first.
    Rows carry their batch (in update mode the last state of a key is in its last batch).
    """

    def save(batch: DataFrame, number: int) -> None:
        (batch if each is None else each(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(save).start().awaitTermination()
