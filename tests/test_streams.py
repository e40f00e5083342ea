"""Streams with late rows, restarted batches, idle users and patches that clear."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from corpusgap.streaming import jobs


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.ROCKSDB)
    yield
    spark.conf.set(name, before)


class Landing:
    """A folder that rows land in, and what a stream over it has given."""

    def __init__(self, spark, folder, schema, make, mode, each=None):
        self.spark, self.folder, self.schema, self.make, self.mode, self.each = spark, str(folder), schema, make, mode, each

    def land(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self.drain()

    def drain(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        jobs.drained(self.make(source), f"{self.folder}/state", f"{self.folder}/out", self.mode, self.each)
        return self.rows()

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").drop("batch").collect()), key=str)

    def forget_last_commit(self):
        """As after a driver that was lost between a batch's output and its commit."""
        last = max(glob.glob(f"{self.folder}/state/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
        os.remove(last)
        for crc in glob.glob(f"{self.folder}/state/commits/.*.crc"):
            os.remove(crc)


def at(day, hour=0, month=1):
    return dt.datetime(2024, month, day, hour)


def test_days_are_final_once_and_late_rows_dont_count(spark, tmp_path):
    s = Landing(spark, tmp_path, "created_at timestamp, topic string", jobs.daily_searches, "append")
    assert s.land((at(1, 1), "a"), (at(1, 2), "b"), (at(2, 3), "a")) == []
    days = s.land((at(1, 9), "in time"), (at(4, 1), "a"))
    assert days == [(dt.date(2024, 1, 1), 3), (dt.date(2024, 1, 2), 1)]
    days = s.land((at(1, 5), "too late"), (at(9), "a"))
    assert days == [(dt.date(2024, 1, 1), 3), (dt.date(2024, 1, 2), 1), (dt.date(2024, 1, 4), 1)]
    s.forget_last_commit()
    assert s.drain() == days


def test_the_best_topics_of_a_final_window(spark, tmp_path):
    s = Landing(spark, tmp_path, "created_at timestamp, topic string", jobs.trending_windows, "append", lambda batch: jobs.top_of_windows(batch, 2))
    assert s.land(*[(at(10, h), t) for h, t in enumerate("aaabbc")], (at(10), " ")) == []
    found = s.land((at(28), "z"))
    assert found == sorted(((at(10) - dt.timedelta(days=k), t, n) for k in range(7) for t, n in (("a", 3), ("b", 2))), key=str)
    s.forget_last_commit()
    assert s.drain() == found


def test_idle_users_leave_the_ring_without_new_rows(spark, tmp_path, rocks):
    s = Landing(spark, tmp_path, "user_id long, external_id string, ts timestamp", lambda log: jobs.seen_ring(log, newest=2, days=21), "update")
    s.land((1, "p", at(1)), (1, "q", at(2)), (1, "p", at(3)), (2, "x", at(3)))
    assert s.rows() == [(1, "p", at(3), False), (1, "q", at(2), False), (2, "x", at(3), False)]
    s.land((1, "r", at(20)))  # the ring holds two; q goes, p is within 21 days
    assert {r for r in s.rows() if r[0] == 1} == {(1, "p", at(3), False), (1, "q", at(2), False), (1, "r", at(20), False)}
    assert s.land((3, "y", at(27))) and [r[0] for r in s.rows() if r[3]] == [2]
    s.land((3, "y", at(20, month=2)))
    assert sorted(r[0] for r in s.rows() if r[3]) == [1, 2]
    s.land((2, "w", at(21, month=2)))  # a user that comes back begins anew
    assert [r for r in s.rows() if r[0] == 2 and r[2] > at(10, month=2)] == [(2, "w", at(21, month=2), False)]


def test_patches_set_and_clear(spark, tmp_path, rocks):
    schema = "user_id long, gap_id string, vote string, pursue boolean, updated_at timestamp, event_id long, note string, addressed_by string, clear array<string>"
    s = Landing(spark, tmp_path, schema, jobs.feedback_fold, "update")
    s.land((1, "g", "up", False, at(1), 1, "first", "p1", None), (1, "g", None, True, at(2), 2, None, None, None), (1, "h", "up", False, at(1), 3, None, None, None))
    assert (1, "g", "up", "first", "p1", True, at(2)) in s.rows()
    s.land((1, "g", None, False, at(3), 4, "second", None, ["vote", "addressed_by"]), (1, "h", "", True, at(2), 5, None, None, []))
    last = [tuple(r)[:-1] for r in spark.read.parquet(f"{tmp_path}/out").filter(F.col("updated_at") >= F.lit(at(2))).collect()]
    assert (1, "g", None, "second", None, False, at(3)) in last and (1, "h", None, None, None, True, at(2)) in last
    s.land((1, "g", "down", True, at(2, 5), 6, None, "p2", None))  # older than what cleared it
    assert s.rows().count((1, "g", None, "second", None, False, at(3))) == 2
