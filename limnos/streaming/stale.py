"""Silences of the live feed by keyed event-time timers (st_stale of a stream).

Each station is a key of a `transformWithState` operator.  Its state is the first
and last reading of each day, kept in a map of chunks of days, of which a batch
reads and writes once those that it has readings of or next to, and one timer 24
hours after the newest reading.  The clock is the watermark without delay: the newest reading of all
stations.  A timer that fires before a newer reading came opens an alert; a later
reading closes it, and a late reading that lies inside a silence withdraws or
splits it.  Late readings are never discarded, because the column that carries the
watermark does not reach the operator.

The operator's output is a log of changes, a folder an epoch, written again as it
was when an epoch is executed again.  Its rows follow the changes and not the
state.  `current_stale` takes the newest version of each silence and equals the
batch result after any order of files, to the millisecond of the clock.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources import files
from .live import ingest_stream, state_store

DAY_MICROS = 24 * 3600 * 10**6
CHUNK = 64  # days of a station that are one entry of its state: an access costs far more than the entry's length
CHANGES = "station_id long, latest long, next long, live boolean, version long"


class Silences(StatefulProcessor):
    """Changes of a station's silences; times are microseconds."""

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "chunk int", "day array<int>, first array<long>, last array<long>")
        # alerted: the reading whose open silence has an alert
        self.about = handle.getValueState("about", "oldest int, newest int, version long, alerted long")

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, tuple[int, int]] = {}
        for r in rows:
            first, last = fresh.get(r.day, (r.at, r.at))
            fresh[r.day] = min(first, r.at), max(last, r.at)
        found = self.about.get()
        oldest, newest, version, alerted = found or (min(fresh), min(fresh), 0, None)
        held, changed, changes = {}, set(), []

        def chunk(day):
            """The days with readings of the chunk that `day` is in: {day: (first, last)}."""
            c = day // CHUNK
            if c not in held:
                stored = self.days.getValue((c,)) if found and found[0] // CHUNK <= c <= found[1] // CHUNK else None
                held[c] = dict(zip(stored[0], zip(stored[1], stored[2]))) if stored else {}
            return held[c]

        def near(day, step, end):
            """The next day with readings before or after `day`, up to `end`."""
            day += step
            while (end - day) * step >= 0:
                days = chunk(day)
                if day in days:
                    return days[day]
                at = day // CHUNK * CHUNK
                day = day + step if days else at + CHUNK if step > 0 else at - 1
            return None
        before = chunk(newest)[newest][1] if found else None

        def silence(a, b, was):
            """The silence after `a` ends at `b` (None: open), where it ended at `was`; None if it did before as well."""
            nonlocal version
            had = a == alerted if was is None else was - a > DAY_MICROS
            live = b is not None and b - a > DAY_MICROS
            if had or live:
                version += 1
                changes.append(Row(station_id=key[0], latest=a, next=b, live=live, version=version))
        for day in sorted(fresh):
            first, last = fresh[day]
            old = chunk(day).get(day)
            if old:
                first, last = min(first, old[0]), max(last, old[1])
                if (first, last) == old:
                    continue
            previous = near(day, -1, oldest) if day > oldest else None
            following = near(day, 1, newest) if day < newest else None
            if previous and (not old or first != old[0]):
                silence(previous[1], first, old[0] if old else following and following[0])
            if not old or last != old[1]:
                ends = following and following[0]
                if old:  # nothing is silent after the former last reading of the day
                    silence(old[1], last, ends)
                if ends is not None:
                    silence(last, ends, last)
            chunk(day)[day] = first, last
            changed.add(day // CHUNK)
            oldest, newest = min(oldest, day), max(newest, day)
        for c in changed:
            days = sorted(held[c])
            self.days.updateValue((c,), (days, [held[c][d][0] for d in days], [held[c][d][1] for d in days]))
        now = chunk(newest)[newest][1]
        if now != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(now))
        self.about.update((oldest, newest, version, alerted))
        return iter(changes)

    @staticmethod
    def _due(at: int) -> int:
        return (at + DAY_MICROS) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        oldest, newest, version, _ = self.about.get()
        last = self.days.getValue((newest // CHUNK,))[2][-1]  # the newest day is the last of its chunk
        if expiredTimerInfo.getExpiryTimeInMs() != self._due(last):
            return iter([])
        self.about.update((oldest, newest, version + 1, last))
        return iter([Row(station_id=key[0], latest=last, next=None, live=True, version=version + 1)])

    def close(self) -> None:
        pass


def changes(readings: DataFrame) -> DataFrame:
    """The change log of a stream of (station_id, timestamp) readings."""
    timed = readings.where(F.col("timestamp").isNotNull() & F.col("station_id").isNotNull()).withColumn("clock", F.col("timestamp").cast("timestamp")).withWatermark("clock", "0 seconds")
    at = F.unix_micros("clock")
    plain = timed.select("station_id", at.alias("at"), F.expr("cast(unix_micros(clock) div 86400000000 as int)").alias("day"))
    return plain.groupBy("station_id").transformWithState(statefulProcessor=Silences(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def run_stale(spark: SparkSession, drop_dir: str, out_dir: str, max_files: int = 10, batch_bytes: int = 0) -> str:
    """Process everything in the drop dir (availableNow) and return the path of the change log."""
    log = posixpath.join(out_dir, "stale")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(posixpath.join(log, f"epoch={epoch}"))
    with state_store(spark):  # timers and maps need it
        q = (changes(ingest_stream(spark, drop_dir, max_files, batch_bytes)).writeStream.outputMode("update").foreachBatch(per_batch)
             .option("checkpointLocation", posixpath.join(out_dir, "_stale_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return log


def current_stale(spark: SparkSession, log: str) -> DataFrame:
    """A row per station and silence of more than 24 hours; next_timestamp is null while it lasts."""
    newest = spark.read.schema(CHANGES).parquet(log).groupBy("station_id", "latest").agg(F.max_by(F.struct("next", "live"), "version").alias("s"))

    def time(c):
        return F.timestamp_micros(c).cast("timestamp_ntz")
    return newest.where("s.live").select("station_id", time("latest").alias("latest_timestamp"), time("s.next").alias("next_timestamp"),
                                         F.lit("Live Stale Data Alert").alias("alert_type"), F.lit("Warning").alias("severity"),
                                         F.lit("Live data is older than 24 hours.").alias("reason"))
