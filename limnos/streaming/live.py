"""Live feed as Structured Streaming.

readStream(JSON drop dir, declared schema)
  -> st_ingest projection (canonical parameter, numeric value), and from it
       * readings: a log of each batch's readings, one folder per epoch; of a
         reading that a batch has twice the one with the smallest event_id;
       * latest: a streaming aggregation by (station, parameter) in update mode;
       * stations: one by station, with the latest value of every parameter and
         the metadata, scored as it changes.

The aggregations keep their state in Spark's state store, which writes the changes
of a batch.  Their output, too, is only what changed: it is appended to a change
log (`sources/versions.py`) whose newest row a key is the table.  So a batch costs
what it brings, and alerts are derived from the scored row of a station, which is
rewritten when one of its readings came; only their age test has a clock, the newest
event time, and is evaluated when they are read.

Nothing depends on the order or the size of the batches: there is no watermark, so
a late reading is never discarded, and every aggregate is a maximum over (timestamp,
event_id) keys.  An epoch's folder is overwritten when it is executed again.
Silences are found by timers (`streaming/stale.py`).
"""

from __future__ import annotations

import contextlib
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import live as LV
from ..sources import files
from ..sources.versions import ChangeLog

META = ["station_no", "station_name", "state", "latitude", "longitude"]
READING_KEY = ["station_id", "parameter", "timestamp"]
#: State beyond the heap, and a state checkpoint of what a batch changed.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store's settings while a query starts; the session's own are put back."""
    held = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BATCH_BYTES = 1 << 30  # what a batch of a large drop folder holds: its fixed costs then follow the bytes, not the number of files


def files_per_batch(spark: SparkSession, drop_dir: str, least: int, batch_bytes: int) -> int:
    """How many files of the drop folder make a batch of about `batch_bytes`, `least` at least."""
    count, size = files.folder_size(spark, drop_dir)
    return max(least, -(-batch_bytes * count // size)) if size else least


def ingest_stream(spark: SparkSession, drop_dir: str, max_files: int = 10, batch_bytes: int = 0) -> DataFrame:
    """Readings of the drop folder; a batch has `max_files` files, or as many as hold `batch_bytes` if those are more."""
    raw = (spark.readStream.schema(files.LIVE_SCHEMA).option("maxFilesPerTrigger", files_per_batch(spark, drop_dir, max_files, batch_bytes))
           .option("timestampNTZFormat", files.TS_FORMAT).option("recursiveFileLookup", True).json(drop_dir))
    return LV.ingest(raw)


def _key():
    return F.struct("timestamp", "event_id")


def _newest(value: str, condition=None):
    """Latest non-null `value` (of the rows that meet the condition)."""
    there = F.col(value).isNotNull() if condition is None else condition & F.col(value).isNotNull()
    return F.max_by(value, F.when(there, _key()))


def latest_rows(readings: DataFrame) -> DataFrame:
    """Latest value and text of every station and parameter."""
    return readings.groupBy("station_id", "parameter").agg(
        F.max("timestamp").alias("latest_timestamp"), _newest("value_numeric").alias("latest_value"), _newest("value").alias("latest_value_text"))


def station_rows(readings: DataFrame) -> DataFrame:
    """Latest value of every known parameter and metadata of each station."""
    return readings.groupBy("station_id").agg(
        *[_newest(c).alias(c) for c in META], F.max("timestamp").alias("latest_timestamp"),
        *[_newest("value_numeric", F.col("parameter") == p).alias(p) for p in K.LIVE_PARAMS])


def scored(stations: DataFrame) -> DataFrame:
    return LV.live_predictions(LV.completed(stations))


def once(batch: DataFrame) -> DataFrame:
    """One row of each (station, parameter, timestamp): the one with the smallest event_id."""
    rest = [c for c in batch.columns if c not in READING_KEY]
    return (batch.groupBy(*READING_KEY).agg(F.min_by(F.struct(*rest), "event_id").alias("r"))
            .select(*[F.col(c) if c in READING_KEY else F.col(f"r.{c}").alias(c) for c in batch.columns]))


def logs(spark: SparkSession, out_dir: str) -> dict[str, ChangeLog]:
    return {"state": ChangeLog(spark, posixpath.join(out_dir, "state"), ["station_id", "parameter"]),
            "stations": ChangeLog(spark, posixpath.join(out_dir, "stations"), ["station_id"])}


def run_live(spark: SparkSession, drop_dir: str, out_dir: str, max_files: int = 10, parts=("readings", "state", "stations"),
             batch_bytes: int = 0) -> dict:
    """Process everything in the drop dir (availableNow) with the wanted parts and return the tables' paths."""
    feed, changed = ingest_stream(spark, drop_dir, max_files, batch_bytes), logs(spark, out_dir)
    readings = posixpath.join(out_dir, "readings")
    jobs = {"readings": (feed, lambda batch, epoch: once(batch).write.mode("overwrite").parquet(posixpath.join(readings, f"epoch={epoch}"))),
            "state": (latest_rows(feed), lambda batch, epoch: changed["state"].append(batch, epoch)),
            "stations": (station_rows(feed), lambda batch, epoch: changed["stations"].append(scored(batch), epoch))}
    for name in parts:
        stream, work = jobs[name]
        with state_store(spark):
            q = (stream.writeStream.outputMode("append" if name == "readings" else "update").foreachBatch(work)
                 .option("checkpointLocation", posixpath.join(out_dir, f"_{name}_checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
    return {"readings": readings, "out": out_dir}


def readings(spark: SparkSession, paths: dict) -> DataFrame:
    """All readings of the log; one that was delivered again in a later batch counts once (its smallest event_id)."""
    return once(spark.read.parquet(paths["readings"]).drop("epoch"))


def current_state(spark: SparkSession, paths: dict) -> DataFrame:
    return logs(spark, paths["out"])["state"].read()


def current_alerts(spark: SparkSession, paths: dict) -> DataFrame:
    """Alerts of all stations as of the newest event time, from their scored rows."""
    stations = logs(spark, paths["out"])["stations"].read()
    return LV.live_alerts(stations, stations.select(F.max("latest_timestamp")).scalar())
