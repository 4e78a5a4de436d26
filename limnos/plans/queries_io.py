"""Registered queries: file sources/sinks and the streaming live job.

Inputs are derived from the given tables by Spark and staged under the shared
checkpoint folder; the queries then read them back through the file sources.
"""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources import files as FS
from ..sources.versions import VersionedTable
from ..streaming import live as ST
from ..streaming import stale as SL
from . import datasets as D

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def _tag(sf):
    return re.sub(r"[^A-Za-z0-9.]+", "_", sf.strip("/"))


def _json_drop(spark, sf):
    path = FS.scratch_path(spark, "stage", _tag(sf), f"live_json-{D.input_key(spark, sf)}")
    return FS.stage_once(spark, path, lambda p: FS.write_json_drop(B.live_feed(spark, sf), p))


def _csv_dir(spark, sf):
    path = FS.scratch_path(spark, "stage", _tag(sf), f"raw_csv-{D.input_key(spark, sf)}")
    return FS.stage_once(spark, path, lambda p: FS.write_csv_dir(B.raw_uploads(spark, sf), p))


@q
def src_live_json(spark, sf):
    return FS.read_live_json(spark, _json_drop(spark, sf))


def _upload_headers(columns):
    """Headers of the three uploads: the whole sheet; two columns swapped and a missing class; fewer columns, in
    another order, and a new one."""
    rest = [c for c in columns if c not in ("source_file", "BOD (mg/L)", "DO (mg/L)", "Class", "PH-Value")]
    swapped = ["BOD (mg/L)", *rest, "PH-Value", "DO (mg/L)"]
    new = [*reversed(rest), "DO (mg/L)", "BOD (mg/L)", "Class", F.concat(F.lit("lab "), F.col("station_id")).alias("Laboratory")]
    return {"upload_july.csv": [c for c in columns if c != "source_file"], "upload_august.csv": swapped, "upload_september.csv": new}


def _uploads(spark, sf):
    """The uploads in one folder, each with a header of its own."""
    path = FS.scratch_path(spark, "stage", _tag(sf), f"uploads-{D.input_key(spark, sf)}")
    raw = B.raw_uploads(spark, sf)
    FS.stage_once(spark, posixpath.join(path, "upload_september"), lambda _: FS.write_uploads(raw, path, _upload_headers(raw.columns)))
    return path


@q
def src_csv_dir(spark, sf):
    d = FS.read_csv_dir(spark, _uploads(spark, sf))
    # the folder above the part files is the upload
    return d.withColumn("source_file", F.url_decode(F.regexp_extract("file_path", "source_file=([^/]+)/", 1))).drop("file_path")


@q
def src_manifest(spark, sf):
    """The part files of a source as one upload: what does not depend on how Spark cut it."""
    m = FS.manifest(spark, _csv_dir(spark, sf))
    return m.groupBy("source_file").agg(
        F.sum("row_count").alias("row_count"), F.max("column_count").alias("column_count"), F.max("detected_encoding").alias("detected_encoding"),
        F.max("load_status").alias("load_status"), F.bool_or("duplicate_file_flag").alias("duplicate_file_flag"),
        F.max("inferred_state_from_filename").alias("inferred_state_from_filename"), F.max("likely_parameter_group").alias("likely_parameter_group"))


@q
def snk_tables(spark, sf):
    """The prediction table, published as a version of one table a data set; readers of the one before keep theirs."""
    path = FS.scratch_path(spark, "sink", _tag(sf), "predictions")
    pred = D.predictions(spark, sf).select("station_id", "sampling_date", "month", "available_compliance_label",
                                           "risk_score", "predicted_non_compliant")
    return VersionedTable(spark, path).write(pred, partition_by="month")


def _stream(spark, sf, part):
    out = FS.scratch_path(spark, "stream", _tag(sf), uuid.uuid4().hex[:12])
    return ST.run_live(spark, _json_drop(spark, sf), out, max_files=10, parts=(part,), batch_bytes=ST.BATCH_BYTES)


@q
def st_ingest(spark, sf):
    return ST.readings(spark, _stream(spark, sf, "readings")).select("event_id", "station_id", "parameter", "value_numeric",
                                                         "is_numeric_value")


@q
def st_latest(spark, sf):
    return ST.current_state(spark, _stream(spark, sf, "state")).select(
        "station_id", "parameter", "latest_timestamp", "latest_value", "latest_value_text")


@q
def st_alerts(spark, sf):
    return ST.current_alerts(spark, _stream(spark, sf, "stations"))


@q
def st_stale_stream(spark, sf):
    out = FS.scratch_path(spark, "stream", _tag(sf), uuid.uuid4().hex[:12])
    return SL.current_stale(spark, SL.run_stale(spark, _json_drop(spark, sf), out, max_files=10, batch_bytes=ST.BATCH_BYTES))
