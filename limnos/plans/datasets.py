"""Shared derived datasets of the monitoring jobs.

The canonical sample table (DM2) and the live feed (DM8) are the hand-over
points between stages of the jobs (E1 -> E2 -> E3).  They are written once per
input location as parquet tables under the shared checkpoint folder
(``spark.checkpoint.dir``) and read back by every downstream query: this cuts
the lineage (a lost executor never forces a recompute from raw events),
lets later filters prune by ``source_file`` partition, and keeps each query's
plan to its own work.  The storage key has a hash of all modules that can feed a
table and of the input files (names, sizes, times), so changed code or a grown
input derives a fresh table instead of reusing a stale one.
"""

from __future__ import annotations

import functools
import hashlib
import pathlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, live, standardize
from ..operators.registry import ModelStore
from ..sources import bindings
from ..sources import files as FS
from ..sources.tables import table
from ..sources.versions import VersionedTable

#: What a hand-over table may be made by: everything but oracles, streams and parts that no table reads.
CODE = ("*.py", "functions/*.py", "operators/*.py", "sources/*.py", "plans/*.py")


def code_key(root: pathlib.Path) -> str:
    """Changes whenever a module that can feed a hand-over table does."""
    found = sorted({p for pattern in CODE for p in root.glob(pattern)})
    return hashlib.md5("\n".join(f"{p.relative_to(root)} {p.read_text(encoding='utf-8')}" for p in found).encode()).hexdigest()[:10]


@functools.cache
def _code_key() -> str:
    return code_key(pathlib.Path(__file__).resolve().parents[1])


def _tag(sf: str) -> str:
    return re.sub(r"[^A-Za-z0-9.]+", "_", sf.strip("/"))


def input_key(spark: SparkSession, sf: str) -> str:
    """Changes whenever a file of the tables that the bindings read does."""
    return FS.input_key(spark, [f"{sf.rstrip('/')}/{t}.parquet" for t in bindings.TABLES])


def materialized(spark: SparkSession, sf: str, name: str, build, partition_by: str | None = None) -> DataFrame:
    """The table `name` of this code and input; it is written to a staged folder and published whole, and of two
    sessions that write it at once the first one's is taken."""
    table = VersionedTable(spark, FS.scratch_path(spark, "tables", _tag(sf), f"{name}-{_code_key()}-{input_key(spark, sf)}"))
    folder = table.current()
    if folder is None:
        def write(path):
            w = build().write
            (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        folder = table.publish(table.stage(write), first_only=True)
        _forget(spark, sf, name)
    return spark.read.parquet(folder)


def _forget(spark: SparkSession, sf: str, name: str, keep: int = 3) -> None:
    """Remove the tables of this name that older code or input made, but for the last ones."""
    base = FS.scratch_path(spark, "tables", _tag(sf))
    fs, p = FS._fs(spark, base)
    made = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if re.fullmatch(re.escape(name) + "-[0-9a-f]{10}-[0-9a-f]{12}", s.getPath().getName()))
    for _, old in made[:-keep]:
        FS.remove(spark, f"{base}/{old}")


def fingerprint(spark: SparkSession, sf: str) -> str:
    """Key of what is derived from this input by this code."""
    return f"{_code_key()}-{input_key(spark, sf)}"


def models(spark: SparkSession, sf: str) -> ModelStore:
    return ModelStore(spark, FS.scratch_path(spark, "models", _tag(sf)))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """DM2 canonical samples (materialised, partitioned by source file)."""
    df = materialized(spark, sf, "samples", lambda: bindings.samples(spark, sf), partition_by="source_file")
    return df.select(*bindings.SAMPLE_COLUMNS)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_samples(samples(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return labels.add_predictions(labelled(spark, sf))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct stations of the feed with their attributes (materialised dimension)."""
    def build():
        ids = table(spark, sf, "events").select(F.col("user_id").alias("station_id")).distinct()
        return bindings.station_dim(spark, sf, ids)
    return materialized(spark, sf, "stations", build)


def live_feed(spark: SparkSession, sf: str) -> DataFrame:
    """DM8 raw live feed (materialised)."""
    df = materialized(spark, sf, "live_feed", lambda: bindings.live_feed(spark, sf))
    return df.select(*bindings.LIVE_COLUMNS)


def raw_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """DM1 raw sheets of the uploads (materialised)."""
    return materialized(spark, sf, "raw_uploads", lambda: bindings.raw_uploads(spark, sf))


def canonical_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Expanded canonical table of the field and laboratory sheets, values as typed, united by name (materialised)."""
    def build():
        keep = ("source_file", "station_id")
        return standardize.map_canonical(raw_uploads(spark, sf), keep).unionByName(
            standardize.map_canonical(bindings.lab_uploads(spark, sf), keep), allowMissingColumns=True)
    return materialized(spark, sf, "canonical_uploads", build)


def live_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored live state of all stations (materialised: E3's hand-over to alerts and serving)."""
    return materialized(spark, sf, "live_predictions", lambda: live.live_predictions(live.live_state(live.ingest(live_feed(spark, sf)))))


def expanded(spark: SparkSession, sf: str) -> DataFrame:
    """DM3 labelled samples with the laboratory parameters (materialised)."""
    return materialized(spark, sf, "expanded", lambda: labelled(spark, sf).join(
        bindings.lab_samples(spark, sf), ["station_id", "sampling_date"], "left"))
