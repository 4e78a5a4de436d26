"""Spark session helpers.

The library never creates global state; callers pass a ``SparkSession``.
``get_session`` is a convenience for tests, the bench and local runs: it turns
on AQE (runtime coalescing, skew-join splitting, broadcast by measured size)
and only fills in a checkpoint directory when the cluster has not named one.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Broadcast only sides whose measured size is below this bound; anything
# larger falls back to a shuffle join chosen by Catalyst / AQE.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "limnos") -> SparkSession:
    master = master or os.environ.get("LIMNOS_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("LIMNOS_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LIMNOS_DRIVER_MEMORY", "4g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder that the cluster names in spark.checkpoint.dir, set as the context's checkpoint folder.

    Where it is unset, a local session (tests, a laptop) gets a scratch folder of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(conf_dir)
        return conf_dir
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="limnos-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    context.setCheckpointDir(local)
    return local
