"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app_name: str = "creditpath", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides any of them.

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    caller; adaptive execution coalesces and splits shuffle partitions by size.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording the call site of every column expression takes longer than planning the queries.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if master.startswith("local"):
        # Keep all threads busy although shuffles are small.
        settings["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = "64k"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app_name)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, since executors elsewhere cannot read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = os.path.join(tempfile.gettempdir(), "creditpath-" + spark.sparkContext.applicationId)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no other run uses."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
