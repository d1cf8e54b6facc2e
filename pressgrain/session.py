"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "pressgrain", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; extra settings come in as keywords with `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, so that its Python functions load there wherever the driver was started."""
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    if not any(os.path.basename(f).startswith(f"{name}-") for f in spark.sparkContext.listFiles):
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), f"{name}-{uuid.uuid4().hex[:12]}")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(root), name))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster. Where none is configured, a local master gets a temporary one, and any
    other raises an error, since its executors would each write to a disk of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured and not re.fullmatch(r"local(\[[^]]*])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh subfolder of the shared checkpoint folder for one stream's output and progress."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
