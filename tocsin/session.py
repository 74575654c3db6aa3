"""A session with the settings that the operators count on, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tocsin", master: str | None = None, **conf: str) -> SparkSession:
    """UTC wall time, adaptive plans; `conf` keys take underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session, whose executors are this machine's, gets a folder
    that goes when the process ends; a cluster has no such place, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tocsin-")
        atexit.register(shutil.rmtree, folder, True)
        where = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
