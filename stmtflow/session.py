"""Session helpers."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "stmtflow", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster spark-submit supplies the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    base = tempfile.mkdtemp(prefix="stmtflow-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stream output and state, below the shared folder the cluster names.

    Only a session of one process may fall back to a temporary folder of its own machine, which goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def _located(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it is."""
    store, where = _located(spark, path)
    return store.exists(where)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    store, where = _located(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this program's own."""
    store, where = _located(spark, path)
    store.delete(where, True)
