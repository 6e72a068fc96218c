"""Spark sessions for tests, the benchmark and the command line."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Set on a local session that names no shared folder.
_OWN = "millrace.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a local session that names none gets one of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get(_OWN, None)
    if own is None:
        own = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_OWN, own)
    return own


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: once per application it goes to them as a zip file."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.join(os.path.basename(root), os.path.relpath(file, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def local_session(cores: str | int = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A local session with adaptive execution and a UTC clock."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
