"""Sessions: UTC, filter pushdown into Python sources, the journal source registered."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from inkwell.sources.journal import source

CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def builder() -> SparkSession.Builder:
    b = SparkSession.builder
    for k, v in CONF.items():
        b = b.config(k, v)
    return b


def enable(spark: SparkSession) -> SparkSession:
    """The journal source and its settings in an existing session, with the hashes and codecs registered so far."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    spark.dataSource.register(source())
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see. Where it is unset a local master gets a
    temporary folder; a cluster, whose machines don't share one, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not held.isDefined():  # the setting itself cannot be changed in a running session
            context.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
            held = context._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, unless their Python finds it already."""
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    context = spark.sparkContext
    if any(Path(p).resolve() == root for p in known) or getattr(context, "_inkwell_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="inkwell-"), "inkwell.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "inkwell").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(path)
    context._inkwell_shipped = True
    return spark
