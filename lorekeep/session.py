"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine counts on; sizes of partitions are the cluster's to set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_shipped: set[str] = set()
_scratch: list[str] = []


def session(name: str = "lorekeep", **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` come on top, with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once per application.

    Spark's own file server carries them, so nothing needs a shared path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="lorekeep-py-"), "lorekeep.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where Spark runs in this very process may that be unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="lorekeep-"))
        top = _scratch[0]
    return f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}"
