"""Sessions: builder defaults and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="floeberg-"), "floeberg_src.zip")  # read by the driver's own file server
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, "floeberg")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
        for name in ("corpus_pipeline.py",):
            if os.path.exists(os.path.join(_ROOT, name)):
                out.write(os.path.join(_ROOT, name), name)
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution and partitions that fit it."""
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]")
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
