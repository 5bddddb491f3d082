"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Application id -> folder of its intermediate tables.
_folders: dict[str, str] = {}
#: Paths of the tables settled since the innermost ``settle_last`` began.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="mapweave-")), "mapweave.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; on a local master without one, a temporary folder.

    It goes when the driver's Python ends, as far as the session still lives then.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        found = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if found:
            folder = f"{found.rstrip('/')}/mapweave-{app}"
            atexit.register(_at_end, folder)
        elif master == "local" or master.startswith("local["):
            made = tempfile.mkdtemp(prefix="mapweave-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = f"file://{made}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = folder
    return _folders[app]


def _at_end(folder: str) -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            _delete(spark, folder)
    except Exception:  # the JVM may have ended before
        return


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._settled_at = path
    if (paths := _on_the_way.get()) is not None:
        paths.append(path)
    return made


def settle_last(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a settled table; all tables settled on the way to it go then, so nothing else may read them."""
    outer = _on_the_way.set([])
    try:
        last = settle(make())
        paths = _on_the_way.get()
    finally:
        _on_the_way.reset(outer)
    for path in paths[:-1]:
        _delete(last.sparkSession, path)
    if (before := _on_the_way.get()) is not None:
        before.append(paths[-1])
    return last


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        _delete(df.sparkSession, path)
