"""Session helpers: a local session for tests and benches, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, name: str = "batchwright") -> SparkSession:
    """A local session with settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.cteRecursionLevelLimit", "300")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in tests, a new temporary one.

    Only a local master may fall back to a temporary folder: on a cluster its executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="batchwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths that ``release`` deletes, by application.
_written: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str, released: bool = False) -> str:
    """A path in the shared folder that nothing else uses; with ``released`` one that ``release`` deletes."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if released:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written for this application, and other paths made to be released;
    results that read them are void. They are kept until then, as lazy results may read them at any time. Returns how
    many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def materialize(df, name: str):
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name, released=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of a cluster import this package."""
    context = spark.sparkContext
    if getattr(context, "_batchwright_shipped", False):
        return
    import zipfile

    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    out = os.path.join(tempfile.mkdtemp(prefix="batchwright-zip-"), "batchwright.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    context.addPyFile(out)
    context._batchwright_shipped = True
