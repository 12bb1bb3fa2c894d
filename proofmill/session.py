"""Session set-up for local use, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "proofmill", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set to a temporary one only where that is unset."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = kept.get() if kept.isDefined() else None
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and a Python stage
    that feeds several branches runs once. The table is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more, before the driver exits."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        _remove(df.sparkSession, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="proofmill-src-")) / "proofmill.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("proofmill") / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, over at least as many partitions as there are cores; a large one already has them."""
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def map_arrow(df: DataFrame, fn: Callable, schema: str, spread: bool = True) -> DataFrame:
    """``mapInArrow`` with this package at hand on every executor.

    ``spread``: a plain scan of fewer partitions than there are cores is spread over all of them first. Must be
    off for a ``df`` with shuffles of its own, which would run just to be counted.
    """
    ship(df.sparkSession)
    return (_spread(df) if spread else df).mapInArrow(fn, schema)


_spread = spread
