"""Session helpers."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_PACKAGE = Path(__file__).resolve().parent
_scratch: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers (once for each Spark application)."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:  # a batch of long texts stays small in a worker
        spark.conf.set(_BATCH, "8m")
    if getattr(sc, "_veilframe_shipped", None) != sc.applicationId:
        path = Path(tempfile.mkdtemp(prefix="veilframe-")) / "veilframe.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
        sc._veilframe_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``; the JVM removes it when it ends.

    Only a local session without that setting (tests, the bench) takes a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/veilframe-checkpoints"
    path = f"{base.rstrip('/')}/veilframe/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in a shared folder, read back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession, name)}/table"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    if (made := _scratch.get()) is not None:
        made.append(table)
    return table


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that are stored inside, for ``dropped`` when nothing reads them any more: a running stream stores some for each batch."""
    made: list[DataFrame] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)


def dropped(table: DataFrame) -> None:
    """Removes a stored table that nothing reads any more."""
    spark = table.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)
