"""Shared intermediate storage.

Iterative plans cut their lineage by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``. Every executor and the driver see that folder, so a table written there
survives the loss of any executor.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, about, of a batch that Spark hands to a Python worker; its buffers lie outside the heap.
BATCH_BYTES = 4 << 20
#: A table of up to so many rows of a few numbers each is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may do without: it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="tilewright-")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above it starts at that table.

    What :func:`discard` has not deleted before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _located(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilewright_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tilewright_path", None)
        if path:
            target, files = _located(df.sparkSession, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)


def _located(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def hinted(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, one that :func:`materialize` made, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run, and bound their batches by bytes."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(batch).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(batch, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if getattr(context, "_tilewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    path = f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
    stream.write(held.getvalue())
    stream.close()
    context.addPyFile(path)
    context._tilewright_shipped = True
