"""Writers of results. ``mode("overwrite")`` removes what an earlier run left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.tiles import descaled, scale_factor

#: Header of the cluster file, a fixed value.
CLUSTER_HEADER = ("Cluster Number", "X-Position", "Y-Position")


def cluster_table(clusters: DataFrame, precision: float | None) -> DataFrame:
    """Numbers from 1, and positions; without a precision the tile numbers themselves."""
    if precision is None:
        x, y = F.col("tx"), F.col("ty")
    else:
        x, y = (descaled(F.col(c), scale_factor(precision)) for c in ("tx", "ty"))
    return clusters.select((F.col("label") + 1).alias("cluster_number"), x.alias("x"), y.alias("y"))


def write_clusters(clusters: DataFrame, path: str, precision: float | None = None, header: bool = True) -> None:
    out = cluster_table(clusters, precision).toDF(*CLUSTER_HEADER)
    out.write.mode("overwrite").option("header", header).option("sep", ", ").csv(path)


def write_descriptions(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def append_record(record: DataFrame, path: str) -> None:
    """Bench records, fields parted by semicolons; arrays as JSON."""
    plain = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in record.dtypes]
    record.select(*plain).coalesce(1).write.mode("append").option("header", True).option("sep", ";").csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path``, a file or a folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
