"""Session helpers: the shared checkpoint folder and durable cuts of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM ``local`` master may fall back to a temporary folder;
    on a cluster a missing setting is an error rather than a silent local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = "file://" + tempfile.mkdtemp(prefix="arcweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Like ``checkpoint()`` this cuts lineage durably (a lost executor costs
    nothing), but the copy is columnar and prunable. Nullability aside, the
    schema is unchanged. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arcweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
