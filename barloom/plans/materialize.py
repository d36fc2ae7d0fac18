"""Tables written between the stages of one operator, and joins whose broadcast side is measured first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast when it has at most so many rows of at most so many bytes each; else the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_ROW_BYTES = 256


#: Tables written so far, deleted when the driver ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and the master is local, as in tests, one
    of our own; on a cluster a folder of one machine would lose what the others write, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, urlparse(folder).path, True)
    return folder.rstrip("/")


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before us
            if urlparse(path).scheme in ("", "file"):
                shutil.rmtree(urlparse(path).path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there is deleted when the driver ends, wherever it lies."""
    path = f"{shared_folder(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and no lost executor takes it along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int = BROADCAST_ROW_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its rows and its bytes are measured and found within the bound.

    Beyond the bound the frame comes back without a hint and the join is a shuffle join, which
    adaptive execution splits where keys are hot. Pass a written() table, or what is soon computed from one.
    """
    texts = [c for c, t in small.dtypes if t in ("string", "binary")]
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts), F.lit(0))
    n, long = small.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(small) if n <= rows and long + 8 * n * len(small.columns) <= rows * row_bytes else small
