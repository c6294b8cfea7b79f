"""Tables written to cut lineage, in the folder that all executors share.

Lost executors cost nothing here: a written table is read again from the shared folder, while a
cached block or a local checkpoint would be gone. The folder is the session's
``spark.checkpoint.dir``; only where that is unset (tests on one machine) is a folder of our own made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; on a cluster that names none, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="lockfleet-")
        atexit.register(__import__("shutil").rmtree, _fallback["dir"], True)
    return "file://" + _fallback["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again; its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` that no later step reads."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
