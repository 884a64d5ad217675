"""Tables that all executors can read, and sessions' folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset a new one, but only for a session in one JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(spark.sparkContext, "_provgraph_shared", None)
        if not where:
            where = spark.sparkContext._provgraph_shared = "file://" + tempfile.mkdtemp(prefix="provgraph-")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = getattr(spark.sparkContext, "_provgraph_made", None)
    if made is None:
        made = spark.sparkContext._provgraph_made = []
    made.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes what this session's operators have put in the shared folder; call it when their
    results have been written, since results read these tables when they are computed."""
    made = getattr(spark.sparkContext, "_provgraph_made", [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    n = len(made)
    made.clear()
    return n


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what follows does not
    depend on executors' local files, and is not computed again."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
