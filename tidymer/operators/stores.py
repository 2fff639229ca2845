"""Tables written between the rounds of iterative operators, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='tidymer-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    sc, folder = spark.sparkContext, f"{shared_dir(spark)}/tidymer/{spark.sparkContext.applicationId}"
    if getattr(sc, "_tidymer_folder", None) != folder:
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._tidymer_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_persisted(df: DataFrame) -> None:
    """Delete the table behind a ``persisted`` frame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, path = _files(df.sparkSession, folder)
        files.delete(path, True)
