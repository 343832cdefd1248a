"""Where intermediate tables are kept, and how a table is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where none is set, a local master (tests on one machine) takes a folder below the
    system's temporary directory; on a cluster that is an error, as lost executors
    could not be replaced.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    import tempfile

    return f"{tempfile.gettempdir()}/lexgrove-checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder; lineage ends there.

    What is drawn at run time (bounds of a range partitioning, partition numbers) is the
    same for everything that reads the result.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store; one that is not there is none to delete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
