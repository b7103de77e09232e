"""Path checks through the file system Spark itself uses."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read, on whatever file system it names."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a path, on whatever file system it names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return [status.getPath().getName() for status in system.listStatus(folder)]


def data_version(spark: SparkSession, folder: str) -> tuple[str, str, tuple]:
    """A key for what was derived from a folder of tables: application, folder, time and size of each table."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = sorted(
        (s.getPath().getName(), s.getModificationTime(), system.getContentSummary(s.getPath()).getLength())
        for s in system.listStatus(parent)
    )
    return spark.sparkContext.applicationId, folder, tuple(tables)
