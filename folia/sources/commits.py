"""Names of finished batches beside the tables they wrote: what has no name there isn't read, and a batch is done once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Token of each finished batch by its number, in order."""
    fs, at = place(spark, f"{path}/commits")
    if not fs.exists(at):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return {int(n): token for n, token in (name.split("-", 1) for name in names if name[0].isdigit())}


def commit(spark: SparkSession, path: str, number: int, token: str) -> None:
    fs, at = place(spark, f"{path}/commits/{number:09d}-{token}")
    fs.create(at, False).close()
