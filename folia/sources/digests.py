"""Digests of files by what must be read of them: whole small ones, the two ends of large ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of an end, of the largest file that is read whole, and the sign of a digest of ends.
END, WHOLE, MARK = 1 << 20, 50 << 20, "p:"
#: Bytes that a task has in hand at a time.
STEP = 4 << 20


def digest(read: Callable[[int, int], bytes], size: int, end: int = END, whole: int = WHOLE) -> tuple[str, int]:
    """SHA-256 in lower-case hex, and how many bytes were read: of all bytes up to ``whole`` of them; beyond, after ``p:``, of the first
    ``end`` bytes, the last ones and the size in decimals.  ``read`` gives bytes from a place."""
    ranges = [(0, size)] if size <= whole else [(0, min(end, size)), (max(0, size - end), size)]
    total, seen = hashlib.sha256(), 0
    for start, stop in ranges:
        for at in range(start, stop, STEP):
            part = read(at, min(STEP, stop - at))
            if len(part) != min(STEP, stop - at):
                raise OSError("a file ended before its listed size")
            total.update(part)
            seen += len(part)
    if size <= whole:
        return total.hexdigest(), seen
    total.update(str(size).encode())
    return MARK + total.hexdigest(), seen


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", end: int = END, whole: int = WHOLE) -> DataFrame:
    """(path, size, digest, bytes_read) of the files of a folder that tasks can open by their address; files that can't be read
    have no digest.  Only names and sizes come from Spark's listing; bytes are read in ranges, so a file of any size needs
    little memory, and a large one little traffic.  Empty files aren't listed.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, size in zip(frame["path"], frame["size"], strict=True):
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as file:
                        out.append((path, size, *digest(lambda at, n, file=file: file.read_at(n, at), size, end, whole)))
                except (OSError, ValueError):
                    out.append((path, size, None, 0))
            yield pd.DataFrame(out, columns=["path", "size", "digest", "bytes_read"])

    return listed.mapInPandas(make, "path string, size long, digest string, bytes_read long")


def duplicates(digests: DataFrame) -> DataFrame:
    """(digest, trusted, keeper, copies) of digests that several files have; those of ends aren't trusted without a look at the whole files."""
    groups = digests.where("digest IS NOT NULL").groupBy("digest").agg(F.min("path").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    return groups.select("digest", (~F.startswith("digest", F.lit(MARK))).alias("trusted"), "keeper", "copies")
