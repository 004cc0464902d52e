"""Sinks whose effects happen once, however often a batch comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.sources.commits import commit, commits


def once(folder: str, make: Callable[[DataFrame, int], DataFrame] = lambda batch, number: batch, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: rows of batch n are ``folder/rows/batch=n``, and hold once the batch's name is written.

    A batch that is replayed after that changes nothing; one that failed on the way is written anew over what
    it left.  Batches of streams of other names may go to the same folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, token = batch.sparkSession, f"{name}.{number}"
        done = commits(spark, folder)
        if token in done.values():
            return
        own = max(done, default=-1) + 1
        make(batch, own).write.mode("overwrite").parquet(f"{folder}/rows/batch={own}")
        commit(spark, folder, own, token)

    return put


def finished(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches that hold, with their batch."""
    done = commits(spark, folder)
    if not done:
        known = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return spark.createDataFrame([], T.StructType([*known.fields, T.StructField("batch", T.IntegerType())]))
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*(f"{folder}/rows/batch={n}" for n in done))


def drain(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Sends all that a stream has through a sink."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


QUEUED = "document_id long, case_id long, user_id long, metadata struct<storage_path:string,filename:string,document_type:string,file_size:long,source:string,rol:string,doc_metadata:string>"


def _metadata(rol: Column) -> Column:
    own = F.struct("storage_path", "filename", "document_type", F.col("file_size").cast("long").alias("file_size"), "source", F.coalesce(rol, F.lit("sin_rol")).alias("rol"), F.coalesce("metadata", F.lit("{}")).alias("doc_metadata"))
    return own.alias("metadata")


def enqueue(folder: str, cases: DataFrame, order: tuple[str, ...], name: str = "inserts") -> Callable[[DataFrame, int], None]:
    """A sink for inserted documents that puts each into the queue once, with what its processing needs to know.

    ``cases`` has (case_id, rol).  Of several inserts of a document the first in ``order`` counts, whatever batch they
    come in; one that is queued already is left as it is.  Inserts without a document_id aren't queued.
    """

    def make(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        known = finished(spark, folder, QUEUED).select("document_id")
        first = batch.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("x")).select("x.*")
        return first.join(known, "document_id", "left_anti").join(cases.select("case_id", "rol"), "case_id", "left").select("document_id", "case_id", "user_id", _metadata(F.col("rol")))

    return once(folder, make, name)
