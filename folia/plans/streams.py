"""Queries that run as streams over the event log, and the sinks they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.catalog import register
from folia.operators import metering, worklist
from folia.plans.retrieval import ATTEMPTS, attempts_of
from folia.sources import digests
from folia.sources.folders import shared
from folia.sources.tables import moment, table
from folia.streaming import queue, sinks

L = "long"


@register("str1_queue_state_machine")
def str1(s, d):
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("other")
    rows = queue.stream(s, d, "events").select(F.col("user_id").alias("document_id"), moment("ts").alias("t"), kind.alias("event"))
    return queue.written_out(queue.queue(rows), shared(s, "queue"))


TIMERS = """
WITH RECURSIVE e AS (SELECT user_id AS id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'other' END AS event FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, event) AS k FROM e),
m AS (SELECT max(t) // 1000 AS mark FROM e),
s(id, k, t, cause, status, attempts, due) AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', 'gone', 0, CAST(0 AS BIGINT) FROM e
  UNION ALL SELECT id, k, t, cause, status, attempts, CASE WHEN timer THEN 0 WHEN status = was AND attempts = tried THEN due WHEN status = 'failed' AND attempts < 3 THEN t + CASE attempts WHEN 1 THEN 60000000 ELSE 300000000 END WHEN status IN ('failed', 'completed') THEN t + 604800000000 ELSE 0 END
  FROM (SELECT id, CASE WHEN timer THEN k ELSE k + 1 END AS k, CASE WHEN timer THEN due ELSE next END AS t, timer, due, was, tried,
      CASE WHEN timer AND was = 'failed' AND tried < 3 THEN 'retry' WHEN timer THEN 'expiry' ELSE event END AS cause,
      CASE WHEN timer AND was = 'failed' AND tried < 3 THEN 'queued' WHEN timer THEN 'gone' WHEN event = 'enqueue' AND was NOT IN ('processing', 'completed') THEN 'queued'
        WHEN event = 'start' AND was IN ('queued', 'failed') AND tried < 3 THEN 'processing' WHEN event = 'done' AND was = 'processing' THEN 'completed' WHEN event = 'error' AND was = 'processing' THEN 'failed' ELSE was END AS status,
      CASE WHEN NOT timer AND event = 'start' AND was IN ('queued', 'failed') AND tried < 3 THEN tried + 1 ELSE tried END AS attempts
    FROM (SELECT s.id, s.k, s.due, o.t AS next, o.event, CASE WHEN status = 'gone' THEN 'queued' ELSE status END AS was, CASE WHEN status = 'gone' THEN 0 ELSE attempts END AS tried,
        s.due > 0 AND (s.due <= o.t OR (o.t IS NULL AND s.due // 1000 < mark)) AS timer
      FROM s CROSS JOIN m LEFT JOIN o ON o.id = s.id AND o.k = s.k + 1) WHERE timer OR next IS NOT NULL))
SELECT id AS document_id, make_timestamp(t) AS "at", cause, status, attempts FROM s WHERE t > 0"""


@register("str1_queue_with_timers", TIMERS)
def str1_timers(s, d):
    """Each event and each timer of the queue: retries that fire by themselves, and finished documents that expire."""
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("other")
    rows = queue.stream(s, d, "events").select(F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("event"))
    return queue.written_out(queue.timed_queue(rows), shared(s, "timers")).withColumn("at", F.col("at").cast("timestamp_ntz"))


@register("str3_enqueue_once", """
WITH i AS (SELECT user_id * 10 + event_id % 10 AS document_id, user_id AS case_id, * FROM events),
f AS (SELECT document_id, case_id, min_by(i, (ts, event_id)) AS x FROM i GROUP BY 1, 2)
SELECT document_id, case_id, x.event_id || '.pdf' AS filename, x.event_type AS document_type, round(x.value * 100)::BIGINT AS file_size, coalesce(c_name, 'sin_rol') AS rol, coalesce(x.props, '{}') AS doc_metadata
FROM f LEFT JOIN customer ON c_custkey = case_id AND c_custkey % 3 <> 0""")
def str3(s, d):
    """Documents that are inserted again and again, in three batches of which the last comes twice, are queued once with the metadata of the first."""
    folder, case = shared(s, "enqueue"), F.col("user_id").alias("case_id")
    columns = ["ts", "event_id", (F.col("user_id") * 10 + F.col("event_id") % 10).alias("document_id"), case, "user_id", F.lit("bucket").alias("storage_path")]
    inserts = table(s, d, "events").select(*columns, F.concat(F.col("event_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("event_type").alias("document_type"), F.round(F.col("value") * 100).alias("file_size"), F.lit("sync").alias("source"), F.col("props").alias("metadata"))
    put = sinks.enqueue(folder, table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("rol")), ("ts", "event_id"))
    days = ("2024-01-11", "2024-01-21", "2024-02-01")
    for number in (0, 1, 2, 2):
        at = F.col("ts") < F.lit(days[number]).cast("timestamp_ntz")
        after = F.col("ts") >= F.lit(days[number - 1]).cast("timestamp_ntz") if number else F.lit(True)
        put(inserts.where(at & after), number)
    return sinks.finished(s, folder, sinks.QUEUED).select("document_id", "case_id", "metadata.filename", "metadata.document_type", "metadata.file_size", "metadata.rol", "metadata.doc_metadata")


@register("str3_deduplicated_stream", "SELECT user_id * 10 + event_id % 10 AS document_id, min(event_id) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id * 10 + event_id % 10) AS first FROM events) WHERE ts = first GROUP BY 1")
def str3_stream(s, d):
    """The first insert of each document as a stream: state is kept for as long as rows may come late."""
    rows = queue.stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("user_id") * 10 + F.col("event_id") % 10).alias("document_id"))
    firsts = queue.written_out(queue.once(rows, "document_id"), shared(s, "firsts"))
    known = table(s, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("document_id"), "ts", "event_id")
    first = known.groupBy("document_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return firsts.select("document_id").join(first, "document_id")


@register("str4_resumed_work", """
SELECT doc_id, CASE WHEN doc_id % 13 = 1 OR doc_id % 7 = 1 THEN 'skipped' ELSE 'done' END AS outcome,
  CASE WHEN doc_id % 13 = 1 THEN 'unsupported_format' WHEN doc_id % 7 = 1 THEN 'max_retries' END AS skip_reason,
  CASE WHEN doc_id % 13 = 1 THEN 0 WHEN doc_id % 7 = 1 THEN 3 WHEN doc_id % 5 = 1 THEN 2 ELSE 0 END AS attempts FROM documents""")
def str4_resumed(s, d):
    """Tasks of each source under a budget of characters a batch, resumed until none waits: some fail twice, some always, some can't be read."""
    tasks = table(s, d, "documents").select("source", "doc_id", "n_chars")

    def work(rows):
        t, tries = F.col("doc_id"), F.col("attempts")
        return rows.withColumn("result", F.when(t % 13 == 1, "unsupported_format").when((t % 7 == 1) | ((t % 5 == 1) & (tries < 2)), "failed").otherwise("done"))

    done = worklist.resume(tasks, shared(s, "work"), work, 1_000_000, group="source", order="doc_id", size="n_chars")
    return done.select("doc_id", "outcome", "skip_reason", "attempts")


@register("str4_leftover_tasks", """
SELECT source, status, count(*) AS n FROM (SELECT source, CASE WHEN sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 50000 THEN 'done' ELSE 'pending' END AS status FROM documents) GROUP BY 1, 2""")
def str4(s, d):
    return queue.with_leftover(table(s, d, "documents"), 50_000, "n_chars", "doc_id", "source").groupBy("source", "status").agg(F.count("*").alias("n"))


@register("str5_rate_limit_stream")
def str5(s, d):
    rows = queue.stream(s, d, "events").select("user_id", moment("ts").alias("t"))
    return queue.written_out(queue.limiter(rows, 2, 86_400.0), shared(s, "limiter"))


@register("snk3_rewrite_by_partition")
def snk3(s, d):
    """Delete-then-insert of one document's chunks is an overwrite of its partition; others stay as they are."""
    folder = shared(s, "chunks")
    docs = table(s, d, "documents").select("lang", "doc_id", "n_chars")
    docs.write.partitionBy("lang").parquet(folder)
    again = docs.where("lang = 'es'").withColumn("n_chars", -F.col("n_chars"))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(folder)
    return s.read.schema("doc_id long, n_chars long, lang string").parquet(folder)


@register("snk6_batch_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk6(s, d):
    """A foreachBatch sink that drains its source even where a consumer has gone; all batches come twice and count once."""
    folder = shared(s, "sink")
    put = sinks.once(folder, lambda batch, number: batch.groupBy("event_type").agg(F.count("*").alias("n")))
    for turn in range(2):  # the second run has lost its checkpoint
        sinks.drain(queue.stream(s, d, "events").select("event_type"), put, f"{folder}/checkpoint-{turn}")
    return sinks.finished(s, folder, "event_type string, n long").groupBy("event_type").agg(F.sum("n").alias("n"))


@register("flt7_format_sniff", "SELECT page_id, CASE WHEN substring(html, 1, 4) = '%PDF' THEN 'pdf' WHEN substring(html, 1, 2) = 'PK' THEN 'zip' WHEN substring(html, 1, 2) = '<!' THEN 'html' ELSE 'unknown' END AS format FROM pages")
def flt7(s, d):
    magic = F.hex(F.substring(F.col("html").cast("binary"), 1, 4))
    kind = F.when(magic == "25504446", "pdf").when(F.startswith(magic, F.lit("504B")), "zip").when(F.startswith(magic, F.lit("D0CF")), "ole2").when(F.startswith(magic, F.lit("3C21")), "html").otherwise("unknown")
    return table(s, d, "pages").select("page_id", kind.alias("format"))


@register("src3_object_store_files")
def src3(s, d):
    """Files of a store with their bytes' digests, written and read as objects."""
    folder = shared(s, "objects")
    table(s, d, "pages").select("html").write.option("maxRecordsPerFile", 100).text(folder)
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select("length", F.sha2("content", 256).alias("sha256"))


@register("met3_counters_as_stream", ATTEMPTS + " SELECT user_id, action, count(*) AS asked, count(*) FILTER (verdict = 'denied') AS denied, max(lifetime_count) AS counter FROM y GROUP BY 1, 2")
def met3_stream(s, d):
    """The counters of attempts that come as a stream."""
    rows = metering.counted_stream(attempts_of(queue.stream(s, d, "events")))
    done = queue.written_out(rows, shared(s, "counters")).groupBy("user_id", "action")
    return done.agg(F.count("*").alias("asked"), F.count_if(F.col("verdict") == "denied").alias("denied"), F.max("lifetime_count").alias("counter"))


@register("dup2_digest_of_files")
def dup2_files(s, d):
    """Files of the pages, a hundred pages each: whole digests up to 64 KB, those of both ends beyond, and how much was read."""
    folder = shared(s, "files")
    table(s, d, "pages").select("html").write.option("maxRecordsPerFile", 100).text(folder)
    return digests.file_digests(s, folder, "*.txt", 8192, 65_536).select("size", "digest", "bytes_read")
