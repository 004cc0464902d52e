"""Queries of the relational base: sources, sinks, filters, joins, aggregations, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folia.catalog import register
from folia.functions.folds import admitted
from folia.operators.upserts import batches, duplicates, fill_in, insert_new, latest, upsert
from folia.operators.budget import greedy
from folia.operators.ranks import numbered
from folia.sources.tables import extracted, first_complete, moment, now, optional, scoped, table

L, D = "long", "double"


def count(name="n"):
    return F.count("*").alias(name)


@register("src1_scan_filter_project", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'es'")
def src1(s, d):
    return table(s, d, "documents").where("lang = 'es'").select("doc_id", "source", "n_chars")


@register("src2_case_fan_out", """
SELECT 'case' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'order', o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7
UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7""")
def src2(s, d):
    own = scoped(table(s, d, "orders"), 7, "o_custkey")
    case = scoped(table(s, d, "customer"), 7, "c_custkey").select(F.lit("case").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    lines = table(s, d, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return case.unionByName(own.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))).unionByName(lines.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label")))


@register("src5_extracted_text_cleanup", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g'))) AS clean_md5, length(trim(regexp_replace(text, '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g'))) AS n FROM documents")
def src5(s, d):
    clean = extracted(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast(L).alias("n"))


@register("src6_extraction_fallback", """
SELECT method, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN n_chars > 2000 THEN 'native' WHEN lang IN ('en','es') THEN 'cloud_ocr' WHEN n_chars > 500 THEN 'local_ocr' ELSE 'failed' END AS method FROM documents) GROUP BY method""")
def src6(s, d):
    n = F.col("n_chars")
    empty = F.lit("")
    method = first_complete(("native", F.when(n > 2000, F.col("text")).otherwise(empty)), ("cloud_ocr", F.when(F.col("lang").isin("en", "es"), F.col("text")).otherwise(empty)), ("local_ocr", F.when(n > 500, F.col("text")).otherwise(empty)))
    return table(s, d, "documents").select(method.alias("method"), "n_chars").groupBy("method").agg(count(), F.sum("n_chars").alias("chars"))


@register("src7_ocr_page_batches", """
SELECT doc_id, (page - 1) // 15 AS batch_no, count(*) AS pages, min(page) AS first_page FROM (SELECT doc_id, unnest(range(1, (n_chars + 299) // 300 + 1)) AS page FROM documents) GROUP BY 1, 2""")
def src7(s, d):
    pages = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast(L), F.ceil(F.col("n_chars") / 300))).alias("page"))
    return pages.groupBy("doc_id", F.floor((F.col("page") - 1) / 15).alias("batch_no")).agg(count("pages"), F.min("page").alias("first_page"))


@register("src8_all_pages_readable", """
SELECT doc_id, count(*) AS pages, bool_and(length(trim(page)) > 10) AS complete FROM (SELECT doc_id, substring(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS page FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS i FROM documents)) GROUP BY doc_id""")
def src8(s, d):
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 1000).cast("int") - 1))
    page = F.substring("text", F.col("i") * 1000 + 1, F.lit(1000))
    return table(s, d, "documents").where("length(text) > 0").select("doc_id", "text", at.alias("i")).groupBy("doc_id").agg(count("pages"), F.bool_and(F.length(F.trim(page)) > 10).alias("complete"))


@register("snk1_upsert", """
WITH new AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice FROM orders WHERE o_orderkey % 7 = 0)
SELECT * FROM new UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def snk1(s, d):
    old = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    new = new.unionByName(old.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice"))
    return upsert(old, new, ["o_orderkey"])


@register("snk2_insert_on_conflict_nothing", "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)")
def snk2(s, d):
    return insert_new(table(s, d, "documents").select("doc_id"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct(), ["doc_id"])


@register("snk4_wipe_case_children_first", """
SELECT 'lineitem' AS tbl, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE NOT o_custkey % 3 = 0""")
def snk4(s, d):
    gone = table(s, d, "orders").where("o_custkey % 3 = 0").select("o_orderkey")
    lines = table(s, d, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    rest = table(s, d, "orders").join(gone, "o_orderkey", "left_anti")
    return lines.agg(count()).select(F.lit("lineitem").alias("tbl"), "n").unionByName(rest.agg(count()).select(F.lit("orders").alias("tbl"), "n"))


@register("snk5_fill_in_non_empty", """
SELECT c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 AND c.c_custkey % 6 <> 0 THEN 'NEW' ELSE c.c_mktsegment END AS c_mktsegment, c.c_name FROM customer c""")
def snk5(s, d):
    old = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    new = old.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, "").otherwise("NEW").alias("c_mktsegment"))
    return fill_in(old, new, "c_custkey", ["c_mktsegment"])


@register("snk7_cascade_delete_plan", """
SELECT o_custkey, (rn - 1) // 100 AS batch_no, count(*) AS n FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0) GROUP BY 1, 2""")
def snk7(s, d):
    free = table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    own = table(s, d, "orders").join(free, "o_custkey", "left_semi")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(own, "o_orderkey")
    return batches(lines, ["o_custkey"], ["o_orderkey", "l_linenumber"]).groupBy("o_custkey", "batch_no").agg(count())


@register("flt1_optional_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY event_type")
def flt1(s, d):
    return optional(table(s, d, "events"), event_type="click", user_id=None).groupBy("event_type").agg(count())


@register("flt2_tenant_scope", "SELECT event_id, event_type FROM events WHERE user_id = 42")
def flt2(s, d):
    return scoped(table(s, d, "events"), 42).select("event_id", "event_type")


@register("flt3_retry_eligibility", """
SELECT event_id, attempts FROM (SELECT event_id, event_id % 5 AS attempts, ts FROM events WHERE event_type = 'error' AND (event_id % 3 = 0 OR ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-31 00:00:00') ORDER BY ts, event_id LIMIT 10) WHERE attempts < 3""")
def flt3(s, d):
    due = (F.col("event_id") % 3 == 0) | (F.col("ts") + F.expr("interval 5 days") <= now())
    first = table(s, d, "events").where((F.col("event_type") == "error") & due).orderBy("ts", "event_id").limit(10)
    return first.select("event_id", (F.col("event_id") % 5).alias("attempts")).where("attempts < 3")


@register("flt4_status_in_list", "SELECT count(*) AS n FROM events WHERE event_type IN ('signup','error')")
def flt4(s, d):
    return table(s, d, "events").where(F.col("event_type").isin("signup", "error")).agg(count())


@register("flt5_reaper_idle_users", """
SELECT user_id, max(ts) AS last_active FROM events WHERE user_id % 4 = 0 GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 HOUR""")
def flt5(s, d):
    last = table(s, d, "events").where("user_id % 4 = 0").groupBy("user_id").agg(F.max("ts").alias("last_active"))
    return last.where(F.col("last_active") < now() - F.expr("interval 30 hours"))


@register("flt6_file_validation_chain", r"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(html) < 1500 THEN 'too_small' WHEN regexp_matches(url, 'utm_source|cheap-pills') THEN 'url_blocked' WHEN substring(html, 1, 9) <> '<!DOCTYPE' THEN 'bad_magic' ELSE 'ok' END AS reason FROM pages) GROUP BY reason""")
def flt6(s, d):
    reason = F.when(F.length("html") < 1500, "too_small").when(F.col("url").rlike("utm_source|cheap-pills"), "url_blocked").when(F.substring("html", 1, 9) != "<!DOCTYPE", "bad_magic").otherwise("ok")
    return table(s, d, "pages").groupBy(reason.alias("reason")).agg(count())


@register("flt8_keyword_any_match", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'idiot')""")
def flt8(s, d):
    words = F.array(*map(F.lit, ("license", "copyright", "idiot")))
    return table(s, d, "documents").where(F.exists(words, lambda w: F.contains(F.lower("text"), w))).select("doc_id")


@register("flt9_drop_unidentified", """
SELECT conv_id, turn FROM conversations WHERE coalesce(nullif(trim(role), ''), nullif(trim(text), '')) IS NOT NULL AND length(text) > 20""")
def flt9(s, d):
    ident = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    return table(s, d, "conversations").where(ident.isNotNull() & (F.length("text") > 20)).select("conv_id", "turn")


@register("prj1_context_chunk_fallback", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, lang) AS label, CASE WHEN doc_id % 5 = 0 THEN n_chars ELSE doc_id % 5 END AS folio FROM documents""")
def prj1(s, d):
    own = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    folio = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5)  # an empty or zero value falls through too
    return table(s, d, "documents").select("doc_id", F.coalesce(own, "lang").alias("label"), F.coalesce(folio, "n_chars").alias("folio"))


@register("prj2_three_layer_metadata", """
SELECT d.doc_id, i, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS kind, coalesce(l.toxic, -1) AS flag, d.source AS court FROM (SELECT *, unnest([0,1]) AS i FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def prj2(s, d):
    chunks = table(s, d, "documents").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return chunks.join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "i", F.coalesce(F.col("quality").cast("string"), "lang").alias("kind"), F.coalesce("toxic", F.lit(-1)).alias("flag"), F.col("source").alias("court"))


@register("jon1_inner_two_joins", """
SELECT o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1""")
def jon1(s, d):
    own = table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(s, d, "orders").join(own, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(s, d, "lineitem").join(orders, "l_orderkey").groupBy("o_orderstatus").agg(count(), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@register("jon2_inner_join", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon2(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@register("jon3_left_one_to_one", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon3(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "toxic")


@register("jon4_inner_with_child_predicate", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def jon4(s, d):
    return table(s, d, "documents").join(table(s, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id", "source")


@register("jon5_left_join_count_zero_filled", """
SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def jon5(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count())
    return table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@register("jon8_anti_known_hash", """
SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id < a.doc_id AND b.text = a.text)""")
def jon8(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("jon9_drop_chunks_of_key_documents", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def jon9(s, d):
    key = table(s, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return table(s, d, "embeddings").join(key, "vec_id", "left_anti").select("vec_id")


@register("jon10_as_of_interval", """
SELECT e.event_id, max(s.ts) AS section_start FROM events e LEFT JOIN events s ON e.user_id = s.user_id AND s.event_type = 'signup' AND s.ts <= e.ts GROUP BY e.event_id""")
def jon10(s, d):
    """Backward as-of join by one window: the last section start at or before each event."""
    starts = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return table(s, d, "events").select("event_id", starts.alias("section_start"))


@register("jon11_page_of_offset", """
SELECT doc_id, place, CASE WHEN n_chars > 1000 THEN place // 1000 + 1 END AS page FROM (SELECT doc_id, n_chars, unnest([0, n_chars // 2, n_chars - 1]) AS place FROM documents WHERE n_chars > 0)""")
def jon11(s, d):
    n = F.col("n_chars")
    bounds = F.sequence(F.lit(0).cast(L), n - 1, F.lit(1000).cast(L))
    docs = table(s, d, "documents").where("n_chars > 0").select("doc_id", bounds.alias("b"), F.explode(F.array(F.lit(0).cast(L), F.floor(n / 2), n - 1)).alias("place"))
    page = F.size(F.filter("b", lambda x: x <= F.col("place"))).cast(L)
    return docs.select("doc_id", "place", F.when(F.size("b") > 1, page).alias("page"))


@register("jon12_name_contains_first_match", """
SELECT p_partkey, min(b) AS brand FROM part JOIN (SELECT DISTINCT p_brand AS b, split_part(p_type, ' ', 1) AS w FROM part) ON contains(p_type, w) GROUP BY p_partkey""")
def jon12(s, d):
    part = table(s, d, "part")
    words = part.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("w")).agg(F.min("p_brand").alias("b"))
    types = part.select("p_type").distinct()  # the words and types are few, whatever the number of parts
    brands = types.join(words, F.contains("p_type", F.col("w"))).groupBy("p_type").agg(F.min("b").alias("brand"))
    return part.join(brands, "p_type").select("p_partkey", "brand")


@register("jon13_regex_key_lookup", r"""
SELECT page_id, n_name FROM pages JOIN nation ON CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) % 25 = n_nationkey WHERE regexp_extract(url, '/(\d+)', 1) <> ''""")
def jon13(s, d):
    key = F.regexp_extract("url", r"/(\d+)", 1)
    pages = table(s, d, "pages").where(key != "").select("page_id", (key.cast(L) % 25).cast("int").alias("n_nationkey"))
    return pages.join(table(s, d, "nation"), "n_nationkey").select("page_id", "n_name")


@register("jon14_positional_citations", """
SELECT conv_id, turn, i AS cited, item_id FROM (SELECT conv_id, turn, unnest([turn % 40, length(text) % 40]) AS i FROM conversations) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark) ON i = pos WHERE item_id % 4 <> 0""")
def jon14(s, d):
    cited = table(s, d, "conversations").select("conv_id", "turn", F.explode(F.array(F.col("turn") % 40, (F.length("text") % 40).cast(L))).alias("cited"))
    context = numbered(table(s, d, "benchmark"), "n", "item_id").select("item_id", (F.col("n") - 1).alias("cited"))
    return cited.join(context, "cited").where("item_id % 4 <> 0").select("conv_id", "turn", "cited", "item_id")


@register("jon15_tree_assembly", """
SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def jon15(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = table(s, d, "orders").join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "lines")).alias("orders"))
    total = F.aggregate("orders", F.lit(0).cast(L), lambda a, o: a + F.size(o["lines"]))
    return table(s, d, "customer").join(orders, "c_custkey").select("c_custkey", F.size("orders").cast(L).alias("orders"), total.alias("lines"), F.array_join(F.array_sort(F.array_distinct("orders.o_orderstatus")), ",").alias("statuses"))


@register("jon17_tolerant_match", """
SELECT c_custkey, count(s_suppkey) AS matches, min(s_suppkey) AS first_match FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS t FROM customer) LEFT JOIN (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE ' building ' END AS u FROM supplier) ON c_nationkey = s_nationkey AND (t IS NULL OR u IS NULL OR lower(trim(t)) = lower(trim(u))) GROUP BY c_custkey""")
def jon17(s, d):
    """How many suppliers each customer matches, a missing name on either side matching any: suppliers meet as counts by name."""
    name = lambda c: F.lower(F.trim(c))
    a = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), name(F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))).alias("t"))
    b = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), name(F.when(F.col("s_suppkey") % 3 != 0, F.lit(" building "))).alias("u"))
    all_, some, named = (F.count("*"), F.count_if(F.col("u").isNull()), F.min(F.when(F.col("u").isNull(), F.col("s_suppkey"))))
    by_nation = b.groupBy("k").agg(all_.alias("n"), F.min("s_suppkey").alias("least"), some.alias("n0"), named.alias("least0"))
    by_name = b.where("u IS NOT NULL").groupBy("k", F.col("u").alias("t")).agg(F.count("*").alias("n1"), F.min("s_suppkey").alias("least1"))
    rows = a.join(by_nation, "k", "left").join(by_name, ["k", "t"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    matches = F.when(F.col("t").isNull(), zero("n")).otherwise(zero("n0") + zero("n1"))
    return rows.select("c_custkey", matches.cast(L).alias("matches"), F.when(F.col("t").isNull(), F.col("least")).otherwise(F.least("least0", "least1")).alias("first_match"))


@register("agg1_status_counts", """
SELECT count(*) AS total, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view_n FROM events""")
def agg1(s, d):
    of = lambda k: F.count_if(F.col("event_type") == k)
    return table(s, d, "events").agg(count("total"), of("signup").alias("signup"), of("error").alias("error"), of("click").alias("click"), of("view").alias("view_n"))


@register("agg2_count_per_parent", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def agg2(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(count())


@register("agg3_duplicate_finder", "SELECT coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(event_type, '') AS event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def agg3(s, d):
    return duplicates(table(s, d, "events"), ["user_id", "event_type"])


@register("agg4_floored_max", "SELECT user_id, greatest(max(value), 0.001) AS top FROM events GROUP BY user_id")
def agg4(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.greatest(F.max("value"), F.lit(0.001)).alias("top"))


@register("agg5_chunk_statistics", """
SELECT lang, count(*) AS n, CAST(floor(avg(t) + 0.5) AS BIGINT) AS mean_tokens, min(t) AS least, max(t) AS most, CAST(sum(t) AS BIGINT) AS total FROM (SELECT lang, (length(text) + 4) // 5 AS t FROM documents) GROUP BY lang""")
def agg5(s, d):
    t = F.ceil(F.length("text") / 5)
    return table(s, d, "documents").select("lang", t.alias("t")).groupBy("lang").agg(count(), F.floor(F.avg("t") + 0.5).alias("mean_tokens"), F.min("t").alias("least"), F.max("t").alias("most"), F.sum("t").alias("total"))


@register("agg6_confidence_histogram", """
SELECT count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.7 AND c < 0.9) AS middle, count(*) FILTER (c < 0.7) AS low FROM (SELECT 0.5 + l_discount * 5 AS c FROM lineitem)""")
def agg6(s, d):
    c = F.col("c")
    return table(s, d, "lineitem").select((F.lit(0.5) + F.col("l_discount") * 5).alias("c")).agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("middle"), F.count_if(c < 0.7).alias("low"))


@register("agg7_changes_by_category", """
SELECT l_returnflag AS category, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1""")
def agg7(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))


@register("agg8_set_membership", "SELECT user_id, bool_or(event_type = 'purchase') AS buys, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def agg8(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("buys"), F.size(F.collect_set("event_type")).cast(L).alias("kinds"))


@register("agg9_batch_summary", """
SELECT source, CAST(sum(n_chars) AS BIGINT) AS size, count(*) FILTER (n_chars < 1000) AS small, count(*) FILTER (n_chars >= 1000 AND n_chars < 10000) AS medium, count(*) FILTER (n_chars >= 10000) AS large, bool_or(n_chars >= 10000) AS confirm FROM documents GROUP BY source""")
def agg9(s, d):
    n = F.col("n_chars")
    return table(s, d, "documents").groupBy("source").agg(F.sum(n).alias("size"), F.count_if(n < 1000).alias("small"), F.count_if((n >= 1000) & (n < 10000)).alias("medium"), F.count_if(n >= 10000).alias("large"), F.bool_or(n >= 10000).alias("confirm"))


@register("agg10_more_chunks_than_vectors", """
SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderkey % 4 > coalesce(n, 0)""")
def agg10(s, d):
    n = table(s, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(count())
    return table(s, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).where("o_orderkey % 4 > n")


@register("agg11_token_totals", """
SELECT role, count(*) AS messages, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens, round(sum((length(text) + 3) // 4) / 1e6 * 3.0, 6) AS cost FROM conversations GROUP BY role""")
def agg11(s, d):
    t = F.ceil(F.length("text") / 4)
    return table(s, d, "conversations").groupBy("role").agg(count("messages"), F.sum(t).alias("tokens"), F.round(F.sum(t) / 1e6 * 3.0, 6).alias("cost"))


@register("agg12_usage_counters", """
SELECT user_id, count(*) AS lifetime, count(*) FILTER (ts >= TIMESTAMP '2024-01-15 00:00:00') AS monthly FROM events GROUP BY user_id""")
def agg12(s, d):
    return table(s, d, "events").groupBy("user_id").agg(count("lifetime"), F.count_if(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("monthly"))


@register("agg13_availability_sets", """
SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def agg13(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"), F.size(F.collect_set("l_partkey")).cast(L).alias("parts"))


@register("agg14_corpus_report", r"""
SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(length(trim(regexp_replace(text, '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g')))) AS BIGINT) AS clean_chars, count(*) FILTER (contains(text, '|')) AS tabular FROM documents GROUP BY lang""")
def agg14(s, d):
    return table(s, d, "documents").groupBy("lang").agg(count("docs"), F.sum(F.length("text")).alias("raw_chars"), F.sum(F.length(extracted(F.col("text")))).alias("clean_chars"), F.count_if(F.contains("text", F.lit("|"))).alias("tabular"))


@register("win1_section_end", """
SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-31 00:00:00') AS ends FROM events""")
def win1(s, d):
    return table(s, d, "events").select("event_id", F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), now()).alias("ends"))


@register("win2_latest_per_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def win2(s, d):
    return latest(table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@register("win3_first_per_key", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def win3(s, d):
    return latest(table(s, d, "documents"), ["source"], "doc_id").select("source", "doc_id")


@register("win4_best_confidence", "SELECT l_orderkey, max_by(l_linenumber, (l_discount, -l_linenumber)) AS line, max(l_discount) AS confidence FROM lineitem GROUP BY 1")
def win4(s, d):
    best = F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber")))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(best.alias("line"), F.max("l_discount").alias("confidence"))


@register("win5_latest_five", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r <= 5")
def win5(s, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(s, d, "events").where("event_type = 'purchase'").withColumn("r", rank).where("r <= 5").select("user_id", "event_id")


@register("win7_latest_conversation", "SELECT role, max_by(conv_id, (turn, conv_id)) AS conv_id FROM conversations GROUP BY role")
def win7(s, d):
    return latest(table(s, d, "conversations"), ["role"], F.desc("turn"), F.desc("conv_id")).select("role", "conv_id")


@register("win8_sliding_window_limiter")
def win8(s, d):
    """Two requests a user and day; what is rejected isn't logged, so a window's count would be wrong."""
    times = table(s, d, "events").select("user_id", moment("ts").alias("t")).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return times.select("user_id", F.size("t").cast(L).alias("requests"), F.size(admitted(F.col("t"), 2, 86_400.0)).cast(L).alias("admitted"))


@register("win9_greedy_budget", """
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f(source, k, doc_id, free, taken) AS (
  SELECT source, k, doc_id, 20000 - CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END, n_chars <= 20000 FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.k, o.doc_id, free - CASE WHEN n_chars <= free THEN n_chars ELSE 0 END, n_chars <= free FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS ctx_pos FROM f WHERE taken""")
def win9(s, d):
    """Documents of a source in order, within a budget of 20,000 characters; too large ones are skipped."""
    return greedy(table(s, d, "documents").where("source IS NOT NULL"), 20_000, "source", ["doc_id"], "n_chars").select("source", "ctx_pos", "doc_id")


@register("top1_top_k_by_distance", "SELECT part.p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1200), p_partkey LIMIT 10")
def top1(s, d):
    return table(s, d, "part").orderBy(F.abs(F.col("p_retailprice") - 1200), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@register("top2_top_k_by_rank", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top2(s, d):
    return table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@register("top3_over_fetch_and_rerank", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) ORDER BY (lang = 'es') DESC, n_chars DESC, doc_id LIMIT 5")
def top3(s, d):
    first = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return first.orderBy(F.desc(F.col("lang") == "es"), F.desc("n_chars"), "doc_id").limit(5).select("doc_id", "n_chars")


@register("top4_history_limit", "SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn LIMIT 50")
def top4(s, d):
    return table(s, d, "conversations").orderBy(F.desc("conv_id"), "turn").limit(50).select("conv_id", "turn")


@register("top5_stable_sort_by_offset", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_shipdate, l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1")
def top5(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_returnflag")))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(ordered.alias("x")).select("l_orderkey", F.array_join("x.l_returnflag", "").alias("flags"))


@register("top6_sort_children", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS folios FROM orders GROUP BY 1")
def top6(s, d):
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(keys, " ").alias("folios"))


@register("set1_key_difference", """
SELECT 'added' AS change, doc_id FROM labels WHERE doc_id % 2 = 0 AND quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'removed', doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0 AND quality = 1)""")
def set1(s, d):
    new, old = table(s, d, "labels").where("doc_id % 2 = 0 and quality = 1"), table(s, d, "labels").where("toxic = 1")
    return new.join(old, "doc_id", "left_anti").select(F.lit("added").alias("change"), "doc_id").unionByName(old.join(new, "doc_id", "left_anti").select(F.lit("removed").alias("change"), "doc_id"))


@register("set2_ordered_concat", "SELECT 0 AS branch, n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region")
def set2(s, d):
    return table(s, d, "nation").select(F.lit(0).alias("branch"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(table(s, d, "region").select(F.lit(1).alias("branch"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("label")))


@register("set3_context_concat", """
SELECT row_number() OVER (ORDER BY prio, id) AS ctx_pos, kind, id FROM (SELECT 0 AS prio, 'structured' AS kind, CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT 1, 'inventory', item_id FROM benchmark UNION ALL SELECT 2, 'rag', vec_id FROM embeddings WHERE label = 2)""")
def set3(s, d):
    parts = [("structured", table(s, d, "region").select(F.col("r_regionkey").cast(L).alias("id"))), ("inventory", table(s, d, "benchmark").select(F.col("item_id").alias("id"))), ("rag", table(s, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("id")))]
    whole = None
    for prio, (kind, rows) in enumerate(parts):
        rows = rows.select(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), "id")
        whole = rows if whole is None else whole.unionByName(rows)
    return numbered(whole, "ctx_pos", "id", "prio").select("ctx_pos", "kind", "id")


@register("set4_distinct_insertion", "SELECT DISTINCT source, lang FROM documents")
def set4(s, d):
    return table(s, d, "documents").select("source", "lang").distinct()


@register("set5_skip_embedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def set5(s, d):
    return table(s, d, "documents").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
