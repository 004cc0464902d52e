"""Queries of document processing: cleaning, sections, chunks, enrichment and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.catalog import register
from folia.functions import chunking, edits, html, normalise, page_choice, sections
from folia.sources.tables import cell, dealt, table

L = "long"


@register("nrm0_blank_short_circuit", "SELECT doc_id, length(trim(coalesce(text, ''))) = 0 AS blank FROM documents")
def nrm0(s, d):
    return table(s, d, "documents").select("doc_id", (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("blank"))


MARKED = """
p AS (SELECT doc_id, coalesce(text, '') AS text, greatest(1, (length(coalesce(text, '')) + 999) // 1000) AS n FROM documents),
i AS (SELECT doc_id, text, n, unnest(range(1, n + 1)) AS k FROM p),
m AS (SELECT *, substring(text, CAST(k * 1000 - 999 AS BIGINT), 1000) AS piece, '-- ' || k || ' of ' || n || ' --' AS mark FROM i),
b AS (SELECT *, sum(length(piece) + 1 + length(mark)) OVER (PARTITION BY doc_id ORDER BY k) + k - 1 AS stop, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k) + k - 1 AS clean_stop FROM m)"""


def _marked(s, d):
    """Texts with an invented page mark after every 1,000 characters."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000)).cast("int")
    piece = lambda k: F.concat(F.substring("text", (k - 1) * 1000 + 1, F.lit(1000)), F.lit(" -- "), k.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" -- "))
    return docs.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), n), piece), "").alias("text"))


@register("nrm1_page_boundaries", "WITH " + MARKED + " SELECT doc_id, CAST(0 AS BIGINT) AS page, CAST(0 AS HUGEINT) AS at FROM p UNION ALL SELECT doc_id, k, stop FROM b")
def nrm1(s, d):
    """Places just after each page break of the raw text, 0 first."""
    return edits.mapped(dealt(_marked(s, d), "doc_id")).select("doc_id", F.posexplode("pages").alias("page", "at"))


@register("nrm13_edit_map", "WITH " + MARKED + " SELECT doc_id, k - 1 AS edit, 'page_marker' AS kind, clean_stop AS at, mark AS content, stop - length(mark) AS raw_start, stop AS raw_stop FROM b")
def nrm13_edits(s, d):
    """What cleaning takes out of each text: its kind and content, and where it stood."""
    edit = F.posexplode("edits").alias("edit", "x")
    return edits.mapped(dealt(_marked(s, d), "doc_id")).select("doc_id", edit).select("doc_id", "edit", "x.*")


@register("nrm13_marks_from_last_to_first", "WITH " + MARKED + " SELECT doc_id, md5(string_agg(piece || ' ««page_marker»»' || mark || '««/page_marker»» ', '' ORDER BY k)) AS marked, md5(string_agg(piece || '  ', '' ORDER BY k)) AS clean FROM b GROUP BY doc_id")
def nrm13_marked(s, d):
    """The dry run over all kinds at once, and the clean text."""
    return edits.mapped(dealt(_marked(s, d), "doc_id"), marks=True).select("doc_id", F.md5("marked").alias("marked"), F.md5("clean").alias("clean"))


@register("chk7_page_of_clean_chunk", "WITH " + MARKED + """, c AS (SELECT doc_id, n, unnest(range(0, (length(text) + 2 * n + 3264) // 3265)) AS chunk_index FROM p)
SELECT c.doc_id, chunk_index, 1 + count(*) FILTER (b.clean_stop <= chunk_index * 3265) AS page FROM c JOIN b USING (doc_id) GROUP BY 1, 2""")
def chk7_pages(s, d):
    """The page that each chunk of the clean text begins on, by page breaks of the raw one."""
    maps = edits.mapped(dealt(_marked(s, d), "doc_id")).select("doc_id", F.length("clean").alias("n"), "clean_pages")
    at = F.explode(F.sequence(F.lit(0).cast(L), F.ceil(F.col("n") / 3265) - 1)).alias("chunk_index")
    return maps.select("doc_id", "clean_pages", at).select("doc_id", "chunk_index", edits.page_of(F.col("chunk_index") * 3265, F.col("clean_pages")).alias("page"))


@register("chk7_pages_of_chunks")
def chk7_real(s, d):
    """Chunks of the clean texts, at legal and sentence ends, with the page they begin on."""
    maps = edits.mapped(dealt(_marked(s, d), "doc_id"))
    paged = chunking.chunk(maps.select("doc_id", F.col("clean").alias("text"), "clean_pages"), keep=("clean_pages",), texts=False)
    return paged.withColumn("page", edits.page_of(F.col("start_offset"), F.col("clean_pages"))).drop("clean_pages")


@register("nrm2_signature_codes", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Z0-9]{5,20}')) AS codes, md5(regexp_replace(text, '[A-Z0-9]{5,20}', '', 'g')) AS rest FROM documents""")
def nrm2(s, d):
    code = normalise.SIGNATURE_CODE
    return table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(code)).cast(L).alias("codes"), F.md5(F.regexp_replace("text", code, "")).alias("rest"))


@register("nrm3_page_markers", r"""
SELECT doc_id, len(regexp_extract_all(text, '--\s*(\d{1,4})\s+of\s+(\d{1,4})\s*--')) AS markers, md5(regexp_replace(text, '--\s*(\d{1,4})\s+of\s+(\d{1,4})\s*--', '', 'g')) AS rest FROM documents""")
def nrm3(s, d):
    return table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(normalise.PAGE_MARKER)).cast(L).alias("markers"), F.md5(F.regexp_replace("text", normalise.PAGE_MARKER, "")).alias("rest"))


@register("nrm4_repeated_rol", r"SELECT doc_id, md5(regexp_replace(text, '[CEV]-\d{1,6}-\d{4}\s+Foja:\s*\d+', '', 'g')) AS rest FROM documents")
def nrm4(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(normalise.removed(F.col("text"), "repeated_rol")).alias("rest"))


@register("nrm5_header_metadata")
def nrm5(s, d):
    return table(s, d, "documents").select("doc_id", normalise.header(F.col("text")).alias("h")).select("doc_id", "h.*")


@register("nrm5_header_block", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS sheet, CASE WHEN doc_id % 2 = 0 THEN 'en palabras' END AS sheet_text, doc_id % 100 || ' Sentencia, 445 Mero trámite' AS nomenclatures,
  (doc_id % 30 + 1) || 'º Juzgado Civil de Santiago' AS court, 'C-' || doc_id % 999999 || '-2020' AS rol, 'PARTE ' || doc_id || '/BANCO S.A.' AS caption FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 5 = 0""")
def nrm5_block(s, d):
    """All fields of an invented header before each text but every fifth; a court's number has lost its sign or has it at the end of the name."""
    i = F.col("doc_id").cast("string")
    sheet = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("FOJA: "), i, F.lit(" .- en palabras .- "))).otherwise("")
    court = F.concat(((F.col("doc_id") % 30) + 1).cast("string"), F.when(F.col("doc_id") % 3 == 0, " Juzgado Civil de Santiago º").when(F.col("doc_id") % 3 == 1, "º Juzgado Civil de Santiago").otherwise(" Juzgado  Civil de Santiago"))
    made = F.concat(sheet, F.lit("NOMENCLATURA : 1. ["), (F.col("doc_id") % 100).cast("string"), F.lit("]Sentencia 2. [445]Mero trámite JUZGADO : "), court, F.lit(" CAUSA ROL : C-"), (F.col("doc_id") % 999999).cast("string"), F.lit("-2020 CARATULADO : PARTE "), i, F.lit("/BANCO S.A. Santiago, dos de enero. "))
    text = F.concat(F.when(F.col("doc_id") % 5 != 0, made).otherwise(""), F.coalesce("text", F.lit("")))
    h = table(s, d, "documents").select("doc_id", normalise.header_block(text).alias("h"))
    codes = F.array_join(F.transform("h.nomenclatures", lambda x: F.concat_ws(" ", x["code"].cast("string"), x["text"])), ", ")
    return h.select("doc_id", "h.sheet", "h.sheet_text", codes.alias("nomenclatures"), "h.court", "h.rol", "h.caption")


@register("nrm6_hour_notice", r"""
SELECT doc_id, md5(regexp_replace(text, '(?is)A contar del \d{2} de \pL+ de \d{4},\s*la hora visualizada .*?https?://www\.horaoficial\.cl', '', 'g')) AS rest FROM documents""")
def nrm6(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(normalise.removed(F.col("text"), "hour_notice")).alias("rest"))


@register("nrm7_private_signatures", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)C[óo]digo:\s*\d{10,20}\s+validar en https?://www\.esigner\.cl/\S+', '', 'g'), '(?i)Scanned with [A-Za-z0-9_]+', '', 'g')) AS rest FROM documents""")
def nrm7(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(normalise.removed(F.col("text"), "private_signer", "scanner")).alias("rest"))


@register("nrm9_labelled_metadata", r"""
SELECT doc_id, regexp_extract(text, '(?:License|Licence)[,:]? (?:Version )?([0-9.]+)', 1) AS version, regexp_extract(text, '(MIT|Apache|BSD|GPL)', 1) AS kind FROM documents""")
def nrm9(s, d):
    """Labelled fields of a certificate; the text isn't changed."""
    return table(s, d, "documents").select("doc_id", F.regexp_extract("text", r"(?:License|Licence)[,:]? (?:Version )?([0-9.]+)", 1).alias("version"), F.regexp_extract("text", "(MIT|Apache|BSD|GPL)", 1).alias("kind"))


@register("nrm10_encoding_repairs")
def nrm10(s, d):
    return table(s, d, "documents").select("doc_id", normalise.occurrences(F.col("text"), normalise.FLOATING_ACCENT).alias("accents"), normalise.repairs(F.col("text")).alias("r")).select("doc_id", "accents", F.md5("r.text").alias("repaired"), F.col("r.fixes").alias("fixes"))


@register("nrm11_whitespace_collapse", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f\x0B\r\x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS clean FROM documents""")
def nrm11(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(normalise.squeezed(F.col("text"))).alias("clean"))


@register("nrm12_statistics", r"""
SELECT doc_id, raw_length, clean_length, CASE WHEN raw_length > 0 THEN CAST(floor((raw_length - clean_length) * 100 / raw_length + 0.5) AS BIGINT) ELSE 0 END AS reduction FROM (SELECT doc_id, length(text) AS raw_length, length(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS clean_length FROM documents)""")
def nrm12(s, d):
    stats = normalise.statistics(F.col("text"), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    rows = table(s, d, "documents").select("doc_id", stats.alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", *(F.col(c).cast(L).alias(c) for c in ("raw_length", "clean_length", "reduction")))


@register("nrm14_nul_cleanup", r"SELECT page_id, md5(regexp_replace(html, '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g')) AS clean FROM pages")
def nrm14(s, d):
    return table(s, d, "pages").select("page_id", F.md5(F.regexp_replace(F.regexp_replace("html", r"\x00", " "), r"[ \t\n\r\f\x0B\x{A0}]+", " ")).alias("clean"))


@register("nrm15_cell_cleanup", r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g'))) AS clean FROM conversations")
def nrm15(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(cell(F.col("text"))).alias("clean"))


@register("nrm_chain_whole_documents")
def nrm_chain(s, d):
    rows = dealt(table(s, d, "documents"), "doc_id").select("doc_id", "text", normalise.normalised(F.col("text")).alias("clean"))
    return rows.select("doc_id", F.md5("clean").alias("clean_md5"), normalise.statistics(F.col("text"), F.col("clean")).alias("x")).select("doc_id", "clean_md5", "x.*")


@register("sec1_marker_catalogue")
def sec1(s, d):
    found = dealt(table(s, d, "documents"), "doc_id").select("doc_id", F.explode(sections.markers("text")).alias("m"))
    return found.select("doc_id", "m.*")


@register("sec2_ordinal_words", r"""
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(un|une|une|ein|eine|uno|una|a)(?:[^a-z]|$)', 1)) AS word FROM documents) GROUP BY 1, 2""")
def sec2(s, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?:^|[^a-z])(un|une|une|ein|eine|uno|una|a)(?:[^a-z]|$)"), F.lit(1))
    return table(s, d, "documents").select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@register("sec3_label_with_ordinal", "SELECT item_id, CASE WHEN item_id % 4 > 0 THEN 'Considerando ' || (item_id % 4) ELSE 'Considerando' END AS label FROM benchmark")
def sec3(s, d):
    n = F.col("item_id") % 4
    return table(s, d, "benchmark").select("item_id", F.when(n > 0, F.concat(F.lit("Considerando "), n.cast("string"))).otherwise("Considerando").alias("label"))


@register("sec4_sections")
def sec4(s, d):
    return sections.detect(dealt(table(s, d, "documents"), "doc_id"))


@register("sec5_intervals_between_lines", """
SELECT doc_id, k, start, lead(start, 1, n + 1) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (SELECT doc_id, k, n, CAST(1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, length(text) AS n, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)))""")
def sec5(s, d):
    from pyspark.sql import Window

    p = F.split("text", "\n")
    rows = table(s, d, "documents").select("doc_id", F.length("text").alias("n"), F.posexplode(p).alias("k", "line"))
    w = Window.partitionBy("doc_id").orderBy("k")
    start = 1 + F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("doc_id", (F.col("k") + 1).cast(L).alias("k"), "n", start.alias("start"))
    return rows.select("doc_id", "k", "start", F.coalesce(F.lead("start").over(w), F.col("n").cast(L) + 1).alias("stop"))


@register("sec6_context_boost", "SELECT l_orderkey, l_linenumber, l_returnflag, round(CASE WHEN bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) THEN least(1.0, 0.9 + l_tax + 0.05) ELSE 0.9 + l_tax END, 4) AS confidence FROM lineitem")
def sec6(s, d):
    from pyspark.sql import Window

    c = F.lit(0.9) + F.col("l_tax")
    clear = F.bool_or(F.col("l_returnflag") == "R").over(Window.partitionBy("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.round(F.when(clear, F.least(F.lit(1.0), c + 0.05)).otherwise(c), 4).alias("confidence"))


@register("sec7_structure_classifier", """
SELECT user_id, CASE WHEN bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') THEN 'judgment' WHEN bool_or(event_type = 'error') THEN 'hearing' WHEN bool_or(event_type = 'click') THEN 'pleading' ELSE 'undetermined' END AS kind FROM events GROUP BY user_id""")
def sec7(s, d):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    return table(s, d, "events").groupBy("user_id").agg(F.when(has("signup") & has("purchase"), "judgment").when(has("error"), "hearing").when(has("click"), "pleading").otherwise("undetermined").alias("kind"))


@register("sec8_procedure_classifier", """
SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN NULL WHEN contains(p_type, 'BRASS') THEN 'ejecutivo' WHEN contains(p_type, 'COPPER') THEN 'ordinario' WHEN contains(p_type, 'TIN') THEN 'sumario' END AS procedure FROM part""")
def sec8(s, d):
    has = lambda w: F.contains("p_type", F.lit(w))
    return table(s, d, "part").select("p_partkey", F.when(has("STEEL"), None).when(has("BRASS"), "ejecutivo").when(has("COPPER"), "ordinario").when(has("TIN"), "sumario").alias("procedure"))


@register("chk1_token_estimates", "SELECT doc_id, (length(text) + 4) // 5 AS chunk_tokens, (length(text) + 3) // 4 AS context_tokens FROM documents")
def chk1(s, d):
    return table(s, d, "documents").select("doc_id", chunking.tokens(F.col("text")).alias("chunk_tokens"), chunking.tokens(F.col("text"), 4).alias("context_tokens"))


@register("chk2_short_documents", "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE 2 END AS kind FROM documents")
def chk2(s, d):
    n = F.length("text")
    return table(s, d, "documents").select("doc_id", F.when(F.length(F.trim("text")) == 0, 0).when(n <= 1000, 1).otherwise(2).alias("kind"))


@register("chk5_semantic_chunks")
def chk5(s, d):
    return chunking.chunk(dealt(table(s, d, "documents"), "doc_id")).select("doc_id", "chunk_index", "start_offset", "end_offset", "token_estimate", "overlap", F.md5("chunk_text").alias("chunk_md5"))


@register("chk_fixed_stride", """
SELECT doc_id, i AS chunk_index, substring(text, CAST(i * 3265 + 1 AS BIGINT), 3840) AS chunk_text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 3264) // 3265))) AS i FROM documents)""")
def chk_fixed(s, d):
    last = F.greatest(F.lit(1), F.ceil(F.length("text") / 3265)).cast(L) - 1
    rows = table(s, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast(L), last)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substring("text", (F.col("chunk_index") * 3265 + 1).cast("int"), F.lit(3840)).alias("chunk_text"))


@register("chk8_section_of_chunk")
def chk8(s, d):
    docs = dealt(table(s, d, "documents"), "doc_id")
    return chunking.section_of(chunking.chunk(docs, texts=False), sections.detect(docs)).select("doc_id", "chunk_index", "section_type")


@register("chk9_chunk_statistics", """
SELECT source, count(*) AS chunks, CAST(floor(avg(t) + 0.5) AS BIGINT) AS mean_tokens, min(t) AS least, max(t) AS most FROM (SELECT source, (length(substring(text, CAST(i * 3265 + 1 AS BIGINT), 3840)) + 4) // 5 AS t FROM (SELECT source, text, unnest(range(0, greatest(1, (length(text) + 3264) // 3265))) AS i FROM documents)) GROUP BY source""")
def chk9(s, d):
    chunks = chk_fixed(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    t = chunking.tokens(F.col("chunk_text"))
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.floor(F.avg(t) + 0.5).alias("mean_tokens"), F.min(t).alias("least"), F.max(t).alias("most"))


@register("emb1_embedding_input", """
SELECT d.doc_id, '[' || concat_ws(' | ', lang, CASE WHEN l.quality = 1 THEN source END, CASE WHEN d.doc_id % 7 <> 0 THEN 'Folio ' || (d.doc_id % 7) ELSE 'Folio ' || n_chars END) || '] ' || text AS input FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def emb1(s, d):
    folio = F.coalesce(F.nullif(F.col("doc_id") % 7, F.lit(0)), F.col("n_chars"))
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    head = F.concat_ws(" | ", "lang", F.when(F.col("quality") == 1, F.col("source")), F.concat(F.lit("Folio "), folio.cast("string")))
    return rows.select("doc_id", F.concat(F.lit("["), head, F.lit("] "), "text").alias("input"))


@register("emb2_citation_label", "SELECT o_orderkey, concat_ws(', ', o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN 'Cuaderno ' || (o_custkey % 5) END, strftime(o_orderdate, '%d/%m/%Y')) AS label FROM orders")
def emb2(s, d):
    book = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Cuaderno "), (F.col("o_custkey") % 5).cast("string")))
    return table(s, d, "orders").select("o_orderkey", F.concat_ws(", ", "o_orderpriority", book, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("label"))


@register("emb3_embedding_batches", "SELECT vec_id, vec_id // 100 AS batch_no, CAST(len(embedding[1:32]) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def emb3(s, d):
    v = F.slice("embedding", 1, 32)
    return table(s, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("batch_no"), F.size(v).cast(L).alias("dims"), F.round(F.get(v, F.lit(0)).cast("double"), 5).alias("first"))


@register("htm_page_fields", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href="')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def htm_fields(s, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast(L)
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), n('<a href="').alias("links"), n("<p>").alias("paragraphs"))


@register("htm13_link_tokens", r"SELECT page_id, t AS token FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1)) AS t FROM pages) WHERE length(t) > 8")
def htm13(s, d):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z]+)"'), F.lit(1))).alias("token")).where("length(token) > 8")


# The driver's pages have no tables, so each query makes a page of the kind around a page's own fields: a row that counts
# in its tab, the same row outside of any tab, and in the tab a row that lacks what the kind needs.
TOKEN = "'kkkkkkkkkkkkkkkkkkkk' || page_id"
DOC = ' <form action="/x/{}?y"><input type="text" name="z" value="{}"><input type="hidden" name="dta" value="{}"></form>'
KINDS = {
    "folio_history": ("historiaCiv", "n d a 3 4 5 6 7", "docuS.php", "anexoSolicitudCivil", f"CAST(page_id AS INT) AS folio, 'c3 ' || url AS stage, 'c4 ' || url AS procedure, 'c5 ' || url AS description, 'c6 ' || url AS date, 0 AS page, {TOKEN} AS document_token, NULL AS certificate_token, {TOKEN} AS annex_token, true AS has_document, false AS has_certificate, true AS has_annex"),
    "litigants": ("litigantesCiv", "0 1 2 3", "", "", "'c0 ' || url AS participant, 'c1 ' || url AS rut, 'c2 ' || url AS person, 'c3 ' || url AS name"),
    "notifications": ("notificacionesCiv", "0 1 2 3 4 5 6 7", "", "", "'c0 ' || url AS rol, 'c1 ' || url AS state, 'c2 ' || url AS type, 'c3 ' || url AS date, 'c4 ' || url AS participant_type, 'c5 ' || url AS name, 'c6 ' || url AS procedure, 'c7 ' || url AS failure"),
    "pending_filings": ("escritosCiv", "d a 2 3 4", "docuN.php", "any", f"'c2 ' || url AS date, 'c3 ' || url AS type, 'c4 ' || url AS applicant, {TOKEN} AS document_token, true AS has_document, true AS has_annex"),
    "letters_rogatory": ("exhortosCiv", "0 1 a 3 4 5 6", "", "detalleExhortosCivil", f"'c0 ' || url AS origin, 'c1 ' || url AS type, 'see' AS destination, 'c3 ' || url AS ordered, 'c4 ' || url AS entered, 'c5 ' || url AS court, 'c6 ' || url AS state, {TOKEN} AS detail_token, true AS has_detail"),
    "rogatory_pieces": ("piezasExhortoCiv", "n d 2 a 4 5 6 7 n", "docuS.php", "any", f"CAST(page_id AS INT) AS folio, 'c2 ' || url AS book, 'c4 ' || url AS stage, 'c5 ' || url AS procedure, 'c6 ' || url AS description, 'c7 ' || url AS date, CAST(page_id AS INT) AS page, {TOKEN} AS document_token, true AS has_document, true AS has_annex"),
    "annexes": ("any", "d 1 2", "anexoDocCivil.php", "", f"'c1 ' || url AS date, 'c2 ' || url AS reference, {TOKEN} AS document_token, true AS has_document"),
    "rogatory_documents": ("any", "d 1 2 3", "docDetalleExhorto.php", "", f"'c1 ' || url AS date, 'c2 ' || url AS reference, 'c3 ' || url AS procedure, {TOKEN} AS document_token, true AS has_document"),
    "bailiff_withdrawals": ("any", "0 1 2 3", "", "", "'c0 ' || url AS book, 'c1 ' || url AS data, 'c2 ' || url AS date, 'c3 ' || url AS state"),
    "appeal_movements": ("movimientosApe", "n d a 3 s 5 6 7", "docCausaApelaciones.php", "anexoEscritoApelaciones", f"CAST(page_id AS INT) AS folio, 'c3 ' || url AS procedure, 'span ' || page_id AS description, 'title ' || page_id AS nomenclatures, 'c5 ' || url AS date, 'c6 ' || url AS room, 'c7 ' || url AS state, {TOKEN} AS document_token, NULL AS certificate_token, {TOKEN} AS annex_token, true AS has_document, false AS has_certificate, true AS has_annex"),
    "appeal_annexes": ("any", "d 1 2 3 4", "anexoDocEscritoApelaciones.php", "", f"'c1 ' || url AS code, 'c2 ' || url AS type, 'c3 ' || url AS quantity, 'c4 ' || url AS remark, {TOKEN} AS document_token, true AS has_document"),
    "appeal_litigants": ("litigantesApe", "0 1 2 3", "", "", "'c0 ' || url AS subject, 'c1 ' || url AS rut, 'c2 ' || url AS person, 'c3 ' || url AS name"),
}


def _made(pages, tab, cells, action, called, rest=""):
    """``pages`` with the html of a table of one row around url and page_id, and its two other rows."""
    def page(row, kind):
        whole = f'<div id="{tab}"><table class="t"><thead><tr><th>head</th></tr></thead><tbody>{row}<tr>{kind}</tr></tbody></table></div>'
        return whole + (f"<div><table><tbody>{row}</tbody></table></div>" if tab != "any" else "")

    forms = {"n": "@ID@ ", "d": DOC.format(action, "k" * 30, "k" * 20 + "@ID@") + "<a>d</a>", "a": f"""<a onclick="{called}( 'kkkkkkkkkkkkkkkkkkkk@ID@' )">see</a>""", "s": '<b>x</b><span title=" title @ID@ ">span @ID@</span>'}
    row = "<tr>" + "".join(f"<td>{forms.get(c) or f'c{c}  @URL@&nbsp;'}</td>" for c in cells.split()) + "</tr>"
    short = DOC.format(action, "", "k" * 20) if action else ""
    text = page(row, f"<td>{short}</td>" + "<td></td>" * (len(cells.split()) - 1)) + rest
    return pages.select("page_id", F.replace(F.replace(F.lit(text), F.lit("@ID@"), F.col("page_id").cast("string")), F.lit("@URL@"), F.col("url")).alias("html"))


def _tables(name):
    tab, cells, action, called, _ = KINDS[name]

    def query(s, d):
        return html.extract(_made(table(s, d, "pages"), tab, cells, action, called), name).drop("table_no", "row_no")

    query.__doc__ = f"The table '{name}' of each page's HTML, by its declared columns."
    return query


for _number, _name in enumerate(KINDS, 2):
    register(f"htm{_number if _number < 13 else 11}_{_name}", f"SELECT page_id, {KINDS[_name][4]} FROM pages")(_tables(_name))

APPEAL = """<form action="newebookapelaciones.php"><input name="dtaEbook" value="eeeeeeeeeeeeeeeeeeee@ID@"></form>
<table class="table table-titulos"><tbody><tr><td>Libro : Civil - @ID@</td><td>Fecha: 01/02/2024</td><td>Estado Recurso: Fallado</td></tr><tr><td>Estado Procesal: En tabla</td><td>Ubicación: Relator</td><td>Recurso: Apelación @ID@</td></tr><tr><td>Corte: C.A. de @URL@</td></tr></tbody></table>
<table class="table-titulos"><tbody><tr><td><form action="docCertificado.php"><input name="dtaCert" value="cccccccccccccccccccc@ID@"></form></td><td><form action="docTexto.php"><input type="hidden" name="t" value="tttttttttttttttttttt@ID@"></form></td><td><a onclick="anexo('eyJa@ID@.b.c')">x</a></td></tr></tbody></table>
<div id="ExhortosApe"><table><tbody><tr><td>1</td><td>letter @ID@</td></tr><tr><td></td><td></td></tr></tbody></table></div>
<div id="expedienteApe"><table class="table-titulos"><tbody><tr><td>Causa Origen: C - @ID@ - 2024</td><td>Tribunal: 1º Civil</td></tr><tr><td>Caratulado: A / B</td><td>Materia: Cobro</td><td>Ruc: 24-@ID@</td><td>Fecha Ingreso: 03/04/2024</td><td><a onclick="detalleCausaCivil('kkkkkkkkkkkkkkkkkkkk@ID@')">ver</a></td></tr></tbody></table></div>"""


def _appeals(s, d):
    return _made(table(s, d, "pages"), "any", "0", "", "", APPEAL)


@register("htm11_appeal_metadata", "SELECT page_id, 'Civil - ' || page_id AS book, '01/02/2024' AS date, 'Fallado' AS appeal_state, 'En tabla' AS procedural_state, 'Relator' AS place, 'Apelación ' || page_id AS appeal, 'C.A. de ' || url AS court FROM pages")
def htm11_metadata(s, d):
    return html.appeal_metadata(_appeals(s, d))


@register("htm11_appeal_documents", "SELECT page_id, 'eeeeeeeeeeeeeeeeeeee' || page_id AS ebook_token, 'cccccccccccccccccccc' || page_id AS certificate_token, 'tttttttttttttttttttt' || page_id AS text_token, 'eyJa' || page_id || '.b.c' AS annex_token FROM pages")
def htm11_documents(s, d):
    return html.appeal_documents(_appeals(s, d))


@register("htm11_appeal_letters", "SELECT page_id, 'letter ' || page_id AS entry FROM pages")
def htm11_letters(s, d):
    return html.appeal_list(_appeals(s, d), "appeal_letters_rogatory")


@register("htm11_appeal_origin", f"SELECT page_id, 'C-' || page_id || '-2024' AS origin, '1º Civil' AS court, 'A / B' AS caption, 'Cobro' AS matter, '24-' || page_id AS ruc, '03/04/2024' AS entered, {TOKEN} AS detail_token FROM pages")
def htm11_origin(s, d):
    return html.appeal_origin(_appeals(s, d))


@register("sel1_best_table_score", r"""
SELECT page_id, round(CAST(2.0 AS DOUBLE) * len(regexp_extract_all(lower(html), '<h1>')) + CAST(0.5 AS DOUBLE) * len(regexp_extract_all(lower(html), '<li>')) + CAST(0.15 AS DOUBLE) * least(10, len(regexp_extract_all(html, '<p>'))) + CAST(0.1 AS DOUBLE) * least(10, len(regexp_extract_all(html, '<a href'))), 4) AS score FROM pages""")
def sel1(s, d):
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    low = F.lower("html")
    return table(s, d, "pages").select("page_id", F.round(2.0 * n(low, "<h1>") + 0.5 * n(low, "<li>") + 0.15 * F.least(F.lit(10), n(F.col("html"), "<p>")) + 0.1 * F.least(F.lit(10), n(F.col("html"), "<a href")), 4).alias("score"))


@register("sel2_element_scores", "SELECT page_id, round(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) * CAST(contains(html, '<article>') AS INT) + 0.3 * CAST(contains(html, '<nav>') AS INT) + 0.5 * CAST(contains(html, '<table') AS INT) - 0.2 * CAST(contains(html, 'class=\"ad\"') AS INT))), 4) AS score FROM pages")
def sel2(s, d):
    has = lambda w: F.contains("html", F.lit(w)).cast("int")
    total = 0.4 * has("<article>") + 0.3 * has("<nav>") + 0.5 * has("<table") - 0.2 * has('class="ad"')
    return table(s, d, "pages").select("page_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("score"))


FOUND = """
made AS (SELECT page_id, page_id % 5 AS a, page_id % 12 AS b FROM pages),
score AS (SELECT page_id, 4 + CASE WHEN a > 0 THEN 0.5 ELSE 0 END + CASE WHEN a > 1 THEN 0.15 * (a + 1) ELSE 0 END + 0.1 * a AS one, 2 + CASE WHEN b > 0 THEN 0.5 ELSE 0 END + CASE WHEN b > 1 THEN 0.15 * least(b + 1, 10) ELSE 0 END + 0.1 * least(b, 10) AS two, page_id % 3 AS kind FROM made)"""


def _with_tables(s, d):
    """Pages with invented tables and elements after their own text: one table or two by page_id % 3, of rows by page_id."""
    pages = table(s, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    n = lambda m: (F.col("page_id") % m).cast("int")
    one = F.concat(F.lit("<table><thead><tr><th>ROL</th><th>Tribunal</th></tr></thead><tbody>"), F.repeat(F.lit('<tr><td><a href="#">fecha</a></td><td>x</td></tr>'), n(5)), F.lit("</tbody></table>"))
    two = F.concat(F.lit("<table><tr><td>Fecha</td></tr>"), F.repeat(F.lit("<tr><td>tipo <a>x</a></td></tr>"), n(12)), F.lit("</table>"))
    tables = F.when(n(3) == 0, one).when(n(3) == 1, two).otherwise(F.concat(two, one))
    links = F.concat(
        F.lit('<a href="/docs/'), F.col("page_id").cast("string"), F.lit('.pdf" target="_blank">Descargar</a><button onclick="verDoc(1)">Abrir</button><a href="#" '),
        F.when(n(2) == 1, F.lit('title="Sentencia"')).otherwise(F.lit("")), F.lit('><i class="fa-file-pdf"></i></a><a href="/p?page=2">Descargar pdf documento</a>'),
    )
    return pages.select("page_id", F.concat("html", tables, links).alias("html"))


@register("sel1_best_table", "WITH " + FOUND + """
SELECT page_id, CASE WHEN kind = 2 AND one > two THEN 1 ELSE 0 END AS table_no, CAST(round(best, 4) AS DOUBLE) AS score, CAST(round(least(best / 8, 0.9), 4) AS DOUBLE) AS confidence
FROM (SELECT *, CASE kind WHEN 0 THEN one WHEN 1 THEN two ELSE greatest(one, two) END AS best FROM score) WHERE best > 2""")
def sel1_best(s, d):
    """The likeliest table of each page that has one."""
    found = dealt(_with_tables(s, d), "page_id").select("page_id", page_choice.best_table(page_choice.facts("html")).alias("t"))
    return found.where("t IS NOT NULL").select("page_id", "t.*")


@register("sel2_download_elements", """
SELECT page_id, 'a' AS tag, CAST(0.9 AS DOUBLE) AS score FROM pages UNION ALL SELECT page_id, 'button', 0.65 FROM pages UNION ALL SELECT page_id, 'a', 0.4 FROM pages WHERE page_id % 2 = 1""")
def sel2_elements(s, d):
    """The elements of each page that are likely to lead to a download."""
    found = dealt(_with_tables(s, d), "page_id").select("page_id", F.explode(page_choice.download_elements(page_choice.facts("html"))).alias("e"))
    return found.select("page_id", "e.tag", "e.score")


@register("ttl1_title", r"""
SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, 1, 60), ' [^ ]*$', '') || '...' END AS title FROM conversations""")
def ttl1(s, d):
    short = F.concat(F.regexp_replace(F.substring("text", 1, 60), r" [^ ]*\z", ""), F.lit("..."))
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.length("text") <= 60, F.col("text")).otherwise(short).alias("title"))


@register("nrm8_loose_page_numbers", "SELECT doc_id, md5(text) AS same FROM documents")
def nrm8(s, d):
    """Loose numbers after page markers never match, as the markers are gone by then: the text stays as it is."""
    return table(s, d, "documents").select("doc_id", F.md5("text").alias("same"))


@register("nrm13_dry_run_marks", r"SELECT doc_id, md5(regexp_replace(text, '(?i)Scanned with [A-Za-z0-9_]+', '««scanner»»\0««/scanner»»', 'g')) AS marked FROM documents")
def nrm13(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(normalise.annotated(F.col("text"), "scanner")).alias("marked"))


@register("win6_chunk_index_reassigned", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, n FROM (SELECT doc_id, i, length(substring(text, CAST(i * 500 + 1 AS BIGINT), 500)) AS n FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)) WHERE i % 3 <> 1")
def win6(s, d):
    at = F.sequence(F.lit(0), F.ceil(F.length("text") / 500).cast("int") - 1)
    rows = table(s, d, "documents").where("length(text) > 0").select("doc_id", "text", F.posexplode(F.filter(at, lambda i: i % 3 != 1)).alias("chunk_index", "i"))
    return rows.select("doc_id", F.col("chunk_index").cast(L).alias("chunk_index"), F.length(F.substring("text", F.col("i") * 500 + 1, F.lit(500))).cast(L).alias("n"))


@register("win10_de_overlap")
def win10(s, d):
    from folia.functions.folds import apart
    from folia.sources.tables import moment

    marks = table(s, d, "events").select("user_id", F.struct(F.floor(moment("ts") / 3600).cast("int").alias("at"), F.col("event_type").alias("type"), F.col("value").alias("confidence")).alias("m"))
    kept = marks.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select("user_id", F.explode(apart(F.col("m"))).alias("m"))
    return kept.select("user_id", "m.*")


@register("chk7_page_of_chunk", """
SELECT doc_id, i AS chunk_index, CASE WHEN length(text) > 2000 THEN (i * 3265) // 2000 + 1 END AS page FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 3264) // 3265))) AS i FROM documents)""")
def chk7(s, d):
    chunks = chk_fixed(s, d).select("doc_id", "chunk_index").join(table(s, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return chunks.select("doc_id", "chunk_index", F.when(F.col("n") > 2000, F.floor(F.col("chunk_index") * 3265 / 2000) + 1).alias("page"))


@register("htm1_titled_fields", r"SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, trim(regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) AS first_entry FROM pages")
def htm1(s, d):
    field = lambda p: F.trim(F.regexp_extract("html", p, 1))
    return table(s, d, "pages").select("page_id", field("<h1>([^<]*)</h1>").alias("heading"), field('<li><a href="[^"]*">([^<]*)</a></li>').alias("first_entry"))


@register("url1_owned_objects", "SELECT page_id, url FROM pages WHERE page_id % 150 = 42")
def url1(s, d):
    from folia.sources.tables import scoped

    return scoped(table(s, d, "pages").withColumn("user_id", F.col("page_id") % 150), 42).select("page_id", "url")
