"""Queries of the rule tables: the driver's texts get invented phrases, and the SQL states the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.catalog import register
from folia.functions import normalise, rules, sections
from folia.sources.tables import dealt, table


def _phrase(key, phrases):
    return F.get(F.array(*map(F.lit, phrases)), F.pmod(F.col(key), F.lit(len(phrases))).cast("int"))


def _sql_phrase(key, phrases):
    return "list_extract([" + ", ".join("'" + p + "'" for p in phrases) + f"], CAST({key} % {len(phrases)} AS INT) + 1)"


RAW = ("Ejecutivo Obligación de Dar", "GESTIÓN  PREPARATORIA notificación", "Monitorio de Arrendamiento", "Ordinario Mayor Cuantía", "Cobro judicial de Honorarios", "Liquidación Voluntaria", "Juicio Tributario", "Posesión Efectiva", "Rendición de la Cuenta", "Otro trámite", "Partición de herencia", "Nombramiento de Árbitro", " ")


@register("sec8_procedure_classes", "SELECT p_partkey, CASE WHEN regexp_matches(raw, '(?i)liquidaci[oó]n|tributari|partici[oó]n') THEN NULL WHEN regexp_matches(raw, '(?i)ejecutiv|gesti[oóÓ]n\\s+preparatoria') THEN 'ejecutivo' WHEN regexp_matches(raw, '(?i)monitorio') THEN 'monitorio' WHEN regexp_matches(raw, '(?i)ordinario|hacienda') THEN 'ordinario' WHEN regexp_matches(raw, '(?i)sumario|precario|interdicto|cobro.*honorarios|obra\\s+nueva|obra\\s+ruinosa|comodato|arrendamiento|querella|denuncia\\s+de\\s+obra|servidumbre|dep[oó]sito\\s+necesario|rendici[oó]n.*cuenta') THEN 'sumario' WHEN regexp_matches(raw, '(?i)voluntari|cambio.*nombre|posesi[oó]n\\s+efectiva|rectificaci[oó]n|autorizaci[oó]n\\s+judicial|interdicci[oó]n|[aáÁ]rbitro|partidor') THEN 'voluntario' END AS procedure FROM (SELECT p_partkey, " + _sql_phrase("p_partkey", RAW) + " || ' ' || p_type AS raw FROM part)")
def sec8_classes(s, d):
    raw = F.concat(_phrase("p_partkey", RAW), F.lit(" "), "p_type")
    return table(s, d, "part").select("p_partkey", rules.procedure_of(raw).alias("procedure"))


SENT = "OFICINA JUDICIAL VIRTUAL CERTIFICADO DE ENVÍO Juzgado: 3º Civil de Talca N° Rol/Rit: C-12-2024 Ruc: 24-1-9 Caratulado: BANCO / PÉREZ Procedimiento: Ejecutivo Materia(s): Cobro de pagaré Fecha Envío : 01/02/2024 10:11:12 "


@register("nrm9_certificate_fields", f"""
SELECT doc_id, CASE WHEN c THEN '3º Civil de Talca' END AS court, CASE WHEN c THEN 'C-12-2024' END AS rol, CASE WHEN c THEN '24-1-9' END AS ruc, CASE WHEN c THEN 'BANCO / PÉREZ' END AS caption, CASE WHEN c THEN 'Ejecutivo' END AS procedure, CASE WHEN c THEN 'Cobro de pagaré' END AS matter, CASE WHEN c THEN '01/02/2024 10:11:12' END AS sent, md5(CASE WHEN c THEN '{SENT}' || text ELSE text END) AS same FROM (SELECT doc_id, text, doc_id % 3 = 0 AS c FROM documents)""")
def nrm9_fields(s, d):
    """A third of the documents get a certificate's lines put before them; the texts stay as they are."""
    rows = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(SENT), "text")).otherwise(F.col("text")).alias("text"))
    return rows.select("doc_id", normalise.certificate(F.col("text")).alias("c"), F.md5("text").alias("same")).select("doc_id", "c.*", "same")


@register("nrm3_total_pages", "SELECT doc_id, CAST(doc_id % 50 + 7 AS INT) AS total_pages FROM documents")
def nrm3_pages(s, d):
    n = (F.col("doc_id") % 50 + 7).cast("string")
    text = F.concat(F.lit("-- 1 of "), n, F.lit(" -- "), F.coalesce("text", F.lit("")), F.lit(" --2   of 3--"))
    return table(s, d, "documents").select("doc_id", normalise.total_pages(text).alias("total_pages"))


BROKEN = ("la presentaci n y la versi n", "el C digo, do a Mu oz", "hace un a o y m s d a s", "Reg strese, notif quese y arch vese", "Gonz lez recibi  c dula", "sin da o")
MENDED = ("la presentación y la versión", "el Código, doña Muñoz", "hace un año y más día s", "Regístrese, notifíquese y archívese", "González recibió cédula", "sin daño")


@register("nrm10_repair_counts", "SELECT doc_id, md5(" + _sql_phrase("doc_id", MENDED) + " || ' ' || doc_id) AS mended, list_extract([2, 3, 3, 3, 3, 1], CAST(doc_id % 6 AS INT) + 1) AS fixes FROM documents")
def nrm10_counts(s, d):
    """Damaged phrases come back whole, each repair counted."""
    rows = table(s, d, "documents").select("doc_id", normalise.repairs(F.concat(_phrase("doc_id", BROKEN), F.lit(" "), F.col("doc_id").cast("string"))).alias("r"))
    return rows.select("doc_id", F.md5("r.text").alias("mended"), F.col("r.fixes").alias("fixes"))


TYPES = (("vistos", "considerando_n"), ("en_lo_principal", "petitorio"), ("audiencia_inicio", "audiencia_prueba"), ("considerando_n", "resolutivo"), ("considerando", "resolutivo", "petitorio"))


@register("sec6_boost_by_type", """
SELECT l_orderkey, l_linenumber, kind, round(CASE WHEN kind IN ('considerando_n', 'resolutivo', 'cierre_sentencia') AND (list_contains(ts, 'vistos') OR list_contains(ts, 'considerando')) AND (list_contains(ts, 'resolutivo') OR list_contains(ts, 'considerando_n')) OR kind IN ('petitorio', 'otrosi', 'hechos', 'derecho') AND (list_contains(ts, 'en_lo_principal') OR list_contains(ts, 'otrosi')) OR kind IN ('audiencia_conciliacion', 'audiencia_prueba') AND list_contains(ts, 'audiencia_inicio') THEN least(1.0, round(0.9 + l_tax, 2) + 0.05) ELSE round(0.9 + l_tax, 2) END, 2) AS confidence FROM (SELECT *, list(kind) OVER (PARTITION BY l_orderkey) AS ts FROM (SELECT l_orderkey, l_linenumber, l_tax, list_extract(['vistos', 'considerando_n', 'petitorio', 'audiencia_inicio', 'audiencia_prueba', 'otrosi', 'resolutivo'], CAST((l_orderkey + l_linenumber) % 7 AS INT) + 1) AS kind FROM lineitem))""")
def sec6_types(s, d):
    from pyspark.sql import Window

    kinds = F.array(*map(F.lit, ("vistos", "considerando_n", "petitorio", "audiencia_inicio", "audiencia_prueba", "otrosi", "resolutivo")))
    kind = F.get(kinds, F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7)).cast("int"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.9 + F.col("l_tax"), 2).alias("c"), kind.alias("kind"))
    rows = rows.withColumn("types", F.collect_set("kind").over(Window.partitionBy("l_orderkey")))
    return rows.select("l_orderkey", "l_linenumber", "kind", F.round(sections.boosted(F.col("c"), F.col("kind"), F.col("types")), 2).alias("confidence"))


ASKED = ("¿Qué dice el PAGARÉ adjunto?", "¿Hay exhorto o pieza?", "Estado de la apelación", "certificado de ejecutoria", "resúmeme todos los documentos", "¿Cuándo vence el plazo?", "busca qué dice la doctrina en la web", "googlea la jurisprudencia", "embargo y retiro del receptor", "hola")


def _asked(s, d):
    return dealt(table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", F.concat(_phrase("turn", ASKED), F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


ASKED_SQL = "(SELECT conv_id, turn, lower(" + _sql_phrase("turn", ASKED) + " || ' ' || coalesce(text, '')) AS q FROM conversations)"


def _sql_any(words):
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words.split("|")) + ")"


ORIGIN_SQL = [("anexo|adjunto|pagaré|pagare|mandato|poder|personería|personeria|título ejecutivo|titulo ejecutivo", "anexo_causa anexo_solicitud"), ("exhorto|tribunal exhortado|exhortado", "exhorto pieza_exhorto"), ("apelación|apelacion|recurso|remisión|remision|corte de apelaciones|casación|casacion|alzada|segunda instancia|ebook", "remision_directo remision_movimiento remision_mov_anexo"), ("certificado", "folio_certificado"), ("pieza", "pieza_exhorto")]
ALL_SQL = _sql_any("documento|documentos|resúmeme|resumeme|resumen de todos|todos los|cada uno")


@register("ret6_origins_asked_for", "SELECT DISTINCT conv_id, turn, origin FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{o}' AS origin FROM {ASKED_SQL} WHERE {_sql_any(w)} AND NOT {ALL_SQL}" for w, some in ORIGIN_SQL for o in some.split()) + f" UNION ALL SELECT conv_id, turn, '*' FROM {ASKED_SQL} WHERE {ALL_SQL})")
def ret6_origins(s, d):
    return _asked(s, d).select("conv_id", "turn", F.explode(rules.wanted_origins(F.col("q"))).alias("origin")).distinct()


CATEGORIES = ("folio", "folio_anexo", "anexo_causa", "exhorto", "exhorto_doc", "pieza_exhorto", "remision", "remision_movimiento", "remision_mov_anexo", "litigante")


@register("ret7_origins_of_changes", "SELECT DISTINCT user_id, origin FROM (SELECT user_id, " + _sql_phrase("event_id", CATEGORIES) + " AS c FROM events) JOIN (VALUES ('folio', 'folio'), ('folio', 'folio_certificado'), ('folio_anexo', 'anexo_solicitud'), ('anexo_causa', 'anexo_causa'), ('exhorto', 'exhorto'), ('exhorto_doc', 'exhorto'), ('pieza_exhorto', 'pieza_exhorto'), ('remision', 'remision_directo'), ('remision_movimiento', 'remision_movimiento'), ('remision_mov_anexo', 'remision_mov_anexo')) AS v(k, origin) ON c = k")
def ret7_origins(s, d):
    return table(s, d, "events").select("user_id", F.explode(rules.origins_of_change(_phrase("event_id", CATEGORIES))).alias("origin")).distinct()


WANTED_SQL = [("ESCRITOS PRESENTADOS:", "escrito|presentación|presentacion|solicitud|demanda|contestación|contestacion|réplica|replica|dúplica|duplica|ingreso|plazo"), ("NOTIFICACIONES:", "notific|notif|cédula|cedula|estado diario|personal|plazo|vencimiento|rebeldía|rebeldia"), ("ANEXOS DE LA CAUSA:", "anexo|adjunto|documento adjunt"), ("RETIROS DE RECEPTOR:", "receptor|retiro|ministro de fe|requerimiento|embargo|lanzamiento|plazo"), ("EXHORTOS:", "exhorto|tribunal exhortado|jurisdicción|jurisdiccion"), ("PIEZAS DE EXHORTO:", "exhorto|pieza"), ("RECURSOS EN CORTE (REMISIONES):", "apelación|apelacion|recurso|remisión|remision|corte|casación|casacion|alzada|segunda instancia")]


@register("ret11_sections_asked_for", " UNION ALL ".join(f"SELECT conv_id, turn, '{h}' AS header, '{h}' || chr(10) || 'x' AS kept FROM {ASKED_SQL} WHERE {_sql_any(w)}" for h, w in WANTED_SQL))
def ret11_sections(s, d):
    """Which secondary sections each question wants, and what the filter leaves of them."""
    case = "\n".join(["=== CAUSA ===", "a", *(f"{h}\nx" for h, _ in rules.SECTIONS)])
    rows = _asked(s, d).select("conv_id", "turn", rules.filtered_case_text(F.lit(case), F.col("q")).alias("text"), rules.wanted_sections(F.col("q")).alias("wanted"))
    rows = rows.select("conv_id", "turn", "text", F.explode("wanted").alias("header"))
    return rows.select("conv_id", "turn", "header", F.when(F.contains("text", F.concat(F.lit("\n"), "header", F.lit("\nx"))), F.concat("header", F.lit("\nx"))).alias("kept"))


WORDS_SQL = "busca en internet|buscar en internet|busca en la web|buscar en la web|googlea|investiga en internet|busca online|buscar online|busca en google|buscar en google|búsqueda web|busqueda web"
TOPICS_SQL = "jurisprudencia|sentencia de|corte suprema|corte de apelaciones|fallos sobre|criterio jurisprudencial|precedente|doctrina|recurso de casación|recurso de protección|recurso de nulidad|unificación de jurisprudencia"


@register("ret13_web_search", f"SELECT conv_id, turn, {_sql_any(WORDS_SQL + '|' + TOPICS_SQL)} AS called_for, {_sql_any(WORDS_SQL)} OR regexp_matches(q, '\\b(busca|investiga)\\w*\\b.{{0,60}}\\ben\\s+(la\\s+)?(web|internet|google|línea|linea)\\b|\\ben\\s+(la\\s+)?(web|internet|google)\\b.{{0,60}}\\bbusca|\\bbusca\\w*\\b.{{0,60}}\\bonline\\b') AS asked_for FROM {ASKED_SQL}")
def ret13_web(s, d):
    return _asked(s, d).select("conv_id", "turn", rules.web_search(F.col("q")).alias("called_for"), rules.asks_for_web(F.col("q")).alias("asked_for"))


CAPTIONS = ("Resolución que recibe", "autoridad", "Auto de prueba", "Contestación", "Diligencia", "cédula", "Anexo 3", "acompaña", "sin más")


@register("dup7_file_tags", "SELECT page_id, CASE WHEN regexp_matches(t, '(?i)resoluci[oóÓ]n|auto\\b|sentencia|decreto') THEN 'resolucion' WHEN regexp_matches(t, '(?i)escrito|demanda|contestaci|recurso|apelaci') THEN 'escrito' WHEN regexp_matches(t, '(?i)actuaci[oóÓ]n|diligencia|audiencia') THEN 'actuacion' WHEN regexp_matches(t, '(?i)notificaci[oóÓ]n|c[eéÉ]dula|carta') THEN 'notificacion' WHEN regexp_matches(t, '(?i)tomo|prueba|documental|anexo|acompaña') THEN 'tomo_pruebas' ELSE 'otro' END AS tag FROM (SELECT page_id, lower(url) || ' ' || upper(" + _sql_phrase("page_id", CAPTIONS) + ") AS t FROM pages)")
def dup7_tags(s, d):
    return table(s, d, "pages").select("page_id", rules.file_tag(F.col("url"), _phrase("page_id", CAPTIONS)).alias("tag"))


@register("emb1_enriched_chunks", """
SELECT doc_id, md5(CASE WHEN head = '' THEN text ELSE '[' || head || '] ' || text END) AS input FROM (SELECT doc_id, text, concat_ws(' | ', CASE doc_id % 4 WHEN 0 THEN 'Folio' WHEN 1 THEN 'Anexo causa' WHEN 2 THEN 'raro' END, CASE WHEN doc_id % 5 = 1 THEN 'Certificación' END, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'Considerando 6' WHEN doc_id % 3 = 0 THEN 'Considerando' END, CASE WHEN doc_id % 7 < 3 THEN 'Sumario' END, CASE WHEN doc_id % 6 > 0 THEN 'Folio ' || (doc_id % 6) WHEN doc_id % 9 > 0 THEN 'Folio ' || (doc_id % 9) END, CASE WHEN doc_id % 11 = 0 THEN 'Principal' END) AS head FROM documents)""")
def emb1_chunks(s, d):
    i = F.col("doc_id")
    when = lambda n, k, v: F.when(i % n == k, v)
    head = {"document_type": when(4, 0, "folio").when(i % 4 == 1, "anexo_causa").when(i % 4 == 2, "raro"), "description": when(5, 1, "Certificación"), "section_type": F.when(i % 3 == 2, "general").otherwise("considerando_n"), "section_ordinal": F.when(i % 2 == 0, 6), "section_confidence": F.when(i % 3 == 0, 0.7).otherwise(0.69), "procedure": F.when(i % 7 < 3, "sumario"), "folio": F.nullif(i % 6, F.lit(0)), "page": i % 9, "book": when(11, 0, "Principal")}
    return table(s, d, "documents").select("doc_id", F.md5(rules.embedding_input(F.col("text"), **head)).alias("input"))


@register("emb2_citations", """
SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'folio' ELSE 'Documento' END, 'de fecha ' || strftime(o_orderdate, '%d/%m/%Y'), CASE WHEN o_custkey % 4 > 0 THEN 'folio ' || (o_custkey % 4) END, CASE WHEN o_custkey % 2 = 0 THEN 'cuaderno Principal' END, CASE WHEN o_orderkey % 5 > 0 THEN '(pág. ' || (o_orderkey % 5) || ')' END) AS label FROM orders""")
def emb2_citations(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    label = rules.citation_label(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 3 == 1, "folio"), date, F.nullif(c % 4, F.lit(0)), F.lit(None).cast("long"), F.when(c % 2 == 0, "Principal"), k % 5)
    return table(s, d, "orders").select("o_orderkey", label.alias("label"))


@register("dup6_tiers_and_estimates", """
SELECT doc_id, CASE WHEN size <= 52428800 THEN 'standard' WHEN size <= 524288000 THEN 'large' WHEN size <= 5368709120 THEN 'tomo' ELSE 'mega' END AS tier, CAST(ceil(size / 1048576.0::DOUBLE / 2) AS BIGINT) AS upload_seconds, CAST(ceil(size / 1048576.0::DOUBLE * 0.2::DOUBLE * 250000) AS BIGINT) AS tokens, CAST(ceil(size / 1048576.0::DOUBLE / 0.5::DOUBLE) AS BIGINT) AS pages, round(CAST(ceil(size / 1048576.0::DOUBLE * 0.2::DOUBLE * 250000) AS DOUBLE) / 1e6 * 0.5::DOUBLE, 2) AS first_cost, round(CAST(ceil(size / 1048576.0::DOUBLE * 0.2::DOUBLE * 250000) AS DOUBLE) / 1e6 * 0.05::DOUBLE, 3) AS cached_cost FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * 65536 AS size FROM documents)""")
def dup6_tiers(s, d):
    """Documents as files of 65,536 bytes a character: tiers and what they cost."""
    size = F.col("n_chars").cast("long") * 65_536
    return table(s, d, "documents").select("doc_id", rules.size_tier(size).alias("tier"), rules.processing_estimates(size).alias("x")).select("doc_id", "tier", "x.*")


ENDINGS = ("¿Cuándo vence?", "Dime los últimos cambios", "busca en internet jurisprudencia", "cambios detectados y PLAZOS FATALES", "¿Qué hay de nuevo?", "Últimos Cambios de la ley, jurisprudencia", "días para contestar; investiga esto en la web")
DEADLINES_SQL = "plazos fatales|plazos vigentes|próximos plazos|análisis de plazos|plazo para contestar|plazo para apelar|plazo para oponer excepciones|plazo para recurrir|vencimiento de plazo|plazos que corren|días para contestar|cuántos días quedan|cuándo vence|plazos procesales|plazos pendientes"
UPDATES_SQL = "cambios de la [uú]ltima sincronizaci[oó]n|(cambios|actualizaciones|novedades|diferencias) de sincronizaci[oó]n|(actualizaciones|novedades) de la causa|qu[eé] cambi[oó] en la causa|cambios detectados|[uú]ltimos cambios|cambios recientes"


@register("ret13_answer_modes", f"""
SELECT conv_id, turn, CASE WHEN d THEN 'deadline' WHEN u THEN 'updates' ELSE 'plain' END AS mode, d OR (u AND turn % 2 = 1) AS specialised, d OR u AS whole_context, w AS web,
  w AND regexp_matches(q, '{WORDS_SQL}|\\b(busca|investiga)\\w*\\b.{{0,60}}\\ben\\s+(la\\s+)?(web|internet|google|línea|linea)\\b') AS asked_for_web
FROM (SELECT *, regexp_matches(q, '{DEADLINES_SQL}') AS d, regexp_matches(q, '{UPDATES_SQL}') AS u, regexp_matches(q, '{WORDS_SQL}|{TOPICS_SQL}') OR conv_id % 9 = 0 AS w
  FROM (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || {_sql_phrase('(conv_id + turn)', ENDINGS)}) AS q FROM conversations))""")
def ret13_modes(s, d):
    """How each question is answered: deadlines before changes before others, the web beside them."""
    asked = table(s, d, "conversations").withColumn("key", F.col("conv_id") + F.col("turn"))
    asked = asked.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _phrase("key", ENDINGS)).alias("q"))
    mode = rules.answer_mode(F.col("q"), F.when(F.col("turn") % 2 == 1, F.lit(3)), F.col("conv_id") % 9 == 0)
    return asked.select("conv_id", "turn", mode.alias("m")).select("conv_id", "turn", "m.*")


@register("ret9_inventories", """
WITH d AS (SELECT source, doc_id, doc_id % 3 = 0 AS selected, doc_id % 7 <> 0 AS completed,
  concat_ws(' — ', CASE doc_id % 4 WHEN 0 THEN 'Ref ' || doc_id WHEN 1 THEN 'Resolución' WHEN 2 THEN doc_id || '.pdf' ELSE coalesce(lang, 'documento') END,
    '(' || coalesce(lang, 'documento') || CASE WHEN doc_id % 3 = 0 THEN ', F' || doc_id % 10 ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ', Principal' ELSE '' END || ')', CASE WHEN doc_id % 2 = 0 THEN '01/02/2024' END) AS label FROM documents),
c AS (SELECT source, count(*) FILTER (selected) AS a, count(*) FILTER (NOT selected AND completed) AS b, count(*) FILTER (NOT selected AND NOT completed) AS c,
  string_agg('  - ' || label || ' [INCLUIDO]', chr(10) ORDER BY doc_id) FILTER (selected) AS x,
  string_agg('  - ' || label || ' [NO INCLUIDO por presupuesto de contexto]', chr(10) ORDER BY doc_id) FILTER (NOT selected AND completed) AS y,
  string_agg('  - ' || label || ' [SIN TEXTO EXTRAÍDO — PDF pendiente de procesamiento]', chr(10) ORDER BY doc_id) FILTER (NOT selected AND NOT completed) AS z FROM d GROUP BY source)
SELECT source AS case_id, md5(concat_ws(chr(10), '=== INVENTARIO DE DOCUMENTOS DE LA CAUSA ===', 'INCLUIDOS EN CONTEXTO (' || a || ' docs — puedes analizar su contenido):' || chr(10) || x,
  'NO INCLUIDOS (' || b || ' docs — texto extraído pero fuera de presupuesto):' || chr(10) || y, 'PENDIENTES DE EXTRACCIÓN (' || c || ' docs — NO disponibles):' || chr(10) || z,
  CASE WHEN c > 1 THEN chr(10) || '⚠️ NOTA: Hay documentos recién sincronizados cuyo texto aún se está extrayendo.' || chr(10) || 'Si el usuario pregunta por su contenido, informa que los documentos se están procesando' || chr(10) || 'y que el análisis completo estará disponible en unos momentos al consultar nuevamente.' END,
  chr(10) || 'REGLA: Solo puedes afirmar sobre el contenido de documentos [INCLUIDO].', 'Para documentos [NO INCLUIDO] o [SIN TEXTO EXTRAÍDO], declara explícitamente que no tienes acceso a su contenido.', '=== FIN INVENTARIO ===')) AS inventory_md5 FROM c""")
def ret9_whole(s, d):
    """The inventory of each source's documents: those in the context, those left out, those without a text yet."""
    i = F.col("doc_id")
    label = rules.inventory_label(
        F.when(i % 4 == 0, F.concat(F.lit("Ref "), i.cast("string"))), F.when(i % 4 == 1, "Resolución"), F.when(i % 4 == 2, F.concat(i.cast("string"), F.lit(".pdf"))), F.col("lang"),
        F.when(i % 3 == 0, i % 10), F.when(i % 5 == 0, "Principal"), F.when(i % 2 == 0, "01/02/2024"),
    )
    docs = table(s, d, "documents").select(F.col("source").alias("case_id"), i.alias("pos"), label.alias("label"), (i % 3 == 0).alias("selected"), (i % 7 != 0).alias("completed"))
    waits = docs.where("NOT selected AND NOT completed").groupBy("case_id").agg((F.count("*") > 1).alias("syncing"))
    return rules.inventories(docs.join(waits, "case_id", "left")).select("case_id", F.md5("inventory").alias("inventory_md5"))
