"""Rule tables of court documents and questions, and the column functions that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.folds import once

# Procedures that are none of the classes, and the classes by keyword, the first that fits.
NO_PROCEDURE = ("liquidaci[oó]n", "tributari", "partici[oó]n")
PROCEDURES = (
    ("ejecutivo", r"ejecutiv|gesti[oó]n\s+preparatoria"),
    ("monitorio", r"monitorio"),
    ("ordinario", r"ordinario|hacienda"),
    ("sumario", r"sumario|precario|interdicto|cobro.*honorarios|obra\s+nueva|obra\s+ruinosa|comodato|arrendamiento|querella|denuncia\s+de\s+obra|servidumbre|dep[oó]sito\s+necesario|rendici[oó]n.*cuenta"),
    ("voluntario", r"voluntari|cambio.*nombre|posesi[oó]n\s+efectiva|rectificaci[oó]n|autorizaci[oó]n\s+judicial|interdicci[oó]n|[aá]rbitro|partidor"),
)
# Origins of documents that a question's words ask for ('*': all).
QUESTION_ORIGINS = (
    (("anexo", "adjunto", "pagaré", "pagare", "mandato", "poder", "personería", "personeria", "título ejecutivo", "titulo ejecutivo"), ("anexo_causa", "anexo_solicitud")),
    (("exhorto", "tribunal exhortado", "exhortado"), ("exhorto", "pieza_exhorto")),
    (("apelación", "apelacion", "recurso", "remisión", "remision", "corte de apelaciones", "casación", "casacion", "alzada", "segunda instancia", "ebook"), ("remision_directo", "remision_movimiento", "remision_mov_anexo")),
    (("certificado",), ("folio_certificado",)),
    (("pieza",), ("pieza_exhorto",)),
    (("documento", "documentos", "resúmeme", "resumeme", "resumen de todos", "todos los", "cada uno"), ("*",)),
)
# Origins of documents by the category of a change.
CHANGE_ORIGINS = {
    "folio": ("folio", "folio_certificado"),
    "folio_anexo": ("anexo_solicitud",),
    "anexo_causa": ("anexo_causa",),
    "exhorto": ("exhorto",),
    "exhorto_doc": ("exhorto",),
    "pieza_exhorto": ("pieza_exhorto",),
    "remision": ("remision_directo",),
    "remision_movimiento": ("remision_movimiento",),
    "remision_mov_anexo": ("remision_mov_anexo",),
}
# Essential documents by procedure, the words that tell them, and the words of resolutions and deadlines.
ESSENTIAL = {
    "ejecutivo": ("demanda", "mandamiento", "acta_embargo", "excepciones"),
    "ordinario": ("demanda", "contestacion", "auto_prueba"),
    "sumario": ("demanda", "acta_audiencia"),
    "monitorio": ("demanda", "resolucion"),
    "voluntario": ("solicitud", "informe"),
}
TYPE_WORDS = {
    "demanda": ("demanda", "libelo"),
    "contestacion": ("contestación", "contestacion", "contesta la demanda"),
    "mandamiento": ("mandamiento", "ejecución y embargo"),
    "acta_embargo": ("embargo", "acta de embargo", "traba"),
    "excepciones": ("excepciones", "opone excepciones", "oposición"),
    "acta_audiencia": ("audiencia", "comparendo", "acta de audiencia"),
    "auto_prueba": ("auto de prueba", "recibe la causa a prueba"),
    "solicitud": ("solicitud", "solicita"),
    "informe": ("informe", "informa"),
    "resolucion": ("resolución", "resolucion", "resuelve", "proveído"),
}
RESOLUTION_WORDS = ("sentencia", "resolución", "resolucion", "auto", "decreto")
DEADLINE_WORDS = (*RESOLUTION_WORDS, "mandamiento", "requerimiento", "notificación", "notificacion")
# Secondary sections of a case's text and the words of a question that want them.
SECTIONS = (
    ("ESCRITOS PRESENTADOS:", ("escrito", "presentación", "presentacion", "solicitud", "demanda", "contestación", "contestacion", "réplica", "replica", "dúplica", "duplica", "ingreso", "plazo")),
    ("NOTIFICACIONES:", ("notific", "notif", "cédula", "cedula", "estado diario", "personal", "plazo", "vencimiento", "rebeldía", "rebeldia")),
    ("ANEXOS DE LA CAUSA:", ("anexo", "adjunto", "documento adjunt")),
    ("RETIROS DE RECEPTOR:", ("receptor", "retiro", "ministro de fe", "requerimiento", "embargo", "lanzamiento", "plazo")),
    ("EXHORTOS:", ("exhorto", "tribunal exhortado", "jurisdicción", "jurisdiccion")),
    ("PIEZAS DE EXHORTO:", ("exhorto", "pieza")),
    ("RECURSOS EN CORTE (REMISIONES):", ("apelación", "apelacion", "recurso", "remisión", "remision", "corte", "casación", "casacion", "alzada", "segunda instancia")),
)
CORE_HEADERS = ("===", "DATOS GENERALES:", "LITIGANTES:", "CUADERNO:", "NOTA:")
# Words and forms of questions that ask for a search on the web, and topics that call for one.
WEB_WORDS = ("busca en internet", "buscar en internet", "busca en la web", "buscar en la web", "googlea", "investiga en internet", "busca online", "buscar online", "busca en google", "buscar en google", "búsqueda web", "busqueda web")
WEB_FORMS = (
    r"\bbusca\w*\b.{0,60}\ben\s+(?:la\s+)?(?:web|internet|google|línea|linea)\b",
    r"\binvestiga\w*\b.{0,60}\ben\s+(?:la\s+)?(?:web|internet|google|línea|linea)\b",
    r"\ben\s+(?:la\s+)?(?:web|internet|google)\b.{0,60}\bbusca",
    r"\bbusca\w*\b.{0,60}\bonline\b",
)
WEB_TOPICS = ("jurisprudencia", "sentencia de", "corte suprema", "corte de apelaciones", "fallos sobre", "criterio jurisprudencial", "precedente", "doctrina", "recurso de casación", "recurso de protección", "recurso de nulidad", "unificación de jurisprudencia")
# What questions of deadlines and of changes say.
DEADLINE_QUESTIONS = (
    "plazos fatales", "plazos vigentes", "próximos plazos", "análisis de plazos", "plazo para contestar", "plazo para apelar", "plazo para oponer excepciones",
    "plazo para recurrir", "vencimiento de plazo", "plazos que corren", "días para contestar", "cuántos días quedan", "cuándo vence", "plazos procesales", "plazos pendientes",
)
UPDATE_QUESTIONS = (
    "cambios de la última sincronización", "cambios de la ultima sincronización", "cambios de la última sincronizacion", "cambios de la ultima sincronizacion",
    "cambios de sincronización", "cambios de sincronizacion", "actualizaciones de la causa", "actualizaciones de sincronización", "actualizaciones de sincronizacion",
    "qué cambió en la causa", "que cambió en la causa", "que cambio en la causa", "qué cambio en la causa", "novedades de la causa", "novedades de sincronización", "novedades de sincronizacion",
    "cambios detectados", "últimos cambios", "ultimos cambios", "cambios recientes", "diferencias de sincronización", "diferencias de sincronizacion",
)
# Tags of a file by its address and caption, the first that fits.
FILE_TAGS = (
    ("resolucion", r"resoluci[oó]n|auto\b|sentencia|decreto"),
    ("escrito", r"escrito|demanda|contestaci|recurso|apelaci"),
    ("actuacion", r"actuaci[oó]n|diligencia|audiencia"),
    ("notificacion", r"notificaci[oó]n|c[ée]dula|carta"),
    ("tomo_pruebas", r"tomo|prueba|documental|anexo|acompaña"),
)
# Names shown for document types, sections and procedures; the least confidence of a section that is shown.
TYPE_NAMES = {"folio": "Folio", "directo": "Documento", "anexo_causa": "Anexo causa", "anexo_solicitud": "Anexo solicitud"}
SECTION_NAMES = {
    "vistos": "Vistos", "considerando": "Considerando", "considerando_n": "Considerando", "resolutivo": "Resolutivo", "cierre_sentencia": "Cierre",
    "individualizacion": "Individualización", "en_lo_principal": "Principal", "hechos": "Hechos", "derecho": "Derecho", "petitorio": "Petitorio", "otrosi": "Otrosí",
    "receptor_certificacion": "Certificación", "receptor_diligencia": "Diligencia", "receptor_cierre": "Cierre",
    "resolucion_proveyendo": "Proveyendo", "resolucion_vistos": "Vistos", "resolucion_dispositivo": "Dispositivo", "notificacion_estado_diario": "Estado diario",
    "audiencia_inicio": "Audiencia", "audiencia_conciliacion": "Conciliación", "audiencia_prueba": "Prueba", "audiencia_cierre": "Cierre audiencia",
    "mandamiento": "Mandamiento",
}
PROCEDURE_NAMES = {"ordinario": "Ordinario", "ejecutivo": "Ejecutivo", "sumario": "Sumario", "monitorio": "Monitorio", "voluntario": "Voluntario"}
SURE = 0.70

# Upper bounds of the size tiers, and what estimates of sending and reading a file take for granted.
MEGABYTE = 1024 * 1024
SIZE_TIERS = (("standard", 50 * MEGABYTE), ("large", 500 * MEGABYTE), ("tomo", 5 * 1024 * MEGABYTE))
LARGEST_TIER = "mega"
SENT_PER_SECOND, TEXT_SHARE, TOKENS_PER_MEGABYTE, PAGE_MEGABYTES = 2.0, 0.2, 250_000.0, 0.5
FIRST_PRICE, CACHED_PRICE = (0.5, 2), (0.05, 3)


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text has one of the words."""
    return once(F.lower(text), lambda low: _holds(low, words))


def first_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first rule whose pattern, in any case, is found; null without one."""
    return F.coalesce(*(F.when(text.rlike(f"(?iu){pattern}"), name) for name, pattern in rules))


def procedure_of(raw: Column) -> Column:
    """The class of a procedure's raw name; null for excluded and unknown ones."""
    return F.when(~F.trim(raw).rlike("(?iu)" + "|".join(NO_PROCEDURE)), first_rule(F.trim(raw), PROCEDURES))


def wanted_origins(question: Column) -> Column:
    """The origins that a question asks for, each once; ['*'] alone if it asks for all."""
    found = F.array_distinct(once(F.lower(question), lambda low: F.flatten(F.array(*(F.when(_holds(low, words), F.array(*map(F.lit, origins))).otherwise(F.array().cast("array<string>")) for words, origins in QUESTION_ORIGINS)))))
    return once(found, lambda x: F.when(F.array_contains(x, "*"), F.array(F.lit("*"))).otherwise(x))


def origins_of_change(category: Column) -> Column:
    """The origins of the documents that a change of this category touches; empty for others."""
    known = F.create_map(*(x for k, v in CHANGE_ORIGINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(known, category), F.array().cast("array<string>"))


def wanted_sections(question: Column) -> Column:
    """Headers of the secondary sections that a question wants."""
    return once(F.lower(question), lambda low: F.array_compact(F.array(*(F.when(_holds(low, words), header) for header, words in SECTIONS))))


def filtered_case_text(text: Column, question: Column) -> Column:
    """A case's text without the secondary sections that the question doesn't want; all of it if it wants all."""
    starts = lambda line, some: F.exists(F.array(*map(F.lit, some)), lambda h: F.startswith(line, h))
    begin = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(True).alias("on"))

    def left(wanted: Column) -> Column:
        def step(now: Column, line: Column) -> Column:
            on = F.when(starts(line, tuple(h for h, _ in SECTIONS)), F.exists(wanted, lambda h: F.startswith(line, h))).when(starts(line, CORE_HEADERS), F.lit(True)).otherwise(now["on"])
            return once(on, lambda on: F.struct(F.when(on, F.concat(now["lines"], F.array(line))).otherwise(now["lines"]).alias("lines"), on.alias("on")))

        kept = F.array_join(F.aggregate(F.split(text, "\n"), begin, step)["lines"], "\n")
        return F.when(F.size(wanted) == len(SECTIONS), text).otherwise(kept)

    return once(wanted_sections(question), left)


def web_search(question: Column) -> Column:
    """Whether a question's words call for a search on the web."""
    return has_any(question, WEB_WORDS + WEB_TOPICS)


def asks_for_web(question: Column) -> Column:
    """Whether a question asks for such a search by name."""
    return has_any(question, WEB_WORDS) | F.lower(question).rlike("(?iu)" + "|".join(WEB_FORMS))


def answer_mode(question: Column, changes: Column, enabled: Column | None = None) -> Column:
    """(mode, specialised, whole_context, web, asked_for_web) of a question: how it is answered and with what.

    A question of deadlines comes before one of changes, which has a prompt of its own only where the last sync
    has ``changes`` (their number, null for none); both get the whole text of the case, others its sections that they ask for.  The web is
    searched where that is ``enabled`` or the question calls for it, whatever the mode.
    """
    deadline, updates = has_any(question, DEADLINE_QUESTIONS), has_any(question, UPDATE_QUESTIONS)
    web = web_search(question) if enabled is None else web_search(question) | F.coalesce(enabled, F.lit(False))
    mode = F.when(deadline, "deadline").when(updates, "updates").otherwise("plain")
    specialised = deadline | (updates & (F.coalesce(changes, F.lit(0)) > 0))
    return F.struct(mode.alias("mode"), specialised.alias("specialised"), (deadline | updates).alias("whole_context"), web.alias("web"), (web & asks_for_web(question)).alias("asked_for_web"))


def inventory_label(reference: Column, procedure: Column, filename: Column, origin: Column, folio: Column, book: Column, date: Column) -> Column:
    """How a document is called in an inventory: its reference, else procedure, file or origin, with folio and book, and its date."""
    of = F.coalesce(origin, F.lit("documento"))
    name = F.coalesce(*(F.nullif(x, F.lit("")) for x in (reference, procedure, filename)), of)
    place = F.concat(F.lit("("), F.concat_ws(", ", of, F.concat(F.lit("F"), folio.cast("string")), _given(book)), F.lit(")"))
    return F.concat_ws(" — ", name, place, _given(date))


# The lines of an inventory.
INVENTORY = ("=== INVENTARIO DE DOCUMENTOS DE LA CAUSA ===", "REGLA: Solo puedes afirmar sobre el contenido de documentos [INCLUIDO].", "Para documentos [NO INCLUIDO] o [SIN TEXTO EXTRAÍDO], declara explícitamente que no tienes acceso a su contenido.", "=== FIN INVENTARIO ===")
INVENTORY_PARTS = (
    ("included", " [INCLUIDO]", "INCLUIDOS EN CONTEXTO (", " docs — puedes analizar su contenido):"),
    ("left_out", " [NO INCLUIDO por presupuesto de contexto]", "NO INCLUIDOS (", " docs — texto extraído pero fuera de presupuesto):"),
    ("pending", " [SIN TEXTO EXTRAÍDO — PDF pendiente de procesamiento]", "PENDIENTES DE EXTRACCIÓN (", " docs — NO disponibles):"),
)
INVENTORY_NOTE = (
    "", "⚠️ NOTA: Hay documentos recién sincronizados cuyo texto aún se está extrayendo.", "Si el usuario pregunta por su contenido, informa que los documentos se están procesando",
    "y que el análisis completo estará disponible en unos momentos al consultar nuevamente.",
)


def inventories(docs: DataFrame) -> DataFrame:
    """(case_id, inventory) of ``docs`` (case_id, pos, label, selected, completed, syncing): one text a case, whose documents are in it, left out or pending, by ``pos``.

    The note on documents whose text is being extracted is there where one of a case is ``syncing``.
    """
    state = F.when(F.col("selected"), "included").when(F.col("completed"), "left_out").otherwise("pending")
    row = docs.withColumn("state", state)
    lists = [F.array_sort(F.collect_list(F.when(F.col("state") == name, F.struct("pos", F.concat(F.lit("  - "), "label", F.lit(end)).alias("line"))))).alias(name) for name, end, _, _ in INVENTORY_PARTS]
    cases = row.groupBy("case_id").agg(*lists, F.coalesce(F.bool_or("syncing"), F.lit(False)).alias("syncing"))
    none = F.array().cast("array<string>")
    parts = [F.when(F.size(n) > 0, F.concat(F.array(F.concat(F.lit(head), F.size(n).cast("string"), F.lit(tail))), F.col(f"{n}.line"))).otherwise(none) for n, _, head, tail in INVENTORY_PARTS]
    note = F.when(F.col("syncing"), F.array(*map(F.lit, INVENTORY_NOTE))).otherwise(none)
    lines = F.concat(F.array(F.lit(INVENTORY[0])), *parts, note, F.array(F.lit(""), *map(F.lit, INVENTORY[1:])))
    return cases.select("case_id", F.array_join(lines, "\n").alias("inventory"))


def file_tag(url: Column, caption: Column) -> Column:
    return F.coalesce(first_rule(F.concat(F.lower(F.coalesce(url, F.lit(""))), F.lit(" "), F.upper(F.coalesce(caption, F.lit("")))), FILE_TAGS), F.lit("otro"))


def _named(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), key)


def _given(*parts: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != "")


def folio_of(folio: Column, page: Column) -> Column:
    """The folio, or the page where there is none, as text; null where both are missing or zero."""
    return F.nullif(F.coalesce(folio, page), F.lit(0)).cast("string")


def embedding_input(text: Column, document_type: Column, description: Column, section_type: Column, section_ordinal: Column, section_confidence: Column, procedure: Column, folio: Column, page: Column, book: Column) -> Column:
    """A chunk's whole text after a bracketed head of what is known of it; sections only where they are sure."""
    section = F.when((F.coalesce(section_confidence, F.lit(0.0)) >= SURE) & (section_type != "general"), F.concat_ws(" ", _named(SECTION_NAMES, section_type), F.nullif(section_ordinal, F.lit(0)).cast("string")))
    parts = _given(F.nullif(_named(TYPE_NAMES, document_type), F.lit("")), description, section, _named(PROCEDURE_NAMES, procedure), F.concat(F.lit("Folio "), folio_of(folio, page)), book)
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " | "), F.lit("] "), text)).otherwise(text)


def citation_date(date: Column) -> Column:
    """DD/MM/YYYY as it is, and of YYYY-MM-DD."""
    return F.when(F.contains(date, F.lit("/")), date).otherwise(F.regexp_replace(date, r"^([^-]+)-([^-]+)-([^-]+)$", "$3/$2/$1"))


def citation_label(description: Column, document_type: Column, date: Column, folio: Column, page: Column, book: Column, page_number: Column) -> Column:
    name = F.coalesce(description, document_type, F.lit("Documento"))
    number = F.concat(F.lit("(pág. "), F.nullif(page_number, F.lit(0)).cast("string"), F.lit(")"))
    rest = _given(F.concat(F.lit("de fecha "), F.nullif(citation_date(date), F.lit(""))), F.concat(F.lit("folio "), folio_of(folio, page)), F.concat(F.lit("cuaderno "), F.nullif(book, F.lit(""))), number)
    return F.array_join(F.concat(F.array(name), rest), ", ")


def size_tier(size: Column) -> Column:
    """The tier of a file's bytes; null for a null size."""
    tier = F.when(size.isNull(), None)
    for name, most in SIZE_TIERS:
        tier = tier.when(size <= most, name)
    return tier.otherwise(LARGEST_TIER)


def processing_estimates(size: Column) -> Column:
    """What a file of so many bytes costs: seconds to send it, tokens, pages and cents-rounded prices of reading it first and again."""
    megabytes = size / F.lit(float(MEGABYTE))
    tokens = F.ceil(megabytes * TEXT_SHARE * TOKENS_PER_MEGABYTE)
    money = lambda price, digits: F.round(tokens / F.lit(1e6) * price, digits)
    return F.struct(F.ceil(megabytes / SENT_PER_SECOND).alias("upload_seconds"), tokens.alias("tokens"), F.ceil(megabytes / PAGE_MEGABYTES).alias("pages"), money(*FIRST_PRICE).alias("first_cost"), money(*CACHED_PRICE).alias("cached_cost"))
