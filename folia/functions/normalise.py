"""Cleaning of extracted court texts: an ordered chain of removals, and what each of them finds.

Patterns are stated for the JVM; letters with accents are given by class, so that texts in either
spelling match.  Order matters: later patterns count on the earlier removals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.folds import once

# The forms of the artefacts in extracted court documents.
SIGNATURE_CODE = r"[A-Z0-9]{5,20}"
SIGNATURE = r"(?iu)(?:(?:SEC\s+)?C[óo]digo|Cvc)\s*:?\s*([A-Z0-9]{5,20})\s+Este documento tiene firma electr[óo]nica y su original puede ser validado en\s+h\s*t\s*t\s*p\s*s?\s*:\s*/\s*/\s*v\s*e\s*r\s*i\s*f\s*i\s*c\s*a\s*d\s*o\s*c\s*\.\s*p\s*j\s*u\s*d\s*\.\s*c\s*l(?:\s+o\s+en\s+la\s+tramitaci[óo]n\s+de\s+la\s+causa\.?)?"
PAGE_MARKER = r"--\s*(\d{1,4})\s+of\s+(\d{1,4})\s*--"
OCR_PAGE_MARKER = r"(?<=\s)-(\d{1,3})-(?=\s)"
REPEATED_ROL = r"[CEV]-\d{1,6}-\d{4}\s+Foja:\s*\d+"
HOUR_NOTICE = r"(?isu)A contar del \d{2} de \p{L}+ de \d{4},\s*la hora visualizada .*?https?://www\.horaoficial\.cl"
PRIVATE_SIGNER = r"(?iu)C[óo]digo:\s*\d{10,20}\s+validar en https?://www\.esigner\.cl/\S+"
SCANNER = r"(?i)Scanned with \w+"
HEADER = (
    r"(?iu)(?:FOJA:\s*\d+\s*\.-[^.]*?\.-\s*)?NOMENCLATURA\s*:\s*(?:\d+\.\s*\[\d+\][^\[]*?)+\s*JUZGADO\s*:\s*(.*?)(?:\s*º)?\s*CAUSA\s+ROL\s*:\s*([CEV]-\d{1,6}-\d{4})"
    r"\s+CARATULADO\s*:\s*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s./()&0-9-]*)(?=\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+,)"
)
SHEET = r"FOJA:\s*(\d+)\s*\.-\s*([^.]*)\.-"
NOMENCLATURE = r"\[(\d+)\]([^\[]*?)(?=\d+\.\s*\[|\s*JUZGADO)"
FLOATING_ACCENT = r"\s+[óáéíúñÓÁÉÍÚÑ]\s+(?=\p{L})"
GARBLED_SIGNATURE = r"(?iu)[A-ZÁÉÍÓÚÑ]+\s+Firmado\s+digitalmente\s+[A-ZÁÉÍÓÚÑ]+\s+por\s+[A-ZÁÉÍÓÚÑ\s]+\s*Fecha:\s*\d{4}\.\d{2}\.\d{2}\s*[A-ZÁÉÍÓÚÑ]+\s+\d{2}:\d{2}:\d{2}\s*-\d{2}'\d{2}'"
# Words that lose an accented letter in extraction, and how they are spelt, in the order of their repair.
# A bar is the edge of a word, an underline white space beside it.
REPAIRS = (
    # -ción, -sión
    ("ci n|", "ción"), ("si n|", "sión"),
    # código
    ("|C digo", "Código"), ("|c digo", "código"),
    # ñ
    ("|se ala", "señala"), ("|Se ala", "Señala"), ("|se al|", "señal"), ("_a o_", "año"), ("|do a|", "doña"), ("|Do a|", "Doña"), ("|da o", "daño"), ("|Da o", "Daño"), ("|due o", "dueño"), ("|ni o", "niño"), ("|compa ", "compaña"), ("|rese ado", "reseñado"), ("|orse ado", "orseñado"),
    ("|Cama o", "Camaño"), ("|Mu oz", "Muñoz"), ("|Nu ez", "Nuñez"), ("|Iba ez", "Ibañez"), ("|Ordo ez", "Ordoñez"), ("|Ya ez", "Yañez"), ("|Zu iga", "Zuñiga"), ("|pe a|", "peña"), ("|Pe a|", "Peña"),
    # -ía
    ("|Miner a|", "Minería"), ("|miner a|", "minería"), ("|policí a|", "policía"),
    # á
    ("|m quina", "máquina"), ("|M quina", "Máquina"), ("|telem tico", "telemático"), ("|telem tica", "telemática"), ("|cl usula", "cláusula"), ("|Cl usula", "Cláusula"), ("|pr ctic", "práctic"), ("_m s_", "más"), ("|dem s|", "demás"), ("|pag r ", "pagar"),
    # é
    ("|c dula", "cédula"), ("|C dula", "Cédula"), ("|m rito", "mérito"), ("|t rmino", "término"), ("|T rmino", "Término"), ("|trav s|", "través"), ("|Andr s|", "Andrés"), ("|P rez|", "Pérez"), ("|Guti rrez|", "Gutiérrez"), ("|Jim nez|", "Jiménez"), ("|Ram rez|", "Ramírez"), ("|Fern ndez|", "Fernández"), ("|Hern ndez|", "Hernández"), ("|Gonz lez|", "González"), ("|Rodr guez|", "Rodríguez"), ("|L pez|", "López"), ("|Mart nez|", "Martínez"),
    # í
    ("_d a_", "día"), ("|d as|", "días"), ("|art culo", "artículo"), ("|Art culo", "Artículo"), ("|art culos", "artículos"), ("|Art culos", "Artículos"), ("|jur dico", "jurídico"), ("|jur dica", "jurídica"), ("|s ntesis", "síntesis"), ("|t tulo", "título"), ("|T tulo", "Título"), ("|per odo", "período"), ("|Per odo", "Período"), ("|Roc o|", "Rocío"),
    # ú
    ("|gr as|", "grúas"), ("|ltimo", "último"), ("|n mero", "número"), ("|N mero", "Número"), ("|p blico", "público"), ("|P blico", "Público"), ("|p blica", "pública"), ("|P blica", "Pública"),
    # ó
    ("|electr nico", "electrónico"), ("|electr nica", "electrónica"),
    # ordinals
    ("|D cimo|", "Décimo"), ("|d cimo|", "décimo"), ("|D CIMO|", "DÉCIMO"), ("|vig simo", "vigésimo"), ("|VIG SIMO", "VIGÉSIMO"), ("|S ptimo|", "Séptimo"), ("|s ptimo|", "séptimo"), ("|S PTIMO|", "SÉPTIMO"), ("|Und cimo", "Undécimo"), ("|UND CIMO", "UNDÉCIMO"), ("|Duod cimo", "Duodécimo"), ("|DUOD CIMO", "DUODÉCIMO"),
    # verbs and closing formulas
    ("|concedi |", "concedió"), ("|recibi |", "recibió"), ("|Reg strese", "Regístrese"), ("|reg strese", "regístrese"), ("|notif quese", "notifíquese"), ("|arch vese", "archívese"),
    # numbers in words ("veintid s" is 22, and is spelt as 23 here as it is there: a known error that results must share)
    ("|veintis is|", "veintiséis"), ("|Veintis is|", "Veintiséis"), ("|veintitr s|", "veintitrés"), ("|Veintitr s|", "Veintitrés"), ("|veintid s|", "veintitrés"), ("|Veintid s|", "Veintitrés"), ("|habi ndose|", "habiéndose"), ("|Est ndose|", "Estándose"),
)
# The labelled fields of a certificate of sending.
CERTIFICATE_MARKS = ("OFICINA JUDICIAL VIRTUAL", "CERTIFICADO DE ENV")
CERTIFICATE = (
    ("court", r"(?im)Juzgado:\s*(.+?)(?:\s+N[°º]|\s+$)"),
    ("rol", r"(?i)N[°º]\s*Rol/Rit:\s*([^\s]+)"),
    ("ruc", r"(?i)Ruc:\s*([^\s]+)"),
    ("caption", r"(?im)Caratulado:\s*(.+?)(?:\s+Procedimiento|\s+$)"),
    ("procedure", r"(?im)Procedimiento:\s*(.+?)(?:\s+Materia|\s+$)"),
    ("matter", r"(?im)Materia\(s\):\s*(.+?)(?:\s+Fecha|\s+$)"),
    ("sent", r"(?i)Fecha\s+Env[ií]o\s*:\s*(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})"),
)

REMOVALS = (("signature", SIGNATURE), ("page_marker", PAGE_MARKER), ("page_marker", OCR_PAGE_MARKER), ("repeated_rol", REPEATED_ROL), ("header", HEADER), ("hour_notice", HOUR_NOTICE), ("private_signer", PRIVATE_SIGNER), ("private_signer", GARBLED_SIGNATURE), ("scanner", SCANNER))


# For each removal, a stretch that any match of its pattern holds, and whether in lower case.
REMOVAL_HELD = (("este documento tiene firma electr", True), ("--", False), ("-", False), ("Foja:", False), ("nomenclatura", True), ("la hora visualizada ", True), ("validar en http", True), ("firmado", True), ("scanned with ", True))
#: What Java takes for an i, a k or an s in any case, though lower case is another.
ODD = ("\u0130", "\u0131", "\u017f", "\u212a")


def _low(text: Column) -> Column:
    """A text as it is (text), in lower case (low), and whether lower case isn't all that patterns of any case match (odd)."""
    odd = (F.length(text) != F.octet_length(text)) & reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in ODD))
    return F.struct(text.alias("text"), F.lower(text).alias("low"), odd.alias("odd"))


def removed(text: Column, *kinds: str) -> Column:
    """``text`` without the artefacts of ``kinds`` (all of them by default), in the chain's order.

    A pattern runs only where what is left of the text by then holds the stretch that any match has.
    """
    now = _low(text)
    for (kind, pattern), (held, low) in zip(REMOVALS, REMOVAL_HELD, strict=True):
        if not kinds or kind in kinds:
            now = once(now, _without(pattern, held, low))
    return now["text"]


def _without(pattern: str, held: str, low: bool) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        may = x["odd"] | F.contains(x["low"], F.lit(held)) if low else F.contains(x["text"], F.lit(held))
        less = once(F.regexp_replace(x["text"], pattern, ""), lambda y: F.when(y == x["text"], x).otherwise(_low(y)))
        return F.when(may, less).otherwise(x)

    return step


def occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _pattern(broken: str) -> str:
    """The letters come first and what must be before them is looked for from their end, as most places already fail at the first letter."""
    letters = broken.strip("|_")
    before = rf"(?<![\p{{L}}\p{{N}}_]{letters})" if broken[0] == "|" else rf"(?<=\s{letters})" if broken[0] == "_" else ""
    after = r"(?![\p{L}\p{N}_])" if broken[-1] == "|" else r"(?=\s)" if broken[-1] == "_" else ""
    return letters + before + after


def _ending(broken: str) -> str:
    """The letters from the gap on, where they are long enough to be rare; else empty."""
    _, _, ending = broken.strip("|_").partition(" ")
    return ending if len(ending) > 2 else ""


def _rare() -> str:
    """A pattern that is found wherever the letters of a repair with a rare ending are."""
    firsts: dict[str, set[str]] = {}
    for e in filter(None, (_ending(b) for b, _ in REPAIRS)):
        firsts.setdefault(e[0], set()).add(e[1:])
    return " (?:" + "|".join(f"{k}(?:{'|'.join(sorted(v))})" for k, v in sorted(firsts.items())) + ")"


def repairs(text: Column) -> Column:
    """(text, fixes): floating accents go, then known words get their accented letter back, and how many of both there were.

    One fold over the table of repairs; a pattern runs only on texts that hold its letters.  Letters with a rare ending are looked for all at
    once, and one by one only if some are there or the text has changed since.
    """
    rules = F.array(*(F.struct(F.lit(b.strip("|_")).alias("letters"), F.lit(_pattern(b)).alias("pattern"), F.lit(w).alias("whole"), F.lit(_ending(b) != "").alias("rare")) for b, w in REPAIRS))

    def begun(t: Column) -> Column:
        accents = (F.length(t) != F.octet_length(t)) & t.rlike(FLOATING_ACCENT.replace(r"\s+", r"\s", 1))
        new = F.when(accents, F.regexp_replace(t, FLOATING_ACCENT, " ")).otherwise(t)
        return F.struct(new.alias("text"), F.when(accents, occurrences(t, FLOATING_ACCENT)).otherwise(0).cast("int").alias("fixes"))

    def step(now: Column, r: Column) -> Column:
        mended = lambda y: F.when(y == now["text"], now).otherwise(F.struct(y.alias("text"), (now["fixes"] + F.regexp_count(now["text"], r["pattern"])).cast("int").alias("fixes"), F.lit(True).alias("rare")))
        return F.when((now["rare"] | ~r["rare"]) & F.contains(now["text"], r["letters"]), once(F.regexp_replace(now["text"], r["pattern"], r["whole"]), mended)).otherwise(now)

    start = once(once(text, begun), lambda x: F.struct(x["text"].alias("text"), x["fixes"].alias("fixes"), x["text"].rlike(_rare()).alias("rare")))
    return F.aggregate(rules, start, step, lambda x: F.struct(x["text"].alias("text"), x["fixes"].alias("fixes")))


def repaired(text: Column) -> Column:
    return repairs(text)["text"]


def certificate(text: Column) -> Column:
    """The labelled fields of a certificate of sending, null where the text isn't one or has no such field; the text stays as it is."""
    one = F.contains(text, F.lit(CERTIFICATE_MARKS[0])) & F.contains(text, F.lit(CERTIFICATE_MARKS[1]))
    return F.struct(*(F.when(one, F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))).alias(n) for n, p in CERTIFICATE))


def total_pages(text: Column) -> Column:
    """The largest M of the markers 'N of M' of the raw text; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(2)), lambda m: m.cast("int")))


def squeezed(text: Column) -> Column:
    """Runs of blanks become one space, lines are trimmed, three or more line ends become two."""
    text = F.regexp_replace(text, r"[ \t\f\x0B\r\x{A0}]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalised(text: Column) -> Column:
    """The whole chain; a null or blank text becomes an empty one."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, F.lit("")).otherwise(squeezed(repaired(removed(text))))


def statistics(raw: Column, clean: Column) -> Column:
    """Lengths, and by how many per cent the text got shorter, rounded half up."""
    n, m = F.length(raw), F.length(clean)
    return F.struct(n.alias("raw_length"), m.alias("clean_length"), F.when(n > 0, F.floor((n - m) * 100 / n + 0.5)).otherwise(0).alias("reduction"))


def header(text: Column) -> Column:
    """Court, rol and caption of a document's first header; empty where there is none."""
    return F.struct(*(F.trim(F.regexp_replace(F.regexp_extract(text, HEADER, k), r"\s+", " ")).alias(n) for k, n in ((1, "court"), (2, "rol"), (3, "caption"))))


def header_block(text: Column) -> Column:
    """All that a document's first header says: sheet, its number in words, nomenclatures by code, court, rol and caption; null where there is no header.

    A court's number gets the sign of an ordinal that extraction lost, or took to the end of the name.  The caption is that of its first line.
    """
    block = F.regexp_extract(text, HEADER, 0)
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    court = given(F.regexp_replace(F.regexp_extract(text, HEADER, 1), r"(?U)\s+", " "))
    court = F.when(court.rlike(r"^\d+\s") & ~F.contains(court, F.lit("º")), F.regexp_replace(court, r"^(\d+)\s", "$1º ")).otherwise(court)
    parts = F.arrays_zip(F.regexp_extract_all(block, F.lit(NOMENCLATURE), F.lit(1)).alias("code"), F.regexp_extract_all(block, F.lit(NOMENCLATURE), F.lit(2)).alias("text"))
    named = F.transform(parts, lambda x: F.struct(x["code"].cast("int").alias("code"), F.trim(F.regexp_replace(x["text"], r"\s+", " ")).alias("text")))
    return F.when(
        block != "",
        F.struct(
            F.nullif(F.regexp_extract(block, SHEET, 1), F.lit("")).cast("int").alias("sheet"), given(F.regexp_extract(block, SHEET, 2)).alias("sheet_text"), named.alias("nomenclatures"),
            court.alias("court"), F.regexp_extract(text, HEADER, 2).alias("rol"), given(F.regexp_extract(F.regexp_extract(text, HEADER, 3), r"^[^\n]*", 0)).alias("caption"),
        ),
    )


def annotated(text: Column, *kinds: str) -> Column:
    """A dry run: each artefact stays, between marks that name its kind, instead of being removed."""
    for kind, pattern in REMOVALS:
        if not kinds or kind in kinds:
            text = F.regexp_replace(text, pattern, f"««{kind}»»$0««/{kind}»»")
    return text
