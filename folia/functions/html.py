"""Rows of HTML tables, and the columns that each kind of court table has.

One parser gives the table rows of a page with their cell texts, forms and links, and with the ids of the
elements around them.  A declared shape for each kind says in which tab its rows are, how many cells a
row needs, which must be a number or present, what they are called, and which cells hold documents.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.slices import of_text
from folia.sources.tables import cell

ROWS = (
    "array<struct<table_no: int, row_no: int, heading: boolean, body: boolean, scopes: array<string>, classes: array<string>, cells: array<string>, token: string, "
    "forms: array<struct<cell: int, action: string, name: string, value: string>>, clicks: array<struct<cell: int, tag: string, onclick: string>>, titles: array<struct<cell: int, title: string, text: string>>>>"
)
#: Tags that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A token has more characters than this.
SHORT = 20


def _row(table: dict, no: int) -> dict:
    return {"table_no": table["no"], "row_no": no, "heading": False, "body": table["body"], "scopes": table["scopes"], "classes": table["classes"], "cells": [], "token": None, "forms": [], "clicks": [], "titles": []}


class _Reader(HTMLParser):
    """Cell texts by row; nested tables are rows of their own table.  Forms outside of tables are in a row -1 of a table -1."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.tables, self.open = [], [], 0, []
        self.outside = _row({"no": -1, "body": False, "scopes": [], "classes": []}, -1)
        self.form = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        top = self.stack[-1] if self.stack else None
        if tag == "table":
            scopes = [i for _, i in self.open if i] + ([attrs["id"]] if attrs.get("id") else [])
            self.stack.append({"no": self.tables, "count": -1, "row": None, "text": None, "title": None, "body": False, "scopes": scopes, "classes": (attrs.get("class") or "").split()})
            self.tables += 1
        elif top and tag in ("tbody", "thead", "tfoot"):
            self._end_row(top)
            top["body"] = tag == "tbody"
        elif top and tag == "tr":
            self._end_row(top)
            top["count"] += 1
            top["row"] = _row(top, top["count"])
        elif top and top["row"] is not None and tag in ("td", "th"):
            self._end_cell(top)
            top["text"] = []
            top["row"]["heading"] |= tag == "th"
        row = top["row"] if top and top["row"] is not None else self.outside
        at = len(row["cells"]) if top and top["text"] is not None else -1
        if tag == "form":
            self._end_form()
            self.form = (row, {"cell": at, "action": attrs.get("action") or "", "name": None, "value": None, "hidden": False})
        elif tag == "input":
            value, hidden = attrs.get("value") or "", (attrs.get("type") or "").lower() == "hidden"
            if len(value) > SHORT and row is not self.outside:
                row["token"] = row["token"] or value
            if self.form and (self.form[1]["value"] is None or hidden > self.form[1]["hidden"]):
                self.form[1].update(name=attrs.get("name") or "", value=value, hidden=hidden)
        elif tag in ("a", "label"):
            row["clicks"].append({"cell": at, "tag": tag, "onclick": attrs.get("onclick") or ""})
        elif tag == "span" and top and top["text"] is not None and ("title" in attrs or "topToolNom" in (attrs.get("class") or "").split()):
            top["title"] = (row, {"cell": at, "title": attrs.get("title"), "text": ""})
        if tag not in VOID:
            self.open.append((tag, attrs.get("id")))

    def handle_data(self, data):
        if self.stack and self.stack[-1]["text"] is not None:
            self.stack[-1]["text"].append(data)
            if self.stack[-1]["title"]:
                self.stack[-1]["title"][1]["text"] += data

    def handle_endtag(self, tag):
        if tag == "form":
            self._end_form()
        if self.stack:
            top = self.stack[-1]
            if tag == "span" and top["title"]:
                top["title"][0]["titles"].append(top["title"][1])
                top["title"] = None
            elif tag in ("td", "th"):
                self._end_cell(top)
            elif tag in ("tr", "tbody", "thead"):
                self._end_row(top)
                top["body"] &= tag == "tr"
            elif tag == "table":
                self._end_row(top)
                self.stack.pop()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def _end_form(self):
        if self.form and self.form[1].pop("hidden") is not None and self.form[1]["value"] is not None:
            self.form[0]["forms"].append(self.form[1])
        self.form = None

    def _end_cell(self, top):
        if top["text"] is not None:
            top["row"]["cells"].append("".join(top["text"]))
            top.update(text=None, title=None)

    def _end_row(self, top):
        self._end_cell(top)
        if top["row"] is not None:
            self.rows.append(top["row"])
            top["row"] = None


def read(page: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader._end_form()
    while reader.stack:
        reader._end_row(reader.stack.pop())
    rows = reader.rows + ([reader.outside] if reader.outside["forms"] else [])
    return sorted(rows, key=lambda r: (r["table_no"], r["row_no"]))


def html_rows(page: Column | str) -> Column:
    """The table rows of a page, as an array of structs."""
    return of_text(read, ROWS, page)


class Shape(NamedTuple):
    """What rows of a kind of table are like.

    columns: (name, cell); scope: id of the tab around them, None for the whole page; least: cells a
    row needs; number: a column of a whole number without which a row is dropped; whole: (name, cell) of a
    number that is 0 where there is none; any_of: columns of which one isn't empty; documents: (name, cell,
    parts of the form's action); clicks: (name, cell, function called); links: (name, cell) of cells with a link;
    token: documents of which one must be there; titled: a column of a cell whose span's text and title count.
    """

    columns: tuple[tuple[str, int], ...]
    scope: str | None = None
    least: int = 0
    number: tuple[str, int] | None = None
    whole: tuple[str, int] | None = None
    any_of: tuple[str, ...] = ()
    documents: tuple[tuple[str, int, tuple[str, ...]], ...] = ()
    clicks: tuple[tuple[str, int, str], ...] = ()
    links: tuple[tuple[str, int], ...] = ()
    token: str | None = None
    titled: tuple[str, int] | None = None


# The tabs, cells and form actions of each kind of table.
TABLES = {
    "folio_history": Shape((("stage", 3), ("procedure", 4), ("description", 5), ("date", 6)), "historiaCiv", 7, ("folio", 0), ("page", 7), (), (("document", 1, ("docuS.php", "docuN.php")), ("certificate", 1, ("docCertificadoEscrito.php",))), (("annex", 2, "anexoSolicitudCivil"),)),
    "litigants": Shape((("participant", 0), ("rut", 1), ("person", 2), ("name", 3)), "litigantesCiv", any_of=("participant", "name")),
    "notifications": Shape((("rol", 0), ("state", 1), ("type", 2), ("date", 3), ("participant_type", 4), ("name", 5), ("procedure", 6), ("failure", 7)), "notificacionesCiv", any_of=("rol", "type")),
    "pending_filings": Shape((("date", 2), ("type", 3), ("applicant", 4)), "escritosCiv", any_of=("type", "date"), documents=(("document", 0, ("docuS.php", "docuN.php")),), links=(("annex", 1),)),
    "letters_rogatory": Shape((("origin", 0), ("type", 1), ("destination", 2), ("ordered", 3), ("entered", 4), ("court", 5), ("state", 6)), "exhortosCiv", any_of=("origin", "type"), clicks=(("detail", 2, "detalleExhortosCivil"),)),
    "rogatory_pieces": Shape((("book", 2), ("stage", 4), ("procedure", 5), ("description", 6), ("date", 7)), "piezasExhortoCiv", 8, ("folio", 0), ("page", 8), (), (("document", 1, ("docuS.php", "docuN.php")),), links=(("annex", 3),)),
    "annexes": Shape((("date", 1), ("reference", 2)), None, 2, documents=(("document", 0, ("anexoDocCivil.php", "docuS.php", "docuN.php", "docu.php")),), token="document"),
    "rogatory_documents": Shape((("date", 1), ("reference", 2), ("procedure", 3)), None, 3, documents=(("document", 0, ("docDetalleExhorto.php",)),), token="document"),
    "bailiff_withdrawals": Shape((("book", 0), ("data", 1), ("date", 2), ("state", 3)), None, 4, any_of=("book", "data")),
    "appeal_movements": Shape((("procedure", 3), ("date", 5), ("room", 6), ("state", 7)), "movimientosApe", 8, ("folio", 0), None, (), (("document", 1, ("docCausaApelaciones.php",)), ("certificate", 1, ("docCertificadoEscrito.php",))), (("annex", 2, "anexoEscritoApelaciones"),), titled=("description", 4)),
    "appeal_annexes": Shape((("code", 1), ("type", 2), ("quantity", 3), ("remark", 4)), None, 4, documents=(("document", 0, ("anexoDocEscritoApelaciones.php",)),), token="document"),
    "appeal_litigants": Shape((("subject", 0), ("rut", 1), ("person", 2), ("name", 3)), "litigantesApe", any_of=("subject", "name")),
}
APPEAL_LISTS = {"appeal_letters_rogatory": "ExhortosApe", "appeal_incompetence": "IncompetenciaApe"}
TITLES = "table-titulos"
APPEAL_FIELDS = (
    (0, "book", r"(?i)Libro\s*:?\s*(.+)"), (0, "date", r"(?i)Fecha\s*:?\s*(\d{2}/\d{2}/\d{4})"), (0, "appeal_state", r"(?i)Estado\s+Recurso\s*:?\s*(.+)"),
    (1, "procedural_state", r"(?i)Estado\s+Procesal\s*:?\s*(.+)"), (1, "place", r"(?i)Ubicaci[oó]n\s*:?\s*(.+)"), (1, "appeal", r"(?i)Recurso\s*:?\s*(.+)"),
    (2, "court", r"(?i)Corte\s*:?\s*(.+)"),
)
ORIGIN_FIELDS = (
    ("origin", r"(?i)Causa\s+Origen\s*:?\s*([A-Z]\s*-\s*\d{1,8}\s*-\s*\d{4})"), ("court", r"(?i)Tribunal\s*:?\s*(.+?)(?:$|Caratulado|Materia|Ruc|Fecha)"), ("caption", r"(?i)Caratulado\s*:?\s*(.+?)(?:$|Materia|Ruc|Fecha)"),
    ("matter", r"(?i)Materia\s*:?\s*(.+?)(?:$|Ruc|Fecha)"), ("ruc", r"(?i)Ruc\s*:?\s*(\S+)"), ("entered", r"(?i)Fecha\s+Ingreso\s*:?\s*(\d{2}/\d{2}/\d{4})"),
)
ORIGIN_DETAIL, JWT = "detalleCausaCivil", r"(eyJ[A-Za-z0-9_-]+\.[\w-]+\.[\w-]+)"


def _cell(i: int) -> Column:
    return cell(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))


def _whole(i: int) -> Column:
    """The number that a cell's text begins with; null where it doesn't."""
    return F.nullif(F.regexp_extract(_cell(i), r"^([+-]?\d{1,9})", 1), F.lit("")).cast("int")


def _form(i: int, *parts: str) -> Column:
    """The token of the first form of a cell whose action has one of the parts and whose token is long enough."""
    fits = F.filter("forms", lambda f: (f["cell"] == i) & (F.length(f["value"]) > SHORT) & F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(f["action"], p)))
    return F.get(fits, F.lit(0))["value"]


def _called(i: int, function: str) -> Column:
    """The token that a link or label of a cell hands to a function."""
    found = F.transform(F.filter("clicks", lambda c: c["cell"] == i), lambda c: F.regexp_extract(c["onclick"], rf"(?i){function}\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1))
    return F.get(F.filter(found, lambda t: F.length(t) > SHORT), F.lit(0))


def _has_link(i: int) -> Column:
    return F.exists("clicks", lambda c: (c["cell"] == i) & (c["tag"] == "a"))


def _body_rows(pages: DataFrame, key: str, html: str, scope: str | None) -> DataFrame:
    rows = pages.select(key, F.explode(html_rows(html)).alias("r")).select(key, "r.*").where(F.col("body") & ~F.col("heading"))
    return rows if scope is None else rows.where(F.array_contains("scopes", scope))


def extract(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of the tables of one kind: those in the kind's tab that have its cells, with has_X and X_token for documents."""
    shape = TABLES[name]
    rows = _body_rows(pages, key, html, shape.scope).where(F.size("cells") >= shape.least)
    made = [_cell(i).alias(c) for c, i in shape.columns]
    if shape.number:
        made.append(_whole(shape.number[1]).alias(shape.number[0]))
    if shape.whole:
        made.append(F.coalesce(_whole(shape.whole[1]), F.lit(0)).alias(shape.whole[0]))
    if shape.titled:
        column, i = shape.titled
        span = F.get(F.filter("titles", lambda t: t["cell"] == i), F.lit(0))
        made += [F.coalesce(F.nullif(cell(span["text"]), F.lit("")), _cell(i)).alias(column), F.nullif(F.trim(span["title"]), F.lit("")).alias("nomenclatures")]
    made += [_form(i, *parts).alias(f"{c}_token") for c, i, parts in shape.documents] + [_called(i, f).alias(f"{c}_token") for c, i, f in shape.clicks]
    made += [_has_link(i).alias(f"has_{c}") for c, i in shape.links]
    named = rows.select(key, "table_no", "row_no", *made)
    if shape.number:
        named = named.where(F.col(shape.number[0]).isNotNull())
    if shape.any_of:
        named = named.where(F.greatest(*(F.length(c) for c in shape.any_of)) > 0)
    if shape.token:
        named = named.where(F.col(f"{shape.token}_token").isNotNull())
    return named.select("*", *(F.col(f"{c}_token").isNotNull().alias(f"has_{c}") for c, *_ in (*shape.documents, *shape.clicks)))


def appeal_list(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, entry): the second cell's text, or the first one's, of the rows of one of an appeal's lists."""
    entry = F.coalesce(F.nullif(_cell(1), F.lit("")), _cell(0))
    return _body_rows(pages, key, html, APPEAL_LISTS[name]).select(key, entry.alias("entry")).where("entry <> ''")


def _titled_tables(all_rows: str) -> Column:
    """By table, in order, the body rows of a page's tables of titles."""
    rows = F.filter(all_rows, lambda r: F.array_contains(r["classes"], TITLES) & r["body"])
    return F.transform(F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["table_no"]))), lambda no: F.filter(rows, lambda r: r["table_no"] == no))


def appeal_metadata(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each page: the labelled fields of the first table of titles, null where there are none."""
    rows = pages.select(key, html_rows(html).alias("all")).select(key, F.get(_titled_tables("all"), F.lit(0)).alias("rows"))

    def field(at: int, pattern: str) -> Column:
        found = F.transform(F.get("rows", F.lit(at))["cells"], lambda c: F.trim(F.regexp_extract(cell(c), pattern, 1)))
        return F.try_element_at(F.filter(found, lambda v: v != ""), F.lit(-1))

    return rows.select(key, *(field(at, pattern).alias(name) for at, name, pattern in APPEAL_FIELDS))


def appeal_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each page: tokens of an appeal's direct documents, null where there are none."""
    rows = pages.select(key, html_rows(html).alias("every")).select(key, F.flatten(F.transform("every", lambda r: r["forms"])).alias("all"), F.get(_titled_tables("every"), F.lit(1)).alias("rows"))
    rows = rows.select(key, "all", F.flatten(F.transform("rows", lambda r: r["forms"])).alias("forms"), F.flatten(F.transform("rows", lambda r: r["clicks"])).alias("clicks"))

    def first(forms: str, name: str | None, *parts: str, but: tuple[str, ...] = ()) -> Column:
        has = lambda f, some: F.exists(F.array(*map(F.lit, some)), lambda p: F.contains(f["action"], p))
        form = F.get(F.filter(forms, lambda f: has(f, parts) & ~(has(f, but) if but else F.lit(False))), F.lit(0))
        ok = (F.length(form["value"]) > SHORT) & ((form["name"] == name) if name else F.lit(True))
        return F.when(ok, form["value"])

    click = F.get(F.filter("clicks", lambda c: (c["tag"] == "a") & F.contains(c["onclick"], F.lit("anexo"))), F.lit(0))["onclick"]
    return rows.select(
        key, first("all", "dtaEbook", "newebookapelaciones").alias("ebook_token"), first("forms", "dtaCert", "docCertificado").alias("certificate_token"),
        first("forms", None, "docTexto", "docu", but=("newebookapelaciones", "docCertificado")).alias("text_token"), F.nullif(F.regexp_extract(click, JWT, 1), F.lit("")).alias("annex_token"),
    )


def appeal_origin(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each page with an origin file: the labelled fields of the first table of titles in its tab, and the token of its detail."""
    tables = F.filter("all", lambda r: F.array_contains(r["scopes"], "expedienteApe") & F.array_contains(r["classes"], TITLES))
    own = pages.select(key, html_rows(html).alias("all")).select(key, tables.alias("tables")).where(F.size("tables") > 0)
    own = own.select(key, F.filter("tables", lambda r: r["table_no"] == F.col("tables")[0]["table_no"]).alias("rows"))
    text = cell(F.array_join(F.flatten(F.transform("rows", lambda r: r["cells"])), " "))
    link = F.filter(F.flatten(F.transform("rows", lambda r: r["clicks"])), lambda c: (c["tag"] == "a") & F.contains(c["onclick"], F.lit(ORIGIN_DETAIL)))
    own = own.select(key, text.alias("text"), F.get(link, F.lit(0))["onclick"].alias("link"))
    field = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    called = F.regexp_extract("link", rf"(?i){ORIGIN_DETAIL}\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)
    token = F.when(F.length(called) > SHORT, called).otherwise(F.nullif(F.regexp_extract("link", JWT, 1), F.lit("")))
    return own.select(key, *((F.regexp_replace(field(p), r"\s+", "") if name == "origin" else field(p)).alias(name) for name, p in ORIGIN_FIELDS), token.alias("detail_token"))
