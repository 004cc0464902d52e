"""What to take from a page whose layout isn't known: its most likely table, and elements that lead to downloads.

One reader gives the facts of each table and each clickable element; scores are sums of small
weights over these facts, as columns.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.html import VOID
from folia.functions.slices import of_text

# Words of tables and of downloads, and the scores from which a table and an element are accepted.
TABLE_WORDS = ("ROL", "CAUSA", "TRIBUNAL", "CARÁTULA", "FECHA", "TIPO")
DOWNLOAD_WORDS = ("descargar", "download", "pdf", "documento", "escrito", "resolución", "ver", "abrir", "sentencia")
TABLE_LEAST, ELEMENT_LEAST = 2.0, 0.35

FACTS = (
    "struct<tables: array<struct<head: string, first: string, whole: string, rows: int, links: int>>, "
    "elements: array<struct<tag: string, text: string, href: string, onclick: string, class: string, title: string, label: string, data: string, target: string, download: boolean, icons: array<string>, pdf_icon: boolean>>>"
)


class _Reader(HTMLParser):
    """Tables with all text in them, nested tables included, and clickable elements with the text and icons in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.elements = [], []
        self.open: list[tuple[str, dict | None]] = []  # tag and the table or element it began
        self.inside: list[dict] = []  # open tables
        self.clickable: list[dict] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        own = None
        if tag == "table":
            own = {"head": [], "first": [], "whole": [], "rows": 0, "links": 0, "in_head": False, "had_head": False}
            self.tables.append(own)
            self.inside.append(own)
        elif self.inside and tag == "thead":
            self.inside[-1].update(in_head=not self.inside[-1]["had_head"], had_head=True)
        elif self.inside and tag == "tr":
            self.inside[-1]["rows"] += 1
        for table in self.inside:
            table["links"] += tag == "a"
        icon = tag in ("i", "svg", "img") or (tag == "span" and "icon" in attrs.get("class", ""))
        for element in self.clickable if icon else ():
            element["icons"].append(f"{attrs.get('class', '')} {attrs.get('src', '')} {attrs.get('alt', '')}".lower())
            element["pdf_icon"] |= tag == "i" and bool({"fa-file-pdf", "fa-file-pdf-o"} & set(attrs.get("class", "").split()))
        if tag in ("a", "button") or "onclick" in attrs or attrs.get("role") == "button" or (tag == "input" and attrs.get("type") in ("button", "submit")):
            data = " ".join(v for k, v in attrs.items() if k.startswith("data-")).lower()
            low = {name: attrs.get(key, "").lower() for name, key in (("href", "href"), ("onclick", "onclick"), ("class", "class"), ("title", "title"), ("label", "aria-label"))}
            made = {"tag": tag, "text": [], **low, "data": data, "target": attrs.get("target", ""), "download": "download" in attrs, "icons": [], "pdf_icon": False}
            self.elements.append(made)
            if tag not in VOID:
                self.clickable.append(made)
                own = made
        if tag not in VOID:
            self.open.append((tag, own))

    def handle_data(self, data):
        for table in self.inside:
            table["whole"].append(data)
            if table["rows"] <= 1:
                table["first"].append(data)
            if table["in_head"]:
                table["head"].append(data)
        for element in self.clickable:
            element["text"].append(data)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        for name, own in self.open[at:]:
            if name == "thead" and self.inside:
                self.inside[-1]["in_head"] = False
            if own is not None and name == "table":
                self.inside = [t for t in self.inside if t is not own]
            elif own is not None:
                self.clickable = [e for e in self.clickable if e is not own]
        del self.open[at:]


def read(page: str | None) -> dict:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    tables = [{k: "".join(t[k]) for k in ("head", "first", "whole")} | {k: t[k] for k in ("rows", "links")} | ({} if t["had_head"] else {"head": None}) for t in reader.tables]
    return {"tables": tables, "elements": [e | {"text": "".join(e["text"]).lower().strip()} for e in reader.elements]}


def facts(page: Column | str) -> Column:
    """The tables and clickable elements of a page; a null page has none."""
    return of_text(read, FACTS, page)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def table_score(table: Column) -> Column:
    """Two for each word in the head (a thead, else the first row), half for one elsewhere, and something for rows and links."""
    head = F.upper(F.coalesce(F.nullif(table["head"], F.lit("")), table["first"]))
    whole = F.upper(table["whole"])
    words = [F.when(F.contains(head, F.lit(w)), 2.0).when(F.contains(whole, F.lit(w)), 0.5).otherwise(0.0) for w in TABLE_WORDS]
    rows = F.when(table["rows"] > 2, F.least(table["rows"], F.lit(10)) * 0.15).otherwise(0.0)
    return F.round(_sum(words) + rows + F.least(table["links"], F.lit(10)) * 0.1, 4)


def best_table(found: Column) -> Column:
    """(table_no, score, confidence) of a page's best table, the first of equal ones; null where none scores over 2."""
    scores = F.transform(found["tables"], table_score)
    best = F.array_max(scores)
    chosen = F.struct((F.array_position(scores, best) - 1).cast("int").alias("table_no"), best.alias("score"), F.round(F.least(best / 8, F.lit(0.9)), 4).alias("confidence"))
    return F.when(best > TABLE_LEAST, chosen)


def element_score(e: Column) -> Column:
    """From 0 to 1, how likely an element is to lead to a download."""
    every = F.concat_ws(" ", e["text"], e["href"], e["onclick"], e["class"], e["title"], e["label"], e["data"])
    given = lambda condition, worth: F.when(condition, worth).otherwise(0.0)
    has = lambda column, *words: reduce(lambda a, b: a | b, (F.contains(column, F.lit(w)) for w in words))
    parts = [given(has(every, w), 0.15) for w in DOWNLOAD_WORDS]
    parts += [given(has(e["href"], ".pdf"), 0.5), given(has(e["href"], "download", "descarga"), 0.3), given(e["download"], 0.45)]
    parts += [given(e["onclick"].rlike("(?i)download|descarga|abrir|verdoc|getdoc|obtener"), 0.35), given(e["onclick"].rlike(r"(?i)window\.open|window\.location"), 0.1)]
    parts += [F.size(F.filter(e["icons"], lambda i: i.rlike("download|descarga|pdf|file|archivo"))) * 0.25, given(e["target"] == "_blank", 0.1)]
    parts += [given(F.startswith(e["href"], F.lit("#")) & ~has(e["href"], "download") & ~e["pdf_icon"], -0.2)]
    parts += [given(every.rlike("(?iu)página|page|next|prev|anterior|siguiente"), -0.3), given(every.rlike("(?iu)inicio|home|menú|salir|logout|cerrar"), -0.3)]
    return F.round(F.greatest(F.lit(0.0), F.least(_sum(parts), F.lit(1.0))), 4)


def download_elements(found: Column) -> Column:
    """(place, tag, score) of a page's elements that score .35 or more, the likeliest first, equal ones in the page's order."""
    scored = F.transform(found["elements"], lambda e, i: F.struct((-element_score(e)).alias("less"), i.alias("place"), e["tag"].alias("tag")))
    kept = F.array_sort(F.filter(scored, lambda x: x["less"] <= -ELEMENT_LEAST))
    return F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["tag"].alias("tag"), (-x["less"]).alias("score")))
