"""Goldens on invented texts, and properties of the folds, chunks, sections and tables."""

import re
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folia.functions import chunking, fulltext, html, normalise, rules, sections, selection
from folia.functions.folds import admitted, apart, greedy_within
from folia.operators import snapshot
from folia.operators.ranks import numbered
from folia.streaming.queue import MOST_ATTEMPTS, machine, retry_after

JUDGMENT = "Vistos: la demanda. PRIMERO: Que consta. SEGUNDO: Que no consta. Por ello se resuelve: Que se acoge. Regístrese y archívese."


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"]


def test_greedy_skips_what_does_not_fit(spark):
    assert one(spark, greedy_within(F.col("a"), 100), a=[60, 50, 30]) == [0, 2]


@pytest.mark.parametrize("limit,window", [(1, 10.0), (3, 25.0)])
def test_limiter_never_admits_more(spark, limit, window):
    times = sorted(random.Random(limit).uniform(0, 200) for _ in range(60))
    taken = one(spark, admitted(F.col("t"), limit, window), t=times)
    log = []
    for t in times:
        if sum(x > t - window for x in log) < limit:
            log.append(t)
    assert taken == log


def test_markers_too_close_are_thinned(spark):
    rows = [(0, "a", 0.8), (3, "b", 0.9), (40, "a", 0.9), (50, "a", 0.9), (80, "a", 0.5)]
    df = spark.createDataFrame([(rows,)], "m array<struct<at: int, type: string, confidence: double>>")
    assert [(r["at"], r["type"]) for r in df.select(apart(F.col("m")).alias("x")).first()["x"]] == [(3, "b"), (40, "a"), (80, "a")]


def test_sections_of_a_judgment(spark):
    found = sections.detect(spark.createDataFrame([(1, JUDGMENT), (2, ""), (3, None)], "doc_id long, text string")).orderBy("start").collect()
    assert [r["type"] for r in found] == ["vistos", "considerando_n", "considerando_n", "resolutivo", "cierre_sentencia"]
    assert {r["structure"] for r in found} == {"sentencia"} and found[1]["label"] == "Considerando 1"
    assert [r["stop"] for r in found] == [r["start"] for r in found[1:]] + [len(JUDGMENT)]


def test_ordinals():
    assert [sections.ordinal_of(w) for w in ("primero", "DÉCIMO TERCERO", "7", "nada", None)] == [1, 13, 7, None, None]


def test_normaliser_removes_artefacts(spark):
    text = "Código: ABCDE12345 Este documento tiene firma electrónica y su original puede ser validado en https://verificadoc.pjud.cl uno  dos -- 1 of 3 --\n\n\n\ntres C-12-2020 Foja: 4 la presentaci n fin"
    assert one(spark, normalise.normalised(F.col("t")), t=text) == "uno dos\n\ntres la presentación fin"
    assert one(spark, normalise.normalised(F.col("t")), t="  ") == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=9000))
def test_chunks_cover_the_text(text):
    spans = list(chunking.split(text))
    if not text.strip():
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= 1.35 * chunking.OVERLAP * chunking.CHARS_PER_TOKEN


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "x. " * 3000), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    rows = chunking.chunk(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 4} and max(r["token_estimate"] for r in rows) <= 1000
    assert {r["section_type"] for r in chunking.section_of(chunking.chunk(df), sections.detect(df)).collect()} == {"general"}


def test_html_tables(spark):
    cells = "".join(f"<td>{x}</td>" for x in ("12 bis", "d", "", "s", "t", "x  y​", "01/02/2024", "n"))
    page = f"<div id=historiaCiv><table><thead><tr><th>Folio</th></tr></thead><tbody><tr>{cells}</tr><tr><td>n</td></tr></tbody></table></div><table><tbody><tr>{cells}</tr></tbody></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None), (4, page.replace("tbody", "tfoot")), (5, page.replace("historiaCiv", "x"))], "page_id long, html string")
    rows = html.extract(df, "folio_history").collect()
    assert [(r["page_id"], r["folio"], r["description"], r["page"], r["has_document"]) for r in rows] == [(1, 12, "x y", 0, False)]
    form = "<td><form action='/a/docuS.php?x'><input name='z' value='{}'><input type='hidden' value='{}'></form></td>"
    page = "<table><tbody>" + "".join(f"<tr>{form.format('z' * 30, 'k' * n)}<td>1/1/24</td><td>ref{n}</td></tr>" for n in (20, 21)) + "<tr>" + form.format("", "k" * 30).replace("docuS", "other") + "<td>a</td><td>b</td></tr></tbody></table>"
    assert [(r["reference"], r["document_token"]) for r in html.extract(spark.createDataFrame([(1, page)], "page_id long, html string"), "annexes").collect()] == [("ref21", "k" * 21)]


def test_tables_of_other_kinds_stay_out(spark):
    row = "<tr>" + "".join(f"<td>v{k}</td>" for k in range(8)) + "</tr>"
    page = "".join(f"<div id={tab}><table><tbody>{row}</tbody></table></div>" for tab in ("litigantesCiv", "notificacionesCiv", "exhortosCiv"))
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [html.extract(df, k).count() for k in ("litigants", "notifications", "letters_rogatory", "pending_filings", "bailiff_withdrawals")] == [1, 1, 1, 0, 3]
    found = html.extract(df, "notifications").first()
    assert (found["participant_type"], found["procedure"], found["failure"]) == ("v4", "v6", "v7")


def test_origin_of_an_appeal_has_its_detail(spark):
    def page(link, head="Causa Origen: C - 12 - 2024"):
        titles = f'<table class="table-titulos"><tbody><tr><td>{head}</td><td>Ruc: 24-5 {link}</td></tr></tbody></table>'
        return f"""<a onclick="detalleCausaCivil('{'o' * 30}')">x</a><div id="expedienteApe">{titles}<table class="table-titulos"><tr><td>Materia: other {link}</td></tr></table></div>"""

    call = lambda token, name="detalleCausaCivil": f"""<a onclick="return {name}( '{token}' )">x</a>"""
    jwt = "eyJab.c-d.e_f"
    links = [call("k" * 21), call("k" * 20), call(jwt), call("k" * 30, "detalleCausaCobranza"), call("k" * 20) + call("k" * 30), call("k" * 21).replace("<a", "<label"), ""]
    df = spark.createDataFrame([*((i, page(link)) for i, link in enumerate(links)), (7, page(call("k" * 21), "")), (8, "<p>none</p>"), (9, None)], "page_id long, html string")
    rows = {r["page_id"]: r for r in html.appeal_origin(df).collect()}
    assert [rows[i]["detail_token"] for i in range(8)] == ["k" * 21, None, jwt, None, None, None, None, "k" * 21] and len(rows) == 8
    assert {(r["origin"], r["ruc"], r["matter"]) for i, r in rows.items() if i < 7} == {("C-12-2024", "24-5", None)} and rows[7]["origin"] is None


def test_cover_density_prefers_close_terms():
    assert fulltext.cover_density([(1, 0), (2, 1)], 2) == 1.0
    assert fulltext.cover_density([(1, 0), (9, 1)], 2) < fulltext.cover_density([(1, 0), (3, 1)], 2)


def test_stemmer_keeps_short_words():
    assert [fulltext.stem(w) for w in ("notificaciones", "casas", "sol", "rápidamente")] == ["notific", "cas", "sol", "rápida"]


def test_selection_phases():
    docs = [{"doc_id": i, "document_type": t, "created_at": i, "n": n} for i, (t, n) in enumerate([("a", 400), ("b", 4000), ("c", 40), ("b", 80)])]
    taken = selection.choose(docs, ["a"], ["c"], budget=200)
    assert [(p, x["doc_id"]) for _, p, x in taken] == [("priority", 0), ("essential", 2), ("fill", 3)]


def test_selection_of_changes_and_deadlines():
    def docs():
        kinds = ("folio", "Resolución", "anexo", "Auto de prueba", "sentencia", "mandamiento", "x", "x")
        return [{"doc_id": i, "document_type": t, "origin": "exhorto" if i == 6 else None, "procedure": "decreto" if i == 7 else None, "created_at": i, "n": 40} for i, t in enumerate(kinds)]

    names = lambda **k: [(p, x["doc_id"]) for _, p, x in selection.choose(docs(), ["anexo"], ["mandamiento"], **k)]
    assert names(changed=["exhorto"]) == [("changed", 6), ("priority", 2), ("essential", 5), ("recent", 7), ("recent", 4), ("recent", 3), ("recent", 1), ("fill", 0)]
    assert names(deadline=True)[:5] == [("deadline", k) for k in (7, 5, 4, 3, 1)]
    assert [p for _, p, _ in selection.choose(docs(), None, [])] == ["priority"] * 8


@pytest.mark.parametrize("text, kind", [("DÉCIMO TERCERO: x", "considerando_n"), ("Décimo Primero: x", "considerando_n"), ("DÉCIMO PRIMERO: x", None), ("DÉCIMO OTRA: x", None), ("Se recibe la causa a prueba", "audiencia_prueba"), ("recibió la causa a prueba", None), ("llamado a conciliación", "audiencia_conciliacion"), ("se llamó a las partes", None), ("En Talca, a uno de mayo del año dos mil veinte, " + "x " * 300 + "me constituí", "receptor_diligencia"), ("En Talca, a uno de mayo de 2020, me constituí", None)])
def test_markers_and_near_misses(text, kind):
    found = [m[2] for m in sections.find(text)]
    assert kind in found if kind else not {"audiencia_prueba", "audiencia_conciliacion", "receptor_diligencia"} & set(found) and "DÉCIMO" not in "".join(m[3] for m in sections.find(text))


def test_repairs_leave_whole_words(spark):
    text = "el último código, la presentaci n y C digo. Regístrese"
    got = one(spark, normalise.repairs(F.col("text")), text=text)
    assert (got["text"], got["fixes"]) == ("el último código, la presentación y Código. Regístrese", 2)
    assert len(normalise.REPAIRS) == 106


def test_citations_and_heads(spark):
    none = F.lit(None)
    label = rules.citation_label(none.cast("string"), F.lit("Resolución"), F.lit("2024-03-12"), F.lit(31), none.cast("int"), F.lit("Principal"), F.lit(5))
    assert one(spark, label, x=1) == "Resolución, de fecha 12/03/2024, folio 31, cuaderno Principal, (pág. 5)"
    text = rules.embedding_input(F.lit("Que"), F.lit("folio"), none.cast("string"), F.lit("considerando_n"), F.lit(6), F.lit(0.9), F.lit("sumario"), F.lit(31), none.cast("int"), F.lit("Principal"))
    assert one(spark, text, x=1) == "[Folio | Considerando 6 | Sumario | Folio 31 | Principal] Que"


def test_numbers_of_whole_tables(spark):
    values = [(p, i) for p in (1, 0) for i in (5, 30_000, None, 12_000, -3)]
    got = {(r["prio"], r["id"]): r["n"] for r in numbered(spark.createDataFrame(values, "prio int, id long"), "n", "id", "prio").collect()}
    order = sorted(values, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    assert got == {v: k for k, v in enumerate(order, 1)}


def rows(spark, values):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(values)], "k string, v string, pos int")


def test_diff(spark):
    a, b = rows(spark, [("x", " one "), ("y", "two"), ("y", "three"), ("z", None)]), rows(spark, [("x", "one"), ("y", "four"), ("z", ""), ("w", "n")])
    found = {(r["type"], r["entity_key"], r["old_value"], r["new_value"]) for r in snapshot.diff(a, b, ["k"], ["v"], "c", "pos").collect()}
    assert found == {("added", "w", None, None), ("changed", "y", "three", "four")}
    assert snapshot.diff(a, a, ["k"], ["v"], "c", "pos").count() == 0
    back = {r["entity_key"] for r in snapshot.diff(b, a, ["k"], ["v"], "c", "pos").collect() if r["type"] == "removed"}
    assert back == {"w"}


def test_truncation_is_tolerated_where_asked(spark):
    a, b = rows(spark, [("x", "Juzgado de Le")]), rows(spark, [("x", "Juzgado de Letras")])
    assert snapshot.diff(a, b, ["k"], ["v"], "c", "pos", tolerate_truncation=True).count() == 0
    assert snapshot.diff(a, b, ["k"], ["v"], "c", "pos").count() == 1


def test_queue_machine():
    state = ("queued", 0)
    for event in ("start", "error", "start", "error", "start", "error", "start"):
        state = machine(*state, event)
    assert state == ("failed", MOST_ATTEMPTS) and machine("completed", 1, "enqueue") == ("completed", 1)
    assert [retry_after(n) for n in (1, 2, 3)] == [60, 300, 300]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_signatures(spark, key):
    import hashlib
    import hmac

    from folia.functions.signing import signature

    got = one(spark, signature({"b": F.lit("ñ"), "a": F.lit(7), "c": F.lit(None).cast("string")}, key), x=1)
    assert got == hmac.new(key, "a7bñc".encode(), hashlib.sha256).hexdigest()


def test_stored_index_finds_what_the_texts_give(spark, tmp_path):
    texts = ["notificación del plazo", "plazo y notificaciones, plazo", "", None, "notificado fuera de todo plazo legal", "plazo", "Notificado plazo " * 300]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, part string")
    fulltext.store(docs, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for query in ("plazo notificación", "plazo", "legal fuera", "nada", "de la", ""):
        want = [tuple(r) for r in fulltext.search(docs, query, 5).collect()]
        assert [tuple(r) for r in fulltext.search_stored(index, query, 5).collect()] == want, query
    fulltext.store(docs.limit(0), str(tmp_path / "empty"))


def test_header_block(spark):
    text = "x FOJA: 12 .- doce .- NOMENCLATURA : 1. [40]Sentencia 2. [445]Mero trámite JUZGADO : 3 Juzgado Civil de Santiago CAUSA ROL : C-123-2020 CARATULADO : PÉREZ Y OTROS/BANCO S.A. Santiago, dos"
    block = one(spark, normalise.header_block(F.lit(text)), x=1)
    assert (block["sheet"], block["sheet_text"], block["court"], block["rol"], block["caption"]) == (12, "doce", "3º Juzgado Civil de Santiago", "C-123-2020", "PÉREZ Y OTROS/BANCO S.A.")
    assert [tuple(n) for n in block["nomenclatures"]] == [(40, "Sentencia"), (445, "Mero trámite")]
    assert one(spark, normalise.removed(F.lit(text), "header"), x=1) == "x  Santiago, dos"
    loose = "NOMENCLATURA : sin códigos JUZGADO : 1 CAUSA ROL : C-1-2020 CARATULADO : A/B Talca, tres"
    assert one(spark, normalise.header_block(F.lit(loose)), x=1) is None and one(spark, normalise.removed(F.lit(loose), "header"), x=1) == loose
    late = "NOMENCLATURA : 1. [1]Auto JUZGADO : 1 Juzgado de Letras º CAUSA ROL : E-1-2021 CARATULADO : A\nB Talca, tres"
    block = one(spark, normalise.header_block(F.lit(late)), x=1)
    assert (block["sheet"], block["court"], block["caption"]) == (None, "1º Juzgado de Letras", "A")


def test_patterns_are_tried_only_where_they_may_match(monkeypatch):
    class Never:
        def finditer(self, text):
            raise AssertionError("tried")

    plain = {k: list(re.finditer(c[2], MARKED, re.I if c[3] else 0)) for k, c in enumerate(sections.CATALOGUE)}
    assert sorted((m.start(), k, len(m[0])) for k, found in plain.items() for m in found) == [(m[0], m[1], m[4]) for m in sections.find(MARKED)]
    assert {k for k, m in sections.matches(MARKED)} == {0, 3, 4, 5, 9, 12}
    monkeypatch.setattr(sections, "_patterns", lambda: [(Never(), held) for held in sections.HELD])
    assert sections.find("Una frase larga, sin marcas. Otra más: nada.\n\n" * 50) == []


MARKED = "VIſTOS: a Primero : b 12°.- c ſe reſuelve: d OTROSÍ: e por tanto, f"
