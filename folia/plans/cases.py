"""Queries of case trees: customers are cases, orders their books, lines the sheets; a later snapshot differs by rules that the SQL states anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.catalog import register
from folia.operators import case_tree
from folia.sources.folders import stored
from folia.sources.tables import table

L = "long"


def _base(s, d):
    """Customers, their orders and the lines of these, which all branches are made from: joined and stored once."""
    customer = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    orders = table(s, d, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_shipdate").repartition("o_orderkey")
    lines = lines.groupBy("o_orderkey", "l_linenumber").agg(F.max("l_quantity").cast(L).alias("q"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("shipped"))
    orders = stored(orders, "orders")
    return customer, orders, stored(lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey"), "lines")


def _snapshot(base, later=False):
    """The eighteen tables of a snapshot, or of the later one."""
    def now(flag, new, old):
        return F.when(flag, new).otherwise(old) if later else old

    def rows(df, parent, key, **columns):
        return df.select(F.col("o_custkey").alias("case_id") if "o_custkey" in df.columns else F.col("c_custkey").alias("case_id"), key.alias("id"), parent.alias("parent_id"), F.lit(0).alias("pos"), *(v.alias(k) for k, v in columns.items()))

    customer, orders, lines = base
    c, word = F.col("c_custkey"), lambda x: F.lit(x)
    of_orders = "o_orderkey % 5 <> 0" if later else "o_orderkey % 7 <> 0"
    orders, lines = orders.where(of_orders), lines.where(f"{of_orders} AND l_linenumber % 4 <> 0" if later else of_orders)
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    line_id = F.concat_ws("-", k.cast("string"), n.cast("string"))
    letters = customer.where("c_custkey % 3 = 0 AND c_custkey % 9 <> 0 OR c_custkey % 12 = 4" if later else "c_custkey % 3 = 0")
    appeals = customer.where("c_custkey % 4 = 0")
    text = lambda x: F.col(x).cast("string")
    return {
        "metadata": customer.select(c.alias("case_id"), text("c_custkey").alias("rol"), now(c % 5 == 0, None, F.col("c_mktsegment")).alias("estado_adm"), now(c % 3 == 0, F.concat("c_name", F.lit(" y otro")), now(c % 3 == 1, F.lit("X"), F.col("c_name"))).alias("caratula")),
        "cuaderno": rows(orders, F.col("o_custkey"), k, nombre=F.concat(F.lit("C"), k.cast("string")), procedimiento=now(k % 11 == 0, F.lit("X"), F.col("o_orderstatus")), etapa=F.col("o_orderpriority")).withColumn("pos", F.col("id")),
        "folio": rows(lines, k, line_id, numero_folio=n, tramite=now(k % 3 == 0, F.col("q") + 1, F.col("q")), fecha_tramite=F.col("shipped")),
        "folio_anexo": rows(lines, line_id, line_id, fecha=F.col("shipped"), referencia=F.concat(now(k % 2 == 0, F.lit("S"), F.lit("R")), n.cast("string"))),
        "litigante": rows(orders, k, k, rut=text("o_custkey"), participante=word("DTE."), persona=now(k % 13 == 0, F.lit("JURIDICA"), F.lit("NATURAL"))),
        "notificacion": rows(orders, k, k, tramite=word("Cédula"), obs_fallida=now(k % 23 == 0, F.lit("ausente"), F.lit(None).cast("string"))),
        "escrito": rows(orders, k, k, tipo_escrito=word("Demanda"), tiene_doc=now(k % 17 == 0, F.lit(False), F.lit(True))),
        "pieza_exhorto": rows(orders, k, k, numero_folio=k, foja=now(k % 19 == 0, F.lit(1), F.lit(0))),
        "anexo_causa": rows(customer.where(c % 6 == 0) if later else customer.where(c % 10 == 0), c, c, referencia=word("Pagaré")),
        "receptor": rows(customer, c, c, datos_retiro=F.col("c_mktsegment"), estado=now(c % 7 == 0, F.lit("Retirado"), F.lit("Listo"))),
        "exhorto": rows(letters, c, c, rol_destino=F.concat(F.lit("E-"), text("c_custkey")), tribunal_destino=now(c % 2 == 0, F.lit("Otro"), text("c_nationkey"))),
        "exhorto_doc": rows(letters.where(c % 5 != 0) if later else letters, c, c, referencia=word("Oficio")),
        "remision": rows(appeals, c, c, descripcion_tramite=word("Apelación"), corte=now(c % 8 == 0, F.lit("Suprema"), F.lit("Talca"))),
        "remision_movimiento": rows(appeals, c, c, numero_folio=word(1), estado=now(c % 12 == 0, F.lit("Firmado"), F.lit(""))),
        "remision_mov_anexo": rows(appeals, c, c, codigo=word("9"), cantidad=now(c % 16 == 0, F.lit("2"), F.lit("1"))),
        "remision_litigante": rows(appeals, c, c, rut=text("c_custkey"), sujeto=word("Apelado"), persona=now(c % 20 == 0, F.lit("b"), F.lit("a"))),
        "remision_exhorto": rows(appeals.where(c % 28 == 0) if later else appeals.limit(0), c, c, exhorto=word("E")),
        "remision_incompetencia": rows(appeals.where(c % 44 != 0) if later else appeals, c, c, incompetencia=word("I")),
    }


BOTH = "o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0"
LINES = "SELECT o_custkey, o_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q, strftime(max(l_shipdate), '%Y-%m-%d') AS shipped FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL"
WHOLE = "WITH o AS (SELECT o.*, 'C' || o_orderkey AS book FROM orders o JOIN customer ON o_custkey = c_custkey), l AS (" + LINES + ") "


def _change(source, where, category, kind, key, field="NULL", a="NULL", b="NULL", book="NULL", case="c_custkey"):
    return f"SELECT {case} AS case_id, '{category}' AS category, '{kind}' AS type, {book} AS cuaderno, {key} AS entity_key, {field} AS field, {a} AS old_value, {b} AS new_value FROM {source} WHERE {where}"


def _of_book(where, category, kind, key, *values):
    return _change("o", where, category, kind, key, *values, book="book", case="o_custkey")


def _of_line(where, category, kind, key, *values):
    return _change("l", f"{BOTH} AND {where}", category, kind, key, *values, book="'C' || o_orderkey", case="o_custkey")


CHANGES = WHOLE + " UNION ALL ".join([
    _change("customer", "c_custkey % 3 = 1", "metadata", "changed", "'causa'", "'caratula'", "c_name", "'X'"),
    _change("customer", "c_custkey % 5 = 0", "metadata", "changed", "'causa'", "'estado_adm'", "c_mktsegment"),
    _of_book("o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0", "cuaderno", "added", "book"),
    _of_book("o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0", "cuaderno", "removed", "book"),
    _of_book(f"{BOTH} AND o_orderkey % 11 = 0", "cuaderno", "changed", "book", "'procedimiento'", "o_orderstatus", "'X'"),
    _of_line("l_linenumber % 4 = 0", "folio", "removed", "CAST(l_linenumber AS VARCHAR)"),
    _of_line("l_linenumber % 4 <> 0 AND o_orderkey % 3 = 0", "folio", "changed", "CAST(l_linenumber AS VARCHAR)", "'tramite'", "CAST(q AS VARCHAR)", "CAST(q + 1 AS VARCHAR)"),
    _of_line("l_linenumber % 4 <> 0 AND o_orderkey % 2 = 0", "folio_anexo", "removed", "shipped || '|R' || l_linenumber"),
    _of_line("l_linenumber % 4 <> 0 AND o_orderkey % 2 = 0", "folio_anexo", "added", "shipped || '|S' || l_linenumber"),
    _of_book(f"{BOTH} AND o_orderkey % 13 = 0", "litigante", "changed", "o_custkey || '|DTE.'", "'persona'", "'NATURAL'", "'JURIDICA'"),
    _of_book(f"{BOTH} AND o_orderkey % 23 = 0", "notificacion", "changed", "'||Cédula'", "'obs_fallida'", "NULL", "'ausente'"),
    _of_book(f"{BOTH} AND o_orderkey % 17 = 0", "escrito", "changed", "'|Demanda|'", "'tiene_doc'", "'sí'", "'no'"),
    _of_book(f"{BOTH} AND o_orderkey % 19 = 0", "pieza_exhorto", "changed", "CAST(o_orderkey AS VARCHAR)", "'foja'", "'0'", "'1'"),
    _change("customer", "c_custkey % 6 = 0 AND c_custkey % 10 <> 0", "anexo_causa", "added", "'|Pagaré'"),
    _change("customer", "c_custkey % 10 = 0 AND c_custkey % 6 <> 0", "anexo_causa", "removed", "'|Pagaré'"),
    _change("customer", "c_custkey % 7 = 0", "receptor", "changed", "'|' || c_mktsegment", "'estado'", "'Listo'", "'Retirado'"),
    _change("customer", "c_custkey % 12 = 4", "exhorto", "added", "'E-' || c_custkey"),
    _change("customer", "c_custkey % 9 = 0", "exhorto", "removed", "'E-' || c_custkey"),
    _change("customer", "c_custkey % 6 = 0 AND c_custkey % 9 <> 0", "exhorto", "changed", "'E-' || c_custkey", "'tribunal_destino'", "CAST(c_nationkey AS VARCHAR)", "'Otro'"),
    _change("customer", "c_custkey % 15 = 0 AND c_custkey % 9 <> 0", "exhorto_doc", "removed", "'|Oficio|'"),
    _change("customer", "c_custkey % 8 = 0", "remision", "changed", "'Apelación|'", "'corte'", "'Talca'", "'Suprema'"),
    _change("customer", "c_custkey % 12 = 0", "remision_movimiento", "changed", "'Apelación|f1'", "'estado'", "NULL", "'Firmado'"),
    _change("customer", "c_custkey % 16 = 0", "remision_mov_anexo", "changed", "'9|'", "'cantidad'", "'1'", "'2'"),
    _change("customer", "c_custkey % 20 = 0", "remision_litigante", "changed", "c_custkey || '|Apelado'", "'persona'", "'a'", "'b'"),
    _change("customer", "c_custkey % 28 = 0", "remision_exhorto", "added", "'E'"),
    _change("customer", "c_custkey % 44 = 0", "remision_incompetencia", "removed", "'I'"),
])


@register("dif4_changes_of_every_branch", CHANGES)
def dif4_changes(s, d):
    """All eighteen branches of every case, one row for each added, removed or changed cell."""
    base = _base(s, d)
    return case_tree.changes(_snapshot(base), _snapshot(base, later=True))


@register("dif5_nested_snapshots", WHOLE + f"""
SELECT c_custkey AS case_id, c_mktsegment AS state, coalesce(n, 0) AS books, coalesce(m, 0) AS sheets, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS appeals FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM o WHERE o_orderkey % 7 <> 0 GROUP BY 1) ON k = c_custkey LEFT JOIN (SELECT o_custkey AS j, count(*) AS m FROM l WHERE o_orderkey % 7 <> 0 GROUP BY 1) ON j = c_custkey""")
def dif5_nested(s, d):
    """The nested snapshot of each case, by the numbers of its records."""
    x = F.col("snapshot")
    sheets = F.aggregate(x["cuaderno"], F.lit(0).cast(L), lambda a, b: a + F.size(b["folio"]))
    return case_tree.build(_snapshot(_base(s, d))).select("case_id", x["estado_adm"].alias("state"), F.size(x["cuaderno"]).cast(L).alias("books"), sheets.alias("sheets"), F.size(x["remision"]).alias("appeals"))


NL = "chr(10)"
RENDERED = WHOLE + f"""
, f AS (SELECT o_orderkey, count(*) AS n, string_agg({NL} || '  F' || l_linenumber || ': ' || q || ' | ' || shipped || {NL} || '    -> Anexo: R' || l_linenumber || ' | ' || shipped, '' ORDER BY l_linenumber) AS t FROM l GROUP BY 1),
b AS (SELECT o_custkey, string_agg({NL} || 'CUADERNO: ' || book || {NL} || '  Procedimiento: ' || o_orderstatus || {NL} || '  Etapa actual: ' || o_orderpriority || {NL} || '  Total folios: ' || coalesce(n, 0) || coalesce(t, '') || {NL}, '' ORDER BY o_orderkey) AS books, string_agg({NL} || '- Demanda | con doc', '') AS filings, string_agg({NL} || '- Cédula', '') AS notices, string_agg({NL} || '  P' || o_orderkey || ': foja 0', '' ORDER BY o_orderkey) AS pieces FROM o LEFT JOIN f USING (o_orderkey) WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT c_custkey AS case_id, md5('=== DATOS COMPLETOS DE LA CAUSA (fuente de verdad del expediente) ===' || {NL} || {NL} || 'DATOS GENERALES:' || {NL} || '  ROL: ' || c_custkey || {NL} || '  Carátula: ' || c_name || {NL}
|| CASE WHEN books IS NOT NULL THEN {NL} || 'LITIGANTES:' || {NL} || '- DTE. | ' || c_custkey || {NL} ELSE '' END || coalesce(books, '')
|| coalesce({NL} || 'ESCRITOS PRESENTADOS:' || filings || {NL} || {NL} || 'NOTIFICACIONES:' || notices || {NL}, '')
|| CASE WHEN c_custkey % 10 = 0 THEN {NL} || 'ANEXOS DE LA CAUSA:' || {NL} || '- Pagaré' || {NL} ELSE '' END
|| {NL} || 'RETIROS DE RECEPTOR:' || {NL} || '- Listo | ' || c_mktsegment || {NL}
|| CASE WHEN c_custkey % 3 = 0 THEN {NL} || 'EXHORTOS:' || {NL} || '- ' || c_nationkey || {NL} || '  ROL destino: E-' || c_custkey || {NL} || '  Doc: Oficio' || coalesce({NL} || 'PIEZAS DE EXHORTO:' || pieces, '') || {NL} ELSE '' END
|| CASE WHEN c_custkey % 4 = 0 THEN {NL} || 'RECURSOS EN CORTE (REMISIONES):' || {NL} || '- Talca' || {NL} || '  Parte: Apelado | ' || c_custkey || {NL} || '  Incompetencia: I' || {NL} || '  Movimientos:' || {NL} || '  M1: ' || {NL} || '    -> Anexo: 9 | cant: 1' || {NL} ELSE '' END
|| {NL} || '=== FIN DATOS DE LA CAUSA ===' || {NL} || 'NOTA: Esta información es la fuente de verdad del expediente. ✓ = documento PDF con contenido extraído disponible para análisis detallado.') AS text_md5
FROM customer LEFT JOIN b ON o_custkey = c_custkey"""


@register("ret10_text_of_every_section", RENDERED)
def ret10_text(s, d):
    """Each case's text with all of its sections."""
    return case_tree.build(_snapshot(_base(s, d))).select("case_id", F.md5(case_tree.case_text(F.col("snapshot"))).alias("text_md5"))
