"""Cases as trees: nested snapshots, the changes between two of them on every level, and a case's text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.operators.snapshot import canonical, truncation
from folia.sources.folders import stored

CASE = "metadata"


@dataclass(frozen=True)
class Branch:
    """One kind of record: what it hangs on, what tells its records apart and which fields are compared.

    ``shown`` fields are part of a snapshot and of the text only.
    """

    category: str
    parent: str | None
    keys: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *self.fields, *self.shown)


#: Categories, keys and compared fields of the eighteen branches, parents before children.
BRANCHES = (
    Branch(CASE, None, (), ("estado_adm", "ubicacion", "estado_procesal", "caratula", "materia", "causa_origen", "tribunal_origen"), ("rol", "tribunal", "procedimiento", "fecha_ingreso", "estado", "etapa", "libro_tipo")),
    Branch("cuaderno", CASE, ("nombre",), ("procedimiento", "etapa")),
    Branch("folio", "cuaderno", ("numero_folio",), ("etapa", "tramite", "desc_tramite", "fecha_tramite", "foja", "tiene_doc_principal", "tiene_certificado_escrito", "tiene_anexo_solicitud"), ("has_content",)),
    Branch("folio_anexo", "folio", ("fecha", "referencia"), (), ("has_content",)),
    Branch("litigante", "cuaderno", ("rut", "participante"), ("persona", "nombre_razon_social")),
    Branch("notificacion", "cuaderno", ("fecha_tramite", "nombre", "tramite"), ("rol", "estado_notif", "tipo_notif", "tipo_participante", "obs_fallida")),
    Branch("escrito", "cuaderno", ("fecha_ingreso", "tipo_escrito", "solicitante"), ("tiene_doc", "tiene_anexo")),
    Branch("pieza_exhorto", "cuaderno", ("numero_folio",), ("cuaderno_pieza", "etapa", "tramite", "desc_tramite", "fecha_tramite", "foja", "tiene_doc", "tiene_anexo"), ("has_content",)),
    Branch("anexo_causa", CASE, ("fecha", "referencia"), (), ("has_content",)),
    Branch("receptor", CASE, ("fecha_retiro", "datos_retiro"), ("cuaderno", "estado")),
    Branch("exhorto", CASE, ("rol_destino",), ("rol_origen", "tipo_exhorto", "fecha_ordena", "fecha_ingreso", "tribunal_destino", "estado_exhorto")),
    Branch("exhorto_doc", "exhorto", ("fecha", "referencia", "tramite"), (), ("has_content",)),
    Branch("remision", CASE, ("descripcion_tramite", "fecha_tramite"), ("libro", "fecha", "estado_recurso", "estado_procesal", "ubicacion", "recurso", "corte", "tiene_certificado", "tiene_ebook", "tiene_texto", "tiene_anexo", "exp_causa_origen", "exp_tribunal", "exp_caratulado", "exp_materia", "exp_ruc", "exp_fecha_ingreso")),
    Branch("remision_movimiento", "remision", ("numero_folio",), ("tramite", "descripcion", "nomenclaturas", "fecha", "sala", "estado", "tiene_doc", "tiene_certificado_escrito", "tiene_anexo_escrito"), ("has_content",)),
    Branch("remision_mov_anexo", "remision_movimiento", ("codigo", "tipo_documento"), ("cantidad", "observacion"), ("has_content",)),
    Branch("remision_litigante", "remision", ("rut", "sujeto"), ("persona", "nombre_razon_social")),
    Branch("remision_exhorto", "remision", ("exhorto",)),
    Branch("remision_incompetencia", "remision", ("incompetencia",)),
)
NUMBERS = {"numero_folio", "foja"}
FLAGS = {b for branch in BRANCHES for b in branch.columns if b.startswith(("tiene_", "has_"))}


def _children(category: str | None) -> list[Branch]:
    return [b for b in BRANCHES if b.parent == category]


def _type(name: str) -> str:
    return "long" if name in NUMBERS else "boolean" if name in FLAGS else "string"


def _records(branch: Branch, rows: DataFrame) -> DataFrame:
    """The branch's columns of ``rows`` in their types; those it lacks are null."""
    has = set(rows.columns)
    own = (F.col(c).cast(_type(c)).alias(c) if c in has else F.lit(None).cast(_type(c)).alias(c) for c in branch.columns)
    if branch.parent is None:
        return rows.select("case_id", F.col("case_id").cast("string").alias("id"), *own)
    return rows.select("case_id", F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("pos").cast("long").alias("pos"), *own)


def build(tables: dict[str, DataFrame]) -> DataFrame:
    """(case_id, snapshot): each case with its records nested in ``pos`` order, from one table for each branch.

    Tables have case_id and, but for that of the cases, id (unique in its table), parent_id and pos; a
    missing table is an empty one, a missing column is null, and other columns are left out.  Records
    without their parent are left out, as are null ids.  Every record is shuffled once by its parent's
    id, so a task holds whole cases but never several cases' worth of one kind at once.
    """

    def nested(branch: Branch) -> DataFrame | None:
        if branch.category not in tables:
            return None
        rows = _records(branch, tables[branch.category])
        for child in _children(branch.category):
            below = nested(child)
            if below is None:
                rows = rows.withColumn(child.category, F.array().cast(f"array<{_struct(child)}>"))
                continue
            lists = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "at", "x"))).alias("xs"))
            lists = lists.select("id", F.col("xs.x").alias(child.category))
            rows = rows.join(lists, "id", "left").withColumn(child.category, F.coalesce(child.category, F.array().cast(f"array<{_struct(child)}>")))
        record = F.struct(*branch.columns, *(c.category for c in _children(branch.category)))
        if branch.parent is None:
            return rows.select("case_id", record.alias("snapshot"))
        return rows.select("parent_id", "pos", F.col("id").alias("at"), record.alias("x"))

    return nested(BRANCHES[0])


def _struct(branch: Branch) -> str:
    fields = [f"{c}: {_type(c)}" for c in branch.columns] + [f"{c.category}: array<{_struct(c)}>" for c in _children(branch.category)]
    return f"struct<{', '.join(fields)}>"


def tables_of(snapshots: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``build`` nested: a record's id is the way of places that leads to it."""
    found = {CASE: snapshots.select("case_id", F.col("case_id").cast("string").alias("id"), "snapshot.*")}
    for b in BRANCHES[1:]:
        rows = found[b.parent].select("case_id", F.col("id").alias("parent_id"), F.posexplode(b.category).alias("pos", "x"))
        found[b.category] = rows.select("case_id", "parent_id", "pos", F.concat_ws("/", "parent_id", F.col("pos").cast("string")).alias("id"), "x.*")
    return found


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _value(name: str) -> Column:
    """A field in its canonical form; numbers have no blanks to squeeze."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if _type(name) == "long" else canonical(F.col(name))


def _entities(level: list[Branch], old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame | None:
    """The records of one level of both snapshots in one shape; values are in the order of their branch's fields."""
    parts = []
    for branch in level:
        for is_new, tables in ((False, old), (True, new)):
            if branch.category not in tables:
                continue
            rows = _records(branch, tables[branch.category])
            place = ("parent_id", "pos") if branch.parent else (F.lit("").alias("parent_id"), F.lit(0).cast("long").alias("pos"))
            # a book is known by its very name, all others by their cleaned keys
            key = F.lit("causa") if branch.parent is None else F.col("nombre") if branch.category == "cuaderno" else F.concat_ws("|", *map(_value, branch.keys))
            shown = F.coalesce(_given(F.col("descripcion_tramite")), _given(F.col("libro")), F.lit("?")) if branch.category == "remision" else F.lit(None).cast("string")
            values = F.array(*map(_value, branch.fields)) if branch.fields else F.array().cast("array<string>")
            parts.append(rows.select("case_id", F.lit(branch.category).alias("category"), F.lit(branch.parent or "").alias("parent"), F.lit(is_new).alias("is_new"), "id", *place, F.coalesce(key, F.lit("")).alias("key"), shown.alias("shown"), values.alias("values")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _levels() -> list[list[Branch]]:
    found, at = [], [None]
    while at:
        level = [b for p in at for b in _children(p)]
        found, at = found + [level], [b.category for b in level]
    return found[:-1]


#: What makes one record of a level in both snapshots, before its parents are known and after.
_UNDER, _PAIRED = ("case_id", "parent_id", "parent", "category", "key"), ("case_id", "category", "pair", "key")


def _sides(rows: DataFrame, keys: tuple[str, ...], dealt_by: tuple[str, ...], *carried: str) -> DataFrame:
    """``rows`` with the last record of each side (o, n), dealt out before they are grouped: partial groups of one or two rows would be sorted for nothing."""
    last = lambda side: F.max_by(F.when(side, F.struct("id", "values", "shown")), F.when(side, F.struct("pos", "id")))
    return rows.repartition(*dealt_by).groupBy(*keys).agg(last(~F.col("is_new")).alias("o"), last(F.col("is_new")).alias("n"), *(F.max(c).alias(c) for c in carried))


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(case_id, category, type, cuaderno, entity_key, field, old_value, new_value) between two sets of tables as ``build`` takes.

    Records are compared within the same parent, and only where both snapshots have that parent; cases
    that only one snapshot has give nothing.  Of repeated keys the last by ``pos`` counts, with what
    hangs on it.  Added and removed records give one row without a field, changed ones one for each
    field that differs; of a case's own fields, a value that begins with the other is no change.  Empty
    values come out as null.  The branches of a level share one aggregate and one join with the level
    above.  Below a parent of the same id in both snapshots, records are shuffled once, by that id, and sorted once; those below other
    parents, if there are any, get the pair of their parents first and are shuffled again by it.  Of a level, what the next one needs
    and the changes found are stored.
    """
    found, above = [], None
    for level in _levels():
        rows = _entities(level, old, new)
        if rows is None:
            break
        if above is None:
            both = _sides(rows, ("case_id", "category", "key"), ("case_id",)).where("o IS NOT NULL AND n IS NOT NULL").select("*", F.lit(None).cast("string").alias("book"), F.lit(None).cast("string").alias("of"))
        else:
            same = above.where("old_id = new_id").select("case_id", F.col("old_id").alias("parent_id"), "parent", "book", "of")
            both = _sides(rows, _UNDER, _UNDER[:3]).join(same, list(_UNDER[:3])).drop("parent", "parent_id")
            moved = above.where("old_id <> new_id")
            if not moved.isEmpty():
                sides = F.explode(F.array(*(F.struct(F.col(f"{side}_id").alias("parent_id"), F.lit(side == "new").alias("is_new")) for side in ("old", "new")))).alias("s")
                pairs = moved.select("case_id", "parent", F.struct("old_id", "new_id").alias("pair"), "book", "of", sides).select("case_id", "parent", "pair", "book", "of", "s.*")
                both = both.unionByName(_sides(rows.join(pairs, ["case_id", "parent", "parent_id", "is_new"]), _PAIRED, _PAIRED, "book", "of").drop("pair"))
        both = both.withColumn("book", F.when(F.col("category") == "cuaderno", F.col("key")).otherwise(F.col("book")))
        parents = [b.category for b in level if _children(b.category)]
        common = F.col("category").isin(*parents) & F.col("o").isNotNull() & F.col("n").isNotNull()
        both = _found(both).select("case_id", "category", "book", "entity_key", "found", *(F.when(common, x).alias(c) for c, x in (("old_id", F.col("o.id")), ("new_id", F.col("n.id")), ("of", F.col("n.shown")))))
        both = both.where("old_id IS NOT NULL AND new_id IS NOT NULL OR size(found) > 0")
        if parents:
            both = stored(both, "level")  # the next level and the result read it, so that no level is made twice
        found.append(both.select("case_id", "category", F.col("book").alias("cuaderno"), "entity_key", F.explode("found").alias("c")).select("case_id", "category", "c.type", "cuaderno", "entity_key", "c.field", "c.old_value", "c.new_value"))
        above = both.where("old_id IS NOT NULL AND new_id IS NOT NULL").select("case_id", F.col("category").alias("parent"), "old_id", "new_id", "book", "of")
    return reduce(DataFrame.unionByName, found)


def _found(both: DataFrame) -> DataFrame:
    """``both`` with entity_key and found, the changes of each record."""
    names = F.create_map(*(x for b in BRANCHES for x in (F.lit(b.category), F.array(*map(F.lit, b.fields)) if b.fields else F.array().cast("array<string>"))))
    none = F.lit(None).cast("string")
    row = lambda kind, field, a, b: F.struct(F.lit(kind).alias("type"), field.alias("field"), a.alias("old_value"), b.alias("new_value"))
    cells = F.arrays_zip(names[F.col("category")].alias("field"), F.col("o.values").alias("a"), F.col("n.values").alias("b"))
    differs = F.filter(cells, lambda x: (x["a"] != x["b"]) & ~((F.col("category") == CASE) & truncation(x["a"], x["b"])))
    changed = F.when(F.col("o.values") == F.col("n.values"), F.array().cast(CELLS)).otherwise(F.transform(differs, lambda x: row("changed", x["field"], _given(x["a"]), _given(x["b"]))).cast(CELLS))
    found = F.when(F.col("o").isNull(), F.array(row("added", none, none, none)).cast(CELLS)).when(F.col("n").isNull(), F.array(row("removed", none, none, none)).cast(CELLS)).otherwise(changed)
    key = F.when(F.col("category") == "remision_movimiento", F.concat("of", F.lit("|f"), "key")).otherwise(F.col("key"))
    return both.select("*", key.alias("entity_key"), found.alias("found"))


CELLS = "array<struct<type: string, field: string, old_value: string, new_value: string>>"


def _line(head: str, *parts: Column, end: Column | None = None) -> Column:
    """The parts that aren't empty, between bars, after ``head``."""
    return F.concat(F.lit(head), F.concat_ws(" | ", *map(_given, parts)), *([] if end is None else [end]))


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag), _given(value.cast("string")))


def _tick(x: Column) -> Column:
    return F.when(x["has_content"], " ✓").otherwise("")


def _mark(x: Column, has: str) -> Column:
    return F.when(x[has], F.when(x["has_content"], "✓").otherwise("con doc"))


def _if(flag: Column, *lines: Column) -> Column:
    return F.when(flag, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _each(xs: Column, lines) -> Column:
    """The lines of all of ``xs`` one after the other."""
    return F.flatten(F.transform(xs, lines))


def _all(s: Column, category: str) -> Column:
    """What hangs on a case's books, in their order."""
    return F.flatten(F.transform(s["cuaderno"], lambda b: b[category]))


def _by_number(xs: Column) -> Column:
    return F.transform(F.array_sort(F.transform(xs, lambda x, i: F.struct(x["numero_folio"].alias("n"), i.alias("i"), x.alias("x")))), lambda y: y["x"])


def _section(header: str, xs: Column, lines: Column) -> Column:
    return F.when(F.size(xs) > 0, F.concat(F.array(F.lit(header)), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def case_text(s: Column) -> Column:
    """A snapshot as text, a line for each record: general data, litigants of the first book, books with their
    folios, then the seven secondary sections where they aren't empty.

    Empty and null values leave no trace; a null snapshot gives null.  The text is of one case, as a prompt needs it.
    """
    # The labels and marks of each line.
    general = (("ROL", "rol"), ("Carátula", "caratula"), ("Tribunal", "tribunal"), ("Materia", "materia"), ("Procedimiento", "procedimiento"), ("Fecha ingreso", "fecha_ingreso"), ("Estado", "estado"), ("Estado procesal", "estado_procesal"), ("Etapa", "etapa"), ("Ubicación", "ubicacion"), ("Libro", "libro_tipo"))
    origin = F.concat(F.lit("  Causa origen: "), _given(s["causa_origen"]), F.lit(" ("), F.coalesce(_given(s["tribunal_origen"]), F.lit("—")), F.lit(")"))
    data = F.array_compact(F.array(F.lit("DATOS GENERALES:"), *(_tagged(f"  {label}: ", s[f]) for label, f in general), origin, F.lit("")))
    litigants = F.coalesce(F.get(s["cuaderno"], F.lit(0))["litigante"], F.array().cast(f"array<{_struct(next(b for b in BRANCHES if b.category == 'litigante'))}>"))
    annex = lambda a: F.array(_line("    -> Anexo: ", a["referencia"], a["fecha"], end=_tick(a)))
    sheet = lambda f, head, has: F.concat(F.lit(f"  {head}"), F.coalesce(f["numero_folio"].cast("string"), F.lit("")), F.lit(": "), _line("", f["tramite"], f["desc_tramite"], f["fecha_tramite"], _tagged("foja ", f["foja"]), _mark(f, has)))
    folio = lambda f: F.concat(F.array(sheet(f, "F", "tiene_doc_principal")), _each(f["folio_anexo"], annex))
    book = lambda b: F.concat(F.array_compact(F.array(F.concat(F.lit("CUADERNO: "), F.coalesce(b["nombre"], F.lit(""))), _tagged("  Procedimiento: ", b["procedimiento"]), _tagged("  Etapa actual: ", b["etapa"]), F.concat(F.lit("  Total folios: "), F.size(b["folio"]).cast("string")))), _each(_by_number(b["folio"]), folio), F.array(F.lit("")))
    filings, notices, pieces = _all(s, "escrito"), _all(s, "notificacion"), _all(s, "pieza_exhorto")
    filing = lambda e: _line("- ", e["fecha_ingreso"], e["tipo_escrito"], e["solicitante"], F.when(e["tiene_doc"], "con doc"), F.when(e["tiene_anexo"], "con anexo"))
    notice = lambda n: _line("- ", n["fecha_tramite"], n["tramite"], n["tipo_notif"], F.coalesce(_given(n["nombre"]), n["tipo_participante"]), n["estado_notif"], end=F.coalesce(F.concat(F.lit(" ("), _given(n["obs_fallida"]), F.lit(")")), F.lit("")))
    details = lambda *parts: _if(F.concat_ws("", *parts) != "", F.concat(F.lit("  "), F.concat_ws(" | ", *parts)))
    letter = lambda e: F.concat(F.array(_line("- ", e["tipo_exhorto"], e["estado_exhorto"], e["tribunal_destino"])), details(_tagged("ROL origen: ", e["rol_origen"]), _tagged("ROL destino: ", e["rol_destino"]), _tagged("ordena: ", e["fecha_ordena"]), _tagged("ingreso: ", e["fecha_ingreso"])), F.transform(e["exhorto_doc"], lambda d: _line("  Doc: ", d["tramite"], d["referencia"], d["fecha"], end=_tick(d))))
    movement = lambda m: F.concat(F.array(F.concat(F.lit("  M"), F.coalesce(m["numero_folio"].cast("string"), F.lit("")), F.lit(": "), _line("", m["tramite"], m["descripcion"], m["fecha"], m["estado"], _tagged("sala ", m["sala"]), end=_tick(m)))), F.transform(m["remision_mov_anexo"], lambda a: _line("    -> Anexo: ", a["tipo_documento"], a["codigo"], _tagged("cant: ", a["cantidad"]), a["observacion"], end=_tick(a))))
    appeal = lambda r: F.concat(
        F.array(_line("- ", r["recurso"], r["corte"], r["libro"], r["fecha"])),
        details(_tagged("estado recurso: ", r["estado_recurso"]), _tagged("estado procesal: ", r["estado_procesal"]), _tagged("ubicación: ", r["ubicacion"])),
        _if(F.coalesce(r["exp_caratulado"], F.lit("")) != "", _line("  Exp: ", r["exp_caratulado"], r["exp_materia"], r["exp_tribunal"])),
        F.transform(r["remision_litigante"], lambda p: _line("  Parte: ", p["sujeto"], p["nombre_razon_social"], p["rut"])),
        F.array_compact(F.transform(r["remision_exhorto"], lambda e: _tagged("  Exhorto: ", e["exhorto"]))),
        F.array_compact(F.transform(r["remision_incompetencia"], lambda i: _tagged("  Incompetencia: ", i["incompetencia"]))),
        _if(F.size(r["remision_movimiento"]) > 0, F.lit("  Movimientos:")),
        _each(_by_number(r["remision_movimiento"]), movement),
    )
    of_pieces = F.when(F.size(pieces) > 0, F.concat(F.array(F.lit("PIEZAS DE EXHORTO:")), F.transform(pieces, lambda p: sheet(p, "P", "tiene_doc")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit("=== DATOS COMPLETOS DE LA CAUSA (fuente de verdad del expediente) ==="), F.lit("")),
        data,
        _section("LITIGANTES:", litigants, F.transform(litigants, lambda x: _line("- ", x["participante"], x["nombre_razon_social"], x["rut"]))),
        _each(s["cuaderno"], book),
        _section("ESCRITOS PRESENTADOS:", filings, F.transform(filings, filing)),
        _section("NOTIFICACIONES:", notices, F.transform(notices, notice)),
        _section("ANEXOS DE LA CAUSA:", s["anexo_causa"], F.transform(s["anexo_causa"], lambda a: _line("- ", a["referencia"], a["fecha"], end=_tick(a)))),
        _section("RETIROS DE RECEPTOR:", s["receptor"], F.transform(s["receptor"], lambda r: _line("- ", r["fecha_retiro"], r["cuaderno"], r["estado"], r["datos_retiro"]))),
        _section("EXHORTOS:", s["exhorto"], F.concat(_each(s["exhorto"], letter), of_pieces)),
        _section("RECURSOS EN CORTE (REMISIONES):", s["remision"], _each(s["remision"], appeal)),
        F.array(F.lit("=== FIN DATOS DE LA CAUSA ==="), F.lit("NOTA: Esta información es la fuente de verdad del expediente. ✓ = documento PDF con contenido extraído disponible para análisis detallado.")),
    )
    return F.array_join(lines, "\n")
