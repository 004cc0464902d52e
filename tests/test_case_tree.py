"""Case trees: nesting and back, changes on every branch against a fold over dictionaries, and the text."""

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import case_tree
from folia.operators.case_tree import BRANCHES, CASE, FLAGS, NUMBERS


def value(name, rng):
    if name in NUMBERS:
        return rng.choice([1, 2, 3, None])
    if name in FLAGS:
        return rng.choice([True, False, None])
    return rng.choice(["a", " a ", "b  c", "b c", "bd", "", None])


def made(seed, cases, most=3):
    """Nested dictionaries of every branch, with repeated keys and nulls."""
    rng = random.Random(seed)

    def record(branch):
        x = {c: value(c, rng) for c in branch.columns}
        for child in case_tree._children(branch.category):
            x[child.category] = [record(child) for _ in range(rng.randrange(most))]
        return x

    return {case: record(BRANCHES[0]) for case in cases}


def tables(spark, cases):
    rows = {b.category: [] for b in BRANCHES}

    def put(branch, case, parent, pos, x):
        key = f"{parent}.{branch.category[:4]}{branch.category[-4:]}{pos}" if parent else str(case)
        rows[branch.category].append((case, key, parent, pos, *(x[c] for c in branch.columns)))
        for child in case_tree._children(branch.category):
            for k, y in enumerate(x[child.category]):
                put(child, case, key, k, y)

    for case, x in cases.items():
        put(BRANCHES[0], case, None, 0, x)
    random.Random(1).shuffle(rows["folio"])
    kinds = lambda b: "".join(f", {c} {case_tree._type(c)}" for c in b.columns)
    return {b.category: spark.createDataFrame(rows[b.category], f"case_id long, id string, parent_id string, pos int{kinds(b)}") for b in BRANCHES}


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return "sí" if v else "no"
    return " ".join(str(v).split())


def expected(old, new):
    """The changes one case and record after the other."""
    found = []

    def level(case, parent, a, b, book, of):
        for branch in case_tree._children(parent):
            key = lambda x: (x["nombre"] or "") if branch.category == "cuaderno" else "|".join(plain(x[k]) for k in branch.keys)
            left, right = ({key(x): x for x in side[branch.category]} for side in (a, b))
            for k in sorted(left.keys() | right.keys()):
                compare(case, branch, k, left.get(k), right.get(k), k if branch.category == "cuaderno" else book, of)

    def compare(case, branch, key, x, y, book, of):
        shown = f"{of}|f{key}" if branch.category == "remision_movimiento" else key
        if x is None or y is None:
            found.append((case, branch.category, "removed" if y is None else "added", book, shown, None, None, None))
            return
        for f in branch.fields:
            a, b = plain(x[f]), plain(y[f])
            cut = a and b and (a.startswith(b) or b.startswith(a))
            if a != b and not (branch.category == CASE and cut):
                found.append((case, branch.category, "changed", book, shown, f, a or None, b or None))
        label = (y["descripcion_tramite"] or y["libro"] or "?") if branch.category == "remision" else None
        level(case, branch.category, x, y, book, label)

    for case in old.keys() & new.keys():
        compare(case, BRANCHES[0], "causa", old[case], new[case], None, None)
    return found


def later(cases, seed):
    """The same cases with some values changed, some records gone and some new."""
    rng = random.Random(seed)

    def record(branch, x):
        y = {c: value(c, rng) if rng.random() < 0.15 else x[c] for c in branch.columns}
        for child in case_tree._children(branch.category):
            y[child.category] = [record(child, z) for z in x[child.category] if rng.random() < 0.85]
            if rng.random() < 0.2 and x[child.category]:
                y[child.category].append(record(child, rng.choice(x[child.category])))
        return y

    return {case: record(BRANCHES[0], x) for case, x in cases.items()}


@pytest.fixture(scope="module")
def two():
    old, new = made(1, range(12), 4), later(made(1, range(12), 4), 2)
    del old[0], new[1]
    return old, new


@pytest.fixture(scope="module")
def stored(spark, two, tmp_path_factory):
    """Both snapshots' tables, read from files."""
    found = []
    for k, cases in enumerate(two):
        root = tmp_path_factory.mktemp(f"snapshot{k}")
        for name, rows in tables(spark, cases).items():
            rows.coalesce(1).write.parquet(f"{root}/{name}")
        found.append({b.category: spark.read.parquet(f"{root}/{b.category}") for b in BRANCHES})
    return found


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_changes_of_every_branch(two, stored):
    old, new = two
    want = expected(old, new)
    assert {c for _, c, *_ in want} == {b.category for b in BRANCHES} and {t for _, _, t, *_ in want} == {"added", "removed", "changed"}
    assert ordered(case_tree.changes(*stored).collect()) == ordered(want)


def test_snapshots_nest_and_come_back(two, stored, tmp_path):
    for k, x in enumerate(stored):
        case_tree.build(x).write.parquet(f"{tmp_path}/{k}")
    session = stored[0][CASE].sparkSession
    old, new = (session.read.parquet(f"{tmp_path}/{k}") for k in range(2))
    got = {r["case_id"]: r["snapshot"].asDict(recursive=True) for r in old.collect()}
    assert got == two[0]
    assert ordered(case_tree.changes(case_tree.tables_of(old), case_tree.tables_of(new)).collect()) == ordered(expected(*two))


def test_changes_below_parents_of_other_ids(two, stored):
    """Ids of the new snapshot are others than the old ones': of all records, then of every third."""
    above = {b.category: b.parent for b in BRANCHES}
    for share in (1, 3):
        other = lambda c: F.when(F.crc32(F.col(c)) % share == 0, F.concat(F.lit("n"), c)).otherwise(F.col(c))  # noqa: B023, E731
        new = {k: v if k == CASE else v.withColumns({"id": other("id"), "parent_id": F.col("parent_id") if above[k] == CASE else other("parent_id")}) for k, v in stored[1].items()}
        assert ordered(case_tree.changes(stored[0], new).collect()) == ordered(expected(*two))


def test_a_level_is_shuffled_once(stored, monkeypatch):
    """The records of a level and their parents: two exchanges by keys at most, none between the join and the aggregate; what didn't change and has no children isn't stored."""
    plans, sizes, keep = [], [], case_tree.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = keep(df, name)
        sizes.append(out.where("size(found) = 0 AND old_id IS NULL").count())
        return out

    monkeypatch.setattr(case_tree, "stored", watched)
    case_tree.changes(*stored).count()
    assert len(plans) == 3 and max(p.count("Exchange hashpartitioning") for p in plans) <= 2 and sizes == [0, 0, 0]


def test_empty_and_missing_tables(spark):
    case = spark.createDataFrame([(1, "x", "C-1")], "case_id long, caratula string, rol string")
    built = case_tree.build({CASE: case})
    assert built.first()["snapshot"]["cuaderno"] == []
    assert case_tree.changes({CASE: case}, {CASE: case.limit(0)}).count() == 0
    assert case_tree.changes({CASE: case}, {CASE: case}).count() == 0
    text = built.select(case_tree.case_text(F.col("snapshot"))).first()[0].split("\n")
    assert text[2:6] == ["DATOS GENERALES:", "  ROL: C-1", "  Carátula: x", ""] and len(text) == 8


def test_text_of_a_case(spark):
    none = lambda b: {c: None for c in b.columns} | {c.category: [] for c in case_tree._children(b.category)}
    new = lambda category, **given: none(next(b for b in BRANCHES if b.category == category)) | given
    folios = [new("folio", numero_folio=2, tramite="Escrito", foja=0, tiene_doc_principal=True), new("folio", numero_folio=1, tramite="Resolución", desc_tramite="", fecha_tramite="01/02/2024", tiene_doc_principal=True, has_content=True, folio_anexo=[new("folio_anexo", referencia="Poder", fecha="02/02/2024", has_content=True)])]
    first = new("cuaderno", nombre="Principal", etapa="Prueba", folio=folios, litigante=[new("litigante", participante="DTE", rut="1-9", nombre_razon_social="ANA")], escrito=[new("escrito", tipo_escrito="Demanda", tiene_doc=True, tiene_anexo=False)], notificacion=[new("notificacion", tramite="Cédula", tipo_participante="DDO", obs_fallida="ausente")], pieza_exhorto=[new("pieza_exhorto", numero_folio=7, tiene_doc=True)])
    second = new("cuaderno", nombre="Apremio", litigante=[new("litigante", participante="DDO")])
    movement = new("remision_movimiento", numero_folio=3, tramite="Vista", sala="2", has_content=True, remision_mov_anexo=[new("remision_mov_anexo", codigo="9", cantidad="1")])
    appeal = new("remision", recurso="Apelación", corte="C.A. de Talca", estado_recurso="Fallado", exp_caratulado="A / B", remision_litigante=[new("remision_litigante", sujeto="Apelante")], remision_exhorto=[new("remision_exhorto", exhorto="E-1"), new("remision_exhorto")], remision_incompetencia=[new("remision_incompetencia", incompetencia="I")], remision_movimiento=[movement])
    letter = new("exhorto", tipo_exhorto="Nacional", rol_destino="E-2", exhorto_doc=[new("exhorto_doc", referencia="Oficio")])
    case = new(CASE, rol="C-1-2024", causa_origen="C-9", cuaderno=[first, second], anexo_causa=[new("anexo_causa", referencia="Pagaré")], receptor=[new("receptor", estado="Listo", cuaderno="Principal")], exhorto=[letter], remision=[appeal])
    text = case_tree.build(tables(spark, {1: case})).select(case_tree.case_text(F.col("snapshot"))).first()[0]
    assert text.split("\n")[2:-2] == """DATOS GENERALES:
  ROL: C-1-2024
  Causa origen: C-9 (—)

LITIGANTES:
- DTE | ANA | 1-9

CUADERNO: Principal
  Etapa actual: Prueba
  Total folios: 2
  F1: Resolución | 01/02/2024 | ✓
    -> Anexo: Poder | 02/02/2024 ✓
  F2: Escrito | foja 0 | con doc

CUADERNO: Apremio
  Total folios: 0

ESCRITOS PRESENTADOS:
- Demanda | con doc

NOTIFICACIONES:
- Cédula | DDO (ausente)

ANEXOS DE LA CAUSA:
- Pagaré

RETIROS DE RECEPTOR:
- Principal | Listo

EXHORTOS:
- Nacional
  ROL destino: E-2
  Doc: Oficio
PIEZAS DE EXHORTO:
  P7: con doc

RECURSOS EN CORTE (REMISIONES):
- Apelación | C.A. de Talca
  estado recurso: Fallado
  Exp: A / B
  Parte: Apelante
  Exhorto: E-1
  Incompetencia: I
  Movimientos:
  M3: Vista | sala 2 ✓
    -> Anexo: 9 | cant: 1
""".split("\n")
