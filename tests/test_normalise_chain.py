"""The chain of removals and repairs, each pattern tried only where it may match, against the same patterns tried everywhere."""

import random

from pyspark.sql import functions as F

from folia.functions import normalise as N

PIECES = [
    "Código: AB12345 Este documento tiene firma electrónica y su original puede ser validado en h t t p s : / / v e r i f i c a d o c . p j u d . c l", "-- 1 of 2 --", " -12- ", "C-1-2024 Foja: 3", "ſcanned with X", "Scanned with Y", "Scan-- 1 of 2 --ned with Z",
    "FOJA: 2 .- dos .- NOMENCLATURA : 1. [4]Sentencia JUZGADO : 1 Juzgado Civil CAUSA ROL : C-1-2020 CARATULADO : A/B Santiago, dos", "A contar del 01 de enero de 2024, la hora visualizada es http://www.horaoficial.cl", "Código: 1234567890 validar en http://www.esigner.cl/a",
    "ANA Fİrmado digitalmente ANA por ANA Fecha: 2024.01.02 ANA 10:11:12 -03'00'", "ana firmado digitalmente ana por ana fecha: 2024.01.02 ana 10:11:12 -03'00'", "a ó b", " é  x", "hola", "\n", "do a d a", *(b.replace("|", " ").replace("_", " ") for b, _ in N.REPAIRS), *(b.strip("|_") for b, _ in N.REPAIRS),
]


def everywhere(text):
    for _, pattern in N.REMOVALS:
        text = F.regexp_replace(text, pattern, "")
    return text


def in_order(text):
    fixes, text = N.occurrences(text, N.FLOATING_ACCENT), F.regexp_replace(text, N.FLOATING_ACCENT, " ")
    yield text, fixes
    for broken, whole in N.REPAIRS:
        before = r"(?<![\p{L}\p{N}_])" if broken[0] == "|" else r"(?<=\s)" if broken[0] == "_" else ""
        after = r"(?![\p{L}\p{N}_])" if broken[-1] == "|" else r"(?=\s)" if broken[-1] == "_" else ""
        pattern = before + broken.strip("|_") + after
        yield F.regexp_replace("t", pattern, whole), F.col("n") + N.occurrences(F.col("t"), pattern)


def test_guarded_patterns_find_the_same(spark):
    rng = random.Random(5)
    texts = [*PIECES, "", None, *("".join(rng.choice(("", " ", "x")) + rng.choice(PIECES) for _ in range(rng.randrange(2, 9))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows.cache().count()
    got = rows.select("i", N.removed(F.col("t")).alias("removed"), N.repairs(F.col("t")).alias("r")).select("i", "removed", "r.text", "r.fixes")
    want = {r["i"]: r["x"] for r in rows.select("i", everywhere(F.col("t")).alias("x")).collect()}
    now = rows
    for k, (text, fixes) in enumerate(in_order(F.col("t"))):
        now = now.select("i", text.alias("t"), fixes.alias("n"))
        if k % 12 == 11:
            now = spark.createDataFrame(now.collect(), now.schema)
    mended = {r["i"]: (r["t"], r["n"]) for r in now.collect()}
    for r in got.collect():
        assert r["removed"] == want[r["i"]], texts[r["i"]]
        assert (r["text"], r["fixes"]) == mended[r["i"]], texts[r["i"]]
    assert sum(n > 0 for _, n in mended.values()) > 100 and sum(a != b for a, b in zip(texts, (want[i] for i in range(len(texts))), strict=True)) > 50


def test_patterns_have_a_guard():
    assert len(N.REMOVAL_HELD) == len(N.REMOVALS)
    assert all(N._pattern(b).startswith(b.strip("|_")) for b, _ in N.REPAIRS)
