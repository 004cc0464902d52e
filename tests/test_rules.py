"""Questions are lower-cased and looked through once, however many words and lines there are."""

from pyspark.sql import functions as F

from folia.functions import rules

CASE = "\n".join(["=== CAUSA ===", "a", *(f"{h}\nx" for h, _ in rules.SECTIONS)])


def test_questions_are_read_once(spark):
    for made in (rules.wanted_sections(F.col("q")), rules.filtered_case_text(F.lit(CASE), F.col("q")), rules.wanted_origins(F.col("q"))):
        assert str(made).count("lower(") == 1


def test_sections_by_plain_python(spark):
    every = " ".join(words[0] for _, words in rules.SECTIONS)
    asked = ["", None, "EXHORTO", "¿Qué PLAZO corre?", "hola", every, *(w.upper() for _, words in rules.SECTIONS for w in words)]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", rules.wanted_sections(F.col("q")).alias("w"), rules.filtered_case_text(F.lit(CASE), F.col("q")).alias("t"))
    for i, wanted, text in rows.collect():
        want = [h for h, words in rules.SECTIONS if any(w in (asked[i] or "").lower() for w in words)]
        left = CASE if len(want) == len(rules.SECTIONS) else "\n".join(["=== CAUSA ===", "a", *(f"{h}\nx" for h in want)])
        assert (wanted, text) == (want, left)
