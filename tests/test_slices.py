"""Python functions of texts a slice at a time."""

import pyarrow as pa
from folia.functions import html, slices
from pyspark.sql import functions as F


def test_bounds_of_slices():
    bounds = lambda texts, rows, size: list(slices.sliced(pa.array(texts, pa.string()), rows, size))
    assert bounds([], 3, 10) == [] and bounds([None] * 4, 3, 10) == [(0, 3), (3, 4)]
    assert bounds(["a" * 6, "b" * 4, "c", "d" * 30, "e"], 9, 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_pages_are_read_by_slices(spark):
    page = "<table><tr><td>x</td></tr></table>"
    df = spark.range(1500).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit(page), F.col("id").cast("string"))).alias("html"))
    rows = df.select("id", html.html_rows("html").alias("r"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().toString()
    assert {(r["id"] % 7 > 0, len(r["r"])) for r in rows.collect()} == {(True, 1), (False, 0)}
