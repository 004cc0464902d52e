"""Choice of a page's table and of its download elements on invented pages."""

from pyspark.sql import functions as F

from folia.functions import page_choice as pc


def chosen(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", pc.facts("html").alias("f"))
    rows = df.select("i", pc.best_table(F.col("f")).alias("t"), pc.download_elements(F.col("f")).alias("e")).orderBy("i").collect()
    return [(r["t"] and tuple(r["t"]), [tuple(x) for x in r["e"]]) for r in rows]


def test_best_table(spark):
    plain = "<table><tr><td>uno</td></tr></table>"
    rows = "<tr><td>carátula</td><td><a href='#'>x</a></td></tr>" * 4
    good = f"<table><thead><tr><th>Rol</th><th>Fecha</th></tr></thead><tbody>{rows}</tbody></table>"
    nested = "<table><tr><td><table><tr><td>Rol</td></tr><tr><td>Fecha</td></tr></table></td></tr></table>"
    got = chosen(spark, plain + good, good + good, plain, nested, None, "<table><thead></thead><tr><td>Rol Tipo</td></tr>", "<p>")
    assert got[0][0] == (1, 4 + 0.5 + 0.75 + 0.4, round(5.65 / 8, 4)) and got[1][0][0] == 0
    assert got[2][0] is None and got[4] == (None, []) and got[6] == (None, [])
    assert got[3][0] == (0, 4.0, 0.5)  # text of a table within counts for the one around it
    assert got[5][0] == (0, 4.0, 0.5)  # an empty head isn't one


def test_download_elements(spark):
    page = """<nav><a href="/home">Inicio pdf documento descargar</a></nav>
      <a href="/x.pdf" target="_blank">Descargar</a> <span onclick="verDoc(3)">Abrir</span> <input type="submit" value="pdf" title="sentencia">
      <a href="#" title="Sentencia"><i class="fa fa-file-pdf"></i></a> <a href="#" title="Sentencia"><b class="fa-file-pdf"></b></a>
      <a href="/a" download>Ver<img alt="PDF" src="p.png"></a><a href="/b.pdf" data-x="download">Escrito resolución documento descargar sentencia</a>"""
    (_, found), = chosen(spark, page)
    assert found == [(7, "a", 1.0), (1, "a", 0.9), (6, "a", 0.85), (2, "span", 0.65), (4, "a", 0.4)]
