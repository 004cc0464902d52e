"""What reaches the driver stays bounded, and switches by size give equal rows."""

import numpy as np

from pyspark.sql import functions as F

from folia.llm import nbsvm, toxicity, warc


def labelled(spark):
    texts = [(k, ("vile wretch " if k % 3 == 0 else "fair weather ") * 20 + f"day {k}") for k in range(60)]
    docs = spark.createDataFrame(texts + [(6, f"copy {i} " + "x y " * 30) for i in range(3000)], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(k % 2 == 0), int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")


def test_a_labelled_id_of_very_many_rows(spark):
    docs, labels = labelled(spark)
    rows, share = toxicity._sample(docs, labels, 50, 50)
    numbers = toxicity._numbered(rows, {0: 50, 1: 50}, 4000)
    sizes = {r["row"]: (r["label"], r["size"]) for r in rows.select("row", "label", "size").collect()}
    for c, own in numbers.items():
        assert 0 < len(own) <= 50 and sum(sizes[n][1] for n in own) <= 4000 and {sizes[n][0] for n in own} == {c}
    assert len(toxicity._numbered(rows, {0: 10, 1: 10}, 1 << 30)[1]) == 10 and 0 < share < 1
    model, _ = nbsvm.fit(docs, labels, fit_rows=40)
    assert np.isfinite(model.weights).all()
    out = toxicity.score(docs.limit(5), toxicity.fit(docs, labels, fit_bytes=2000)).collect()
    assert len(out) == 5 and all(0 <= r["tox_score"] <= 1 for r in out)


def test_archives_of_many_repeated_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://a.example/{k % 7}", f"p{k % 11}" if k % 5 else None) for k in range(80)], "page_id long, url string, html string")

    def rows():
        out = warc.archive_index(pages).select("page_id", "payload_digest", "record_type", "refers_to", "url_key", "captured", F.col("range_no"), "range_pos")
        return sorted(out.collect())

    few = rows()
    monkeypatch.setattr(warc, "REPEATED", 0)
    assert rows() == few and len(few) == 80
