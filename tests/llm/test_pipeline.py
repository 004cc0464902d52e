"""The pipeline end to end on a small corpus, each stage held against a brute-force version of it."""

import random
import zlib

import brute
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from folia.llm import toxicity
from folia.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice(("ba", "ko", "ri", "mu", "te", "zo", "la")) for _ in range(rng.randint(1, 3))) for _ in range(n))

    passage, items = prose(30), [(k, prose(14)) for k in range(3)]
    texts = []
    for i in range(260):
        words = prose(60).split()
        if i % 5 == 0:
            for _ in range(5):
                words.insert(rng.randrange(60), rng.choice(("dreadful", "wretched", "nincompoop")))
        text = " ".join(words)
        if i % 9 == 0:
            text += " " + passage
        if i % 13 == 0:
            text = items[i % 3][1] + " " + text
        texts.append(text)
    texts += [texts[1], texts[2] + ".", texts[3], "", None, "x " * 9000]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return docs, [(i, 1, int(i % 5 == 0)) for i in range(250)], items


def test_stages_match_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]

    now, tables = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, d).write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        tables.append(now)
    assert all(t.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]

    first = spark.read.parquet(f"{d}/documents.parquet")
    rated = {r["doc_id"]: r for r in toxicity.score(first, toxicity.fit(first, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert texts[0] == {i: r["text"] for i, r in rated.items() if r["tox_score"] < 0.5}
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(i not in texts[0]) == (i % 5 == 0) for i in held]) > 0.9

    groups = brute.components({i: brute.simhash(t) for i, t in texts[0].items()})
    assert texts[1] == {i: t for i, t in texts[0].items() if groups[i] == i}
    masks = brute.repeats({i: (t or "").encode() for i, t in texts[1].items() if len(t or "") < 15_000})
    assert set(texts[2]) == set(texts[1])
    for i, mask in masks.items():
        raw = np.frombuffer((texts[1][i] or "").encode(), np.uint8)
        assert (texts[2][i] or "").encode() == raw[~mask].tobytes()
    assert texts[3] == {i: t for i, t in texts[2].items() if not brute.hits(t, items)[1]}

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = tables[-1].collect()
    assert {r["doc_id"] for r in pieces} == set(texts[3])
    for i, t in texts[3].items():
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(k, s, n) for k, s, n, _ in own] == [(k, at, min(4096, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 4096))]
        assert [c for *_, c in own] == [zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, _ in own]

    whole = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces}
