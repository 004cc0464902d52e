"""Toxicity, quality and the lattice model: held-out accuracy, sums against brute force, edge cases."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import brute
import numpy as np
import public_tokenizers
import pytest

from folia.llm import lattice, nbsvm, toxicity
from folia.llm.stages import drop_toxic

EDGE = [None, "", " ", "x" * 50_000, "word " * 3000]


def words(rng, n):
    return " ".join("".join(rng.choice(("ba", "ko", "ri", "mu", "te", "zo", "la", "pi")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(spark, mark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        text = mark(rng, words(rng, 80)) if bad else words(rng, 80)
        docs.append((i, text, "en"))
        labels.append((i, int(not bad), int(bad)))
    docs += [(1000 + k, t, "en") for k, t in enumerate(EDGE)] + [(None, "no id", "en"), (3, "a repeated id", "en")]
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, tox_score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def insult(rng, text):
    parts = text.split()
    for _ in range(4):
        parts.insert(rng.randrange(len(parts)), rng.choice(("dreadful", "wretched", "contemptible", "nincompoop")))
    return " ".join(parts)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, insult)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["tox_score"] <= 1 and r["tox_predicted"] == int(r["tox_score"] >= 0.5) for r in rows)
    out = [(r["tox_predicted"], int(r["doc_id"] % 4 == 0)) for r in rows if held_out(r["doc_id"]) and r["doc_id"] < 700 and r["text"] != "a repeated id"]
    assert np.mean([a == b for a, b in out]) > 0.95
    same = {r["tox_score"] for r in rows if r["text"] in (None, "")}
    assert len(same) == 1


def test_clean_documents_stay(spark, monkeypatch):
    import folia.llm.stages as stages

    docs, labels = labelled(spark, insult)
    monkeypatch.setattr(stages, "table", lambda *a: labels)
    kept = drop_toxic(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sum(i is not None and i < 700 and i % 4 != 0 for i in ids) > 510 and sum(i is not None and i < 700 and i % 4 == 0 for i in ids) < 15


def test_toxicity_of_long_texts(spark):
    rng = random.Random(11)
    docs = []
    for i in range(240):
        own = words(rng, 3000).split()
        if i % 3 == 0:  # one passage, anywhere in some 180 windows
            own[(at := rng.randrange(2900)) : at] = ["dreadful", "nincompoop", "wretched", "contemptible"]
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in docs], "doc_id long, quality int, toxic int")
    assert min(len(toxicity.windows(t.encode())) for _, t in docs) > 96
    model = toxicity.fit(df, labels)
    rows = {r["doc_id"]: r["tox_predicted"] for r in toxicity.score(df, model).collect()}
    assert np.mean([rows[i] == int(i % 3 == 0) for i, _ in docs if held_out(i)]) > 0.95


def test_toxicity_is_calibrated_on_all_windows(spark, monkeypatch):
    long = " ".join(["word"] * 6000)
    df = spark.createDataFrame([(i, long) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, w: seen.append(x) or np.zeros(5))
    toxicity.fit(df, labels)
    n = len(toxicity.windows(long.encode()))
    assert n > 96 and len(seen[0]) and np.allclose(seen[0][:, 3], math.log1p(n))


@pytest.mark.parametrize("size", [0, 3])
def test_toxicity_without_labels(spark, size):
    docs, labels = labelled(spark, insult)
    rows = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0").limit(size))).collect()
    assert len({r["tox_score"] for r in rows}) == 1 and rows[0]["tox_predicted"] == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).collect() == []


def test_windows_are_the_whole_text():
    for text in ("", "a b c", "word " * 999, "y" * 5000, "é" * 333):
        raw = text.encode()
        assert b"".join(w[:-1] for w in toxicity.windows(raw)) == raw.lower()
        assert max(map(len, toxicity.windows(raw))) <= toxicity.LONGEST + toxicity.WINDOW


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda rng, t: t.upper().replace(" ", "!! ") if rng.random() < 0.5 else " ".join([t.split()[0]] * 70))
    rows = nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["quality_score"] <= 1 and r["quality_predicted"] == int(r["quality_score"] >= 0.3) for r in rows)
    out = [(r["quality_predicted"], int(r["doc_id"] % 4 != 0)) for r in rows if held_out(r["doc_id"]) and r["doc_id"] < 700 and r["text"] != "a repeated id"]
    assert np.mean([a == b for a, b in out]) > 0.97
    none = nbsvm.score(docs, nbsvm.fit(docs, labels.limit(0))).collect()
    assert len({r["quality_score"] for r in none}) == 1


def test_dual_descent_finds_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    y = np.asarray([int(3 in x or 7 in x) for x in rows])
    scale = np.ones(30)
    w, b = nbsvm.dual_descent(rows, y, scale, cost=1.0, epochs=400)
    sign = np.where(y > 0, 1, -1)
    bound = 1.0 / np.asarray([(y == k).mean() for k in y]) / 2

    def primal(w, b):
        margin = sign * (np.asarray([w[x].sum() for x in rows]) / np.sqrt(6) + b)
        return 0.5 * ((w**2).sum() + b * b) + (bound * np.maximum(0, 1 - margin)).sum()

    best = primal(w, b)
    for _ in range(300):
        assert primal(w + rng.normal(0, 0.02, 30), b + rng.normal(0, 0.02)) >= best - 1e-4


def pieces():
    text = [b" ", b" a", b"a", b"ab", b"b", b" ab", b"ba", b"c"]
    weight = np.asarray([5, 4, 3, 6, 2, 1, 2, 1], float)
    return lattice.Pieces(text, np.log(weight / weight.sum()))


def segmentations(word, known):
    n = len(word)
    for k in range(n):
        for cuts in combinations(range(1, n), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, n), strict=True)]
            if all(p in known for p in parts):
                yield parts


def test_marginals_sum_over_all_segmentations():
    p = pieces()
    known = dict(zip(p.text, np.exp(p.weight), strict=True))
    some = [b"a", b"ab", b"aba", b"abcab", b"bbbb", b"c"]
    got = lattice.Lattice(p).scores(some)
    for w, s in zip(some, got, strict=True):
        assert s == pytest.approx(math.log(sum(math.prod(known[x] for x in parts) for parts in segmentations(b" " + w, known))))
    counts = np.asarray([2.0, 1, 3, 1, 1, 4])
    want = Counter()
    for w, n in zip(some, counts, strict=True):
        ways = [(math.prod(known[x] for x in parts), parts) for parts in segmentations(b" " + w, known)]
        for q, parts in ways:
            for x in parts:
                want[x] += n * q / sum(q for q, _ in ways)
    assert lattice.Lattice(p).expected(some, counts) == pytest.approx([want[x] for x in p.text])


@pytest.mark.parametrize("frequent", [lattice.FREQUENT, 20])
def test_document_scores(spark, frequent):
    rng = random.Random(1)
    texts = {i: (words(rng, 30) if i % 2 else words(rng, 20).replace("o", "ö")) for i in range(120)} | {500 + k: t for k, t in enumerate(EDGE)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, score string")
    rows = lattice.document_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), frequent=frequent, classes=2).collect()
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*brute.lower(t).split(), "\n"] for i, t in texts.items()}
    seen = Counter(w for i, own in tokens.items() if not out[i] for w in own)
    total, distinct = sum(seen.values()), len(seen)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(seen[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    by_word, gone = {}, lattice.fit(spark.createDataFrame([(w.encode(), n) for w, n in seen.items() if w != "\n"], "word binary, n long"), lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    own = sorted({w for t in tokens.values() for w in t[:-1]})
    by_word = dict(zip(own, lattice.Lattice(gone).scores([w.encode() for w in own]) / math.log(10), strict=True))
    ends = seen["\n"]
    for r in rows:
        words_ = tokens[r["doc_id"]][:-1]
        pure = sum(by_word[w] + math.log10((total - ends + 0.5) / (total + 1)) for w in words_) + math.log10((ends + 0.5) / (total + 1))
        assert r["lattice_score"] == pytest.approx(pure, rel=1e-5)
    assert lattice.document_scores(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []
