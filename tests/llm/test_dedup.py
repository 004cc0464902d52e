"""SimHash groups and repeated substrings against brute force, also where groups are refined and split."""

import hashlib
import random

import brute
import numpy as np
import pytest

from folia.llm import simhash, substrings
from folia.llm.components import connected_components
from folia.llm.stages import drop_repeated_substrings, keep_one_of_near_copies


def table(spark, docs):
    return spark.createDataFrame([(i, t, "extra") for i, t in docs], "doc_id long, text string, fp string")


def prose(rng, n):
    return " ".join("".join(rng.choice(("ba", "ko", "ri", "mu", "te", "Zo")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    docs = [prose(rng, rng.randint(3, 90)) for _ in range(60)]
    passage = prose(rng, 40)
    docs += [f"{prose(rng, 5)} {passage} {prose(rng, 5)}" for _ in range(25)]
    for base in docs[:10]:
        docs += [base, base[:-4] + "ende", base]
    docs += ["", None, "a b", "", "ñandú " * 30, "ñandú " * 31, "x" * 49, "x" * 49, "x" * 50, "x" * 50, "é" * 40, "é" * 41, "z" * 40_000, "ab " * 9000]
    return list(enumerate(docs))


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 6])
def test_groups_match_brute_force(spark, group_rows):
    docs = corpus()
    fps = {i: brute.simhash(t) for i, t in docs}
    want = brute.components(fps)
    rows = simhash.near_groups(table(spark, docs), group_rows=group_rows).collect()
    assert {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows} == {(i, fps[i], want[i]) for i, _ in docs} and len(rows) == len(docs)


def test_dense_fingerprints_and_large_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [base[rng.integers(0, 12)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for k in rng.integers(1, 4, 400)]
    fps = np.unique(np.concatenate([base, flips, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    want = brute.components({int(x): int(x) for x in fps})
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    for group_rows in (simhash.GROUP_ROWS, 40):
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(simhash.links(df, group_rows=group_rows)).collect()}
        groups, mine = {}, {}
        for x, w in want.items():
            groups.setdefault(w, set()).add(x)
            mine.setdefault(roots.get(x, x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_spread_equals_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**12, 300, dtype=np.uint64)
    forest = simhash._Forest()
    simhash._spread(fps, 1, forest)
    want = {}
    ids = {int(x): int(x) for x in fps}
    want = brute.components(ids, 1)
    assert {x: forest.root(x) for x in ids} == {x: min(y for y in ids if want[y] == want[x]) for x in ids}


def test_allotted_thresholds_cover_the_radius():
    rng = np.random.default_rng(3)
    for total in (1000, 10**6, 10**9):
        parts = simhash.allot(rng.integers(0, 2**63, 500, dtype=np.uint64), total)
        assert sum(t + 1 for _, t in parts) == simhash.RADIUS + 1
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)


def test_chain_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert set(roots.values()) == {0, 500} and len(roots) == 203
    assert connected_components(links.limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = corpus()
    want = brute.components({i: brute.simhash(t) for i, t in docs})
    df = table(spark, docs)
    kept = keep_one_of_near_copies(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    twice = df.unionAll(df).unionAll(spark.createDataFrame([(None, "alone in the world of words", "e"), (None, "alone in the world of words", "e"), (None, docs[0][1], "e")], df.schema))
    again = [r["doc_id"] for r in keep_one_of_near_copies(spark, twice, "").collect()]
    assert sorted(again, key=lambda x: (x is None, x)) == [*sorted(set(want.values())), None]


@pytest.mark.parametrize("few", [0, 10**6])
def test_representatives_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_IDS", few)
    docs = corpus()
    want = brute.components({i: brute.simhash(t) for i, t in docs})
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(table(spark, docs)).collect()) == sorted(set(want.values()))


def test_representatives_of_repeated_ids(spark):
    own, other = "one two three four five six", "quite another text of several words"
    df = spark.createDataFrame([(1, own), (3, own), (3, other), (None, own)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_representatives(df).collect()) == [(1, own), (3, other)]


@pytest.mark.parametrize("hot", [substrings.HOT_CONTEXTS, 3])
def test_repeats_match_brute_force(spark, hot):
    docs = corpus()
    masks = brute.repeats({i: (t or "").encode() for i, t in docs if i != len(docs) - 2} | {len(docs) - 2: b"z" * 60})
    rows = {r["doc_id"]: r for r in substrings.repeated_bytes(table(spark, docs), hot_contexts=hot).collect()}
    assert len(rows) == len(docs)
    for i, text in docs:
        raw, mask = np.frombuffer((text or "").encode(), np.uint8), masks[i]
        if i == len(docs) - 2:
            continue
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(raw), int(mask.sum()), spans, hashlib.sha256(raw[~mask].tobytes()).hexdigest()), i


def test_refinement_tells_windows_apart():
    rng = random.Random(8)
    for bucket_bytes in (100, 10**6):
        base = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(4)]
        contexts = [b[: rng.randint(50, 70)][rng.randint(0, 3) :].ljust(50, "c").encode() for b in base * 9]
        contexts = [c[:k] + b"x" + c[k + 1 :] if k % 2 else c for c, k in ((c, rng.randrange(50)) for c in contexts)]
        least, width = np.asarray([rng.randrange(20) for _ in contexts]), 12
        got = np.zeros((len(contexts), 80), bool)
        for k, a, b in zip(*substrings.refine(contexts, np.zeros(len(contexts), np.int64), least, width, bucket_bytes), strict=True):
            got[k, a:b] = True
        first = {}
        for c, n in zip(contexts, least.tolist(), strict=True):
            for at in range(len(c) - width + 1):
                w = c[at : at + width]
                first[w] = min(n, first.get(w, n))
        want = np.zeros_like(got)
        for k, (c, n) in enumerate(zip(contexts, least.tolist(), strict=True)):
            for at in range(len(c) - width + 1):
                if first[c[at : at + width]] < n:
                    want[k, at : at + width] = True
        assert (got == want).all() and want.any()


def test_repeats_with_null_and_repeated_ids(spark):
    line = "this line is quite long and stands in several of the documents here"
    df = spark.createDataFrame([(None, line), (3, line), (3, line + "!"), (None, line + "?"), (5, None)], "doc_id long, text string")
    found = sorted((r["n_bytes"], r["n_removed"]) for r in substrings.repeated_bytes(df).collect())
    n = len(line)
    assert found == sorted([(n, n), (n, 0), (n + 1, 0), (n + 1, n), (0, 0)])
    assert substrings.repeated_bytes(df.limit(0)).collect() == []


def test_removal_keeps_texts_valid(spark):
    docs = corpus()
    df = table(spark, docs)
    done = drop_repeated_substrings(spark, df, "")
    assert done.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    rows = {r["doc_id"]: r for r in substrings.repeated_bytes(df).collect()}
    for i, text in docs:
        if rows[i]["n_removed"] == 0:
            assert texts[i] == text
        elif text.isascii():
            assert hashlib.sha256(texts[i].encode()).hexdigest() == rows[i]["kept_sha256"]
        else:
            texts[i].encode()
