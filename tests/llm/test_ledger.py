"""Rule ledger: measurements by plain counting, policies and ablations by reading the rows."""

import random
import re
from collections import Counter

import pytest

from folia.llm import ledger as L

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    bare = [x.strip(" \t\n\r\x0b\x0c") for x in lines]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(lines),
        sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) for w in words), sum(x[0] in "-*•" for x in bare), sum(x.endswith(("...", "…")) for x in bare),
    )


def texts():
    rng = random.Random(5)
    made = [None, "", " ", "a", "a a a", "a a a a", "x y z x y z", "\x0b\x0c\r\n", "é ü #", "- a\n* b\n• c\nd...\ne…", "a\n a\na\n\n\na", "a\r\na\na", "\x1c \x85  ", "a b c d a b", "漢字 漢字 漢字 漢字"]
    for _ in range(150):
        words = [rng.choice(("ab", "ü", "c", "#", "|", "...", "-", "12", "•x", "long" * 4)) for _ in range(rng.choice((3, 9, 60, 400)))]
        made.append("".join(w + rng.choice((" ", " ", "\n", "\t", "  ", "\r\n")) for w in words))
    return [*made, "a b " * 40_000, " ".join(f"w{i}" for i in range(120_000))]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts())], "doc_id long, text string, n_words string, failures int")
    return L.ledger(df.unionAll(df.where("doc_id = 9")).repartition(3)).cache()


def test_measures(rows):
    found, want = {r["doc_id"]: r for r in rows.collect()}, [brute(t) for t in texts()]
    assert rows.count() == len(want) + 1
    assert [tuple(found[i][m] for m in L.MEASURES) for i in range(len(want))] == want
    for i in range(len(want)):
        known = dict(zip(L.MEASURES, want[i], strict=True))
        assert found[i]["failures"] == sum(1 << r.bit for r in L.RULES.values() if eval(r.fails, {}, known))
    assert found[0]["failures"] == found[1]["failures"] == 1


def test_policies_and_ablations(spark, rows):
    bits = [r["failures"] for r in rows.collect()]
    for version, rules in L.POLICIES.items():
        mask = L.mask(rules)
        assert rows.where(L.kept(version)).count() == sum(not b & mask for b in bits)
        found = {r["rule"]: r for r in L.ablation(rows, version).collect()}
        assert set(found) == set(rules)
        for name, r in found.items():
            bit = 1 << L.RULES[name].bit
            own = [b & mask for b in bits]
            assert (r["n_docs"], r["n_kept"], r["n_failed"]) == (len(bits), own.count(0), sum(bool(b & bit) for b in own))
            assert (r["n_failed_alone"], r["n_kept_without"]) == (own.count(bit), sum(not b & ~bit for b in own))
            both = 0
            for b in own:
                both |= b & ~bit if b & bit else 0
            assert (r["failed_with"] or 0) == both
    was, now = L.mask(L.POLICIES[1]), L.mask(L.POLICIES[3])
    r = L.changes(rows, 1, 3).first()
    assert (r["n_docs"], r["both"], r["only_old"]) == (len(bits), sum(not b & (was | now) for b in bits), sum(not b & was and bool(b & now) for b in bits))
    assert r["only_new"] == 0 and r["neither"] == sum(bool(b & was) for b in bits)
    grouped = L.ablation(rows.selectExpr("*", "doc_id % 2 AS part"), 2, ("part",)).collect()
    assert sum(r["n_docs"] for r in grouped if r["rule"] == "symbols") == len(bits)


def test_bits_are_distinct_and_empty_tables_pass(spark):
    assert len({r.bit for r in L.RULES.values()}) == len(L.RULES) and L.mask(L.BASE) == 3
    empty = L.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and L.ablation(empty).collect() == [] and L.changes(empty, 1, 2).first()["n_docs"] == 0
    nulls = L.ledger(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string"))
    assert [r["doc_id"] for r in nulls.collect()] == [None, None]
