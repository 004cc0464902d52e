"""Maps of edits: the way back to the raw text, marks, and pages on invented texts."""

import random
import re

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folia.functions import chunking, edits

SIGN = "Código: ABCDE12345 Este documento tiene firma electrónica y su original puede ser validado en http://verificadoc.pjud.cl"
PARTS = ["-- 1 of 3 --", " -- 22 of 30 -- ", "C-123-2020 Foja: 7", "Scanned with CamScanner", SIGN, "vistos y considerando", " ", "\n", "-2-", "á", "--", "1 of", "Foja:"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_text_and_edits_give_the_raw_text(parts):
    raw = "".join(parts)
    clean, found, pieces = edits.edited(raw)
    assert edits.restored(clean, found) == raw
    assert "".join(raw[a:b] for a, b in pieces.spans) == clean
    for kind, _, content, a, b in found:
        assert 0 <= a < b <= len(raw) and raw[a] == content[0] and raw[b - 1] == content[-1]
    for at in range(len(raw) + 1):
        assert pieces.left(at) == sum(min(b, at) - min(a, at) for a, b in pieces.spans)
    marked = edits.annotated(raw, found)
    assert re.sub("««/?[a-z_]+»»", "", marked) == raw and marked.count("««/") == len(found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(x)", max_size=40))
def test_edits_that_reach_over_others(raw):
    rules = [("inner", regex.compile(r"\(x*\)")), ("pair", regex.compile("ab")), ("x", regex.compile("xx?"))]
    clean, found, pieces = edits.edited(raw, rules)
    want = raw
    for _, rule in rules:
        want = rule.sub("", want)
    assert clean == want and edits.restored(clean, found) == raw and "".join(raw[a:b] for a, b in pieces.spans) == clean
    marked = edits.annotated(raw, found)
    assert re.sub("««/?[a-z]+»»", "", marked) == raw


def test_kinds_and_places():
    raw = f"uno {SIGN} -- 1 of 2 -- C-12-2021 Foja: 3 dos -- 2 of 2 --"
    clean, found, pieces = edits.edited(raw)
    assert [k for k, *_ in found] == ["signature", "page_marker", "page_marker", "repeated_rol"]
    assert clean.split() == ["uno", "dos"] and all(raw[a:b] == c for _, _, c, a, b in found)
    assert edits.page_starts(raw) == [0, raw.index(" dos")] and pieces.left(raw.index(" dos")) == clean.index(" dos")
    assert edits.annotated(raw, found).startswith("uno ««signature»»Código: ABCDE12345")


def test_pages_of_chunks(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(("que", "la", "parte.", "demandada", "expone:", "notifíquese")) for _ in range(n))
    texts = {1: "".join(f"{prose(300)} -- {k} of 9 -- " for k in range(1, 10)), 2: prose(900), 3: "", 4: None, 5: f"{prose(20)} -- 1 of 2 -- {prose(20)}"}
    maps = edits.mapped(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string"), marks=True).cache()
    chunks = chunking.chunk(maps.select("doc_id", F.col("clean").alias("text"))).join(maps.select("doc_id", "clean_pages", "clean"), "doc_id")
    rows = chunks.select("*", edits.page_of(F.col("start_offset"), F.col("clean_pages")).alias("page")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 5} and {r["page"] for r in rows if r["doc_id"] == 2} == {None} and [r["page"] for r in rows if r["doc_id"] == 5] == [1]
    for r in rows:
        if r["doc_id"] == 1:
            raw, (_, _, pieces) = texts[1], edits.edited(texts[1])
            assert r["page"] == 1 + len(re.findall(r"of 9 --", raw[: pieces.raw(r["start_offset"]) + 1]))
    got = {r["doc_id"]: (r["pages"], r["marked"], r["edits"]) for r in maps.collect()}
    assert got[4] == got[3] == ([0], "", []) and len(got[1][0]) == 10 and got[1][1].count("««page_marker»»") == 9
