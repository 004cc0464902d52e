"""Best-fit packing: ids, gapless places, bounds on the number of sequences, edge cases."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folia.llm import packing
from folia.llm.queries import packed_digest, tokenizer_path

TEXTS = ["", None, "Hello, WORLD! it's 42", "naïve Ärger señor İstanbul ΟΔΟΣ", "a<|endoftext|>b  c", "«x»…!? — don't", "x" * 9000, " \n\t ", "word " * 5000, "ẞtraße été \x1cq  z", "same", "same"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def test_ids_are_the_tokenizers(spark):
    tok = Tokenizer.from_file(tokenizer_path())
    found = {}
    for r in packing.tokenize_pieces(frame(spark), tokenizer_path()).collect():
        found.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, text in enumerate(TEXTS):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = [found[i][k] for k in sorted(found[i])]
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == want
        assert [p["start"] for p in pieces] == list(range(0, len(want), packing.CAPACITY))
        assert all(p["length"] == packing.CAPACITY for p in pieces[:-1])


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    enc, tok = packing._Encoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path())
    for texts in (["the quick brown fox jumps", "over lazy dogs!"], ["the fox, the dogs", "Over OVER over"], ["jumps."]):
        for raw, text in zip(enc.encode([t.encode() for t in texts]), texts, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 30), max_size=12))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan_patterns(counts, 24)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 24 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {k: n for k, n in counts.items() if n}
    sequences = sum(t for _, t in plan)
    assert sequences <= 11 / 9 * -(-sum(k * n for k, n in counts.items()) // 24) + sum(n for k, n in counts.items() if k > 12) + 1


def test_triples_and_pairs_fill_exactly():
    assert sum(t for _, t in packing.plan_patterns({10: 2, 7: 2, 4: 2, 3: 2}, 24)) == 2
    assert [sorted(p) for p, _ in packing.plan_patterns({20: 1, 2: 2}, 24)] == [[2, 2, 20]]
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        k = min(4096, max(1, int(rng.lognormvariate(6, 1))))
        counts[k] = counts.get(k, 0) + 1
    assert sum(t for _, t in packing.plan_patterns(counts)) == -(-sum(k * n for k, n in counts.items()) // 4096)


def test_places_are_gapless(spark):
    rows = packed_digest(frame(spark, TEXTS * 7)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_empty_table_and_sequences(spark):
    assert packed_digest(frame(spark, [])).collect() == []
    pieces = packing.tokenize_pieces(frame(spark), tokenizer_path())
    whole = packing.sequences(pieces, packing.pack_pieces(pieces.drop("ids"))).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 4 * packing.CAPACITY for r in whole)
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in pieces.collect())
