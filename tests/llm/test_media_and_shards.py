"""Transport streams, archives, shards and decontamination: round trips, laws and brute force."""

import base64
import hashlib
import random
import zlib

import brute
import pytest

from pyspark.sql import functions as F

from folia.llm import decontamination, packing, ring, simhash, substrings, transport_stream, warc
from folia.llm.components import link_mark
from folia.llm.stages import drop_contaminated

TEXTS = [None, "", "a", "b" * 64, "c" * 65, "é" * 5000, "d" * 16384, "e" * 40_000, "a", "f" * 170, "g" * 162, "h" * 346]


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 345, 346, 347, 16384, 16385, 70_001])
def test_streams_round_trip(n):
    raw = bytes(random.Random(n).randrange(256) for _ in range(n))
    s = transport_stream.demux(transport_stream.mux(raw))
    assert s.samples == raw and len(s.pts) == len(s.random_access) == -(-n // transport_stream.UNIT)
    assert s.pts == [9000 + k * transport_stream.TICKS for k in range(len(s.pts))]


def test_damage_is_found():
    media = bytearray(transport_stream.mux(b"x" * 9000))
    for at in (0, 188 * 3 + 3, 20, 188 + 20, 188 * 2 + 15):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            transport_stream.demux(bytes(bad))
    with pytest.raises(ValueError):
        transport_stream.demux(bytes(media[:-188]))


def test_stored_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS media", "1 AS n_bytes")
    rows = {r["doc_id"]: r for r in transport_stream.read(transport_stream.store(df)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = transport_stream.padded((text or "").encode())
        r = rows[i]
        assert len(raw) % 64 == 0 and len(raw) > 0 and r["n_bytes"] == len((text or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert rows[2][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
    assert transport_stream.read(transport_stream.store(df.limit(0))).collect() == []


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 700])
def test_archives(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    rng = random.Random(2)
    html = ["", None, "same", "same", "<p>x</p>\r\n\r\nWARC/1.0\r\n", "ü" * 3000] + [f"p{rng.randrange(9)}" for _ in range(60)]
    urls = [None, "http://A.example/x y\n", "https://www.a.example:443/x?q=1#f", "//b.example:8080/", "not a url", "http://[bad"] + [f"http://s{i % 4}.example/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, h, "z") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, archive string")
    pages = pages.unionAll(pages.where("page_id = 3")).unionAll(spark.createDataFrame([(None, "u", "p1", "z")], pages.schema))
    rows = warc.archive_index(pages, range_rows=10).collect()
    assert len(rows) == len(html) + 2
    top = {}
    for i, h in enumerate(html):
        top[h or ""] = i
    for r in rows:
        h = "p1" if r["page_id"] is None else html[r["page_id"]] or ""
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        kind = "response" if r["page_id"] == top[h] else "revisit"
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(h.encode()), sha, kind, None if kind == "response" else top[h])
    order = [(r["url_key"], r["captured"]) for r in sorted(rows, key=lambda r: (r["range_no"], r["range_pos"]))]
    assert order == sorted(order)
    assert warc.archive_index(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), j) for j in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree([iter([((x,), x) for x in r]) for r in runs])) == sorted(x for r in runs for x in r)


def test_flow_is_a_ring_walked_key_by_key():
    rng = random.Random(6)
    for _ in range(30):
        shards = rng.randrange(1, 6)
        owners = ring.np.asarray([rng.randrange(shards) for _ in range(12)] + list(range(shards)))
        counts = {(a, p): rng.randrange(9) for a in range(len(owners)) for p in range(2)}
        room = ring.capacities(sum(counts.values()), shards)
        placed, left, slots = ring.flow(counts, owners, room), list(room), [0] * shards
        for (arc, part), n in sorted(counts.items()):
            for rank in range(n):
                at = arc
                while not left[owners[at % len(owners)]]:
                    at += 1
                shard = int(owners[at % len(owners)])
                left[shard] -= 1
                first, to, slot = next(p for p in reversed(placed[arc, part]) if p[0] <= rank)
                assert (to, slot + rank - first) == (shard, slots[shard])
                slots[shard] += 1


def test_names_of_other_columns_are_free(spark):
    own = ["_arc", "_hash", "_key", "_part", "_rank", "_before", "_n", "_parts", "_spread", "_order", "_digest", "_kept", "_first", "_sha", "_ord", "_row", "_fp", "_component", "_none"]
    line = "this line is quite long and stands in several of the documents here"
    docs = spark.createDataFrame([(k, f"{line} {(k or 0) % 3}", *range(len(own))) for k in (1, 2, 2, 5, None, None, (1 << 63) - 1)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in own))
    same = lambda df: all(tuple(r[c] for c in own) == tuple(range(len(own))) for r in df.collect())
    assert same(ring.assign(docs, 3)) and same(packing.pack_pieces(docs.withColumn("length", F.lit(2000))))
    assert same(substrings.remove_repeats(docs)) and same(simhash.keep_representatives(docs)) and same(decontamination.drop_hits(docs, docs.selectExpr("doc_id AS item_id", "'none of it' AS text"), most_bytes=0))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in substrings.repeated_bytes(docs).where("doc_id IS NOT NULL").collect())[-1] == (False, (1 << 63) - 1)
    none = docs.limit(0)
    assert not ring.assign(none, 3).count() and not substrings.remove_repeats(none).count() and not simhash.keep_representatives(none).count()
    assert not decontamination.drop_hits(none, none.selectExpr("doc_id AS item_id", "text")).count() and not transport_stream.read(transport_stream.store(none)).count()


def test_long_payloads(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "ä" * 900_000), (2, "http://a.example/", "ä" * 900_000), (3, None, "<p>" * 700_000)], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_index(pages).collect()}
    assert rows == {1: (1_800_000, "revisit", 2), 2: (1_800_000, "response", None), 3: (2_100_000, "response", None)}


def test_link_marks_of_many_links(spark):
    links = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    a, b = (tuple(df.agg(*link_mark()).first()) for df in (links, links.where("a <> 12345")))
    assert a[0] == 20_000_000 and a != b


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/A?b#c") == "org,example)/a?b"
    assert warc.url_key("http://example.org") == "org,example)/"


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 1000])
def test_rows_law(spark, n):
    df = spark.createDataFrame([(i if i % 10 else None, f"t{i % 5}", "old") for i in range(n)], "doc_id long, text string, shard string")
    rows = ring.assign(df, 24).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(24)]
    assert len(rows) == n and max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_overflow_continues_clockwise():
    owners = ring.np.asarray([0, 1, 2])
    placed = ring.flow({(0, 0): 5, (1, 0): 1, (2, 0): 0}, owners, [2, 2, 2])
    assert placed[0, 0] == [(0, 0, 0), (2, 1, 0), (4, 2, 0)] and placed[1, 0] == [(0, 2, 1)]
    with pytest.raises(ValueError):
        ring.flow({(0, 0): 7}, owners, [2, 2, 2])


def test_one_more_shard_moves_few_keys(spark):
    df = spark.range(6000).selectExpr("id AS doc_id")
    before = {r["doc_id"]: r["shard"] for r in ring.assign(df, 8, slack=0.25).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.assign(df, 9, slack=0.25).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.3 * 6000
    assert max(sum(s == k for s in after.values()) for k in range(9)) <= 1.25 * -(-6000 // 9)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "nobody owns these words at all in here today ok"), (10, "One TWO three four five six seven eight nine ten"), (5, "ünïcode wörds")]
DOCS = ["x one two three four five six seven eight nine TEN eleven y", "a short-item b short item", None, "", "!!", "one two three four five six seven eight nine", "Ünïcode wörds ünïcode wörds", "short " * 2000 + "item", "nobody owns these words at all in here today ok then", "word " * 20_000]


@pytest.mark.parametrize("most", [decontamination.MOST_BYTES, 0])
def test_hits_match_brute_force(spark, most):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(DOCS)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.find_hits(docs, bench, most_bytes=most).collect()}
    assert len(rows) == len(DOCS)
    for i, text in enumerate(DOCS):
        n, hit, items = brute.hits(text, [("" if k is None else k, t) for k, t in ITEMS])
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"]) == (n, hit, items), i
    assert rows[1]["clean_text"] == "a  b " and rows[5]["clean_text"] == DOCS[5]
    none = decontamination.find_hits(docs, bench.limit(0), most_bytes=most).collect()
    assert sum(r["n_hit"] for r in none) == 0 and len(none) == len(DOCS)
    assert decontamination.find_hits(docs.limit(0), bench, most_bytes=most).collect() == []


def test_contaminated_documents_go(spark, monkeypatch):
    import folia.llm.stages as stages

    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(stages, "table", lambda *a: bench)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(DOCS)], "doc_id long, text string, n_hit int")
    want = [i for i, t in enumerate(DOCS) if not brute.hits(t, ITEMS)[1]]
    kept = drop_contaminated(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert sorted(r["doc_id"] for r in decontamination.drop_hits(docs, bench, most_bytes=0).collect()) == want
    same = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "n_hit")
    for most in (decontamination.MOST_BYTES, 0):
        assert decontamination.drop_hits(same, bench, most_bytes=most).count() == len(want)
