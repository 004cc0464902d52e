"""Index upkeep: search over base and deltas equals search over a fresh index, whatever the edits; ranks by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import text_index as ix

KIND, CHANGES = "doc_id long, text string", "doc_id long, text string, deleted boolean"
WORDS = "plazo plazos notificación notificado juez tribunal la de costas 12".split()


def brute(texts, query, config, k):
    """Minimal covers of all terms by trying every stretch."""
    wanted = {x for x, _ in ix.lexemes(query, config)}
    out = []
    for i, text in texts.items():
        places = sorted((p, x) for x, p in ix.lexemes(text, config) if x in wanted)
        holds = lambda a, b: {x for _, x in places[a : b + 1]} == wanted  # noqa: B023,E731
        covers = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if holds(a, b) and not (b > a and (holds(a + 1, b) or holds(a, b - 1)))]
        if covers and wanted:
            out.append((i, round(sum(ix.WEIGHT / (1 + (places[b][0] - places[a][0]) - (b - a)) for a, b in covers), 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def found(spark, path, query, k=50):
    return [tuple(r) for r in ix.search(spark, path, query, k).collect()]


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def prose(rng):
    return rng.choice((None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25)))))


QUERIES = ("plazo", "notificación del plazo", "juez tribunal costas", "12", "de la", "", "nada")


@pytest.mark.parametrize("config", ["spanish", "simple"])
def test_random_edits(spark, tmp_path, config):
    rng, path = random.Random(7), f"file://{tmp_path}/index"
    texts = {i: prose(rng) for i in range(60)}
    ix.create(spark.createDataFrame(list(texts.items()), KIND), path, config)
    for turn in range(4):
        edits = {rng.randrange(90): (prose(rng), rng.random() < 0.3) for _ in range(15)}
        ix.apply(spark.createDataFrame([(i, t, gone) for i, (t, gone) in edits.items()], CHANGES), path)
        for i, (t, gone) in edits.items():
            texts.pop(i, None)
            if not gone:
                texts[i] = t
        if turn == 2:
            ix.compact(spark, path)
            ix.vacuum(spark, path)
            assert len(ix.live(ix.log(spark, path))) == 1
        if turn in (1, 2, 3):
            for query in QUERIES:
                same(found(spark, path, query), brute(texts, query, config, 50))
    fresh = f"file://{tmp_path}/fresh"
    ix.create(spark.createDataFrame(list(texts.items()), KIND), fresh, config)
    for query in QUERIES:
        assert found(spark, fresh, query) == found(spark, path, query)
    scope = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "doc_id long")
    assert [tuple(r) for r in ix.search(spark, path, "plazo", 50, scope).collect()] == [r for r in found(spark, path, "plazo") if r[0] % 2 == 0]


def test_deletions_repeats_and_missing_ids(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ix.create(spark.createDataFrame([(1, "plazo"), (1, "juez"), (None, "plazo"), (2, "plazo plazo"), (3, "juez")], KIND), path, "simple")
    with pytest.raises(FileExistsError):
        ix.create(spark.createDataFrame([], KIND), path)
    assert found(spark, path, "plazo") == [(2, 0.2), (1, 0.1)] and [i for i, _ in found(spark, path, "plazo juez")] == [1]
    ix.apply(spark.createDataFrame([(2, "juez", False), (2, None, True), (None, "plazo", False), (9, "plazo", None)], CHANGES), path)
    assert found(spark, path, "plazo") == [(1, 0.1), (9, 0.1)] and found(spark, path, "juez") == [(1, 0.1), (3, 0.1)]
    ix.apply(spark.createDataFrame([], CHANGES), path)
    assert found(spark, path, "plazo") == [(1, 0.1), (9, 0.1)]


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ix.create(spark.createDataFrame([(1, "plazo")], KIND), path, "simple")
    spark.createDataFrame([("plazo", 2, [1], 0)], "lexeme string, doc_id long, positions array<int>, part int").write.parquet(f"{path}/postings/segment=1")
    assert found(spark, path, "plazo") == [(1, 0.1)]
    ix.apply(spark.createDataFrame([(3, "plazo", False)], CHANGES), path)
    assert found(spark, path, "plazo") == [(1, 0.1), (3, 0.1)]


def test_only_the_parts_of_the_query_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ix.create(spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(40))) for i in range(30)], KIND), path, "simple")
    files = {f.rsplit("part=", 1)[1].split("/")[0] for f in ix._rows(spark, path, ["w3", "w7"]).where("true").inputFiles()}
    plan = ix.search(spark, path, "w3 w7", 5)._jdf.queryExecution().executedPlan().toString()
    assert len(files) > 10 and "PartitionFilters: [part" in plan and "PushedFilters: [In(lexeme" in plan
    assert [i for i, _ in found(spark, path, "w3 w7")] == [0, 1, 2, 3]


def test_a_stream_keeps_it_and_replays_change_nothing(spark, tmp_path):
    path, source = f"file://{tmp_path}/index", f"file://{tmp_path}/in"
    ix.create(spark.createDataFrame([(1, "plazo")], KIND), path, "simple")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CHANGES).parquet(source)
    for k, rows in enumerate(([(2, "plazo", False)], [(1, None, True), (3, "plazo juez", False)])):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        ix.maintain(stream, path, f"file://{tmp_path}/c").awaitTermination()
        assert len(ix.log(spark, path)) == k + 2
    assert found(spark, path, "plazo") == [(2, 0.1), (3, 0.1)]
    ix.maintain(stream, path, f"file://{tmp_path}/again").awaitTermination()  # a lost checkpoint gives the batches anew
    assert [s.token for s in ix.log(spark, path)] == ["create", "stream.0", "stream.1"]
    assert found(spark, path, "plazo") == [(2, 0.1), (3, 0.1)]


def test_postings_are_made_once(spark, tmp_path):
    from folia.operators import text_index as index

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.range(40).selectExpr("id AS doc_id", "concat('uno dos ', id) AS text").repartition(4)
    index.create(docs.mapInArrow(count, docs.schema), f"file://{tmp_path}/i", "simple")
    assert seen.value == 40
    assert [r["doc_id"] for r in index.search(spark, f"file://{tmp_path}/i", "uno 17", 9).collect()] == [17]
