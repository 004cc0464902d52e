"""The cache: keys against the plain fold, and hit, miss, expired and invalidated entries."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folia.operators import cache


def plain(text):
    raw, h = text.encode("utf-16-le", "surrogatepass"), 0
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2], "little")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


@settings(max_examples=200)
@given(st.text(max_size=200))
def test_rolling_hash(text):
    assert cache.rolling(text) == plain(text)
    assert int(cache.base36(plain(text)), 36) == plain(text)


def test_known_hashes():
    assert (cache.rolling(""), cache.rolling("hello"), cache.rolling("😀" * 3000)) == (0, 99162322, plain("😀" * 3000))
    assert (cache.base36(0), cache.base36(-1), cache.base36(99162322)) == ("0", "-1", "1n1e4y")


ASK = "request_id long, model string, prompt string, case_id long"


def run(spark, path, rows, now):
    make = lambda df: df.withColumn("value", F.concat("model", F.lit(":"), F.substring("prompt", 1, 1), F.lit("@"), F.lit(now)))
    return {r["request_id"]: (r["status"], r["value"]) for r in cache.serve(spark.createDataFrame(rows, ASK), path, now, make).collect()}


def test_entries_over_time(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    a, b, c, short = "a" * 4093, "b" * 5000, "c" * 5000, "s" * 4092
    t = lambda minute: f"2024-01-01 10:{minute:02d}:00"
    assert run(spark, path, [(2, "m", a, 1), (1, "m", a, 2), (3, "n", a, 1), (4, "m", short, 1), (5, "m", None, 1)], t(0)) == {
        1: ("miss", f"m:a@{t(0)}"), 2: ("shared", f"m:a@{t(0)}"), 3: ("miss", f"n:a@{t(0)}"), 4: ("short", None), 5: ("short", None)}
    assert run(spark, path, [(1, "m", a, 1), (2, "m", b, 1), (3, "m", c, 3)], t(29)) == {1: ("hit", f"m:a@{t(0)}"), 2: ("miss", f"m:b@{t(29)}"), 3: ("miss", f"m:c@{t(29)}")}
    cache.invalidate(spark, path, spark.createDataFrame([(3,), (99,)], "case_id long"))
    assert run(spark, path, [(1, "m", a, 1), (2, "m", b, 1), (3, "m", c, 1), (4, "n", b, 1)], t(30)) == {
        1: ("expired", f"m:a@{t(30)}"), 2: ("hit", f"m:b@{t(29)}"), 3: ("miss", f"m:c@{t(30)}"), 4: ("miss", f"n:b@{t(30)}")}
    before = sorted(map(tuple, cache.entries(spark, path).where("expires > '2024-01-01 10:59:30'").collect()))
    cache.sweep(spark, path, "2024-01-01 10:59:30")
    assert sorted(map(tuple, cache.entries(spark, path).collect())) == before and len(before) == 3
    assert run(spark, path, [(1, "m", b, 1)], t(59)) == {1: ("miss", f"m:b@{t(59)}")}
    assert run(spark, path, [], t(59)) == {}


def test_prompts_of_one_hash(spark, tmp_path):
    path, tail = f"file://{tmp_path}/cache", "x" * 5000
    one, two = "Aa" + tail, "BB" + tail
    assert cache.rolling(one) == cache.rolling(two)
    now = "2024-01-01 10:00:00"
    assert {s for s, _ in run(spark, path, [(1, "m", one, 1), (2, "m", two, 1)], now).values()} == {"miss"}
    again = run(spark, path, [(1, "m", one, 1), (2, "m", two, 1)], now)
    assert sorted(s for s, _ in again.values()) == ["hit", "miss"] and again[1][1][2] == "A" and again[2][1][2] == "B"


def test_query_keeps_prompts_of_one_hash_apart(spark, tmp_path):
    import duckdb

    from folia import catalog

    tail = "x" * 5000
    docs = spark.createDataFrame([(3 * k, t + tail, "src1") for k, t in enumerate(("Aa", "BB", "Aa", "BB", "C", "BB"))], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["ret17_cache_over_time"](spark, f"file://{tmp_path}").collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()["ret17_cache_over_time"]).fetchall())


def test_keys_are_made_without_python(spark):
    texts = ["", "hello", "😀" * 3000, "ñ" * 4093, None, "Aa", "BB"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", cache.prompt_hash(F.col("t")).alias("h"))
    assert {r["k"]: r["h"] for r in rows.collect()} == {k: None if t is None else cache.base36(cache.rolling(t)) for k, t in enumerate(texts)}
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
