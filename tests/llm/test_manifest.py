"""Merkle manifest: every leaf, proof and root against a tree built in plain Python."""

import hashlib
import random
from itertools import accumulate

import pytest

from pyspark.sql import functions as F

from folia.llm.manifest import leaf_of, manifest, proof_digest, verified


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """(root, proof of each node)."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for i in members[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest(*run))
            held.append(sum(members[a : a + arity], []))
        nodes, members = up, held
    return nodes[0], paths


def brute(rows, arity=3):
    """Sorted (leaf, subroot, root, proof) of rows (doc_id, source, text)."""
    groups = {}
    for d, s, t in rows:
        groups.setdefault(s, []).append(((d is not None, d or 0), leaf(d, s, t)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x for _, x in sorted(groups[s])], arity) for s in order]
    root, over = tree([t[0] for t in trees], arity)
    return sorted((x, sub, root, own + top) for s, (sub, paths), top in zip(order, trees, over, strict=True) for (_, x), own in zip(sorted(groups[s]), paths, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, leaf string, _key int")


def found(df, **how):
    rows = manifest(df, ["doc_id", "source", "text"], "source", "doc_id", **how).collect()
    return sorted((r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in rows)


@pytest.mark.parametrize("sizes,levels", [((1,), 7), ((4,), 1), ((1, 1), 2), ((3, 1, 10), 1), ((9, 27, 28, 2), 2), ((70, 1, 2, 5), 7)])
def test_trees_of_all_sizes(spark, sizes, levels):
    ends = list(accumulate(sizes))
    rows = [(i * 7 % 1009, f"s{k}", f"t{i}") for k, (n, end) in enumerate(zip(sizes, ends, strict=True)) for i in range(end - n, end)]
    assert found(frame(spark, rows).repartition(3), levels=levels) == brute(rows)


def test_nulls_ties_empty_and_long_texts(spark):
    rows = [(None, None, None), (None, "", ""), (1, "=", "ü" * 70_000), (1, "=", "b"), (1, "=", "b"), (2, "=", None), (3, "é", "a"), (3, "z", "-"), (2**63 - 1, "z", "\n"), (-5, "z", "x")]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, rows), arity=2, levels=2) == brute(rows, arity=2)
    assert found(frame(spark, rows).limit(0)) == []


def test_a_hot_group_of_several_blocks(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else f"s{rng.randrange(40)}", "t") for i in rng.sample(range(10**6), 4500)]
    assert found(frame(spark, rows)) == brute(rows)


def test_tampering_is_found(spark):
    rows = [(i, f"s{i % 3}", f"a\nb{i}" if i % 2 else None) for i in range(50)]
    df = frame(spark, rows).withColumn("now", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    kept = df.withColumn("other", leaf_of("doc_id", "source", "now"))
    out = verified(manifest(kept, ["doc_id", "source", "text"], "source", "doc_id", keep=("other",)), F.col("other")).withColumn("p", proof_digest(F.col("proof"))).collect()
    assert len(out) == 50
    for r in out:
        assert r["verified"] == (r["doc_id"] % 5 != 0 or r["doc_id"] % 2 == 0)
        assert (r["folded_root"] == r["root"]) == r["verified"]
        assert r["p"] == digest(*("".join(s) for s in r["proof"]))
    lone = manifest(kept.where("doc_id = 1"), ["text"], "source", "doc_id").withColumn("p", proof_digest(F.col("proof"))).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["p"] == digest()
