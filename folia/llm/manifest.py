"""Merkle manifest of a dataset: a digest tree in each group of rows, and one over the groups' roots.

Every level is made by lag and lead windows.  A node stands on the row of its first leaf, so that its
siblings are a fixed number of rows away; slot and length of its run say which of them exist, and the
row of a run's first child hashes the parent.  Windows hold a block of 3^7 leaves, in which seven levels
end exactly; the next seven are made from one row a block, so no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.llm.common import forget, fresh, written

#: Children of a node, and levels that are made in one block of rows.
ARITY, LEVELS = 3, 7


def field(name: str) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers in decimal)."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: str) -> Column:
    """Lower-case hex SHA-256 of the columns' fields one after the other."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with its proof, an array of (left, right) digests by level."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _placed(rows: DataFrame, group: str, order: list[str], at: str, total: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their place (from 0) in their group by ``order`` and the group's number of rows; the scratch table it reads.

    Ranges of the order are stored and counted; a row's place is that in its range, of one task's size,
    after the rows of the group in former ranges.
    """
    part, start = fresh([*rows.columns, at, total], "part", "start")
    keys = [group, *order]
    dealt = written(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in keys)).withColumn(part, F.spark_partition_id()), "placed")
    counts = dealt.groupBy(group, part).agg(F.count("*").alias(total))
    by_group = Window.partitionBy(group)
    counts = counts.select(
        group, part, F.coalesce(F.sum(total).over(by_group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start), F.sum(total).over(by_group).alias(total)
    )
    inside = Window.partitionBy(group, part).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    ranked = dealt.withColumn(at, F.row_number().over(inside) - 1)
    return ranked.join(counts, [group, part]).withColumn(at, (F.col(at) + F.col(start)).cast("long")).drop(part, start), dealt


def _stride(rows: DataFrame, group: str, node: str, at: str, total: str, path: str, arity: int, levels: int) -> DataFrame:
    """``rows`` with the steps of their first ``levels`` levels (``path``) and, on the first row of each block, its node (``node``)."""
    block, *own = fresh([*rows.columns, path], "block", *(f"node{k}" for k in range(1, levels + 1)), *(f"step{k}" for k in range(levels)))
    nodes, steps = [node, *own[:levels]], own[levels:]
    place, out = F.col(at), rows.withColumn(block, F.floor(F.col(at) / arity**levels))
    window = Window.partitionBy(group, block).orderBy(at)
    for k in range(levels):
        width = arity**k
        index = F.floor(place / width)
        slot, count = index % arity, F.ceil(F.col(total) / width)
        run = F.least(F.lit(arity), count - index + slot)
        here = (place % width == 0) & (count > 1)
        left = [F.when(slot >= d, F.lag(nodes[k], d * width).over(window)).otherwise("") for d in range(arity - 1, 0, -1)]
        right = [F.when(slot + d < run, F.lead(nodes[k], d * width).over(window)).otherwise("") for d in range(1, arity)]
        out = out.withColumn(steps[k], F.when(here, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        parent = F.when(count > 1, F.sha2(F.concat(F.col(nodes[k]), F.col(steps[k])["right"]), 256)).otherwise(F.col(nodes[k]))
        out = out.withColumn(nodes[k + 1], F.when(place % (width * arity) == 0, parent))
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(path, F.array_compact(F.array(*(F.last(s, ignorenulls=True).over(so_far) for s in steps))))
    return out.select(*rows.columns, path, F.when(place % arity**levels == 0, F.col(nodes[levels])).alias(own[levels - 1])).withColumnRenamed(own[levels - 1], f"{path}_top")


def _tree(rows: DataFrame, group: str, order: list[str], node: str, path: str, arity: int, levels: int) -> tuple[list[DataFrame], list[str]]:
    """A written table for each seven levels, the lowest (with the columns of ``rows``) first; names of place, total and top node."""
    at, total = fresh([*rows.columns, path, f"{path}_top"], "at", "total")
    now, dealt = _placed(rows, group, order, at, total)
    most, tables = None, []
    while most is None or most > 1:
        tables.append(written(_stride(now, group, node, at, total, path, arity, levels), "nodes"))
        most = tables[-1].agg(F.max(F.ceil(F.col(total) / arity**levels))).first()[0] or 0
        now = tables[-1].where(f"`{path}_top` IS NOT NULL").select(
            group, F.floor(F.col(at) / arity**levels).alias(at), F.ceil(F.col(total) / arity**levels).alias(total), F.col(f"{path}_top").alias(node)
        )
    forget(dealt)
    return tables, [at, total, f"{path}_top"]


def _down(tables: list[DataFrame], names: list[str], tops: DataFrame, group: str, path: str, arity: int, levels: int) -> DataFrame:
    """The lowest table with whole paths: those of ``tops`` (group, path and more) follow the own ones, table by table downwards."""
    at, total, top = names
    above, more = tops, [c for c in tops.columns if c not in (group, path)]
    up, block = fresh([*tables[0].columns, *more], "up", "block")
    keys = [group]
    for table in reversed(tables):
        own = table.drop(top).withColumn(block, F.floor(F.col(at) / arity**levels))
        above = own.join(above.withColumnRenamed(path, up), keys).withColumn(path, F.concat(path, up)).drop(up, block)
        lowest, above, keys = above, above.select(group, F.col(at).alias(block), path, *more), [group, block]
    return lowest.drop(at, total)


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, keep: tuple[str, ...] = (), arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``order``, ``keep``, ``leaf``, ``subroot``, ``root`` and ``proof`` of each row of ``docs``.

    The leaf is the digest of ``fields``; in a group (null is one, and comes first) leaves ascend by
    ``order`` (null first), equal ones by digest, so equal rows have neighbouring leaves with proofs of
    their own.  Every ``arity`` consecutive nodes become one until one is left, even where a last run
    has a single node.  Empty texts and very long ones are leaves like others, extra columns don't
    count, and an empty table gives no rows.  Names of ``keep`` may not be those of the result.
    """
    (key,) = fresh([*docs.columns, "leaf", "proof"], "key")
    leaves = docs.select(order, *keep, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias(key), leaf_of(*fields).alias("leaf"))
    stored = written(leaves, "leaves")
    tables, names = _tree(stored, key, [order, "leaf"], "leaf", "proof", arity, levels)
    roots = tables[-1].where("proof_top IS NOT NULL").select(F.lit("").alias("all"), F.col(key), F.col("proof_top").alias("subroot"))
    over, over_names = _tree(roots, "all", [key], "subroot", "proof", arity, levels)
    root = over[-1].where("proof_top IS NOT NULL").select("all", F.col("proof_top").alias("root"), F.array().cast(over[-1].schema["proof"].dataType).alias("proof"))
    groups = _down(over, over_names, root, "all", "proof", arity, levels).drop("all")
    out = written(_down(tables, names, groups, key, "proof", arity, levels).select(order, *keep, "leaf", "subroot", "root", "proof"), "manifest")
    for table in (stored, *tables, *over):
        forget(table)
    return out


def verified(proved: DataFrame, leaf: Column) -> DataFrame:
    """``proved`` with ``folded_root``, from ``leaf`` and the stored proof, and ``verified``: whether that is the root."""
    return proved.withColumn("folded_root", folded(leaf, F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
