"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups, a proof per row.

Rows get their place within their group by a range partitioning and counts per partition. Trees are climbed and
descended by superblocks of 2^BITS neighbouring nodes, so a group of any size is spread evenly: going up, each
superblock is reduced to one node, which is a leaf of the next, smaller tree. Going down, the nodes of a superblock are
cogrouped with the outer nodes that its proofs need from above; local reduction, joining of proofs and folding happen
together in that one exchange. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.sources.tables import materialise

#: levels that one superblock has; 1024 nodes are a small pandas frame
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def layers(nodes: Sequence[str], levels: int) -> list[list[str]]:
    """The nodes, and what they are reduced to level by level: `levels` times, each two neighbours to one."""
    out = [list(nodes)]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def levels_of(size: int, bits: int = BITS) -> int:
    """Levels of a superblock in a tree of `size` nodes: all of them, or up to the root if it is the only one."""
    return min(bits, (size - 1).bit_length())


def siblings(tower: Sequence[Sequence[str]], at: int) -> list[str]:
    """Steps from node `at` to the top: L or R (the side of the sibling) and the sibling; empty for a lone node."""
    steps = []
    for layer in tower[:-1]:
        other = at ^ 1
        steps.append("" if other >= len(layer) else ("L" if at & 1 else "R") + layer[other])
        at >>= 1
    return steps


def fold(node: str, steps: Sequence[str]) -> str:
    """The root that a node and its steps lead to."""
    for step in steps:
        node = digest(step[1:] + node if step[:1] == "L" else node + step[1:])
    return node


def proof(steps: Sequence[str]) -> str:
    """Digest of all siblings, level by level."""
    return digest("".join(step[1:] for step in steps))


def field(column: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def leaves(docs: DataFrame, fields: Sequence[str], group: str, order: str, altered: Mapping[str, Column]) -> DataFrame:
    """(tree, id, leaf, changed): the group as a key that orders null first, and digests of each row as it is and as
    altered (null where that is the same)."""
    plain = [F.col(f"`{f}`") for f in fields]
    other = [altered.get(f, column) for f, column in zip(fields, plain)]
    differs = F.lit(False)
    for f, column, new in zip(fields, plain, other):
        if f in altered:
            differs |= ~column.eqNullSafe(new)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    changed = F.when(differs, leaf(other)) if altered else F.lit(None).cast("string")
    return docs.select(tree.alias("tree"), F.col(f"`{order}`").alias("id"), leaf(plain).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (a written table with a column `tree`) with pos, counted from 0 within the tree in the given order, and size.

    Rows are sorted in range partitions; a place is the count of what lies in the partitions before, and the
    place within the own one. Equal rows are told apart by where they are stored, so a value that is on very many
    rows is spread over several partitions.
    """
    stored = rows.withColumn("stored", F.monotonically_increasing_id())
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("stored")]
    ranged = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged.drop("stored"), "manifest-order").withColumn("part", F.shiftright("at", 33))
    counted = ranged.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "tree", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    starts = materialise(starts, "manifest-starts")
    return ranged.join(starts, ["part", "tree"]).withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "start", "first")


def _climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables (tree, pos, size, node), from the given nodes up to one node per tree."""

    def reduced(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        size = int(block["size"].iloc[0])
        (top,) = layers(block["node"].tolist(), levels_of(size, bits))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [max(1, -(-size >> bits))], "node": [top]})

    towers = [nodes.select("tree", "pos", "size", "node")]
    while (towers[-1].agg(F.max("size")).first()[0] or 1) > 1:
        blocks = towers[-1].groupBy("tree", F.shiftright("pos", bits).alias("block"))
        towers.append(materialise(blocks.applyInPandas(reduced, "tree string, pos long, size long, node string"), "manifest-nodes"))
    return towers


def _exchange(inner: DataFrame, outer: DataFrame, bits: int, each, schema: str) -> DataFrame:
    """Nodes cogrouped by superblock with the outer row (steps, subroot, root) that their superblock has from above."""

    def joined(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", ignore_index=True)
        tower = layers(block["node"].tolist(), levels_of(int(block["size"].iloc[0]), bits))
        steps, subroot, root = above["steps"].iloc[0], above["subroot"].iloc[0], above["root"].iloc[0]
        return each(block, [siblings(tower, i) + list(steps) for i in range(len(block))], subroot, root)

    blocks = inner.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")
    return blocks.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(joined, schema)


def _descend(towers: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, steps, subroot, root) of the nodes of the lowest of `towers`, from those one table above the highest."""

    def handed(block: pd.DataFrame, steps: list[list[str]], subroot: str, root: str) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "steps": steps, "subroot": subroot, "root": root})

    for inner in reversed(towers):
        outer = materialise(_exchange(inner, outer, bits, handed, "tree string, pos long, steps array<string>, subroot string, root string"), "manifest-outer")
    return outer


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
    with_steps: bool = False,
    bits: int = BITS,
) -> DataFrame:
    """(order column, leaf, subroot, root, proof_sha256, folded_root, verified[, steps]): one row per row of docs.

    A leaf is the digest of the fields. Leaves of a group ascend by the order column, nulls first, equal ids by their
    leaf; two neighbours at a time are reduced until one node is left, the subroot (a lone leaf itself). Subroots
    in the order of the groups, null first, else by UTF-8 bytes, give the root in the same way. steps are the
    siblings with their side, from the leaf to the root, and proof_sha256 is the digest of the siblings. folded_root is
    what the steps lead to from the leaf of the row with `altered` values (column expressions by field), from the
    leaf itself if they don't differ; verified tells whether that is the root.

    Rows are never merged: repeated rows are leaves of their own. Null and empty texts differ (`-` and `0:`). An
    empty table gives an empty result. Other columns are left out.
    """
    kind = docs.schema[order].dataType
    rows = materialise(leaves(docs, fields, group, order, altered or {}), "manifest-leaves")
    lowest = placed(rows, ["id", "leaf"]).withColumn("node", F.col("leaf"))
    towers = _climb(lowest, bits)

    subroots = placed(towers[-1].select(F.col("tree").alias("key"), "node", F.lit("").alias("tree")), ["key"])
    over = _climb(subroots, bits)
    top = over[-1].select("tree", "pos", F.array().cast("array<string>").alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    above = _descend(over[:-1], top, bits).select("pos", "steps", "root").join(subroots.select("pos", "key", "node"), "pos")
    outer = above.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", F.col("node").alias("subroot"), "root")
    outer = _descend(towers[1:-1], outer, bits)

    def finished(block: pd.DataFrame, steps: list[list[str]], subroot: str, root: str) -> pd.DataFrame:
        given = [c if isinstance(c, str) else x for x, c in zip(block["leaf"], block["changed"])]
        folded = [fold(node, way) for node, way in zip(given, steps)]
        out = {"id": block["id"], "leaf": block["leaf"], "subroot": subroot, "root": root, "proof_sha256": [proof(way) for way in steps]}
        out |= {"folded_root": folded, "verified": [f == root for f in folded]}
        return pd.DataFrame(out | ({"steps": steps} if with_steps else {}))

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", steps array<string>" * with_steps
    proven = _exchange(lowest.withColumn("id", F.col("id").cast("string")), outer, bits, finished, schema)
    return proven.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", order)
