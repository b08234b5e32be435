"""Connected components of a link table, by large-star and small-star rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.sources.tables import materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of one partition by a star per component: no link is lost, copies of links are."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = [x for x in parent if root(x) != x]
    for at in range(0, len(members), 100_000):
        part = members[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root): every node of `links` (two long columns) that is not the smallest of its component.

    root is the smallest node of the component. Links with a null end and links of a node to itself
    are ignored; repeated links count once; an empty table gives an empty result. Each round joins a
    node with the smallest of its neighbours, so a node with very many neighbours is only counted
    map-side and split by the join. Every round is written to the shared folder, which cuts lineage.
    """
    a, b = links.columns[:2]
    given = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # written first: a task that finds links in Python and thins them in Python would need two workers at once
    stars = materialise(materialise(given, "links").mapInArrow(_forest, "a long, b long"), "links")
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
