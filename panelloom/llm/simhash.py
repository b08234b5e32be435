"""SimHash near-duplicates: fingerprints, links found through a popcount embedding, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelloom.llm.batches import pieces
from panelloom.llm.components import connected
from panelloom.sources.tables import materialise

SEED = 42
STEP = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the XXH64 of all `width`-word shingles of a text in UTF-8; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp), and the long columns `extra`: the fingerprint of every row's whole text as a signed long.

    A null text counts as empty; empty texts have fingerprint 0. Rows with a null id or a repeated id
    stay rows of their own. Other columns of docs are left out, so no name can clash.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *extra])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    return given.mapInArrow(each, ", ".join(f"{c} long" for c in ("doc_id", "fp", *extra)))


def embedding(fp):
    """Popcounts (0 to 2) of the 32 two-bit segments, each written in unary in its two bits.

    Written so, the Manhattan distance of two embeddings is the number of differing bits, and it is
    never more than the Hamming distance of the fingerprints.
    """
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _masks(blocks: int, distance: int) -> list[int]:
    """Of `blocks` runs of segments, at most `distance` differ between near embeddings: every choice of
    the others, as bits of the embedding to keep."""
    edges = [2 * round(32 * i / blocks) for i in range(blocks + 1)]
    runs = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(runs, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _spanning(cell: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (member, first member) that join what is within `distance` bits, directly or over others."""
    if len(cell) == 2:
        return [(cell[1], cell[0])] if (int(cell[0]) ^ int(cell[1])).bit_count() <= distance else []
    links, open_ = [], cell
    while len(open_):
        first, open_, front = open_[0], open_[1:], [open_[0]]
        while front and len(open_):
            near = np.bitwise_count(open_ ^ front.pop()) <= distance
            if near.any():
                found, open_ = open_[near], open_[~near]
                links += [(x, first) for x in found]
                front += list(found)
    return links


def _cells(distance: int):
    """Of rows (cell columns ..., fp) sorted by cell: the spanning links of each cell. One cell is held
    at a time; the caller bounds its rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def close():
            if len(held) > 1 or held and len(held[0]) > 1:
                out.extend(_spanning(np.concatenate(held), distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:-1]])
            fps = batch.columns[-1].to_numpy().view(np.uint64)
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *starts], [*starts, len(fps)]):
                if (now := tuple(keys[lo])) != key:
                    close()
                    held, key = [], now
                held.append(fps[lo:hi])
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        close()
        yield _pairs(out)

    return each


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(distinct: DataFrame, distance: int = 3, levels: Sequence[int] = (6, 12, 24), most: int = 4096) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within `distance` bits of each other.

    distinct: one long column `fp` without repeats. Each fingerprint goes to the grid cells of all
    projections of its embedding onto all but `distance` of levels[0] blocks, so near embeddings share
    a cell, and members of a cell are verified on the fingerprints themselves. A cell emits a spanning
    forest, not pairs. Cells with more than `most` members go to the next level, whose finer blocks make
    more and smaller cells; what is too large at the last level is cut into tiles of pairs of blocks of
    about `most` rows. Every level is exact for the rows that reach it, so no link is lost.
    """
    found, rows = [], distinct.select("fp")
    for at, blocks in enumerate(levels):
        masks = _masks(blocks, distance)
        keyed = rows.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.posexplode(F.array(*map(F.lit, masks))).alias("k", "mask"))
        keyed = keyed.select("k", F.col("e").bitwiseAND(F.col("mask")).alias("cell"), "fp")
        sizes = materialise(keyed.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
        fit = keyed.join(sizes.where(F.col("n") <= most).drop("n"), ["k", "cell"])
        found.append(fit.repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(_cells(distance), "a long, b long"))
        large = sizes.where(F.col("n") > most)
        if not large.limit(1).count():
            return _union(found)
        if at + 1 < len(levels):
            rows = materialise(keyed.join(large.drop("n"), ["k", "cell"]).select("fp").distinct(), "cells")
    n = F.ceil(F.col("n") / most).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    tiles = keyed.join(large.select("k", "cell", n.alias("tiles")), ["k", "cell"]).select("k", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "fp")
    tiles = tiles.select("k", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    found.append(tiles.repartition("k", "cell", "x", "y").sortWithinPartitions("k", "cell", "x", "y").mapInArrow(_cells(distance), "a long, b long"))
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.union(other)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, levels: Sequence[int] = (6, 12, 24), most: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    Equal fingerprints are one node, so a large group of copies costs one row. component_id is the
    smallest id that is reachable over links of at most `distance` bits; it is null only where no row of
    the component has an id. Null and empty texts have fingerprint 0 and link like any other.
    """
    found = grouped(docs, id_col, text_col, width, distance, levels, most)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, levels: Sequence[int] = (6, 12, 24), most: int = 4096, extra: Sequence[str] = ()) -> DataFrame:
    """(fp, doc_id, root, component_id), and `extra`: the same with root, which no two components share even if an id is in both."""
    rows = materialise(fingerprints(docs, id_col, text_col, width, extra), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = connected(links(nodes, distance, levels, most))
    placed = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labels = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(labels, "root").select("fp", "root", "component_id"), "fp")
