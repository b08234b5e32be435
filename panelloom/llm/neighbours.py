"""Near-duplicate embeddings: a navigable small-world graph per shard, queried by every vector."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.components import connected
from panelloom.llm.hnsw import Graph
from panelloom.sources.tables import materialise

#: float32 products of unit vectors are off by less than this, so nothing within reach is lost before the exact check
SLACK = 1e-4
#: links of one row that are held for comparison with those found from the other ends
HELD = 128
NODE = "dim int, shard int, pos int, node long, copies long, vector binary, links binary, own_links long, local_root long"
FOUND = "node long, n_links long, roots array<bigint>"


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Shard:
    """A graph with the exact vectors, and links found through it and verified in double precision."""

    def __init__(self, exact: np.ndarray, graph: Graph, least: float, beam: int, recall: float, audit: int):
        self.exact, self.graph, self.least, self.beam, self.recall, self.audit = exact, graph, least, beam, recall, audit

    def links(self, exact: np.ndarray, own: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """Query number and the nodes linked with it, block by block; own: query i is node i and no link of itself.
        The queries of a block are classed by the number of links found: none, 1 to 3, 4 to 15 and so on. Up to
        `audit` of each class are scanned in full; if in any class they have found less than `recall` of their
        links, or of each query's links on average, the whole block is searched again with beams twice as wide,
        at last by a scan."""
        for at in range(0, len(exact), 4096):
            block = exact[at : at + 4096]
            single, beam = block.astype(np.float32), self.beam
            while True:
                found = [self._verified(block[i], near, at + i if own else -1) for i, near in enumerate(self.graph.within(single, self.least - SLACK, beam))]
                if beam * 4 >= len(self.exact) or self._enough(block, single, found, at if own else None):
                    break
                beam *= 2
            for i, near in enumerate(found):
                if len(near):
                    yield at + i, near

    def all_links(self, exact: np.ndarray, asked: np.ndarray, own: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """The same for the queries numbered by `asked`, by scans that miss none."""
        for at in range(0, len(asked), 4096):
            part = asked[at : at + 4096]
            for i, near in zip(part, self.graph.scan(exact[part].astype(np.float32), self.least - SLACK)):
                yield int(i), self._verified(exact[i], near, i if own else -1)

    def _verified(self, query: np.ndarray, near: np.ndarray, but: int) -> np.ndarray:
        near = near[near != but].astype(np.int64)
        return near[self.exact[near] @ query >= self.least] if len(near) else near

    def _enough(self, block: np.ndarray, single: np.ndarray, found: list[np.ndarray], first: int | None) -> bool:
        kinds = np.array([(len(f).bit_length() + 1) // 2 for f in found])
        for kind in np.unique(kinds):
            of = np.flatnonzero(kinds == kind)
            sample = of[:: max(1, len(of) // self.audit)][: self.audit]
            scanned = self.graph.scan(single[sample], self.least - SLACK)
            whole = np.array([len(self._verified(block[i], near, -1 if first is None else first + i)) for i, near in zip(sample, scanned)])
            got = np.array([len(found[i]) for i in sample])
            if got.sum() < self.recall * whole.sum() or np.where(whole > 0, got / np.maximum(whole, 1), 1).mean() < self.recall:
                return False
        return True


Met = Callable[[int, np.ndarray], None]


def _asked(exact: np.ndarray, shard: Shard, met: Met, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links found by queries with at most HELD, as query * rows of the shard + node, and which queries found more."""
    keys, many = [np.empty(0, np.int64)], np.zeros(len(exact), bool)
    for i, near in shard.links(exact, own):
        if len(near) > HELD:
            many[i] = True
        else:
            met(i, near)
            keys.append(i * len(shard.exact) + near)
    return np.concatenate(keys), many


def _counts(a: Shard, b: Shard, copies: tuple[np.ndarray, np.ndarray], met: tuple[Met, Met]) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a the copies of its links in b, and the reverse; each link counts at both ends, from whichever end it
    was found. At most HELD links of a row are held; rows with more are scanned, so that they miss none, and are
    counted at once at the other ends that missed them. met gets what each row of a, and of b, has found."""
    own, shards = a is b, (a, b)
    first = _asked(a.exact, b, met[0], own)
    found = (first, first if own else _asked(b.exact, a, met[1], own))
    n, out = (len(a.exact), len(b.exact)), []
    for x in (0, 1):
        y = 1 - x
        (mine, many), (theirs, _) = found[x], found[y]
        other, row = np.divmod(theirs, n[x])
        pairs = np.union1d(mine, (row * n[y] + other)[~many[row]])
        count = np.zeros(n[x], np.int64)
        np.add.at(count, pairs // n[y], copies[y][pairs % n[y]])
        out.append(count)
    for x in (0,) if own else (0, 1):
        y = 1 - x
        theirs, many = np.sort(found[y][0]), found[y][1]
        for i, near in shards[y].all_links(shards[x].exact, np.flatnonzero(found[x][1]), own):
            met[x](i, near)
            out[x][i] = copies[y][near].sum()
            rest = near[~many[near]]
            keys = rest * n[x] + i
            at = np.searchsorted(theirs, keys)
            known = np.zeros(len(rest), bool)
            known[at < len(theirs)] = theirs[at[at < len(theirs)]] == keys[at < len(theirs)]
            out[0 if own else y][rest[~known]] += copies[x][i]
    return out[0], out[1]


def _sizes(n: int) -> list[int]:
    return Graph.layers(n, 12)


def _build(least: float, beam: int, recall: float, audit: int):
    def each(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        nodes, copies = (shard.column(c).to_numpy() for c in ("node", "copies"))
        dim = key[0].as_py()
        order = np.lexsort((nodes, (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))  # a fixed random order
        nodes, copies = nodes[order], copies[order]
        raw = pa.concat_arrays(shard.column("vector").chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
        exact = _unit(raw)
        graph = Graph.build(exact.astype(np.float32), 12)
        parent = np.arange(len(nodes))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def met(i: int, near: np.ndarray) -> None:
            roots = {root(j) for j in (i, *near[parent[near] != parent[i]])}
            first = min(roots, key=nodes.__getitem__)
            for j in roots:
                parent[j] = first

        shard = Shard(exact, graph, least, beam, recall, audit)
        own, _ = _counts(shard, shard, (copies, copies), (met, met))
        n = len(nodes)
        packed = [b"".join(layer[i].astype("<i4").tobytes() for layer in graph.links if i < len(layer)) for i in range(n)]
        widths = [layer.shape[1] for layer in graph.links]
        return pa.table([
            pa.array([dim] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(nodes, pa.int64()), pa.array(copies, pa.int64()),
            pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([np.int32(widths[0]).tobytes() + x for x in packed], pa.binary()), pa.array(own), pa.array([nodes[root(i)] for i in range(n)], pa.int64()),
        ], [x.split()[0] for x in NODE.split(", ")])

    return each


def _restore(raw: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, Graph]:
    """The exact unit vectors and the graph of a shard from its rows in order."""
    sizes, exact = _sizes(len(raw)), _unit(raw)
    width = int(np.frombuffer(packed[0], np.int32, 1)[0])
    links = [np.full((sizes[0], width), -1, np.int32), *(np.full((s, 24), -1, np.int32) for s in sizes[1:])]
    for i, data in enumerate(packed):
        flat = np.frombuffer(data, np.int32)[1:]
        links[0][i] = flat[:width]
        for layer in range(1, len(sizes)):
            if i >= sizes[layer]:
                break
            links[layer][i] = flat[width + 24 * (layer - 1) : width + 24 * layer]
    return exact, Graph(exact.astype(np.float32), sizes, links)


def _across(least: float, beam: int, recall: float, audit: int):
    """Of the rows of two shards, the links between them and the components that each row met in the other shard."""

    def each(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, nodes, copies, roots, shards = key[0].as_py(), [], [], [], []
        for number in key[1:]:
            part = rows.filter(pc.equal(rows.column("shard"), number)).sort_by("pos")
            if not part.num_rows:  # no row of this length has that shard
                return pa.table([[], [], []], pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("roots", pa.list_(pa.int64()))]))
            raw = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            exact, graph = _restore(raw, part.column("links").to_pylist())
            shards.append(Shard(exact, graph, least, beam, recall, audit))
            for to, name in ((nodes, "node"), (copies, "copies"), (roots, "local_root")):
                to.append(part.column(name).to_numpy())
        met: list[dict[int, np.ndarray]] = [{}, {}]
        meet = [lambda i, near, x=x: met[x].__setitem__(i, np.unique(roots[1 - x][near])) for x in (0, 1)]
        counts = _counts(shards[0], shards[1], (copies[0], copies[1]), (meet[0], meet[1]))
        out = [(nodes[x][i], counts[x][i], met[x].get(i, ())) for x in (0, 1) for i in np.flatnonzero(counts[x])]
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["node", "n_links", "roots"])

    return each


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, beam: int = 32, recall: float = 0.99, audit: int = 50, least_shards: int = 8, shard_rows: int = 250_000, block_rows: int = 250_000
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    Rows link if the cosine of their vectors, in double precision, is at least `least`. Equal vectors are one
    node. Nodes are dealt to shards by a hash; each shard builds its graph, and every node queries every
    shard, two shards at a time. Only a count and the components that it meets there leave a query, never all
    pairs. A shard has at most about shard_rows and block_rows rows, so their number grows with the table.
    Beams widen per query while their worst result still links, and per block until an audit against a full
    scan finds `recall` of the links of queries with none, with few and with many alike; what is counted was
    verified exactly, and a link that only one end found counts at both.

    Null vectors, those of no length, or with null, NaN or infinite components link with nothing, and only
    vectors of one length link. A row with a null id links with nothing and gets a null component and kept
    null. Rows that repeat an id are linked as rows: their vectors may differ. Empty tables give no rows.
    """
    number = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(number, lambda x: x + F.lit(0.0)).alias("vector")).withColumn("good", good)
    rows = materialise(rows.withColumn("vector", F.when(F.col("good"), F.col("vector"))), "vectors")
    grouped = rows.where("good").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # ids may repeat, so a node is numbered by itself; order and component names follow the smallest id
    numbered = materialise(grouped.withColumn("least", F.col("node")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n = numbered.count()
    shards = max(least_shards, math.ceil(n / min(shard_rows, block_rows)))
    keyed = numbered.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "copies", "vector")
    built = materialise(keyed.groupBy("dim", "shard").applyInArrow(_build(least, beam, recall, audit), NODE), "vector-graphs")

    # every shard meets every other one in a task of that pair, where both ask
    pair = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard")))
    asked = built.withColumn("other", pair).withColumns({"a": F.least("shard", "other"), "b": F.greatest("shard", "other")}).drop("other", "own_links")
    dealt = asked.repartition(max(1, shards * (shards - 1) // 2), "dim", "a", "b")
    found = materialise(dealt.groupBy("dim", "a", "b").applyInArrow(_across(least, beam, recall, audit), FOUND), "vector-links")

    stars = connected(built.select("node", "local_root").union(found.select("node", F.explode("roots"))))
    far = found.groupBy("node").agg(F.sum("n_links").alias("far"))
    total = F.col("copies") - 1 + F.col("own_links") + F.coalesce("far", F.lit(0))
    linked = built.select("node", "copies", "own_links").join(far, "node", "left").select("node", total.alias("n_links"))
    placed = linked.join(stars, "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root")).join(numbered.select("node", "least", "vector"), "node")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("vector", "n_links", "component_id")
    out = rows.join(named, "vector", "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
