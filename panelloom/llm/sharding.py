"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Only DataFrame and SQL functions: the matrix of counts is drawn by splitting the list of partitions
in halves, each half's counts per shard being a multivariate hypergeometric draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.sources.tables import materialise


def _uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 12) + F.lit(0.5)) * F.lit(2.0**-52)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_factorial_step(a: Column, d: Column) -> Column:
    """ln (a + d)! - ln a!, without the loss of digits that the difference of two large logarithms
    has: Stirling's series eight places further up, where it is good to 1e-10."""
    low, high = a + 8, a + d + 8
    ratio = F.lit(1.0)
    for i in range(1, 9):
        ratio = ratio * ((a + d + i) / (a + i))

    def tail(x: Column) -> Column:
        return (F.lit(1 / 12) - (F.lit(1 / 360) - 1 / (x * x * 1260)) / (x * x)) / x

    return (low + 0.5) * F.log1p(d / low) + d * (F.log(high) - 1) + tail(high) - tail(low) - F.log(ratio)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows, taken from `total` of which `marked` are marked, are marked.

    Narrow laws are drawn by inversion of u over the whole support that a double can tell from
    nothing, wide ones by rejection, whose number of steps doesn't grow with the law's width. Both
    give the exact law, in double precision.
    """
    given = F.struct(*[x.cast("double").alias(name) for x, name in ((total, "total"), (marked, "marked"), (drawn, "drawn"), (u, "u"))])

    def draw(g: Column) -> Column:
        total, marked, drawn = g["total"], g["marked"], g["drawn"]
        least, most = F.greatest(F.lit(0.0), drawn + marked - total), F.least(drawn, marked)
        mode = F.greatest(least, F.least(most, F.floor((drawn + 1) * (marked + 1) / (total + 2)).cast("double")))
        spread = F.sqrt(drawn * marked / F.greatest(total, F.lit(1.0)) * ((total - marked) / F.greatest(total, F.lit(1.0))) * ((total - drawn) / F.greatest(total - 1, F.lit(1.0))))
        whole = F.struct(g["total"], g["marked"], g["drawn"], g["u"], least.alias("least"), most.alias("most"), mode.alias("mode"), spread.alias("spread"))
        return _let(whole, lambda h: F.when(h["least"] >= h["most"], h["least"]).when(h["spread"] >= 8, _rejection(h)).otherwise(_inversion(h)))

    return _let(given, draw).cast("long")


def _rejection(h: Column, tries: int = 64) -> Column:
    """Ratio of uniforms under the hat of Stadlober (1990), which takes under two tries on average;
    that all tries fail is far rarer than any weight a double can tell from nothing."""
    mode = h["mode"]
    rest = h["total"] - h["marked"] - h["drawn"]
    centre = h["drawn"] * (h["marked"] / h["total"]) + 0.5
    width = F.sqrt(h["spread"] * h["spread"] + 0.5) * (2 * math.sqrt(2 / math.e)) + (3 - 2 * math.sqrt(3 / math.e))

    def attempt(found: Column, i: Column) -> Column:
        point = F.struct(_uniform(h["u"], i, 1).alias("x"), _uniform(h["u"], i, 2).alias("y"))

        def place(p: Column) -> Column:
            return F.struct(p["x"], F.floor(centre + width * (p["y"] - 0.5) / p["x"]).cast("double").alias("k"))

        def accepted(p: Column) -> Column:
            d = p["k"] - mode
            weight = -(
                _log_factorial_step(mode, d)
                + _log_factorial_step(h["marked"] - mode, -d)
                + _log_factorial_step(h["drawn"] - mode, -d)
                + _log_factorial_step(rest + mode, d)
            )
            return F.when((p["k"] >= h["least"]) & (p["k"] <= h["most"]), F.when(F.log(p["x"]) * 2 <= weight, p["k"]))

        return F.when(found.isNotNull(), found).otherwise(_let(_let(point, place), accepted))

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("double"), attempt)
    return F.coalesce(drawn, mode)


def _inversion(h: Column) -> Column:
    """The weights start with 1 at the mode and follow from the ratio of neighbours; as they fall at
    least as fast as a normal curve, 12 standard deviations and 40 steps hold all above 1e-17."""
    total, marked, drawn, u, mode = (h[c] for c in ("total", "marked", "drawn", "u", "mode"))
    reach = F.ceil(h["spread"] * 12 + 40).cast("long")

    def up(k: Column) -> Column:
        return (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))

    def down(k: Column) -> Column:
        return k * (total - marked - drawn + k) / ((marked - k + 1) * (drawn - k + 1))

    zero = F.lit(0.0)

    def weights(ratio, way: int) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), mode.alias("k"), zero.alias("sum"))

        def step(s: Column, _: Column) -> Column:
            w = s["w"] * F.coalesce(ratio(s["k"]), zero)
            return F.struct(w.alias("w"), (s["k"] + way).alias("k"), (s["sum"] + w).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), reach), start, step, lambda s: s["sum"])

    def walk(ratio, way: int, target: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), mode.alias("k"), zero.alias("sum"), mode.alias("at"))

        def step(s: Column, _: Column) -> Column:
            w = s["w"] * F.coalesce(ratio(s["k"]), zero)
            k = s["k"] + way
            return F.struct(w.alias("w"), k.alias("k"), (s["sum"] + w).alias("sum"), F.when((s["sum"] < target) & (w > 0), k).otherwise(s["at"]).alias("at"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), reach), start, step, lambda s: s["at"])

    above, below = weights(up, 1), weights(down, -1)
    # a row of arrays keeps each sum evaluated once
    sums = F.transform(F.array(F.struct(above.alias("a"), below.alias("b"))), lambda s: F.struct(s["a"].alias("a"), (u * (s["a"] + s["b"] + 1)).alias("t")))
    value = F.transform(sums, lambda s: F.when(s["t"] <= 1, mode).when(s["t"] <= s["a"] + 1, walk(up, 1, s["t"] - 1)).otherwise(walk(down, -1, s["t"] - 1 - s["a"])))
    return F.element_at(value, 1)


def _split(room: Column, drawn: Column, *key: Column | int) -> Column:
    """Of `drawn` rows, how many go to each shard when room[s] places are left in shard s, all
    placings being equally likely: one hypergeometric draw per shard from what is left."""
    total = F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, place: Column) -> Column:
        got = hypergeometric(s["total"], place, s["drawn"], _uniform(*key, F.size(s["out"])))
        one = F.transform(F.array(got), lambda g: F.struct((s["total"] - place).alias("total"), (s["drawn"] - g).alias("drawn"), F.concat(s["out"], F.array(g)).alias("out")))
        return F.element_at(one, 1)

    return F.aggregate(room, start, step, lambda s: s["out"])


# Leaves of a subtree that one task draws, and tasks over which the subtrees of a level are spread.
SUBTREE = 64
MATRIX_TASKS = 1024


def _even(total: Column, shards: int) -> Column:
    """Places of each shard: equal, or one more."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(total * (s + 1) / shards) - F.floor(total * s / shards)).cast("long"))


def communication_matrix(counts: DataFrame, partitions: int, shards: int, seed: int) -> DataFrame:
    """(part, quota): per partition the number of its rows that go to each shard.

    counts: (part, n) with part from 0 to partitions - 1; missing parts have no rows. Row sums are the
    counts, column sums differ by at most one, and the matrix has the law that a uniform shuffle of all
    rows would give it. An empty table gives quotas of zero.
    """
    # The tree is cut into subtrees of a bounded number of leaves, rows of their own tasks.
    leaves = min(partitions, SUBTREE)
    place = (F.col("part") % leaves).cast("int")
    listed = F.map_from_entries(F.collect_list(F.struct(place.alias("place"), "n"))).alias("by")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(leaves - 1)), lambda p: F.coalesce(F.element_at("by", p), F.lit(0)).cast("long"))
    if partitions == leaves:
        whole = counts.groupBy().agg(listed, F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        nodes = whole.select(F.lit(0).alias("lo"), sizes.alias("sizes"), _even(F.col("total"), shards).alias("quota"))
    else:
        grouped = counts.groupBy(F.floor(F.col("part") / leaves).cast("int").alias("part"))
        roots = materialise(communication_matrix(grouped.agg(F.sum("n").alias("n")), partitions // leaves, shards, seed), "matrix-roots")
        nodes = roots.join(grouped.agg(listed), "part", "left").select((F.col("part") * leaves).alias("lo"), sizes.alias("sizes"), "quota")
        nodes = nodes.repartition(min(partitions // leaves, MATRIX_TASKS), "lo")
    width = leaves
    while width > 1:
        half = width // 2
        left = F.slice("sizes", 1, half)
        drawn = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.select("lo", "sizes", "quota", _split(F.col("quota"), drawn, seed, F.col("lo"), width).alias("first"))
        rest = F.zip_with("quota", "first", lambda q, f: q - f)
        nodes = nodes.select(F.inline(F.array(
            F.struct(F.col("lo"), left.alias("sizes"), F.col("first").alias("quota")),
            F.struct((F.col("lo") + half).alias("lo"), F.slice("sizes", half + 1, half).alias("sizes"), rest.alias("quota")),
        )))
        width = half
    return nodes.select(F.col("lo").alias("part"), "quota")


def uniform_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rows_per_part: int = 50_000, least_parts: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs in one shard and one place of it.

    Shards hold the same number of rows or one more; slots run from 0 without gaps, and all orders are
    equally likely. Rows get a number of their own first, in a table written to the shared folder, and
    all draws follow from that number and the seed. So rows with equal or null ids and texts are told
    apart, no key can be hot, and a lost executor's tasks repeat the same placing. A null text has no
    bytes (size 8, crc 0); empty texts likewise. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    parts = 1 << max(math.ceil(math.log2(max(1, n / rows_per_part))), int(math.log2(least_parts)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int"))
    matrix = materialise(communication_matrix(rows.groupBy("part").agg(F.count("*").alias("n")), parts, shards, seed), "matrix")

    # permute locally, then the first quota[0] rows go to shard 0, the next quota[1] to shard 1, ...
    ends = F.transform(F.sequence(F.lit(1), F.size("quota")), lambda i: F.aggregate(F.slice("quota", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    local = Window.partitionBy("part").orderBy(F.xxhash64("row", F.lit(seed + 1)), "row")
    dealt = rows.withColumn("place", F.row_number().over(local)).join(matrix.select("part", ends.alias("ends")), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))

    # permute again inside each shard: ordered by a second random number, whose leading bits cut the shard into even bins
    bins = parts
    dealt = dealt.withColumn("mix", F.xxhash64("row", F.lit(seed + 2)))
    dealt = materialise(dealt.select("doc_id", "size", "text_crc32", "shard", "row", "mix", F.pmod("mix", F.lit(bins)).cast("int").alias("bin")), "dealt")
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n")).select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bin").orderBy("mix", "row")
    placed = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "bin"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
