"""SimHash groups, embedding groups, shards, archives, components, and the pipeline."""

import random
from collections import Counter
from hashlib import sha1

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import components, neighbours, sharding, simhash, warc
from panelloom.llm.hnsw import Graph

DOC = "doc_id long, text string, fp string, row long"  # the last two clash with names inside the operators


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], DOC)


def groups_of(edges, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


# components


def test_components_of_chains_hubs_and_copies(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(draw.randint(2000, 2400), draw.randint(2000, 2400)) for _ in range(250)] + [(5, 5), (7, 8), (7, 8), (None, 3), (9, None), (-4, 2500)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    clean = [(a, b) for a, b in edges if a is not None and b is not None]
    want = groups_of(clean, {x for e in clean for x in e})
    assert {(r.node, r.root) for r in components.connected(df).collect()} == {(n, r) for n, r in want.items() if n != r}
    assert components.connected(df.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> j & 1 for h in hashes) > len(hashes)) << j for j in range(64))


@pytest.mark.parametrize("text", ["", " \n", "one", "one two", "A b C d", "é É \xa0x y\x1cz w", "a a a a a", "x\ty\vz\fw\rv", "word " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 3) == plain_fingerprint(text)


def test_fingerprint_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(simhash.fingerprint(b"a b c", 3)).astype(np.int64)


def test_embedding_never_exceeds_the_distance(spark):
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 63, 2000, dtype=np.int64) * 2 + draw.integers(0, 2, 2000)
    b = a ^ (np.int64(1) << draw.integers(0, 64, 2000)) ^ (np.int64(1) << draw.integers(0, 64, 2000))
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    e = rows.select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("low"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"), simhash.embedding(F.col("a")).alias("e"), "a").collect()
    assert all(r.low <= r.d for r in e)
    for r in e[:50]:
        counts = [(r.a >> i & 3).bit_count() for i in range(0, 64, 2)]
        assert [(r.e >> i & 3) for i in range(0, 64, 2)] == [(1 << c) - 1 for c in counts]


def clustered_fingerprints(n, seed):
    draw = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        base = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 40])):
            x = base
            for _ in range(draw.randint(0, 6)):
                x ^= 1 << draw.randint(0, 63)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("levels, most", [((6, 12, 24), 4096), ((6, 12), 8), ((4,), 5), ((6, 12, 24), 20)])
def test_links_connect_what_brute_force_connects(spark, levels, most):
    fps = clustered_fingerprints(900, 11)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = [(signed[a], signed[b]) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    rows = spark.createDataFrame([(signed[f],) for f in fps], "fp long").repartition(3)
    found = [(r.a, r.b) for r in simhash.links(rows, 3, levels, most).collect()]
    assert groups_of(found, signed.values()) == groups_of(edges, signed.values())


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " x"), (1, None), (2, ""), (None, base), (None, "lone text of nobody"), (7, "other words here"), (7, "other words here"), (8, "long " * 50_000)]
    got = simhash.near_duplicates(docs(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows_of = Counter(map(tuple, got.collect()))
    hexed = {t: f"{plain_fingerprint(t or ''):016x}" for _, t in rows}
    near = (plain_fingerprint(base) ^ plain_fingerprint(base + " x")).bit_count() <= 3
    want = [(5, base, 3), (3, base.upper(), 3), (9, base + " x", 3 if near else 9), (1, None, 1), (2, "", 1), (None, base, 3), (None, "lone text of nobody", None), (7, "other words here", 7), (7, "other words here", 7), (8, "long " * 50_000, 8)]
    assert rows_of == Counter((k, hexed[t], c) for k, t, c in want)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# embeddings


def brute_vectors(rows):
    """Per row index its links and component, by cosines in double precision."""
    units = {}
    for i, (k, v) in enumerate(rows):
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    edges = [(i, j) for i in units for j in units if i < j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    label = groups_of(edges, range(len(rows)))
    least = {}
    for i, root in label.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    degree = Counter(x for e in edges for x in e)
    return [(rows[i][0], degree[i], None if rows[i][0] is None else least[label[i]]) for i in range(len(rows))]


@pytest.mark.parametrize("shards, block_rows", [(1, 10_000), (3, 10_000), (2, 150)])
def test_near_vectors_against_brute_force(spark, shards, block_rows):
    draw = np.random.default_rng(shards)
    rows = []
    for _ in range(60):
        centre = draw.normal(size=16)
        for _ in range(int(draw.choice([1, 1, 3, 25]))):
            rows.append((len(rows) * 3 + 1, (centre + draw.normal(size=16) * 0.12).astype(np.float32).tolist()))
    rows += [(9001, rows[0][1]), (9002, rows[0][1]), (9003, None), (9004, [0.0] * 16), (9005, [float("nan")] * 16), (9006, [None] + [1.0] * 15), (9007, [float("inf")] * 16), (9008, []), (None, rows[0][1]), (9010, [1.0, 0.0]), (9011, [2.0, 0.1]), (9012, [-0.0, 1.0]), (9013, [0.0, 1.0]), (1, rows[0][1]), (9014, [1e-30] * 16)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, node int, vector string")
    float32 = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = neighbours.near_vectors(df, least_shards=shards, block_rows=block_rows, beam=8)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == Counter(brute_vectors(float32))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect() if r.vec_id is not None)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_graph_finds_links_in_tight_groups():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 32))
    rows = np.concatenate([c + draw.normal(size=(n, 32)) * 0.1 for c, n in zip(centres, [1, 2, 300, 30] * 10)])
    rows = np.concatenate([rows, draw.normal(size=(2000, 32))])
    rows = draw.permutation(rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    graph = Graph.build(rows)
    found, whole = graph.within(rows, 0.9, 16), graph.scan(rows, 0.9)
    assert sum(map(len, found)) >= 0.99 * sum(map(len, whole))
    assert all(set(f) <= set(w) for f, w in zip(found, whole))


def test_audit_widens_beams():
    class Blind(Graph):
        def within(self, queries, least, beam):
            widths.append(beam)
            return self.scan(queries, least) if beam >= 64 else [np.empty(0, np.int64)] * len(queries)

    widths = []
    draw = np.random.default_rng(1)
    rows = np.repeat(draw.normal(size=(200, 8)), 2, axis=0) + draw.normal(size=(400, 8)) * 0.01
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    shard = neighbours.Shard(rows, Blind(rows.astype(np.float32), [400], []), 0.9, 16, 0.99, 20)
    assert all(len(near) >= 2 for _, near in shard.links(rows)) and widths == [16, 32, 64]


class Partial(Graph):
    """A graph that loses the partners of some rows: at narrow beams, or always."""

    def __init__(self, rows, lost, until):
        super().__init__(rows.astype(np.float32), [len(rows)], [])
        self.lost, self.until, self.at = lost, until, 0

    def within(self, queries, least, beam):
        return [np.empty(0, np.int64) if i in self.lost and beam < self.until else f for i, f in enumerate(self.scan(queries, least))]


def test_audit_sees_small_groups_beside_a_hot_one():
    draw = np.random.default_rng(5)
    hot = np.eye(64)[0] + draw.normal(size=(1500, 64)) * 0.001
    pairs = np.repeat(draw.normal(size=(50, 64)), 2, axis=0) + draw.normal(size=(100, 64)) * 0.001
    rows = np.concatenate([hot, pairs])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    shard = neighbours.Shard(rows, Partial(rows, set(range(1500, 1600)), 32), 0.9, 16, 0.99, 50)
    found = dict(shard.links(rows, own=True))
    assert all(i not in near for i, near in found.items()) and all(list(found[i]) == [i ^ 1] for i in range(1500, 1600))


def test_links_found_from_one_end_count_at_both():
    draw = np.random.default_rng(6)
    hot = np.eye(64)[0] + draw.normal(size=(300, 64)) * 0.001
    rows = np.concatenate([hot, np.repeat(draw.normal(size=(20, 64)), 3, axis=0) + draw.normal(size=(60, 64)) * 0.001])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    lost, copies = {0, *range(300, 360, 3)}, np.arange(1, 361)  # no link is lost from both ends
    linked = rows @ rows.T >= 0.9
    np.fill_diagonal(linked, False)
    a = neighbours.Shard(rows, Partial(rows, lost, 10**9), 0.9, 8, 0.0, 50)
    own, _ = neighbours._counts(a, a, (copies, copies), (lambda i, near: None,) * 2)
    assert (own == linked @ copies).all()
    x, y = rows[::2], rows[1::2]
    a, b = (neighbours.Shard(z, Partial(z, gone, 10**9), 0.9, 8, 0.0, 50) for z, gone in ((x, {0, 3, 151}), (y, set())))
    got = neighbours._counts(a, b, (copies[::2], copies[1::2]), (lambda i, near: None,) * 2)
    assert (got[0] == linked[::2, 1::2] @ copies[1::2]).all() and (got[1] == linked[1::2, ::2] @ copies[::2]).all()


# shards


@pytest.mark.parametrize("total, marked, drawn", [(50, 20, 10), (30, 29, 28), (9, 3, 9), (9, 0, 4), (0, 0, 0), (400, 200, 100)])
def test_hypergeometric_law(spark, total, marked, drawn):
    n = 20_000
    u = (F.col("id") + F.lit(0.5)) / n
    got = [r[0] for r in spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u)).collect()]
    from math import comb

    for k in range(max(0, drawn + marked - total), min(drawn, marked) + 1):
        share = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)
        assert abs(got.count(k) / n - share) <= 1.5 / n
    assert min(got) >= max(0, drawn + marked - total) and max(got) <= min(drawn, marked)


@pytest.mark.parametrize("total, marked, drawn", [(2000, 300, 900), (100_000, 4_166, 50_000), (500, 250, 350)])
def test_wide_hypergeometric_law(spark, total, marked, drawn):
    from math import exp, lgamma

    n = 50_000
    u = sharding._uniform(F.col("id"), 11)
    rows = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u).alias("k")).groupBy("k").count().collect()
    got = {r["k"]: r["count"] for r in rows}

    def ln_choose(a, b):
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

    whole = ln_choose(total, drawn)
    odd = cells = 0
    for k in range(max(0, drawn + marked - total), min(drawn, marked) + 1):
        expected = n * exp(ln_choose(marked, k) + ln_choose(total - marked, drawn - k) - whole)
        if expected >= 5:
            odd, cells = odd + (got.get(k, 0) - expected) ** 2 / expected, cells + 1
    assert cells > 20 and odd < cells + 4 * (2 * cells) ** 0.5


def test_matrix_over_many_subtrees(spark):
    parts, shards = 512, 5
    counts = spark.range(parts).where("id % 7 != 3").select(F.col("id").cast("int").alias("part"), (F.col("id") % 90 + 1000 * (F.col("id") % 50 == 0).cast("int")).alias("n"))
    sizes = {r["part"]: r["n"] for r in counts.collect()}
    rows = {r["part"]: r["quota"] for r in sharding.communication_matrix(counts, parts, shards, 3).collect()}
    assert {p: sum(q) for p, q in rows.items()} == {p: sizes.get(p, 0) for p in range(parts)}
    columns = [sum(c) for c in zip(*rows.values())]
    assert max(columns) - min(columns) <= 1


def test_matrix_has_exact_sums(spark):
    counts = spark.createDataFrame([(0, 100), (1, 3), (2, 77), (5, 1000), (7, 1)], "part int, n long")
    rows = {r.part: r.quota for r in sharding.communication_matrix(counts, 8, 5, 3).collect()}
    assert {p: sum(q) for p, q in rows.items()} == {0: 100, 1: 3, 2: 77, 3: 0, 4: 0, 5: 1000, 6: 0, 7: 1}
    assert sorted(sum(c) for c in zip(*rows.values())) == [236, 236, 236, 236, 237]


def test_shards_are_even_whole_and_repeatable(spark):
    rows = [(i, f"text {i}") for i in range(1000)] + [(7, "text 7")] * 500 + [(None, None), (1001, ""), (1002, "é" * 50_000)]
    df = docs(spark, rows).repartition(4)
    got = sharding.uniform_shards(df, shards=7, rows_per_part=100).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    import zlib

    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    copies = Counter(r.shard for r in got if r.doc_id == 7)
    assert min(copies.values()) > 30  # 501 equal rows spread over all shards
    assert sharding.uniform_shards(docs(spark, [])).count() == 0


# archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_archives_round_trip(spark, tmp_path):
    big, other = "<p>héllo</p>" * 200, "y" * 1000
    rows = [(1, "http://a", big), (5, "http://b\r\nX: 1 é", big), (3, None, big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (None, "n", other), (8, "u", "z" * 3_000_000), (9, "u", "é" * 499 + "a"), (10, "u", "é" * 499 + "a"), (5, "again", big)]
    warc.write_archives(pages(spark, rows).repartition(3), str(tmp_path / "a"), frame_bytes=2000, bundle_bytes=1500)
    archives = spark.read.schema(warc.BUNDLE).parquet(str(tmp_path / "a"))
    got = warc.read_archives(archives).collect()
    text = {(k, u): (h or "").encode() for k, u, h in rows}
    by_id = {}
    for r in got:
        by_id.setdefault(r.record_id, []).append(r)
    assert len(got) == len(rows)
    for k, u, h in rows:
        payload = (h or "").encode()
        for r in by_id[k]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), sha1(payload).hexdigest())
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    assert {k: {(r.record_type, r.refers_to) for r in v} for k, v in by_id.items()} == {
        1: {("revisit", 5)}, 3: {("revisit", 5)}, 5: {("response", None)}, 2: {("response", None)}, 4: {("response", None)}, 6: {("response", None)}, 7: {("response", None)},
        None: {("revisit", 7)}, 8: {("response", None)}, 9: {("response", None)}, 10: {("response", None)},
    }
    assert by_id[3][0].url is None and by_id[5][0].url.count("\n") == 0
    one = {r.record_id: warc.parse(bytes(r.record)) for r in warc.fetch(archives, [8, 2]).collect()}
    assert one[2]["payload"] == text[(2, "u")] and len(one[8]["payload"]) == 3_000_000
    for row in archives.collect():
        bundle = bytes(row.bundle)
        frames = warc.read_seek_table(bundle)
        # any reader of the format gets all records from the frames in order
        assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read().count(b"WARC/1.1\r\n") == len(row["index"])
        assert len(frames) == max(e.frame for e in row["index"]) + 1


def test_very_many_copies_make_many_small_bundles(spark, tmp_path):
    """300,000 revisits of one page compress to almost nothing, yet no bundle holds more than its bound."""
    given = spark.range(300_000).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.lit("same page " * 200).alias("html"))
    warc.write_archives(given, str(tmp_path / "c"))
    archives = spark.read.schema(warc.BUNDLE).parquet(str(tmp_path / "c"))
    assert archives.agg(F.max(F.size("index"))).first()[0] <= 8192
    found = warc.read_archives(archives, payloads=False)
    assert "payload" not in found.columns
    assert {tuple(r) for r in found.groupBy("record_type", "refers_to").count().collect()} == {("response", None, 1), ("revisit", 299_999, 299_999)}


def test_fetch_of_no_and_unknown_ids(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "u", "x"), (None, "u", "y")]), str(tmp_path / "d"))
    archives = spark.read.schema(warc.BUNDLE).parquet(str(tmp_path / "d"))
    assert warc.fetch(archives, []).count() == warc.fetch(archives, [None]).count() == warc.fetch(archives, [7]).count() == 0
    assert warc.fetch(archives, [None, 1]).count() == 1


def test_archive_of_nothing_and_a_damaged_one(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "b"))
    assert warc.read_archives(spark.read.schema(warc.BUNDLE).parquet(str(tmp_path / "b"))).count() == 0
    good = warc.record(1, "u", b"abc", 3, sha1(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))


# pipeline


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark."""
    at = tmp_path_factory.mktemp("small")
    draw = random.Random(1)
    words = ["the", "of", "river", "stone", "light", "garden", "winter", "yellow", "paper", "silent", "table", "window"]
    good = [(i, " ".join(draw.choice(words) for _ in range(120)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(draw.choice(words).upper() + "!!" for _ in range(80))) for i in range(40)]
    passage = "seven bright kites were drifting over that old harbour wall tonight"
    rows = good + bad + [(200, good[3][1]), (201, good[3][1] + " stone"), (202, good[4][1] + " " + passage + " end"), (203, passage)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(rows), passage


def test_pipeline_stage_by_stage(spark, small):
    at, texts, passage = small
    found = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = found.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, at)
        assert found.columns == columns
        kept.append({r.doc_id: r for r in found.collect()})
    assert set(kept[0]) == {k for k in texts if not 100 <= k < 200}
    groups = groups_of([(a, b) for a in kept[0] for b in kept[0] if a < b and (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() <= 3], kept[0])
    assert set(kept[1]) == set(groups.values()) and 200 not in kept[1]
    assert 203 not in kept[2] and passage not in kept[2][202].text and kept[2][202].text.startswith(texts[4])
    assert all(r.n_chars == len(r.text) for r in kept[2].values()) and all(r.text == texts[k] for k, r in kept[2].items() if k != 202)
    pieces = corpus_pipeline.run(spark, at).toPandas()
    assert set(pieces.doc_id) == set(kept[2]) and pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z w v"), (3, "q r s t")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()))) == ["1", "3", "None"]


def test_one_id_on_texts_of_several_groups(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [(5, a), (6, a), (5, b), (5, b), (7, b), (3, c), (5, c), (5, d), (None, d)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, a), (5, b), (3, c), (5, d)])
