"""Byte-level BPE, the Merkle manifest and spelling variants, against the library and brute force."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelloom.llm import byte_bpe, manifest, spelling

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.read_ranks(RANKS), byte_bpe.splitter(public_tokenizers.PATTERN))


def as_ids(ids):
    return np.array(ids, "<u4").tobytes()


# byte-level BPE


def test_codes_equal_the_library_on_odd_texts(coder, library):
    draw = random.Random(1)
    letters = "aaab  \n\t'sdé²½ß€漢字🙂́ \x1c\x85 .!?-_0123 \U00010ee7\U00018da7\U000323b0<|endoftext|>ABCабв\x00"
    texts = ["".join(draw.choices(letters, k=draw.randrange(80))) for _ in range(3000)]
    assert coder.encode(texts) == [as_ids(library.encode_ordinary(t)) for t in texts]
    assert [coder.decode(x).decode() for x in coder.encode(texts)] == texts


def test_rows_of_every_length_and_the_heap_merge_alike(coder, library):
    draw = random.Random(2)
    for size in [1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 64, 65, 300, 511, 512, 513, 2000]:
        for letters in ("a", "ab", "etaoin", "aé漢"):
            text = "".join(draw.choices(letters, k=size))
            data = text.encode()[:1000]
            assert coder.merge_rows([data, data[:1], data])[0] == coder.merge_long(data)
            assert coder.encode([text])[0] == as_ids(library.encode_ordinary(text))


def test_ranks_out_of_the_order_of_merging():
    """Tokens that no merge makes, and pairs of which a later one has the lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 256, b"abc": 400, b"bca": 257, b"aa": 258, b"aaa": 259, b"xyz": 260}
    coder = byte_bpe.Coder(ranks, byte_bpe.splitter(public_tokenizers.PATTERN))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcaxyz ", k=draw.randrange(30))) for _ in range(500)] + ["xyz", "abc", "a" * 600]
    assert coder.encode(texts) == [as_ids(library.encode_ordinary(t)) for t in texts]


def test_long_texts_are_cut_where_no_match_goes_on(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TOGETHER", 50)
    draw = random.Random(4)
    texts = ["".join(draw.choices("ab é\n\t  .'s🙂1", k=2000)) for _ in range(20)] + ["x" * 500, "", " " * 400]
    assert coder.encode(texts) == [as_ids(library.encode_ordinary(t)) for t in texts]


def test_the_cache_may_be_cut_at_any_time(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_CACHED", 3)
    coder = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), byte_bpe.splitter(public_tokenizers.PATTERN))
    for text in ("one two threefold", "threefold fourfold zzxxyyqq", "zzxxyyqq one two", "q" * 100):
        assert coder.encode([text]) == [as_ids(library.encode_ordinary(text))]


def test_round_trip_of_rows(spark, library):
    rows = [(1, "hello  world"), (1, "hello  world"), (None, "x"), (2, None), (3, ""), (4, "é" * 3000 + " \n" * 500)]
    docs = spark.createDataFrame([(k, t, "c", "d") for k, t in rows], "doc_id long, text string, ids string, decoded string")
    got = sorted(((r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = sorted(((k or 0, len(x := library.encode_ordinary(t or "")), as_ids(x), (t or "").encode()) for k, t in rows), key=str)
    assert got == want
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(coded, RANKS).collect()) == sorted(x[3] for x in want)
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Merkle manifest


def hexed(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and the siblings of each node from below to above as (is left, sibling or None)."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            ways[i].append((p % 2 == 1, nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
        place = [p // 2 for p in place]
        nodes = [hexed("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for lang in langs]
    trees = [plain_tree([plain_leaf(r) for r in g]) for g in groups]
    root, over = plain_tree([t[0] for t in trees])
    out = []
    for group, (subroot, ways), above in zip(groups, trees, over):
        for row, way in zip(group, ways):
            hit = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = plain_leaf((*row[:3], row[3] + 1, row[4]) if hit else row)
            for left, other in way + above:
                node = hexed((other if left else "") + node + (other if other and not left else ""))
            siblings = hexed("".join(x for _, x in way + above if x))
            out.append((row[0], plain_leaf(row), subroot, root, siblings, node, node == root))
    return sorted(out, key=str)


def spark_manifest(spark, rows, bits):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, tree string, pos int")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = manifest.manifest(docs, altered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits, with_steps=True).collect()
    for r in found:
        assert manifest.fold(r.leaf, r.steps) == r.root and manifest.proof(r.steps) == r.proof_sha256
    return sorted((tuple(r)[:7] for r in found), key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, bits):
    draw = random.Random(bits)
    rows = [(i, draw.choice(["web", None, ""]), draw.choices(["en", "é", None, "", "e"], [9, 1, 1, 1, 1])[0], draw.choice([None, 7, i]), f"t{i % 5}") for i in range(45)]
    rows += [(900, "s", "alone", 3, "x")] + [(50, "s", "en", 1, "same")] * 9 + [(50, "s", "en", 2, "other"), (None, None, "en", None, None), (None, None, None, None, None)]
    got = spark_manifest(spark, rows, bits)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifests_of_few_rows(spark):
    assert spark_manifest(spark, [(14, "s", None, 1, "")], 10) == plain_manifest([(14, "s", None, 1, "")])
    two = [(1, "s", "b", 1, "x"), (1, "s", "a", 1, "x")]
    assert spark_manifest(spark, two, 10) == plain_manifest(two)
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert manifest.manifest(docs).count() == 0


# spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, ratio=5):
    near = {a: [b for b in counts if one_apart(a, b)] for a in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[word] = best if best and counts[best] >= ratio * counts[word] else None
    out = set()
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.add((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return out


def test_variants_equal_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    for letters, hot in (("abé", 10_000), ("abcdefÿ", 10_000), ("ab", 12)):
        monkeypatch.setattr(spelling, "HOT_WORDS", hot)  # the last run splits its keys over several shards
        words = {"".join(draw.choices(letters, k=draw.randrange(6, 9))) for _ in range(150)}
        for word in list(words):
            at = draw.randrange(len(word))
            words |= {w for w in (word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:]) if len(w) >= 6}
        counts = {w: draw.choice([5, 6, 25, 30, 125, 150, 700]) for w in words}
        rows = spark.createDataFrame(list(counts.items()), "word string, n int").select(F.explode(F.expr("array_repeat(word, n)")).alias("word"), F.lit(1).alias("kind"))
        found = spelling.variants(rows)
        assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(counts)


def test_long_words_rare_words_and_no_words(spark):
    long = "q" * 3000
    rows = [long] * 30 + [long[:-1] + "r"] * 5 + ["seldom"] * 4 + ["short"] * 9 + [None] * 9 + ["single"] * 5
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame([(r,) for r in rows], "word string")).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == {(long, None, long, 30, 1, None), (long[:-1] + "r", long, long, 5, 1, 30), ("single", None, "single", 5, 0, None)}
    assert spelling.variants(spark.createDataFrame([], "word string")).count() == 0


def test_runs_of_letters(spark):
    rows = [(1, "Straße-ÀÉÎ×÷øAbcdef abcde x"), (None, "ABCDEF1ghijkl_mnopqr"), (2, None), (3, "")]
    got = sorted((r.id or 0, r.run) for r in spelling.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, "straße"), (1, "ÀÉÎ×÷øabcdef"), (0, "abcdef"), (0, "ghijkl"), (0, "mnopqr")])
