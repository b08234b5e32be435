"""Chat round trip, decontamination, token counts, packing, main text, quality votes."""

import random
import re
import time
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import chat, decontaminate, html_text, packing, quality_votes, token_counts

DOC = "doc_id long, text string, words string, part long"  # the last two clash with names inside the operators


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], DOC)


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", ">> x"]), st.text(st.sampled_from("<>/[]\\INSTs SYROLE:a\n"), max_size=30)), max_size=5))
def test_grammar_reads_back_every_turn(turns):
    grammar = chat.Grammar(chat.Template())
    rendered = [grammar.render(r, t) for r, t in turns]
    assert grammar.parse("".join(r[0] for r in rendered)) == (turns, "")
    for (_, text), (segment, start, end, _) in zip(turns, rendered):
        assert chat.UNESCAPE.sub(r"\1", segment[start:end]) == text
        assert not grammar.marker.search(segment[start:end])


def test_control_strings_are_escaped_and_counted():
    segment, start, end, level = chat.Grammar(chat.Template()).render("assistant", "</s>[INST] ok [/INST]")
    assert (segment, level) == (" <\\/s>[\\INST] ok [\\/INST] </s>", 1)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 0, "user", None, 0), (2, None, None, "x", 0), (None, 0, "user", "</s>", 0), (3, 0, "user", "a" * 100_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha256(b"user\n\nuser\n\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 1 and got[1].loss_sha256 == sha256(b"b").hexdigest()
    assert got[2].turns_sha256 == sha256(b"\nx\n").hexdigest() and got[2].loss_sha256 == sha256(b"").hexdigest()
    assert got[3].formatted_chars == 100_018
    texts = {r.conv_id: r.formatted for r in chat.texts(chat.render(df)).collect()}
    assert all(len(texts[k]) == got[k].formatted_chars for k in got)
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_a_broken_text_fails(spark):
    broken = chat.render(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")).selectExpr("conv_id", "turn", "role", "left(segment, 5) AS segment", "body_start", "body_end", "trained", "level")
    with pytest.raises(Exception, match="doesn't parse"):
        chat.read_back(broken).collect()


# decontamination


def brute(text, items, width):
    words, hit, names = decontaminate.words_of(text.encode()), set(), set()
    for name, item in items:
        w = decontaminate.words_of(item.encode())
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return sorted(hit), names


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab c", max_size=14), max_size=4), st.text("abc  d", max_size=40), st.integers(1, 4))
def test_automaton_against_brute_force(items, text, width):
    items = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    text = " ".join(text)
    spans, names = decontaminate.Automaton([(n, t.encode()) for n, t in items], width).scan(decontaminate.words_of(text.encode()))
    assert ([p for s, e in spans for p in range(s, e)], names) == brute(text, items, width)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


ITEMS = [(1, "The quick brown fox jumps over the lazy dog, again and again."), (2, "Short item"), (None, "no id"), (4, None), (5, "!!"), (2, "short, item"), (7, "gleich ÄRGER")]


@pytest.mark.parametrize("most_bytes", [4 << 20, 40])
def test_scan_and_cut(spark, most_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    passage = "THE quick brown fox; jumps over the lazy dog again"
    rows = [(1, f"before {passage} after it"), (2, None), (3, ""), (4, "a short ITEM here, and more text around it"), (None, "nothing"), (6, "short item"), (6, "short item"), (7, "x " * 50_000 + passage), (8, "gleich ärger")]
    got = [(r.doc_id, r.n_words, r.n_hit, r.items) for r in decontaminate.scan(docs(spark, rows), items, most_bytes=most_bytes).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 13, 10, ["1"]), (2, 0, 0, []), (3, 0, 0, []), (4, 9, 2, ["2"]), (None, 1, 0, []), (6, 2, 2, ["2"]), (6, 2, 2, ["2"]), (7, 50_010, 10, ["1"]), (8, 2, 0, [])], key=str
    )
    kept = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, rows), items, most_bytes=most_bytes).collect()}
    assert kept[4] == "a  here, and more text around it" and kept[2] is None and kept[3] == "" and kept[8] == "gleich ärger"
    assert 1 not in kept and 6 not in kept  # mostly benchmark text
    assert decontaminate.words_of(kept[7].encode()) == [b"x"] * 50_000
    assert decontaminate.remove_spans(docs(spark, rows), items).columns == ["doc_id", "text", "words", "part"]
    assert decontaminate.scan(docs(spark, []), items).count() == 0
    assert decontaminate.scan(docs(spark, rows), items.limit(0)).where("n_hit > 0").count() == 0


def test_cutting_repeats_until_nothing_is_left():
    known = decontaminate.Automaton([("1", b"a b c d")], 4)
    assert decontaminate.cut(b"x a b a b c d c d y", known) == (b"x  y", 8)


# token counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_every_prefix_has_the_library_count():
    import sentencepiece

    library, counter, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.PrefixCounter(MODEL), random.Random(3)
    pieces = ["the", " the", "ing", "  ", " ", "\n", "\t", "▁", "é", "字", "😀", "<s>", "<0x0A>", "ﬁ", "\r", "();", "aaaa", "1234", "\x00", "      "]
    for _ in range(200):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))
        total, growth = counter.growth(text)
        assert token_counts.counts(growth).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert total == len(library.encode(text))
        budget = draw.randint(0, 12)
        best = token_counts.longest_prefix(growth, budget)
        assert best == max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= budget)
        assert token_counts.tokens_at(growth, best) == len(library.encode(text[:best]))


def test_counts_of_odd_rows(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    long = "abc" * 30_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, long)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.prefix_counts(docs(spark, rows), MODEL).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (None, 3, 2), (3, 4, len(library.encode("same"))), (3, 4, len(library.encode("same"))), (4, 90_000, len(library.encode(long)))], key=str)
    assert token_counts.prefix_counts(docs(spark, []), MODEL).count() == 0
    cuts = {(r.doc_id, r.budget): (r.chars, r.n_tokens) for r in token_counts.truncations(token_counts.prefix_counts(docs(spark, rows), MODEL), [0, 7]).collect()}
    assert cuts[1, 7] == cuts[2, 0] == cuts[4, 0] == (0, 0) and cuts[None, 7] == (3, 2)
    assert cuts[4, 7][1] == len(library.encode(long[: cuts[4, 7][0]])) <= 7 < len(library.encode(long[: cuts[4, 7][0] + 1]))


# packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_ids_by_run_are_the_library_ids():
    from tokenizers import Tokenizer

    library, encoder, draw = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS), random.Random(5)
    pieces = ["The", "don't", " ", "\n", "\t ", " ", "é", "é", "́", "字", "😀", "<|endoftext|>", "Σ", "İ", "\x1c", "\x85", "12", "!?", ".", ",|", "a.", "'s", " ", "\x00", "x" * 80]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts), b"")):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("partitions", [1, 5])
def test_pieces_cover_all_ids_once(spark, partitions):
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(WORDS), random.Random(7)
    rows = [(i, " ".join(draw.choice(["the", "of", "cat", "zebra?"]) for _ in range(draw.choice([0, 1, 10, 60, 300, 700])))) for i in range(120)] + [(500, None), (501, "word " * 9000), (None, "no id"), (502, "twin"), (502, "twin")]
    pieces = packing.pack(docs(spark, rows).repartition(partitions), WORDS, window=512, tiers=(32, 64, 128, 256), step_tokens=2048, block=4000, merged=16).toPandas()
    by_doc = {}
    for key, text in rows:
        by_doc.setdefault(key, []).append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    for p in pieces.itertuples():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        key = None if p.doc_id != p.doc_id else int(p.doc_id)
        assert ids in [d[p.start : p.start + p.length] for d in by_doc[key]] and p.doc_tokens in map(len, by_doc[key])
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(ids) == p.length > 0
    assert pieces.length.sum() == sum(len(d) for ds in by_doc.values() for d in ds)
    for key, own in pieces[~pieces.doc_id.isin([502])].groupby("doc_id"):
        ends = own.sort_values("start")
        assert (ends.start.values == np.concatenate([[0], ends.length.cumsum().values[:-1]])).all()
    padding = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset.values == np.concatenate([[0], own.length.cumsum().values[:-1]])).all()
        assert own.length.sum() <= 512 and own.tier.nunique() == 1
        padding += own.tier.iloc[0] - own.length.sum()
    assert padding < 512  # one sequence of leftovers
    full = pieces[pieces.step >= 0].groupby(["tier", "step"]).length.sum()
    assert (full <= 2048).all() and (full.groupby("tier").apply(lambda s: (s < 2048).sum()) <= 1).all()


def test_no_documents_no_pieces(spark):
    assert packing.pack(docs(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), WORDS, tiers=(512,))


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>not this</p> --><div class="ad">Buy this, now.</div>
%s
<aside><p>Side, text.</p></aside><div id="comments"><article class="comment"><p>I like it, really.</p></article></div><form><label>Mail</label><button>Go</button></form>
<div class="cookie-notice">We use cookies, yes.</div><footer>&copy; me &middot; all, rights.</footer></body></html>"""


def test_article_of_a_page():
    body = '<article><h1>Head &amp;\n line</h1><p><b>First, one.<br><p>Second&nbsp;two, <a href="x">with a link</a>.</p><p> </p><ul><li>Point<li>Last</ul><footer>by me</footer></article>'
    want = "Head & line\nFirst, one.\nSecond two, with a link.\nPoint\nLast"
    assert html_text.main_text(PAGE % body) == want
    assert html_text.main_text(PAGE % body.replace("article>", 'div>').replace("<div>", '<div class="story">', 1)) == want


def test_paths_without_marks():
    story = "<p>" + "</p><p>".join(f"Sentence {i}, of some length, and a bit more of it." for i in range(9)) + "</p><p>Short.</p>"
    page = f'<body><div class="x1"><span>Top</span></div><div class="x2">{story}</div><div class="x3"><div><a href="1">Link one here</a></div><div><a href="2">Link two here</a></div></div></body>'
    assert html_text.main_text(page) == re.sub(r"</?p>", "\n", story).strip().replace("\n\n", "\n")


@pytest.mark.parametrize("page, want", [("", ""), ("plain, text", "plain, text"), ("<p>a < b &lt;c&gt;", "a < b <c>"), ("<nav>only</nav>", ""), ("<p>open <b", "open <b"), ("<!-- never ends <p>x", ""), ("<p>" + "long text. " * 50_000, ("long text. " * 50_000).strip()), ("<p a='x>y'>t</p>", "t")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


STORY = [f"Sentence {i} of the story, of some length, and a bit more of it." for i in range(9)]
NAMED = ["<article class='post has-sidebar'>%s</article>", "<div class='content no-sidebar'>%s</div>", "<div id='page' class='social-site'>%s</div>", "<div class='social'><article>%s</article></div>", "<div class='share-story'>%s</div>"]


@pytest.mark.parametrize("around", NAMED)
def test_names_take_no_article(around):
    body = "".join(f"<p>{x}</p>" for x in STORY) + "<div class='sidebar'>Top ten, of this week.</div>"
    assert html_text.main_text(f"<body><div class='menu'>Home, and more.</div>{around % body}<div id='comments'><p>I agree, with all of it.</p></div></body>") == "\n".join(STORY)


LONG = [f"This is opinion number {i}, rather long, and it goes on for a while; nobody knows why it does." for i in range(12)]


def paragraphs(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def test_a_long_sidebar_is_no_article():
    page = f"<body><div class='content'><h1>Title</h1><p>One short sentence.</p></div><div class='sidebar'>{paragraphs(LONG[:4])}</div></body>"
    assert html_text.main_text(page) == "Title\nOne short sentence."


@pytest.mark.parametrize("count", [2, 8, 12])
def test_comments_go_however_long_they_are(count):
    comments, body = paragraphs(LONG[:count]), paragraphs(STORY[:3])
    for page in (
        f"<article><h1>Title</h1>{body}<section class='comments'>{comments}</section></article>",
        f"<article><h1>Title</h1>{body}</article><div id='comments'>{comments}</div>",
        f"<body><div class='post'><h1>Title</h1>{body}</div><div id='comments'>{comments}</div></body>",
        f"<body><div class='post'><h1>Title</h1>{body}<div class='reader-comments'>{comments}</div></div></body>",
        f"<article><h1>Title</h1>{body}<div id='c'><article class='comment'>{comments}</article></div></article>",
    ):
        assert html_text.main_text(page) == "\n".join(["Title", *STORY[:3]])


def test_the_header_of_an_article_without_marks_stays():
    post = f"<div class='post'><header><h1>Title</h1></header>{paragraphs(STORY)}</div>"
    assert html_text.main_text(f"<body><header><h2>Site</h2><nav>Menu</nav></header>{post}</body>") == "\n".join(["Title", *STORY])
    site = f"<div id='wrap'><header><h1>Site</h1></header><div class='post'><h1>Title</h1>{paragraphs(STORY)}</div></div>"
    assert html_text.main_text(f"<body>{site}</body>") == "\n".join(["Title", *STORY])


def test_a_named_element_that_holds_the_only_heading_is_the_article():
    page = f"<body><div class='widget'><h1>Title</h1>{paragraphs(STORY)}<div class='related'>{paragraphs(LONG)}</div></div><p>All rights reserved.</p></body>"
    assert html_text.main_text(page).startswith("\n".join(["Title", *STORY])) and LONG[0] not in html_text.main_text(page)


HOSTILE = {
    "open tags": "<a " * 330_000,
    "open quotes": '<a x="' * 160_000 + ">",
    "odd quotes": "<a x='\"" * 140_000 + "> <b>",
    "classes": "".join(f"<div class='c{i}'>Some text, number {i}.</div>" for i in range(22_000)),
    "deep": "<div>text " * 100_000,
    "deep classes": "".join(f"<div class='widget c{i}'>t. " for i in range(35_000)),
    "unopened ends": "<div>" * 70_000 + "</section></p></td>" * 35_000,
    "items": "<ul><li>x" * 60_000 + "</li></b>" * 40_000,
    "comments": "<!-- " * 200_000,
    "scripts": "<script>" * 120_000,
    "many headers": "<div>" + "<header><h2>t.</h2></header>" * 30_000 + "<p>Text, at last.</p>",
    "headers": "<div><header><h1>t.</h1></header>" * 30_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_of_a_megabyte_take_linear_time(kind):
    began = time.thread_time()
    html_text.main_text(HOSTILE[kind])
    assert time.thread_time() - began < 8  # a quadratic step takes minutes


def test_path_scores_equal_all_pairs():
    """Every path compared with every other: weight 1 for itself, NEAR one step away, nothing else."""
    draw = random.Random(6)
    above = [-1] + [draw.randrange(i) for i in range(1, 120)]
    sums = {p: [float(draw.randrange(90)), draw.randrange(9), 90.0, draw.randrange(1, 5)] for p in draw.sample(range(1, 120), 80)}
    for p, found in html_text.path_scores(above, sums).items():
        weight = {q: 1 if p == q else html_text.NEAR if above[q] == p or above[p] == q or above[p] == above[q] else 0 for q in sums}
        length, marks, blocks = (sum(w * sums[q][i] for q, w in weight.items()) for i in (0, 1, 3))
        want = 0 if sums[p][0] < 0.4 * sums[p][2] else length / blocks * (1 + marks / blocks)
        assert found == pytest.approx(want)


def test_header_inside_an_article_stays():
    page = f"<article><header class='entry-header'><h1 class='header'>Title</h1></header><div class='post-header'>By one, of us.</div><p>{STORY[0]}</p><div class='ad'>Buy.</div></article>"
    assert html_text.main_text(page) == f"Title\nBy one, of us.\n{STORY[0]}"


def test_linked_lists_of_a_marked_article_stay():
    page = f"<article><p>{STORY[0]}</p><ul><li><a href='1'>Source one</a></li><li><a href='2'>Source two</a></li></ul><nav>Menu</nav></article>"
    assert html_text.main_text(page) == f"{STORY[0]}\nSource one\nSource two"


def test_low_paths_between_paragraphs_in_the_body_stay():
    first, last = ("".join(f"<p>{x}</p>" for x in part) for part in (STORY[:5], STORY[5:]))
    page = f"<body><div><span>Top</span></div>{first}<ul><li>One</li><li>Two</li></ul><table><tr><td>7</td></tr></table><blockquote>So.</blockquote>{last}<div><i>End</i></div></body>"
    assert html_text.main_text(page) == "\n".join([*STORY[:5], "One", "Two", "7", "So.", *STORY[5:]])


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", None, "z"), (None, None, "<p>x</p>", "z"), (2, "u", "<p>y</p>", "z"), (2, "u", "<p>y</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, "u", ""), (None, None, "x"), (2, "u", "y"), (2, "u", "y")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


# quality votes


def quality_tables(spark):
    good = [(i, f"A plain sentence about thing {i}, with words and an end. And another one.") for i in range(0, 120, 2)]
    bad = [(i, "BUY!! NOW!! CHEAP!! " * 5 + f"{i}") for i in range(1, 120, 2)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k, _ in good + bad] + [(None, 1), (7, None)], "doc_id long, quality int")
    return good + bad, labels


def test_votes_tell_held_out_rows(spark):
    rows, labels = quality_tables(spark)
    extra = [(1000, None), (1001, ""), (None, "A plain sentence about thing, with words."), (1002, "BUY!! NOW!! " * 20_000), (2, "A plain sentence about thing 2, twice.")]
    votes = quality_votes.fit(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality_votes.score(docs(spark, rows + extra), votes).collect()}
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert out and all((got[k] >= 0.7) == (k % 2 == 0) for k in out)
    assert got[1000] == got[1001] == pytest.approx(votes.labels.mean()) and got[None] > 0.7 > got[1002]
    assert len(votes.labels) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k, _ in rows)
    kept = quality_votes.keep(docs(spark, rows), votes)
    assert kept.columns == ["doc_id", "text", "words", "part"] and {r.doc_id for r in kept.collect()} == {k for k, _ in rows if k % 2 == 0}
    assert quality_votes.score(docs(spark, []), votes).count() == 0


def test_votes_tell_texts_of_one_form_by_their_words(spark):
    draw = random.Random(4)
    sorts = ["clean river stone garden light winter paper window".split(), "cheap pills quick money offer loans prize casino".split()]
    rows = [(i, " ".join(draw.choice(sorts[i % 2]) for _ in range(30))) for i in range(200)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_votes.score(docs(spark, rows), quality_votes.fit(docs(spark, rows), labels)).collect()}
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert out and all((got[k] >= 0.7) == (k % 2 == 0) for k in out)


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    rows, labels = quality_tables(spark)
    flipped = labels.withColumn("quality", F.when(quality_votes.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_votes.fit(docs(spark, rows), x) for x in (labels, flipped))
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_without_labels_and_within_the_bound(spark):
    rows, labels = quality_tables(spark)
    none = quality_votes.fit(docs(spark, rows), labels.limit(0))
    assert {r.score for r in quality_votes.score(docs(spark, rows), none).collect()} == {0.5}
    assert len(quality_votes.fit(docs(spark, rows + rows), labels, most_labelled=10).labels) == 10


def test_votes_equal_brute_force(spark):
    draw = random.Random(9)
    pool = "river stone garden light winter paper window pills quick money offer loans prize casino A1 BUY!! |x| 2024".split()
    rows = [(i, " ".join(draw.choice(pool[draw.randrange(6) :]) for _ in range(draw.randint(5, 60)))) for i in range(300)]
    label = {k: draw.random() < 0.5 for k, _ in rows}
    labels = spark.createDataFrame([(k, int(v)) for k, v in label.items()], "doc_id long, quality int")
    votes = quality_votes.fit(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality_votes.score(docs(spark, rows), votes).collect()}

    whole = {k: np.array(quality_votes.frequencies(t), np.float64) for k, t in rows}
    learned = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    seen = np.sum([whole[k] > 0 for k in learned], axis=0)
    rarity = np.log((1 + len(learned)) / (1 + seen)) + 1
    assert np.allclose(rarity, votes.rarity, rtol=1e-5)
    weighted = np.array([whole[k] * rarity for k in learned])
    sizes = np.linalg.svd(weighted, compute_uv=False)[: votes.space.shape[1]]
    assert ((weighted @ votes.space) ** 2).sum() == pytest.approx((sizes**2).sum(), rel=1e-4)

    def cosine(a, b):
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    low = {k: whole[k] * rarity @ votes.space for k in whole}
    for k, _ in rows:
        nearest = sorted(((cosine(low[k], low[j]), label[j]) for j in learned), reverse=True)
        if nearest[14][0] - nearest[15][0] < 1e-5:
            continue  # the fifteenth is a matter of rounding
        kept = [(max(c, 0.0), v) for c, v in nearest[:15]]
        assert got[k] == pytest.approx(sum(c * v for c, v in kept) / sum(c for c, _ in kept), abs=1e-4)
    assert 0 < min(got.values()) < 0.4 and 0.6 < max(got.values()) < 1
