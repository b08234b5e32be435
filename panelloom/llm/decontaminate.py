"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import pieces
from panelloom.sources.tables import materialise

KEPT = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(KEPT).split()


class Automaton:
    """Generalised suffix automaton of the items, over word numbers.

    A window is `width` consecutive words of an item, or a whole item of fewer words (not of none).
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, self.numbers = width, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        texts = []
        for name, text in items:
            if words := words_of(text):
                texts.append((name, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        for _, text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        self.shortest = min([width, *(len(t) for _, t in texts)])
        # short[v]: (length, names) of the short items that are v's longest suffixes as a whole; full[v]: items
        # that hold the string of `width` words in v
        self.short: dict[int, dict[int, set[str]]] = {}
        self.full: dict[int, set[str]] = {}
        for name, text in texts:
            state = 0
            for at, word in enumerate(text, 1):
                state = self.next[state][word]
                if at >= width:
                    v = state
                    while self.length[self.link[v]] >= width:
                        v = self.link[v]
                    self.full.setdefault(v, set()).add(name)
            if len(text) < width:
                self.short.setdefault(state, {}).setdefault(len(text), set()).add(name)
        self.up = self._nearest()

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def _nearest(self) -> list[int]:
        """Per state the nearest state over suffix links, itself included, that ends a short item; 0 if none."""
        up = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up[v] = v if v in self.short else up[self.link[v]]
        return up

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words, in order and apart, and the items with occurring windows.

        Words that no item has reset the match, so only runs of known words are walked; along a run the
        automaton keeps the length of the longest suffix that occurs in some item.
        """
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.numbers or len(words) < self.shortest:
            return spans, names
        numbers = np.fromiter(map(self.numbers.get, words, [0] * len(words)), np.int64, len(words))
        known = np.concatenate([[0], numbers > 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(known))
        for lo, hi in zip(turns[::2], turns[1::2]):
            if hi - lo >= self.shortest:
                self._walk(numbers[lo:hi].tolist(), int(lo), spans, names)
        return spans, names

    def _walk(self, run: list[int], at: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        state = matched = 0
        following, link, length, width = self.next, self.link, self.length, self.width
        for end, word in enumerate(run, at + 1):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if (to := following[state].get(word)) is None:
                continue
            state, matched = to, matched + 1
            longest = 0
            if matched >= width:
                v = state
                while length[link[v]] >= width:
                    v = link[v]
                names |= self.full[v]
                longest = width
            v = self.up[state]
            while v:
                for size, own in self.short[v].items():
                    if size <= matched:
                        names |= own
                        longest = max(longest, size)
                v = self.up[link[v]]
            if longest:
                start = end - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def automatons(items: DataFrame, id_col: str, text_col: str, width: int, most_bytes: int) -> list[Automaton]:
    """Automatons of all items, each of at most most_bytes of text (or a single longer item).

    They go to the tasks one at a time: about 100 bytes of memory per byte of text. A set of items that
    is larger than one automaton may be takes one more pass over the documents for each further one.
    """
    given = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    parts, size = [[]], 0
    for row in given.toLocalIterator():
        text = bytes(row.text)
        if parts[-1] and size + len(text) > most_bytes:
            parts.append([])
            size = 0
        parts[-1].append((row.name, text))
        size += len(text)
    return [Automaton(part, width) for part in parts]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, most_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans): one row per row of docs, whole texts.

    spans are [start, end) in words of the text, in order and apart; n_hit is their total length. items
    are the ids, as sorted strings, of the test items with occurring windows. Null and empty texts have no
    words; items with a null id or without words have no windows; items with the same id count once.
    """
    parts = automatons(items, item_id, item_text, width, most_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def pass_of(part: Automaton):
        known = docs.sparkSession.sparkContext.broadcast(part)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                counts, named, placed = [], [], []
                for text, names, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    words = words_of(text or b"")
                    found, also = known.value.scan(words)
                    counts.append(len(words))
                    named.append(sorted({*names, *also}))
                    placed.append([{"start": s, "end": e} for s, e in _join([*((x["start"], x["end"]) for x in spans), *found])] if spans else [{"start": s, "end": e} for s, e in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(placed, SPANS)], batch.schema.names)

        return each

    for at, part in enumerate(parts):
        rows = (materialise(rows, "scan") if at else rows).mapInArrow(pass_of(part), rows.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def cut(text: bytes, known: Automaton) -> tuple[bytes, int]:
    """The text without its hit spans, cut again until no window is left, and the number of words cut."""
    hit = 0
    while True:
        spans, _ = known.scan(words_of(text))
        if not spans:
            return text, hit
        hit += sum(e - s for s, e in spans)
        places = [m.span() for m in WORD.finditer(text)]
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at : places[start][0]])
            at = places[end - 1][1]
        text = b"".join([*kept, text[at:]])


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, most_coverage: float = 0.5, most_bytes: int = 4 << 20) -> DataFrame:
    """docs with all its columns, without the spans of words that lie in windows of test items.

    Texts are cut until no window is left. Rows of which more than most_coverage of the words were cut are
    removed whole; rows without a span stay as they are, null and empty texts included.
    """
    parts = automatons(items, item_id, item_text, width, most_bytes)
    at, n = docs.columns.index(text_col), len(docs.columns)
    words, gone = (f"__{x}_{'_'.join(docs.columns)}" for x in ("words", "gone"))  # no column of docs is called so
    rows = docs.withColumns({words: F.lit(-1).cast("long"), gone: F.lit(0).cast("long")})

    def pass_of(part: Automaton):
        known = docs.sparkSession.sparkContext.broadcast(part)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                old = batch.column(at).cast(pa.binary()).to_pylist()
                new = [(None, 0) if t is None else cut(t, known.value) for t in old]
                counts = [len(words_of(t or b"")) if c < 0 else c for t, c in zip(old, batch.column(n).to_pylist())]
                cuts = [c + now for c, (_, now) in zip(batch.column(n + 1).to_pylist(), new)]
                columns = [*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())]
                columns[at] = pa.array([t for t, _ in new], pa.binary()).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return each

    total = None
    while True:
        for i, part in enumerate(parts):
            rows = (materialise(rows, "cut") if i else rows).mapInArrow(pass_of(part), rows.schema)
        if len(parts) == 1:
            break
        rows = materialise(rows, "cut")  # what one part cuts may bring words of another part's window together
        before, total = total, rows.agg(F.sum(gone)).first()[0]
        if total == before or not total:
            break
    return rows.where(F.col(gone) <= F.col(words) * most_coverage).drop(words, gone)
