"""Packing of tokenised documents into sequences of several lengths.

Whole windows of a long document are sequences by themselves. What is left of a document is routed to the
smallest tier that holds it. A sequence starts with the longest rest at hand, of its tier's length, and its gap
is filled with rests of shorter tiers, the best fitting first; the last piece of it is cut to fit. So every
sequence is full, except for the last few tokens of a task, which are put together over several tasks.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.batches import kept, pieces
from panelloom.sources.tables import materialise

MOST_CACHED = 400_000
SHORT = 64
MARKS = b".,;:!?*#%&$|"


class WordEncoder:
    """Ids of a lower-casing word BPE, whose tokens never cross ASCII white space, kept per run of other characters."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, runs: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Runs and their ids, encoded a thousand to a text: the places of the tokens tell the runs apart."""
        for at in range(0, len(runs), 1000):
            part = runs[at : at + 1000]
            words = [r.decode() for r in part]
            found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.array([start for start, _ in found.offsets], np.int64)
            bounds = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
            yield from zip(part, map(ids.__getitem__, map(slice, bounds, bounds[1:])))

    def _learn_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The same for runs of small letters in normal form, which no step before the merging changes: each
        is one word for the merges, and its last id, alone, is one that ends a word."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            (found,) = self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            bounds = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            ids = ids.tobytes()
            yield from zip(part, map(ids.__getitem__, map(slice, bounds, bounds[1:])))

    def _add(self, new: list[bytes]) -> None:
        """A letter or digit and the marks after it never share a token: a run is its core and its marks."""
        cache, other, cut = self.cache, set(), []
        letters: set[bytes] = set()
        for run in new:
            core = run.rstrip(MARKS)
            text = core.decode()
            if text.isalpha() and text.islower() and text == text.lower() and is_normalized("NFC", text):
                letters.add(core)
            elif len(core) < len(run) and (core[-1:].isalnum() or core and normalize("NFC", text).lower()[-1].isalpha()):
                other.add(core)
            else:
                other.add(run)
                continue
            if len(core) < len(run):
                other.add(run[len(core) :])
                cut.append((run, core))
        cache.update(self._learn_words([w for w in letters if w not in cache]))
        cache.update(self._learn([w for w in other if w not in cache]))
        for run, core in cut:
            cache[run] = cache[core] + cache[run[len(core) :]]

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers, and `end`; null texts are empty.

        The tokenizer lower-cases, so A-Z may go first, unless the text could hold a special token in capitals or
        a mark that composes with one case of a letter only. Each run is looked up once per call.
        """
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, "[\u0300-\u033f]|<\\|"), texts, pc.ascii_lower(texts)))
        runs = split.flatten().dictionary_encode()
        used = runs.dictionary.cast(pa.binary()).to_pylist()
        if len(self.cache) > MOST_CACHED:  # what is frequent is in use
            self.cache = {r: self.cache[r] for r in used if r in self.cache}
        new = [r for r in used if r and r not in self.cache]
        self._add(new)
        found = [self.cache[r] if r else b"" for r in used]
        for run in new:
            if len(run) > SHORT:
                self.cache.pop(run, None)
                self.cache.pop(run.rstrip(MARKS), None)

        # the ids of all runs in order: each run's place among the found ones, counted up
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        codes = runs.indices.to_numpy()
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [ids[lo:hi].tobytes() + end for lo, hi in zip(bounds, bounds[1:])]


class Packer:
    """Packs the documents of one task; keeps at most about `block` tokens of them."""

    def __init__(self, window: int, tiers: Sequence[int], block: int):
        self.window, self.tiers, self.block = window, sorted({*tiers, window}), block
        self.rests: list[tuple[int, int, int]] = []  # (tokens, document, start), sorted
        self.docs: dict[int, tuple] = {}  # document: key, ids, its rests
        self.held, self.numbers, self.sequences, self.by_tier = 0, 0, 0, dict.fromkeys(self.tiers, 0)
        self.out: list[tuple] = []

    def _piece(self, doc: int, start: int, length: int, offset: int, tier: int | None) -> None:
        key, ids, _ = self.docs[doc]
        part = memoryview(ids)[4 * start : 4 * (start + length)]
        self.out.append((key, start, length, zlib.crc32(part), len(ids) // 4, None if tier is None else self.sequences, offset, tier, None if tier is None else self.by_tier[tier], part))

    def _close(self, tier: int | None) -> None:
        if tier is not None:
            self.sequences += 1
            self.by_tier[tier] += 1

    def add(self, key, ids: bytes) -> None:
        doc, n = self.numbers, len(ids) // 4
        self.numbers += 1
        self.docs[doc] = [key, ids, 0]
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            self._piece(doc, start, self.window, 0, self.window)
            self._close(self.window)
        if n > whole:
            self._rest(n - whole, doc, whole)
            self.held += n - whole
        else:
            del self.docs[doc]
        if self.held > self.block:
            self.drain(self.block // 2)

    def _rest(self, tokens: int, doc: int, start: int) -> None:
        insort(self.rests, (tokens, doc, start))
        self.docs[doc][2] += 1

    def _take(self, at: int, most: int) -> tuple[int, int, int]:
        """The rest at a place of the list; one that is longer than `most` is cut and what is left stays."""
        tokens, doc, start = self.rests.pop(at)
        self.docs[doc][2] -= 1
        if tokens > most:
            self._rest(tokens - most, doc, start + most)
            tokens = most
        self.held -= tokens
        return tokens, doc, start

    def _sequence(self, tier: int) -> None:
        """One full sequence; at least `tier` tokens are held."""
        gap = tier
        while gap:
            at = bisect_right(self.rests, (gap, self.numbers, 0)) - 1  # the longest that fits, else cut the shortest
            tokens, doc, start = self._take(max(at, 0), gap)
            self._piece(doc, start, tokens, tier - gap, tier)
            self._done(doc)
            gap -= tokens
        self._close(tier)

    def _done(self, doc: int) -> None:
        if not self.docs[doc][2]:
            del self.docs[doc]

    def drain(self, least: int) -> None:
        """Packs until at most `least` tokens are held, the longest rest and its tier first."""
        while self.held > least:
            tier = self.tiers[bisect_left(self.tiers, self.rests[-1][0])]
            if tier > self.held:
                return
            self._sequence(tier)

    def finish(self) -> None:
        """Packs all but less than the shortest tier, which leaves as pieces without a sequence."""
        self.drain(0)
        for tier in reversed(self.tiers):
            while self.held >= tier:
                self._sequence(tier)
        offset = 0
        while self.rests:
            tokens, doc, start = self._take(len(self.rests) - 1, self.window)
            self._piece(doc, start, tokens, offset, None)
            self._done(doc)
            offset += tokens

    def flush(self, part: int, with_ids: bool) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [[]] * 10
        ids = [bytes(p) for p in columns[9]] if with_ids else [None] * len(self.out)
        sequence = [None if s is None else (part << 32) + s for s in columns[5]]
        arrays = [pa.array(columns[0], pa.int64()), *(pa.array(columns[i], pa.int64()) for i in (1, 2, 3, 4)), pa.array(sequence, pa.int64()), pa.array(columns[6], pa.int64()), pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64()), pa.array([part] * len(self.out), pa.int64()), pa.array(ids, pa.binary())]
        self.out = []
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, tier_index long, part long, ids binary"


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = 4096, tiers: Sequence[int] = (256, 512, 1024, 2048), step_tokens: int = 65_536, block: int = 1 << 20, merged: int = 16, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step, ids).

    A document is its ids and end_id. Each id lies in exactly one piece; the pieces of a sequence lie in it one
    after another. Sequences have exactly the length of their tier, except those that hold what was left over by
    `merged` tasks, each less than the shortest tier: they are of tier `window`, and only they need padding.
    step: groups of sequences of one tier with step_tokens tokens each, the last group of a tier may have less.

    Tokens are packed where the documents are read: no text and no id is shuffled, and a task holds `block`
    tokens beside one document. Only the short list of pieces is written, to the shared folder, and then the
    leftovers are put together and steps numbered. A null text counts as empty: one piece with end_id. Null and
    repeated ids stay documents of their own. An empty table has no pieces. merged * (shortest tier - 1) must not
    exceed the window.
    """
    if merged * (min(tiers) - 1) > window or step_tokens % window:
        raise ValueError("the leftovers of `merged` tasks must fit in a window, and steps hold whole windows")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, part = kept(("words", tokenizer_file), lambda: WordEncoder(tokenizer_file)), Packer(window, tiers, block), TaskContext.get().partitionId()
        for rows in pieces(batches):
            for key, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1), end_id.to_bytes(4, "little"))):
                packer.add(key, ids)
                if len(packer.out) > 5_000 or with_ids:
                    yield packer.flush(part, with_ids)
        packer.finish()
        yield packer.flush(part, with_ids)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = materialise(given.mapInArrow(each, PIECES), "pieces")

    group = F.floor(F.col("part") / merged).cast("long")
    order = Window.partitionBy("group").orderBy("part", "offset").rowsBetween(Window.unboundedPreceding, -1)
    tails = cut.where("sequence_id IS NULL").withColumn("group", group)
    tails = tails.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).withColumns({"sequence_id": -1 - F.col("group"), "tier": F.lit(window)})

    # a step is numbered over all tasks: a task's first sequence of a tier follows the last of the task before
    counted = cut.where("offset = 0 AND sequence_id IS NOT NULL").groupBy("tier", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("tier", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    step = F.floor((F.col("first") + F.col("tier_index")) * F.col("tier") / step_tokens).cast("long")
    full = cut.where("sequence_id IS NOT NULL").join(firsts, ["tier", "part"]).withColumn("step", step)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step", "ids"]
    last = tails.withColumn("step", -1 - F.floor(F.col("group") * window / step_tokens).cast("long"))
    return full.select(columns).union(last.select(columns))
