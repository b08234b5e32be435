"""Byte-level BPE encoding and decoding over a rank file, in padded numpy matrices.

A text is split by a pattern. Matches that are no token by themselves are merged together: matches of similar
length are the rows of a padded matrix of token ids, and in each round every row merges its leftmost pair of
least rank. Pairs are looked up in a hash table of all pairs of tokens that make a token. Rows that have no pair
left leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import kept, pieces

NONE = np.iinfo(np.int32).max
#: rows by length up to this one are matrices; a longer match would take as many rounds as it has bytes
LONGEST_ROW = 512
CELLS = 1 << 20
MOST_CACHED = 500_000
#: matches kept from batch to batch are at most this long
SHORT = 64
#: characters of texts that are split at once
TOGETHER = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_list(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Tokens by id."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class PairTable:
    """Hash table with open addressing: pair of ids to the id of the token that they make."""

    def __init__(self, ranks: dict[bytes, int]):
        made = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, value = (np.array(x, np.int64) for x in (zip(*made) if made else ((), (), ())))
        key = left << 32 | right
        bits = max(4, int(len(key) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        place, todo, self.steps = self._place(key), np.arange(len(key)), 0
        while len(todo):  # who is first at a free place gets it, the others go on
            free = todo[self.keys[place[todo]] < 0]
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[place[won]], self.values[place[won]] = key[won], value[won]
            todo = todo[self.keys[place[todo]] != key[todo]]
            place[todo] = place[todo] + 1 & self.mask
            self.steps += 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * MULTIPLIER >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs make; NONE where they make no token or an id is -1."""
        key = left.astype(np.int64) << 32 | right
        place = self._place(key)
        at = self.keys[place]
        out = np.where((at == key) & (key >= 0), self.values[place], NONE).astype(np.int32)
        todo = np.flatnonzero((at != key) & (at >= 0) & (key >= 0))
        for _ in range(self.steps):
            if not len(todo):
                break
            place[todo] = place[todo] + 1 & self.mask
            at = self.keys[place[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.values[place[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


@lru_cache(maxsize=8)
def splitter(pattern: str) -> str:
    r"""`pattern` for Python's `re`, with `\p{L}`, `\p{N}`, `\s` and `\S` spelled out as the tokenizer library has them.

    Two regular expression libraries know different versions of Unicode; the classes are asked of the library
    whose splits are wanted, by matching every code point with them.
    """
    import sys

    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    singles = {bytes([b]): b for b in range(256)}

    def members(name: str) -> str:
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=singles, special_tokens={})
        codes = np.array([ord(c) for c in coder.decode_bytes(coder.encode_ordinary(every)).decode()])
        starts = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
        ends = np.append(starts[1:], len(codes)) - 1
        return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(starts, ends))

    classes = {name: members(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, depth, at = [], 0, 0
    while at < len(pattern):
        name = next((x for x in (*classes, r"\S") if pattern.startswith(x, at)), None)
        if name == r"\S":
            if depth:
                raise ValueError(r"\S inside of a class isn't supported")
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif name:
            out.append(classes[name] if depth else f"[{classes[name]}]")
        else:
            step = 2 if pattern[at] == "\\" else 1
            depth += (pattern[at] == "[") - (pattern[at] == "]")
            out.append(pattern[at : at + step])
            at += step
            continue
        at += len(name)
    return "".join(out)


def _plane(split: str) -> str:
    """A pattern of `splitter` for texts without code points over U+FFFF: `re` looks such classes up in a bitmap."""

    def part(found: re.Match) -> str:
        first, last = int(found[1], 16), min(int(found[2], 16), 0xFFFF)
        return f"\\U{first:08x}-\\U{last:08x}" if first <= last else ""

    return re.sub(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", part, split)


class Coder:
    """Encodes and decodes by ranks, which are the ids as well. `split` is a pattern of `splitter`."""

    def __init__(self, ranks: dict[bytes, int], split: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"single bytes without a rank: {missing[:5]}")
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = token_list(ranks)
        self.split, self.split_plane = re.compile(split), re.compile(_plane(split))
        self.cut = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")
        self.cache: dict[str, bytes] = {}

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids of rows of bytes of similar length, merged together, as little-endian 32-bit integers."""
        sizes = np.array([len(r) for r in rows])
        width = int(sizes.max())
        ids = np.full((len(rows), width + 1), -1, "<i4")
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
        out: list = [None] * len(rows)
        place = np.arange(len(rows))
        while len(place):
            at = rank.argmin(axis=1)
            every = np.arange(len(place))
            least = rank[every, at]
            if (ended := least == NONE).any():
                done, held = ids[ended].tobytes(), 4 * ids.shape[1]
                for k, (row, size) in enumerate(zip(place[ended].tolist(), sizes[ended].tolist())):
                    out[row] = done[k * held : k * held + 4 * size]
                stay = ~ended
                place, ids, rank, sizes, at, least = place[stay], ids[stay], rank[stay], sizes[stay], at[stay], least[stay]
                if not len(place):
                    break
                width = int(sizes.max())
                ids, rank, every = ids[:, : width + 1], rank[:, :width], np.arange(len(place))
            # everything after the merged pair moves one place to the left
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[every, at] = least
            rank[:, :-1] = np.where(after[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            sizes = sizes - 1
            rank[every, at] = self.pairs(least, ids[every, at + 1])
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs(ids[before, at[before] - 1], least[before])
        return out

    def merge_long(self, text: bytes) -> bytes:
        """Ids of one long run of bytes: the same merges in the same order, from a heap of pairs."""
        ids = self.byte_ids[np.frombuffer(text, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        queue = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(queue)
        parts: list = [bytes([b]) for b in text]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        get, push = self.ranks.get, heapq.heappush
        while queue:
            rank, i = heapq.heappop(queue)
            if parts[i] is None or (j := after[i]) < 0 or get(whole := parts[i] + parts[j]) != rank:
                continue  # one of the two is merged already
            parts[i], parts[j], after[i] = whole, None, after[j]
            if (k := after[i]) >= 0:
                before[k] = i
                if (found := get(whole + parts[k])) is not None:
                    push(queue, (found, i))
            if (k := before[i]) >= 0 and (found := get(parts[k] + whole)) is not None:
                push(queue, (found, k))
        return np.array([self.ranks[p] for p in parts if p is not None], "<i4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        rows: dict[int, tuple[list[str], list[bytes]]] = {}
        rank_of = self.ranks.get
        for piece in new:
            data = piece.encode()
            if (rank := rank_of(data)) is not None:  # a match that is a token stays whole, whatever its pairs would make
                found[piece] = rank.to_bytes(4, "little")
            elif len(data) > LONGEST_ROW:
                found[piece] = self.merge_long(data)
            else:
                names, some = rows.setdefault((len(data) + 3 >> 2 if len(data) <= 32 else 8 * len(data).bit_length()), ([], []))
                names.append(piece)
                some.append(data)
        for names, some in rows.values():
            step = max(1, CELLS // max(map(len, some)))
            for at in range(0, len(some), step):
                found.update(zip(names[at : at + step], self.merge_rows(some[at : at + step])))
        return found

    def _segments(self, text: str) -> list[str]:
        """Cuts a very long text before white space that follows something else: no match crosses such a place."""
        out, at = [], 0
        while len(text) - at > TOGETHER and (end := self.cut.search(text, at + TOGETHER)):
            out.append(text[at : end.start()])
            at = end.start()
        return [*out, text[at:]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        split = [(self.split_plane if len(t.encode("utf-16-le")) == 2 * len(t) else self.split).findall(t) for t in texts]
        known = [list(map(cache.get, found)) for found in split]
        new: set[str] = set()
        for found, ids in zip(split, known):
            if None in ids:
                new.update(compress(found, map(is_, ids, repeat(None))))
        learned = self._learn(list(new))
        out = [b"".join([learned[p] if x is None else x for p, x in zip(found, ids)] if None in ids else ids) for found, ids in zip(split, known)]
        cache.update(learned)
        if len(cache) > MOST_CACHED:  # what is frequent is in use
            self.cache = {p: cache[p] for p in set().union(*split) if len(p) <= SHORT}
        for piece in new:
            if len(piece) > SHORT:
                self.cache.pop(piece, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids per text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            if len(texts[at]) > TOGETHER:
                out.append(b"".join(x for part in self._segments(texts[at]) for x in self._encode([part])))
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(ranks_file: str, split: str) -> Coder:
    return kept(("byte_bpe", ranks_file, split), lambda: Coder(read_ranks(ranks_file), split))


def _grouped(sizes: list[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` characters together, one row at least."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): one row per row of docs, its whole text encoded, and its ids decoded.

    ids are little-endian unsigned 32-bit integers, decoded is bytes. A null text counts as empty: no ids, no
    bytes. Rows with null or repeated ids stay rows of their own; other columns are left out. Control strings
    inside texts are ordinary text. The rank file is read on the executors, from a path that they have, as
    installed libraries. A very long text is split in segments, and takes the memory of its ids besides.
    """
    split = splitter(pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, split)
        for batch in pieces(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for at, end in _grouped([len(t) for t in texts]):
                ids = coder.encode(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, n_tokens long, ids binary, decoded binary")


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of `round_trip`."""
    split = splitter(pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, split)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, end in _grouped([len(t) for t in texts]):
                ids = coder.encode(texts[at:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of each row's ids. Null ids count as none; an unknown id fails the job."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("byte_tokens", ranks_file), lambda: token_list(read_ranks(ranks_file)))
        for batch in pieces(batches):
            rows = [x or b"" for x in batch.column(1).to_pylist()]
            for at, end in _grouped([len(x) for x in rows], 4 * TOGETHER):
                found = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in rows[at:end]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    given = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return given.mapInArrow(each, "doc_id long, decoded binary")
