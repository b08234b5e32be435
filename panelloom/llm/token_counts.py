"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes.

For byte-pair merging by rank, a list of tokens is the encoding of its text if and only if each token is the
encoding of its own text and each two neighbours are the encoding of theirs. So each prefix has one last
token t that fits the last token of the prefix before t, and count(prefix) = count(prefix before t) + 1.
The table answers where to cut a text for a budget of tokens, and what a cut costs, without encoding again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from operator import add, sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import kept, pieces

SPACE = "▁"
PART, WHOLE = 1, 2
MOST_CACHED = 700_000
SHORT = 64
#: characters of texts that are counted together; their new chunks share the table of common prefixes
TOGETHER = 8_000_000


class PrefixCounter:
    """Counts of a BPE model file of sentencepiece that marks spaces by U+2581 and falls back to bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        # no piece holds a space after another character, so no token crosses the start of a run of spaces
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces of this model hold inner spaces")
        alone = {c for p in self.score if len(p) > 1 for c in p}
        breaks = "".join(re.escape(c) for c in "\n\t" if c not in alone)  # and none crosses these
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|[{breaks}]" if breaks else ""))
        # tokens by their text: WHOLE for tokens, PART for what is only the end of one
        self.kind: dict[str, int] = {}
        for piece in self.score:
            if len(piece) == 1 or self._merge(piece) == [piece]:
                for i in range(len(piece)):
                    self.kind.setdefault(piece[i:], PART)
                self.kind[piece] = WHOLE
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text: the pair that makes the best piece is merged first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        while True:
            best, at = -np.inf, -1
            for i, pair in enumerate(map(add, parts, parts[1:])):
                if (now := score(pair)) is not None and now > best:
                    best, at = now, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: str, right: str) -> bool:
        if len(self.fits) > MOST_CACHED:
            self.fits.clear()
        found = self.fits[left, right] = self._merge(left + right) == [left, right]
        return found

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Per chunk, as int16, the growth of its count with each character.

        In sorted order a chunk goes on from the table of the prefix that it shares with the one before.
        """
        kind, known, fit, score = self.kind.get, self.fits.get, self._fit, self.score
        out, before, last, counts = {}, "", [""], [0]
        for chunk in sorted(chunks):
            same = 0
            for x, y in zip(before, chunk):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(chunk) + 1):
                start, starts = end - 1, []
                while start >= 0 and (found := kind(chunk[start:end])):
                    if found == WHOLE:
                        starts.append(start)
                    start -= 1
                for start in reversed(starts):
                    pair = last[start], chunk[start:end]
                    if not start or (ok if (ok := known(pair)) is not None else fit(*pair)):
                        last.append(pair[1])
                        counts.append(counts[start] + 1)
                        break
                else:  # a character of its own, in bytes unless the model has it
                    token = chunk[end - 1]
                    last.append(token)
                    counts.append(counts[-1] + (1 if token in score else len(token.encode())))
            before = chunk
            out[chunk] = array("h", map(sub, counts[1:], counts)).tobytes()
        return out

    def growths(self, texts: list[str]) -> list[bytes]:
        """Per text, as int16 per character, by how much it changes the count of the prefix before it."""
        split = [self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        used = set().union(*split)
        if len(self.cache) > MOST_CACHED:  # what is frequent is in use
            self.cache = {c: self.cache[c] for c in used if c in self.cache}
        cache = self.cache
        new = [c for c in used if c not in cache]
        cache.update(self._learn(new))
        out = []
        for chunks in split:
            steps = b"".join(map(cache.__getitem__, chunks))
            # the mark before the first character counts with it
            out.append(np.frombuffer(steps[:4], np.int16).sum(dtype=np.int16).tobytes() + steps[4:] if steps else b"")
        for chunk in new:
            if len(chunk) > SHORT:
                del cache[chunk]
        return out

    def growth(self, text: str) -> tuple[int, bytes]:
        """Tokens of a text, and its table."""
        (steps,) = self.growths([text])
        return tokens_at(steps, len(text)), steps


def counts(growth: bytes) -> np.ndarray:
    """Tokens of every prefix, the empty one included."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(growth, np.int16), dtype=np.int64)])


def tokens_at(growth: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters."""
    return int(np.frombuffer(growth, np.int16, min(chars, len(growth) // 2)).sum(dtype=np.int64))


def longest_prefix(growth: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts(growth) <= budget)[-1])


def prefix_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, growth): one row per row of docs, over the whole text.

    growth is the table of the prefixes: an int16 per character, see `counts`, `tokens_at` and
    `longest_prefix`. A null text counts as empty: no bytes, no tokens, an empty table. Rows with null or
    repeated ids stay rows of their own; other columns are left out. The model file is read on the
    executors, from a path that they have, as installed libraries.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("prefixes", model_file), lambda: PrefixCounter(model_file))
        for batch in pieces(batches, 2000):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                found = counter.growths(part)
                totals = [tokens_at(g, len(t)) for g, t in zip(found, part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at:end], pa.int64()), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(totals, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "growth"]
                )
                at = end

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, growth binary")


def truncations(counted: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(doc_id, budget, chars, n_tokens): per row of `prefix_counts` and budget the longest prefix that fits in it,
    and the tokens of that prefix, read off the table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, growth in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = counts(growth.as_py())
                for budget in budgets:
                    chars = int(np.flatnonzero(table <= budget)[-1])
                    out.append((key, budget, chars, int(table[chars])))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "budget", "chars", "n_tokens"])

    return counted.select("doc_id", "growth").mapInArrow(each, "doc_id long, budget long, chars long, n_tokens long")
