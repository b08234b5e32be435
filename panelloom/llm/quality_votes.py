"""Quality scores by the votes of the nearest labelled documents in a latent-semantic space.

Terms are words, as the small letters in them, hashed; word forms: a word with its letters replaced by
their kind (capitals, a capital first, small), its digits by one 0, runs of a character cut to two; and two
counts of repetition. Their frequencies, weighted by rarity, are projected onto the leading singular
directions of the labelled documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import kept, pieces

FORMS = 1024
WORDS = 2048
TERMS = FORMS + 2 + WORDS
#: a term of a vector that is not 0
ENTRY = np.dtype([("term", "<u2"), ("value", "<f4")])
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
RUNS = re.compile(r"(.)\1+", re.S)
MOST_CACHED = 200_000


def _kind(match: re.Match) -> str:
    word = match[0]
    return "A" if len(word) > 1 and word.isupper() else "Aa" if word[0].isupper() else "a"


def _number(word: str, known: dict[str, int]) -> int:
    """The numbers of a word and its form in one; a word without letters has the number WORDS."""
    form = RUNS.sub(r"\1\1", DIGITS.sub("0", LETTERS.sub(_kind, word)))
    letters = "".join(LETTERS.findall(word)).lower()
    number = (zlib.crc32(letters.encode()) % WORDS if letters else WORDS) * FORMS + zlib.crc32(form.encode()) % FORMS
    if len(word) <= 64:
        if len(known) >= MOST_CACHED:
            known.clear()
        known[word] = number
    return number


def frequencies(text: str) -> np.ndarray:
    """Roots of the share of each term among the words of a whole text; zeros without words."""
    words, known = text.split(), kept("forms", dict)
    out = np.zeros(TERMS, np.float32)
    if words:
        numbers = np.array([n if (n := known.get(w)) is not None else _number(w, known) for w in words])
        out[:FORMS] = np.bincount(numbers % FORMS, minlength=FORMS)
        out[FORMS] = sum(map(str.__eq__, words, words[1:]))
        out[FORMS + 1] = len(words) - len(set(words))
        out[FORMS + 2 :] = np.bincount(numbers // FORMS, minlength=WORDS + 1)[:WORDS]
        out /= len(words)
    return np.sqrt(out)


@dataclass(frozen=True)
class Votes:
    """Labelled vectors of unit length, their labels, and how texts get there. Bounded by the fit's parameters."""

    rarity: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text the labels of its nearest labelled vectors, weighted by cosine: exact products, in blocks."""
        out = []
        for at in range(0, len(texts), 256):
            given = np.array([frequencies(t) for t in texts[at : at + 256]])
            out.append(self._vote(_unit(given * self.rarity @ self.space)))
        return np.concatenate(out) if out else np.empty(0)

    def _vote(self, given: np.ndarray) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(given), prior)
        cosines = given @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.take_along_axis(cosines, at, 1).clip(0).astype(np.float64)
        total = weights.sum(axis=1)
        return np.where(total > 0, (weights * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1), prior).clip(0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = 4096, dims: int = 16, neighbours: int = 15) -> Votes:
    """Learns from at most most_labelled labelled documents that are not held out, drawn by a hash of the id.

    Rows with a null id or label are no labels; an id with several labels counts with their mean, and one with
    several texts with the smallest. Without any label all scores are 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = known.where(~held_out("id")).groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most most_labelled pairs of numbers are broadcast, and as many vectors of fixed length come back
    drawn = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [_packed(frequencies(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "vector"])

    rows = sorted(drawn.mapInArrow(each, "id long, label double, vector binary").collect())
    seen = np.zeros(TERMS, np.int64)
    for r in rows:
        seen[np.frombuffer(r.vector, ENTRY)["term"]] += 1
    rarity = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, len(rows), 256):
            given = np.zeros((len(rows[at : at + 256]), TERMS), np.float32)
            for out, r in zip(given, rows[at : at + 256]):
                entries = np.frombuffer(r.vector, ENTRY)
                out[entries["term"]] = entries["value"]
            yield given * rarity

    space = _directions(blocks, dims).astype(np.float32)
    vectors = np.vstack([np.zeros((0, dims), np.float32), *(_unit(x @ space) for x in blocks())]).astype(np.float32)
    return Votes(rarity, space, vectors, np.array([r.label for r in rows]), neighbours)


def _packed(vector: np.ndarray) -> bytes:
    """The terms of a vector that are not 0, with their values."""
    out = np.empty(np.count_nonzero(vector), ENTRY)
    out["term"] = np.flatnonzero(vector)
    out["value"] = vector[out["term"]]
    return out.tobytes()


def _directions(blocks: Callable[[], Iterator[np.ndarray]], dims: int) -> np.ndarray:
    """The leading right singular directions of the rows in all blocks, by subspace iteration until they stand still:
    only one block is in memory."""
    basis, last = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, 2 * dims)))[0], np.zeros(dims)
    for _ in range(200):
        image = np.zeros_like(basis)
        for x in blocks():
            image += x.T @ (x @ basis)
        sizes, turn = np.linalg.eigh(basis.T @ image)
        found, sizes = (basis @ turn)[:, ::-1][:, :dims], sizes[::-1][:dims]
        if np.abs(sizes - last).max() <= 1e-9 * max(sizes[0], 1e-30):
            break
        basis, last = np.linalg.qr(image)[0], sizes
    return found


def score(docs: DataFrame, votes: Votes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of docs, from the whole text; higher means label 1 is likelier.

    Null and empty texts, and those without a similar labelled one, score the mean of the labels.
    """
    model = docs.sparkSession.sparkContext.broadcast(votes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = model.value.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(each, "doc_id long, score double")


def keep(docs: DataFrame, votes: Votes, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs with a score of at least `least`, with all their columns and no join."""
    model, at = docs.sparkSession.sparkContext.broadcast(votes), docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.value.scores([t or "" for t in batch.column(at).to_pylist()]) >= least))

    return docs.mapInArrow(each, docs.schema)
