"""Groups of spelling variants: words one edit apart, found in a bidirectional FM-index of the vocabulary.

Of a word and its neighbour, one edit apart, either the first or the second half of the word is unchanged. A search
matches that half exactly from the delimiter at its end, and goes on across the other half with one error up to
the delimiter there. It works on intervals of suffix ranks in an index that is extended on both sides; as the words
are indexed in order, the rank of a delimited word is its number. Words are dealt to shards by their first and,
once more, by their last characters, so each search needs one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.sources.tables import materialise

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: characters at either end by which words are dealt; half of the shortest word
KEY = LEAST_LENGTH // 2
#: words of one shard on average, fewest shards, and words of one key from which it is split over several shards
SHARD_WORDS, LEAST_SHARDS, HOT_WORDS = 4_000, 32, 20_000
QUERIES = 2048
BLOCK = 32


class Ranks:
    """FM-index of one direction: Burrows-Wheeler transform with counts at every 32nd place."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order, rank, width = np.argsort(text, kind="stable"), text.astype(np.int64), 1
        while True:  # suffixes by their first `width` symbols; a suffix that ends is smaller
            ahead = np.full(n, -1, np.int64)
            ahead[:-width or None] = rank[width:]
            key = rank * (n + sigma + 1) + ahead + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) > 0)
            if rank[order[-1]] == n - 1 or width >= n:
                break
            width *= 2
        self.sigma = sigma
        blocks = n // BLOCK + 1
        last = np.full(blocks * BLOCK, sigma, np.int16)
        last[:n] = text[order - 1]
        self.last = last.reshape(blocks, BLOCK)
        #: symbols under c before each block
        held = np.zeros((blocks, sigma + 1), np.int32)
        inside = np.bincount(np.repeat(np.arange(blocks), BLOCK) * (sigma + 1) + last, minlength=blocks * (sigma + 1)).reshape(blocks, sigma + 1)
        held[1:, 1:] = np.cumsum(np.cumsum(inside[:, :sigma], axis=1), axis=0)[:-1]
        self.held = held
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def at(self, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Before each place, how many symbols are under the given one, and how many are equal."""
        block, rest = np.divmod(place, BLOCK)
        inside = np.arange(BLOCK) < rest[:, None]
        rows, c = self.last[block], symbol[:, None]
        under, upto = self.held[block, symbol], self.held[block, symbol + 1]
        return under + ((rows < c) & inside).sum(1), upto - under + ((rows == c) & inside).sum(1)

    def all_at(self, place: np.ndarray) -> np.ndarray:
        """Before each place, how many symbols are under each symbol, one column more than there are symbols."""
        block, rest = np.divmod(place, BLOCK)
        inside = np.arange(BLOCK) < rest[:, None]
        cells = (np.arange(len(place))[:, None] * (self.sigma + 1) + self.last[block])[inside]
        counts = np.bincount(cells, minlength=len(place) * (self.sigma + 1)).reshape(-1, self.sigma + 1)
        return self.held[block] + np.concatenate([np.zeros((len(place), 1), np.int64), np.cumsum(counts[:, : self.sigma], axis=1)], axis=1)


class Vocabulary:
    """Bidirectional FM-index of sorted distinct words between delimiters. Side 1 goes on to the right, 0 to the left.

    A state is an array (interval start in the index of the text, in that of its reverse, length of both).
    """

    def __init__(self, words: list[str]):
        self.words = words
        codes = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.symbols, text = np.unique(codes, return_inverse=True)
        sigma = len(self.symbols)
        self.index = Ranks(text, sigma), Ranks(text[::-1], sigma)

    def code(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols; -1 for a character that the vocabulary doesn't have."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at, -1).reshape(len(words), -1)

    def extend(self, side: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States with one symbol more, whose intervals may be empty."""
        here = self.index[side]
        known = np.maximum(symbol, 0)
        under, equal = here.at(state[side], known)
        under_end, equal_end = here.at(state[side] + state[2], known)
        out = np.empty_like(state)
        out[side] = here.first[known] + equal
        out[1 - side] = state[1 - side] + under_end - under
        out[2] = np.where(symbol < 0, 0, equal_end - equal)
        return out

    def branches(self, side: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the state, symbol, longer state) for every symbol that goes on, but the delimiter."""
        here = self.index[side]
        start, end = here.all_at(state[side]), here.all_at(state[side] + state[2])
        equal = np.diff(start, axis=1)
        size = np.diff(end, axis=1) - equal
        size[:, 0] = 0
        row, symbol = np.nonzero(size)
        out = np.empty((3, len(row)), np.int64)
        out[side] = here.first[symbol] + equal[row, symbol]
        out[1 - side] = state[1 - side][row] + (end - start)[row, symbol]
        out[2] = size[row, symbol]
        return row, symbol, out

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, number of the indexed word): words one edit away in the half on the given side.

        The queries have one length. Side 1 leaves the first half as it is, side 0 the second.
        """
        codes = self.code(words)
        length = codes.shape[1]
        exact = length // 2 if side else length - length // 2
        codes = codes if side else codes[:, ::-1]
        every = np.arange(len(words))
        delimiters = int(self.index[0].first[1])
        state = np.array([[0], [0], [delimiters]]) + np.zeros(len(words), np.int64)

        def going(rows: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            alive = states[2] > 0
            return rows[alive], states[:, alive]

        for j in range(exact):
            every, state = going(every, self.extend(side, state, codes[every, j]))
        erring, errors = np.empty(0, np.int64), np.empty((3, 0), np.int64)
        for j in range(exact, length):
            row, symbol, branch = self.branches(side, state)
            query = every[row]
            other = symbol != codes[query, j]
            # inserted symbols wait for the same character of the query as the errors before them
            erring, errors = np.append(erring, query), np.append(errors, branch, axis=1)
            erring, errors = going(erring, self.extend(side, errors, codes[erring, j]))
            erring = np.concatenate([erring, query[other], every])
            errors = np.concatenate([errors, branch[:, other], state], axis=1)
            every, state = going(every, self.extend(side, state, codes[every, j]))
        row, _, branch = self.branches(side, state)
        erring, errors = np.append(erring, every[row]), np.append(errors, branch, axis=1)
        erring, errors = going(erring, self.extend(side, errors, np.zeros(len(erring), np.int64)))
        # the rank of a delimited word is its number, after the delimiter that ends the text
        pairs = np.unique(erring * (len(self.words) + 1) + errors[0] - 1)
        return np.divmod(pairs, len(self.words) + 1)


def _shard(kind: str, words: list[str], counts: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Per query word: near words that this shard has, the largest count among them, and the word that has it."""
    order = sorted(np.flatnonzero(indexed).tolist(), key=words.__getitem__)
    index, held = Vocabulary([words[i] for i in order]), counts[order]
    n_near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, some in by_length.items():
        for at in range(0, len(some), QUERIES):
            asked = some[at : at + QUERIES]
            query, found = index.near([words[i] for i in asked], int(kind == "first"))
            if kind == "last":  # what the other search finds as well counts there
                half = length // 2
                own = np.array([index.words[f][:half] != words[asked[q]][:half] for q, f in zip(query.tolist(), found.tolist())], bool)
                query, found = query[own], found[own]
            np.add.at(n_near, np.array(asked)[query], 1)
            ranked = np.lexsort((found, -held[found], query))
            for k in ranked[np.unique(query[ranked], return_index=True)[1]].tolist():
                best_n[asked[query[k]]], best[asked[query[k]]] = held[found[k]], index.words[found[k]]
    return n_near, best_n, best


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, near): per word the count of words one edit away, and the one of them with the largest n.

    vocabulary is a written table of distinct words (word, n) of at least LEAST_LENGTH characters. Of equal n the
    first word in code-point order counts. Links stay in their tasks; a word leaves one row per shard it asks.
    """
    length = F.length("word")
    ends = F.array(F.struct(F.lit("first").alias("kind"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit("last").alias("kind"), F.substring("word", -KEY, KEY).alias("key")))
    routed = vocabulary.where(length >= LEAST_LENGTH).select("word", "n", F.inline(ends))
    keys = materialise(routed.groupBy("kind", "key").agg(F.count("*").alias("words")), "spelling-keys")
    total = keys.where("kind = 'first'").agg(F.sum("words")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_WORDS))
    hot = keys.where(F.col("words") > HOT_WORDS).select("kind", "key", F.ceil(F.col("words") / HOT_WORDS).cast("int").alias("parts"))
    dealt = routed.join(hot, ["kind", "key"], "left").withColumn("bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(shards)))
    part = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.col("parts").isNull() | (F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part"))
    spread = dealt.withColumn("part", part).select("kind", F.when(F.col("parts").isNull(), F.lit("")).otherwise(F.col("key")).alias("key"), "bucket", "part", "word", "n", own.alias("indexed"))

    def search(group: pa.Table) -> pa.Table:
        words, counts = group.column("word").to_pylist(), group.column("n").to_numpy()
        n_near, best_n, best = _shard(group.column("kind")[0].as_py(), words, counts, np.array(group.column("indexed").to_pylist(), bool))
        return pa.table({"word": group.column("word"), "n": group.column("n"), "n_near": n_near, "best_n": best_n, "best": pa.array(best, pa.string())})

    found = spread.groupBy("kind", "key", "bucket", "part").applyInArrow(search, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("near"))))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): for each row (word, form) of a table of pointers without cycles, the last form that they lead to.

    Each round doubles the steps that a pointer spans, and is written to the shared folder.
    """
    reached = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while reached.where("moved").limit(1).count():
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = reached.select("word", "root").join(further, "root", "left")
        reached = materialise(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
    return reached.select("word", "root")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): maximal runs of letters of at least LEAST_LENGTH code points, A-Z in lower case; one row each.

    Null and empty texts have no runs; rows with null or repeated ids count like any other.
    """
    found = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), F.lit(1))
    listed = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))
    return listed.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))


def variants(words: DataFrame, word: str | Column = "word", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of at least LEAST_LENGTH code points and `least_count` rows.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
    near word with the largest n (of equals the first in code-point order) if that is at least `ratio` times its own
    n, else null; root is the last of the forms that follow each other from it, or the word itself. Null words are left out;
    an empty table gives an empty result.
    """
    column = F.col(word) if isinstance(word, str) else word
    counted = words.select(column.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = materialise(counted.where(F.col("n") >= least_count), "spelling-words")
    follows = F.col("near_n") >= ratio * F.col("n")
    near = near_words(vocabulary).select("word", "n", "n_near", F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n"))
    near = materialise(near, "spelling-near")
    led = roots(near.where("form IS NOT NULL"))
    return near.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
