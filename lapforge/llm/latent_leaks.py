"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) are TF-IDF vectors over the vocabulary of the benchmark, with document frequencies
counted over all documents. A randomised SVD, whose passes over the passages of all documents and of the benchmark
are distributed, gives a latent space. Every window of every document is projected and compared with every item by cosine. What
passes is checked on the words: the longest common subsequence must cover most of the item, and the item's
answer (its last line, or last sentence) must be there as well, so changed words, insertions and deletions are
found and mere similarity of topic is not.

The benchmark is the stated query set; it is taken in blocks of ``BLOCK_ITEMS`` items, so what a task holds does
not grow with it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches
from lapforge.llm.texts import chunks, word_hashes

BLOCK_ITEMS = 1_000
PASSAGES = 32           # passages that are multiplied at once
RANK, OVERSAMPLE, POWER = 128, 8, 1
WINDOWS = (24, 64)      # words of a passage; neighbours overlap by half
CELL = 4                # words that are summed first; divides the half windows
SPACING = 96            # multiple of the half windows, more than a window
PLACES = 300 * SPACING  # words whose vectors are held at once
COSINE = 0.55           # finds all of 190 items with their rarest 35 % of words replaced (README)
COVER = 0.6             # share of an item's words that the common subsequence must have
ANSWER = 0.5            # the same for the answer
PRECISION = 0.5         # share of item words in the stretch that the common subsequence spans


def answer_of(text: str) -> str:
    """The last line of a text with several, else its last sentence."""
    lines = [x for x in text.split("\n") if x.split()]
    if len(lines) > 1:
        return lines[-1]
    return ([x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if x.split()] or [""])[-1]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence of ``a`` and ``b``, and the shortest stretch from the start of
    ``b``'s used part that reaches it (words of ``b`` up to the last useful one). Bit-parallel in ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, best, last = full, 0, 0
    for j, x in enumerate(b.tolist()):
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            found = len(a) - v.bit_count()
            if found > best:
                best, last = found, j + 1
    return best, last


def subsequence_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of ``size``, given by the places of its words as bit
    masks, and ``words``, all of which it has."""
    full = v = (1 << size) - 1
    for x in words:
        u = v & masks[x]
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def check_words(item: np.ndarray, answer: np.ndarray, region: np.ndarray) -> tuple[int, bool]:
    """(common subsequence, accepted) of an item and a stretch of a document, both as word hashes."""
    length, stop = common_subsequence(item, region)
    if length < COVER * len(item):
        return length, False
    # the same from the end gives the start of the stretch
    _, back = common_subsequence(item[::-1], region[:stop][::-1])
    used = region[stop - back:stop]
    if length < PRECISION * len(used):
        return length, False
    return length, common_subsequence(answer, used)[0] >= ANSWER * len(answer)


class Block:
    """Word hashes, terms and weights of a block of items; a bounded table that tasks carry."""

    def __init__(self, ids: list, texts: list[str]):
        words, first = word_hashes(pa.array(texts, pa.string()))
        last, bounds = word_hashes(pa.array([answer_of(t) for t in texts], pa.string()))
        self.ids = ids
        self.items = [words[first[i]:first[i + 1]] for i in range(len(ids))]
        self.answers = [last[bounds[i]:bounds[i + 1]] for i in range(len(ids))]
        self.terms = np.unique(words)
        self.index()
        self.needed = np.array([max(1, math.ceil(COVER * len(item) - 1e-9)) for item in self.items])

    def index(self) -> None:
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        # how often each item has each term
        self.counts = np.zeros((len(self.ids), len(self.terms)), np.uint16)
        for i, item in enumerate(self.items):
            t, n = np.unique(self.lookup(item)[1], return_counts=True)
            self.counts[i, t] = np.minimum(n, 65_535)

    def __getstate__(self) -> dict:
        """What tasks carry: the tables that follow from the rest are made anew there, as they would take most of it."""
        return {k: v for k, v in self.__dict__.items() if k not in ("near", "counts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.index()

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and their term numbers."""
        at = np.flatnonzero(self.near[(words >> np.uint64(48)).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return at[:0], at[:0]
        term = np.searchsorted(self.terms, words[at])
        term[term == len(self.terms)] = 0
        hit = self.terms[term] == words[at]
        return at[hit], term[hit]

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Weights of all terms of the items; the common ones weigh little and are never left out."""
        self.idf = np.log((n_docs + 1) / (df + 1)) + 1

    def passages(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, term, weight): the passages of some documents that hold a term, as unit vectors one after the other,
        with the index at which each begins."""
        at, term = self.lookup(words)
        if not len(at):
            return at, term, np.zeros(0)
        size, of = WINDOWS[-1], np.searchsorted(first, at, side="right") - 1
        count = -(-np.diff(first) // size)
        number = (np.cumsum(count) - count)[of] + (at - first[of]) // size
        pairs, n = np.unique(number * np.int64(len(self.terms)) + term, return_counts=True)
        number, term = np.divmod(pairs, len(self.terms))
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        x = n * self.idf[term]
        lengths = np.sqrt(np.add.reduceat(x * x, start))
        return start, term, x / np.repeat(lengths, np.diff(np.r_[start, len(x)]))

    def multiply(self, words: np.ndarray, first: np.ndarray, right: np.ndarray, total: np.ndarray) -> None:
        """Add A'A ``right`` to ``total``, A being the passages of some documents, given as in ``search``."""
        start, term, x = self.passages(words, first)
        bounds = np.r_[start, len(term)]
        for k in range(0, len(start), PASSAGES):
            cuts = bounds[k:k + PASSAGES + 1]
            a, b = cuts[0], cuts[-1]
            own, column = np.unique(term[a:b], return_inverse=True)
            dense = np.zeros((len(cuts) - 1, len(own)))
            dense[np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), column] = x[a:b]
            total[own] += dense.T @ (dense @ right[own])

    def project(self, basis: np.ndarray) -> None:
        """Term vectors, and the items in latent space."""
        self.vectors = np.zeros((len(basis) + 1, basis.shape[1]), np.float32)  # the last one stands for other words
        self.vectors[:-1] = basis * self.idf[:, None]
        latent = np.zeros((len(self.items), basis.shape[1]), np.float32)
        for i, item in enumerate(self.items):
            latent[i] = self.vectors[self.lookup(item)[1]].sum(axis=0)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(document, item number, common words, cosine, first word of the region) of the leaks in some documents, given
        by all their words and the index of each one's first word (n + 1 values)."""
        at, term = self.lookup(words)
        if not len(at):
            return []
        # documents lie apart by more than a window, so no window has words of two
        doc = np.searchsorted(first, at, side="right") - 1
        room = (np.diff(first) // SPACING + 2) * SPACING
        base = np.cumsum(room) - room
        place = base[doc] + at - first[doc]
        ends = base + np.diff(first)
        starts, widths, items, cosines = [], [], [], []
        total = int(base[-1] + room[-1])
        for p in range(0, total, PLACES):
            size = min(PLACES, total - p) + SPACING  # neighbouring parts share a spacing, more than a window
            lo, hi = np.searchsorted(place, [p, p + size])
            if lo == hi:
                continue
            at_place = np.full(size, len(self.vectors) - 1)  # the last vector is zero
            at_place[place[lo:hi] - p] = term[lo:hi]
            cells = self.vectors.take(at_place[::CELL], axis=0)
            for k in range(1, CELL):
                cells += self.vectors.take(at_place[k::CELL], axis=0)
            for width in WINDOWS:
                step = width // 2 // CELL
                half = cells[::step].copy()
                for k in range(1, step):
                    half += cells[k::step]
                w = half[:-1] + half[1:]
                grid = p + np.arange(len(w)) * (width // 2)
                norm = np.sqrt(np.einsum("ij,ij->i", w, w))
                # windows that begin in a document, hold a term, and belong to this part
                own = np.searchsorted(base, grid, side="right") - 1
                some = np.flatnonzero((norm > 0) & (grid < ends[own]) & (grid < p + PLACES))
                near = w[some] @ self.latent.T
                x, i = np.nonzero(near >= COSINE * norm[some, None])
                starts.append(grid[some[x]])
                widths.append(np.full(len(x), width))
                items.append(i)
                cosines.append(near[x, i] / norm[some[x]])
        starts, widths, items, cosines = map(np.concatenate, (starts, widths, items, cosines))
        of = np.searchsorted(base, starts, side="right") - 1
        order = np.argsort(of, kind="stable")
        starts, widths, items, cosines, of = (x[order] for x in (starts, widths, items, cosines, of))
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        found = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
            d = int(of[a])
            lo, hi = np.searchsorted(doc, [d, d + 1])
            wanted = np.unique(items[a:b])
            # a common subsequence has no word more often than both sides have it
            own, times = np.unique(term[lo:hi], return_counts=True)
            both = np.minimum(self.counts[wanted][:, own], times).sum(axis=1)
            for i in wanted[both >= self.needed[wanted]].tolist():
                mine = np.flatnonzero(items[a:b] == i) + a
                found += [(d, *x) for x in self.verify(i, words[first[d]:first[d + 1]], at[lo:hi] - first[d], term[lo:hi],
                                                      starts[mine] - base[d], widths[mine], cosines[mine])]
        return found

    def verify(self, i: int, words: np.ndarray, at: np.ndarray, term: np.ndarray, starts: np.ndarray,
               widths: np.ndarray, cosines: np.ndarray) -> list[tuple[int, int, float, int]]:
        """The best leak of item ``i`` around the windows given, if one is accepted.

        An accepted stretch has ``needed`` words of the item in at most len(item) / PRECISION words, so only the part
        of a region from the first to the last such stretch is compared.
        """
        item, needed, longest = self.items[i], int(self.needed[i]), int(len(self.items[i]) / PRECISION)
        member = np.flatnonzero(self.counts[i, term])
        place, code = at[member], term[member]
        crowd = np.searchsorted(place, place + longest) - np.arange(len(place))
        good = place[crowd >= needed]
        if not len(good):
            return []
        reach = len(item) + widths // 2
        begin, end = np.maximum(starts - reach, 0), starts + widths + reach
        first, last = np.searchsorted(good, begin), np.searchsorted(good, end) - 1
        some = last >= first
        regions: dict[tuple[int, int], tuple[float, int]] = {}
        for a, b, cosine, start in zip(good[first[some]].tolist(), np.minimum(good[last[some]] + longest, end[some]).tolist(),
                                       cosines[some].tolist(), begin[some].tolist()):
            regions[a, b] = max(regions.get((a, b), (-2.0, 0)), (cosine, start))
        best: tuple[int, float, int] | None = None
        masks = None
        for (a, b), (cosine, start) in sorted(regions.items()):
            inside = code[np.searchsorted(place, a):np.searchsorted(place, b)]
            own, times = np.unique(inside, return_counts=True)
            if np.minimum(self.counts[i, own], times).sum() < needed:
                continue
            if masks is None:
                masks = {}
                for k, t in enumerate(self.lookup(item)[1].tolist()):
                    masks[t] = masks.get(t, 0) | (1 << k)
            if subsequence_length(masks, len(item), inside.tolist()) < needed:
                continue
            length, ok = check_words(item, self.answers[i], words[a:b])
            if ok and (best is None or length > best[0]):
                best = (length, cosine, start)
        return [(i, *best)] if best else []


def _document_frequencies(docs: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    def count(batch):
        df = np.zeros(len(block.terms), np.int64)
        text = batch.column("text")
        for i, j in chunks(text):
            words, first = word_hashes(text.slice(i, j - i))
            at, term = block.lookup(words)
            doc = np.searchsorted(first, at, side="right")
            pairs = np.unique(doc * np.int64(len(block.terms) or 1) + term)
            df += np.bincount(pairs % np.int64(len(block.terms) or 1), minlength=len(df))
        some = np.flatnonzero(df)
        yield {"term": np.r_[some, -1], "df": np.r_[df[some], len(text)]}

    df, n = np.zeros(len(block.terms), np.int64), 0
    # one row per term of the block
    for term, count_ in map_batches(docs, count, "term bigint, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        if term < 0:
            n = count_
        else:
            df[term] = count_
    return df, n


def _basis(docs: DataFrame, block: Block) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages (of all documents and the items) by a randomised range finder.

    Every pass multiplies the passages in the tasks, each of which hands on one sum; these are added by shuffle. Tasks
    and driver hold matrices of (terms of the block) x (rank) only.
    """
    m = len(block.terms)
    width = min(RANK + OVERSAMPLE, m)
    if not width:
        return np.zeros((0, 0))
    schema = "term bigint, y binary"

    def rows(total: np.ndarray):
        some = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(some), 4096):
            part = some[k:k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(
                [y.tobytes() for y in total[part]], pa.binary())], names=["term", "y"])

    def drawn() -> np.ndarray:
        return np.random.default_rng(12345).standard_normal((m, width))

    def multiply(matrix: np.ndarray | None) -> np.ndarray:
        """A'A times ``matrix``, or times the drawn one, which every task draws itself instead of carrying it."""
        def part(batches):
            total, right = np.zeros((m, width)), drawn() if matrix is None else matrix
            for batch in batches:
                text = batch.column("text")
                for i, j in chunks(text):
                    block.multiply(*word_hashes(text.slice(i, j - i)), right, total)
            yield from rows(total)

        def add(batches):
            total = np.zeros((m, width))
            for batch in batches:
                for t, y in zip(batch.column("term").to_pylist(), batch.column("y").to_pylist()):
                    total[t] += np.frombuffer(y, np.float64)
            yield from rows(total)

        sums = docs.select("text").mapInArrow(part, schema).repartition("term").mapInArrow(add, schema)
        result = np.zeros((m, width))
        for term, y in sums.collect():
            result[term] = np.frombuffer(y, np.float64)
        block.multiply(np.concatenate(block.items), np.cumsum([0, *map(len, block.items)]),
                       drawn() if matrix is None else matrix, result)
        return result

    current = None
    for _ in range(POWER):
        current = np.linalg.qr(multiply(current))[0]
    current = drawn() if current is None else current
    small = current.T @ multiply(current)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return current @ vectors[:, np.argsort(-values)[:RANK]]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, cosine, near_word) for every leak of an item in a document.

    One row per document row and item; repeated items are found once each. Items without words and null or empty
    texts match nothing; an empty benchmark gives no rows. Item ids and doc_ids may be null and are passed on.
    Other columns of either table are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut_lineage(items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "block", F.monotonically_increasing_id()), "items")
    numbered = items.orderBy("block")
    schema = "doc_id bigint, item_id bigint, common_words bigint, item_words bigint, cosine double, near_word bigint"
    result, done = None, -1
    while True:
        # the next block of the stated query set
        rows = numbered.where(F.col("block") > done).limit(BLOCK_ITEMS).collect()
        if not rows:
            break
        done = rows[-1]["block"]
        block = Block([r["item_id"] for r in rows], [r["text"] for r in rows])
        block.weigh(*_document_frequencies(texts, block))
        block.project(_basis(texts, block))

        def search(batch, block=block):
            out = {k: [] for k in ("doc_id", "item_id", "common_words", "item_words", "cosine", "near_word")}
            text, ids = batch.column("text"), batch.column("doc_id")
            for i, j in chunks(text):
                words, first = word_hashes(text.slice(i, j - i))
                for d, item, common, cosine, start in block.search(words, first):
                    for k, v in zip(out, (ids[i + d].as_py(), block.ids[item], common, len(block.items[item]), cosine, start)):
                        out[k].append(v)
            yield out
        part = map_batches(texts, search, schema)
        result = part if result is None else result.union(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id has a leak; rows without an id stay."""
    leaks = cut_lineage(benchmark_leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), "doc_id", "left_anti").select(*docs.columns)
