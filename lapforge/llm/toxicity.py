"""Toxicity by a classifier chain.

Each category has a linear (logistic) model over words and word beginnings; a later category also sees the
probabilities of the earlier ones. Later models are trained on out-of-fold probabilities, so they meet the same
kind of error in training as in use. Models are fitted on a bounded sample of the labelled rows: the
``SAMPLE_ROWS`` labelled documents with the smallest hash of their id. Scoring covers every document.

No word of the sample is left out: every word and beginning is a feature, known by a 64-bit hash, and counts by how
much it has to do with the category (its chi-squared statistic in the training rows), so the many unrelated ones stay
near zero without being cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches

CATEGORIES = ("quality", "toxic")   # chain order; the last one decides
SAMPLE_ROWS = 20_000                # bound of the labelled sample
FOLDS = 5
STEMS = (4, 5)                      # lengths of word beginnings
PENALTY = 1e-4
WEIGHT_CHI = 10.0                   # chi-squared statistic of a feature that counts once
KNOWN_WORDS = 500_000               # words whose features a worker remembers
WORD = re.compile(r"\w+")


@dataclass
class Chain:
    """A fitted chain: the features known, one weight vector per category (features, earlier categories, intercept), and
    the threshold of the last one."""
    categories: tuple[str, ...]
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes, sorted
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))     # feature of each, frequent ones first
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 1.0


def hashes_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings (marked by a star)."""
    return tuple(int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)
                 for x in (word, *[word[:n] + "*" for n in STEMS if len(word) > n]))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def pack(features: list[int]) -> bytes:
    """Sorted numbers as compressed differences of two bytes, or of four if need be."""
    steps = np.diff(np.array(features, np.int64), prepend=0)
    wide = bool(len(steps)) and int(steps.max()) > 65_535
    return (b"4" if wide else b"2") + zlib.compress(steps.astype("<u4" if wide else "<u2").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data[1:]), "<u4" if data[:1] == b"4" else "<u2").astype(np.int64))


class Features:
    """Feature numbers of texts, by a sorted vocabulary of hashes; other words have none."""

    def __init__(self, vocabulary: np.ndarray, numbers: np.ndarray):
        self.vocabulary, self.numbers = vocabulary, numbers
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        found = [hashes_of(w) for w in words]
        flat = np.array([h for own in found for h in own], np.int64)
        at = np.searchsorted(self.vocabulary, flat)
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
        places, k = np.where(hit, self.numbers[at] if len(self.numbers) else -1, -1).tolist(), 0
        for word, own in zip(words, found):
            self.known[word] = tuple(p for p in places[k:k + len(own)] if p >= 0)
            k += len(own)

    def rows(self, texts: list[str | None]) -> list[list[int]]:
        """Distinct feature numbers of each text, sorted."""
        words = [words_of(t) for t in texts]
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set().union(*words)
        self.learn(sorted(new))
        known = self.known
        return [sorted(set().union(*[known[w] for w in own])) for own in words]


def relevance(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Root of the chi-squared statistic of every feature and the category, over ``WEIGHT_CHI``."""
    n = np.bincount(columns, minlength=width).astype(float)
    hits = np.bincount(columns, weights=y[rows], minlength=width)
    share = y.mean()
    chi = (hits - n * share) ** 2 / (n * share * (1 - share) * (1 - n / (len(y) + 1)) + 1e-9)
    return np.sqrt(chi / WEIGHT_CHI)


def _sums(groups: np.ndarray, entries: np.ndarray, n: int):
    """A function that sums a vector's entries by group: the product with a sparse 0/1 matrix, sorted once."""
    counts = np.bincount(groups, minlength=n)
    present = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[present]
    if len(groups) and (groups[1:] < groups[:-1]).any():
        entries = entries[np.argsort(groups, kind="stable")]
    entries = entries.astype(np.intp, copy=False)  # other index types are converted on every use

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(starts):
            out[present] = np.add.reduceat(values.take(entries), starts)
        return out
    return total


def fit_logistic(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int,
                 tolerance: float = 1e-3, most: int = 500) -> np.ndarray:
    """Weights of a logistic model, by limited-memory BFGS until no slope is beyond ``tolerance``: ``width`` sparse 0/1
    features scaled by their relevance, dense columns, intercept.

    Classes weigh the same in total. With one class only, the intercept alone carries the rate.
    """
    n, extra = len(y), dense.shape[1]
    w = np.zeros(width + extra + 1)
    positives = y.sum()
    if n == 0 or positives in (0, n):
        w[-1] = -20.0 if n == 0 or positives == 0 else 20.0
        return w
    weight = np.where(y > 0, 0.5 / positives, 0.5 / (n - positives))
    scale = relevance(rows, columns, y, width)
    by_row, by_column = _sums(rows, columns, n), _sums(columns, rows, width)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = by_row(w[:width] * scale) + dense @ w[width:width + extra] + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        slope = np.concatenate([scale * by_column(g), g @ dense, [g.sum()]])
        slope[:-1] += PENALTY * w[:-1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + PENALTY / 2 * (w[:-1] @ w[:-1])), slope

    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(most):
        if np.abs(slope).max() < tolerance:
            break
        way, shares = -slope, []
        for step, change, rho in reversed(steps):
            shares.append(rho * (step @ way))
            way = way - shares[-1] * change
        if steps:
            step, change, _ = steps[-1]
            way = way * ((step @ change) / (change @ change))
        for (step, change, rho), share in zip(steps, reversed(shares)):
            way = way + step * (share - rho * (change @ way))
        length, descent = (1.0 if steps else 1 / np.linalg.norm(slope)), slope @ way
        while True:
            ahead, new = loss(w + length * way)
            if ahead <= value + 1e-4 * length * descent or length < 1e-12:
                break
            length /= 2
        step, change = length * way, new - slope
        if step @ change > 1e-14:
            steps = [*steps, (step, change, 1 / (step @ change))][-8:]
        w, value, slope = w + step, ahead, new
    w[:width] *= scale
    return w


def margins(features: list, dense: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """Margins of rows with lists of features."""
    lengths = np.array([len(f) for f in features], np.int64)
    at = np.concatenate([np.asarray(f, np.int64) for f in features] or [np.zeros(0, np.int64)])
    sparse = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=w[at], minlength=len(lengths))
    return sparse + dense @ w[width:width + dense.shape[1]] + w[-1]


def best_threshold(y: np.ndarray, z: np.ndarray) -> float:
    """Margin with the best F score (recall weighs twice), in the middle between its neighbours, and never below even odds. Without both
    classes there is none."""
    if not len(y) or y.sum() in (0, len(y)):
        return float("inf")
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    score = 3 * hits / (np.arange(1, len(y) + 1) + 2 * y.sum())   # recall weighs twice
    z = z[order]
    score[:-1][z[:-1] == z[1:]] = -1
    best = int(np.argmax(score))
    return max(0.0, float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1))


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """Fit the chain on the labelled sample.

    Labels with a null id or category are left out; of repeated ids the largest label counts. Null texts have no
    features. Without labelled rows of both classes the chain rejects nothing.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                          *[F.col(c).cast("int").alias(c) for c in categories]).na.drop()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # a bounded table
    sample = cut_lineage(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int")), "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(texts.join(F.broadcast(sample), "doc_id"), "labelled")

    def count_hashes(batch):
        n = Counter(h for text in batch.column("text").to_pylist() for w in words_of(text) for h in hashes_of(w))
        yield {"hash": list(n), "n": list(n.values())}

    # the words of the bounded sample
    counts = map_batches(rows.select("text"), count_hashes, "hash bigint, n bigint").groupBy("hash").agg(
        F.sum("n").alias("n")).toArrow()
    hashes, times = (counts[c].to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes)
    vocabulary, numbers = hashes[order], np.zeros(len(hashes), np.int32)
    numbers[np.argsort(-times[order], kind="stable")] = np.arange(len(hashes), dtype=np.int32)

    def encode(batch):
        of = Features(vocabulary, numbers)
        yield {"features": [pack(f) for f in of.rows(batch.column("text").to_pylist())],
               **{c: batch.column(c) for c in ("doc_id", "fold", *categories)}}

    kinds = ", ".join(f"{c} int" for c in ("fold", *categories))
    coded = cut_lineage(map_batches(rows, encode, f"doc_id bigint, features binary, {kinds}").withColumn(
        "chain", F.expr("array()").cast("array<double>")), "coded")
    chain, width = Chain(tuple(categories), vocabulary, numbers), len(vocabulary)
    for position, category in enumerate(categories):
        # one group per fold model, and one (FOLDS) for the model of all rows; each holds the sample at most
        spread = coded.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).where("model <> fold")
        spread = spread.repartitionByRange(FOLDS + 1, "model")  # by size alone, the models would be merged into one task

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("doc_id")
            # as 32-bit numbers until they lie in one array
            found = [unpack(f).astype(np.int32) for f in part["features"]]
            at = np.repeat(np.arange(len(part), dtype=np.int32), [len(f) for f in found])
            columns = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64)
            del found
            dense = np.array([list(x) for x in part["chain"]], float).reshape(len(part), position)
            w = fit_logistic(at, columns, dense, (part[category] > 0).to_numpy(float), width)
            return pd.DataFrame({"model": [int(part["model"].iloc[0])], "w": [w.astype(np.float32).tobytes()]})

        fitted = {r.model: np.frombuffer(r.w, np.float32) for r in spread.groupBy("model").applyInPandas(
            fit, "model int, w binary").collect()}  # as many vectors as folds
        nothing = np.zeros(width + position + 1, np.float32)
        nothing[-1] = -20.0
        chain.weights.append(fitted.get(FOLDS, nothing))

        def out_of_fold(batch):
            features, folds = batch.column("features").to_pylist(), batch.column("fold").to_pylist()
            before = batch.column("chain").to_pylist()
            z = [float(margins([unpack(f)], np.array([b], float).reshape(1, position), fitted.get(k, nothing), width)[0])
                 for f, k, b in zip(features, folds, before)]
            yield {**{c: batch.column(c) for c in ("doc_id", "features", "fold", *categories)},
                   "chain": [[*b, float(np.clip(x, -20, 20))] for b, x in zip(before, z)]}
        coded = cut_lineage(map_batches(
            coded, out_of_fold, f"doc_id bigint, features binary, {kinds}, chain array<double>"), "coded")
    held = coded.select(categories[-1], F.element_at("chain", -1).alias("z")).toPandas()  # the bounded sample
    chain.threshold = best_threshold((held[categories[-1]] > 0).to_numpy(float), held["z"].to_numpy(float))
    return chain


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the probability of each category, and ``toxic``; one row per row of ``docs``.

    A null or empty text has no features; its probabilities are those of the intercepts and it is not toxic.
    """
    weights, names, threshold = chain.weights, chain.categories, chain.threshold
    vocabulary, numbers, width, states = chain.vocabulary, chain.numbers, len(chain.vocabulary), []

    def score(batch):
        if not states:  # once for a task
            states.append(Features(vocabulary, numbers))
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            features = states[0].rows(part.column("text").to_pylist())
            z = np.zeros((len(features), 0))
            for w in weights:
                z = np.column_stack([z, np.clip(margins(features, z, w, width), -20, 20)])
            found = np.array([bool(f) for f in features], bool)
            yield {"doc_id": part.column("doc_id"), "toxic": (z[:, -1] > threshold) & found,
                   **{f"p_{c}": 1 / (1 + np.exp(-z[:, i])) for i, c in enumerate(names)}}

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, score, "doc_id bigint, toxic boolean, " + ", ".join(f"p_{c} double" for c in names))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id the chain rejects; rows without an id stay."""
    toxic = score_chain(docs, train_chain(docs, labels)).where("toxic").select("doc_id").distinct()
    return docs.join(broadcast_if_small(cut_lineage(toxic, "toxic")), "doc_id", "left_anti").select(*docs.columns)
