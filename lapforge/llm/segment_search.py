"""Hard negatives of labelled vectors, by bounds from segment means and deviations.

A vector is cut into segments; each segment has its mean and its deviation (the length of what the mean leaves over),
computed where vectors meet. The inner product of two vectors lies within

    sum of (segment size * mean * mean')  -+  sum of (deviation * deviation')

by Cauchy and Schwarz. Coarse segments are tried first, and only pairs that may still be among the wanted ones are
refined: to finer segments, and in the end to the exact integer product.

Rows with the same label and vector form a class; only its smallest ids can be among the first few, so a vector that
occurs very often is compared once. Classes are dealt by a hash into blocks, anchors (the stated query set) too, and
every block of anchors meets every block of rows: a cell holds a bounded number of both, whatever the labels. A cell
returns its few best rows for each anchor, which are merged by shuffle. Vectors travel as the bytes of the smallest integers
that hold them (``packed``), and their segments do not travel: what a cell sorts and receives is little more than its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.tables import cut_lineage, map_batches

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95        # percent of the positive's score that a hard negative's score may have
SEGMENT, WIDER = 2, 4       # components of the finest segments, and how many make a coarser one
LEVELS = 3
ROW_BLOCK, ANCHOR_BLOCK = 2_048, 2_048
CHUNK = 512                 # rows of a cell that are compared at once
PAIRS = 16_384              # pairs whose vectors are gathered at once
DENSE = 0.1                 # share of live pairs from which whole matrices are cheaper than pairs
INTEGERS = (np.int16, np.int32, np.int64)
LONG = (1 << 63) - 1


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the finest segments of each row."""
    starts = np.arange(0, vectors.shape[1], SEGMENT)
    if not len(starts) or not len(vectors):
        return np.zeros((len(vectors), len(starts))), np.zeros((len(vectors), len(starts)))
    sizes = np.diff(np.r_[starts, vectors.shape[1]])
    means = np.add.reduceat(vectors, starts, axis=1) / sizes
    rest = vectors - np.repeat(means, sizes, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def levels(means: np.ndarray, deviations: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means times the root of the size, deviations) from the coarsest to the finest segments."""
    sizes = np.diff(np.r_[np.arange(0, width, SEGMENT), width]).astype(float)
    out = []
    for _ in range(LEVELS):
        out.append((means * np.sqrt(sizes), deviations))
        starts = np.arange(0, len(sizes), WIDER)
        if len(starts) < 2:
            break
        wide = np.add.reduceat(sizes, starts)
        parts = np.diff(np.r_[starts, len(sizes)])
        mean = np.add.reduceat(means * sizes, starts, axis=1) / wide
        apart = (means - np.repeat(mean, parts, axis=1)) ** 2 * sizes
        deviations = np.sqrt(np.add.reduceat(deviations ** 2 + apart, starts, axis=1))
        means, sizes = mean, wide
    return out[::-1]


class Vectors:
    """Rows of a cell: integer vectors with the bounds of every level."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact
        self.levels = levels(*segments(exact.astype(float)), exact.shape[1])
        self.norm = float(np.sqrt((exact.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
        self.top = float(np.abs(exact.astype(float)).max(initial=0.0))

    def take(self, rows) -> Vectors:
        out = object.__new__(Vectors)
        out.exact, out.norm, out.top = self.exact[rows], self.norm, self.top
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def scores(q: np.ndarray, r: np.ndarray, small: bool) -> np.ndarray:
    """Exact products of the rows of ``q`` and ``r``, pair by pair; beyond 64 bits the nearest long."""
    if small:  # every partial sum is an integer below 2^53
        return np.einsum("ij,ij->i", q.astype(float), r.astype(float)).astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, b))))
                     for a, b in zip(q.tolist(), r.tolist())], np.int64)


def search(q: Vectors, r: Vectors, low: np.ndarray, high: np.ndarray, allowed: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, score) of all allowed pairs with a score from ``low`` to ``high``, limits by row of q."""
    slack = 1e-9 * q.norm * r.norm + 1e-6  # far more than rounding takes
    below, above = low - slack, high + slack
    alive, a, b = allowed.copy(), None, None
    for (qm, qd), (rm, rd) in zip(q.levels, r.levels):
        if a is None and alive.mean() < DENSE:
            a, b = np.nonzero(alive)
        if a is None:
            mid, wide = qm @ rm.T, qd @ rd.T
            alive &= mid + wide >= below[:, None]
            alive &= np.subtract(mid, wide, out=mid) <= above[:, None]
        elif len(a):
            keep = np.empty(len(a), bool)
            for k in range(0, len(a), PAIRS):
                i, j = a[k:k + PAIRS], b[k:k + PAIRS]
                mid, wide = (np.einsum("ij,ij->i", x[i], y[j]) for x, y in ((qm, rm), (qd, rd)))
                keep[k:k + PAIRS] = (mid + wide >= below[i]) & (mid - wide <= above[i])
            a, b = a[keep], b[keep]
    small = q.top * r.top * max(q.exact.shape[1], 1) < 2 ** 53
    if a is None and small and alive.mean() >= DENSE:
        product = (q.exact.astype(float) @ r.exact.astype(float).T)
        alive &= (product >= low[:, None]) & (product <= high[:, None])
        a, b = np.nonzero(alive)
        return a, b, product[a, b].astype(np.int64)
    if a is None:
        a, b = np.nonzero(alive)
    score = np.concatenate([scores(q.exact[a[k:k + PAIRS]], r.exact[b[k:k + PAIRS]], small)
                            for k in range(0, len(a), PAIRS)] or [np.zeros(0, np.int64)])
    keep = (score >= low[a]) & (score <= high[a])
    return a[keep], b[keep], score[keep]


def first_few(a: np.ndarray, score: np.ndarray, ids: np.ndarray, few: int) -> np.ndarray:
    """Places of the ``few`` first entries of each ``a``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, a))  # ~score falls where score rises, without overflow
    a = a[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < few]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, len(flat) // rows if rows else 0)


def packed_vectors(vectors: np.ndarray) -> list[bytes]:
    """The bytes of each row, in the smallest of ``INTEGERS`` that holds it."""
    out = [b""] * len(vectors)
    if not vectors.size:
        return out
    low, high, left = vectors.min(axis=1), vectors.max(axis=1), np.ones(len(vectors), bool)
    for kind in INTEGERS:
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(fits).tolist(), vectors[fits].astype(kind)):
            out[i] = row.tobytes()
        left &= ~fits
    return out


def unpacked_vectors(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    if width:
        sizes = np.array([len(r) for r in rows]) // width
        for kind in INTEGERS:
            of = np.flatnonzero(sizes == np.dtype(kind).itemsize)
            if len(of):
                out[of] = np.frombuffer(b"".join(rows[i] for i in of.tolist()), kind).reshape(len(of), width)
    return out


def _vectors(table: pa.Table, prefix: str = "") -> Vectors:
    return Vectors(unpacked_vectors(table[prefix + "packed"].to_pylist(), table[prefix + "dim"][0].as_py()))


def _first_ids(table: pa.Table) -> tuple[np.ndarray, list]:
    lists = table["ids"].to_pylist()
    return np.array([x[0] for x in lists], np.int64), lists


def vector_classes(rows: DataFrame, few: int) -> DataFrame:
    """(cid, dim, label, vec, ids, packed): one row per different (label, vec), with its ``few`` smallest ids.
    ``rows`` (vec_id, label, vec) has distinct rows."""
    w = Window.partitionBy("label", "vec").orderBy("vec_id")
    some = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= few)
    classes = some.groupBy("label", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def describe(batch):
        lengths = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths):
            part = batch.filter(pa.array(lengths == n))
            vectors = _matrix(pa.chunked_array([part.column("vec")]), part.num_rows)
            yield {"label": part.column("label"), "vec": part.column("vec"), "ids": part.column("ids"),
                   "packed": packed_vectors(vectors)}
    out = map_batches(classes, describe, "label bigint, vec array<bigint>, ids array<bigint>, packed binary")
    return cut_lineage(out.select(F.monotonically_increasing_id().alias("cid"), F.size("vec").alias("dim"), "*"), "classes")


def _cells(classes: DataFrame, anchors: DataFrame, extra: list[str]) -> tuple:
    """Both sides dealt into (dim, row block, anchor block), as a cogroup."""
    count = lambda t, size, name: t.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias(name))
    grid = count(classes, ROW_BLOCK, "rblocks").join(count(anchors, ANCHOR_BLOCK, "ablocks"), "dim")
    sent = classes.join(grid, "dim").select(
        "dim", F.pmod(F.xxhash64("cid"), "rblocks").alias("rblock"),
        F.explode(F.expr("sequence(0l, ablocks - 1)")).alias("ablock"), "cid", "label", "ids", "packed")
    asked = anchors.join(grid, "dim").select(
        F.col("dim").alias("a_dim"), F.pmod(F.xxhash64(F.lit(1), "cid"), "ablocks").alias("a_ablock"),
        F.explode(F.expr("sequence(0l, rblocks - 1)")).alias("a_rblock"),
        *[F.col(c).alias(f"a_{c}") for c in ("cid", "label", "packed", *extra)])
    return sent.groupBy("dim", "rblock", "ablock").cogroup(asked.groupBy("a_dim", "a_rblock", "a_ablock"))


def nearest_same(classes: DataFrame, anchors: DataFrame, few: int) -> DataFrame:
    """(cid, score, id, of): for each anchor class the ``few`` first rows of its label, itself included."""
    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"cid": [], "score": [], "id": [], "of": []}
        if rows.num_rows and asked.num_rows:
            q, r = _vectors(asked, "a_"), _vectors(rows)
            first, ids = _first_ids(rows)
            cids, of = asked["a_cid"].to_numpy(), rows["cid"].to_numpy()
            q_label, r_label = asked["a_label"].to_numpy(), rows["label"].to_numpy()
            for label in np.unique(q_label):
                qs, rs = np.flatnonzero(q_label == label), np.flatnonzero(r_label == label)
                low, high = np.full(len(qs), -LONG - 1), np.full(len(qs), LONG)
                held = [np.zeros(0, np.int64)] * 3
                mine = q.take(qs)
                for k in range(0, len(rs), CHUNK):
                    part = rs[k:k + CHUNK]
                    a, b, score = search(mine, r.take(part), low, high, np.ones((len(qs), len(part)), bool))
                    held = [np.concatenate(x) for x in zip(held, (a, part[b], score))]
                    held = [x[first_few(held[0], held[2], first[held[1]], few)] for x in held]
                    full = np.bincount(held[0], minlength=len(qs)) >= few
                    last = np.full(len(qs), LONG)
                    np.minimum.at(last, held[0], held[2])
                    low = np.where(full, last, low)
                for a, b, score in zip(*[x.tolist() for x in held]):
                    for i in ids[b]:
                        for column, value in zip(out.values(), (cids[qs[a]], score, i, of[b])):
                            column.append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = _cells(classes, anchors, []).applyInArrow(cell, "cid bigint, score bigint, id bigint, of bigint")
    w = Window.partitionBy("cid").orderBy(F.desc("score"), "id", "of")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= few).drop("place")


def best_below(classes: DataFrame, asked: DataFrame, few: int) -> DataFrame:
    """(cid, wanted, score, id, place): for each class of ``asked`` and each of its ``bands`` (wanted, least, most) the
    ``few`` first rows of other labels with a score from least to most."""
    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"cid": [], "wanted": [], "score": [], "id": []}
        if rows.num_rows and asked.num_rows:
            q, r = _vectors(asked, "a_"), _vectors(rows)
            first, ids = _first_ids(rows)
            cids = asked["a_cid"].to_numpy()
            bands = asked["a_bands"].to_pylist()
            width = max(map(len, bands))
            least, most = np.full((len(bands), width), LONG), np.full((len(bands), width), -LONG - 1)
            for i, row in enumerate(bands):
                for j, band in enumerate(row):
                    least[i, j], most[i, j] = band["least"], band["most"]
            other = asked["a_label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :]
            held = [[np.zeros(0, np.int64)] * 3 for _ in range(width)]
            floor, high = least.copy(), most.max(axis=1)
            for k in range(0, rows.num_rows, CHUNK):
                part = np.arange(k, min(k + CHUNK, rows.num_rows))
                a, b, score = search(q, r.take(part), floor.min(axis=1), high, other[:, part])
                for j in range(width):
                    inside = (score >= floor[a, j]) & (score <= most[a, j])
                    new = [np.concatenate(x) for x in zip(held[j], (a[inside], part[b[inside]], score[inside]))]
                    held[j] = [x[first_few(new[0], new[2], first[new[1]], few)] for x in new]
                    full = np.bincount(held[j][0], minlength=len(cids)) >= few
                    last = np.full(len(cids), LONG)
                    np.minimum.at(last, held[j][0], held[j][2])
                    floor[:, j] = np.where(full, last, floor[:, j])
            for j in range(width):
                for a, b, score in zip(*[x.tolist() for x in held[j]]):
                    for i in ids[b][:few]:
                        for column, value in zip(out.values(), (cids[a], bands[a][j]["wanted"], score, i)):
                            column.append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = _cells(classes, asked, ["bands"]).applyInArrow(cell, "cid bigint, wanted bigint, score bigint, id bigint")
    w = Window.partitionBy("cid", "wanted").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= few)


def percent(value: Column, share: int) -> Column:
    """floor(value * share / 100) without overflow, for value >= 0."""
    div = lambda x: F.call_function("div", x, F.lit(100))
    return div(value) * share + div(value % 100 * share)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: vec_id, label and vec (array<bigint>); ``is_anchor`` chooses the anchors by their vec_id. A score is the
    integer inner product with the anchor; higher scores come first, ties by the smaller vec_id. An anchor's positives
    are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels whose
    score is from ``least`` to ``most`` percent of the positive's are returned, so a negative positive score has none.

    Rows with a null vec_id, label, vec or component take no part; exact repeats of a row count once, and rows that
    share a vec_id only are rows of their own. Vectors of different lengths never meet; empty ones have the score 0.
    A score beyond 64 bits is the nearest long. Other columns are ignored; an empty table gives no rows.
    """
    whole = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                        F.col("vec").cast("array<bigint>").alias("vec"))
    whole = whole.where("vec_id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)")
    whole = cut_lineage(whole.distinct(), "vectors")
    classes = vector_classes(whole, positives + 1)
    members = cut_lineage(whole.where(is_anchor).join(classes.select("label", "vec", "cid"), ["label", "vec"]).select(
        F.col("vec_id").alias("anchor_id"), "cid"), "anchors")
    anchors = cut_lineage(classes.join(members.select("cid").distinct(), "cid", "left_semi"), "asked")

    near = cut_lineage(nearest_same(classes, anchors, positives + 1), "near")
    bands = near.where("score >= 0").select("cid", F.col("score").alias("wanted")).distinct().withColumns({
        "least": F.col("wanted") - percent(F.col("wanted"), 100 - least), "most": percent(F.col("wanted"), most)}).where(
        "least <= most").groupBy("cid").agg(F.collect_list(F.struct("wanted", "least", "most")).alias("bands"))
    below = best_below(classes, anchors.join(bands, "cid"), negatives)
    lists = below.groupBy("cid", F.col("wanted").alias("score")).agg(F.sort_array(F.collect_list(
        F.struct("place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("found"))
    # one bounded row per class, so a class with very many anchors only joins
    of_class = near.join(lists, ["cid", "score"], "left").groupBy("cid").agg(F.sort_array(F.collect_list(
        F.struct((-1 - F.col("score")).alias("order"), "id", "of", "score", "found"))).alias("near"))
    own = F.filter("near", lambda x: ~((x["id"] == F.col("anchor_id")) & (x["of"] == F.col("cid"))))
    chosen = members.join(of_class, "cid").select("anchor_id", F.explode(F.slice(own, 1, positives)).alias("p"))
    return chosen.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                         F.explode("p.found").alias("n")).select(
        "anchor_id", "positive_id", F.col("n.place").alias("rank"), "n.negative_id", "positive_score", "n.negative_score")


def mining_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label), anchors are the ids divisible by 50.

    Each component x becomes floor(256 x); rows with a null or non-finite component take no part. Labels of ids
    divisible by 7 are moved on by one modulo 10. Other cases as in ``hard_negatives``.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * 256)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(1 << 62)
    vec = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c))))
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & finite).select(
        "vec_id", label.alias("label"), vec.alias("vec"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM r a JOIN r b ON len(a.vec) = len(b.vec) AND NOT (a.vec_id = b.vec_id AND a.label = b.label AND a.vec = b.vec)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""
