"""Substring dedup by paragraphs: MinHash bands, exact check, clusters, and removal of all but the first copy.

A paragraph is a line of a text. Equal paragraphs (same five-word shingles) are one node, so a passage in
thousands of documents costs one signature. The number of bands follows from the wanted recall. Colliding
paragraphs are compared by their exact Jaccard similarity, and clusters are the connected components.

Passages inside longer or over shorter lines are found by spans of ``SPAN`` words that the content chooses: of the
spans in every stretch of ``PASSAGE`` + 1 words, line ends or not, the one with the smallest hash is taken
(winnowing). Equal stretches choose equal spans, so every passage of more than ``PASSAGE`` equal words in two
places shares a span, and none is missed by chance.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.components import connected_components
from lapforge.llm.near_links import bit_sketch, link_classes, only, shared_buckets
from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches, set_aside
from lapforge.llm.texts import chunks, mix, mix_int, raw_bytes, rolling, span_hashes, split_words

WORDS, PERCENT = 5, 80
MIN_WORDS = 20          # shorter lines are no passages; repeated short lines are the line dedup's work
RECALL, MAX_BANDS = 0.999, 16
SPAN, PASSAGE = 25, 50  # words of a span; every longer passage than this holds one
DOCUMENT, SPANS = -1, -2   # line numbers of rows that are no lines


def tune_bands(similarity: float, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective layout that finds a pair of that similarity with that probability."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-similarity ** rows))) if similarity < 1 else 1
        if bands <= most:
            best = (bands, rows)
    return best


def _sliding(of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:len(x) - step], x[step:])
        have += step
    return x


def content_spans(text: pa.Array, span: int = SPAN, passage: int = PASSAGE
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, code) of the chosen spans of a batch; words count from 0 in their text."""
    data, offsets = raw_bytes(text)
    starts, ends, first = split_words(data, offsets)
    if len(starts) <= passage:
        none = np.zeros(0, np.int64)
        return none, none, none
    code = rolling(span_hashes(data, starts, ends, lower=True), span)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    width = passage + 2 - span      # spans in a stretch of passage + 1 words
    least = np.where(doc[:-passage] == doc[passage:], _sliding(np.minimum, code, width), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.r_[edge, least, edge], width) == code)
    return doc[at], at - first[doc[at]], code[at].view(np.int64)


def line_shingles(text: pa.Array, words: int, min_words: int):
    """All lines with ``min_words`` words or more of a batch, as arrays: text number, line number, words, start of
    the line's shingles (one value more), shingle hashes, the byte span of the line's words, and the number of its
    first word in the text."""
    data, offsets = raw_bytes(text)
    starts, ends, first = split_words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    hashes = span_hashes(data, starts, ends, lower=True)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc] if len(starts) else doc
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]) if len(doc) else doc
    count = np.diff(np.r_[new, len(doc)])
    use = np.flatnonzero(count >= max(min_words, 1))
    sizes, parts = [], []
    for u in use:
        s = np.unique(rolling(hashes[new[u]:new[u] + count[u]], words))
        sizes.append(len(s))
        parts.append(s)
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return doc[new[use]], line[new[use]], count[use], bounds, flat, starts[new[use]], \
        ends[new[use] + count[use] - 1] if len(use) else use, new[use] - first[doc[new[use]]]


def codes_of(bounds: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Signed 64-bit code of each set of shingles."""
    if len(bounds) < 2:
        return np.zeros(0, np.int64)
    both = mix(np.bitwise_xor.reduceat(mix(flat + np.uint64(11)), bounds[:-1]))
    return mix(both + np.add.reduceat(flat, bounds[:-1])).view(np.int64)


def paragraph_clusters(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, min_words: int = MIN_WORDS
                       ) -> DataFrame:
    """One row per paragraph that has copies: doc_id, line_no, n_words, cluster, first_doc, keep.

    Lines count from 0 in the text as it stands. Two paragraphs link when the Jaccard similarity of their shingle
    sets is at least ``percent`` / 100; a cluster's first row by (doc_id, line_no) is kept, null ids last. Lines
    with fewer than ``min_words`` words take no part, so null, empty and blank texts have no rows. Of repeated
    rows with one doc_id and equal lines, all but one count as copies. Other columns are ignored.
    """
    return _clusters(docs, words, percent, min_words)[1].select(
        "doc_id", "line_no", "n_words", "cluster", "first_doc", "keep")


def _clusters(docs: DataFrame, words: int, percent: int, min_words: int, row=None) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): every document, line and span with its node, and the lines that have copies."""
    docs = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bands, n_rows = tune_bands(percent / 100)
    factors = np.array([mix_int(2 * i + 1) | 1 for i in range(n_bands * n_rows)], np.uint64)

    def places(batch):
        for i, j in chunks(batch.column("text")):
            text = batch.column("text").slice(i, j - i)
            doc, line, count, bounds, flat, _, _, word = line_shingles(text, words, min_words)
            ids, row = batch.column("doc_id").slice(i, j - i), batch.column("row").slice(i, j - i)
            # one row without a line for each document, then its paragraphs, then its spans
            yield {"row": row, "doc_id": ids, "line_no": [DOCUMENT] * (j - i), "word": [0] * (j - i),
                   "n_words": [0] * (j - i), "node": pa.nulls(j - i, pa.int64())}
            yield {"row": row.take(pa.array(doc)), "doc_id": ids.take(pa.array(doc)), "line_no": line, "word": word,
                   "n_words": count, "node": codes_of(bounds, flat)}
            doc, word, node = content_spans(text)
            yield {"row": row.take(pa.array(doc)), "doc_id": ids.take(pa.array(doc)),
                   "line_no": np.full(len(doc), SPANS), "word": word, "n_words": np.full(len(doc), SPAN), "node": node}

    def keys(batch):
        for i, j in chunks(batch.column("text")):
            _, _, _, bounds, flat, *_ = line_shingles(batch.column("text").slice(i, j - i), words, min_words)
            node = codes_of(bounds, flat)
            if not len(node):
                continue
            _, once = np.unique(node, return_index=True)
            for band in range(n_bands):
                key = np.full(len(node), np.uint64(mix_int(band + 1)))
                for factor in factors[band * n_rows:(band + 1) * n_rows]:
                    key = mix(key + np.minimum.reduceat(mix(flat * factor), bounds[:-1]))
                yield {"key": key[once].view(np.int64), "node": node[once]}

    rows = cut_lineage(map_batches(docs, places, "row bigint, doc_id bigint, line_no bigint, word bigint, "
                                                 "n_words bigint, node bigint"), "paragraphs")
    # copies of other tasks send the same rows; dealt by key, they meet where the buckets are formed
    bands = map_batches(docs.select("text"), keys, "key bigint, node bigint").repartition("key").distinct()
    buckets = cut_lineage(shared_buckets(bands), "buckets")

    def sets_of(nodes: DataFrame) -> DataFrame:
        def lines(batch):
            for i, j in chunks(batch.column("text")):
                text = batch.column("text").slice(i, j - i)
                _, _, _, bounds, flat, *_ = line_shingles(text, words, min_words)
                node = codes_of(bounds, flat)
                _, once = np.unique(node, return_index=True)
                sets = [flat[bounds[k]:bounds[k + 1]] for k in once]
                yield {"node": node[once], "n": np.diff(bounds)[once], "sketch": [bit_sketch(s) for s in sets],
                       "shingles": [s.tobytes() for s in sets]}
        found = map_batches(docs.select("text"), lines, "node bigint, n bigint, sketch binary, shingles binary")
        return only(found, nodes, "node").dropDuplicates(["node"])

    classes, _ = link_classes(buckets, sets_of, percent)
    placed = rows.where("line_no >= 0")
    of = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"))
    of = of.join(classes, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    totals = of.groupBy("cluster").agg(F.sum("n").alias("copies"), F.min("first").alias("first")).where("copies > 1")
    named = cut_lineage(of.select("node", "cluster").join(totals, "cluster"), "clusters")
    copies = placed.join(named, "node").withColumn("rank", F.row_number().over(_same_place()))
    keep = (_place() == F.col("first")) & (F.col("rank") == 1)
    return rows, copies.select("row", "doc_id", "line_no", "word", "n_words", "cluster",
                               F.col("first.doc_id").alias("first_doc"), keep.alias("keep"))


def _span_copies(rows: DataFrame) -> DataFrame:
    """row, doc_id, word, n_words, first_doc, keep of every span that has copies; its first place is kept."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"), F.col("word"))
    spans = rows.where(F.col("line_no") == SPANS).select("row", "doc_id", "word", "n_words", "node")
    named = spans.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    copies = spans.join(broadcast_if_small(cut_lineage(named, "spans")), "node")
    return copies.select("row", "doc_id", "word", "n_words", F.col("first.doc_id").alias("first_doc"),
                         (place == F.col("first")).alias("keep"))


def _stretches(copies: DataFrame, spans: DataFrame) -> DataFrame:
    """row, doc_id, start, stop, fresh, opens of the removed lines and spans in order: ``fresh`` counts the words
    that none before covers, ``opens`` is 1 where a maximal stretch of removed words begins."""
    columns = ["row", "doc_id", "word", "n_words"]
    gone = copies.where("not keep").select(columns).union(spans.where("not keep").select(columns)).select(
        "row", "doc_id", F.col("word").alias("start"), (F.col("word") + F.col("n_words")).alias("stop"))
    before = F.coalesce(F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(-1))
    return gone.withColumn("before", before).select(
        "row", "doc_id", "start", "stop",
        F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before")).alias("fresh"),
        F.when(F.col("start") > F.col("before"), 1).otherwise(0).alias("opens"))


def _place():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("line_no"))


def _same_place():
    return Window.partitionBy("cluster", "doc_id", "line_no").orderBy(F.lit(1))


def paragraph_report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, min_words: int = MIN_WORDS
                     ) -> DataFrame:
    """Per doc_id: class_id (smallest doc_id reachable over documents that share a paragraph cluster or a span,
    itself without copies), n_paragraphs, n_removed (paragraphs), n_passages_removed (maximal stretches of words in removed
    paragraphs and spans), n_words_removed. Rows of one doc_id are reported together, those without an id as one. Null,
    empty and blank texts have no paragraphs; an empty table gives an empty one; other columns are ignored."""
    rows, copies = _clusters(docs, words, percent, min_words)
    copies, spans = cut_lineage(copies, "copies"), cut_lineage(_span_copies(rows), "span_copies")
    own = rows.where(F.col("line_no") != SPANS).groupBy("doc_id").agg(
        F.sum(F.when(F.col("line_no") >= 0, 1).otherwise(0)).alias("n_paragraphs"))
    columns = ["n_removed", "n_passages_removed", "n_words_removed"]
    none, no_doc = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    parts = copies.select("doc_id", "first_doc", F.when(~F.col("keep"), 1).otherwise(0).alias("n_removed"),
                          none.alias("n_passages_removed"), none.alias("n_words_removed"))
    parts = parts.union(spans.select("doc_id", "first_doc", none, none, none))
    parts = parts.union(_stretches(copies, spans).select("doc_id", no_doc, none, "opens", "fresh"))
    # every document of a cluster is linked to the cluster's first one, so chains over several clusters are kept
    links = copies.select("doc_id", "first_doc").union(spans.select("doc_id", "first_doc")).distinct()
    classes = connected_components(links.select(F.col("doc_id").alias("a"), F.col("first_doc").alias("b"))).select(
        F.col("node").alias("first"), F.col("component").alias("class_id"))
    lost = parts.groupBy("doc_id").agg(F.min("first_doc").alias("first_doc"), *[F.sum(c).alias(c) for c in columns])
    found = own.join(lost.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn(
        "first", F.coalesce("first_doc", "doc_id"))
    return found.join(classes, "first", "left").select(
        "doc_id", F.coalesce("class_id", "first").alias("class_id"), "n_paragraphs",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in columns])


def remove_paragraphs(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``docs`` with the text of every paragraph not kept taken out; a text may become empty.

    Null texts and rows without a doc_id stay as they are; rows of one doc_id lose the same lines. Columns of any name
    are kept; an empty table gives an empty one.
    """
    columns = docs.columns
    docs, names = set_aside(docs, ["_gone", "_gone_id"])
    gone = copies.where("not keep").groupBy(F.col("doc_id").alias("_gone_id")).agg(
        F.collect_set("line_no").alias("_gone"))
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i.cast("bigint")))
    joined = docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNotNull(), F.array_join(lines, "\n")).otherwise(
        F.col("text"))).drop("_gone", "_gone_id").withColumnsRenamed(names).select(*columns)


def remove_passages(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, min_words: int = MIN_WORDS
                    ) -> DataFrame:
    """``docs`` with the words of all removed paragraphs and spans taken out; the white space around them stays.

    Null and empty texts stay as they are; repeated rows are documents of their own, of which the first keeps its
    passages; rows with a null doc_id come last. Columns of any name are kept; an empty table gives an empty one.
    """
    columns = docs.columns
    docs, names = set_aside(docs, ["_row", "_gone"])
    numbered = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows, copies = _clusters(numbered, words, percent, min_words, F.col("_row"))
    gone = _stretches(copies, _span_copies(rows)).groupBy(F.col("row").alias("_row")).agg(
        F.collect_set(F.struct("start", "stop")).alias("_gone"))

    def cut(text: str | None, stretches) -> str | None:
        if text is None or stretches is None or not len(stretches):
            return text
        data = text.encode()
        places = [m.span() for m in re.finditer(rb"[^\t-\r ]+", data)]
        out, at = [], 0
        for start, stop in sorted((x["start"], x["stop"]) for x in stretches):
            out.append(data[at:max(at, places[start][0])])
            at = max(at, places[stop - 1][1])
        return b"".join([*out, data[at:]]).decode()

    @F.pandas_udf("string")
    def cut_all(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([cut(t, g) for t, g in zip(texts, gone)], dtype=object)
    left = numbered.join(gone, "_row", "left").withColumn("text", cut_all("text", "_gone"))
    return left.drop("_row", "_gone").withColumnsRenamed(names).select(*columns)
