"""N-gram Jaccard self-join by parity sketches.

Every distinct shingle of a text flips one bit of a sketch that is cut into pieces; equal sets have equal
sketches, and the number of pieces that differ is at most the Hamming distance, which is at most the size of
the symmetric difference of the sets. Sets of sizes x and y with similarity t differ in at most
(1 - t) / (1 + t) * (x + y) shingles. So of one piece more than that, one is equal in both sketches, and an
equi-join on (size band, piece, value) finds every pair (pigeonhole). A piece has 2**64 bits; it is carried as
the XOR of the positions of its set bits. The exact similarity is computed from the texts afterwards.

Bands overlap, so that any two sizes within the ratio t meet in a band. Pieces without a shingle would be equal
in unrelated texts: a sketch has ``spare`` pieces more, so pairs have ``spare + 1`` equal pieces, and a text with
at most ``spare`` empty pieces sends only its full ones. A text with more of them is sketched again with another
seed, where it meets all others of that kind; after the last seed empty pieces are sent as well, which keeps the
join exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.near_links import bit_sketch, count_links, link_classes, only, shared_buckets
from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches
from lapforge.llm.texts import chunks, mix, mix_int, shingle_sets

SEEDS = 4
BAND_RATIO = 1.7


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, pieces, spare) of the one or two bands in which a set of ``n`` shingles takes part."""
    j = _band(n)
    out = [(j, *_layout(j, percent))]
    low = _low(j)
    if j and percent * n <= 100 * (low - 1):  # a set of the band below may be similar
        out.append((j - 1, *_layout(j - 1, percent)))
    return out


def _low(j: int) -> int:
    """Smallest size of band ``j``."""
    return math.ceil(BAND_RATIO ** j)


def _band(n: int) -> int:
    j = max(0, int(math.log(n, BAND_RATIO)) - 1)
    while _low(j + 1) <= n:
        j += 1
    return j


def _layout(j: int, percent: int) -> tuple[int, int]:
    top = _low(j + 1) - 1                      # largest size of the band
    reach = top * 100 // percent               # largest size it can be similar to
    most = (100 - percent) * (top + reach) // (100 + percent)
    spare = 0 if most == 0 else 1 + most // 12
    return most + 1 + spare, spare


def sketch_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of one set of shingle hashes."""
    out = []
    for band, pieces, spare in bands(len(shingles), percent):
        for seed in range(SEEDS):
            bits = mix(shingles + np.uint64(mix_int(7919 * seed + 1)))
            piece = (bits >> np.uint64(32)) % np.uint64(pieces)
            order = np.argsort(piece, kind="stable")
            piece, bits = piece[order], bits[order]
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            values = np.bitwise_xor.reduceat(bits, first)
            salt = np.uint64(mix_int((band * SEEDS + seed) * 1_000_003 + 17))
            out.append(mix(mix(values + salt) + piece[first]))
            empty = pieces - len(first)
            if empty <= spare:
                break
            if seed == SEEDS - 1:
                missing = np.setdiff1d(np.arange(pieces, dtype=np.uint64), piece[first])
                out.append(mix(mix(np.zeros(len(missing), np.uint64) + salt) + missing))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def set_code(shingles: np.ndarray) -> int:
    """A signed 64-bit code of a set of shingles."""
    both = np.array([np.bitwise_xor.reduce(mix(shingles + np.uint64(11))), np.add.reduce(shingles)], np.uint64)
    return int(mix(mix(both[:1]) + both[1:] + np.uint64(len(shingles))).view(np.int64)[0])


def parity_sketch_join(docs: DataFrame, words: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, and n_links if ``links`` is set:
    the number of other rows whose text links with this one's, copies of it included.

    Two texts link when the Jaccard similarity of their sets of ``words``-word shingles (A-Z lower-cased) is at
    least ``percent`` / 100; the component is the smallest doc_id reachable by links. A text with fewer words is
    one shingle; a null or wordless text has none and links with nothing, not even its copies. Copies share a
    node, so a large group of copies costs one comparison. Repeated doc_ids keep a row each. A null doc_id keeps
    its row and takes part; it is the component only where no member has an id. Other columns are ignored.
    """
    if not 60 <= percent <= 100:
        raise ValueError("bands are laid out for similarities of 60 to 100 percent")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def codes(batch):
        text = batch.column("text")
        sizes, found = [], []
        for s in shingle_sets(text, words):
            sizes.append(len(s))
            found.append(set_code(s) if len(s) else None)
        yield {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "node": found}

    def keys(batch):
        text = batch.column("text")
        sent: set[int] = set()  # codes of this batch
        nodes, parts = [], []
        for s in shingle_sets(text, words):
            if not len(s):
                continue
            code = set_code(s)
            if code in sent:
                continue
            sent.add(code)
            k = sketch_keys(s, percent)
            parts.append(k)
            nodes.append(np.full(len(k), code, np.int64))
            if sum(map(len, parts[-64:])) > 1 << 16:
                yield {"key": np.concatenate(parts).view(np.int64), "node": np.concatenate(nodes)}
                nodes, parts = [], []
        if parts:
            yield {"key": np.concatenate(parts).view(np.int64), "node": np.concatenate(nodes)}

    rows = cut_lineage(map_batches(docs, codes, "doc_id bigint, n_shingles bigint, node bigint"), "codes")
    # copies of other tasks send the same rows; dealt by key, they meet where the buckets are formed
    sketches = map_batches(docs.select("text"), keys, "key bigint, node bigint").repartition("key").distinct()
    buckets = cut_lineage(shared_buckets(sketches), "buckets")

    def sets_of(nodes: DataFrame) -> DataFrame:
        first = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        chosen = only(docs, first.where("doc_id is not null").select("doc_id"), "doc_id").union(
            docs.where("doc_id is null"))

        def keyed(batch):
            for i, j in chunks(batch.column("text")):
                text = batch.column("text").slice(i, j - i)
                sets = list(shingle_sets(text, words))
                yield {"node": [set_code(s) if len(s) else None for s in sets], "n": [len(s) for s in sets],
                       "sketch": [bit_sketch(s) for s in sets], "shingles": [s.tobytes() for s in sets]}
        found = map_batches(chosen.select("text"), keyed, "node bigint, n bigint, sketch binary, shingles binary")
        return only(found.where("node is not null"), nodes, "node").dropDuplicates(["node"])

    classes, sets = link_classes(buckets, sets_of, percent)
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where(
        "node is not null")
    grouped = own.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "component").select("node", "component_id", "copies")
    columns = ["doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id")]
    if links:
        # a link counts once for every row of the other text
        others = count_links(classes, sets, own.select("node", "copies"), percent)
        named = named.join(others, "node", "left")
        columns.append(F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"))
    return rows.join(named, "node", "left").select(*columns)


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; of repeated doc_ids of that kind all stay
    out, and rows without an id stay in."""
    drop = parity_sketch_join(docs, words, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(broadcast_if_small(drop), "doc_id", "left_anti")
