"""From bucket memberships to classes of near-duplicate texts, without listing all pairs of a bucket.

Given (key, node) rows such that any two linked nodes share a key, the classes are found in two steps. In a star
round every bucket compares its members with one centre only, so a bucket of n copies costs n comparisons. What
no star joined is searched exactly afterwards: in the buckets that still hold several classes, bit sketches are
compared in blocks inside the tasks, and only pairs of different classes whose sketches allow the wanted
similarity leave them for the exact test. Pairs within a class are skipped, since a further link could not change
it, so no link between classes is lost.

Links are counted class by class, as every link lies in one: a class is cut into blocks, each two blocks meet in one
task, sketches and then exact intersections decide every pair once, and only the counts of the nodes leave the task.

The sketch of a set flips one bit per element. The Hamming distance of two sketches is at most the symmetric
difference of the sets, so a pair beyond the bound is certainly not similar. Sketches of different lengths are
folded to the shorter one, which keeps that bound.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.components import connected_components
from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches
from lapforge.llm.texts import mix

STAR_ROUNDS = 1
BLOCK = 512        # nodes of a bucket or class that are compared at once
BLOCK_SHINGLES = 1 << 21   # shingles of a block of a class, on average
COLUMNS = 4_096    # shingles of a piece of an intersection matrix
DENSE_PAIRS = 16   # pairs a node from which intersections are computed for a block at once
SKETCH_BITS = 14   # sketches have at most 2**14 bits


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of a set of hashes, about four bits per element."""
    bits = 1 << min(SKETCH_BITS, max(6, int(4 * len(shingles)).bit_length()))
    at = (mix(shingles + np.uint64(0x51ED270B)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """XOR the 64-bit words of a sketch down to ``size`` words."""
    return words if len(words) == size else np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def most_difference(x, y, percent: int):
    """Largest symmetric difference of sets of sizes x and y that are similar."""
    return (100 - percent) * (x + y) // (100 + percent)


def similar_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of 100 * intersection >= percent * union on sorted distinct hashes."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shared_buckets(keys: DataFrame) -> DataFrame:
    """(key, node, members) of buckets with two nodes or more; ``keys`` has distinct rows."""
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return keys.withColumn("members", size).where("members > 1")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one matrix, folded to the shortest of them."""
    words = [np.frombuffer(s, np.uint64) for s in sketches]
    least = min(map(len, words))
    return np.stack([fold(w, least) for w in words])


def possible_pairs(table: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """For every row of ``left`` the rows of ``right`` that sizes and sketches do not rule out; of two equal ranges,
    later ones only."""
    same = left is right
    for k, i in enumerate(left):
        rest = right[k + 1:] if same else right
        if len(rest):
            far = np.bitwise_count(table[rest] ^ table[i]).sum(axis=1, dtype=np.int64)
            ok = ((far <= most_difference(size[i], size[rest], percent))
                  & (np.minimum(size[rest], size[i]) * 100 >= percent * np.maximum(size[rest], size[i])))
            yield i, rest[ok]


def close_pairs(nodes: list[int], classes: list[int], sizes: list[int], sketches: list[bytes], own: list[int], i: int, j: int,
                percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different classes, one of block ``i`` and one of block ``j``, that sizes and sketches do not rule out."""
    node, group, size, block = (np.array(x, np.int64) for x in (nodes, classes, sizes, own))
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    a, b = [node[:0]], [node[:0]]
    if len(left) and len(right):
        for k, hit in possible_pairs(folded(sketches), size, left, right, percent):
            hit = hit[group[hit] != group[k]]
            a.append(np.minimum(node[k], node[hit]))
            b.append(np.maximum(node[k], node[hit]))
    return np.concatenate(a), np.concatenate(b)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right``, by products of 0/1 matrices over
    the shingles that occur on both sides."""
    values, at = np.unique(np.concatenate([sets[k] for k in [*left, *right]]), return_inverse=True)
    lengths = [len(sets[k]) for k in [*left, *right]]
    row = np.repeat(np.arange(len(lengths)), lengths)
    here, there = np.zeros(len(values), bool), np.zeros(len(values), bool)
    here[at[row < len(left)]] = True
    there[at[row >= len(left)]] = True
    number = np.cumsum(here & there) - 1
    keep = (here & there)[at]
    row, column = row[keep], number[at[keep]]
    out = np.zeros((len(left), len(right)), np.float32)  # counts stay below 2^24
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        table = np.zeros((len(lengths), COLUMNS), np.float32)
        table[row[lo:hi], column[lo:hi] - k] = 1
        out += table[:len(left)] @ table[len(left):].T
    return out.astype(np.int64)


def block_links(sizes: np.ndarray, sketches: list[bytes], sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray,
                right: np.ndarray, percent: int) -> np.ndarray:
    """For each node the copies of the nodes of the other block that it links with."""
    others = np.zeros(len(sizes), np.int64)
    pairs = [(i, hit) for i, hit in possible_pairs(folded(sketches), sizes, left, right, percent) if len(hit)]
    if sum(len(hit) for _, hit in pairs) > DENSE_PAIRS * len(left):
        place = np.full(len(sizes), -1)
        place[right] = np.arange(len(right))
        shared, row = intersections(sets, left, right), {int(i): k for k, i in enumerate(left)}
    else:
        shared = None
    for i, hit in pairs:
        if shared is None:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in hit])
        else:
            both = shared[row[int(i)], place[hit]]
        hit = hit[100 * both >= percent * (sizes[i] + sizes[hit] - both)]
        others[i] += copies[hit].sum()
        others[hit] += copies[i]
    return others


def link_classes(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """((node, component) of all nodes with a link of ``percent`` similarity, (node, n, sketch, shingles) of all nodes).

    ``buckets`` (key, node, members): a stored table; ``sets_of(nodes)`` gives (node, n, sketch, shingles) for the nodes
    asked for, shingles as sorted distinct 64-bit hashes.
    """
    weights = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    info = cut_lineage(sets_of(weights.select("node")), "sets")
    weighted = cut_lineage(buckets.join(weights, "node").select("key", "node", "weight"), "weighted")

    def mixed(classes: DataFrame | None) -> DataFrame:
        """Bucket rows with their class, of buckets that hold several classes."""
        if classes is None:
            return weighted.withColumn("component", F.col("node"))
        rows = weighted.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        w = Window.partitionBy("key")
        return rows.withColumns({"lo": F.min("component").over(w), "hi": F.max("component").over(w)}).where(
            "lo < hi").drop("lo", "hi")

    def check(pairs: DataFrame) -> DataFrame:
        """The linked ones of (a, b): first by sketches, which are short, then by the texts of what is left."""
        def possible(batch):
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")]
            for i, (x, y, s, t) in enumerate(zip(*columns)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                size = min(len(s), len(t))
                if int(np.bitwise_count(fold(s, size) ^ fold(t, size)).sum()) <= most_difference(x, y, percent):
                    keep.append(i)
            yield {c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")}

        def decide(batch):
            one, two = (batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b"))
            ok = [similar_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(one, two)]
            batch = batch.filter(pa.array(ok, pa.bool_()))
            yield {"a": batch.column("a"), "b": batch.column("b")}

        def both(rows, of, columns):
            # a node with very many pairs is split by the adaptive skew join
            for x in ("a", "b"):
                rows = rows.join(of.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
            return rows
        near = cut_lineage(map_batches(both(pairs, info, ("n", "sketch")), possible, "a bigint, b bigint"), "near")
        used = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        return map_batches(both(near, only(info, used, "node"), ("shingles",)), decide, "a bigint, b bigint")

    def rest(rows: DataFrame) -> DataFrame:
        """(a, b) of different classes in one bucket that the sketches allow; buckets are cut into blocks."""
        blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / F.lit(BLOCK)))
        cut = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        sent = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
            "key", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        full = sent.join(info.select("node", "n", "sketch"), "node")
        full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

        def compare(batches):
            held, at = ([], [], [], [], []), None
            out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

            def emit():
                a, b = close_pairs(*held, *at[1:], percent)
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "component", "n", "sketch", "own")]
                for k, i, j, *row in zip(*columns):
                    if (k, i, j) != at:
                        if at is not None and len(held[0]) > 1:
                            yield emit()
                        held, at = ([], [], [], [], []), (k, i, j)
                    for to, value in zip(held, row):
                        to.append(value)
            if at is not None and len(held[0]) > 1:
                yield emit()
        return full.select("key", "i", "j", "node", "component", "n", "sketch", "own").mapInArrow(
            compare, "a bigint, b bigint").distinct()

    classes, links = None, None
    for round_number in range(STAR_ROUNDS + 1):
        rows = mixed(classes)
        if round_number < STAR_ROUNDS:
            order = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
            starred = rows.withColumns({"centre": F.first("node").over(order),
                                        "centre_class": F.first("component").over(order)})
            pairs = starred.where("component <> centre_class").select(
                F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        else:
            pairs = rest(rows)
        found = cut_lineage(check(pairs), "links")
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            classes = cut_lineage(connected_components(links), "classes")
    if classes is None:
        classes = info.where("false").select("node", F.col("node").alias("component"))
    return classes, info


def count_links(classes: DataFrame, info: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(node, others): for every node of a class the copies of all other nodes that it links with.

    ``classes`` and ``info`` as from ``link_classes``; ``copies`` (node, copies) says how many texts a node stands for. A
    class of n nodes takes a quadratic number of sketch comparisons, in as many tasks as it has pairs of blocks.
    """
    sets = info.join(classes, "node").join(copies, "node")
    blocks = sets.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    own = sets.join(broadcast_if_small(cut_lineage(blocks.where("blocks > 1"), "blocks")), "component", "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    sent = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "copies",
        "sketch", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    out = pa.schema([("node", pa.int64()), ("others", pa.int64())])

    def count(batches):
        held, at = [], None

        def emit():
            block, nodes, sizes, copies_ = (np.array(x, np.int64) for x in list(zip(*held))[:4])
            left = np.flatnonzero(block == at[1])
            right = left if at[1] == at[2] else np.flatnonzero(block == at[2])
            if not len(left) or not len(right):
                return None
            others = block_links(sizes, [x[4] for x in held], [np.frombuffer(x[5], np.uint64) for x in held], copies_,
                                 left, right, percent)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(others)], schema=out)
        for batch in batches:
            for k, i, j, *row in zip(*[batch.column(c).to_pylist() for c in (
                    "component", "i", "j", "own", "node", "n", "copies", "sketch", "shingles")]):
                if (k, i, j) != at:
                    found = emit() if held else None
                    if found is not None:
                        yield found
                    held, at = [], (k, i, j)
                held.append(row)
        found = emit() if held else None
        if found is not None:
            yield found
    return sent.mapInArrow(count, "node bigint, others bigint").groupBy("node").agg(F.sum("others").alias("others"))


def only(rows: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is among ``nodes``: by broadcast if a count allows, else by a shuffle."""
    return rows.join(broadcast_if_small(nodes), on, "left_semi")
