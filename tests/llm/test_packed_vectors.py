"""Vectors of op11 travel as the bytes of the smallest integers that hold them."""

import numpy as np
from pyspark.sql import functions as F

from lapforge.llm import segment_search


def test_packing_is_exact_and_small():
    edges = [0, 1, -1, 2 ** 15 - 1, -2 ** 15, 2 ** 15, -2 ** 15 - 1, 2 ** 31 - 1, -2 ** 31, 2 ** 31, 2 ** 62, -2 ** 63, 2 ** 63 - 1]
    vectors = np.array([[x, 5, -7] for x in edges], np.int64)
    packed = segment_search.packed_vectors(vectors)
    assert [len(p) // 3 for p in packed] == [2] * 5 + [4] * 4 + [8] * 4
    assert (segment_search.unpacked_vectors(packed, 3) == vectors).all()
    empty = segment_search.packed_vectors(np.zeros((4, 0), np.int64))
    assert empty == [b""] * 4 and segment_search.unpacked_vectors(empty, 0).shape == (4, 0)
    assert segment_search.packed_vectors(np.zeros((0, 3), np.int64)) == []


def test_cells_receive_no_arrays_of_numbers(spark):
    """They received 8 bytes a component, and a mean and a deviation of 8 bytes for every two."""
    rows = spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"),
                                   F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.col("id") * 7919 * i) % 511 - 255).alias("vec"))
    classes = segment_search.vector_classes(rows, 6)
    assert classes.columns == ["cid", "dim", "label", "vec", "ids", "packed"]
    assert {len(r.packed) for r in classes.collect()} == {128}
    plan = segment_search.nearest_same(classes, classes, 6)._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Relation" not in line and "vec#" in line]
    assert not moved and "packed#" in plan


def test_many_live_pairs_are_gathered_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    q, r = (segment_search.Vectors(rng.integers(-99, 99, (n, 12))) for n in (30, 50))
    allowed = rng.random((30, 50)) < 0.05
    low, high = np.full(30, -2000), np.full(30, 3000)
    whole = segment_search.search(q, r, low, high, allowed)
    monkeypatch.setattr(segment_search, "PAIRS", 5)
    parts = segment_search.search(q, r, low, high, allowed)
    product = q.exact @ r.exact.T
    a, b = np.nonzero(allowed & (product >= -2000) & (product <= 3000))
    assert all((x == y).all() for x, y in zip(whole, parts)) and (whole[0] == a).all() and (whole[1] == b).all()
