"""Segment search, source divergence and pair-index coding against brute force, SQL and the public tokenizer."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapforge.llm import divergence, pair_index, queries, segment_search

CLASH = ["cid", "label_", "ids", "dim", "block", "number", "n", "term", "total", "value", "rank", "part", "means", "a", "b", "place"]


def rows_of(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["op11_segment_filtering", "op12_row_accumulation"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).fetch_df()
    assert len(want) > 50 and list(got.dtypes.sort_index()) == list(want.dtypes.sort_index())
    assert rows_of(got) == rows_of(want)


# ---- hard negatives


def brute_force(rows):
    """The contract, row by row."""
    kept = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        kept.append((vec_id, label, tuple(int(math.floor(256.0 * float(np.float32(x)))) for x in vec)))
    kept = sorted(set(kept))
    out = []
    for a in (r for r in kept if r[0] % 50 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept
                        if r != a and len(r[2]) == len(a[2]))
        for score, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            found = [s for s in scored if s[2] != a[1] and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a[0], positive, k + 1, s[1], -score, -s[0]) for k, s in enumerate(found)]
    return sorted(out)


def embeddings(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return table.withColumns({c: F.lit("z") for c in CLASH})


def mined(spark, rows):
    got = segment_search.mining_report(embeddings(spark, rows)).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in got)


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        centre = np.random.default_rng(i % 4).normal(size=7)
        rows.append((i, (centre + rng.normal(size=7) * (i % 3)).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(1000 + i, rows[50][1], 1) for i in range(300)]              # a large group of copies, with anchors
    rows += [(2000 + i, [0.0] * 7, i % 2) for i in range(120)]            # zero scores, ties everywhere
    rows += [(3000 + 50 * i, [1.0, 2.0, -1.0], i % 2) for i in range(8)] + [(3500, [], 1), (3550, [], 2)]
    rows += [rows[100], rows[150], (100, [0.5] * 7, 2), (None, [1.0] * 7, 1), (4000, None, 1), (4050, [1.0] * 7, None)]
    rows += [(4100, [1.0] * 6 + [None], 1), (4150, [float("nan")] * 7, 1), (4200, [float("inf")] * 7, 2)]
    rows += [(7 * 650, [0.25] * 7, -1), (4501, [0.25] * 7, 2 ** 31 - 1)]
    return rows


def test_mining_against_brute_force(spark, monkeypatch):
    rows = odd_vectors()
    want = brute_force(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    for k, v in (("ROW_BLOCK", 40), ("ANCHOR_BLOCK", 7), ("CHUNK", 9), ("DENSE", 0.6)):
        monkeypatch.setattr(segment_search, k, v)
    assert mined(spark, rows) == want


def test_mining_of_little_and_of_huge_values(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == []
    huge = [(50, [3e38, 1.0], 1), (51, [3e38, 1.0], 1), (52, [3e18, 1.0], 2), (100, [5e6, 5e6], 3), (101, [4e6, 5e6], 3),
            (102, [3e6, 4e6], 4)]
    got = mined(spark, huge)
    assert [r[:4] for r in got if r[0] == 100] == [(100, 101, 1, 102)]
    exact = [65_536 * 5_000_000 * 9_000_000, 65_536 * 5_000_000 * 7_000_000]
    assert [list(r[4:]) for r in got if r[0] == 100] == [exact]
    assert all(r[4] == 2 ** 63 - 1 for r in got if r[0] == 50)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 31, 64):
        x = rng.integers(-300, 300, (40, width)).astype(float)
        exact = x @ x.T
        found = segment_search.levels(*segment_search.segments(x), width)
        widths = []
        for m, d in found:
            assert (m @ m.T + d @ d.T >= exact - 1e-6).all() and (m @ m.T - d @ d.T <= exact + 1e-6).all()
            widths.append(float((d @ d.T).sum()))
        assert widths == sorted(widths, reverse=True)  # finer segments bound more tightly
    assert segment_search.segments(np.zeros((0, 4)))[0].shape == (0, 2)


# ---- divergence


def odd_documents():
    texts = [(None, None, None), ("", None, "a"), ("x y", "en", "a"), ("x", "en", "b")]
    texts += [("Alpha beta \xc9t\xe9 \xe9t\xe9 \xc9T\xc9 b1b_c", "en", f"s{k % 3}") for k in range(30)]
    texts += [("Alpha gamma " * 3000, "de", "only")] * 12 + [("rare word", "fr", None)] * 9 + [("rare word", "fr", "q")] * 3
    texts += [("solo", "it", "u"), ("duo", "it", "v"), ("\x00a\x00", "it", "u")]
    return [(i, *t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("slab, postings", [(128, 100_000), (2, 3)])
def test_divergence_against_sql(spark, monkeypatch, slab, postings):
    monkeypatch.setattr(divergence, "SLAB_GROUPS", slab)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", postings)
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = divergence.divergence_report(docs.withColumns({c: F.lit("z") for c in CLASH})).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    want = con.execute(divergence.ORACLE).fetch_df()
    assert rows_of(got) == rows_of(want)
    zero = got[(got.lang == "it") & (got.part == "pair")]
    assert len(zero) == 2 and (zero.value == 0).all()  # groups without kept terms
    assert divergence.divergence_report(docs.limit(0)).collect() == []


def test_rates_of_very_large_counts(spark):
    n, total = 7 * 10 ** 14, 9 * 10 ** 15
    want = 1 + 10 ** 9 * n // total
    assert divergence.rates(np.array([n]), total)[0] == want
    assert spark.range(1).select(divergence.rate(F.lit(n), F.lit(total)).alias("p")).first().p == want


def test_terms_of_a_batch():
    group, term, n, docs = divergence.term_counts(
        pa.array(["A a b", None, "ab\xdf c", "c-C"]), np.array([0, 0, 1, 0]))
    found = {(g, t): (k, d) for g, t, k, d in zip(group.tolist(), term.to_pylist(), n.tolist(), docs.tolist())}
    assert found == {(0, "a"): (2, 1), (0, "b"): (1, 1), (1, "ab\xdf"): (1, 1), (1, "c"): (1, 1), (0, "c"): (2, 1)}


# ---- byte-pair coding


def odd_texts():
    letters = [32, 10, 39, 97, 115, 116, 48, 0x3B1, 0x660, 0x4E00, 0x1F600, 0xA0, 0x2009, 0x558, 45, 60, 124, 0x10940, 0]
    rng = np.random.default_rng(0)
    texts = [None, "", " ", "a" * 70_000, "the " * 30_000, "ab" * 5_000, "a<|endoftext|>b  <|endoftext|>", "<|endoftext", "don't I'LL we'll"]
    return texts + ["".join(map(chr, rng.choice(letters, 60))) for _ in range(200)]


def test_pair_index_against_the_tokenizer(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(pair_index.tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(10 ** 6 + i // 2 if i else None, t) for i, t in enumerate(odd_texts())], "doc_id bigint, text string"))
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = pair_index.round_trip_report(docs.withColumns({c: F.lit("z") for c in CLASH}))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert pair_index.round_trip_report(docs.limit(0)).collect() == []
    odd = pair_index.decode_documents(spark.createDataFrame(
        [(1, np.array([50256, 64], "<u4").tobytes()), (2, None), (3, np.array([447], "<u4").tobytes())], "doc_id int, ids binary"))
    decoded = {r.doc_id: r.text for r in odd.collect()}
    assert decoded == {1: own.decode([50256, 64], skip_special_tokens=False), 2: "", 3: own.decode([447])}


def test_forgetting_pieces_changes_nothing(monkeypatch):
    texts = odd_texts()
    index = pair_index.PairIndex(pair_index.tokenizer_path())
    want = index.encode(texts)
    monkeypatch.setattr(pair_index, "CACHE_PIECES", 5)
    assert [index.encode([t])[0] for t in texts] == want


def test_other_kinds_of_tokenizers_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        pair_index.PairIndex(public_tokenizers.path("word_bpe_49k.json"))
