"""Operators of the llm subpackage against brute force, exact round trips and edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.llm import id_coder, kneser_ney, latent_leaks, line_quality, line_runs, mixing, paragraphs, parity_join
from lapforge.llm import queries, token_files, toxicity
from lapforge.llm.components import connected_components
from lapforge.llm.html_paths import extract_pages, main_text
from lapforge.llm.near_links import bit_sketch, fold, similar_sets
from lapforge.llm.texts import shingle_sets
from tools.check_oracle import cell

SPACE = re.compile("[ \t-\r]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SENTENCE = " ".join(f"alpha{i}" for i in range(60)) + "."
EDGE = [  # doc_id, text, lang, source, n_chars
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one", "de", "a", 3),
    (5, SENTENCE, "en", "b", 1), (6, SENTENCE, "en", "b", 1), (6, SENTENCE, "en", "b", 1), (None, SENTENCE, "en", "b", 1),
    (7, SENTENCE.replace("alpha7 ", "beta "), "en", "b", 1), (8, LONG, "fr", "c", 9), (9, LONG + " tail", "fr", "c", 9),
    (10, "x\nx\nx\nx", "en", "a", 7), (11, "menu | home | about\n" + SENTENCE, "en", "a", 1), (None, None, None, None, None),
]
CLASH = ["node", "key", "component", "component_id", "size", "row", "p", "sid", "start", "block", "kept", "toxic", "n", "a", "b"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("z") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def words_of(text, lower=True):
    text = text or ""
    if lower:
        text = text.translate({k: k + 32 for k in range(65, 91)})
    return [w for w in SPACE.split(text) if w]


def shingles(text, k):
    w = words_of(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def classes_by_force(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: root(i) for i in sets}


def report(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
    b = np.unique(np.r_[a[:500], rng.integers(0, 2**63, 40).astype(np.uint64)])
    x, y = (np.frombuffer(bit_sketch(s), np.uint64) for s in (a, b))
    size = min(len(x), len(y))
    assert int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= len(np.setxor1d(a, b))


def test_pieces_find_every_similar_pair():
    """Pigeonhole: sets at the threshold share a key, at all sizes, also where pieces are empty."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1200]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(4):
            out = int(len(a) * rng.uniform(0, 0.18))
            b = np.unique(np.r_[a[out:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)])
            if not similar_sets(a, b, 85):
                continue
            assert np.intersect1d(parity_join.sketch_keys(a, 85), parity_join.sketch_keys(b, 85)).size


def test_parity_join(documents, texts):
    got = report(parity_join.parity_sketch_join(documents, 4, 85))
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = classes_by_force(sets, 85)
    assert {i: (len(sets[i]), want[i]) for i in texts} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_parity_join_counts_links(spark):
    """A group of different near copies, copies of one of them, and a text apart: every link is counted."""
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(base[:5 * i] + [f"new{i}"] + base[5 * i + 1:]) for i in range(1, 25)}
    texts |= {i: " ".join(base[:40 + 9 * (i - 30)]) for i in range(30, 48)} | {50: texts[3], 51: texts[3], 60: "apart"}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    docs = spark.createDataFrame([*texts.items(), (70, None), (71, None)], "doc_id bigint, text string")
    got = report(parity_join.parity_sketch_join(docs, 4, 85, links=True))
    assert {i: r["n_links"] for i, r in got.items()} == want | {70: 0, 71: 0} and len(set(want.values())) > 3


@pytest.mark.parametrize("block, dense", [(512, 16), (7, 0), (7, 10**9)])
def test_links_in_blocks(spark, monkeypatch, block, dense):
    """Classes cut into several blocks, intersections by matrices and one by one."""
    from lapforge.llm import near_links
    for name, value in (("BLOCK", block), ("DENSE_PAIRS", dense), ("COLUMNS", 50)):
        monkeypatch.setattr(near_links, name, value)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 5))):
            w[k] = f"z{i}x{k}"
        texts[i] = " ".join(w[int(rng.integers(0, 9)):])
    texts |= {100: texts[5], 101: texts[5], 102: "few words"}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = report(parity_join.parity_sketch_join(spark.createDataFrame([*texts.items()], "doc_id bigint, text string"), 4, 85, links=True))
    assert {i: r["n_links"] for i, r in got.items()} == want and len(set(want.values())) > 8
    force = classes_by_force(sets, 85)
    assert {i: r["component_id"] for i, r in got.items()} == {i: force[i] for i in sets}


def test_parity_join_edges(edge, empty):
    rows = parity_join.parity_sketch_join(edge, 4, 85).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert len(rows) == len(EDGE) and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(1, 4)]
    assert by[6] == [(57, 5)] * 2 and sorted(by[None], key=str) == [(0, None), (57, 5)] and by[9][0][1] == 8
    assert by[7] == [(57, 5)]  # 53 of 61 shingles
    assert parity_join.parity_sketch_join(empty).collect() == []
    assert parity_join.one_of_each_class(edge, 4, 85).where("doc_id in (5, 6, 7, 8, 9)").count() == 2


def test_paragraphs(documents, texts, edge, empty):
    rows = [(i, n) for i, t in texts.items() for n, x in enumerate((t or "").split("\n")) if len(words_of(x)) >= 20]
    sets = {k: shingles(texts[k[0]].split("\n")[k[1]], 5) for k in rows}
    numbers = {k: i for i, k in enumerate(sorted(sets))}
    cluster = classes_by_force({numbers[k]: s for k, s in sets.items()}, 80)
    size = Counter(cluster.values())
    want = {k: cluster[numbers[k]] == numbers[k] for k in rows if size[cluster[numbers[k]]] > 1}
    got = {(r.doc_id, r.line_no): r.keep for r in paragraphs.paragraph_clusters(documents).collect()}
    assert got == want and len(got) > 10
    per = report(paragraphs.paragraph_report(edge))
    assert per[5]["n_removed"] == 0 and per[6]["n_removed"] == 2 and per[7]["class_id"] == 5 and per[1]["n_paragraphs"] == 0
    assert per[None]["n_removed"] == 1 and per[9]["class_id"] == 8
    assert paragraphs.paragraph_report(empty).collect() == []
    left = report(paragraphs.remove_paragraphs(edge.where("doc_id in (5, 11)"), paragraphs.paragraph_clusters(edge)))
    assert left[5]["text"] == SENTENCE and left[11]["text"] == "menu | home | about"
    bands, rows_ = paragraphs.tune_bands(0.8)
    assert 1 - (1 - 0.8 ** rows_) ** bands >= 0.999


def test_columns_of_any_name_are_kept(spark):
    names = ["_row", "_gone", "_GONE_ID", "_words", "_Lines", "_passed", "_all_chars"]
    rows = spark.createDataFrame([(1, SENTENCE), (2, SENTENCE), (3, None), (None, "")], "doc_id bigint, text string")
    rows = rows.withColumns({c: F.lit(c) for c in names})
    for left in (paragraphs.remove_passages(rows), paragraphs.remove_paragraphs(rows, paragraphs.paragraph_clusters(rows)),
                 line_quality.clean_lines(rows).select(*rows.columns)):
        assert left.columns == rows.columns
        found = left.collect()
        assert len(found) == 4 and all(r[c] == c for r in found for c in names)
    texts = {r.doc_id: r.text for r in paragraphs.remove_passages(rows).collect()}
    assert texts == {1: SENTENCE, 2: "", 3: None, None: ""}


def test_passages_by_force(spark, documents, texts):
    """Every shared window of 51 words, in whatever lines, shares a span; the planted ones by hand, the others too."""
    import pyarrow as pa
    rng = np.random.default_rng(11)
    fill = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    passage = fill(51)
    short = "\n".join(" ".join((fill(7) + passage + fill(5))[i:i + 9]) for i in range(0, 63, 9))
    more = {10**6: " ".join(fill(300) + passage + fill(200)), 10**6 + 1: " ".join(fill(40) + passage + fill(700)),
            10**6 + 2: short, 10**6 + 3: " ".join(fill(60) + passage[:24] + fill(60))}
    every = texts | more
    first, pairs = {}, set()
    for i in sorted(every):
        w = words_of(every[i])
        for k in range(len(w) - 50):
            holder = first.setdefault(tuple(w[k:k + 51]), i)
            if holder != i:
                pairs.add((holder, i))
    assert {(10**6, 10**6 + 1), (10**6, 10**6 + 2)} < pairs and len(pairs) > 5
    ids = sorted(every)
    doc, word, code = paragraphs.content_spans(pa.array([every[i] for i in ids], pa.string()))
    spans = defaultdict(set)
    for d, p, c in zip(doc, word, code):
        spans[ids[d]].add(c)
        assert p + paragraphs.SPAN <= len(words_of(every[ids[d]]))
    assert all(spans[a] & spans[b] for a, b in pairs)
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    got = report(paragraphs.paragraph_report(docs))
    assert got[10**6 + 1]["class_id"] == got[10**6 + 2]["class_id"] == 10**6 and got[10**6 + 3]["class_id"] == 10**6 + 3
    assert got[10**6]["n_words_removed"] == 0 and got[10**6 + 3]["n_words_removed"] == 0
    for i in (10**6 + 1, 10**6 + 2):
        assert got[i]["n_passages_removed"] == 1 and 25 <= got[i]["n_words_removed"] <= 51
    left = report(paragraphs.remove_passages(docs.where("doc_id >= 1000000")))
    for i, t in more.items():
        assert len(words_of(left[i]["text"])) == len(words_of(t)) - got[i]["n_words_removed"]


def test_paragraph_classes_are_components(spark):
    """Documents 5 and 6 share Q; 5 also shares P with 1, and Q is first in 2."""
    p, q, r = (" ".join(f"{x}{i}" for i in range(30)) for x in "pqr")
    docs = spark.createDataFrame([(1, p), (2, q), (5, f"{p}\n{q}"), (6, q), (7, r), (8, f"{r}\n{r}"), (9, "alone"),
                                  (None, p)], "doc_id bigint, text string")
    got = {i: r["class_id"] for i, r in report(paragraphs.paragraph_report(docs)).items()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9, None: 1}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(tuple(cell(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]


def test_line_quality_edges(edge, empty):
    rows = line_quality.line_quality_report(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[10].n_dup_lines == 3
    assert by[10].n_repeat_words == 4 and by[5].kept and by[11].n_lines_kept == 1 and by[8].n_words == 30_000
    assert line_quality.clean_lines(edge).where("doc_id = 11").first().clean_text == SENTENCE
    assert line_quality.line_quality_report(empty).collect() == []


def test_line_runs_edges(edge, empty):
    got = report(line_runs.line_run_report(edge))
    assert got[10] == {"doc_id": 10, "n_lines": 4, "n_removed": 3, "n_runs": 1, "chars_removed": 3}
    assert got[1]["n_lines"] == 0 and got[6]["n_lines"] == 2 and len(got) == 12
    assert line_runs.line_run_report(empty).collect() == []
    left = report(line_runs.remove_line_runs(edge.where("doc_id in (1, 10)")))
    assert left[10]["text"] == "x" and left[1]["text"] == ""
    with pytest.raises(ValueError):
        line_runs.repeated_runs(edge, 3)


def test_single_line_runs(spark):
    """A hot line between unlike neighbours stays in its first place only."""
    docs = spark.createDataFrame([(i, f"own {i}\nhot line\nmore {i}") for i in range(5)], "doc_id bigint, text string")
    got = report(line_runs.line_run_report(docs, min_lines=1))
    assert [got[i]["n_removed"] for i in range(5)] == [0, 1, 1, 1, 1]
    assert "op9_single_line_dedup" in queries.QUERIES and "op9_single_line_dedup" in queries.ORACLES


def test_mix(spark, documents, edge, empty):
    rows = mixing.mix_report(documents).toPandas()
    again = mixing.mix_report(documents.repartition(5)).toPandas()
    pd.testing.assert_frame_equal(*[x.sort_values("doc_id", ignore_index=True) for x in (rows, again)])
    assert rows["size"].sum() > 0 and (rows.taken <= 3 * rows["size"]).all()
    source = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    rows["source"] = rows.doc_id.map(source)
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = pd.Series([i % 3 + 1 for i in range(len(by))], by.index)
    target, full = pd.Series(0.0, by.index), pd.Series(False, by.index)
    while True:  # share again by weight until no source is above its limit
        left = by["size"].sum() - 3 * by["size"][full].sum()
        target = (3 * by["size"]).where(full, weights * left / weights[~full].sum())
        above = ~full & (target > 3 * by["size"])
        if not above.any():
            break
        full |= above
    assert np.allclose(by.target, target) and (abs(by.taken - by.target) <= 3 * mixing.BLOCK + 0.02 * by.target).all()
    odd = mixing.mix_report(edge).collect()
    assert len(odd) == len(EDGE) and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.mix_report(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.where("component = 'z'").count() == mixed.count() > 0
    got = documents.sparkSession.createDataFrame(rows[["doc_id", "taken"]])
    words = mixing.mixed_documents(documents).groupBy("doc_id").agg(F.sum(F.size(F.filter(
        F.split("text", mixing.SPACE), lambda w: w != ""))).alias("n"))
    assert got.join(words, "doc_id", "left").where("taken <> coalesce(n, 0)").count() == 0


def test_running_sum_of_odd_places(spark, monkeypatch):
    """Outlying, repeated and null places, a hot key: sums as one ordered list gives them, parts of bounded size."""
    monkeypatch.setattr(mixing, "SEGMENT", 50)
    rows = [("hot" if i % 4 else "cold", None if i % 3 == 0 else (10**17 if i == 7 else i % 40), i, i % 11) for i in range(1500)]
    table = spark.createDataFrame(rows, "k string, place bigint, row bigint, v bigint")
    got = {r.row: r.before for r in mixing.running_sum(table, "k", ["place", "row"], "v", "before").collect()}
    totals = Counter()
    for k, place, row, v in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        assert got[row] == totals[k]
        totals[k] += v
    assert len(got) == 1500 and mixing.running_sum(table.limit(0), "k", ["place"], "v", "before").collect() == []


def test_mix_of_outlying_and_null_ids(spark):
    texts = [(None if i % 3 == 0 else (10**15 if i == 4 else i), " ".join(f"w{i}" for _ in range(1 + i % 50)), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    rows = mixing.mix_report(docs).toPandas()
    assert len(rows) == 400 and (rows.taken <= 3 * rows["size"]).all()
    for size, part in rows.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 3 * mixing.BLOCK


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(4), F.lit(0)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 9000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.tile(rng.integers(0, 300, 50), n // 50 + 1)[:n], np.full(n, 65535)):
        data = id_coder.encode_blocks(ids)
        assert (id_coder.decode_blocks(data) == ids).all()
    if n > 4096:
        assert len(data) < n / 4
        data = id_coder.encode_blocks(rng.integers(0, 65536, n))
        with pytest.raises(ValueError):
            id_coder.decode_blocks(data[:n] + bytes([data[n] ^ 1]) + data[n + 1:])
    with pytest.raises(ValueError):
        id_coder.encode_blocks([65536])


def test_token_files(documents, texts, edge, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    got, start = report(token_files.token_report(documents)), 0
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_files.token_report(edge).orderBy("start").collect()
    assert len(rows) == len(EDGE) and rows[0].doc_id is None and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert token_files.token_report(empty).collect() == []
    odd = ["a\x1cb  c<|endoftext|>d", "É é don't x1 ²", " "]
    assert [np.frombuffer(x, "<u2").tolist() for x in token_files.Encoder(token_files.tokenizer_path()).encode(odd)] == [
        tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


PAGE = """<html><head><title>No</title><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/b">No</a></ul></nav><div class="cookie-notice">No, no. No.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>er text,
 with&nbsp;more words. It goes on, and on.<br>Next<p>Second paragraph, with text; and an end.
<div class="ad">Buy, now. Really.</div><form>Name, please. <input></form></article>
<section id="comments"><p>No comment, none. At all, really.</p></section><footer>&copy; no</footer></body></html>"""


def test_html(spark):
    want = "Head & line First bolder text, with more words. It goes on, and on. Next Second paragraph, with text; and an end."
    assert main_text(PAGE) == want
    plain = "<body><div><p>Some text, that is long enough. It has marks, too.</p><p>More of it, and more. End.</p></div>" \
            "<div><a href=x>One</a> <a href=y>Two</a></div></body>"
    assert main_text(plain) == "Some text, that is long enough. It has marks, too. More of it, and more. End."
    rows = spark.createDataFrame([(1, "u", None, 1), (None, None, "", 1), (2, "v", "<p>a <", 1), (3, "w", PAGE, 1), (3, "w", PAGE, 1)],
                                 "page_id bigint, url string, html string, text int")
    got = extract_pages(rows).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted([("", 0), ("", 0), ("a <", 3), (want, len(want)), (want, len(want))])
    assert extract_pages(rows.limit(0)).collect() == []


def test_kneser_ney(spark, edge, empty, sf_dir):
    train = spark.createDataFrame([("the cat sat on the mat. the cat ran.",), ("a dog sat on a log",), (None,)], "text string")
    tables = kneser_ney.train(train)
    model = 2.0 ** kneser_ney.fill(tables).astype(float)
    assert np.allclose(model.reshape(-1, 64).sum(axis=1), 1, atol=1e-4)   # every context is a distribution
    grams = Counter()
    for text in ("the cat sat on the mat. the cat ran.", "a dog sat on a log"):
        s = [0, 0, 0] + [int(kneser_ney.alphabet()[ord(c)]) for c in text]
        grams.update(tuple(s[i:i + 4]) for i in range(len(s) - 3))

    def probability(gram, counts):
        """Plain recursion: discounted share plus weight times the lower order."""
        if not gram:
            return 1 / 64
        lower = Counter(g[1:] for g in counts)
        d = kneser_ney.discounts([sum(1 for c in counts.values() if c == i) for i in (1, 2, 3, 4)])
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        rest = probability(gram[1:], lower)
        total = sum(own.values())
        if not total:
            return rest
        cut = sum(d[min(c, 3) - 1] for c in own.values())
        c = own.get(gram, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + cut / total * rest
    for gram in [*list(grams)[:12], (1, 2, 3, 4), (20, 8, 5, 5), (0, 20, 8, 9)]:
        at = int(np.dot(gram, 64 ** np.arange(3, -1, -1)))
        assert model[at] == pytest.approx(probability(gram, grams), rel=1e-3)
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = kneser_ney.perplexity_report(edge, labels).collect()
    assert len(rows) == len(EDGE) and {r.kept for r in rows if r.doc_id in (1, 2)} == {False}
    assert all(r.kept for r in rows if r.doc_id in (4, 5, 8))
    assert kneser_ney.perplexity_report(empty, labels).collect() == []
    full = queries.QUERIES["op6_kneser_ney_perplexity"](spark, sf_dir).toPandas()
    assert len(full) == 200 and full.kept.mean() > 0.6


def test_toxicity(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    scored = toxicity.score_chain(docs.where("doc_id % 4 = 1"), toxicity.train_chain(docs, train))
    rows = scored.drop("quality").join(held.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    bad, good = rows[rows.y > 0], rows[rows.y == 0]
    assert len(bad) > 50 and bad.toxic.mean() > 0.85 and good.toxic.mean() < 0.01
    for known in (labels.limit(0), labels.where("toxic = 0").limit(20)):
        chain = toxicity.train_chain(docs, known)
        assert toxicity.score_chain(edge, chain).where("toxic").count() == 0
    assert toxicity.score_chain(edge, chain).count() == len(EDGE) and toxicity.score_chain(empty, chain).collect() == []


def test_logistic_model_is_converged():
    """Against plain gradient descent on a dense table."""
    rng = np.random.default_rng(3)
    y = (rng.random(80) < 0.3).astype(float)
    x = (rng.random((80, 6)) < np.where(np.arange(6) < 2, 0.2 + 0.5 * y[:, None], 0.4)).astype(float)
    dense = rng.normal(size=(80, 1)) + y[:, None]
    rows, columns = np.nonzero(x)
    got = toxicity.fit_logistic(rows, columns, dense, y, 6, tolerance=1e-7)
    scale, weight = toxicity.relevance(rows, columns, y, 6), np.where(y > 0, 0.5 / y.sum(), 0.5 / (80 - y.sum()))
    for j in range(6):  # the statistic from its four cells
        n, share = x[:, j].sum(), y.mean()
        seen = ((x[:, j] * y).sum() - n * share) ** 2 / (n * share * (1 - share) * (1 - n / 81) + 1e-9)
        assert abs(scale[j] ** 2 * toxicity.WEIGHT_CHI - seen) < 1e-9
    full, w = np.column_stack([x * scale, dense, np.ones(80)]), np.zeros(8)
    for _ in range(40_000):
        slope = full.T @ (weight * (1 / (1 + np.exp(-full @ w)) - y))
        w -= 0.5 * (slope + toxicity.PENALTY * np.r_[w[:-1], 0])
    want = np.r_[w[:6] * scale, w[6:]]
    assert np.abs(got - want).max() < 1e-2 * np.abs(want).max()


def test_chain_step_by_step(spark):
    """Scores of a tiny table against a plain chain: folds, out-of-fold margins, a second model that sees them."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        bad = i % 5 == 0
        words = [f"w{k}" for k in rng.integers(0, 12, 6)] + (["vile", "rude"] if bad else ["kind"])
        rows.append((i, " ".join(words), int(i % 3 > 0), int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    chain = toxicity.train_chain(table.select("doc_id", "text"), table.select("doc_id", "quality", "toxic"))
    folds = {r.doc_id: r.f for r in table.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)).alias("f")).collect()}
    fold = np.array([folds[i] for i in range(90)])
    found = toxicity.Features(chain.vocabulary, chain.numbers).rows([t for _, t, _, _ in rows])
    width = len(chain.vocabulary)
    assert width == 12 + 3  # all words of the table, none of which has a beginning of its own
    x = np.zeros((90, width))
    for i, f in enumerate(found):
        x[i, f] = 1
    before = np.zeros((90, 0))
    for k, column in enumerate((2, 3)):
        y = np.array([r[column] for r in rows], float)
        fit = lambda part: toxicity.fit_logistic(*np.nonzero(x[part]), before[part], y[part], width)
        assert np.allclose(chain.weights[k], fit(np.arange(90)), atol=1e-6)
        z = np.zeros(90)
        for f in range(5):
            w = fit(np.flatnonzero(fold != f))
            z[fold == f] = (x @ w[:width] + before @ w[width:-1] + w[-1])[fold == f]
        before = np.column_stack([before, np.clip(z, -20, 20)])
    assert np.isclose(chain.threshold, toxicity.best_threshold(np.array([r[3] for r in rows], float), before[:, 1]))
    scored = {r.doc_id: r for r in toxicity.score_chain(table, chain).collect()}
    assert all(scored[i].toxic == bool(rows[i][3]) for i in range(90))
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200_000))), (2, "vile rude " * 100_000), (2, "vile rude")],
                                 "doc_id bigint, text string")
    assert [r.toxic for r in toxicity.score_chain(long, chain).orderBy("doc_id").collect()] == [False, True, True]


def test_packed_features():
    for numbers in ([], [0], [3, 4, 900], [5, 70_000, 70_001], list(range(0, 10**6, 7))):
        assert toxicity.unpack(toxicity.pack(numbers)).tolist() == numbers


def test_threshold_of_ties():
    assert toxicity.best_threshold(np.array([1, 1, 0, 0.0]), np.array([2.0, 2, 2, -1])) == 0.5
    assert toxicity.best_threshold(np.array([1, 0.0]), np.array([3.0, 3])) == 2.0
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == float("inf")


def plain_leak(item, answer, words):
    """Whether some stretch has enough of item and answer, over all stretches, by the plain recurrence."""
    for a in range(len(words)):
        row, last = [0] * (len(item) + 1), [0] * (len(answer) + 1)
        for b in range(a, len(words)):
            for table, wanted in ((row, item), (last, answer)):
                before = 0
                for j, x in enumerate(wanted):
                    before, table[j + 1] = table[j + 1], before + 1 if x == words[b] else max(table[j + 1], table[j])
            if (row[-1] >= latent_leaks.COVER * len(item) and row[-1] >= latent_leaks.PRECISION * (b - a + 1)
                    and last[-1] >= latent_leaks.ANSWER * len(answer)):
                return True
            if b - a + 1 > len(item) / latent_leaks.PRECISION:
                break
    return False


def test_leaks_of_odd_items(spark):
    items = [(1, "go go go go go go alpha beta gamma delta"), (2, "Paris"), (3, "the the the"), (4, "one two three four five\nsix")]
    docs = [(1, "go go go go go go alpha beta gamma delta"), (2, "it is Paris"), (3, "the cat the dog the"), (4, "alpha beta"),
            (5, "one three four five six"), (6, "go go go go go go beta delta"), (7, "x " * 50_000 + "Paris " + "y " * 50_000),
            (8, None), (9, "go go go go go go")]
    got = {(r.doc_id, r.item_id) for r in latent_leaks.benchmark_leaks(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    short = [d for d in docs if d[0] != 7]
    want = {(i, k) for i, t in short for k, x in items if plain_leak(words_of(x), words_of(latent_leaks.answer_of(x)), words_of(t))}
    assert {p for p in got if p[0] != 7} == want and (7, 2) in got and {(1, 1), (2, 2), (5, 4)} <= want


def test_leaks(spark, documents, texts, edge, empty, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    want = {(i, k) for i, t in texts.items() for k, x in bench.items() if x in (t or "")}
    changed = []  # paraphrases: words dropped and replaced inside a clean text
    for k, x in list(bench.items())[:10]:
        w = x.split(" ")
        if len(w) >= 20:
            w[3], w[9] = "changed", "other"
            del w[14]
            changed.append((900 + k, "Some words before it. " + " ".join(w) + " And a few after.", k))
    more = documents.select("doc_id", "text").union(spark.createDataFrame([c[:2] for c in changed], "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in latent_leaks.benchmark_leaks(more, items).collect()}
    planted = {(c[0], c[2]) for c in changed}
    assert want <= got and len(got & planted) >= 0.9 * len(planted) and len(planted) > 2
    texts = texts | {c[0]: c[1] for c in changed}
    for doc, item in got:  # brute force: the common subsequence is there
        a, b = words_of(bench[item]), words_of(texts[doc])
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert row[-1] >= latent_leaks.COVER * len(a)
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, SENTENCE, 0), (2, SENTENCE, 0)], "item_id bigint, text string, doc_id int")
    found = latent_leaks.benchmark_leaks(edge, odd).collect()
    assert {r.doc_id for r in found} == {5, 6, 7, 11, None}
    assert latent_leaks.benchmark_leaks(edge, odd.limit(0)).collect() == [] and latent_leaks.benchmark_leaks(empty, odd).collect() == []


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = np.array([f"w{k}" for k in range(160)])
    items = [(k, " ".join(names[k * 8:k * 8 + 40])) for k in range(16)]
    docs = [(i, None if i % 97 == 0 else " ".join(rng.choice(names, rng.integers(1, 200), p=np.arange(160) / 12_720)))
            for i in range(2500)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    seen, fit = [], latent_leaks._basis

    def watched(rows, block):
        seen.append((block, fit(rows, block), rows.count()))
        return seen[-1][1]
    monkeypatch.setattr(latent_leaks, "_basis", watched)
    latent_leaks.benchmark_leaks(table, spark.createDataFrame(items, "item_id bigint, text string"))
    (block, basis, n), gram = seen[0], np.zeros((160, 160))
    assert n == len(docs)
    for words, first in (latent_leaks.word_hashes(latent_leaks.pa.array([t for _, t in part], latent_leaks.pa.string())) for part in (docs, items)):
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            for k in range(a, b, latent_leaks.WINDOWS[-1]):
                x = np.zeros(160)
                np.add.at(x, np.searchsorted(block.terms, words[k:min(k + latent_leaks.WINDOWS[-1], b)]), 1)
                x *= block.idf
                gram += np.outer(x, x) / (x @ x)
    assert basis.shape == (160, latent_leaks.RANK) and np.allclose(basis.T @ basis, np.eye(latent_leaks.RANK), atol=1e-6)
    values = np.linalg.eigvalsh(gram)[::-1]
    found = np.diag(basis.T @ gram @ basis)
    assert abs(found[0] / values[0] - 1) < 1e-3 and found.sum() > 0.97 * values[:latent_leaks.RANK].sum()


def test_leaks_with_rare_words_replaced(spark, documents, sf_dir):
    """Items without their rarest third of words; expected is what brute force over all stretches accepts."""
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = documents.select("doc_id", "text")
    df = Counter(w for r in docs.collect() for w in set(words_of(r.text)))
    planted, want = [], set()
    for k, x in bench.items():
        w = words_of(x, lower=False)
        for i in sorted(range(len(w)), key=lambda i: df[w[i].lower()])[:int(0.35 * len(w))]:
            w[i] = f"zz{k}y{i}"
        planted.append((10**6 + k, "Some words before it. " + " ".join(w) + " And a few after.", k))
        if plain_leak(words_of(x), words_of(latent_leaks.answer_of(x)), words_of(planted[-1][1])):
            want.add((10**6 + k, k))
    more = docs.union(spark.createDataFrame([c[:2] for c in planted], "doc_id bigint, text string"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in latent_leaks.benchmark_leaks(more, items).collect()}
    assert len(want) > 10 and len(got & want) >= 0.9 * len(want)


def test_shingles_of_nulls():
    import pyarrow as pa
    assert [len(s) for s in shingle_sets(pa.array([None, "", "a b", "A b c d e f"]), 5)] == [0, 0, 1, 2]
