"""How the word use of each source differs from the other sources of its language.

Term counts come from all documents: every task counts the distinct words of its texts exactly and sends one row per
(language, source, term), which partial aggregation merges again. A term's smoothed rate in a group is
``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))``, and two rates differ by ``f = floor((p - q)^2 / (p + q))``.

The divergence of two groups sums f over all V kept terms of the language, also those that neither has. It is found
by row accumulation over a term-major index: the terms of a language are dealt into blocks, and in a block every
group scatters its terms through their postings into one dense accumulator per peer. No posting pair leaves a
task. What a pair of groups has where one side or both lack the term depends on the baseline rate
``p0 = 1 + floor(10^9 * 2 / (N + 2 V))`` only. With a = p0 of the group, b = p0 of the peer:

    sum = V f(a, b)  +  sum over the group's terms of f(p, b) - f(a, b)  +  the same for the peer's terms
          + sum over shared terms of f(p, q) - f(p, b) - f(a, q) + f(a, b)

All of it is integer arithmetic; counts of up to 9 * 10^15 words a language stay exact in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.tables import broadcast_if_small, cut_lineage, map_batches
from lapforge.llm.texts import chunks, raw_bytes

MIN_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS, STEP = 3, 1_000     # 10^9 in steps, so that no product leaves 64 bits
BLOCK_POSTINGS = 100_000         # postings of a block of terms, on average
SLAB_GROUPS = 128                # groups that are accumulated in one cell
COUNT_BYTES = 1 << 24            # texts that a task counts at once, or one text


def _letters() -> np.ndarray:
    """For each byte what it is in a term: lower-cased, or 0 between terms."""
    to = np.arange(256, dtype=np.uint8)
    to[:65] = 0
    to[65:91] += 32
    to[91:97] = 0
    to[123:128] = 0
    return to


LETTERS = _letters()


def term_counts(text: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts with the term) of the texts of a batch, each belonging to a group number."""
    data, offsets = raw_bytes(text)
    letters = LETTERS[data]
    inside = letters > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    # the letters of all terms in a row are the values of a string array
    before = np.cumsum(inside)
    bounds = np.r_[before[starts] - 1, before[-1] if len(before) else 0].astype(np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters[inside].tobytes())])
    coded = values.dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    width = max(len(terms), 1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    once, times = np.unique(doc * width + code, return_counts=True)
    both, inverse = np.unique(group[once // width] * width + once % width, return_inverse=True)
    occurrences = np.bincount(inverse, weights=times, minlength=len(both)).astype(np.int64)
    docs = np.bincount(inverse, minlength=len(both))
    return both // width, terms.take(pa.array(both % width)), occurrences, docs


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all texts; a row with a null term stands for each group that occurs."""
    def count(batch):
        text = batch.column("text")
        pair = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        width = max(len(pair[1].dictionary), 1)
        of_row = pair[0].indices.to_numpy().astype(np.int64) * width + pair[1].indices.to_numpy()
        seen = np.unique(of_row)

        def named(group):
            return {"lang": pair[0].dictionary.take(pa.array(group // width)),
                    "source": pair[1].dictionary.take(pa.array(group % width))}
        yield {**named(seen), "term": pa.nulls(len(seen), pa.string()), "n": [0] * len(seen), "docs": [0] * len(seen)}
        for a, b in chunks(text, COUNT_BYTES):
            group, term, n, with_term = term_counts(text.slice(a, b - a), of_row[a:b])
            yield {**named(group), "term": term, "n": n, "docs": with_term}

    chosen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = map_batches(chosen, count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * n / total) for n <= total, by long division."""
    quotient, rest = F.lit(0).cast("bigint"), n
    return 1 + F.aggregate(
        F.array(*[F.lit(0)] * SCALE_STEPS), F.struct(quotient.alias("q"), rest.alias("r"), total.alias("d")),
        lambda s, _: F.struct(
            (s["q"] * STEP + F.call_function("div", s["r"] * STEP, s["d"])).alias("q"),
            (s["r"] * STEP % s["d"]).alias("r"), s["d"].alias("d")),
        lambda s: s["q"])


def rates(n: np.ndarray, total) -> np.ndarray:
    """The same on arrays."""
    quotient, rest = np.zeros_like(n), n
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        quotient, rest = quotient * STEP + rest // total, rest % total
    return quotient + 1


def gap(p, q):
    return (p - q) * (p - q) // (p + q)


def accumulate(group: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, rows: range):
    """For each group of ``rows``: its number and one sum per group, over the block's terms and without V f(a, b).

    The sum for a peer has what the group's own terms add, and what shared terms add if the peer comes later, so both
    directions together are the whole. ``group``, ``term``, ``n`` are postings, ``totals`` the N + 2 V of every group.
    """
    size = len(totals)
    base = rates(np.full(size, 2, np.int64), totals)
    order = np.lexsort((group, term))
    group, term, n = group[order], term[order], n[order]
    p = rates(n + 2, totals[group])
    begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    ends = np.r_[begins[1:], len(term)].astype(np.int64)
    of = np.repeat(np.arange(len(begins)), ends - begins)
    by_group = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by_group], np.arange(size + 1))
    for i in rows:
        mine = by_group[cuts[i]:cuts[i + 1]]
        row = np.zeros(size, np.int64)  # the dense accumulator of this group
        # what its terms differ from the baselines of all peers, once for every different rate
        own, times = np.unique(p[mine], return_counts=True)
        neither = gap(base[i], base)
        for rate_, times_ in zip(own.tolist(), times.tolist()):
            row += times_ * (gap(rate_, base) - neither)
        for k in range(0, len(mine), 4096):
            part = mine[k:k + 4096]
            # the postings of later groups in the same terms
            lengths = ends[of[part]] - part - 1
            at = np.repeat(part + 1 - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            peer, mine_p, peer_p = group[at], np.repeat(p[part], lengths), p[at]
            np.add.at(row, peer, gap(mine_p, peer_p) - gap(mine_p, base[peer]) - gap(base[i], peer_p) + neither[peer])
        yield i, row


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the group numbers a < b of each language.

    ``kept`` (lang, number, term, n): the postings; ``groups`` (lang, number, total, v): all groups with N + 2 V and
    V. A cell is a block of terms and a slab of groups that are accumulated; it holds one dense row at a time.
    """
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_POSTINGS)).cast("bigint").alias("blocks"))
    grid = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLAB_GROUPS)).cast("bigint").alias("slabs")).join(
        sizes, "lang", "left").na.fill(1, ["blocks"])
    grid = broadcast_if_small(cut_lineage(grid, "grid"))  # one row per language, so no join deals out by language
    each = [F.explode(F.expr(f"sequence(0l, {n}s - 1)")).alias(n) for n in ("slab", "block")]
    dealt = kept.join(grid, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), each[0], "term", "number", "n")
    sent = groups.join(grid, "lang").select("lang", each[1], "slabs", "number", "total", "v").select(
        F.col("lang").alias("of_lang"), F.col("block").alias("of_block"), F.explode(F.expr("sequence(0l, slabs - 1)")).alias("of_slab"),
        *[F.col(c).alias(f"of_{c}") for c in ("number", "total", "v")])

    def block_sums(postings: pa.Table, facts: pa.Table) -> pa.Table:
        order = np.argsort(facts["of_number"].to_numpy())
        totals, v = facts["of_total"].to_numpy()[order], facts["of_v"][0].as_py()
        size, slab = len(totals), facts["of_slab"][0].as_py()
        rows, names = range(slab * SLAB_GROUPS, min(size, (slab + 1) * SLAB_GROUPS)), np.arange(size)
        if v:
            code = pa.compute.rank(postings["term"], tiebreaker="dense").to_numpy().astype(np.int64)
            found = accumulate(postings["number"].to_numpy(), code, postings["n"].to_numpy(), totals, rows)
            base = rates(np.full(size, 2, np.int64), totals) if facts["of_block"][0].as_py() == 0 else None
        else:  # a language without terms: its pairs are 0
            found, base = ((i, np.zeros(size, np.int64)) for i in rows), None
        a, b, value = [], [], []
        for i, row in found:
            if base is not None:  # once for each pair
                row[i + 1:] += v * gap(base[i], base[i + 1:])
            others = names != i
            a.append(np.minimum(names, i)[others])
            b.append(np.maximum(names, i)[others])
            value.append(row[others])
        return pa.table({"lang": pa.array([facts["of_lang"][0].as_py()] * (len(rows) * (size - 1)), pa.string()),
                         **{k: np.concatenate(x) for k, x in (("a", a), ("b", b), ("value", value))}})

    sums = dealt.groupBy("lang", "block", "slab").cogroup(sent.groupBy("of_lang", "of_block", "of_slab")).applyInArrow(
        block_sums, "lang string, a bigint, b bigint, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, peer, value), (lang, source, term, value)): how far each source is from every other source of its
    language, and the terms that a source has and uses more than its language does, with their distance.

    Null texts, languages and sources are read as ''. A term counts for a language if ``min_docs`` of its documents
    have it. Every group that occurs takes part, also one without terms; where a language keeps no term all its pairs
    have the value 0. A language with one source has no pair. Repeated rows are documents of their own; an empty
    table gives empty results; other columns are ignored.
    """
    counted = cut_lineage(count_terms(docs), "terms")
    # all sources of a term meet: at most one row for each source
    of_term = Window.partitionBy("lang", "term")
    kept = cut_lineage(counted.where("term is not null").withColumns({
        "in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)}).where(
        F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "kept")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("v"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counted.where("term is null").select("lang", "source").join(by_group, ["lang", "source"], "left").join(
        by_lang, "lang", "left").na.fill(0, ["own", "lang_total", "v"])
    groups = cut_lineage(groups.withColumns({
        "number": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1,
        "total": F.col("own") + 2 * F.col("v"), "lang_total": F.col("lang_total") + 2 * F.col("v")}), "groups")

    numbered = kept.join(broadcast_if_small(groups.select("lang", "source", "number", "total", "lang_total")), ["lang", "source"])
    sums = pair_sums(numbered.select("lang", "number", "term", "n"), groups.select("lang", "number", "total", "v"))
    names = groups.select("lang", "number", "source")
    pairs = sums.join(names.withColumnsRenamed({"number": "a", "source": "source_a"}), ["lang", "a"]).join(
        names.withColumnsRenamed({"number": "b", "source": "source_b"}), ["lang", "b"])
    pairs = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("peer"), "value"),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("peer"), "value"))).alias("x")).select("lang", "x.*")

    compared = numbered.withColumns({"p": rate(F.col("n") + 2, F.col("total")),
                                     "q": rate(F.col("lang_n") + 2, F.col("lang_total"))})
    terms = compared.where("p > q").select(
        "lang", "source", "term", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return pairs, terms


def divergence_report(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all peers of a source (part ``pair``) by falling value, then item, and its
    first ``TOP_TERMS`` terms (part ``term``). Edge cases as in ``source_divergence``."""
    pairs, terms = source_divergence(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    peers = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value").withColumn(
        "rank", F.row_number().over(order))
    first = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return peers.select(columns).union(first.select(columns))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (
  SELECT g.lang, g.source, coalesce(any_value(v.v), 0)::HUGEINT AS v, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, vocab.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * gn.v) AS p
  FROM gn JOIN vocab USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = vocab.term),
l AS (
  SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total,
    count(*) OVER (PARTITION BY lang) AS v FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total::HUGEINT + 2 * v) AS q FROM l),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
QUALIFY rank <= 10
"""
