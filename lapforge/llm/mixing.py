"""Mixing sources to target weights by blocks of words. DataFrame functions only.

The words of a source, in doc_id order, are cut into blocks of ``BLOCK`` words. Every output shard draws its source
counts from the multinomial of the targets (one uniform number per slot, looked up in the cumulative targets); slots
that a source drew beyond its target are handed to sources that drew too few, so every source gets exactly its
number of slots. Slot k of a source takes block perm(k mod blocks) of epoch k div blocks, with a pseudorandom
permutation per source and epoch (swap-or-not, valid for any number of blocks), and blocks meet documents by an
equi-join on the block index. All draws are hashes of (seed, source, slot), so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.tables import broadcast_if_small, cut_lineage

BLOCK = 64            # words of a block
SHARD_SLOTS = 1_024   # blocks of an output shard
MOST_REPEATS = 3      # a target is at most so many times its source
SEED = 20_240
ROUNDS = 24           # of the permutation
SEGMENT = 65_536      # rows of a part of a running sum, on average
SPACE = r"[ \t\n\x0B\f\r]+"


def scramble(*parts: Column) -> Column:
    """A pseudorandom non-negative integer of integers."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 1)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 for every key: in each round x and its partner (k - x mod n) swap or stay."""
    def step(x, r):
        partner = F.pmod(scramble(*key, r) - x, n)
        return F.when(scramble(*key, r + 1_000, F.greatest(x, partner)) % 2 == 0, x).otherwise(partner)
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint"))
    return F.aggregate(rounds, index.cast("bigint"), step)


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``key``, nulls of ``order`` last, which has to be total.

    The rows are dealt by ranges of key and order, so neither a hot key, outlying values nor many nulls make one
    task large; sums run inside the parts and over the totals of the parts.
    """
    ordered = [F.col(c).asc_nulls_last() for c in order]
    n = rows.count()
    # the parts of a key meet in one task: their number grows with the root of the rows
    parts = max(1, math.ceil(n / max(SEGMENT, math.isqrt(n))))
    dealt = rows.repartitionByRange(parts, F.col(key), *ordered).withColumn("_part", F.spark_partition_id())
    cut = cut_lineage(dealt, "parts")  # a part's number holds once it is written down
    totals = cut.groupBy(key, "_part").agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inside = Window.partitionBy(key, "_part").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return cut.join(totals, [key, "_part"]).withColumn(out, (F.col("_ahead") + F.col("_inside")).cast("bigint")).drop(
        "_part", "_ahead", "_inside")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, weight, target) of a table (source, size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the total by weight; none exceeds
    ``MOST_REPEATS`` times its size, what is over is shared by weight among the others (water filling: sources
    are full in ascending order of limit / weight).
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    named = by.withColumn("sid", rank.cast("bigint")).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    named = named.withColumn("_cap", MOST_REPEATS * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = named.withColumns({
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0)),
        "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    }).withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    # the first source that is not full sets the level of all that follow
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("weight"), "sid", "_left", "_weights"))).over(every)
    staged = staged.withColumn("_level", level)
    return staged.select("source", "sid", "source_size", "weight", F.when(
        F.col("_full"), F.col("_cap").cast("double")).otherwise(
        F.col("weight") * F.col("_level._left") / F.col("_level._weights")).cast("double").alias("target"))


def look_up(rows: DataFrame, value: str, intervals: DataFrame, total: int, count: int) -> DataFrame:
    """``rows`` with the columns of the interval lo <= value < hi that their value lies in.

    An equi-join on buckets of the values' range 0..total-1: an interval has a row for each bucket that it touches, in
    all at most twice as many as there are intervals. Which side moves is left to the measured sizes.
    """
    width = F.lit(max(1, -(-total // max(1, count))))
    div = lambda x: F.call_function("div", x, width)
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1))))
    return rows.withColumn("_bucket", div(F.col(value))).join(spread, "_bucket").where(
        (F.col("lo") <= F.col(value)) & (F.col(value) < F.col("hi"))).drop("_bucket", "lo", "hi")


def draw_slots(sources: DataFrame) -> DataFrame:
    """(shard, slot, sid, epoch, block) of the whole mix. ``sources`` (sid, blocks, slots) has a row per source."""
    spark = sources.sparkSession
    ordered = Window.orderBy("sid")  # a row per source
    intervals = cut_lineage(sources.where("slots > 0").withColumn("hi", F.sum("slots").over(ordered)).select(
        "sid", (F.col("hi") - F.col("slots")).alias("lo"), "hi"), "intervals")
    size = intervals.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    total = int(size["total"])
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD_SLOTS).cast("bigint").alias("shard"),
                                      (F.col("id") % SHARD_SLOTS).alias("slot"))
    thrown = slots.withColumn("u", scramble(F.col("shard"), F.col("slot")) % F.lit(max(total, 1)))
    drawn = look_up(thrown, "u", intervals, total, size["n"]).select("shard", "slot", "sid")
    # the number of a slot within its source: counts of the earlier shards, then inside the shard
    counts = drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(running_sum(counts, "sid", ["shard"], "n", "before"), "counts")
    inside = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    numbered = drawn.join(counts.select("sid", "shard", "before"), ["sid", "shard"]).withColumn(
        "k", F.col("before") + inside).drop("before")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    balance = cut_lineage(sources.where("slots > 0").join(got, "sid", "left").select(
        "sid", "slots", F.coalesce("got", F.lit(0)).alias("got")).withColumns({
            "over": F.greatest(F.col("got") - F.col("slots"), F.lit(0)),
            "short": F.greatest(F.col("slots") - F.col("got"), F.lit(0))}).withColumns({
                "over_before": F.sum("over").over(ordered) - F.col("over"),
                "short_before": F.sum("short").over(ordered) - F.col("short")}), "balance")
    needy = balance.where("short > 0").select(
        F.col("sid").alias("other"), F.col("got").alias("other_got"), F.col("short_before").alias("first_spare"),
        F.col("short_before").alias("lo"), (F.col("short_before") + F.col("short")).alias("hi"))
    lacking = balance.agg(F.coalesce(F.sum("short"), F.lit(0)).alias("total"), F.count_if(F.col("short") > 0).alias("n")).first()
    numbered = cut_lineage(numbered.join(broadcast_if_small(balance.select("sid", "slots", "over_before")), "sid"), "numbered")
    spare = numbered.where("k >= slots").withColumn("spare", F.col("over_before") + F.col("k") - F.col("slots"))
    moved = look_up(spare, "spare", needy, int(lacking["total"]), lacking["n"]).select(
        "shard", "slot", F.col("other").alias("sid"), (F.col("other_got") + F.col("spare") - F.col("first_spare")).alias("k"))
    settled = numbered.where("k < slots").select("shard", "slot", "sid", "k").union(moved)
    placed = settled.join(broadcast_if_small(sources.select("sid", "blocks")), "sid")
    epoch = F.floor(F.col("k") / F.col("blocks")).cast("bigint")
    return placed.select("shard", "slot", "sid", epoch.alias("epoch"), permuted(
        F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sid"), epoch).alias("block"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "size": F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("bigint"), "_tie": F.xxhash64("text")})


def plan_mix(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, sources, slots) for a stored table ``rows`` (row, doc_id, source, size, _tie).

    placed: the rows with sid, start (words of the source before the document); sources: the targets and numbers
    of blocks and slots; slots: the mix. Repeated doc_ids follow in order of their texts.
    """
    sources = source_targets(rows).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, F.least(F.round(
        F.col("target") * F.col("blocks") / F.col("source_size")), MOST_REPEATS * F.col("blocks"))).otherwise(
        F.lit(0)).cast("bigint"))
    sources = cut_lineage(sources, "sources")
    named = rows.join(broadcast_if_small(sources.select("sid", F.col("source").alias("_source"))),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_sum(named, "sid", ["doc_id", "_tie", "row"], "size", "start")
    return cut_lineage(placed, "placed"), sources, draw_slots(sources)


def _touched(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """(row, block, lo, hi, uses): the words lo..hi-1 of a document in each of its blocks, and the block's uses."""
    uses = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").select("row", "sid", "start", "size", F.explode(
        F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("block"))
    cut = cut.select("row", "sid", "block", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("lo"),
                     F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("hi"))
    return cut.join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    A null or blank text has size 0 and gives nothing; null sources are a source of their own; a null doc_id comes
    after all others. An empty table gives an empty one. Other columns are ignored.
    """
    rows = _sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", "size", "_tie")
    placed, sources, slots = plan_mix(cut_lineage(rows, "sizes"), block)
    taken = _touched(placed, slots, block).groupBy("row").agg(F.sum(F.col("uses") * (F.col("hi") - F.col("lo"))).alias("taken"))
    return placed.join(taken, "row", "left").join(
        broadcast_if_small(sources.select("sid", "source_size", "target")), "sid").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows of ``docs``: a document whose blocks are all used k times comes k times as it is, and once
    more for each further use with the words of the blocks used that often, joined by single spaces (n_chars
    follows). Null, empty and blank texts give no row, null sources are a source of their own, null doc_ids come after
    all others and stay null, repeated rows are documents of their own; an empty table gives an empty one. Columns of
    any name are kept."""
    # the row itself stays in one column, so its names cannot clash with those used here
    numbered = cut_lineage(_sized(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_doc"))).drop(
        "text").withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = numbered.select(F.col("_row").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.col("source").cast("string").alias("source"), "size", "_tie")
    placed, _, slots = plan_mix(rows, block)
    parts = _touched(placed, slots, block).groupBy("row").agg(
        F.min("uses").alias("whole"), F.sort_array(F.collect_list(F.struct("lo", "hi", "uses"))).alias("pieces"))
    joined = numbered.join(parts, F.col("_row") == F.col("row"))
    words = F.filter(F.split("_doc.text", SPACE), lambda w: w != "")
    most = F.array_max(F.transform("pieces", lambda p: p["uses"]))
    numbers = F.sequence(F.lit(1).cast("bigint"), most)
    copies = joined.where(most > 0).withColumn("_copy", F.explode(numbers))
    # the words, split once, and of them the pieces that this copy has
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        F.filter("pieces", lambda p: p["uses"] >= F.col("_copy")),
        lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")), 1)
    text = F.when(F.col("_copy") <= F.col("whole"), F.col("_doc.text")).otherwise(part)
    copies = copies.select("_doc", text.alias("_text"))
    replaced = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return copies.select(*[replaced.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
