"""Ordered scans that stay parallel when one key holds most of the rows.

``Window.partitionBy(session)`` puts a whole session into one task, which is no plan when one group holds a third of
a 100 TB table. A ``Timeline`` cuts groups into *segments* of a bounded number of rows, computed from the order value
itself: the rows of every group are counted by coarse buckets of that value, buckets with too many rows are counted
by finer ones, and neighbouring buckets are joined up to segments. How coarse the first buckets are follows from the
densest group, so that the buckets are about as many as the segments. Windows run per (keys, segment); what has to cross
a border (last known value, row offset) is taken from one summary row per segment. A group within the bound is one
segment, and where that is so for all groups there is no border to cross and nothing to look up.

The rows are neither sampled, nor sorted or stored for that, and move once. The histogram has a row per bucket and is
read as a lookup, which the optimizer broadcasts by its measured size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.session import cut_lineage

MAX_GROUP_ROWS = 1_000_000  # rows of a segment; up to twice as many where buckets do not divide evenly
FIRST_STEP, STEP = 4, 12    # bits by which the buckets of numbers and times get finer: once, and on the levels after that
PREFIX, PREFIXES = 4, 32    # letters that the buckets of texts add on each level, and the number of levels
CELL = "_cell"


_measured: dict[tuple, int] = {}


def total_rows(df: DataFrame) -> int:
    """Number of rows, remembered per plan. A stale number can cost a lookup, never a wrong result."""
    plan = (df.sparkSession.sparkContext.applicationId, df.semanticHash())
    if plan not in _measured:
        if len(_measured) > 1000:
            _measured.clear()
        _measured[plan] = df.count()
    return _measured[plan]


def order_code(df: DataFrame, column: str) -> Column:
    """A bigint that never falls where an order column of numbers or times rises; 0 for columns of other types."""
    value, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        limit = float(1 << 62)  # thousandths; what is beyond lies in the outer buckets, NaN last
        return F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), value.cast("double") * 1024)))
    return F.lit(0).cast("bigint")


def coarsest_shift(lean: DataFrame, keys: list[str], code: Column, rows: int) -> int | None:
    """Bits that the first buckets leave out, so that those of the densest large group hold about half of ``rows``.

    Finer ones would make the lookups grow with the rows instead of the segments. None where no group is large.
    """
    wide = F.max(code).cast("double") - F.min(code).cast("double") + 1.0
    large = lean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), wide.alias("_wide")).where(F.col("_rows") > rows)
    found = large.agg(F.count(F.lit(1)).alias("groups"), F.max(F.col("_rows") / F.col("_wide")).alias("density")).first()
    if not found.groups:
        return None
    return max(0, min(62, math.floor(math.log2(rows / 2 / found.density)))) if found.density else 0


def bucket_levels(df: DataFrame, column: str, shift: int = 36) -> list[tuple[Column, Column]]:
    """(bucket, lowest order value of the bucket) for every level of an order column, from coarse to fine.

    Both never fall where the column rises. Columns of other types than numbers, times and texts are one bucket.
    """
    if isinstance(df.schema[column].dataType, T.StringType):
        return [(F.substring(F.col(column), 1, PREFIX * (k + 1)),) * 2 for k in range(PREFIXES)]
    code, shifts = order_code(df, column), [shift, *range(shift - FIRST_STEP, 0, -STEP), 0]
    return [(F.shiftright(code, n), F.shiftleft(F.shiftright(code, n), n)) for n in dict.fromkeys(shifts)]


def segment_lookups(df: DataFrame, keys: list[str], column: str, rows: int) -> list[tuple[Column, DataFrame]]:
    """(bucket, (keys, _bucket, _segment)) per level that is needed, for the groups with more than ``rows`` rows.

    Rows with the same value of the first order column are never parted.
    """
    lean = df.select(*keys, column)
    shift = coarsest_shift(lean, keys, order_code(df, column), rows)
    if shift is None:
        return []
    levels = bucket_levels(df, column, shift)
    crowded, leaves = None, []
    for level, (bucket, start) in enumerate(levels):
        part = lean
        if crowded is not None:
            above = crowded.select(*keys, F.col("_bucket").alias("_above"))
            part = join_summary(lean.withColumn("_above", levels[level - 1][0]), above, [*keys, "_above"], "left_semi")
        counts = part.groupBy(*keys, bucket.alias("_bucket"), start.alias("_start")).agg(F.count(F.lit(1)).alias("_rows"))
        if crowded is None:
            counts = counts.withColumn("_all", F.sum("_rows").over(Window.partitionBy(*keys))).where(
                F.col("_all") > rows).drop("_all")
        counts = cut_lineage(counts.withColumn("_level", F.lit(level)), "buckets")
        last = level + 1 == len(levels)
        leaves.append(counts if last else counts.where(F.col("_rows") <= rows))
        crowded = counts.where(F.col("_rows") > rows)
        if last or crowded.isEmpty():
            break
    before = Window.partitionBy(*keys).orderBy(F.col("_start").asc_nulls_last(), "_level").rowsBetween(
        Window.unboundedPreceding, -1)
    segment = F.floor(F.coalesce(F.sum("_rows").over(before), F.lit(0)) / F.lit(rows)).cast("int")
    table = reduce(DataFrame.unionByName, leaves).withColumn("_segment", segment)
    table = cut_lineage(table.select(*keys, "_level", "_bucket", "_segment"), "segments")
    if table.isEmpty():
        return []
    return [(levels[k][0], table.where(F.col("_level") == k).drop("_level")) for k in range(len(leaves))]


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join of rows with one summary row per key; the summary's key columns are dropped.

    Which side moves is left to the optimizer: a small summary is broadcast by its measured size,
    a large one is shuffled and hot keys are split by the adaptive skew join.
    """
    renamed = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in summary.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def ordering(columns: list[str], descending: bool = False) -> list[Column]:
    """Ascending with NULLs last, or exactly the reverse of that."""
    if descending:
        return [F.col(c).desc_nulls_first() for c in columns]
    return [F.col(c).asc_nulls_last() for c in columns]


def order_key(columns: list[str]) -> Column:
    """The ordering as one comparable struct, for min_by / max_by."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


def cell(keys: list[str], segment: Column) -> Column:
    return F.struct(*keys, segment.alias("segment"))


@dataclass(frozen=True)
class Timeline:
    """Rows grouped by ``keys`` and totally ordered by ``order`` inside each group.

    Where a group has several segments, every row carries its cell, a struct of its keys and its segment. As one
    column it is NULL-safe under plain equality, so the window, the summary and the join with the
    summary all use the same hash partitioning and the rows move once. Values that are carried may
    only use columns the timeline was built with.
    """

    rows: DataFrame
    keys: list[str]
    order: list[str]
    segmented: bool = False
    base: DataFrame | None = None  # rows as laid out; summaries read these, not what was added since
    within: tuple[str, ...] = ()  # those of ``keys`` that the cells leave out

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str], max_group_rows: int = MAX_GROUP_ROWS,
           measured_on: DataFrame | None = None) -> "Timeline":
        """``measured_on`` may name a cheaper input that holds at least the same rows (keys and first order column)."""
        counted = df if measured_on is None else measured_on
        if total_rows(counted) <= max_group_rows:
            return cls(df, keys, order)
        lookups = segment_lookups(counted, keys, order[0], max_group_rows)
        if not lookups:
            return cls(df, keys, order)
        stamped = df
        for level, (bucket, table) in enumerate(lookups):
            stamped = join_summary(stamped.withColumn("_bucket", bucket), table, [*keys, "_bucket"]).withColumnRenamed(
                "_segment", f"_segment_{level}").drop("_bucket")
        found = [f"_segment_{level}" for level in range(len(lookups))]
        stamped = stamped.withColumn(CELL, cell(keys, F.coalesce(*found, F.lit(0)))).drop(*found)
        return cls(stamped, keys, order, True, stamped)

    @classmethod
    def by_file_position(cls, df: DataFrame, keys: list[str], part: str, position: str,
                         max_group_rows: int = MAX_GROUP_ROWS,
                         measured_on: DataFrame | None = None) -> "Timeline":
        """Rows in file order: ``part`` names the file, ``position`` is the row's place in it.

        The place is dense, so the segment is arithmetic: nothing is sampled and nothing written.
        """
        if total_rows(df if measured_on is None else measured_on) <= max_group_rows:
            return cls(df, keys, [part, position])
        block = F.floor(F.col(position) / F.lit(max_group_rows))
        segment = F.struct(F.col(part).alias("part"), block.alias("block"))
        stamped = df.withColumn(CELL, cell(keys, segment))
        return cls(stamped, keys, [part, position], True, stamped)

    def window(self, descending: bool = False):
        cells = [CELL, *self.within] if self.segmented else self.keys
        return Window.partitionBy(*cells).orderBy(*ordering(self.order, descending))

    def summary_window(self):
        """Groups of a per-cell summary: one row per segment, so even a huge group stays small."""
        return Window.partitionBy(*[F.col(k if k in self.within else f"{CELL}.{k}") for k in self.keys])

    def replace(self, rows: DataFrame) -> "Timeline":
        return Timeline(rows, self.keys, self.order, self.segmented, self.base, self.within)

    def by(self, keys: list[str]) -> "Timeline":
        """The same rows in groups of more keys, which share the segments of the wider group.

        The cells are not laid out anew, so the rows stay where they are and no task gets more of them.
        """
        if keys == self.keys:
            return self
        missing = [k for k in self.keys if k not in keys]
        if missing:
            raise ValueError(f"finer groups need the keys {missing} too")
        if not self.segmented:
            return Timeline(self.rows, keys, self.order)
        return Timeline(self.rows, keys, self.order, True, self.rows,
                        tuple(k for k in keys if k not in self.keys) + self.within)

    def result(self) -> DataFrame:
        return self.rows.drop(CELL) if self.segmented else self.rows

    def _with_summary(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Join rows with the summary row of their cell.

        The summary is stored: steps that follow read the rows more than once, and it takes a scan. Stored it is
        broadcast by its measured size, so that rows which lie by cell alone are not moved for a join on more keys.
        """
        stored = cut_lineage(summary, "carried")
        if not self.within:
            return rows.join(stored, CELL, "left")
        return join_summary(rows, stored, [CELL, *self.within])

    # -- carries -------------------------------------------------------------------------------

    def _with_carry(self, boxed: dict[str, Column], local: dict[str, Column],
                    descending: bool) -> DataFrame:
        """Evaluate ``local`` per cell; where it is NULL use the last box of an earlier segment."""
        if not self.segmented:
            return self.rows.withColumns(local)
        latest = F.min_by if descending else F.max_by
        key, cells = order_key(self.order), [CELL, *self.within]
        summary = self.base.groupBy(*cells).agg(*[
            latest(box, F.when(box.isNotNull(), key)).alias(f"_c_{out}") for out, box in boxed.items()
        ])
        segment = F.col(f"{CELL}.segment")
        earlier = self.summary_window().orderBy(segment.desc() if descending else segment.asc()).rowsBetween(
            Window.unboundedPreceding, -1)
        carried = summary.select(*cells, *[
            F.last(f"_c_{out}", ignorenulls=True).over(earlier).alias(f"_c_{out}") for out in boxed
        ])
        joined = self._with_summary(self.rows.withColumns(local), carried)
        return joined.withColumns({
            out: F.coalesce(F.col(out), F.col(f"_c_{out}")) for out in boxed
        }).drop(*[f"_c_{out}" for out in boxed])

    def carry(self, values: dict[str, Column], descending: bool = False) -> "Timeline":
        """Last non-NULL value at or before each row (at or after it when ``descending``)."""
        frame = self.window(descending).rowsBetween(Window.unboundedPreceding, 0)
        local = {out: F.last(v, ignorenulls=True).over(frame) for out, v in values.items()}
        return self.replace(self._with_carry(values, local, descending))

    def previous(self, values: dict[str, Column]) -> "Timeline":
        """Value of the row just before, NULL or not; NULL for the first row of a group."""
        boxes = {out: F.struct(v.alias("v")) for out, v in values.items()}
        if not self.segmented:
            return self.replace(self.rows.withColumns(
                {out: F.lag(v).over(self.window()) for out, v in values.items()}))
        local = {out: F.lag(box).over(self.window()) for out, box in boxes.items()}
        joined = self._with_carry(boxes, local, False)
        return self.replace(joined.withColumns({out: F.col(f"{out}.v") for out in boxes}))

    def around(self, value: Column, before: str, after: str, wanted: Column) -> DataFrame:
        """The ``wanted`` rows with the last non-NULL ``value`` at or before and the first at or after each.

        The rows are scanned once: wanted rows and the ends of the segments are stored, and the ends give what crosses
        a border.
        """
        up, down = self.window(), self.window(True)
        so_far = (Window.unboundedPreceding, 0)
        rows = self.rows.withColumn("_value", value).withColumns({
            before: F.last("_value", ignorenulls=True).over(up.rowsBetween(*so_far)), "_head": F.row_number().over(up) == 1})
        rows = rows.withColumns({
            after: F.last("_value", ignorenulls=True).over(down.rowsBetween(*so_far)), "_tail": F.row_number().over(down) == 1})
        if not self.segmented:
            return rows.where(wanted).drop("_value", "_head", "_tail")
        wanted_row = F.coalesce(wanted, F.lit(False))
        kept = cut_lineage(rows.withColumn("_wanted", wanted_row).where("_wanted or _head or _tail").drop("_value"), "scanned")
        cells, segment = [CELL, *self.within], F.col(f"{CELL}.segment")
        ends = kept.where("_head or _tail").groupBy(*cells).agg(
            F.first(F.when(F.col("_tail"), F.col(before)), ignorenulls=True).alias("_last"),
            F.first(F.when(F.col("_head"), F.col(after)), ignorenulls=True).alias("_first"))
        past = (Window.unboundedPreceding, -1)
        carried = ends.select(
            *cells, F.last("_last", ignorenulls=True).over(self.summary_window().orderBy(segment).rowsBetween(*past)).alias("_c_before"),
            F.last("_first", ignorenulls=True).over(self.summary_window().orderBy(segment.desc()).rowsBetween(*past)).alias("_c_after"))
        found = self._with_summary(kept.where("_wanted").drop("_wanted", "_head", "_tail"), carried)
        return found.withColumns({before: F.coalesce(before, "_c_before"), after: F.coalesce(after, "_c_after")}).drop(
            "_c_before", "_c_after", CELL)

    # -- positions -----------------------------------------------------------------------------

    def positions(self, position: str = "position", size: str = "group_rows") -> "Timeline":
        """Zero-based position of each row in its group and the size of the group."""
        local = F.row_number().over(self.window()).cast("bigint") - F.lit(1).cast("bigint")
        if not self.segmented:
            return self.replace(self.rows.withColumns({
                position: local,
                size: F.count(F.lit(1)).over(Window.partitionBy(*self.keys)),
            }))
        cells = [CELL, *self.within]
        per_segment = self.base.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
        group = self.summary_window()
        before = group.orderBy(F.col(f"{CELL}.segment")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_segment.select(
            *cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(group).alias(size))
        joined = self._with_summary(self.rows.withColumn(position, local), offsets)
        return self.replace(
            joined.withColumn(position, F.col(position) + F.col("_offset")).drop("_offset"))
