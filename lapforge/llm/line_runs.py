"""Line dedup: repeated runs of lines by distributed prefix doubling. DataFrame functions only.

Every non-blank line starts a suffix of its document's line sequence. Suffixes get names for their first 1, 2, 4,
... lines: the name for 2n lines is made of the name for n lines and the name of the suffix n lines on. Equal names
stand next to each other in a suffix array, and the suffixes that share a name for n lines are its interval with
longest common prefixes of n or more; the order between intervals carries no information here, so intervals are
found by grouping on names instead of a global sort. A suffix whose name is unique leaves the next round, so the
rounds end at the longest repeated run. Names are two 64-bit hashes.

Every interval of depth ``min_lines`` or more keeps its first place by (doc_id, line); the lines of the other
places are deleted. Overlapping places of one document join to maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.tables import cut_lineage

MIN_LINES = 2
BLANKS = r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$"


def _names(*parts):
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def line_suffixes(docs: DataFrame, row=None) -> DataFrame:
    """(row, doc_id, p, line_no, chars, name) of every non-blank line; outer blanks of a line do not count."""
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("line_no"), F.regexp_replace(x, BLANKS, "").alias("line")))
    # numbered before the lines are taken apart, so that all lines of a row share its number
    numbered = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"),
                           F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    listed = numbered.select("row", "doc_id", F.posexplode(F.filter(lines, lambda s: s["line"] != "")).alias("p", "s"))
    return listed.select("row", "doc_id", "p", F.col("s.line_no").alias("line_no"),
                         F.length("s.line").alias("chars"), _names(F.col("s.line")).alias("name"))


def _repeated(level: DataFrame) -> DataFrame:
    """Suffixes whose name another one has, with the first place of the name; counted before the join."""
    groups = level.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).where("n > 1")
    return level.join(groups.drop("n"), "name")


def _place():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "p")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, row=None) -> tuple[DataFrame, DataFrame]:
    """(suffixes, marks): all non-blank lines, and (row, p, later, depth) for suffixes that share their first
    ``depth`` lines with another one; ``later`` is true where another one comes first. ``min_lines`` must be a
    power of two, as any run of at least that length is a union of such stretches."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    suffixes = cut_lineage(line_suffixes(docs, row), "lines")
    level = cut_lineage(_repeated(suffixes.select("row", "doc_id", "p", "name")), "names")
    marks, depth = None, 1
    while True:
        if depth >= min_lines:
            found = level.select("row", "p", (_place() > F.col("first")).alias("later"), F.lit(depth).alias("depth"))
            marks = found if marks is None else marks.union(found)
        # the suffix ``depth`` lines on, if its own prefix is repeated too
        on = level.select("row", (F.col("p") - depth).alias("p"), F.col("name").alias("next"))
        doubled = level.select("row", "doc_id", "p", "name").join(on, ["row", "p"]).select(
            "row", "doc_id", "p", _names("name.a", "name.b", "next.a", "next.b").alias("name"))
        level = cut_lineage(_repeated(doubled), "names")
        depth *= 2
        if not level.limit(1).count():
            break
    if marks is None:
        marks = level.select("row", "p", F.lit(False).alias("later"), F.lit(0).alias("depth")).where("false")
    return suffixes, marks


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, row=None) -> tuple[DataFrame, DataFrame]:
    """(suffixes, deleted): all non-blank lines, and (row, p) of those that belong to a later copy."""
    suffixes, marks = repeated_runs(docs, min_lines, row)
    # windows of min_lines cover the longer ones
    later = marks.where(F.col("later") & (F.col("depth") == min_lines))
    gone = later.select("row", F.explode(F.sequence(F.col("p"), F.col("p") + min_lines - 1)).alias("p")).distinct()
    return suffixes, gone


def line_run_report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per doc_id: n_lines (non-blank), n_removed, n_runs (maximal deleted runs), chars_removed.

    Null and empty texts have no lines. Rows with one doc_id are reported together and each counts as a document
    of its own. Other columns are ignored; an empty table gives an empty one.
    """
    suffixes, gone = deleted_lines(docs, min_lines)
    marked = suffixes.join(gone.withColumn("gone", F.lit(1)), ["row", "p"], "left")
    before = F.lag("gone").over(Window.partitionBy("row").orderBy("p"))
    opened = F.when(F.col("gone").isNotNull() & before.isNull(), 1).otherwise(0)
    counted = marked.withColumn("opens", opened).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("gone"), F.lit(0)).alias("n_removed"),
        F.sum("opens").alias("n_runs"),
        F.sum(F.when(F.col("gone").isNotNull(), F.col("chars")).otherwise(0)).alias("chars_removed"))
    none = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().select(
        "doc_id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_lines", "n_removed", "n_runs", "chars_removed")])
    every = counted.select(none.columns).union(none)
    return every.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in none.columns[1:]])


def remove_line_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text) of every row of ``docs`` with a non-blank line, without the deleted lines; the lines left
    are joined in order, and blank lines stay out."""
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    suffixes, gone = deleted_lines(numbered, min_lines, F.col("row"))
    lost = suffixes.join(gone, ["row", "p"]).groupBy("row").agg(F.collect_set("line_no").alias("lost"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: ~F.array_contains(
        F.coalesce(F.col("lost"), F.array().cast("array<int>")), i) & x.rlike(r"[^ \t\x0B\f\r]"))
    return numbered.join(lost, "row", "left").select("doc_id", F.array_join(lines, "\n").alias("text"))


ORACLE = r"""
with d as (select row_number() over (order by doc_id) as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, i, regexp_replace(ls[i], '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') as line
      from (select r, doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
s as (select r, doc_id, row_number() over (partition by r order by i) as p, line from l where line <> ''),
w as (select r, p, line, lead(line) over (partition by r order by p) as after from s),
ranked as (select r, p, row_number() over (partition by line, after order by r, p) as k from w where after is not null),
gone as (select distinct r, p + unnest([0, 1]) as p from ranked where k > 1),
m as (select s.*, gone.p is not null as gone from s left join gone on s.r = gone.r and s.p = gone.p),
o as (select *, gone and not coalesce(lag(gone) over (partition by r order by p), false) as opens from m)
select d.doc_id, count(o.p)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
       count(*) filter (opens)::bigint as n_runs, coalesce(sum(length(line)) filter (gone), 0)::bigint as chars_removed
from d left join o on d.r = o.r group by d.doc_id
"""


#: The same for runs of one line on: every later copy of a line.
SINGLE_ORACLE = r"""
with d as (select row_number() over (order by doc_id) as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, i, regexp_replace(ls[i], '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') as line
      from (select r, doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
s as (select r, doc_id, row_number() over (partition by r order by i) as p, line from l where line <> ''),
m as (select s.*, row_number() over (partition by line order by r, p) > 1 as gone from s),
o as (select *, gone and not coalesce(lag(gone) over (partition by r order by p), false) as opens from m)
select d.doc_id, count(o.p)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
       count(*) filter (opens)::bigint as n_runs, coalesce(sum(length(line)) filter (gone), 0)::bigint as chars_removed
from d left join o on d.r = o.r group by d.doc_id
"""
