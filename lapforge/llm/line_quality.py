"""Quality rules, line first: failing lines go, then documents that lose too much text. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.tables import set_aside

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50            # below it a document fails
REPEAT_PERCENT = 50       # above it a document fails
KEEP_PERCENT = 50         # characters that must be left after the line rules
NAVIGATION = r"[|»›•·→]"  # separators of menus
NAVIGATION_MARKS = 2      # so many make a menu line
SYMBOL_PERCENT = 10       # share of symbol characters above which a line is junk
ENDINGS = r"""[.!?:;…"'”’»)\]][ \t\x0B\f\r]*$"""
SHORT_LINE = 10           # a line without final punctuation passes from so many words on
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|cookie settings|privacy policy|terms of (use|service)|licensed under"
    r"|copyright (©|\(c\)|[0-9])|subscribe (now|to our)|sign up for|click here|read more\b|enable javascript"
    r"|lorem ipsum|powered by|skip to content)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, each word once."""
    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def positions(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s):
            def at(j):
                own = F.get(s, j)
                return F.when(F.coalesce(F.get(s, j - 1)["h"] == own["h"], F.lit(False)) |
                              F.coalesce(F.get(s, j + 1)["h"] == own["h"], F.lit(False)), own["i"])
            return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), at), lambda p: p.isNotNull())
        return F.sort_array(let(ordered, twice))

    def covered(p):
        end = F.aggregate(p, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda acc, x: F.struct(
            (x + 3).alias("end"), (acc["sum"] + x + 3 - F.greatest(x, acc["end"])).alias("sum")))
        return end["sum"]

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(positions(h)))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count)))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))


def line_passes(line: Column) -> Column:
    """The rules of one line: final punctuation (or many words), no menu, no boilerplate, few symbols."""
    ends = line.rlike(ENDINGS) | (F.size(F.split(F.trim(line), SPACE)) >= SHORT_LINE)
    menu = F.regexp_count(line, F.lit(NAVIGATION)) >= NAVIGATION_MARKS
    junk = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > F.length(line) * SYMBOL_PERCENT
    return ends & ~menu & ~junk & ~line.rlike(BOILERPLATE)


HELPERS = ["_words", "_lines", "_passed", "_all_chars"]


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``clean_text`` (lines that pass, blank lines out) and the columns of the report.

    A null text counts as empty: no words, base_failed, not kept. Existing columns of the same names are replaced;
    all others, also null ids and repeated rows, are passed on.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs, names = set_aside(docs, HELPERS)
    staged = docs.withColumns({"_words": words_of(text), "_lines": lines_of(text)})
    staged = staged.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("bigint"),
        "_passed": F.filter("_lines", line_passes),
        "_all_chars": F.length(F.array_join("_lines", "")),
        "n_lines": F.size("_lines").cast("bigint"),
    })
    staged = staged.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "n_lines_kept": F.size("_passed").cast("bigint"),
        "chars_kept": F.length(F.array_join("_passed", "")).cast("bigint"),
        "clean_text": F.array_join("_passed", "\n"),
    })
    kept = ~F.col("base_failed") & (F.col("chars_kept") * 100 >= F.col("_all_chars") * KEEP_PERCENT)
    return staged.withColumn("kept", kept).drop(*HELPERS).withColumnsRenamed(names)


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
          "n_lines", "n_lines_kept", "chars_kept"]


def line_quality_report(docs: DataFrame) -> DataFrame:
    """One row of ``REPORT`` per row of ``docs`` (doc_id, text)."""
    return clean_lines(docs.select("doc_id", "text")).select(*REPORT)


_W = r"[ \t\n\x0B\f\r]"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(string_split_regex(text, '{_W}+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines from d),
win as (select r, unnest(range(0, greatest(len(words) - 2, 0))) as i, words from w),
keyed as (select r, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as k from win),
twice as (select r, i from (select r, i, count(*) over (partition by r, k) as n from keyed) where n > 1),
cover as (select r, count(distinct p) as n from (select r, i + unnest([0, 1, 2]) as p from twice) group by r),
passed as (select *, list_filter(lines, lambda x:
      (regexp_matches(x, '[.!?:;…"''”’»)\]][ \t\x0B\f\r]*$')
        or len(string_split_regex(trim(x, ' '), '{_W}+')) >= {SHORT_LINE})
      and len(regexp_extract_all(x, '{NAVIGATION}')) < {NAVIGATION_MARKS}
      and len(regexp_extract_all(x, '{SYMBOLS}')) * 100 <= length(x) * {SYMBOL_PERCENT}
      and not regexp_matches(x, '{BOILERPLATE}')) as good from w),
n as (select doc_id, len(words)::bigint as n_words, length(list_aggregate(list_concat(words, ['']), 'string_agg', ''))::bigint as word_chars,
        len(regexp_extract_all(text, '{SYMBOLS}'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words,
        len(lines)::bigint as n_lines, len(good)::bigint as n_lines_kept,
        length(list_aggregate(list_concat(good, ['']), 'string_agg', ''))::bigint as chars_kept,
        length(list_aggregate(list_concat(lines, ['']), 'string_agg', '')) as all_chars
      from passed left join cover using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
         and chars_kept * 100 >= all_chars * {KEEP_PERCENT} as kept,
       n_lines, n_lines_kept, chars_kept
from n
"""
