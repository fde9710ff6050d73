"""Line-first cleaning (native columns only).

Every line is judged by itself: punctuation, navigation and boilerplate rules.
Failing lines are removed, then a document that lost too much of its text is
rejected.  The fixed base counts of a document (characters in words, symbols,
repeated lines, words inside repeated 8-word windows) are computed beside it.

Defined results: a null or empty text has no words and no lines, fails the base
rule and keeps an empty text; repeated rows and null ids are judged row by row;
an empty table gives an empty table; other columns of the input pass through,
and an input column with the name of a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import read_table, text_or_empty

WINDOW = 8
#: White space between words, and the symbols that are counted.
WORD_SPLIT = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
SYMBOL = f"[{SYMBOLS}]"
#: The ends of words that count as shouted, and words that separate links.
MARKS = ("!!", "!?", "?!", "??")
SEPARATORS = ("|", ">", "»", "•", "·")
#: Phrases of boilerplate lines (lower case).
BOILERPLATE = (
    "licensed under the", "this work is licensed", "all rights reserved", "permission is hereby granted",
    "spdx-license-identifier", "copyright (c)", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript", "subscribe to our newsletter",
    "sign up for our", "click here to", "share this on", "back to top", "skip to content", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20              # base: fewer words fail
    max_repeat_pct: int = 30         # base: more words inside repeated windows fail
    max_symbol_share: float = 0.10   # punctuation: symbols among the line's characters
    max_bang_share: float = 0.50     # punctuation: words that end in two or more marks
    max_echo_share: float = 0.50     # boilerplate: words equal to the word before
    nav_separators: int = 3          # navigation: this many separators ...
    max_separator_share: float = 0.2  # ... and this share of the line's words
    max_lost_share: float = 0.60     # document: characters lost with removed lines


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def _judged(line: Column) -> Column:
    """What a line's rules look at more than once: made once a line, because a lambda shares no part of its expression."""
    signs = F.when(line.rlike(SYMBOL), F.length(line) - F.length(F.translate(line, SYMBOLS, ""))).otherwise(0)
    return F.struct(line.alias("line"), F.length(line).alias("n"), signs.alias("signs"), F.lower(line).alias("low"),
                    F.array_remove(F.split(line, WORD_SPLIT), "").alias("words"))


def _line_fails(x: Column, rules: LineRules) -> Column:
    line, words = x["line"], x["words"]
    zero = F.lit(0)
    start = F.struct(zero.alias("n"), zero.alias("bangs"), zero.alias("bars"), zero.alias("same"), F.lit("").alias("last"))
    count = lambda a, w: F.struct(
        (a["n"] + 1).alias("n"), (a["bangs"] + w.rlike("[!?][!?]$").cast("int")).alias("bangs"),
        (a["bars"] + w.isin(*SEPARATORS).cast("int")).alias("bars"), (a["same"] + (w == a["last"]).cast("int")).alias("same"),
        w.alias("last"))
    worded = lambda a: (
        (a["bangs"] > a["n"] * rules.max_bang_share) | (a["same"] > a["n"] * rules.max_echo_share)
        | ((a["bars"] >= rules.nav_separators) & (a["bars"] > a["n"] * rules.max_separator_share)))
    # words are counted where a rule can fail at all: each echo leaves one distinct word less
    can_fail = (_any_of(line, MARKS) | _any_of(line, SEPARATORS)
                | (F.size(F.array_distinct(words)) < F.size(words) * (1 - rules.max_echo_share) + 0.5))
    return ((x["signs"] > x["n"] * rules.max_symbol_share) | _any_of(x["low"], BOILERPLATE)
            | F.when(can_fail, F.aggregate(words, start, count, worded)).otherwise(False))


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed,
    chars_removed, clean_text and kept to ``docs`` (needs ``text``); one row in, one row out, no shuffle."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "n_lines_removed", "chars_removed", "clean_text", "kept"]
    carried = [c for c in docs.columns if c not in added]
    d = docs.select(*[F.col(c) for c in carried], text_or_empty().alias("__t"))
    d = d.select(*carried, "__t",
                 F.array_remove(F.split("__t", WORD_SPLIT), "").alias("__w"),
                 F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("__lines"))
    # no lambda below refers to a column: a filter that the optimiser moves in here then costs one more pass, not a square
    d = d.select("*", F.transform("__w", lambda w: F.xxhash64(w)).alias("__wh"))
    n = F.greatest(F.size("__wh") - (WINDOW - 1), F.lit(0))
    windows = F.transform(F.arrays_zip(*[F.slice("__wh", k + 1, n) for k in range(WINDOW)]), lambda x: F.xxhash64(x))
    d = d.select("*", windows.alias("__h"))
    # only a text with a repeated window pays for the ordering below
    pairs = F.when(F.size(F.array_distinct("__h")) < F.size("__h"),
                   F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select("*", pairs.alias("__s"))
    edge = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i")))
    before = F.concat(edge, F.slice("__s", 1, F.size("__s") - 1))
    after = F.concat(F.slice("__s", 2, F.size("__s") - 1), edge)
    beside = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    twice = F.zip_with("__s", beside, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
    found = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    covered = F.aggregate(
        found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"])
    d = d.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                 F.transform("__lines", _judged).alias("__judged"))
    d = d.select("*", F.filter("__judged", lambda x: ~_line_fails(x, rules)).alias("__left"))
    summed = lambda lines, part: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x[part])
    total, left = summed("__judged", "n"), summed("__left", "n")
    d = d.select(
        *carried,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        summed("__judged", "signs").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("__lines") - F.size("__left")).cast("long").alias("n_lines_removed"),
        (total - left).alias("chars_removed"), total.alias("__total"),
        F.array_join(F.col("__left.line"), "\n").alias("clean_text"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    return d.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "n_lines_removed", "chars_removed", "clean_text",
        (~failed & (F.col("chars_removed") <= rules.max_lost_share * F.col("__total"))).alias("kept"))


def op9_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "n_lines_removed", "chars_removed")
