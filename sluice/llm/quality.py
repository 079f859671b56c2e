"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.shared import BLANKS, text_or_empty, without_blanks

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to in is that it for on with as was be by this from or are at an a "
    "le la les de des du et un une est que qui en dans pour par sur pas au ce il "
    "der die das und ist nicht von mit ein eine im den dem zu sich auf als auch "
    "el los las y es en un una por con para del se no su al lo"
).split()


class Rule(NamedTuple):
    """Keep a document only while ``low <= measure <= high``; measures are SQL over the counts."""

    name: str
    measure: str
    low: float
    high: float


# Ratios are per word or per non-blank line; a document without words fails the base rule already.
RULES = (
    Rule("word_length", "word_chars / n_words", 2, 20),
    Rule("symbols", "n_symbols / n_words", 0, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.01, 1),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / greatest(n_lines, 1)", 0, 0.5),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", 0, 0.9),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def window_keys(words: Column, width: int = WINDOW) -> Column:
    """A 64-bit key of each window of ``width`` words."""
    last = F.size(words) - width + 1
    return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width)))))


def covered_words(keys: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows whose key occurs twice or more."""

    def total(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        def step(acc, i):
            return F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"), (i + width).alias("end"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    found = let(pairs, lambda ps: F.transform(F.filter(
        ps, lambda p, j: F.coalesce(p["k"] == F.get(ps, j - 1)["k"], F.lit(False))
        | F.coalesce(p["k"] == F.get(ps, j + 1)["k"], F.lit(False))), lambda p: p["i"]))
    counted = total(F.sort_array(found))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(counted)


def with_counts(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and the counts that the rules are about, in one pass over the text."""
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(has_word))
    base = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("_text"))
    parts = base.select("doc_id", "_text", words_of(F.col("_text")).alias("_words"), lines.alias("_lines"))
    keyed = parts.select("*", window_keys(F.col("_words")).alias("_keys"))
    trimmed = F.transform(F.col("_lines"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return keyed.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(without_blanks(F.col("_text"))).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("_keys")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(trimmed, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(trimmed, lambda x: x.rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
    )


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text", id_column: str = "doc_id",
           min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, the base verdict, the names of failed rules, and whether a document is kept.

    A null text counts as empty and fails the base rule; every row is judged on its own, repeated or not.
    """
    counts = with_counts(docs, text_column, id_column)
    failed = [F.when(~F.expr(f"({r.measure}) BETWEEN {r.low} AND {r.high}"), F.lit(r.name)) for r in rules]
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = counts.select("doc_id", *COUNTS, base.alias("base_failed"),
                        F.when(F.col("n_words") > 0, F.array_join(F.array_compact(F.array(*failed)), ",")).otherwise("").alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
