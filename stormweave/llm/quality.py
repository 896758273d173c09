"""Operator 2, quality rules: a table of thresholds compiled into one projection of built-in functions.

Ratios of length, symbols, stop words and lines are measured row by row inside the JVM: there is no exchange, no
user function and no limit on the length of a text. Repeated 3-word windows are found by sorting the row's own
windows by a 64-bit hash, so a text of n words costs n log n; two different windows of one text are taken for equal
with a chance below n^2 / 2^65.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged one by one;
an empty table gives an empty result; columns other than `doc_id` and `text` are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.llm.words import texts, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and a in that have it is was for on with as at by this from are he or an not "
    "der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch "
    "le la les de des du et un une en que qui dans pour par sur au est pas avec "
    "el los las del y que en un una por con no para se su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= metric <= high; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The rules a text has to pass besides the base rule.
RULES = (
    Rule("short_words", "mean_word_chars", low=1.5),
    Rule("long_words", "mean_word_chars", high=20.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.3),
)

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words_: Column) -> Column:
    """Words standing in a 3-word window that occurs twice or more in the same text."""

    def of_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, _twin(s)), _covered)))))
        )

    def windows(single: Column) -> Column:
        return F.slice(
            F.transform(single, lambda h, i: F.xxhash64(h, F.get(single, i + 1), F.get(single, i + 2))),
            F.lit(1),
            F.greatest(F.size(single) - 2, F.lit(0)),
        )

    return _let(F.transform(words_, lambda w: F.xxhash64(w)), lambda single: _let(windows(single), of_windows))


def _twin(ordered: Column) -> Callable[[Column, Column], Column]:
    def has_twin(x: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    return has_twin


def _covered(x: Column) -> Column:
    return F.array(x["i"], x["i"] + 1, x["i"] + 2)


#: The counts of a text.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines",
    "n_ellipsis_lines",
)


def measured(text: Column) -> Column:
    """The counts of a text as one struct; words and lines are split once and read by all of them."""
    plain = F.coalesce(text, F.lit(""))
    lines_ = F.filter(F.split(plain, "\n"), lambda line: line.rlike(_HAS_WORD))
    stop = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]

    def counts(p: Column) -> Column:
        values = (
            F.size(p["words"]),
            F.length(F.array_join(p["words"], "")),
            F.length(p["text"]) - F.length(F.translate(p["text"], "#*$%&|<>", "")),
            F.size(p["lines"]) - F.size(F.array_distinct(p["lines"])),
            repeated_words(p["words"]),
            F.size(p["lines"]),
            F.size(F.filter(p["words"], lambda w: w.isin(stop))),
            F.size(F.filter(p["lines"], lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))),
            F.size(F.filter(p["lines"], lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        )
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(COUNTS, values, strict=True)])

    return _let(F.struct(plain.alias("text"), words(text).alias("words"), lines_.alias("lines")), counts)


#: Metric: the two counts it is the ratio of.
PARTS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def compile_rules(rules: Sequence[Rule], counts: Column) -> Column:
    """Names of the rules that the counts break, in the order of the table."""

    def broken(rule: Rule) -> Column:
        part, whole = (counts[c] for c in PARTS[rule.metric])
        value = F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        return F.when(bad, F.lit(rule.name))

    return F.array_compact(F.array(*[broken(r) for r in rules])) if rules else F.array().cast("array<string>")


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Counts, `base_failed`, broken rules and `kept` of a text as one struct.

    One expression, so that a filter on it evaluates nothing twice when it is pushed below a projection.
    """

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        broken = compile_rules(rules, m)
        return F.struct(
            *[m[c].alias(c) for c in COUNTS],
            failed.alias("base_failed"),
            broken.alias("broken"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        )

    return _let(measured(text), judged)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, counts, `base_failed`, the broken rules and `kept`, a row for each row of `docs`."""
    return texts(docs).select("doc_id", verdict(F.col("text"), rules).alias("verdict")).select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs`, all columns, that pass: a filter, no exchange."""
    return docs.filter(verdict(F.col("text").cast("string"), rules)["kept"])
