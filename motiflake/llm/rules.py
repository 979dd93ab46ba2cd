"""Quality rules: a table of thresholds compiled into one projection; no user functions.

A rule bounds one ratio. Every ratio is a column expression over the text, a word array that is built once, and counts
derived from it; `compile_rules` turns the table into the verdict and the list of failed rules in the same projection.

Defined results: null text is empty; an empty text has no words, zero counts, and fails the word count; a ratio of nothing
is 0; a value on a threshold doesn't fail; repeated rows are judged alike; an empty table gives none; other columns stay,
but one with the name of a measure or verdict gives way to it. Very long texts are read whole: a row's arrays hold its
words and lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried, quoted, unpacked

VERDICT = ("base_failed", "failed_rules", "kept")
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for with on as by at this it be are was or an a from not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par plus pas sur au avec "
    "el que y los del se las por con una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.03),
    Rule("capitals", "upper_ratio", None, 0.35),
    Rule("exclamations", "bang_ratio", None, 0.15),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("repeated_words", "repeat_ratio", None, 0.3),
    Rule("digits", "digit_ratio", None, 0.3),
    Rule("separators", "separator_ratio", None, 0.25),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.4),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("stop_words", "stop_ratio", 0.01, None),
)


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words of the array that lie in a window of n words found twice or more in it.

    Hashes of all windows are compared first: without a repeated hash there is no repeated window. Otherwise the windows
    are sorted by 128-bit names with their places, and the places of equal neighbours are merged into covered words.
    """
    places = F.sequence(F.lit(0), F.size(w) - n)
    window = lambda i: [F.get(w, i + k) for k in range(n)]
    hashes = F.transform(places, lambda i: F.xxhash64(*window(i)))
    grams = F.transform(places, lambda i: F.struct(F.xxhash64(*window(i)).alias("g"), F.xxhash64(F.lit(1), *window(i)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce((F.get(s, j)["g"] == e["g"]) & (F.get(s, j)["h"] == e["h"]), F.lit(False))
        again = F.filter(s, lambda e, j: same(e, j + 1) | F.when(j > 0, same(e, j - 1)).otherwise(F.lit(False)))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(again, lambda e: e["i"])), start,
            lambda a, p: F.struct((p + n).alias("end"), (a["n"] + (p + n - F.greatest(p, a["end"])).cast("long")).alias("n")), lambda a: a["n"],
        )

    return F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(
        F.when(bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(bind(F.sort_array(grams), covered))
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios that rules may name."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    of_words = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop"),
        ),
    )
    of_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            F.size(F.filter(x, lambda y: F.endswith(y, F.lit("...")) | F.endswith(y, F.lit("…")))).cast("long").alias("ellipsis"),
            F.size(F.filter(x, lambda y: F.ltrim(y).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("bullet"),
        ),
    )
    m = docs.select(carried(docs).alias("row"), of_words.alias("w"), of_lines.alias("l"), text.alias("t"))
    t, w, ln = F.col("t"), F.col("w"), F.col("l")
    chars = F.length(F.translate(t, SPACE, "")).cast("long")
    upper = _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÓÍÚÁ")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    bangs = ((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2).cast("long")
    measures = {
        "n_words": w["n_words"], "word_chars": chars, "n_symbols": _count(t, SYMBOLS), "n_dup_lines": ln["dup"], "n_repeat_words": w["n_repeat_words"],
        "mean_word_chars": ratio(chars, w["n_words"]), "symbol_ratio": ratio(_count(t, SYMBOLS), chars), "upper_ratio": ratio(upper, chars),
        "bang_ratio": ratio(bangs, w["n_words"]), "dup_line_ratio": ratio(ln["dup"], ln["n"]), "repeat_ratio": ratio(w["n_repeat_words"], w["n_words"]),
        "digit_ratio": ratio(_count(t, "0123456789"), chars), "separator_ratio": ratio(_count(t, "|=_~^"), chars),
        "ellipsis_line_ratio": ratio(ln["ellipsis"], ln["n"]), "bullet_line_ratio": ratio(ln["bullet"], ln["n"]), "stop_ratio": ratio(w["stop"], w["n_words"]),
    }
    taken = {c.lower() for c in [*measures, *VERDICT]}
    kept = [c for c, name in zip(unpacked(docs.columns), docs.columns, strict=True) if name.lower() not in taken]
    return m.select(*kept, *[c.alias(k) for k, c in measures.items()])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string> of the rules that a measured row fails."""

    def failed(r: Rule) -> Column:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.metric) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.metric) > r.most)
        return F.when(bad, F.lit(r.name))

    return F.filter(F.array(*[failed(r) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their measures, base_failed, failed_rules and kept."""
    m = measure(docs, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns({"base_failed": base, "failed_rules": compile_rules(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
