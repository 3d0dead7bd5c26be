"""Line-first document cleaning with DataFrame functions only.

Every line is judged by itself: punctuation (its text ends like prose),
navigation (bars or link lists), shouting and symbol noise, stutter, and
boilerplate phrases. Failing lines are removed; a document that then has lost
too much of its text is rejected, as is one failing the base counts.

Defined results: a null or empty text has no words, so it is rejected
(``base_failed``) with zero counts; blank lines are neither judged nor counted;
rows are judged one by one, so repeated rows get equal verdicts; other columns
(also ones named like the results) ride along under their own names when
``clean_documents`` is used. The whole plan is one projection: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.llm.frames import fresh

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
BASE_SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture, looked for in the lower-cased line.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot password",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign up", "skip to content", "subscribe to our",
    "terms of service", "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; percentages compare integers, so every engine agrees."""

    min_words: int = 50
    max_repeat_percent: int = 50
    bar_percent: int = 20
    symbol_percent: int = 10
    exclaim_percent: int = 30
    stutter_words: int = 10
    distinct_percent: int = 35
    boilerplate_words: int = 12
    min_kept_percent: int = 50


def _count(text: Column, kind: str) -> Column:
    """Code points of ``text`` in the character class ``[kind]``."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", F.lit("")))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def line_passes(line: Column, words: Column, rules: LineRules) -> Column:
    """Whether a line with words is prose. ``words``: the line's words."""
    n, size = F.size(words), F.length(line)
    ends = F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).rlike(r"[.!?:;,\"'\)\]…。」！？»”’]")

    def by_symbols(found: Column) -> Column:
        bars, marks = _count(found, "|"), _count(found, "!")
        navigation = (bars >= 2) & (bars * 100 >= n * rules.bar_percent)
        noise = (F.length(found) - marks) * 100 > size * rules.symbol_percent
        shouting = (marks >= 3) & (marks * 100 >= n * rules.exclaim_percent)
        return (found != "") & (navigation | noise | shouting)

    odd = _let(F.regexp_replace(line, r"[^!#*$%&|<>{}~\^\\]+", F.lit("")), by_symbols)
    stutter = (n >= rules.stutter_words) & (F.size(F.array_distinct(words)) * 100 < n * rules.distinct_percent)
    furniture = (n <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
    return ends & ~odd & ~furniture & ~stutter


#: Distinct repeated windows up to which they are looked up one by one.
FEW = 32


def repeat_words(words: Column, windows: Column, twins: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    ``windows``: the text's windows in order; ``twins``: the repeated ones. With
    few of those the windows are looked up in them; else windows sorted with
    their positions bring equal ones together, in n log n steps for any text.
    """
    spread = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    looked_up = spread(F.filter(F.transform(windows, lambda x, i: F.when(F.array_contains(twins, x), i)), lambda i: i.isNotNull()))
    n = F.greatest(F.size(words), F.lit(1))
    placed = F.sort_array(F.arrays_zip(windows.alias("g"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))
    pair = lambda s: F.filter(F.arrays_zip(s.alias("a"), F.slice(s, 2, n).alias("b")), lambda z: z["a"]["g"] == z["b"]["g"])
    sorted_out = _let(placed, lambda s: _let(pair(s), lambda z: spread(F.concat(F.transform(z, lambda x: x["a"]["p"]), F.transform(z, lambda x: x["b"]["p"])))))
    return F.when(F.size(twins) == 0, 0).when(F.size(twins) <= FEW, looked_up).otherwise(sorted_out)


def assess(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), out: str = "quality") -> DataFrame:
    """docs with a struct column ``out``: counts, verdict and the cleaned text.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    line_chars, kept_chars, n_lines_removed (long), clean_text, base_failed, kept (boolean).
    ``out`` gets underscores in front if docs has that column.
    """
    full, words, solid, lines, windows, twins = fresh(docs, "q_full", "q_words", "q_solid", "q_lines", "q_windows", "q_twins")
    (out,) = fresh(docs, out)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    a = docs.withColumn(full, body).withColumns({words: words_of(F.col(full)), lines: F.split(F.col(full), "\n")})
    # Each line once: its text, whether it has words, its length and verdict.
    judged = lambda line: _let(
        words_of(line), lambda w: F.struct(line.alias("line"), (F.size(w) > 0).alias("full"), F.length(line).alias("chars"), line_passes(line, w, rules).alias("good"))
    )
    a = a.withColumns({lines: F.transform(lines, judged), solid: F.array_join(words, " ")})
    # A window begins at every word that two more follow: taken in order by one pattern.
    a = a.withColumn(windows, F.regexp_extract_all(solid, F.lit("(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), 1))
    a = a.withColumn(twins, F.sort_array(windows))
    a = a.withColumn(twins, F.array_distinct(F.filter(twins, lambda x, i: x == F.get(F.col(twins), i + 1))))
    n = F.size(words)
    with_words = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
    total = lambda test: F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.when(test(x), x["chars"]).otherwise(0))
    counts = {
        "n_words": n,
        "word_chars": F.length(solid) - F.greatest(n - 1, F.lit(0)),
        "n_symbols": _count(F.col(full), BASE_SYMBOLS[1:-1]),
        "n_dup_lines": _let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(F.col(words), F.col(windows), F.col(twins)),
        "line_chars": total(lambda x: x["full"]),
        "kept_chars": total(lambda x: x["full"] & x["good"]),
        "n_lines_removed": F.size(F.filter(lines, lambda x: x["full"] & ~x["good"])),
    }
    clean = F.array_join(F.transform(F.filter(lines, lambda x: ~x["full"] | x["good"]), lambda x: x["line"]), "\n")
    a = a.withColumn(out, F.struct(*(c.cast("long").alias(k) for k, c in counts.items()), clean.alias("clean_text"))).drop(full, words, solid, lines, windows, twins)
    q = F.col(out)
    failed = (q["n_words"] < rules.min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * rules.max_repeat_percent)
    kept = ~failed & (q["kept_chars"] * 100 >= q["line_chars"] * rules.min_kept_percent)
    return a.withColumn(out, q.withField("base_failed", failed).withField("kept", kept))


def clean_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), length: str | None = "n_chars") -> DataFrame:
    """Documents that pass, their failing lines removed; columns stay as they are.

    ``length``, where docs has that column, gets the cleaned text's code points.
    """
    out, once = fresh(docs, "quality", "q_once")
    a = assess(docs, text, rules, out)
    # A filter would be pushed below the projections and work the whole verdict out in
    # its own condition, column by column; a generator of one row or none stays above.
    a = a.withColumn(once, F.explode(F.when(F.col(out)["kept"], F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))).drop(once)
    a = a.withColumn(text, F.col(out)["clean_text"])
    if length in docs.columns:
        a = a.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return a.select(*docs.columns)
