"""Where quotes stand in documents, whatever their typography, in the offsets of the original text.

Texts and quotes are compared in a folded form: compatibility characters, case,
curly quotation marks, dashes and runs of white space are made alike, invisible
characters go. Folding works by distinct characters: a text is an array of code
points, each distinct one is folded once, and the results are gathered with the
span that every folded character came from; only letters with combining marks
are folded one by one.

Documents and quotes meet by equality. A quote may not begin or end inside a
word or number, so each of its words is a whole word of the text around it: its
first words, up to four, are a key that the documents' runs of words are joined
on, and only such pairs are searched. With ``inside`` it may begin and end inside
a word; the key then leaves out words that touch the quote's ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rulemark.operators.documents import WORD

# Characters that count as one of ASCII, and characters that no reader sees.
SINGLE_QUOTES = "‘’‚‛ʼ"
DOUBLE_QUOTES = "“”„‟"
DASHES = "‐‑‒–—―−﹘﹣－"
INVISIBLE = "​‌‍⁠﻿­"

_ALIKE = {ord(c): to for group, to in ((SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-"), (INVISIBLE, "")) for c in group}
_KNOWN: dict[str, str] = {}


def folded_letter(letter: str) -> str:
    """A character with its combining marks, folded."""
    if letter not in _KNOWN:
        if len(_KNOWN) > 1 << 16:
            _KNOWN.clear()
        alike = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", letter).casefold())
        _KNOWN[letter] = alike.translate(_ALIKE)
    return _KNOWN[letter]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _flags(codes: np.ndarray, of) -> np.ndarray:
    """of(character) for every code, worked out once for each distinct one."""
    distinct, which = np.unique(codes, return_inverse=True)
    return np.array([bool(of(chr(c))) for c in distinct], bool)[which] if len(codes) else np.zeros(0, bool)


def folded(text: str | None) -> tuple[str, np.ndarray, np.ndarray]:
    """(folded text, start and end in the original of each of its characters)."""
    codes = _codes(text or "")
    head = ~_flags(codes, unicodedata.combining)
    head[:1] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(codes)) if len(starts) else starts
    # Numbers of letters: plain characters by their distinct codes, marked ones after them.
    distinct, which = np.unique(codes[starts], return_inverse=True)
    letters = [chr(c) for c in distinct]
    for i in np.flatnonzero(ends - starts > 1):
        which[i] = len(letters)
        letters.append(text[starts[i] : ends[i]])
    made = [folded_letter(x) for x in letters]
    sizes = np.array([len(m) for m in made], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = _codes("".join(made))
    n = sizes[which] if len(which) else np.zeros(0, np.int64)
    at = np.repeat(begin[:-1][which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out, low, high = flat[at].copy(), np.repeat(starts, n), np.repeat(ends, n)
    # Runs of white space become one blank, whose span is the run's; none is left at the ends.
    blank = _flags(out, str.isspace)
    first = blank & ~np.concatenate([[False], blank[:-1]]) if len(out) else blank
    last = blank & ~np.concatenate([blank[1:], [False]]) if len(out) else blank
    high[first] = high[last]
    out[first] = 32
    keep = ~blank | first
    keep[np.flatnonzero(first & (np.arange(len(out)) == 0))] = False
    if last.any() and last[-1]:
        keep[np.flatnonzero(first)[-1]] = False
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), low[keep], high[keep]


def whole(quote: str) -> re.Pattern:
    """A pattern for a folded quote that neither begins nor ends inside a word or number."""
    before, after = "", ""
    if quote[0].isalnum():
        before = r"(?<![^\W_])" + (r"(?<!\d[.,])" if quote[0].isdigit() else "")
    elif quote[0] in ".," and quote[1:2].isdigit():
        before = r"(?<!\d)"
    if quote[-1].isalnum():
        after = r"(?![^\W_])" + (r"(?![.,]\d)" if quote[-1].isdigit() else "")
    return re.compile(before + re.escape(quote) + after)


def spans(text: tuple[str, np.ndarray, np.ndarray], quote: str, inside: bool = False) -> Iterator[tuple[int, int]]:
    """Original (start, end) of each place where a folded quote stands in a folded text; places do not overlap nor cut a character."""
    body, starts, ends = text
    pattern, at = re.compile(re.escape(quote)) if inside else whole(quote), 0
    while hit := pattern.search(body, at):
        a, b = hit.span()
        if (a == 0 or starts[a] != starts[a - 1]) and (b == len(body) or starts[b] != starts[b - 1]):
            yield int(starts[a]), int(ends[b - 1])
            at = b
        else:
            at = a + 1


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """The folded form of a text; null is the empty text."""
    return text.map(lambda x: folded(x)[0])


def located(docs: DataFrame, quotes: DataFrame, doc: str, text: str, item: str, quote: str, words: int = 4, inside: bool = False) -> DataFrame:
    """(doc, item, char_start, char_end, n): where a quote first stands in a document, and how often.

    Null and empty texts hold nothing, null and empty quotes are not looked for.
    Quotes without a letter or digit have no words to meet by: those alone are
    searched for in every document. With ``inside``, where a quote may begin and
    end inside a word, so are those without a word between their first and last.
    Repeated ids give repeated rows.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    q = quotes.select(F.col(item).alias("_item"), fold(F.col(quote)).alias("_q")).where("_q <> ''").withColumn("_w", tokens(F.col("_q")))
    if inside:
        at_start, at_end = (F.col("_q").rlike(r).cast("int") for r in (r"\A[\p{L}\p{N}]", r"[\p{L}\p{N}]\z"))
        q = q.withColumn("_w", F.slice("_w", at_start + 1, F.greatest(F.size("_w") - at_start - at_end, F.lit(0))))
    q = q.withColumn("_w", F.slice("_w", 1, words))
    q = q.select("_item", "_q", F.size("_w").alias("_size"), F.array_join("_w", " ").alias("_key"))
    sizes = sorted(r[0] for r in q.where("_size > 0").select("_size").distinct().collect())  # ``words`` rows at most
    t = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc).alias("_doc"), F.col(text).alias("_t"))
    run = lambda m: F.when(F.size("_w") >= m, F.transform(F.sequence(F.lit(1), F.size("_w") - (m - 1)), lambda i: F.array_join(F.slice("_w", i, m), " "))).otherwise(F.array())
    runs = F.array_distinct(F.flatten(F.array(*(run(m) for m in sizes)))) if sizes else F.array().cast("array<string>")
    keyed = t.withColumn("_w", tokens(fold(F.col("_t")))).select("_row", F.explode(runs).alias("_key"))
    pairs = keyed.join(q.where("_size > 0").select("_key", F.struct("_item", "_q").alias("_one")), "_key").select("_row", "_one")
    pairs = pairs.unionByName(t.select("_row").crossJoin(q.where("_size = 0").select(F.struct("_item", "_q").alias("_one"))))
    # A document with all that it may hold, so that it is folded once.
    wanted = pairs.groupBy("_row").agg(F.collect_list("_one").alias("_all")).join(t, "_row").select("_doc", "_t", F.col("_all._item").alias("_items"), F.col("_all._q").alias("_quotes"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, doc), (quotes, item))]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, body, items, looked_for in zip(frame["_doc"], frame["_t"], frame["_items"], frame["_quotes"], strict=True):
                form = folded(body)
                for i, one in zip(items, looked_for, strict=True):
                    found = list(spans(form, one, inside))
                    if found:
                        rows.append((d, i, *found[0], len(found)))
            yield pd.DataFrame(rows, columns=[doc, item, "char_start", "char_end", "n"])

    return wanted.mapInPandas(search, f"{doc} {kinds[0]}, {item} {kinds[1]}, char_start int, char_end int, n int")
