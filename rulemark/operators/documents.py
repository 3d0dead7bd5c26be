"""Documents as paragraphs, and where quotes stand in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = {"p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "br", "title", "header", "footer"}
#: Characters of paragraphs that are handed back at a time.
OUT_CHARS = 2 << 20
HIDDEN = {"script", "style", "noscript", "template"}


class _Paragraphs(HTMLParser):
    """Collects (kind, text) of block elements; hidden elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.kind, self.words, self.hidden = "p", [], 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        if text:
            self.found.append((self.kind, text))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.flush()
            self.kind = "heading" if re.fullmatch(r"h[1-6]|title", tag) else "list" if tag == "li" else "cell" if tag in ("td", "th") else "p"

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.flush()
            self.kind = "p"

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, idx, kind, heading, text): a page's paragraphs under the heading that they follow."""
    kind = pages.schema[key].dataType.simpleString()

    names = [key, "idx", "kind", "heading", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pages are taken up one by one and given back a few megabytes at a time, so that no batch is held twice over.
            rows, size = [], 0
            for at in range(batch.num_rows):
                k, body = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                parser = _Paragraphs()
                parser.feed(body or "")
                parser.close()
                parser.flush()
                heading = None
                for i, (what, text) in enumerate(parser.found):
                    if what == "heading":
                        heading = text
                    rows.append((k, i, what, heading, text))
                    size += len(text) + len(heading or "") + 100
                    if size > OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds(batch), strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds(batch), strict=True)], names=names)

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]

    return pages.select(key, html).mapInArrow(work, f"{key} {kind}, idx int, kind string, heading string, text string")


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, without overlap."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(0)


#: A word of a quote's key: letters and digits only, so that brackets, quotation marks and full stops part words.
WORD = r"[\p{L}\p{N}]+"


def quoted(docs: DataFrame, quotes: DataFrame, doc: str, text: str, item: str, quote: str, words: int = 4) -> DataFrame:
    """(doc, item, char_start, n): documents that contain a quote, whatever stands around it.

    A quote's words that touch neither its start nor its end are whole words of
    any text that contains it. The first run of them, ``words`` at most, is a key
    that the document's word runs of that length are joined on, so documents and
    quotes meet by equality and only likely pairs are compared. Quotes without
    such a word (of one or two words, mostly) are compared with every document.
    Empty quotes are not looked for.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    q = quotes.select(F.col(item), F.col(quote).alias("_q")).where("_q <> ''")
    at_start, at_end = (F.col("_q").rlike(r).cast("int") for r in (r"\A[\p{L}\p{N}]", r"[\p{L}\p{N}]\z"))
    inner = F.slice(tokens(F.col("_q")), at_start + 1, F.greatest(F.size(tokens(F.col("_q"))) - at_start - at_end, F.lit(0)))
    q = q.withColumn("_inner", F.slice(inner, 1, words)).withColumn("_size", F.size("_inner")).withColumn("_key", F.array_join("_inner", " "))
    sizes = sorted(r[0] for r in q.where("_size > 0").select("_size").distinct().collect())  # ``words`` rows at most
    # Every run of those lengths, taken in order.
    t = docs.select(doc, tokens(F.col(text)).alias("_w")) if sizes else docs.select(doc, F.array().cast("array<string>").alias("_w"))
    run = lambda m: F.when(F.size("_w") >= m, F.transform(F.sequence(F.lit(1), F.size("_w") - (m - 1)), lambda i: F.array_join(F.slice("_w", i, m), " "))).otherwise(F.array())
    runs = F.array_distinct(F.flatten(F.array(*(run(m) for m in sizes)))) if sizes else F.col("_w")
    keyed = t.select(doc, F.explode(runs).alias("_key")).join(q.where("_size > 0").select(item, "_key").distinct(), "_key").select(doc, item).distinct()
    texts = docs.select(doc, F.col(text).alias("_t"))
    hit = keyed.join(texts, doc).join(q.where("_size > 0").select(item, "_q"), item).where(F.contains("_t", "_q")).select(doc, item, "_t", "_q")
    short = texts.join(q.where("_size = 0").select(item, "_q"), F.contains("_t", "_q")).select(doc, item, "_t", "_q")
    return hit.unionByName(short).select(doc, item, (F.position(F.col("_q"), F.col("_t")) - 1).alias("char_start"), occurrences(F.col("_t"), F.col("_q")).alias("n"))


def section(paragraphs: DataFrame, pattern: str, heading: str = "heading") -> DataFrame:
    """Paragraphs that stand under a heading which matches the pattern."""
    return paragraphs.where(F.col(heading).rlike(pattern))
