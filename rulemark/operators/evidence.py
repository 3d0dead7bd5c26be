"""Rules taken from documents, each checked against the passage that it cites.

A rule counts only where its quote stands in its document (typography aside) and
every number of the rule stands in the quote, as written, as a percentage for its
share or as a fraction for its percentage. What is not so is not thrown away: it
keeps its place with the status ``unknown`` and what was missing, and is not
compiled. Rules meet their documents by an equi join and are checked one by one,
a document's rules after each other, so a document of very many rules is no
group in memory and is folded once a run.

Defined results: a null or empty quote, a missing or null text leave a rule
unknown; a rule without numbers needs its quote only; null numbers are not
looked for; rules that repeat are checked each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemark.functions import text as words
from rulemark.functions.numbers import number_appears
from rulemark.operators.folding import folded, spans


def _judged(body: str | None, form: tuple, one: str | None, numbers: tuple[float, ...]) -> tuple:
    """(passage, start, end, occurrences, numbers that it does not hold) of a quote in a text with its folded form."""
    q = folded(one)[0]
    hits = list(spans(form, q)) if q and body else []
    if not hits:
        return None, None, None, 0, []
    a, b = hits[0]
    return body[a:b], a, b, len(hits), [v for v in numbers if not number_appears(v, body[a:b])]


def checked(rules: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text", quote: str = "quote", values: str = "values") -> DataFrame:
    """rules with found, evidence (the passage as the document has it), char_start, char_end, occurrences and ungrounded (numbers that the passage does not hold)."""
    there = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    rows = rules.join(there, rules[doc] == F.col("_doc"), "left").drop("_doc")
    rows = rows.repartition(F.col(doc), F.pmod(F.xxhash64(quote), F.lit(16))).sortWithinPartitions(doc)
    added = "evidence string, char_start int, char_end int, occurrences int, ungrounded array<double>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, form = None, folded("")
        for frame in frames:
            out, known = [], {}
            for body, one, numbers in zip(frame["_text"], frame[quote], frame[values], strict=True):
                numbers = tuple(float(v) for v in numbers if v is not None and v == v) if numbers is not None else ()
                case = (body, one, numbers)
                if case not in known:  # what repeats in a frame is checked once
                    if body != last:
                        last, form = body, folded(body)
                    known[case] = _judged(body, form, one, numbers)
                out.append(known[case])
            found = pd.DataFrame(out, columns=["evidence", "char_start", "char_end", "occurrences", "ungrounded"])
            found[["char_start", "char_end"]] = found[["char_start", "char_end"]].astype("Int32")
            yield pd.concat([frame.drop(columns="_text").reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(check, f"{kinds}, {added}")


def constraints(rules: DataFrame, docs: DataFrame, kind: str = "kind", **columns: str) -> DataFrame:
    """Checked rules as constraints: status (disclosed or unknown), modality of the passage, why, and whether they compile."""
    c = checked(rules, docs, **columns)
    found, grounded = F.col("evidence").isNotNull(), F.size("ungrounded") == 0
    status = F.when(found & grounded, "disclosed").otherwise("unknown")
    why = F.when(~found, "quote not found").when(~grounded, F.concat(F.lit("not in the quote: "), F.array_join(F.transform("ungrounded", lambda v: F.format_string("%.6f", v)), ", "))).otherwise("")
    c = c.withColumns({"_hard": words.terms(F.coalesce("evidence", F.lit("")), words.HARD), "_soft": words.terms(F.coalesce("evidence", F.lit("")), words.SOFT)})
    c = c.withColumns({"status": status, "why": why, "modality": words.modality(F.col("_hard"), F.col("_soft"))}).drop("_hard", "_soft")
    return c.withColumn("compiles", (F.col("status") == "disclosed") & F.coalesce(F.col(kind) != "unmapped", F.lit(False)))
