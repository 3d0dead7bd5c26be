"""Folded texts and quotes against a plain reading, character by character."""

from __future__ import annotations

import random
import unicodedata

import pytest

from rulemark.operators import folding

PIECES = ["a", "B", " ", "\n", " ", "ß", "É", "é", "ﬁ", "’", "“", "—", "­", "5", ".", ",", "½", "İ", "​", "ẍ́", "\U0001f600", "中"]


def plain(text):
    """(character, start, end) one cluster at a time."""
    out, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        for ch in folding.folded_letter(text[i:j]):
            if ch.isspace():
                if out and out[-1][0] == " ":
                    out[-1] = (" ", out[-1][1], j)
                elif out:
                    out.append((" ", i, j))
            else:
                out.append((ch, i, j))
        i = j
    return out[:-1] if out and out[-1][0] == " " else out


def test_folding_matches_a_plain_reading():
    rng = random.Random(0)
    for text in ["", None, " ", "́a", "́", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(800))]:
        body, starts, ends = folding.folded(text)
        assert list(zip(body, starts.tolist(), ends.tolist(), strict=True)) == plain(text or ""), repr(text)


@pytest.mark.parametrize(
    ("text", "quote", "found"),
    [
        ("He said “Don’t  go”.", "\"don't go\"", [(8, 19)]), ("co­op­erate now", "cooperate", [(0, 11)]), ("rate 0.5% here", "5%", []), ("rate .5% here", ".5%", [(5, 8)]), ("rate 0.5% here", ".5%", []),
        ("total 1,500 units", "1", []), ("total 1, 500", "1", [(6, 7)]), ("Straße", "strass", []), ("Straße", "STRASSE", [(0, 6)]), ("aa aa aa", "aa", [(0, 2), (3, 5), (6, 8)]), ("ban banana", "an", []),
        ("pages 3–7", "3-7", [(6, 9)]), ("ﬁve", "five", [(0, 3)]), ("snake_case", "snake", [(0, 5)]), ("5.", "5", [(0, 1)]),
    ],
)
def test_whole_quotes(text, quote, found):
    assert list(folding.spans(folding.folded(text), folding.folded(quote)[0])) == found


def test_located_matches_a_search_of_all_pairs(spark):
    rng = random.Random(4)
    texts = [None, "", "…", *("".join(rng.choice(PIECES + ["river ", "Stone ", "it’s ", "well-known "]) for _ in range(30)) for _ in range(40))]
    quotes = [None, "", "­", "river", "RIVER STONE", "it's", "well–known river", "5", "…", "...", "a", "river stone it's well-known stone", "ss"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, texts[5]])], "doc_id long, text string, n int")
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    got = sorted(tuple(r) for r in folding.located(docs, items, "doc_id", "text", "item_id", "quote").collect())
    want = []
    for d, text in enumerate([*texts, texts[5]]):
        for i, q in enumerate(quotes):
            q = folding.folded(q)[0]
            found = list(folding.spans(folding.folded(text), q)) if q else []
            if found:
                want.append((d, i, *found[0], len(found)))
    assert got == sorted(want) and len(want) > 20


def test_quote_located_gives_what_its_sql_gives(spark, tmp_path):
    """Passages inside words, with white space of other kinds and lengths, letters that only folding makes alike, blanks and repeated ids."""
    import duckdb

    from rulemark.plans import registry

    texts = ["so the red fox ran away", "xthe red fox ranx, The\nRed Fox Ran1", "the  red fox ran", "the red fox ran", "straße hin und her", "strasse hin und her", "one", None, "", "a  b a  b"]
    quotes = ["the red fox ran", "straße hin und her", "the  red fox ran", "e", " ", None, "fox", "a  b"]
    spark.createDataFrame([(min(i, 8), t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(min(i, 6), t) for i, t in enumerate(quotes)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["quote_located"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.execute(registry.ORACLE_SQL["quote_located"]).fetchall()))
