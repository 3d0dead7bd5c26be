"""URL filter, importance resampling and conversation repair against plain versions, and on the rows that break things."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemark.llm import conversations, importance, queries, url_filter
from rulemark.llm.oracle import crc

# ---------------------------------------------------------------- url filter

URLS = [None, "", "no scheme", "http://", "ftp://Host.EXAMPLE.org/es/x?q=1#f", "https://example.org/en/1", "https://a.example.org/en/12#x", "https://example.org", "x://y://z/fr/",
        "http://badexample.org/es/", "http://fr.com/fr/a", "http://de.com/de/a", "http://spam.net/", "http://a.b.spam-farm.net/x", "http://good.net/free/casino/page", "http://good.net/free", "http://.../..", "http://u@h.net:80/p",
        "http://" + "a." * 400 + "casino.net/deep", "http://good.net/free"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_keys(host, path):
    labels = host.split(".")
    return {".".join(labels[k:]) for k in range(len(labels))} | {host + path} if host else set()


def test_urls_are_judged_like_a_plain_reading(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("verdict", F.lit("mine"))
    listing = spark.createDataFrame([("spam-farm.net",), ("good.net/free",), ("nobody.example",), (None,), ("casino.net",)], "key string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES, listing).collect()}
    keys = {"spam-farm.net", "good.net/free", "casino.net"}
    for k, url in enumerate(URLS):
        host, path = plain_parts(url)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        r = got[k]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.name, "mine"), url
        assert r["_verdict"] == (best.verdict if best else "block" if keys & plain_keys(host, path) else "allow"), url


@pytest.mark.parametrize("max_bytes", [url_filter.MAX_BYTES, 2000])
def test_cascade_is_exact_over_its_universe(spark, max_bytes):
    rows = spark.range(30000).select("id", F.array(F.concat(F.lit("k"), F.col("id")), F.lit(None), F.lit("hot")).alias("keys"))
    listing = spark.range(0, 60000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    out = url_filter.mark(rows, F.col("keys"), listing, max_bytes=max_bytes)
    assert out.where(F.col("listed") != (F.col("id") % 7 == 0)).count() == 0 and out.count() == 30000


def test_cascade_levels_end_and_empty_lists(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVELS", 6)
    rows = spark.range(50).select("id", F.array(F.col("id").cast("string")).alias("keys"))
    none = spark.createDataFrame([], "key string")
    assert url_filter.mark(rows, F.col("keys"), none).where("listed").count() == 0
    assert url_filter.mark(rows, F.col("keys"), rows.select(F.col("keys")[0].alias("key"))).where("NOT listed").count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, none).count() == 0
    same = spark.createDataFrame([(1, 2, True), (1, 2, False)], "h1 long, h2 long, listed boolean")
    with pytest.raises(RuntimeError, match="128-bit"):
        url_filter.build(same, 1, 1)


# ---------------------------------------------------------------- importance

TEXTS = [(0, None), (1, ""), (2, "The the THE river"), (3, "a-b c_d é1 Été\x00x"), (4, "one two three " * 40), (5, "river " * 25), (6, "x" * 5000 + " tail " * 30), (7, "river stone " * 20), (7, "river stone " * 20), (None, "river moon " * 15)]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_runs(text, n):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_weights(docs, target, n, buckets):
    of = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(of(g) for x in texts for g in plain_runs(x, n)) for texts in (docs, target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for x in docs:
        g = [gain(of(r)) for r in plain_runs(x, n)]
        out.append((len(plain_words(x)), len(g), sum(g) // len(g) if g else 0))
    return out


def plain_noise(key, seed=2024):
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("target", [["river stone by the river", None, "moon"], []])
def test_weights_and_draw_match_brute_force(spark, n, target):
    rng = random.Random(3)
    docs = TEXTS + [(k, " ".join(rng.choice(["river", "stone", "Moon", "été", "w7", "sings"]) for _ in range(rng.randrange(60)))) for k in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    weighed = importance.weigh(df, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=97)
    want = Counter((d[0], *w) for d, w in zip(docs, plain_weights([d[1] for d in docs], target, n, 97), strict=True))
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"]) for r in weighed.collect()) == want
    scored = [(*row, row[3] + plain_noise(row[0])) for row in want.elements()]
    able = sorted((-r[4], -1 if r[0] is None else r[0]) for r in scored if r[1] >= 20)
    k = 30 * len(able) // 100
    got = importance.draw(weighed, percent=30, seed=2024).collect()
    assert len(got) == len(docs)
    assert sorted(((r["rank"], (-r["score"], -1 if r["doc_id"] is None else r["doc_id"])) for r in got if r["rank"])) == list(enumerate(able[:k], 1))


def test_resampling_keeps_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(k, "river stone " * 12, "en", 1) for k in range(40)], "doc_id long, text string, weight string, rank int")
    out = importance.resample(docs, docs.limit(1), percent=25, seed=1)
    assert out.columns == docs.columns and out.count() == 10
    weighed = importance.weigh(docs, docs.limit(1))
    assert weighed.columns == ["doc_id", "weight", "rank", "n_words", "n_features", "_weight"]
    empty = docs.where("false")
    assert importance.draw(importance.weigh(empty, empty, keep=["doc_id"]), 10, 1).count() == 0


def test_runs_of_long_text_and_pieces():
    number, text_of = np.array([0, 1, 0, 1, 1, 0]), np.array([0, 0, 0, 1, 1, 1])
    gram, made, at = importance._grams(number, text_of, 2, 3)
    names = [tuple(row) for m in made for row in m.tolist()]
    runs = Counter((int(t), names[g]) for g, t in zip(gram, at, strict=True))
    want = Counter()
    for t, ws in ((0, [0, 1, 0]), (1, [1, 1, 0])):
        want.update((t, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert runs == want


# ---------------------------------------------------------------- conversations


def brute(turns):
    """Least (cost, audit) over all edits, insertions up to two before each turn and at the end (three are never cheaper than none)."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and legal.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r, inserted + 1)
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, cost + 4, audit + "D", roles, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                go(i + 1, cost + extra, audit + "K", roles + (initial or "-"), 0)
                for r in "ua":
                    go(i + 1, cost + 3 + extra, audit + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best


def test_cheapest_edits_match_a_search_of_all():
    rng = random.Random(5)
    for _ in range(60):
        turns = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(4))]
        assert conversations.cheapest(turns) == brute(turns), turns


def talk(n, seed, most=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut off", " ", None, "", "Why?", "é.\n"]) if rng.random() < 0.8 else f"t{rng.random()}."))
    return rows


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_large_conversations_give_what_small_ones_give(spark):
    rows = [(None if c == 3 else c, *r) for c, *r in talk(40, 1)] + [(99, k // 2, random.Random(k).choice(["user", "assistant", "system"]), random.Random(k * 7).choice(["A.", "b", "C!", f"n{k}."])) for k in range(3000)]
    df = rows_of(spark, rows).repartition(6)
    damaged = conversations.damage(df)
    small = {r["conv_id"]: r for r in conversations.repair(df, damaged).collect()}
    cut = {r["conv_id"]: r for r in conversations.repair(df, damaged, max_turns=2).collect()}
    assert len(small) == len({r[0] for r in rows}) and small == cut
    assert len(small[99]["audit"]) > 2500




def test_damage_and_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (None, None, None, None), (2, 5, "user", "Long " * 50000 + "."), (2, 9, "assistant", "ok.")]
    df = rows_of(spark, rows).withColumn("audit", F.lit("mine"))
    kinds = [zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows]
    assert conversations.damage(df).count() == sum(0 if k == 0 else 2 if k == 3 else 1 for k in kinds)
    got = {r["conv_id"]: r for r in conversations.repair(df, df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))).collect()}
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"], got[1]["illegal"]) == (1, 7, "KDI", 1)
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
    assert (got[None]["blank"], got[None]["audit"], got[None]["gaps"], got[None]["repaired_sha256"]) == (1, "D", 0, hashlib.sha256(b"").hexdigest())
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"]) == (3, 0, "KK")
    nothing = conversations.repair(df, df.where("false").select("conv_id", "turn", "role", "text")).collect()
    assert {(r["cost"], r["audit"]) for r in nothing} == {(0, "")} and len(nothing) == 3
    assert conversations.repair(df.where("false"), df.where("false").select("conv_id", "turn", "role", "text")).count() == 0


def test_sql_checksum():
    import duckdb

    from rulemark.llm.oracle import CRC_TABLE

    got = duckdb.sql(f"WITH RECURSIVE {CRC_TABLE}, t AS (SELECT unnest(['', 'a', 'été', '12:3']) AS x) SELECT x, {crc('x')} FROM t, crc_table").fetchall()
    assert all(zlib.crc32(x.encode()) == n for x, n in got)
