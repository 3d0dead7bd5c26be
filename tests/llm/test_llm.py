"""Each operator against a brute-force version, and on the rows that break things."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemark.llm import license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_model, quality_rules, queries, secrets, topk, toxicity
from rulemark.llm.queries import token_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 0) -> list[tuple]:
    """Prose with copies, near copies, odd rows."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "river", "stone", "été", "größe", "house", "walks", "slowly", "under", "bright", "moon", "when", "people", "sing", "old", "songs"] + [f"w{k}" for k in range(200)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 30))).capitalize() + "."
    texts = ["\n".join(line() for _ in range(rng.randint(2, 9))) for _ in range(n)]
    for k in range(0, n // 3):
        t = texts[rng.randrange(n)].split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    texts += [None, "", " \n\t ", "one", "two words", "x " * 500, "ha ha ha ha " * 40, "\n".join(["same line of five words."] * 6), "a\x00b\x0bc\x85d", "日本語 " * 30, "word " + "y" * 3000]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, texts[1], None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r["doc_id"]), tuple(r["quality"][f] for f in fields), r["quality"]["base_failed"]) for r in quality_rules.assess(docs).select("doc_id", "quality").collect())
    want = sorted((str(i), c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t, *_ in rows for c in [base_counts(t)])
    assert got == want


def test_quality_many_repeats(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(400)), " ".join(f"a{k % 60} b{k % 60} c" for k in range(300))]
    got = [r[0] for r in quality_rules.assess(spark.createDataFrame([(t,) for t in texts], "text string")).select("quality.n_repeat_words").collect()]
    assert got == [base_counts(t)[4] for t in texts]


def test_quality_verdicts(spark):
    prose = "The old river runs slowly under the bright moon when people sing. " * 3
    rng = random.Random(2)
    clean = "\n".join(" ".join(f"v{rng.randrange(999)}" for _ in range(20)) + "." for _ in range(5))
    bars = "\n".join(" | ".join(f"k{rng.randrange(999)}" for _ in range(30)) for _ in range(4))
    shout = " ".join(f"K{rng.randrange(999)}!!" for _ in range(90)) + "."
    noise = " ".join(f"k{rng.randrange(999)}%%%" for _ in range(90)) + "."
    df = spark.createDataFrame([(1, clean, 5, "q"), (2, bars, 5, "q"), (3, shout, 5, "q"), (4, noise, 5, "q"), (5, clean + "\nHome | About | Help | Login", 5, "q"), (6, None, 5, "q")], "doc_id long, text string, kept int, quality string")
    out = {r["doc_id"]: r for r in quality_rules.clean_documents(df).collect()}
    assert set(out) == {1, 5} and out[5]["text"] == clean and out[1]["kept"] == 5 and prose
    assert quality_rules.clean_documents(df.limit(0)).count() == 0


def test_codec_equals_library(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_model())
    out = piece_codec.encode_documents(docs.withColumn("ids", F.lit(1)), token_model(), decimals="decimals", decoded="decoded")
    assert "_ids" in out.columns and out.columns.count("ids") == 1
    again = piece_codec.decode_documents(out.select("doc_id", "_ids"), token_model(), "_ids")
    texts = sorted(str(r["decoded"]) for r in again.collect())
    got = out.collect()
    assert len(got) == len(rows) and texts == sorted(sp.decode(sp.encode(t or "")) for _, t, *_ in rows)
    for r in got:
        ids = sp.encode(r["text"] or "")
        assert r["_ids"] == ids and r["n_tokens"] == len(ids) and r["decimals"] == ",".join(map(str, ids)) and r["decoded"] == sp.decode(ids)


def test_codec_random_ids():
    import sentencepiece

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=token_model()), piece_codec.model(token_model()), random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(m.size) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randrange(25))]
        assert m.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [sp.decode(ids)]
    texts = ["".join(rng.choice("aeinrst  \n▁.é日x") for _ in range(rng.randrange(300))) for _ in range(200)]
    ids, at = m.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == sp.encode(texts)


def test_license_scan(spark):
    files = [("r/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r/a/b/c.py", "code"), ("r/lib/COPYING", "Released under the MIT License."), ("r/lib/x/y.py", "code"), ("r/lib/own.py", "code\nThis work is licensed under the GNU General Public License, version 3.\nmore " * 3), ("q/z.py", "the license of the poet"), ("top.py", None), (None, "Released under the MIT License.")]
    out = {r["path"]: r for r in license_scan.scan(spark.createDataFrame([(*f, "mine") for f in files], "path string, text string, license string")).collect()}
    assert {p: r["_license"] for p, r in out.items()} == {"r/LICENSE": "Apache-2.0", "r/a/b/c.py": "Apache-2.0", "r/lib/COPYING": "MIT", "r/lib/x/y.py": "MIT", "r/lib/own.py": "GPL-3.0", "q/z.py": None, "top.py": None, None: "MIT"}
    assert out["r/lib/x/y.py"]["licensed_by"] == "r/lib" and out["r/lib/own.py"]["licensed_by"] is None and out["r/a/b/c.py"]["license"] == "mine"


def test_license_windows():
    """Wrapped headers, notices inside a line, SPDX lines, and window norms against counts."""
    gpl = "/* This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU {} Public License\n * as published by the Free Software Foundation; either version {}\n * of the License, or (at your option) any later version.\n */\nint main;"
    bsd = license_scan._BSD + 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    cases = [(gpl.format("General", "2"), "GPL-2.0"), (gpl.format("General", "3"), "GPL-3.0"), (gpl.format("Lesser General", "2.1"), "LGPL-2.1"), (gpl.format("Affero General", "3"), "AGPL-3.0"), (bsd, "BSD-2-Clause")]
    cases += [("Released under the MIT License. " + "some other word " * 40, "MIT"), ("x = 1\n# SPDX-License-Identifier: MIT\n", "MIT"), ("// SPDX-License-Identifier: (GPL-2.0-only OR Zlib)", "(GPL-2.0 OR Zlib)")]
    for df, n in (({}, 9), ({"the": 900, "of": 900, "version": 40, "2": 500, "3": 500, "license": 60}, 1000)):
        matcher = license_scan.Matcher(df, n, 0.6)
        assert [matcher.judge(t)[0] for t, _ in cases] == [name for _, name in cases]
    assert matcher.judge("the license of the poet")[0] is None
    _, score, lines, share = matcher.judge(cases[5][0])
    assert score == 1 and lines == 1 and share < 0.1
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 60)
    for size in (1, 7, 60):
        want = [sum((c * (t + 1.0)) ** 2 for t, c in Counter(ids[k : k + size].tolist()).items()) for k in range(61 - size)]
        assert np.allclose(license_scan._window_norms(ids, (ids + 1.0) ** 2, size), want)


def labelled(n, good, bad, seed=4):
    rng = random.Random(seed)
    filler = [f"w{k}" for k in range(80)]
    return [(k, " ".join(rng.choices(filler, k=40)) + " " + rng.choice(bad if k % 4 == 0 else good), int(k % 4 != 0)) for k in range(n)]


def test_quality_model_held_out(spark):
    rng = random.Random(5)
    rows = [(k, " ".join((f"W{rng.randrange(80)}!!" if k % 4 == 0 else f"w{rng.randrange(80)}") for _ in range(30)), int(k % 4 != 0)) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_model.fit(df.where("doc_id < 160").select("doc_id", "text"), df.where("doc_id < 160").select("doc_id", "quality"))
    out = quality_model.score_documents(df.where("doc_id >= 160").unionByName(spark.createDataFrame([(None, None, None), (900, "", None)], df.schema)), model).collect()
    assert all((r["score"] >= 0.5) == bool(r["quality"]) for r in out if r["quality"] is not None)
    assert len({r["score"] for r in out if not r["text"]}) == 1 and all(0 <= r["score"] <= 1 for r in out)
    one = quality_model.fit(df.select("doc_id", "text"), df.where("quality = 1").select("doc_id", "quality"))
    assert quality_model.score_documents(df, one).where("score < 0.99").count() == 0
    assert quality_model.score_documents(df.limit(0), one).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad = ["rotter", "scoundrel", "blackguard"]
    rows = [(k, " ".join([rng.choice(bad) if k % 5 == 0 and j < 3 else f"w{rng.randrange(99)}abc" for j in range(30)]), int(k % 5 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = df.where("doc_id < 200")
    # Half of the documents have labels; the other positives are unlabelled.
    labels = learn.where("doc_id % 2 = 0").select("doc_id", "toxic")
    model = toxicity.fit(learn.select("doc_id", "text"), labels)
    out = toxicity.score_documents(df.where("doc_id >= 200").unionByName(spark.createDataFrame([(None, None, None)], df.schema)), model).collect()
    wrong = [r for r in out if r["toxic"] is not None and (r["score"] >= 0.7) != bool(r["toxic"])]
    assert len(wrong) <= 2, [(r["doc_id"], r["score"]) for r in wrong]
    none = toxicity.fit(learn.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score_documents(df, none).select("score").distinct().count() == 1


def test_risk_is_held_at_zero():
    rows = [np.array([0]), np.array([0]), np.array([1])]
    w, _ = toxicity.train(rows, np.array([1.0, 1, 0]), np.array([0.0, 0, 1]), 0.5, 2, toxicity.Settings(steps=50))
    assert np.isfinite(w).all() and w[0] > w[1]


def test_pattern_deviates_less_than_a_block():
    for weights in ({"a": 1, "*": 1}, {"a": 20, "b": 12, "c": 8, "d": 5, "*": 55}, {"a": 97, "b": 1, "*": 2}):
        p, total = mixing.pattern(weights) * 2, sum(weights.values())
        for s, n in weights.items():
            assert max(abs(sum(x == s for x in p[:t]) - t * n / total) for t in range(len(p) + 1)) < 1


def test_schedule_places_every_block():
    blocks, weights = {"a": 7, "b": 0, "c": 40, "*": 13}, {"a": 3, "b": 2, "c": 4, "*": 1}
    at = {}
    for p in mixing.schedule(blocks, weights):
        n = len(p.slots)
        for b in range(p.first, p.last + 1):
            at[p.start + (b - p.first) // n * p.period + p.slots[(b - p.first) % n]] = (p.stream, b)
    assert sorted(at) == list(range(60)) and sorted(at.values()) == sorted((s, b) for s, n in blocks.items() for b in range(n))


def test_mix_keeps_all_rows(docs, rows):
    out = mixing.mix(docs.withColumn("slot", F.lit("mine")), {"s0": 3, "s1": 1, mixing.OTHER: 2}, block_rows=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, *_ in rows)
    assert all(r["slot"] == "mine" for r in out) and all(n <= 4 for n in Counter(r["_slot"] for r in out).values())
    assert len({(r["_slot"], r["place"]) for r in out}) == len(out) and {r["stream"] for r in out} == {"s0", "s1", "*"}
    assert mixing.mixed(docs.limit(0), {mixing.OTHER: 1}).count() == 0


def test_every_source_has_its_own_stream(spark, tmp_path):
    """Whatever the names: while all sources run, each is less than one block off the share its weight gives."""
    sizes = {"hot": 900, "mid": 225, "small": 100, "tiny": 9, None: 60}
    rows = [(k, "t", "en", s, 1) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    weights = mixing.tempered_weights(docs)
    assert weights == {"hot": 16, "mid": 8, "small": 5, "tiny": 2, mixing.OTHER: 4}
    out = queries.op5_mixing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r["stream"] == (r["source"] or mixing.OTHER) for r in out)
    at = {r["slot"]: r["stream"] for r in out}
    ends = min(max(k for k, s in at.items() if s == name) for name in weights)
    order = [at[k] for k in range(ends + 1)]
    for name, n in weights.items():
        assert all(abs(order[:t].count(name) - t * n / 35) < 1 for t in range(ends + 2))
    assert mixing.tempered_weights(docs.limit(0)) == {mixing.OTHER: 1}


def test_pattern_is_earliest_deadline_first():
    for weights in ({"a": 1, "*": 1}, {"a": 20, "b": 12, "c": 8, "d": 5, "*": 55}, {f"s{k}": 1 + k % 5 for k in range(40)}):
        total, done = sum(weights.values()), dict.fromkeys(weights, 0)
        for slot, got in enumerate(mixing.pattern(weights)):
            ready = [s for s, n in weights.items() if done[s] < n and done[s] * total // n <= slot]
            assert got == min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
            done[got] += 1


def test_top_k(spark):
    rng = random.Random(7)
    vectors = [(k, [rng.choice([-0.5, 0.25, 0.1, 1.5]) for _ in range(5)]) for k in range(130)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, []), (204, [float("inf")] * 5), (None, [1.0] * 5), (205, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()}
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in vectors}
    for q in range(0, 130, 20):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        assert [got[q, k + 1] for k in range(7)] == [(i, -s) for s, i in want]
    assert len(got) == 7 * 7


def test_top_k_of_large_components(spark):
    """Every finite vector takes part; scores beyond 64 bits rank exactly and are null."""
    rng = random.Random(8)
    pick = lambda big: [rng.choice([0.5, -0.25, 3.0, *big]) for _ in range(4)]
    vectors = [(k, pick([])) for k in range(40)] + [(40 + k, pick([2.0**20, -(2.0**21) - 1, 5e6])) for k in range(20)] + [(60 + k, pick([3e9, -1e15, 7e30, -7e30, 1e300, 1.7e308])) for k in range(20)]
    vectors += [(80, [1.7e308, 0.0, 0.0, 0.0]), (81, [-1.7e308, 0.0, 0.0, 0.0]), (82, list(vectors[65][1]))]
    df = spark.createDataFrame([*vectors, (90, [float("inf"), 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    whole = {i: [topk._whole(x, 64) for x in v] for i, v in vectors}
    assert whole[80][0] == 64 * int(1.7e308)
    before = topk.CANDIDATES
    try:
        topk.CANDIDATES = 32  # several blocks, some without large components
        out = topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id > 64"), k=9).collect()
    finally:
        topk.CANDIDATES = before
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    for q in [0, 20, 40, 60, *range(65, 83)]:
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:9]
        assert [got[q, k + 1] for k in range(9)] == [(i, -s if -(2**63) <= -s < 2**63 else None) for s, i in want], q


def test_line_dedup(docs, rows):
    flat, seen = [], set()
    for i, t, *_ in rows:
        if (i, t) not in seen:
            seen.add((i, t))
            flat += [(line_dedup.LAST if i is None else i, k, line_dedup.line_set(x)) for k, x in enumerate((t or "").split("\n"))]
    flat = sorted((x for x in flat if len(x[2]) >= 5), key=lambda x: x[:2])
    want = {x[:2] for n, x in enumerate(flat) if any(100 * len(x[2] & y[2]) >= 80 * len(x[2] | y[2]) for y in flat[:n])}
    assert {(r["did"], r["line_no"]) for r in line_dedup.later_lines(docs).collect()} == want
    out = line_dedup.dedup_lines(docs.withColumn("gone", F.lit(3))).collect()
    assert len(out) == len(rows) and all(r["gone"] == 3 for r in out)
    lines = {(line_dedup.LAST if r["doc_id"] is None else r["doc_id"]): r for r in out}
    for i, t, *_ in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if (line_dedup.LAST if i is None else i, k) not in want]
        assert (lines[line_dedup.LAST if i is None else i]["text"] or "") == "\n".join(left)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query and the pipeline's stage exempt no line with a word: repeats go, near ones of four and five words too."""
    import corpus_pipeline

    texts = ["Home | About\n日本語の行\na b c\n\none two three four", "home | ABOUT\n日本語の行\na b d\n\none two three four five", "Home | About | Contact\n \nc b a\nx", None, "x\nx"]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([*texts, *(r[1] for r in corpus(30))])]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    flat = [(i, k, line_dedup.line_set(x)) for i, t, *_ in docs for k, x in enumerate((t or "").split("\n"))]
    flat = [x for x in flat if x[2]]
    want = {x[:2] for n, x in enumerate(flat) if any(100 * len(x[2] & y[2]) >= 80 * len(x[2] | y[2]) for y in flat[:n])}
    assert {(1, 0), (1, 1), (1, 4), (2, 2), (4, 0), (4, 1)} <= want and (1, 2) not in want
    got = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got if r["n_removed"]} == Counter(i for i, _ in want)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    for i, t, *_ in docs:
        assert (left[i] or "") == "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in want)


def slow_spans(t):
    """The base spans, from the patterns as they are written."""
    out = []
    for kind, pattern, least, group in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t, re.ASCII) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_spans():
    rng = random.Random(11)
    parts = ["é ", "password", "PassWd", "secret", "token", "api_key", "apikey", " = ", ": ", '"', "'", "abcdef1", "abc", "AKIA", "A" * 16, "B" * 15, "0f" * 12, "0" * 23, " ", "\n", "x9$K!mQ2zz@L", "ſecret", "===="]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in secrets.scan(t) if s[0] != "guess"] == slow_spans(t), t
    t = "password: x9$K!mQ2zz@L."
    assert [t[a:b] for k, a, b, _ in secrets.scan(t) if k == "guess"] == ["x9$K!mQ2zz@L"]
    assert secrets.scan(None) == [] == secrets.scan("") == secrets.scan("pwd: letmein!")
    assert secrets.guess_cost("password") < 1 < secrets.guess_cost("qwertyui") < secrets.guess_cost("x9$K!mQ2") and secrets.guess_cost("aaaaaaaaaaaaaaaa") < 4


@pytest.mark.parametrize("name", ["password", "db_password", "dbPassword", "DBPASSWORD", "userToken", "authToken", "x-auth-token", "passwordHash", "SECRET_KEY_BASE", "apiKey", "MYAPIKEY2", "smtpPwd"])
def test_secrets_under_joined_names(name):
    for t in (f'{name} = "x9$K!mQ2zz@L"', f"{name}: x9$K!mQ2zz@L.", f"if x=1 {name}=x9$K!mQ2zz@L\n", f"'{name}' => 'x9$K!mQ2zz@L'", f"size={name}=x9$K!mQ2zz@L"):
        assert [t[a:b] for k, a, b, _ in secrets.scan(t) if k == "guess"] == ["x9$K!mQ2zz@L"], t
    assert [s for s in secrets.scan(f"{name}: letmein! monkey: x9$K!mQ2zz@L") if s[0] == "guess"] == []


@pytest.mark.parametrize("text", [
    "author: Shakespeare", "passage: international", "compass = northwestern", "tokenizer = sentencepiece", "authority: municipality", "bypass: Umgehungsstrasse", "authors: https://example.org/papers/list",
    "secretary: Featherstonehaugh", "The password is confidential.", "tokens: sentencepiece", "<passage>international</passage>", "keyboard: mechanical-layout", "authentication = kerberos-realm",
])
def test_everyday_names_are_no_credentials(text):
    assert [s for s in secrets.scan(text) if s[0] == "guess"] == []


@pytest.mark.parametrize("text", ["my password is x9$K!mQ2zz@L", "<password>x9$K!mQ2zz@L</password>", "The Secret is: 'x9$K!mQ2zz@L'.", "<db_passwd> x9$K!mQ2zz@L</db_passwd>", "client-key: x9$K!mQ2zz@L"])
def test_secrets_in_prose_and_tags(text):
    assert [text[a:b] for k, a, b, _ in secrets.scan(text) if k == "guess"] == ["x9$K!mQ2zz@L"]


def test_guess_cost_is_minimal_over_plain_splits():
    """Against all splits of a short value into words and single characters."""
    def slow(v):
        if not v:
            return 0.0
        best = secrets._brute(v[0]) + slow(v[1:])
        for k in range(2, len(v) + 1):
            if v[:k] in secrets._WORD_COST:
                best = min(best, secrets._WORD_COST[v[:k]] + secrets.PART_COST + slow(v[k:]))
        return best

    for v in ("catdog", "xcatz", "rootqq", "zz"):
        assert secrets.guess_cost(v) <= slow(v) + 1e-9


def test_find_secrets_rows(docs, rows):
    out = secrets.find_secrets(docs.withColumn("secrets", F.lit(1))).collect()
    assert len(out) == len(rows) and all(r["_secrets"] == [] for r in out if not r["text"])


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(ngram_join.element_set(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = ngram_join.link_documents(docs, n=n, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"]))
        if r["doc_id"] is not None:
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs, n=n, percent=percent).collect()}
    assert kept - {None} == {i for i in ids if find(i) == i} and None in kept
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    """Any two sets within the threshold share an entry."""
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        bands = ngram_join.Bands(percent)
        for _ in range(400):
            size = int(rng.integers(3, 140))
            x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            most = (len(x) * (100 - percent)) // 100
            y = np.unique(np.append(x[rng.permutation(len(x))[: len(x) - int(rng.integers(0, most + 1))]], rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64)))
            if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) and not np.array_equal(x, y):
                assert np.intersect1d(ngram_join.signatures(x, bands), ngram_join.signatures(y, bands)).size
                apart = np.unpackbits((ngram_join.sketch(x) ^ ngram_join.sketch(y)).view(np.uint8)).sum()
                assert apart * (100 + percent) <= (len(x) + len(y)) * (100 - percent)


def test_pipeline_stages(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    clean = ["\n".join(" ".join(f"v{rng.randrange(5000)}" for _ in range(25)) + "." for _ in range(4)) for _ in range(12)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(clean)]
    near = clean[0].split(" ")
    near[40] = "changed"
    rows += [(50, clean[1], "en", "src0", 1), (51, " ".join(near), "en", "src1", 1), (52, "menu | home | about | login " * 20, "en", "src0", 1), (53, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(12)) <= set(got) and 52 not in got and 53 not in got
    assert all(got[k]["decoded_sha256"] == hashlib.sha256(clean[k].encode()).hexdigest() for k in range(12))
    assert len(corpus_pipeline.STAGES) == 5
