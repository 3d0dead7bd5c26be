"""Rows that once gave wrong results: clashing names, trailing blanks, repeated ids, hot values, file layouts."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rulemark.llm import license_scan, line_dedup, mixing, ngram_join, quality_model, quality_rules, secrets, topk, toxicity


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_trailing_blanks_do_not_fail_a_line(spark):
    line = " ".join(f"word{k}" for k in range(60)) + "."
    docs = spark.createDataFrame([(1, line), (2, line + " " * 20), (3, line + "\t" * 40 + "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["quality"]["kept"] for r in quality_rules.assess(docs).collect()} == {1: True, 2: True, 3: False}


def test_licence_scan_with_clashing_names(spark):
    rows = [("r/LICENSE", "Licensed under the Apache License, Version 2.0.", "MINE", 1), ("r/a.py", "code", "MINE", 2), ("q/b.py", "", "MINE", 3), ("q/b.py", "", "MINE", 3)]
    files = spark.createDataFrame(rows, "path string, text string, own_license string, l_got int")
    out = license_scan.scan(files).collect()
    assert sorted((r["path"], r["license"]) for r in out) == [("q/b.py", None), ("q/b.py", None), ("r/LICENSE", "Apache-2.0"), ("r/a.py", "Apache-2.0")]
    assert all(r["own_license"] == "MINE" for r in out) and len(set(out[0].__fields__)) == len(out[0].__fields__)
    assert license_scan.scan(files.limit(0)).count() == 0


def test_mix_with_clashing_names(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").alias("source"), F.lit(5).alias("p_first"), F.lit(6).alias("p_slots"))
    out = mixing.mix(docs, {"a": 2, mixing.OTHER: 1}, block_rows=2).collect()
    assert len(out) == 40 and {(r["p_first"], r["p_slots"]) for r in out} == {(5, 6)} and len({(r["slot"], r["place"]) for r in out}) == 40


def test_mixed_deviates_by_less_than_a_block(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abbccc")), (F.col("id") % 6 + 1).cast("int")).alias("source"))
    weights, size = {"a": 1, "b": 2, "c": 3, mixing.OTHER: 1}, 4
    order = [r["source"] for r in mixing.mixed(docs, weights, block_rows=size).collect()]
    for at in range(0, 600, size):  # while all streams last, and OTHER has no row
        for s in "abc":
            share = at * weights[s] / 6
            assert abs(order[:at].count(s) - share) < size


def test_ngram_join_of_ids_with_several_texts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(12):
        a, b = prose(rng, 120), prose(rng, 120)
        near = [*b]
        near[60] = "changed"
        rows += [(100 + k, " ".join(a)), (100 + k, " ".join(b)), (10 + k, " ".join(near))]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()
    for r in got:
        assert r["component_id"] == (r["doc_id"] - 90 if r["doc_id"] >= 100 else r["doc_id"])


def test_ngram_join_of_long_documents_and_many_copies(spark):
    rng = random.Random(5)
    long = prose(rng, 3000, 100000)
    rows = [(k, " ".join(["x"] * (k % 2) + long[:1500] + [f"v{k}"] + long[1500:])) for k in range(12)]
    rows += [(100 + k, " ".join(prose(rng, 2500, 100000) + long[:50])) for k in range(6)]
    rows += [(1000 + k, "one text in very many copies of it all") for k in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()}
    assert all(got[k] == 0 for k in range(12)) and all(got[100 + k] == 100 + k for k in range(6)) and all(got[1000 + k] == 1000 for k in range(300))


def test_blocks_of_one_entry_are_all_compared(spark, monkeypatch):
    """Members of one entry that no hub connects: two families that share a passage, in blocks of two."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        base = prose(rng, 60, 5000)
        texts += [" ".join([*base[:k], "new", *base[k:]]) for k in (0, 30, 60)]
    rows = list(enumerate(texts))
    sets = [ngram_join.element_set(t, 3) for t in texts]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = part[i], part[j]
                part = [min(old, new) if p in (old, new) else p for p in part]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()}
    assert got == dict(enumerate(part))


def test_line_dedup_of_variants_and_long_lines(spark, monkeypatch):
    """More candidates than are verified at once, and a line of many words."""
    monkeypatch.setattr(line_dedup, "FEW", 2)
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    rng = random.Random(6)
    base = prose(rng, 20, 60)
    lines = []
    for _ in range(60):
        own = [*base]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(20)] = f"w{rng.randrange(60)}"
        lines.append(" ".join(own))
    big = " ".join(f"x{k}" for k in range(3000))
    lines += [big, big + " more", "", "short", "short"]
    docs = spark.createDataFrame([(k // 2, f"{x}\n{k}", "extra") for k, x in enumerate(lines)], "doc_id long, text string, stays string")
    flat = sorted(((d, hash_, n), line_dedup.line_set(x)) for d, t, _, hash_ in docs.select("*", F.xxhash64("text")).collect() for n, x in enumerate(t.split("\n")) if line_dedup.line_set(x))
    want = {k for at, (k, s) in enumerate(flat) if any(100 * len(s & t) >= 80 * len(s | t) for _, t in flat[:at])}
    assert {(r["did"], r["th"], r["line_no"]) for r in line_dedup.later_lines(docs, min_words=1).collect()} == want
    assert {r["stays"] for r in line_dedup.dedup_lines(docs, min_words=1).collect()} == {"extra"}


def test_guess_cost_of_very_long_values_is_linear():
    began = time.perf_counter()
    assert secrets.guess_cost("a" * 200_000) < 10 and secrets.guess_cost("abcdefgh" * 20_000) < 20
    assert len(secrets.scan("password = " + "x9$K!mQ2zz@L" * 10_000)) == 1
    assert len(secrets.scan("token: abcdef1\n" * 5000)) == 5000
    assert time.perf_counter() - began < 30


def test_fits_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(k, " ".join((["good"] if k % 2 else ["bad"]) * 3 + prose(rng, 30)), k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    for module, label in ((quality_model, "quality"), (toxicity, "toxic")):
        labels = docs.select("doc_id", F.col("y").alias(label))
        scores = []
        for parts in (1, 5):
            dealt = docs.select("doc_id", "text").repartition(parts)
            model = module.fit(dealt, labels)
            scores.append({r["doc_id"]: r["score"] for r in module.score_documents(docs.select("doc_id", "text"), model).collect()})
        assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-6


def test_top_k_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none, k=3).count() == 0 and np.isfinite(1.0)


def test_quality_contexts_cover_all_documents(spark):
    s = quality_model.Settings(slots=64, width=12, nonzero=3)
    texts = ["alpha beta gamma alpha beta", "beta gamma", "", None, "alone", "delta " * 300, "alpha beta gamma alpha beta"]
    want = np.zeros((s.slots, s.width))
    for t in texts:
        for hashes, _ in quality_model.term_hashes(pa.array([t], pa.string()))[:2]:
            places, signs = quality_model.index_places(hashes, s)
            for i in range(len(hashes)):
                for j in range(max(0, i - s.window), min(len(hashes), i + s.window + 1)):
                    if i != j:
                        np.add.at(want[int(hashes[i] % np.uint64(s.slots))], places[j], signs[j])
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(length > 0, length, 1)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one, many = (quality_model.contexts(df.repartition(n), settings=s) for n in (1, 5))
    assert np.array_equal(one, many) and np.allclose(one, want, atol=1e-6)
    assert not quality_model.contexts(df.limit(0), settings=s).any()
    # A text's vector is the mean of its terms' index vectors and contexts, whatever else is in its batch.
    model = quality_model.QualityModel(s, one, (), 1.0)
    column = pa.array(texts, pa.string())
    for t, got in zip(texts, model.pooled(column), strict=True):
        hashes = np.concatenate([h for h, _ in quality_model.term_hashes(pa.array([t], pa.string()))])
        total = np.zeros(s.width)
        places, signs = quality_model.index_places(hashes, s)
        for h, p, g in zip(hashes, places, signs, strict=True):
            np.add.at(total, p, g / np.sqrt(s.nonzero))
            total += one[int(h % np.uint64(s.slots))]
        assert np.allclose(got, total / max(1, len(hashes)), atol=1e-5)


def test_quality_pooling_in_blocks(monkeypatch):
    s = quality_model.Settings(slots=64, width=12)
    model = quality_model.QualityModel(s, np.random.default_rng(0).normal(size=(64, 12)).astype(np.float32), (), 1.0)
    column = pa.array([f"w{i % 7} w{i % 11} w{i}" for i in range(200)] + [" ".join(f"x{i}" for i in range(500)), None])
    whole = model.pooled(column)
    monkeypatch.setattr(quality_model, "PAIRS", 37)
    assert np.allclose(model.pooled(column), whole, atol=1e-5)


def test_words_of_adjoining_texts(monkeypatch):
    """Words end where their text ends, with or without a separator there; counts are added up once for many pieces of text."""
    import re

    import numpy as np
    import pyarrow as pa

    from rulemark.llm import textbatch as tb

    for texts in (["ab", "cd", "", "", "e f", " g", "h ", "", "ij\tk"], ["", ""], ["a"], [" "], ["", "é è", "x"], []):
        data, offsets = tb.buffers(pa.array(texts, pa.string()))
        s, e, of = tb.words(data, offsets)
        assert [(int(t), data[a:b].tobytes().decode()) for a, b, t in zip(s, e, of, strict=True)] == [(t, w) for t, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]

    class Rows:
        work = None

        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            self.work = self.work or work
            return self

        def repartition(self, _):
            return self

        def collect(self):
            return []

    rows, calls, bincount = Rows(), [], np.bincount
    line_dedup._levels(rows)
    monkeypatch.setattr(line_dedup.np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "b c"])], names=["text"])
    out = list(rows.work(iter([batch] * 5)))
    assert len(calls) == 1 and sum(int(np.frombuffer(x, np.int64).sum()) for b in out for x in b.column("n").to_pylist()) == 20
