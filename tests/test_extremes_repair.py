"""Extremes and contradictions against enumeration, repair against a search of all moves."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rulemark.operators import extremes, repair
from rulemark.operators.extremes import Linear, Shape

SHAPE = Shape(units=7, k_min=2, k_max=4)


def instances(seed: int = 0, cases: int = 6, names: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(cases):
        for n in range(rng.randint(2, names)):
            low = rng.randint(1, 2)
            rows.append((c, f"n{n}", rng.randint(-9, 9), low, low + rng.randint(0, 3), rng.randint(-3, 3), rng.randint(0, 1), rng.choice([None, 3, 8])))
    return rows


FIELDS = "case int, name string, value long, low int, high int, a long, m long, cap long"


def points(rows):
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    for q in itertools.product(*([0, *range(r[3], r[4] + 1)] for r in rows)):
        if sum(q) == SHAPE.units and SHAPE.k_min <= sum(x > 0 for x in q) <= SHAPE.k_max:
            yield rows, list(q)


def obeys(rows, q, which=("sum", "members")):
    cap = rows[0][7]
    total, members = sum(r[5] * x for r, x in zip(rows, q, strict=True)), sum(r[6] * (x > 0) for r, x in zip(rows, q, strict=True))
    return ("sum" not in which or cap is None or total <= cap) and ("members" not in which or members >= 1)


def by_case(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {c: [(*r[:7], v[0][7]) for r in v] for c, v in out.items()}


def rules():
    return [Linear("sum", per_unit=F.col("a"), high=F.col("cap")), Linear("members", per_name=F.col("m"), low=1)]


@pytest.mark.parametrize("beam", [None, 2])
def test_extremes_match_enumeration(spark, beam):
    cases = by_case(instances())
    rows = [r for v in cases.values() for r in v] + [(90, "none", None, 1, 2, 0, 1, 5), (None, "x", 1, 1, 2, 0, 1, 5)]
    got = {r["case"]: r for r in extremes.extremes(spark.createDataFrame(rows, FIELDS), ["case"], rules(), SHAPE, beam=beam).collect()}
    assert set(got) == {*cases, 90} and not got[90]["feasible"]
    for c, mine in cases.items():
        fits = [(sum(r[2] * x for r, x in zip(o, q, strict=True)), q, o) for o, q in points(mine) if obeys(o, q)]
        assert got[c]["feasible"] == bool(fits), c
        if fits:
            for end, shown, best in (("lowest", "argmin", min(fits, key=lambda f: f[:2])), ("highest", "argmax", max(fits, key=lambda f: f[:2]))):
                assert got[c][end] == best[0]
                assert [(s["name"], s["units"]) for s in got[c][shown]] == sorted((r[1], x) for r, x in zip(best[2], best[1], strict=True) if x)


def test_diagnosis_matches_every_removal(spark):
    cases = by_case(instances(seed=4, cases=10))
    cases = {c: [(*r[:7], -4 if c % 2 else r[7]) for r in v] for c, v in cases.items()}
    df = spark.createDataFrame([r for v in cases.values() for r in v], FIELDS)
    got = {r["case"]: (r["feasible"], r["relief"]) for r in extremes.diagnose(df, ["case"], rules(), SHAPE).collect()}
    conflict = {r["case"]: r["conflict"] for r in extremes.contradiction(df, ["case"], rules(), SHAPE).collect()}
    for c, mine in cases.items():
        can = lambda which: any(obeys(o, q, which) for o, q in points(mine))  # noqa: B023, E731
        fine = can(("sum", "members"))
        relief = [] if fine else [n for n, left in (("members", ("sum",)), ("sum", ("members",))) if can(left)]
        assert got[c] == (fine, relief), c
        assert (c in conflict) == (not fine)
        if not fine:
            assert not can(tuple(conflict[c])) and all(can(tuple(x for x in conflict[c] if x != n)) for n in conflict[c])


def test_no_names_no_rules(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert extremes.extremes(empty, ["case"], [], SHAPE).count() == 0 and extremes.contradiction(empty, ["case"], rules(), SHAPE).count() == 0
    one = spark.createDataFrame([(1, "a", 5, 1, 7, 0, 1, None), (1, "b", 2, 1, 7, 0, 1, None)], FIELDS)
    r = extremes.extremes(one, ["case"], [], SHAPE).first()
    assert (r["lowest"], r["highest"]) == (2 * 6 + 5, 5 * 6 + 2)


# ------------------------------------------------------------------ repair

ASSETS = 30


def universe(seed=1):
    rng = random.Random(seed)
    return {a: (rng.choice("PEX"), rng.random() < 0.2, float(rng.randint(1, 9)), float(rng.randint(1, 99))) for a in range(ASSETS)}


def violation(names, u, k, scales):
    n = len(names)
    v = sum(u[a][1] for a in names) + (abs(n - k) / k if k else 0) + max(sum(u[a][0] == "P" for a in names) - 2, 0) / 2
    for i, bound, up, scale in ((2, 6.0, True, scales[0]), (3, 40.0, False, scales[1])):
        mean = sum(u[a][i] for a in names) / n if n else None
        v += 1 if mean is None else max(bound - mean if up else mean - bound, 0) / scale
    return round(v, 9)


def greedy(names, u, k, scales):
    names, steps = set(names), 0
    now = violation(names, u, k, scales)
    while now > 0:
        out, into = ([a for a in names], [a for a in u if a not in names])
        moves = []
        if k is None or len(names) == k:
            moves += [(o, i) for o in out for i in into]
        if k is None or len(names) < k:
            moves += [(None, i) for i in into]
        if k is None or len(names) > k:
            moves += [(o, None) for o in out]
        rank = lambda m: (violation(names - {m[0]} | ({m[1]} if m[1] is not None else set()), u, k, scales), (0,) if m[1] is None else (1, -u[m[1]][2], u[m[1]][3]), -1 if m[1] is None else m[1], -1 if m[0] is None else m[0])  # noqa: B023, E731
        best = min(moves, key=rank, default=None)
        if best is None or (not (k is not None and len(names) != k) and rank(best)[0] >= now):
            return None, steps
        names, now, steps = names - {best[0]} | ({best[1]} if best[1] is not None else set()), rank(best)[0], steps + 1
    return names, steps


@pytest.mark.parametrize("k", [5, None])
def test_repair_matches_a_search_of_all_moves(spark, k):
    u = universe()
    rng = random.Random(7)
    held = {s: rng.sample(range(ASSETS), rng.randint(1, 8)) for s in range(25)}
    assets = spark.createDataFrame([(a, *v) for a, v in u.items()], "asset_id long, sector string, ban boolean, esg double, carbon double")
    rules_ = repair.Rules(k=k, caps={"P": (F.col("sector") == "P", 2)}, banned=F.col("ban"), averages=(repair.Average("esg", 6.0), repair.Average("carbon", 40.0, at_least=False)))
    rows = spark.createDataFrame([(s, a) for s, names in held.items() for a in names], "sample_id long, asset_id long")
    names, report = repair.repair(rows, assets, rules_, samples=spark.range(26).withColumnRenamed("id", "sample_id"))
    got = {}
    for r in names.collect():
        got.setdefault(r["sample_id"], set()).add(r["asset_id"])
    told = {r["sample_id"]: r for r in report.collect()}
    scales = [max(v[i] for v in u.values()) - min(v[i] for v in u.values()) for i in (2, 3)]
    for s in range(26):
        want, steps = greedy(held.get(s, []), u, k, scales)
        assert told[s]["outcome"] == ("failed" if want is None else "repaired" if steps else "kept"), s
        assert got.get(s, set()) == (want if want is not None else set(held.get(s, []))), s
        assert want is None or told[s]["steps"] == steps


def test_skyband_keeps_what_few_dominate():
    import pandas as pd

    rng = random.Random(2)
    rows = [([float(rng.randint(0, 5)), float(rng.randint(0, 5))], a) for a in range(60)]
    frame = pd.DataFrame({"asset": [a for _, a in rows], "good": [g for g, _ in rows]})
    beats = lambda x, y: all(p >= q for p, q in zip(x[0], y[0], strict=True)) and (x[0] != y[0] or x[1] < y[1])
    for most in (0, 3):
        want = {r[1] for r in rows if sum(beats(o, r) for o in rows) <= most}
        got = set(repair._skyband(frame, most)["asset"])
        assert want <= got


def test_unknown_attributes_are_not_brought_in(spark):
    assets = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0), (4, 5.0)], "asset_id long, esg double")
    rules_ = repair.Rules(k=1, averages=(repair.Average("esg", 8.0),))
    names, report = repair.repair(spark.createDataFrame([(0, 2), (1, 1), (2, 77)], "sample_id long, asset_id long"), assets, rules_)
    assert {(r["sample_id"], r["asset_id"]) for r in names.collect()} == {(0, 3), (1, 3), (2, 3)}
    assert {r["outcome"] for r in report.collect()} == {"repaired"}
