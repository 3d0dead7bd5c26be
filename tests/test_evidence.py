"""Rules against the passages that they cite."""

from __future__ import annotations

from rulemark.operators import evidence

RULES = "rule_id int, doc_id int, kind string, quote string, values array<double>, note string"


def test_rules_are_grounded_in_their_own_document(spark):
    docs = spark.createDataFrame([(1, "The fund holds “at least 80%” in equities; one-quarter may be cash."), (2, None), (3, "At least 70% in bonds. At least 70% in bonds.")], "doc_id int, text string")
    rules = [
        (1, 1, "bound", 'holds "AT LEAST 80%"', [0.8], "x"), (2, 1, "bound", "one-quarter may be cash", [25.0, 26.0], "x"), (3, 1, "unmapped", "in equities", [], "x"), (4, 1, "bound", "at least 70% in bonds", [70.0], "x"),
        (5, 2, "bound", "anything", [1.0], "x"), (6, 9, "bound", "anything", None, "x"), (7, 3, "bound", "at least 70%", [0.7, None], "x"), (8, 3, "bound", None, [1.0], "x"), (9, None, "bound", "", [], None), (1, 1, "bound", 'holds "AT LEAST 80%"', [0.8], "x"),
    ]
    got = [r.asDict() for r in evidence.constraints(spark.createDataFrame(rules, RULES), docs).orderBy("rule_id").collect()]
    by = {r["rule_id"]: r for r in got}
    assert len(got) == len(rules)
    assert by[1]["evidence"] == "holds “at least 80%”" and (by[1]["char_start"], by[1]["status"], by[1]["compiles"]) == (9, "disclosed", True)
    assert (by[2]["ungrounded"], by[2]["status"], by[2]["compiles"], by[2]["why"]) == ([26.0], "unknown", False, "not in the quote: 26.000000")
    assert (by[3]["status"], by[3]["compiles"]) == ("disclosed", False)
    assert {by[k]["why"] for k in (4, 5, 6, 8, 9)} == {"quote not found"} and by[9]["evidence"] is None
    assert (by[7]["occurrences"], by[7]["status"], by[7]["modality"]) == (2, "disclosed", "hard")
