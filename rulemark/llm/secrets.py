"""Finds secrets: fixed patterns, and values that would take many guesses.

Base patterns find assignments, access keys and hexadecimal strings. Beyond
them, every value standing in a credential context (``password: ...``,
``client_secret=...``, ``dbPassword = ...``: an identifier one of whose parts is
or ends in a credential word, so not ``author`` or ``tokenizer``; tags
``<password>``; in prose "the password is ...", for values of mixed characters) is priced: a dynamic program splits it into dictionary
words, dates, repeats, keyboard walks and brute-force characters at the lowest
total cost, the decimal logarithm of the guesses an attacker needs. Values that
cost ``threshold`` or more and lie in no base span are reported as ``guess``.

Defined results: null and empty texts have no spans; offsets are code points,
the end exclusive; rows are scanned one by one and whole, so repeated rows give
equal spans; other columns come back unchanged.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulemark.llm.frames import fresh

# The base patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")

#: A credential context: a name and a separator. A name starts only where no other goes on, so a text is read once.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]+)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:(?:basic|bearer)[\x20\t]+)?["']?""", re.IGNORECASE | re.ASCII)
#: A name's parts: runs of capitals, words with a capital in front, runs of small letters; digits and joints part them.
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Parts that make a name a credential's, whole or at the end of a part (DBPASSWORD, authtoken), never at its beginning (tokenizer, secretary).
CREDENTIALS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "credentials", "apikey")
#: Parts that do so before a part ``key``.
KEYS = ("api", "access", "private", "client", "auth", "secret")
#: In prose and in tags: "the password is ...", "<password>...</password>".
SPOKEN = re.compile(r"""\b(?:password|passwd|passphrase|passcode|secret|token)[\x20\t]+is:?[\x20\t]+["']?""", re.IGNORECASE | re.ASCII)
TAGGED = re.compile(r"<([A-Za-z0-9_\-]+)>[\x20\t]*", re.ASCII)


def is_credential(name: str) -> bool:
    """Whether an identifier names a credential by one of its parts."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return any(p.endswith(CREDENTIALS) for p in parts) or any(a in KEYS and b == "key" for a, b in zip(parts, parts[1:], strict=False))


def _mixed(value: str) -> bool:
    """Whether a value is not just a word or number of prose."""
    return sum((any(c.islower() for c in value), any(c.isupper() for c in value[1:]), any(c.isdigit() for c in value), any(not c.isalnum() for c in value))) > 1


#: Its value: up to a blank, quote or bracket.
VALUE = re.compile(r"[!#-&(-;=?-~]{6,}")
CONTEXT_HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "key")

# Words that attackers try first, commonest first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "secret", "master", "letmein", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "michael", "jordan", "hunter", "ranger", "soccer", "hockey", "killer", "george",
    "charlie", "andrew", "daniel", "thomas", "joshua", "robert", "summer", "winter", "spring", "autumn", "orange", "purple", "yellow",
    "silver", "golden", "cookie", "cheese", "pepper", "ginger", "flower", "banana", "matrix", "computer", "internet", "server",
    "database", "default", "changeme", "example", "sample", "test", "guest", "root", "user", "demo", "temp", "pass", "word", "love",
    "hello", "world", "home", "work", "house", "happy", "lucky", "money", "power", "magic", "star", "blue", "green", "black", "white",
    "red", "dog", "cat", "fish", "bird", "horse", "tiger", "eagle", "apple", "music", "guitar", "london", "paris", "berlin", "china",
    "america", "europe", "company", "office", "system", "network", "security", "private", "public", "token", "access", "key", "api",
    "client", "service", "value", "string", "none", "null", "true", "false", "your", "here", "insert", "replace", "placeholder",
    "correct", "battery", "staple", "january", "february", "march", "april", "june", "july", "august", "september", "october",
    "november", "december", "monday", "tuesday", "friday", "sunday", "this", "that", "with", "from", "have", "what", "when", "the",
    "and", "for", "not", "you", "are", "was", "his", "her", "all", "one", "two", "three",
)
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_WORD_COST = {w: math.log10(k + 2) for k, w in enumerate(COMMON_WORDS)}
_LONGEST = max(map(len, COMMON_WORDS))
_LEET = str.maketrans("@430157$!", "aaeoistsi")
_AT = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:[0-2]?\d|3[01])|(?:[0-2]?\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)")
_DATE_COST = math.log10(366 * 120)
_YEAR_COST = math.log10(120)
#: Longest block that is looked for repeated, and what one more part of a split costs.
REPEAT_BLOCK = 8
PART_COST = 0.3


def _near(a: str, b: str) -> bool:
    """Whether two keys are neighbours, or letters or digits in sequence."""
    if abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum():
        return True
    x, y = _AT.get(a), _AT.get(b)
    return x is not None and y is not None and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.islower() or c.isupper() else math.log10(33) if c.isascii() else 4.0


def guess_cost(value: str) -> float:
    """log10 of the guesses for ``value``: the cheapest split into known patterns."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    walk_from = list(range(n))  # where the keyboard walk ending here begins, and its turns
    turns = [0] * n
    for k in range(1, n):
        if _near(low[k - 1], low[k]):
            walk_from[k] = walk_from[k - 1]
            step, before = ord(low[k]) - ord(low[k - 1]), ord(low[k - 1]) - ord(low[k - 2]) if k - walk_from[k] >= 2 else None
            turns[k] = turns[k - 1] + (before is not None and step != before and abs(step) > 1)
    each = [_brute(c) for c in value]
    brute = [0.0, *itertools.accumulate(each)]
    # From each place, how many characters on equal those so many places later.
    again = {size: [0] * (n + 1) for size in range(1, REPEAT_BLOCK + 1)}
    for size, run in again.items():
        for k in range(n - size - 1, -1, -1):
            run[k] = run[k + 1] + 1 if value[k] == value[k + size] else 0
    for i in range(n):
        end = i + 1
        cost = best[i] + each[i]
        if cost < best[end]:
            best[end] = cost
        base = best[i] + PART_COST * (i > 0)
        for to in range(i + 2, min(n, i + _LONGEST) + 1):  # words, with capitals and look-alike characters
            part = _WORD_COST.get(plain[i:to])
            if part is not None:
                part += 0.3 * (low[i:to] != value[i:to]) + 0.3 * (plain[i:to] != low[i:to])
                best[to] = min(best[to], base + part)
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            best[m.end()] = min(best[m.end()], base + (_YEAR_COST if m.end() - i == 4 else _DATE_COST))
        for size in range(1, min(REPEAT_BLOCK, (n - i) // 2) + 1):  # a block, repeated as often as it is
            times = again[size][i] // size + 1
            if times > 1 and times * size >= 3:
                to = i + times * size
                best[to] = min(best[to], base + brute[i + size] - brute[i] + math.log10(times))
        # Keyboard walks and sequences of three keys or more that end here.
        start = walk_from[i]
        if i - start >= 2:
            part = math.log10(47) + math.log10(i - start + 1) + turns[i] * math.log10(4)
            best[end] = min(best[end], best[start] + PART_COST * (start > 0) + part)
    return best[n]


def scan(text: str | None, threshold: float = 10.0) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of a text's secrets, by start, then kind."""
    if not text:
        return []
    spans: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                spans.append(("assign", m.start(), m.end(), guess_cost(m[2])))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = sorted((a, b) for _, a, b, _ in spans)
        begins, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
        to = 0  # where the last value's run ends: one that begins within it is a part of it
        contexts = [(m.start(), m.end(), False) for m in CONTEXT.finditer(text) if is_credential(m[1])]
        contexts += [(m.start(), m.end(), False) for m in TAGGED.finditer(text) if is_credential(m[1])]
        contexts += [(m.start(), m.end(), True) for m in SPOKEN.finditer(text)]
        for _, end, spoken in sorted(contexts):
            if end < to or not (v := VALUE.match(text, end)):
                continue
            a, to = v.span()
            b = a + len(v[0].rstrip(".,;:)]}"))
            inside = (k := bisect.bisect_right(begins, a)) and reach[k - 1] >= b
            if b - a >= ASSIGN_LENGTH and not inside and (not spoken or _mixed(text[a:b])) and (cost := guess_cost(text[a:b])) >= threshold:
                spans.append(("guess", a, b, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", threshold: float = 10.0, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with an array of spans: kind, start, end, log10_guesses."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    (out,) = fresh(docs, out)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("log10_guesses", T.DoubleType())])
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in scan(t, threshold)] for t in batch.column(text).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, arrow)], names=[*keep, out])

    return source.mapInArrow(work, schema)
