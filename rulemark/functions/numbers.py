"""Numbers as a reader sees them in a policy text, and whether a value stands there.

A text is cut into runs of letters, digits and inner points; a short look at the
neighbours of each run decides what it is. Not numbers: digits inside identifiers
("35d-1", "N-14"), the parts of word fractions that are not understood
("two-thirds"), and "one" where it is a pronoun ("any one issuer").
"""

from __future__ import annotations

import math
import re

# Number words and denominators that are understood.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DENOMINATORS = {
    2: ("half", "halves"), 3: ("third", "thirds"), 4: ("quarter", "quarters", "fourth", "fourths"), 5: ("fifth", "fifths"), 6: ("sixth", "sixths"),
    7: ("seventh", "sevenths"), 8: ("eighth", "eighths"), 9: ("ninth", "ninths"), 10: ("tenth", "tenths"),
}
# Words after which, or before which, "one" is a pronoun; the largest denominator of a written fraction.
PRONOUN_AFTER = {"any", "each", "every", "no", "the", "this", "that", "which", "per"}
PRONOUN_BEFORE = {"of", "or", "another"}
LARGEST_DENOMINATOR = 20

_VALUE = {word: value for value, word in enumerate(SMALL)} | {word: 10 * k for k, word in enumerate(TENS, 2)}
_UNIT = {word: value for value, word in enumerate(SMALL[1:10], 1)}
_PART = {word: d for d, words in DENOMINATORS.items() for word in words}
_RUN = re.compile(r"(?:\w|[.,](?=\d))+")
_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?\Z|\d*(?:\.\d+)?\Z")
#: Words that make the number before them a percentage, alone or as two.
_HUNDREDTHS = {"percent", "percentage"}

#: A number of a text: all values that it may be read as, what is written first.
Readings = tuple[float, ...]


def _proper(n: int, d: int) -> bool:
    return 0 < n < d <= LARGEST_DENOMINATOR


class _Reader:
    """A text as runs and the gaps around them: gap k lies before run k, the last one after all."""

    def __init__(self, text: str):
        found = list(_RUN.finditer(text))
        self.runs = [m[0] for m in found]
        edges = [0, *(x for m in found for x in m.span()), len(text)]
        self.gaps = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]

    def word(self, k: int) -> str:
        return self.runs[k].lower() if 0 <= k < len(self.runs) else ""

    def between(self, k: int) -> str:
        """What stands between run k and the next, or the text's end."""
        return self.gaps[k + 1]

    def follows(self, k: int) -> str:
        """The next run's word, where only blanks and hyphens lie between."""
        gap = self.between(k)
        return self.word(k + 1) if gap and not gap.strip("- \t\n\r\f\v\xa0") else ""

    def percent(self, last: int) -> bool:
        """Whether run ``last`` is followed by a percent sign or word, perhaps after a closing bracket."""
        gap = self.between(last).strip().removeprefix(")").lstrip()
        if gap:
            return gap.startswith("%")
        return self.word(last + 1) in _HUNDREDTHS or (self.word(last + 1) == "per" and self.word(last + 2) == "cent" and not self.between(last + 1).strip())

    def seen(self, value: float, last: int, fraction: bool = False) -> Readings:
        """A percentage is also its share, a written fraction also its percentage."""
        return (value, *[value / 100] * self.percent(last), *[value * 100] * fraction)

    def plain(self, k: int, digits: int) -> bool:
        run = self.runs[k]
        return run.isascii() and run.isdigit() and len(run) <= digits

    def slashed(self, k: int, digits: int) -> bool:
        """Whether runs k and k + 1 are whole numbers parted by a slash alone, with no third."""
        return k + 1 < len(self.runs) and self.plain(k, digits) and self.between(k) == "/" and self.plain(k + 1, digits) and not self.between(k + 1).startswith("/")

    def read(self) -> list[Readings]:
        out: list[Readings] = []
        k = 0
        while k < len(self.runs):
            found, used = self.at(k)
            out += found
            k += used
        return out

    def at(self, k: int) -> tuple[list[Readings], int]:
        """The numbers that begin at run k, and how many runs they take."""
        run, begins = self.runs[k], not self.gaps[k].endswith("/")
        if begins and self.plain(k, 99) and self.slashed(k + 1, 2) and len(self.between(k)) == 1 and self.follows(k):
            whole, n, d = (int(self.runs[k + i]) for i in range(3))
            if _proper(n, d):
                return [self.seen(whole + n / d, k + 2)], 3
            return [(float(whole),), (float(n),), self.seen(float(d), k + 2)], 3
        if begins and self.slashed(k, 3):
            n, d = int(run), int(self.runs[k + 1])
            if _proper(n, d):
                return [self.seen(n / d, k + 1, fraction=True)], 2
            return [(float(n),), self.seen(float(d), k + 1)], 2
        if run[0].isdigit() or run[0] in ".,":
            return self.digits(k), 1
        return self.words(k)

    def identifier(self, k: int) -> bool:
        """Whether a run of digits is hyphened to a letter before it or a capital after it, as in N-14 and 10-K."""
        after = self.runs[k + 1][:1] if k + 1 < len(self.runs) and self.between(k) == "-" else ""
        before = self.runs[k - 1][-1:] if k and self.gaps[k] == "-" else ""
        return before.isalpha() or after.isupper()

    def digits(self, k: int) -> list[Readings]:
        run = self.runs[k]
        parts = [run] if _GROUPED.match(run) else run.split(",")
        if self.identifier(k) or not all(_GROUPED.match(p) and p for p in parts):
            return []
        return [self.seen(float(p.replace(",", "")), k) if p is parts[-1] else (float(p),) for p in parts]

    def words(self, k: int) -> tuple[list[Readings], int]:
        word, after = self.word(k), self.follows(k)
        if word in _UNIT and after in _PART:
            # Only one over a denominator, and three quarters, are read; others are passed over whole.
            n, d = _UNIT[word], _PART[after]
            return ([self.seen(n / d, k + 1, fraction=True)] if n == 1 or (n, d) == (3, 4) else []), 2
        if word in _UNIT and after == "hundred":
            return [self.seen(100.0 * _UNIT[word], k + 1)], 2
        if word == "hundred":
            return [self.seen(100.0, k)], 1
        if word in TENS and after in _UNIT:
            return [self.seen(float(_VALUE[word] + _UNIT[after]), k + 1)], 2
        if word in _VALUE and not (word == "one" and self.pronoun(k)):
            return [self.seen(float(_VALUE[word]), k)], 1
        return [], 1

    def pronoun(self, k: int) -> bool:
        """Whether a "one" stands for a thing: joined by a hyphen, after a word like "any" or before one like "of"."""
        hyphened = self.gaps[k].endswith("-") or self.between(k).startswith("-")
        return hyphened or self.word(k - 1) in PRONOUN_AFTER or (self.between(k).isspace() and self.word(k + 1) in PRONOUN_BEFORE)


def read_numbers(text: str | None) -> list[Readings]:
    return _Reader(text or "").read()


def numbers_in(text: str | None) -> list[float]:
    """The numbers of a text in order: digits, percentages as written, number words, and fractions by their value."""
    return [readings[0] for readings in read_numbers(text)]


def number_appears(value: float, text: str | None) -> bool:
    """Whether a value stands in a text as it is, as a percentage for its share, or as a fraction for its percentage."""
    return any(math.isclose(value, v, rel_tol=1e-9) for readings in read_numbers(text) for v in readings)
