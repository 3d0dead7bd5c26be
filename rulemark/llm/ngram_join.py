"""Exact Jaccard self-join on word n-grams by partitioned universes.

Documents with the same set of n-grams form one class first, told by 128 bits of
the sorted elements. Between classes the pigeonhole principle finds candidates:
sets within one size band whose Jaccard similarity reaches the threshold differ
in at most H elements, so when all possible elements are hashed into H + 1
segments, at least one segment of both sets is equal. A set that can differ from
its own partners in fewer elements uses as many segments less, from the last
back, so that any two partners use enough of the same. A set is indexed by its
segments' contents in its size band, and in the next if a partner may lie there.
Empty segments would match far too much, so they are left out, and so is the empty
neighbour of one element. They are paid for by reserved segments that are indexed
with all their one-deletion neighbours, each of which proves a second difference
where it does not match: an empty segment takes one proof away, an empty reserved
one two, a reserved one of one element one. How many to reserve is the cheaper of
their entries and of the matches that sets with still more empty segments would
make (``reserve``). Sets that lose more proofs than are reserved index their empty
segments as well, so no pair is lost. Candidates are verified on the n-grams.

Copies in a group share many entries. Instead of all pairs in an entry, each
member is compared with one hub, the most alike of its hubs first; only members
of one entry that are then still of different components are compared with each
other, in blocks. That gives every connection between different texts without
listing all pairs. Before any text is read, pairs must pass the size filter and
a bound from parity sketches: a bit tells whether an odd number of elements fell
on it, so every bit that differs stands for one element at least not shared.

Defined results: null, empty and word-less texts have the empty set and are
linked with nothing; texts of fewer than n words hold their whole sequence as
one element; rows with one id count as one document, whatever texts they have;
rows without an id take no part in linking and get a null component.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.llm import textbatch as tb
from rulemark.llm.components import components
from rulemark.llm.frames import Store, cut, fresh, sweep

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows (of four numbers) up to which the list of wanted texts is broadcast.
SENT_ROWS = 1 << 18
#: Members of an entry in one block, where many are still to be compared with each other.
BLOCK = 256
#: Classes that a task remembers, to tell the entries of copies once.
SEEN = 100_000
#: 64-bit words of a set's short parity sketch.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]


def element_set(text: str | None, n: int = 3) -> set:
    """The n-grams of a text, exactly."""
    w = _WORDS.findall((text or "").translate(_LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(n)), strict=False))


@dataclass(frozen=True)
class Bands:
    """Size bands for a threshold of ``percent`` / 100."""

    percent: int
    #: Sets a band may hold, for weighing entries against matches.
    expected: float = 1e9
    #: A band spans this power of 1 / threshold.
    width: int = 2

    @lru_cache(maxsize=None)  # noqa: B019  one small object lives as long as its worker
    def starts(self) -> np.ndarray:
        out = [1]
        while out[-1] < 1 << 40:
            start = out[-1]
            for _ in range(self.width):
                start = start * 100 // self.percent + 1
            out.append(start)
        return np.array(out, np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts(), size, "right")) - 1

    def apart(self, total: int) -> int:
        """The most elements that two matching sets of ``total`` elements together do not share."""
        return total * (100 - self.percent) // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int]:
        """(segments, reserved ones) of a band; one segment means equal sets only."""
        low, high = int(self.starts()[band]), int(self.starts()[band + 1]) - 1
        m = self.apart(2 * high) + 1
        return m, self.reserve(low, m) if m > 1 else 0

    def used(self, size: int, band: int) -> int:
        """How many segments, from the last, a set of this size needs in a band's plan: more than any partner can break."""
        high = int(self.starts()[band + 1]) - 1
        return min(self.plan(band)[0], self.apart(size + min(size * 100 // self.percent, high)) + 1)

    def reserve(self, size: int, m: int) -> int:
        """Reserved segments at the lowest cost: their neighbours' entries, or matches of sets short of them."""
        mean = min(m, self.apart(size + size * 100 // self.percent) + 1) * math.exp(-size / m)
        # Empty segments follow about a Poisson law; a reserved one costs two if empty, one if it has one element.
        rate = size / m
        cost = (2 + rate) * math.exp(-rate)
        best, least = 0, math.inf
        for r in range(m + 1):
            chance = _above(r, mean + r * cost)
            now = self.expected * r * rate + 100 * (self.expected * chance) ** 2 / m
            if now < least:
                best, least = r, now
            if chance < 1e-12:
                break
        return best


def _above(r: int, mean: float) -> float:
    """The chance that a Poisson variable of this mean exceeds r."""
    if mean <= 0:
        return 0.0
    if mean > 200:
        return math.erfc((r + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    return max(0.0, 1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(r + 1)))


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Index entries (64-bit) of a set of hashed elements."""
    size = len(elements)
    own, out = bands.of(size), []
    # A larger partner may lie in the next band.
    for band in (own, own + 1) if size * 100 // bands.percent >= bands.starts()[own + 1] else (own,):
        m, reserved = bands.plan(band)
        if m < 2:
            continue
        v = tb.mix(elements + np.uint64(band * 0x9E3779B1 + 1))
        segment = ((v >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        content = tb.mix(v ^ np.uint64(0xA5A5A5A55A5A5A5A))
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, content)
        count = np.bincount(segment, minlength=m)
        tag = np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32)
        first, held = m - bands.used(size, band), m - reserved
        # What empty segments cost of the differences that unmatched segments prove: see the module's text.
        own = count[max(held, first) :]
        emit = count > 0
        complete = (~emit[first:held]).sum() + 2 * (own == 0).sum() + (own == 1).sum() > reserved
        if complete:
            emit[:] = True
        emit[:first] = False
        out.append(tb.mix(tb.mix(total[emit]) + tag[emit] * np.uint64(0x9E3779B97F4A7C15)))
        near = np.flatnonzero((segment >= max(held, first)) & ((count[segment] > 1) | complete))
        if len(near):
            s = segment[near]
            out.append(tb.mix(tb.mix(total[s] - content[near]) + tag[s] * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(elements: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of the elements on each of 64 * words bits; words is a power of two, and a longer sketch folds to a shorter one."""
    slots = (tb.mix(elements ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * words) & 1, bitorder="little").view(np.int64)


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """For a set with more elements than the short sketch has bits: parities on as many bits as elements, or more."""
    if len(elements) <= 64 * SKETCH:
        return np.zeros(0, np.int64)
    return sketch(elements, 1 << (-(-len(elements) // 64) - 1).bit_length())


def _apart(a: str, b: str):
    """Bits that differ between the sketches of two struct columns: elements not shared, at least."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCHES), F.lit(0))


def _wide_apart(a: str, b: str):
    """The same of wide sketches; sets within the size filter have sketches of one length, or one has twice the other's."""
    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    size = F.least(F.size(x), F.size(y))
    folded = lambda c: F.when(F.size(c) > size, F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda u, v: u.bitwiseXOR(v))).otherwise(c)
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, n: t + n)


def near(a: str, b: str, percent: int):
    """Whether sets described by the struct columns a and b may reach the threshold."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = lambda apart: apart * (100 + percent) <= (x + y) * (100 - percent)
    short = F.least(F.size(f"{a}.wide"), F.size(f"{b}.wide")) == 0
    return (x * 100 >= y * percent) & (y * 100 >= x * percent) & fits(_apart(a, b)) & F.when(short, True).otherwise(fits(_wide_apart(a, b)))


def _hashed_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed elements of each text."""
    data, offsets = tb.buffers(column)
    data = tb.lower_ascii(data)
    starts, ends, text_of = tb.words(data, offsets)
    hashes = tb.word_hashes(data, starts, ends)
    grams, of = tb.windows(hashes, text_of, n)
    at = np.searchsorted(of, np.arange(len(offsets)))
    word_at = np.searchsorted(text_of, np.arange(len(offsets)))
    for k in range(len(offsets) - 1):
        if at[k] < at[k + 1]:
            yield np.unique(grams[at[k] : at[k + 1]])
        elif word_at[k] < word_at[k + 1]:
            value = np.uint64(0x5EED)
            for h in hashes[word_at[k] : word_at[k + 1]]:
                value = tb.mix(np.array([value + h], np.uint64))[0]
            yield np.array([value], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _class(elements: np.ndarray) -> tuple[int, int]:
    """A set's class: 128 bits of its sorted elements."""
    return struct.unpack("<qq", hashlib.blake2b(elements.tobytes(), digest_size=16).digest())


def _profiles(source: DataFrame, n: int) -> DataFrame:
    """(id, th, text) to (id, th, n_elements, class, sketch words); the class is null for the empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch):
                sets = list(_hashed_sets(part.column("text"), n))
                told = [_class(s) if len(s) else (None, None) for s in sets]
                words = np.array([sketch(s) for s in sets]).T
                wide = [wide_sketch(s) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(w) for w in wide])).astype(np.int32)), pa.array(np.concatenate(wide)))
                columns = [part.column("id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)), *(pa.array(w) for w in words), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n_elements", "k1", "k2", *SKETCHES, "wide"])

    return source.mapInArrow(work, f"id long, th long, n_elements long, k1 long, k2 long, {', '.join(f'{w} long' for w in SKETCHES)}, wide array<long>")


def _entries(source: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(entry, k1) of every class; a task tells a class it has just told no second time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in tb.pieces(batch):
                keys, entries = [], []
                for s in _hashed_sets(part.column("text"), n):
                    if not len(s) or (key := _class(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    keys.append(key[0])
                    entries.append(signatures(s, bands).view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries)), pa.array(np.repeat(np.array(keys, np.int64), [len(e) for e in entries]))], names=["entry", "k1"])

    return source.select("text").mapInArrow(work, "entry long, k1 long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes (k1) whose texts reach the threshold, as classes (a1, a2, b1, b2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if y != last:
                    last, held = y, element_set(y, n)
                s = element_set(x, n)
                both = len(s & held)
                if 100 * both >= percent * (len(s) + len(held) - both):
                    good.append(k)
            yield batch.select(["a1", "a2", "b1", "b2"]).take(pa.array(good, pa.int64()))

    one = texts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("text").alias("x"))
    two = texts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("text").alias("y"))
    both = pairs.join(one, F.col("a") == F.col("a1")).join(two, F.col("b") == F.col("b1"))
    return both.select("a1", "a2", "b1", "b2", "x", "y").mapInArrow(work, "a1 long, a2 long, b1 long, b2 long")


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(<doc_id>, n_shingles, component_id) of every row; see the module's text."""
    spark, bands = docs.sparkSession, Bands(percent)
    store = Store(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.select("id", F.xxhash64("text").alias("th"), "text")
    profiles = cut(_profiles(source, n))
    members = profiles.where(F.col("k1").isNotNull() & F.col("id").isNotNull())
    # One row a class: its smallest id, and a text of that id.
    heads = members.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("at"), *(F.first(c).alias(c) for c in ("n_elements", *SKETCHES, "wide")))
    heads = store.put(heads.select("k1", "k2", F.col("at.id").alias("rep"), F.col("at.th").alias("th"), F.struct(F.col("n_elements").alias("n"), *SKETCHES, "wide").alias("set")))
    shared = _entries(source.where("id IS NOT NULL"), n, bands)
    by = Window.partitionBy("entry")
    shared = shared.select("entry", "k1", F.min("k1").over(by).alias("hub"), F.max("k1").over(by).alias("last")).where("hub < last")
    # Entries of two classes or more, each with its smallest class for a hub.
    opened = store.put(shared.select("entry", "k1", "hub"))
    del shared
    sweep(spark)
    side = lambda k, c: heads.select(F.col("k1").alias(k), F.col("set").alias(c))
    bounded = lambda pairs: pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").where(near("x", "y", percent))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(k1, k2, text) of the classes of pairs (a, b), a row each."""
        nodes = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct()
        wanted = store.put(heads.join(nodes, "k1", "left_semi").select("k1", "k2", F.col("rep").alias("id"), "th"))
        # Few enough are sent to the texts; of more, each partition hashes its own, and no text is sorted.
        side = wanted.hint("broadcast" if wanted.count() <= SENT_ROWS else "shuffle_hash")
        found = source.join(side, ["id", "th"]).withColumn("turn", F.row_number().over(Window.partitionBy("id", "th", "k1", "k2").orderBy("id")))
        out = store.put(found.where("turn = 1").select("k1", "k2", "text"))
        sweep(spark)
        return out

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between the smallest ids of the classes of those pairs (a, b) whose texts match."""
        found = _verified(pairs.distinct(), texts, n, percent)
        own = lambda k: heads.select(F.col("k1").alias(f"{k}1"), F.col("k2").alias(f"{k}2"), F.col("rep").alias(k))
        out = store.put(found.join(own("a"), ["a1", "a2"]).join(own("b"), ["b1", "b2"]).select("a", "b"))
        sweep(spark)
        return out

    def parts(links: DataFrame) -> DataFrame:
        """(k1, part): the component of each class, told by its smallest id."""
        found = heads.select("k1", "rep").join(components(links), F.col("rep") == F.col("node"), "left")
        return found.groupBy("k1").agg(F.min(F.coalesce("component", "rep")).alias("part"))

    # Rows of one id are one document: its classes connect.
    links = members.join(heads.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    # Each class meets the most alike of its hubs first; that connects most of what is connected.
    pairs = store.put(bounded(opened.where("k1 <> hub").select(F.col("k1").alias("a"), F.col("hub").alias("b"))).select("a", "b", _apart("x", "y").alias("apart")))
    texts = texts_of(pairs)
    links = store.put(links.union(verified(pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), texts)))
    at = store.put(parts(links))
    part = lambda k, p: at.select(F.col("k1").alias(k), F.col("part").alias(p))
    split = pairs.join(part("a", "pa"), "a").join(part("b", "pb"), "b").where("pa <> pb").select("a", "b")
    links = store.put(links.union(verified(split, texts)))
    store.drop(pairs, at, texts)
    sweep(spark)
    # Every member has met its entry's hub; what is left are the other members of one entry, where they are of several components.
    at = store.put(parts(links))
    rest = opened.where("k1 <> hub").select("entry", "k1").distinct().join(at, "k1").join(heads.select("k1", "set"), "k1")
    state = rest.groupBy("entry").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum(F.xxhash64("k1").cast("decimal(38,0)")).alias("members"), F.count("*").alias("n"))
    # Entries of equal members count once; those of many members are compared in blocks, a pair of blocks a group.
    state = state.where("low < high").groupBy("members", "n").agg(F.min("entry").alias("entry"))
    rest = store.put(rest.join(state.select("entry", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "entry"))
    own = F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rest.select("entry", own.alias("i"), every.alias("j"), F.col("k1").alias("a"), F.col("part").alias("p"), F.col("set").alias("x"))
    two = rest.select("entry", every.alias("i"), own.alias("j"), F.col("k1").alias("b"), F.col("part").alias("q"), F.col("set").alias("y"))
    same = (one["entry"] == two["entry"]) & (one["i"] == two["i"]) & (one["j"] == two["j"])
    met = one.join(two, same & (F.col("p") != F.col("q")) & (F.col("a") > F.col("b")) & near("x", "y", percent)).select("a", "b")
    met = store.put(met.distinct())
    if not met.isEmpty():
        links = store.put(links.union(verified(met, texts_of(met))))
    store.drop(rest, at, opened)
    final = components(links)
    out = profiles.select("id", "n_elements", "k1", "k2").join(heads.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    out = out.join(final, F.col("rep") == F.col("node"), "left")
    (name,) = fresh(docs.select(doc_id), "n_shingles")
    return out.select(F.col("id").alias(doc_id), F.col("n_elements").alias(name), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """docs without those that are linked, over any way, to a document of a smaller id."""
    component, own = fresh(docs, "component_id", "own_id")
    linked = link_documents(docs, doc_id, text, n, percent).select(F.col(doc_id).alias(own), F.col("component_id").alias(component))
    goes = linked.where(F.col(own) > F.col(component)).select(own).distinct()
    return docs.join(goes, docs[doc_id].cast("long") == F.col(own), "left_anti")
