"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words (ASCII case folded); lines of the same
set form one class, whose first line, by (document id, text hash, line number),
stands for it. Two classes match when the Jaccard similarity of their sets
reaches ``percent`` / 100. A line goes when an earlier line has its set or
matches it, whether that earlier line stays or not; so the result does not
depend on the order of work. A class is told by 128 bits: sums over its words of
two independent hashes of their bytes.

Words are put in order of rarity, by corpus counts in hash buckets (any one order
keeps the filters exact, the counts make the prefixes rare). Sets that match
share a word in the first n - ceil(t n) + 1: those prefixes are joined by word,
less the words that stand in one line only, with the length filter (lists sorted by
size), the positional filter and a bound from parity bitmaps. Wider bitmaps
follow, and pairs that pass are verified on the lines' own words.

A line varied in thousands of copies would make millions of pairs, though each
needs only one earlier match. So of a class's candidates in a word's list the most
alike are verified first; only classes that find no match there, and have further
candidates, look at all of them.

Lines too short to match any but their own set (fewer than four words at 80 %)
take no part in the joins: their class's first line stays, all later ones go, by
an aggregation by class alone.

The table of classes, a line of text each, is written in buckets of the class, so
lines of candidate pairs are found without moving it.

Defined results: null and empty texts have no lines; lines without a word stay,
and so do lines of fewer than ``min_words`` distinct words (the queries pass 1,
so that no line with a word is exempt); rows equal in id and text count as one
document; a null id comes after all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.llm import textbatch as tb
from rulemark.llm.frames import Store, buckets, cut, fresh, sweep

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Buckets of the rarity counts: a fixed size, a byte each where tasks use them.
BUCKETS = 1 << 22
#: Buckets of one block of counts that tasks send on.
BLOCK = 1 << 12
BLOCKS = BUCKETS // BLOCK
#: Classes that a task remembers, to tell repeated lines once.
SEEN = 100_000
#: Candidates of a class and a word that are all verified at once; of more, only the FIRST most alike, the others where none of these matches.
FEW = 8
FIRST = 2
#: Words up to which a filter by them is sent to tasks (4 bytes each); beyond, lists without an open class fall out where they are joined.
WORDS_SENT = 1 << 20
#: Pairs that are looked at in one numpy pass.
PAIRS = 1 << 20
#: 64-bit words of a line's wide parity bitmap.
WIDE = [f"b{k}" for k in range(4)]
LAST = (1 << 63) - 1
KEY = ("did", "th", "line_no")


def line_set(line: str) -> set[str]:
    return set(_WORDS.findall(line.translate(_LOWER)))


def _hashed(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Two hashes of every word of a batch, each word's line and text, and of each line its start, end and number in its text."""
    data, offsets = tb.buffers(column)
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    data = tb.lower_ascii(data)
    s, e, text_of = tb.words(data, offsets)
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(np.searchsorted(s, starts), len(s))))
    # A line's number: newlines between its text's start and its own.
    own = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(newline, starts, "left") - np.searchsorted(newline, offsets[np.minimum(own, len(offsets) - 2)], "left")
    return tb.word_hashes(data, s, e), tb.word_hashes(data, s, e, tb.OTHER_BASE), line, text_of, number


def _texts(column: pa.Array, wanted: np.ndarray) -> pa.Array:
    """The wanted ones of a batch's lines, without their newlines."""
    data, offsets = tb.buffers(column)
    starts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1])).astype(np.int64)
    lines = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data)))
    return pc.utf8_rtrim(lines.take(pa.array(wanted)), characters="\n").cast(pa.string())


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def _ordered(hashes: np.ndarray, line: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Positions of the distinct words of every line, rarest first, lines in order."""
    if not len(line):
        return np.zeros(0, np.int64)
    rank = level[_bucket(hashes)].astype(np.uint64)
    dense = np.cumsum(np.append(0, line[1:] != line[:-1]))
    key = (dense.astype(np.uint64) << np.uint64(40)) | (rank << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    by = np.argsort(key)
    tied = (key[by][1:] == key[by][:-1]) & (hashes[by][1:] != hashes[by][:-1])
    if tied.any() or dense[-1] >= 1 << 24:
        by = np.lexsort((hashes, hashes & np.uint64(0xFFFFFFFF), rank, dense))
    keep = np.ones(len(by), bool)
    keep[1:] = (hashes[by][1:] != hashes[by][:-1]) | (line[by][1:] != line[by][:-1])
    return by[keep]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(body).alias("th"), body.alias("text"))


def _levels(rows: DataFrame) -> np.ndarray:
    """Rarity of each hash bucket, a byte: four times the binary logarithm of how often its words stand in the corpus's lines."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for part in tb.pieces(batch):
                data, offsets = tb.buffers(part.column("text"))
                data = tb.lower_ascii(data)
                held.append(_bucket(tb.word_hashes(data, *tb.words(data, offsets)[:2])).astype(np.int32))
                if sum(map(len, held)) >= BUCKETS:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        for block in range(BLOCKS):
            own = total[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), own[at]))], names=["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        for block, total in held.items():
            # A bucket that is not told, or once, has one word at most.
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.floor(4 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()], pa.binary())], names=["block", "level"])

    counted = rows.select("text").mapInArrow(count, "block int, at binary, n binary").repartition("block")
    out = np.zeros(BUCKETS, np.uint8)
    for block, level in counted.mapInArrow(add, "block int, level binary").collect():  # BUCKETS bytes at most
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(level, np.uint8)
    return out


def _lines(rows: DataFrame, level: np.ndarray, percent: int, min_words: int) -> DataFrame:
    """Every line of min_words distinct words or more: class, key, size, bitmap, prefix (its first place and its words), the line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for part in tb.pieces(batch):
                first_hash, second, line, text_of, number = _hashed(part.column("text"))
                if not len(line):
                    continue
                by = _ordered(first_hash, line, level)
                word, other, line, text_of = first_hash[by], second[by], line[by], text_of[by]
                first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                size = np.diff(np.append(first, len(line)))
                told = [tb.mix(np.add.reduceat(tb.mix(h), first) + size.astype(np.uint64)).view(np.int64) for h in (word, other)]
                of = text_of[first]
                keys = (part.column("did").to_numpy()[of], part.column("th").to_numpy()[of], number[line[first]])
                ok = size >= min_words
                # A line goes on only where the task has told none of its class that comes before it.
                for k, (c, d, *key) in enumerate(zip(*(x.tolist() for x in (*told, *keys)), strict=True)):
                    if ok[k]:
                        if (known := seen.get((c, d))) is not None and known <= tuple(key):
                            ok[k] = False
                        else:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen[c, d] = tuple(key)
                if not ok.any():
                    continue
                slot = tb.mix(word + np.uint64(7)) >> np.uint64(56)
                bit = np.uint64(1) << (slot & np.uint64(63))
                bits = [np.bitwise_xor.reduceat(np.where(slot >> np.uint64(6) == np.uint64(k), bit, np.uint64(0)), first) for k in range(len(WIDE))]
                place = np.arange(len(line)) - np.repeat(first, size)
                # Words that stand in one line of the corpus come first and match nothing.
                alone = np.add.reduceat((level[_bucket(word)] == 0).astype(np.int64), first)
                prefix = size - (percent * size + 99) // 100 + 1
                skip = np.minimum(alone, prefix)
                inside = (place < np.repeat(prefix, size)) & (place >= np.repeat(skip, size)) & np.repeat(ok, size)
                tokens = (word[inside] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((prefix - skip)[ok])).astype(np.int32)), pa.array(tokens))
                columns = [*(pa.array(x[ok]) for x in (*told, *keys[:2])), pa.array(keys[2][ok].astype(np.int32)), pa.array(size[ok].astype(np.int32))]
                columns += [*(pa.array(x[ok].view(np.int64)) for x in bits), pa.array(skip[ok].astype(np.int32)), lists, _texts(part.column("text"), line[first][ok])]
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", *KEY, "n", *WIDE, "skip", "prefix", "line"])

    return rows.mapInArrow(work, f"c1 long, c2 long, did long, th long, line_no int, n int, {', '.join(f'{b} long' for b in WIDE)}, skip int, prefix array<int>, line string")


#: The columns of an index entry: word, class, document, size, place of the word in the line's order, parities on 64 bits or (q) on 128, whether its matches are looked for.
ENTRY = np.dtype([("word", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("open", "<i4"), ("c1", "<i8"), ("did", "<i8"), ("p", "<i8"), ("q", "<i8")])
#: Entries that a task sorts at a time before it sends them on, packed by parts.
FLUSH = 1 << 20
#: Lines of more words have parities on 128 bits.
LONG = 64


def _entries(near: DataFrame, parts: int, words: np.ndarray | None = None) -> DataFrame:
    """(part, packed): the index entries of classes (c1, did, n, WIDE, skip, prefix, open), of these words (sorted) if told, packed by ``parts`` parts of the words."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        if not len(rows):
            return
        part = (tb.mix(rows["word"].astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        rows, part = rows[by], part[by]
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        # Column after column, for they compress so.
        packed = [b"".join(chunk[name].tobytes() for name in ENTRY.names) for chunk in np.split(rows, start[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            c1, did, n, *wide, skip = (batch.column(k).to_numpy() for k in range(len(batch.columns) - 2))
            prefix, is_open = batch.column("prefix"), batch.column("open").to_numpy(zero_copy_only=False)
            count = pc.list_value_length(prefix).to_numpy().astype(np.int64)
            rows = np.empty(int(count.sum()), ENTRY)
            of = np.repeat(np.arange(len(count)), count)
            rows["word"] = prefix.flatten().to_numpy()
            rows["pos"] = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + skip[of]
            p, q = wide[0] ^ wide[2], wide[1] ^ wide[3]
            short = n <= LONG
            for name, column in (("n", n), ("open", is_open), ("c1", c1), ("did", did), ("p", np.where(short, p ^ q, p)), ("q", np.where(short, 0, q))):
                rows[name] = column[of]
            if words is not None:
                at = np.minimum(np.searchsorted(words, rows["word"]), len(words) - 1)
                rows = rows[words[at] == rows["word"]]
            held.append(rows)
            if sum(map(len, held)) >= FLUSH:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return near.select("c1", "did", "n", *WIDE, "skip", "prefix", "open").mapInArrow(work, "part int, packed binary")


def _unpacked(packed: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {name: [] for name in ENTRY.names}
    for blob in packed:
        size, at = len(blob) // ENTRY.itemsize, 0
        for name in ENTRY.names:
            out[name].append(np.frombuffer(blob, ENTRY[name], size, at))
            at += size * ENTRY[name].itemsize
    return {name: np.concatenate(x) for name, x in out.items()}


def _candidates(near: DataFrame, percent: int, some: bool, words: np.ndarray | None = None) -> DataFrame:
    """Pairs (a, b) of classes that share a word of their prefixes and pass the filters, b before a and a open.

    With ``some``, where a word has more than FEW for an a, only the FIRST most alike;
    ``more`` tells that a has others.
    """

    def passing(x: dict[str, np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of places in the arrays that pass the filters by size, by the place of the first common word and by parity bitmaps."""
        n, pos, p, q = x["n"].astype(np.int64), x["pos"].astype(np.int64), x["p"], x["q"]
        key = (group << 32) | n
        low = np.searchsorted(key, (group << 32) | (n * percent + 99) // 100)
        many = np.arange(len(n)) - low
        ends = np.cumsum(many)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            count = many[at:to]
            i = np.repeat(np.arange(at, to), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[at:to], count)
            total = n[i] + n[j]
            need = -(-total * percent // (100 + percent))
            fits = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            i, j, most = i[fits], j[fits], (total - 2 * need)[fits]
            by_p, by_q = p[i] ^ p[j], q[i] ^ q[j]
            both = np.minimum(n[i], n[j]) > LONG
            apart = np.where(both, np.bitwise_count(by_p).astype(np.int64) + np.bitwise_count(by_q), np.bitwise_count(by_p ^ by_q))
            fits = apart <= most
            yield i[fits], j[fits], apart[fits]
            at = to

    def pairs(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = _unpacked(packed)
        _, group = np.unique(x["word"], return_inverse=True)
        useful = (np.bincount(group) > 1) & (np.bincount(group, x["open"]) > 0)
        by = np.flatnonzero(useful[group])
        by = by[np.argsort((group[by] << 32) | x["n"][by])]
        x, group = {name: c[by] for name, c in x.items()}, group[by]
        c1, did, is_open = x["c1"], x["did"], x["open"] > 0
        for i, j, apart in passing(x, group):
            late, soon = did[i] >= did[j], did[i] <= did[j]
            a, b, apart = np.append(i[late], j[soon]), np.append(j[late], i[soon]), np.append(apart[late], apart[soon])
            good = (c1[a] != c1[b]) & is_open[a]
            a, b, apart = a[good], b[good], apart[good]
            more = np.zeros(len(a), bool)
            if some and len(a):
                by = np.lexsort((c1[b], apart, a))
                a, b = a[by], b[by]
                start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                size = np.diff(np.append(start, len(a)))
                kept = np.arange(len(a)) - np.repeat(start, size) < np.repeat(np.where(size > FEW, FIRST, size), size)
                a, b, more = a[kept], b[kept], np.repeat(size > FEW, size)[kept]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c1[a]), pa.array(c1[b]), pa.array(more)], names=["a", "b", "more"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield from pairs(held)
                    held = []
                last = part
                held.append(packed)
        if held:
            yield from pairs(held)

    parts = 4 * buckets(near.sparkSession)
    return _entries(near, parts, words).repartition("part").sortWithinPartitions("part").mapInArrow(work, "a long, b long, more boolean")


def _most_apart(x: Column, y: Column, percent: int) -> Column:
    """How many words two sets of these sizes may not share, at most, to match."""
    return x + y - 2 * F.ceil((x + y) * percent / (100 + percent))


def _words_of(line: str) -> Column:
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    return F.array_distinct(F.array_remove(F.split(F.translate(line, upper, lower), r"[\x20\x09-\x0D]+"), ""))


def _settled(store: Store, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of classes (c1), the later class (s1, s2) of each pair that matches."""
    pairs = store.put(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # The nodes of a bucket are a small part of its classes, so they are hashed and no text is sorted.
    lines = store.put(classes.join(nodes.hint("shuffle_hash"), F.col("c1") == F.col("node"), "left_semi").select("c1", "c2", F.struct(*KEY).alias("k"), "n", *WIDE, "line"))
    side = lambda c: lines.select(F.col("c1").alias(c), F.struct(*lines.columns).alias(f"x{c}"))
    apart = sum((F.bit_count(F.col(f"xa.{b}").bitwiseXOR(F.col(f"xb.{b}"))) for b in WIDE), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= _most_apart(F.col("xa.n"), F.col("xb.n"), percent))
    late = F.col("xa.k") > F.col("xb.k")
    later = F.when(late, F.struct("xa.c1", "xa.c2")).otherwise(F.struct("xb.c1", "xb.c2"))
    both = both.select(later["c1"].alias("s1"), later["c2"].alias("s2"), F.col("xa.line").alias("x"), F.col("xb.line").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if y != last:
                    last, held = y, line_set(y)
                own = line_set(x)
                shared = len(own & held)
                if shared * 100 >= percent * (len(own) + len(held) - shared):
                    good.append(k)
            yield batch.select(["s1", "s2"]).take(pa.array(good, pa.int64()))

    out = store.put(both.mapInArrow(work, "s1 long, s2 long").distinct())
    store.drop(pairs, lines)
    return out


def staying_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 5) -> DataFrame:
    """(did, th, stays): numbers of the lines of min_words distinct words or more that stay, for each document that has one."""
    spark = docs.sparkSession
    store = Store(spark)
    rows = _rows(docs, doc_id, text)
    lines = _lines(rows, _levels(rows), percent, min_words)
    first = Window.partitionBy("c1", "c2").orderBy(*KEY)
    dealt = lines.repartition(buckets(spark), "c1").withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    classes = store.put(dealt, by="c1")
    sweep(spark)
    # n words at most share n of n + 1 with another set.
    near = classes.where((F.col("n") * 100 >= (F.col("n") + 1) * percent) & (F.size("prefix") > 0))
    pairs = store.put(_candidates(near.withColumn("open", F.lit(True)), percent, some=True))
    settled = _settled(store, pairs.select("a", "b").distinct(), classes, percent)
    sweep(spark)
    # Classes whose first candidates do not match, and that have others, look at all of them.
    left = pairs.where("more").select("a").distinct().join(settled, F.col("a") == F.col("s1"), "left_anti")
    left = store.put(left)
    late = None
    if not left.isEmpty():
        again = near.join(left.hint("shuffle_hash"), F.col("c1") == F.col("a"), "left").withColumn("open", F.col("a").isNotNull())
        words = store.put(again.where("open").select(F.explode("prefix").alias("word")).distinct())
        sent = np.sort(words.toArrow().column("word").to_numpy()) if words.count() <= WORDS_SENT else None
        late = _settled(store, _candidates(again, percent, False, sent).select("a", "b").distinct(), classes, percent)
        store.drop(words)
    sweep(spark)
    # A line stays only where it is its class's first and that has no earlier match.
    gone = settled.union(late) if late else settled
    stays = classes.select("c1", "c2", *KEY).join(gone.hint("shuffle_hash"), (F.col("c1") == F.col("s1")) & (F.col("c2").bitwiseXOR(F.col("s2")) == 0), "left_anti")
    out = cut(stays.groupBy("did", "th").agg(F.collect_list("line_no").alias("stays")))
    store.drop(classes, pairs, settled, left, *([late] if late else []))
    return out


def _judged(text: Column, min_words: int) -> Column:
    """Numbers of the lines that are judged: those of min_words distinct words or more."""
    split = F.split(text, "\n")
    if min_words <= 1:
        with_word = F.transform(split, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i))
    else:
        with_word = F.transform(split, lambda line, i: F.when(F.size(_words_of(line)) >= min_words, i))
    return F.filter(with_word, lambda i: i.isNotNull())


def marked(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all, if None) and ``out``: the numbers of each row's lines that go."""
    stays = staying_lines(docs, doc_id, text, percent, min_words)
    did, th, judged, other_did, other_th, held = fresh(docs.withColumn(out, F.lit(0)), "did", "th", "judged", "other_did", "other_th", "stays")
    stays = stays.select(F.col("did").alias(other_did), F.col("th").alias(other_th), F.col("stays").alias(held))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = docs.columns if keep is None else keep
    told = docs.select(*names, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias(did), F.xxhash64(body).alias(th), _judged(body, min_words).alias(judged))
    joined = told.join(stays, (F.col(did) == F.col(other_did)) & (F.col(th) == F.col(other_th)), "left")
    return joined.select(*names, F.when(F.col(held).isNull(), F.col(judged)).otherwise(F.array_except(judged, held)).alias(out))


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 5) -> DataFrame:
    """(did, th, line_no) of every line that goes."""
    rows = _rows(docs, doc_id, text)
    found = marked(rows, "gone", "did", "text", percent, min_words, keep=["did", "th"])
    return found.dropDuplicates(["did", "th"]).select("did", "th", F.explode("gone").alias("line_no"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", percent: int = 80, min_words: int = 5) -> DataFrame:
    """docs without the lines that go; columns stay, null texts stay null.

    ``length``, where docs has that column, gets the new text's code points.
    """
    (gone,) = fresh(docs, "gone")
    a = marked(docs, gone, doc_id, text, percent, min_words)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    changed = (F.size(gone) > 0) & F.col(text).isNotNull()
    size = {length: F.when(changed, F.length(kept).cast(docs.schema[length].dataType)).otherwise(F.col(length))} if length in docs.columns else {}
    return a.withColumns({text: F.when(changed, kept).otherwise(F.col(text)), **size}).select(*docs.columns)
