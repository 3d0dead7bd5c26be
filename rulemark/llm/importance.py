"""Resampling a corpus towards a target distribution by hashed n-gram importance weights.

A corpus-wide dictionary maps every distinct word to an integer id; an n-gram is
a tuple of ids. Only distinct tuples are turned back into bytes and hashed, each
once, whatever their number of occurrences; bucket counts of corpus and target
give every bucket a gain (its log ratio, in thousandths), and gains are joined
back to the documents. Documents are drawn without replacement by their weight
plus Gumbel noise that depends on seed and id alone.

What is joined is not one row an occurrence. Tasks cut the texts into blocks of
about 4 MB and tell each block's distinct words and n-grams apart with numpy;
only those are shuffled, so a very frequent word costs a row a block. Documents
keep sparse counts of their block's n-grams and meet the gains a block at a time.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. Defined results: a null or empty text has no feature, weight 0, and
is never drawn where ``min_words`` is above 0; with an empty target every count t
is 0; repeated rows are drawn by themselves and get ranks of their own, in any
order where nothing tells them apart; a null id has the noise of an empty id;
texts are taken whole, however long; ties in score go to the smaller id, null
first. Results get underscores in front of names that kept columns have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemark.llm.frames import Store, fresh
from rulemark.llm.textbatch import OTHER_BASE, buffers, lower_ascii, pieces, span_hashes, words

#: Bytes that separate words, once A-Z are lower-cased.
SEPARATORS = np.array([b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: Scores are told apart by bins of this width before single scores are counted.
BIN = 256


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of every distinct word, number of the word at each place); 128 bits tell words apart."""
    h = span_hashes(data, starts, ends)[0]
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    other = span_hashes(data, starts, ends, base=OTHER_BASE)[0]
    if (other[first][number] != other).any():
        _, first, number = np.unique(np.stack([h, other], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def _grams(number: np.ndarray, text_of: np.ndarray, distinct: int, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All runs of 1 to n words inside a text: (number of the run at each place, words of distinct runs: a matrix a size, text at each place)."""
    gram, texts, made = [number], [text_of], [np.arange(distinct, dtype=np.int32).reshape(-1, 1)]
    last, before = number, distinct
    for size in range(2, n + 1):
        inside = text_of[: max(0, len(number) - size + 1)] == text_of[size - 1 :]
        begin = np.flatnonzero(inside)
        found, where = np.unique(last[begin].astype(np.int64) * max(1, distinct) + number[begin + size - 1], return_inverse=True)
        made.append(np.hstack([made[-1][found // max(1, distinct)], (found % max(1, distinct)).astype(np.int32).reshape(-1, 1)]))
        gram.append(where.reshape(-1) + before)
        texts.append(text_of[begin])
        before += len(found)
        last = np.zeros(len(number), np.int64)
        last[begin] = where.reshape(-1)
    return np.concatenate(gram), made, np.concatenate(texts)


def _counted(gram: np.ndarray, text_of: np.ndarray, distinct: int, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts by text: (runs, counts, end of each text's part)."""
    found, count = np.unique(text_of.astype(np.int64) * max(1, distinct) + gram, return_counts=True)
    of = found // max(1, distinct)
    return (found % max(1, distinct)).astype(np.int32), count.astype(np.int32), np.searchsorted(of, np.arange(n_texts), "right")


def _lists(made: list[np.ndarray]) -> pa.ListArray:
    """The rows of matrices of several widths as one list column."""
    sizes = np.concatenate([np.full(len(m), m.shape[1]) for m in made])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate([m.reshape(-1) for m in made])))


def blocks(docs: DataFrame, text: str, n: int, keep: Sequence[str]) -> DataFrame:
    """A row a block of texts: its distinct words, its distinct runs of 1 to n words (left out for n = 1, where a run is a word) with their totals, and each document's sparse counts.

    Block numbers hold only once the result is written: partitions number their own.
    """
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType(
        [T.StructField(f"kept{k}", T.ArrayType(f.dataType)) for k, f in enumerate(kept)]
        + [T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]
        + [T.StructField("totals", T.ArrayType(T.LongType()))]
        + ([T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType())))] if n > 1 else [])
        + [T.StructField(c, T.BinaryType()) for c in ("of", "count", "ends", "n_words")]
    )
    order = [f.name for f in schema]
    held = docs.select(*(F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = buffers(piece.column("text"))
                data = lower_ascii(data)
                starts, ends, text_of = words(data, offsets, SEPARATORS)
                first, which = _numbered(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                gram, made, at = _grams(which, text_of, len(first), n)
                distinct = sum(len(m) for m in made)
                of, count, to = _counted(gram, at, distinct, piece.num_rows)
                raw = data.tobytes()
                spoken = pa.array([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                totals = pa.array(np.bincount(gram, minlength=distinct).astype(np.int64))
                one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
                binary = lambda values: pa.array([values.tobytes()], pa.binary())
                kept_here = [one(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (piece.column(f"kept{k}") for k in range(len(kept)))]
                n_words = np.bincount(text_of, minlength=piece.num_rows).astype(np.int64)
                columns = [*kept_here, pa.array([number]), one(spoken), one(totals), *([one(_lists(made))] if n > 1 else []), binary(of), binary(count), binary(to.astype(np.int64)), binary(n_words)]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=order)

    return held.mapInArrow(cut, schema)


def gain(t: Column, total_t: Column, s: Column, total_s: Column, buckets: int) -> Column:
    """A bucket's log ratio of target to corpus with add-one counts, in thousandths, floored."""
    d = lambda c: c.cast("double")
    return F.floor(F.lit(1000.0) * F.log((d(t) + 1) * (d(total_s) + buckets) / ((d(s) + 1) * (d(total_t) + buckets)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10000, keep: Sequence[str] | None = None) -> DataFrame:
    """docs' ``keep`` columns (all but the text by default) with n_words, n_features and weight, the floored mean gain of a document's runs."""
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    store = Store(docs.sparkSession)
    source, wanted = store.put(blocks(docs, text, n, keep)), store.put(blocks(target, target_text, n, []))
    each = lambda *cols: source.select(F.lit(False).alias("wanted"), "block", *cols).unionByName(wanted.select(F.lit(True).alias("wanted"), "block", *cols))
    spoken = each(F.posexplode(F.arrays_zip("words", "totals") if n == 1 else F.col("words")).alias("no", "word"))
    if n == 1:
        spoken = spoken.select("wanted", "block", "no", "word.words", "word.totals").toDF("wanted", "block", "no", "word", "total")
    # Every distinct word once, with its id. Written, as ids would not come out the same again.
    dictionary = store.put(spoken.select("word").distinct().select("word", F.monotonically_increasing_id().alias("id")))
    # Runs as tuples of ids: one row a block and distinct run.
    numbered = spoken.join(dictionary, "word")
    if n == 1:
        runs = store.put(numbered.select("wanted", "block", "no", F.array("id").alias("ids"), "total"))
    else:
        of_block = numbered.groupBy("wanted", "block").agg(F.sort_array(F.collect_list(F.struct("no", "id")))["id"].alias("ids"))
        tuples = F.arrays_zip(F.transform("runs", lambda r: F.transform(r, lambda w: F.get("ids", w))).alias("ids"), F.col("totals").alias("total"))
        runs = each("runs", "totals").join(of_block, ["wanted", "block"]).select("wanted", "block", tuples.alias("runs"))
        # Exploded from a column of its own: no row drags its block's arrays along.
        runs = store.put(runs.select("wanted", "block", F.posexplode("runs").alias("no", "run")).select("wanted", "block", "no", "run.ids", "run.total"))
    seen = lambda wanted: F.coalesce(F.sum(F.when(F.col("wanted") == wanted, F.col("total"))), F.lit(0))
    distinct = runs.groupBy("ids").agg(seen(False).alias("s"), seen(True).alias("t"))
    # Each distinct tuple's bytes, put together and hashed once.
    named = distinct
    for k in range(n):
        named = named.withColumn("_id", F.get("ids", k)).join(dictionary.select(F.col("id").alias("_id"), F.col("word").alias(f"_word{k}")), "_id", "inner" if k == 0 else "left")
    crc = F.crc32(F.concat_ws(" ", *(f"_word{k}" for k in range(n))).cast("binary"))
    hashed = store.put(named.select("ids", "s", "t", (crc % buckets).alias("bucket")))
    by_bucket = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = hashed.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_t"))
    # At most ``buckets`` rows, and one row.
    gains = by_bucket.crossJoin(F.broadcast(total)).select("bucket", gain(F.col("t"), F.col("total_t"), F.col("s"), F.col("total_s"), buckets).alias("gain"))
    of_tuple = hashed.join(F.broadcast(gains), "bucket").select("ids", "gain")
    back = runs.where("NOT wanted").join(of_tuple, "ids").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("no", "gain"))).alias("gains")).select("block", F.col("gains.gain").alias("gains"))
    rows = source.drop("words", "runs", "totals").join(back, "block", "left").drop("block")
    return _weights(rows, docs, keep)


def _weights(rows: DataFrame, docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Blocks with the gains of their runs, turned into documents again."""
    n_words, n_features, weight = fresh(docs.select(*keep), "n_words", "n_features", "weight")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in (n_words, n_features, weight)])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of, count = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in ("of", "count"))
                to, n = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("ends", "n_words"))
                values = batch.column("gains")[r].values
                values = np.zeros(1, np.int64) if values is None or not len(values) else np.asarray(values)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[to], prepend=0)
                features, total = sums(count), sums(values[of] * count)
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                kept = [batch.column(f"kept{k}")[r].values for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(features), pa.array(mean)], names=[*keep, n_words, n_features, weight])

    return rows.mapInArrow(take, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the sha256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int, seed: int, key: str = "doc_id", weight: str = "weight", n_words: str = "n_words", min_words: int = 20) -> DataFrame:
    """weighed with score (weight plus noise) and rank: of the N rows with enough words the floor(percent * N / 100) best are ranked 1, 2, 3...

    The cut is found from counts by bins of scores, then by single scores in one
    bin; both are bounded as scores are logarithms. Only rows at or above it are
    sorted, by range partitions whose sizes give the ranks.
    """
    score, rank, place = fresh(weighed, "score", "rank", "imp_place")
    store = Store(weighed.sparkSession)
    rows = store.put(weighed.withColumn(score, F.col(weight) + noise(F.col(key), seed)))
    able = rows.where(F.col(n_words) >= min_words)
    bins = sorted(((r[0], r[1]) for r in able.groupBy(F.floor(F.col(score) / BIN)).count().collect()), reverse=True)
    wanted = percent * sum(c for _, c in bins) // 100
    if not wanted:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    left = wanted
    for low, count in bins:
        if count >= left:
            break
        left -= count
    inside = able.where(F.floor(F.col(score) / BIN) == low).groupBy(score).count().collect()
    for least, count in sorted(((r[0], r[1]) for r in inside), reverse=True):
        if count >= left:
            break
        left -= count
    above = (F.col(n_words) >= min_words) & (F.col(score) >= least)
    order = [F.col(score).desc(), F.col(key).asc_nulls_first(), F.col(n_words)]
    best = rows.where(above).repartitionByRange(*order).sortWithinPartitions(*order)
    best = store.put(best.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(place), 33)
    sizes = sorted((r[0], r[1]) for r in best.groupBy(part).count().collect())  # a row a partition
    starts, at = [], 0
    for p, c in sizes:
        starts.append((p, at))
        at += c
    where = weighed.sparkSession.createDataFrame(starts, f"{place}_part long, {place}_start long")
    nth = F.col(f"{place}_start") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    best = best.join(F.broadcast(where), part == F.col(f"{place}_part")).withColumn(rank, F.when(nth <= wanted, nth))
    others = rows.where(~F.coalesce(above, F.lit(False))).withColumn(rank, F.lit(None).cast("long"))
    return others.unionByName(best.select(*others.columns))


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, text: str = "text", key: str = "doc_id", n: int = 1, buckets: int = 10000, min_words: int = 20) -> DataFrame:
    """The drawn rows of docs with every column, in no order: the corpus made to look like ``target``."""
    (number,) = fresh(docs, "imp_row")
    store = Store(docs.sparkSession)
    held = store.put(docs.withColumn(number, F.monotonically_increasing_id()))
    drawn = draw(weigh(held, target, text=text, n=n, buckets=buckets, keep=[key, number]), percent, seed, key=key, min_words=min_words)
    return held.join(drawn.where("rank IS NOT NULL").select(number), number, "left_semi").drop(number)
