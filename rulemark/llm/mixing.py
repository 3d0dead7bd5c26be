"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` documents in a hash order. With
integer weight n of total H, a source's j-th block (from 0) is released at slot
floor(j H / n) and due at ceil((j + 1) H / n); every slot takes the released block
of the earliest deadline. As the weights fill the line exactly, every deadline
holds, so at any slot each source is less than one block off its share. When a
source ends, the others go on with their own weights over the smaller total.

That pattern repeats every H slots, so the driver schedules one round for each
set of sources still running (at most one set a named source); a block's slot
follows from its number by arithmetic. ``tempered_weights`` gives every source
present a weight of its own from its count; under weights that leave sources
out, these share the weight ``OTHER`` as one stream. No document is dropped or repeated.

Defined results: null sources belong to the shared stream; repeated rows each
get a place; a stream without documents takes no slots; empty tables give none.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rulemark.llm.frames import fresh

OTHER = "*"
#: Documents of one rank bucket: what a task sorts at once.
BUCKET_ROWS = 20_000
#: Weight of the largest source under tempered weights: one round has at most so many slots a source.
TOP_WEIGHT = 16


def tempered_weights(docs: DataFrame, source: str = "source") -> dict[str, int]:
    """A weight for every source: TOP_WEIGHT x the square root of its count over the largest one's, rounded, 1 at least.

    So small sources stand above their natural share and large ones below it.
    Null sources are OTHER, which has weight 1 where there are none.
    """
    counted = docs.groupBy(F.coalesce(F.col(source), F.lit(OTHER)).alias("s")).count().collect()  # a row a source
    most = max((r["count"] for r in counted), default=1)
    return {OTHER: 1} | {r["s"]: max(1, round(TOP_WEIGHT * math.sqrt(r["count"] / most))) for r in sorted(counted)}


def pattern(weights: dict[str, int]) -> list[str]:
    """One round of sum(weights) slots: the stream of each, by earliest deadline first."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    later = [(0, s) for s in weights]  # (release, stream)
    heapq.heapify(later)
    ready: list[tuple[int, str]] = []  # (deadline, stream)
    out = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s = heapq.heappop(later)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        _, pick = heapq.heappop(ready)
        done[pick] += 1
        if done[pick] < weights[pick]:
            heapq.heappush(later, (done[pick] * total // weights[pick], pick))
        out.append(pick)
    return out


@dataclass(frozen=True)
class Phase:
    """How the blocks first..last of a stream lie in the order while one set of streams runs."""

    stream: str
    first: int
    last: int
    start: int
    period: int
    slots: list[int]


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """Phases that place every block of every stream."""
    left = {s: n for s, n in blocks.items() if n > 0}
    at, out = 0, []
    while left:
        live = {s: weights[s] for s in left}
        divisor = math.gcd(*live.values())
        live = {s: n // divisor for s, n in live.items()}
        round_ = pattern(live)
        period = len(round_)
        slots: dict[str, list[int]] = {s: [] for s in live}
        for k, s in enumerate(round_):
            slots[s].append(k)
        last = {s: (n - 1) // live[s] * period + slots[s][(n - 1) % live[s]] for s, n in left.items()}
        end = min(last.values()) + 1  # slots of this phase
        for s, n in list(left.items()):
            here = end // period * live[s] + sum(k < end % period for k in slots[s])
            if here:
                done = blocks[s] - n
                out.append(Phase(s, done, done + here - 1, at, period, slots[s]))
            left[s] = n - here
            if not left[s]:
                del left[s]
        at += end
    return out


def mix(docs: DataFrame, weights: dict[str, int], source: str = "source", doc_id: str = "doc_id", block_rows: int = 8, salt: str = "mix") -> DataFrame:
    """docs with stream, block, slot and place (within its block); (slot, place) is the mixed order.

    ``weights``: positive integers by source, with OTHER for all other sources.
    The new columns get underscores in front where docs has such names.
    """
    if not weights or min(weights.values()) < 1 or OTHER not in weights:
        raise ValueError(f"weights are positive integers, and {OTHER!r} has one")
    stream, block, slot, place, order, bucket, rank = fresh(docs, "stream", "block", "slot", "place", "mix_order", "mix_bucket", "mix_rank")
    named = [s for s in weights if s != OTHER]
    # Equal ids (and nulls) may abound, so ranks are dealt by the whole row's hash.
    whole = F.xxhash64(*(F.col(c) for c in docs.columns))
    a = docs.withColumn(stream, F.when(F.col(source).isin(named), F.col(source)).otherwise(OTHER) if named else F.lit(OTHER))
    a = a.withColumn(order, F.md5(F.concat_ws("|", F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))))
    total = docs.select(source).count()
    n_buckets = max(1, -(-total // BUCKET_ROWS))
    a = a.withColumn(bucket, F.pmod(F.xxhash64(F.col(order), whole), F.lit(n_buckets)).cast("int") if n_buckets > 1 else F.lit(0))
    # Counts by stream and bucket give each bucket's first rank.
    counts = a.groupBy(stream, bucket).count()
    before = Window.partitionBy(stream).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(rank, F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    sizes = {r[0]: r[1] for r in counts.groupBy(stream).agg(F.sum("count")).collect()}  # one row a stream
    phases = schedule({s: -(-n // block_rows) for s, n in sizes.items()}, weights)
    p_stream, p_first, p_last, p_start, p_period, p_slots = fresh(a, "p_stream", "p_first", "p_last", "p_start", "p_period", "p_slots")
    kinds = {p_stream: T.StringType(), p_first: T.LongType(), p_last: T.LongType(), p_start: T.LongType(), p_period: T.LongType(), p_slots: T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    rows = [(p.stream, p.first, p.last, p.start, p.period, p.slots) for p in phases]
    table = docs.sparkSession.createDataFrame(rows, schema)
    within = Window.partitionBy(stream, bucket).orderBy(order, *(F.col(c) for c in (doc_id,)), whole)
    a = a.join(offsets, [stream, bucket]).withColumn(rank, F.col(rank) + F.row_number().over(within) - 1)
    a = a.withColumns({block: F.floor(F.col(rank) / block_rows).cast("long"), place: F.pmod(F.col(rank), F.lit(block_rows)).cast("int")})
    # At most the square of the named streams: a bounded side to broadcast.
    a = a.join(F.broadcast(table), (F.col(stream) == F.col(p_stream)) & F.col(block).between(F.col(p_first), F.col(p_last)))
    step = F.col(block) - F.col(p_first)
    n = F.size(p_slots)
    where = F.col(p_start) + F.floor(step / n) * F.col(p_period) + F.element_at(p_slots, (F.pmod(step, n) + 1).cast("int"))
    return a.withColumn(slot, where.cast("long")).select(*docs.columns, stream, block, slot, place)


def mixed(docs: DataFrame, weights: dict[str, int], source: str = "source", doc_id: str = "doc_id", block_rows: int = 8) -> DataFrame:
    """docs in the mixed order: partitions, and the rows in them, follow one another."""
    slot, place = fresh(docs, "stream", "block", "slot", "place")[2:]
    return mix(docs, weights, source, doc_id, block_rows).orderBy(slot, place).select(*docs.columns)
