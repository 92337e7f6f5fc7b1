"""Best-fit packing of token sequences after Martello-Toth dominance reduction, on a histogram of lengths.

Items of one length are alike, so that the packing is computed on at most `capacity` counts, however many
documents there are. Reduction: as long as a set of one to three lengths provably dominates every
other set for the longest remaining item, such sets are fixed for good (all equal ones at once). The
rest is packed best-fit in decreasing order, groups of equal bins at a time. Items then get their place by
their rank within their length.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed
each; no documents give no rows.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import map_slices, reach_package, segment_starts, settled, tidy
from crewledger.llm.tokens import pieces_of

CAPACITY = 4096
END_ID = 1
# Ranks are counted within buckets of about this many items of one length.
PER_BUCKET = 2_000


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document its ids and `end_id`, cut every `capacity` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = pieces_of(path).encode(batch.column("text"))
        total = counts + 1
        joined = np.full(total.sum(), end_id, "<u4")
        ends = np.cumsum(total)
        body = np.ones(len(joined), bool)
        body[ends - 1] = False
        joined[body] = flat
        cuts = -(-total // capacity)
        owner = np.repeat(np.arange(len(total)), cuts)
        number = np.arange(len(owner)) - np.repeat(segment_starts(cuts), cuts)
        start = number * capacity
        length = np.minimum(capacity, total[owner] - start)
        at = (ends - total)[owner] + start
        raw = [joined[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start),
                   pa.array(length), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names=schema.names)

    schema = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if keep_ids:
        schema = schema.add("ids", "binary")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, "text", schema, make)


@dataclass
class Plan:
    """Where the items of a length go: those from rank `first` on fill bins `bin`, `bin` + 1, ... with `each` per bin,
    one behind the other from `offset` on."""

    capacity: int
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, bin, each, offset
    used: dict[int, int] = field(default_factory=dict)  # ranks given away, by length
    bins: int = 0
    fixed: int = 0  # bins made by reduction

    def place(self, length: int, bin_: int, bins: int, each: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.slots.append((length, first, bin_, each, offset))
        self.used[length] = first + bins * each

    def arrays(self) -> dict[str, np.ndarray]:
        columns = np.array(sorted(self.slots) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "bin", "each", "offset"), columns.T, strict=True))


def dominating(present: list[int], count: dict[int, int], capacity: int, item: int) -> list[int] | None:
    """Lengths that may share a bin with one item for good; None if nothing proves it.

    `present` has the lengths left in ascending order. With room for k of the smallest others beside it:
    k = 0: the item alone. An exact partner fills the bin, so no other set is better. k = 1: the longest
    partner that fits takes the place of any other one. k = 2: the longest partner is as good as any set if it is at
    least as long as the best two together.
    """
    room = capacity - item
    others = present[: bisect.bisect_right(present, room)]
    left = {item: count[item] - 1}
    if not left[item] and item <= room:
        others.remove(item)
    if not others:
        return [item]
    best = others[-1]
    if best == room:
        return [item, best]
    k, held = 0, 0
    for s in others:
        n = left.get(s, count[s])
        take = min(n, (room - held) // s)
        k, held = k + take, held + take * s
        if take < n or k > 2:
            break
    if k == 1:
        return [item, best]
    if k == 2:
        pairs = 0
        for n, a in enumerate(others):
            at = bisect.bisect_right(others, room - a) - 1
            if at > n or at == n and left.get(a, count[a]) > 1:
                pairs = max(pairs, a + others[at])
        if best >= pairs:
            return [item, best]
    return None


def reduce(count: dict[int, int], plan: Plan) -> None:
    """Fixes dominating sets, longest item first, and takes them out of `count`."""
    present = sorted(s for s in count if count[s] > 0)
    for item in reversed(present.copy()):
        # Longer items that nothing dominates stay, as partners of this one.
        while count[item]:
            found = dominating(present, count, plan.capacity, item)
            if found is None:
                break
            if len(found) == 1:
                bins = count[item]
            else:
                bins = count[item] // 2 if found[1] == item else min(count[item], count[found[1]])
            if found[-1] == item and len(found) == 2:
                plan.place(item, plan.bins, bins, 2, 0)
            else:
                offset = 0
                for s in found:
                    plan.place(s, plan.bins, bins, 1, offset)
                    offset += s
            plan.bins += bins
            plan.fixed += bins
            for s in found:
                count[s] -= bins
            for s in set(found):
                if not count[s]:
                    present.remove(s)


def best_fit(count: dict[int, int], plan: Plan) -> None:
    """Best-fit in decreasing order for counts: bins with equal room are handled together."""
    rooms: list[int] = []  # rooms of open bins, ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # runs (first bin, number) by room

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in bins:
                bisect.insort(rooms, room)
            bins.setdefault(room, []).append((first, number))

    for s in sorted((s for s in count if count[s] > 0), reverse=True):
        left = count[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                break
            room = rooms[at]
            first, number = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            each = room // s
            full = min(number, left // each)
            if full:
                plan.place(s, first, full, each, plan.capacity - room)
                put(room - each * s, first, full)
                left -= full * each
            if full < number:
                partly = min(left, each)
                if partly:
                    plan.place(s, first + full, 1, partly, plan.capacity - room)
                    put(room - partly * s, first + full, 1)
                    left -= partly
                put(room, first + full + bool(partly), number - full - bool(partly))
        if left:
            each = plan.capacity // s
            full, rest = divmod(left, each)
            if full:
                plan.place(s, plan.bins, full, each, 0)
                put(plan.capacity - each * s, plan.bins, full)
            if rest:
                plan.place(s, plan.bins + full, 1, rest, 0)
                put(plan.capacity - rest * s, plan.bins + full, 1)
            plan.bins += full + bool(rest)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of `histogram` (length: number of items)."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan, count = Plan(capacity), dict(histogram)
    reduce(count, plan)
    best_fit(count, plan)
    return plan


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """`cut` with the rank of each item among those of its length, from 0 and without gaps.

    A length is spread over hash buckets, so that one that holds a third of all items is not sorted in
    one task; buckets of a length are few, and their sizes are summed up in order.
    """
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = cut.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    return within.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1).drop("bucket", "at", "before")


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    The driver holds one count per length, at most `capacity`, and a plan whose size follows the number
    of different lengths, not of documents.
    """
    cut = settled(pieces(docs, path, capacity, end_id, keep_ids, id_column, text))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_packing(histogram, capacity).arrays()
    placed = ranked(cut, -(-max(histogram.values(), default=1) // PER_BUCKET))
    span = 1 << 40  # ranks are below
    kept = cut.columns

    def place(batches):
        keys = slots["length"] * span + slots["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(keys, length * span + rank, "right") - 1
            nth = rank - slots["first"][slot]
            each = slots["each"][slot]
            sequence = slots["bin"][slot] + nth // each
            offset = slots["offset"][slot] + nth % each * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    reach_package(docs.sparkSession)
    schema = T.StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return placed.select(*cut.columns, "rank").mapInArrow(tidy(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of every sequence, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
