"""Near-duplicates by b-bit MinHash: bands of full minima propose, packed low bits estimate, full sets confirm.

Defined cases: null or blank text has no shingles and links with nothing; a text of fewer than five words
is one shingle; a null id is never linked; rows that repeat an id are one node of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.components import components
from crewledger.llm.frames import map_slices, segment_starts, settled, tidy
from crewledger.llm.words import Words, encoded, mix, seeds, window_hashes, word_hashes

WIDTH = 5
# A pair at the limit shares no band with at most this probability: 0.85 takes 32 bands of 6 minima, as
# (1 - 0.85^6)^32 = 2.6e-7, and 0.80 takes 39 bands of 5, as (1 - 0.80^5)^39 = 1.9e-7.
MISSED, MOST_BANDS = 2.7e-7, 39
# 128 minima keep 4 bits each, in 8 longs. At a similarity of 0.85 the corrected estimate has a standard
# deviation of 0.033; pairs estimated this many of those below the limit are not looked at again.
LANES, BITS = 128, 4
DEVIATIONS = 6
# Most members and shingles of a block, on average; a set larger than that is a block of its own size.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18
CELL_COLUMNS = 4096

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts end to end, and how many each text has."""
    words = Words([t.translate(LOWER) for t in texts])
    hashes = word_hashes(words.vocabulary)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    owner = words.text_of()
    windows = window_hashes(hashes, WIDTH)
    whole = owner[: len(windows)] == owner[WIDTH - 1 :] if len(windows) else np.zeros(0, bool)
    values, owners = [windows[whole]], [owner[: len(windows)][whole]]
    for length in range(1, WIDTH):  # texts that are one short shingle
        short = np.flatnonzero(words.counts == length)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            with np.errstate(over="ignore"):
                for k, factor in enumerate(seeds(length, 100 + length) | np.uint64(1)):
                    total += hashes[words.starts[short] + k] * factor
            values.append(mix(total))
            owners.append(short)
    value, text = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[first], text[first]
    return value, np.bincount(text, minlength=len(texts)).astype(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands and minima a band for a limit: the longest bands of which MOST_BANDS are enough, else as many as it takes."""
    alike = percent / 100
    if not 0 < alike < 1:
        raise ValueError(f"a limit from 1 to 99 percent is needed, not {percent}")
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(alike**rows)))
        if bands <= MOST_BANDS:
            break
    return bands, rows


def slack(percent: int, lanes: int = LANES) -> float:
    """How far below the limit the estimate of a pair at the limit may come."""
    chance = 1 / (1 << BITS)
    equal = chance + (1 - chance) * percent / 100
    return DEVIATIONS * math.ceil(1000 * math.sqrt(equal * (1 - equal) / lanes) / (1 - chance)) / 1000


def signatures(value: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of `hashes` seeded permutations for every non-empty set, one row per set."""
    starts = segment_starts(counts)[counts > 0]
    minima = np.zeros((len(starts), hashes), np.uint64)
    if len(starts):
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(seeds(hashes, 1) | np.uint64(1), seeds(hashes, 2), strict=True)):
                x = (value ^ b) * a
                minima[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return minima


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    out = np.zeros((len(minima), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band, salt in enumerate(seeds(bands, 3)):
            key = np.full(len(minima), salt, np.uint64)
            for row in range(rows):
                key = mix(key ^ minima[:, band * rows + row])
            out[:, band] = key
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the first LANES minima, 16 lanes to a 64-bit number."""
    low = mix(minima[:, :LANES]) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    out = np.zeros((len(minima), low.shape[1] // per), np.uint64)
    for lane in range(per):
        out |= low[:, lane::per] << np.uint64(BITS * lane)
    return out


SKETCH = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("print_a", T.LongType()),
    T.StructField("print_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("lanes", T.ArrayType(T.LongType())),
])


def sketch(ids: pa.Array, value: np.ndarray, counts: np.ndarray, minima: np.ndarray, bands: int, rows: int) -> pa.RecordBatch:
    """The columns of SKETCH for sets laid end to end, from the minima of those that are not empty."""
    filled = counts > 0
    prints = np.zeros((2, len(counts)), np.uint64)
    if filled.any():
        starts = segment_starts(counts)[filled]
        with np.errstate(over="ignore"):
            for k, salt in enumerate(seeds(2, 4)):
                prints[k, filled] = np.add.reduceat(mix(value ^ salt), starts)

    def lists(found: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.where(filled, found.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel().view(np.int64)))

    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(counts), *[pa.array(p.view(np.int64)) for p in prints],
         lists(band_hashes(minima, bands, rows)), lists(packed(minima))],
        names=SKETCH.names,
    )


def sketches(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: size and 128-bit print of its shingle set, band keys and packed low bits (null if empty)."""
    bands, per_band = banding(percent)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, counts = shingle_sets(encoded(batch.column("text")))
        return sketch(batch.column("id"), value, counts, signatures(value, counts, max(bands * per_band, LANES)), bands, per_band)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return map_slices(rows, "text", SKETCH, make)


def estimate(a: str, b: str, lanes: int = LANES) -> Column:
    """Similarity from two arrays of packed lanes, corrected for lanes that are equal by chance."""
    ones = "1229782938247303441"  # 0x1111111111111111: one bit per lane of four
    differ = (
        f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, z) -> n + "
        f"bit_count((z | shiftright(z, 1) | shiftright(z, 2) | shiftright(z, 3)) & {ones}L))"
    )
    chance = 1 / (1 << BITS)
    return (1 - F.expr(differ) / F.lit(float(lanes)) - chance) / (1 - chance)


# Makes the sets of texts; None where the rows bring their sets along.
Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None


def set_bytes(docs: DataFrame, sets_of: Sets) -> DataFrame:
    """(id, shingles) with the sorted 64-bit set of each text as bytes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, counts = sets_of(encoded(batch.column("text")))
        ends = np.concatenate([[0], np.cumsum(counts)]) * 8
        raw = pa.Array.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(value.tobytes())]
        )
        return pa.RecordBatch.from_arrays([batch.column("id"), raw.cast(pa.binary())], names=["id", "shingles"])

    return map_slices(docs, "text", "id long, shingles binary", make)


def sets_for(ids: DataFrame, rows: DataFrame, sets_of: Sets) -> DataFrame:
    """(id, shingles) of `ids`, from rows (id, text), or from rows (id, shingles) without `sets_of`."""
    chosen = rows.join(ids, "id", "left_semi")
    found = set_bytes(chosen, sets_of) if sets_of else chosen
    return found.groupBy("id").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, sets_of: Sets = shingle_sets) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = settled(sets_for(ids, docs, sets_of))
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )

    def keep(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            mask = []
            for x, y in zip(a, b, strict=True):
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                mask.append(100 * shared >= percent * ((len(x) + len(y)) // 8 - shared))
            yield batch.select(["u", "v"]).filter(pa.array(mask, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(tidy(keep), "u long, v long")


def spanning_links(label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that join all labels which any pair at the limit joins, fewer pairs than sets.

    Shared shingles of all pairs are counted exactly, as products of 0/1 matrices of CELL_COLUMNS shingles.
    """
    size = np.array([len(x) for x in sets], np.int64)
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner = np.repeat(np.arange(len(sets)), size)[common]
    column = (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, CELL_COLUMNS):
        low, high = np.searchsorted(column, [first, first + CELL_COLUMNS])
        has = np.zeros((len(sets), CELL_COLUMNS), np.float32)
        has[owner[low:high], column[low:high] - first] = 1
        shared += (has @ has.T).astype(np.int64)
    linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    same = label[:, None] == label[None, :]
    seen, found = np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        waiting = [] if seen[root] else [root]
        seen[root] = True
        while waiting:
            x = waiting.pop()
            reached = np.flatnonzero((linked[x] | same[x]) & ~seen)
            seen[reached] = True
            waiting.extend(reached.tolist())
            found.extend((x, y) for y in reached.tolist() if not same[x, y])
    return found


def links_across(members: DataFrame, docs: DataFrame, percent: int, sets_of: Sets = shingle_sets) -> DataFrame:
    """Links (u, v) that join the labels within each bucket of `members` (bucket, node, label, n).

    A bucket is dealt into blocks of bounded size by a hash of the node, and every two blocks meet in a
    cell, so no task holds more than two blocks of a bucket of any size. A cell returns fewer links than
    it has members: those that connect what its links connect, confirmed on whole sets.
    """
    ids = members.select(F.col("node").alias("id")).distinct()
    sets = sets_for(ids, docs, sets_of)
    blocks = members.groupBy("bucket").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("k"))
    cells = members.join(blocks, "bucket").withColumn("b", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).select(
        "bucket", "node", "label", F.explode(F.expr(
            "transform(sequence(0, k - 1), o -> struct(least(b, o) AS low, greatest(b, o) AS high))")).alias("cell"))
    held = cells.select("bucket", "cell.low", "cell.high", "node", "label").join(sets, F.col("node") == sets.id).drop("id")

    def find(cell: pa.Table) -> pa.Table:
        node = cell.column("node").to_numpy()
        found = spanning_links(
            cell.column("label").to_numpy(), [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()], percent)
        ends = node[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"u": ends.min(axis=1), "v": ends.max(axis=1)}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return held.groupBy("bucket", "low", "high").applyInArrow(find, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) per row: component_id is the smallest id reachable over links.

    A link is a pair of texts with 100 * intersection >= percent * union. Rows with equal sets become one
    node first, so that copies never meet in pairs. Every bucket then links its members to its smallest
    one only; that settles a group of near copies of any size in one step, linear in its size. What is
    left are buckets whose members did not end up in one component. There a semi join on 64 bytes each
    keeps the members that have a likely partner in another component, and `links_across` finds the
    links between components on whole sets, block against block.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return linked(sketches(docs, id_column, text, percent), rows, percent)


def linked(sketched: DataFrame, rows: DataFrame, percent: int, sets_of: Sets = shingle_sets, n_lanes: int = LANES) -> DataFrame:
    """`near_duplicates` of `rows` (id, text) by their SKETCH rows, whose sets are those of `sets_of`.

    Without `sets_of` the rows are (id, shingles), and both frames are stored already.
    """
    sketched = settled(sketched) if sets_of else sketched
    filled = sketched.filter("n_shingles > 0 and id is not null")
    prints = ["n_shingles", "print_a", "print_b"]
    nodes = settled(
        filled.groupBy(prints).agg(F.min("id").alias("node"), F.min_by(F.struct("bands", "lanes"), "id").alias("s"))
        .select(*prints, "node", F.col("s.bands").alias("bands"), F.col("s.lanes").alias("lanes"))
    )
    copies = filled.join(nodes.select(*prints, "node"), prints).filter("id <> node").select(
        F.col("node").alias("u"), F.col("id").alias("v"))
    node_rows = rows.filter("text is not null and id is not null" if sets_of else "id is not null")

    # Buckets with more than one node, and each member with the smallest of its bucket.
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other")).filter("centre < other")
    members = settled(keys.join(shared.select("bucket", "centre"), "bucket"))
    stars = members.filter("centre < node").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    limit = percent / 100 - slack(percent, n_lanes)
    lanes = nodes.select("node", "lanes", "n_shingles")
    side = {
        end: lanes.select(F.col("node").alias(end), F.col("lanes").alias(f"{end}_lanes"), F.col("n_shingles").alias(f"{end}_n"))
        for end in ("u", "v")
    }
    sizes = f"100 * least(u_n, v_n) >= {percent} * greatest(u_n, v_n)"  # else no overlap can be large enough
    likely = stars.join(side["u"], "u").join(side["v"], "v").filter(sizes).filter(
        estimate("u_lanes", "v_lanes", n_lanes) >= limit).select("u", "v")
    links = settled(confirmed(settled(likely), node_rows, percent, sets_of))

    # Buckets that these links leave in several components.
    first = components(links)
    labelled = members.join(first, members.node == first.node, "left").select(
        "bucket", members.node, F.coalesce("label", members.node).alias("label"))
    labelled = settled(labelled)
    open_buckets = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("n"))
    open_buckets = open_buckets.filter("l < h and n > 2").select("bucket")
    loose = settled(labelled.join(open_buckets, "bucket").join(lanes, "node"))
    left = loose.select("bucket", F.col("node").alias("u"), F.col("label").alias("u_label"),
                        F.col("lanes").alias("u_lanes"), F.col("n_shingles").alias("u_n"))
    right = loose.select("bucket", F.col("node").alias("v"), F.col("label").alias("v_label"),
                         F.col("lanes").alias("v_lanes"), F.col("n_shingles").alias("v_n"))
    near = (left.bucket == right.bucket) & (left.u_label != right.v_label) & F.expr(sizes) & (
        estimate("u_lanes", "v_lanes", n_lanes) >= limit)
    partnered = settled(left.join(right, near, "left_semi").select(
        "bucket", F.col("u").alias("node"), F.col("u_label").alias("label"), F.col("u_n").alias("n")))
    more = links if partnered.isEmpty() else links.union(settled(links_across(partnered, node_rows, percent, sets_of)))

    labels = components(more.union(copies))
    return sketched.join(labels, sketched.id == labels.node, "left").select(
        "id", "n_shingles", F.coalesce("label", "id").alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents of `docs` that are the first of their component at `percent`, with all columns.

    Rows without an id stay; of rows that repeat a kept id one stays.
    """
    found = settled(near_duplicates(docs, percent=percent))
    dropped = found.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = found.filter("id is not null").groupBy(F.col("id").alias("doc_id")).count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(
        kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
