"""Document fingerprints by randomised edit embedding.

A text is cut into blocks where its content says so, which an edit elsewhere does not move. Every block goes
through one random walk that all blocks share: at each step the current character is written out, and a random
bit of step and character decides whether the walk goes on to the next one. After an insertion or deletion
two walks soon meet again, so that a small edit distance becomes a small Hamming distance between the
written sequences. Band functions sample steps of the sequence; the least sampled value of a function over
all blocks is one component of the fingerprint, of which eight bits are kept. Fingerprints are compared by the share
of equal components, corrected for chance. Every step is sampled, every block counts: no text is cut short.

Near documents are found by bands of components. `near_components` verifies them by their common blocks, as exact
sets, and compares what a bucket leaves in several components block against block.

Defined cases: a null text is the empty one; empty texts have a fingerprint of their own; equal texts have
equal fingerprints; of rows that repeat an id the one with the smaller text hash comes first; a null id
comes before all others; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm import minhash_bbit
from crewledger.llm.frames import map_slices, reach_package, segment_starts, settled, tidy
from crewledger.llm.words import encoded, mix, seeds, window_hashes
from crewledger.session import shuffles_dropped

# Blocks end where a hash of CONTEXT characters has its low bits clear, or at LONGEST characters.
CONTEXT, ENDS, LONGEST = 8, 32, 96
STEPS = 3 * LONGEST
COMPONENTS, SAMPLES, KEPT_BITS = 64, 8, 8
BAND = 4
# Documents are linked if they share this part of their distinct blocks.
ALIKE = 70
# Documents of one range of ids, which one task walks through in order.
PER_RANGE = 4_000
# Characters of documents that are walked together, beside those of their edited texts.
HELD_CHARACTERS = 2 << 20
MOST_RANGES = 20_000


def sampled_steps() -> np.ndarray:
    """The steps each band function looks at; together they cover every step, early ones more often."""
    spread = np.concatenate([np.arange(STEPS), (STEPS * ((seeds(COMPONENTS * SAMPLES, 11) >> np.uint64(11)).astype(float) / 2**53) ** 2).astype(np.int64)])
    spread = spread[: COMPONENTS * SAMPLES]
    return spread[np.argsort(seeds(len(spread), 12), kind="stable")].reshape(COMPONENTS, SAMPLES)


def block_ends(points: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and length of all blocks of texts laid end to end; an empty text has one empty block."""
    if not len(points):
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    cut = np.zeros(len(points) + 1, bool)
    cut[starts[counts > 0]] = True
    context = window_hashes(mix(points.astype(np.uint64)), CONTEXT, 13)
    inside = np.flatnonzero((context & np.uint64(ENDS - 1)) == 0) + CONTEXT
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = inside[inside < len(points)]
    cut[inside[owner[inside] == owner[inside - CONTEXT]]] = True
    first = np.flatnonzero(cut[:-1])
    length = np.diff(np.append(first, len(points)))
    pieces = -(-length // LONGEST)
    number = np.arange(pieces.sum()) - np.repeat(segment_starts(pieces), pieces)
    begin = np.repeat(first, pieces) + number * LONGEST
    size = np.minimum(LONGEST, np.repeat(first + length, pieces) - begin)
    empty = starts[counts == 0]
    # Empty blocks stand before the text that follows at the same place.
    begin, size = np.concatenate([empty, begin]), np.concatenate([np.zeros(len(empty), np.int64), size])
    return begin, size


def embedded(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The written sequence of every block, one row per step; 0 behind the end of a block."""
    symbol = mix(points.astype(np.uint64) + np.uint64(1)) if len(points) else np.zeros(1, np.uint64)
    order = np.argsort(-size, kind="stable")
    at, stop = begin[order].copy(), (begin + size)[order]
    out = np.zeros((STEPS, len(begin)), np.uint64)
    live = np.arange(len(begin))
    with np.errstate(over="ignore"):
        for step, factor in enumerate(seeds(STEPS, 14) | np.uint64(1)):
            live = live[at[live] < stop[live]]
            if not len(live):
                break
            here = symbol[at[live]]
            out[step, order[live]] = here
            at[live] += ((here * factor) >> np.uint64(63)).astype(np.int64)
    return out


class Blocks:
    """The blocks of texts in order, each with its text's number and a 64-bit hash of what it says."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = [t.decode().encode("utf-32-le") for t in texts]
        counts = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        self.points = np.frombuffer(b"".join(raw), "<u4")
        starts = segment_starts(counts)
        begin, size = block_ends(self.points, starts, counts)
        empty, filled = np.flatnonzero(counts == 0), np.flatnonzero(counts > 0)
        owner = np.concatenate([empty, filled[np.searchsorted(starts[filled], begin[len(empty) :], "right") - 1]]).astype(np.int64)
        order = np.lexsort((begin, owner))
        self.begin, self.size, self.owner, self.texts = begin[order], size[order], owner[order], len(texts)
        self.value = np.zeros(len(order), np.uint64)
        if len(self.points):
            first, length = self.begin[self.size > 0], self.size[self.size > 0]
            place = np.arange(len(self.points)) - np.repeat(first, length)
            with np.errstate(over="ignore"):
                self.value[self.size > 0] = mix(np.add.reduceat(mix(self.points.astype(np.uint64) ^ seeds(LONGEST, 16)[place]), first))

    def components(self) -> np.ndarray:
        """The 64-bit components of each text, before bits are dropped. Blocks that say the same are walked once."""
        out = np.zeros((self.texts, COMPONENTS), np.uint64)
        if not self.texts:
            return out
        _, one, number = np.unique(self.value, return_index=True, return_inverse=True)
        written = embedded(self.points, self.begin[one], self.size[one])
        first = np.searchsorted(self.owner, np.arange(self.texts))
        factors = (seeds(COMPONENTS * SAMPLES, 15) | np.uint64(1)).reshape(COMPONENTS, SAMPLES)
        with np.errstate(over="ignore"):
            for n, steps in enumerate(sampled_steps()):
                key = np.full(len(one), factors[n, 0], np.uint64)
                for factor, step in zip(factors[n], steps, strict=True):
                    key += written[step] * factor
                out[:, n] = np.minimum.reduceat(mix(key)[number], first)
        return out

    def sets(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the blocks of the first `texts` end to end, and how many each has; 0 for an empty text."""
        chosen = (self.size > 0) & (self.owner < texts)
        value, owner = self.value[chosen], self.owner[chosen]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        return value[first], np.bincount(owner[first], minlength=texts).astype(np.int64)


def components(texts: list[bytes]) -> np.ndarray:
    """The 64-bit components of each text."""
    return Blocks(texts).components()


def kept_bits(found: np.ndarray) -> np.ndarray:
    return (mix(found) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components, corrected for those that are equal by chance, from 0 to 1."""
    chance = 2.0**-KEPT_BITS
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, components, fingerprint) of every document."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = encoded(batch.column("text"))
        found = components(texts)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * COMPONENTS
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.decode()) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(found.ravel().view(np.int64))), pa.array([r.tobytes().hex() for r in kept_bits(found)])],
            names=["doc_id", "n_chars", "components", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, "text", "doc_id long, n_chars long, components array<long>, fingerprint string", make)


def near_documents(docs: DataFrame, least: float = 0.7, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, v, likeness): documents linked with the first of a shared band whose likeness is at least `least`.

    Documents with equal components are one node, its smallest id. Every bucket of a band links its members with its
    smallest one, so that a group of copies of any size gives as many pairs as members.
    """
    found = settled(fingerprints(docs, id_column, text).filter("doc_id is not null"))
    nodes = settled(found.groupBy("components").agg(F.min("doc_id").alias("node")))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(COMPONENTS // BAND - 1)), lambda b: F.xxhash64(b, F.slice("components", b * BAND + 1, BAND)))
    keys = nodes.select("node", F.explode(bands).alias("bucket"))
    centres = keys.groupBy("bucket").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = keys.join(centres, "bucket").filter("u < node").select("u", F.col("node").alias("v")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("u"), F.col("components").alias("a")), "u").join(
        nodes.select(F.col("node").alias("v"), F.col("components").alias("b")), "v")
    equal = F.expr("size(filter(zip_with(a, b, (x, y) -> x = y), z -> z))") / F.lit(float(COMPONENTS))
    near = pairs.select("u", "v", equal.alias("likeness")).filter(F.col("likeness") >= least)
    copies = found.join(nodes, "components").filter("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"), F.lit(1.0).alias("likeness"))
    return near.union(copies)


def near_components(found: DataFrame, percent: int = ALIKE) -> DataFrame:
    """(id, component_id) for every id of stored rows of `walked`: component_id is the smallest id reachable over links.

    A link is a pair of documents that share a band and have 100 * common >= percent * all of their distinct blocks.
    """
    sketched = found.select(F.col("doc_id").alias("id"), *minhash_bbit.SKETCH.names[1:])
    sets = found.select(F.col("doc_id").alias("id"), "shingles")
    linked = minhash_bbit.linked(sketched, sets, percent, None, COMPONENTS)
    return linked.filter("id is not null").select("id", "component_id").distinct()


def ranges_of(ids: DataFrame) -> tuple[list[int], dict[int, int | None]]:
    """Upper bounds of id ranges of about PER_RANGE documents, and the smallest id of each range that is not empty."""
    reach_package(ids.sparkSession)
    n = ids.count()
    wanted = min(MOST_RANGES, max(1, -(-n // PER_RANGE)))
    shares = [k / wanted for k in range(1, wanted)]
    bounds = sorted(set(ids.filter("doc_id is not null").approxQuantile("doc_id", shares, 0.25 / wanted))) if shares else []
    bounds = [int(b) for b in bounds]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([range_of(batch.column("doc_id"), bounds), batch.column("doc_id")], names=["r", "doc_id"])

    found = ids.mapInArrow(tidy(run), "r int, doc_id long").groupBy("r").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()
    return bounds, {row["r"]: None if row["has_null"] else row["first"] for row in sorted(found, key=lambda row: row["r"])}


def range_of(ids: pa.Array, bounds: list[int]) -> pa.Array:
    """Range of each id, null ids in the first."""
    low = np.iinfo(np.int64).min
    return pa.array(np.searchsorted(np.array(bounds, np.int64), ids.fill_null(low).to_numpy(zero_copy_only=False), "left").astype(np.int32))


PREPARED = "r int, copied boolean, doc_id long, tie long, packed binary"
WALKED = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("doc_id", "n_chars")),
    *(T.StructField(n, T.BinaryType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")),
    *(T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")),
    *minhash_bbit.SKETCH.fields[1:], T.StructField("shingles", T.BinaryType()),
])
COMPARED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def walked(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document, its sketch and its set of blocks.

    The edited text has its last quarter of characters replaced by the first as many of the next document.
    Documents are dealt by ranges of ids, compressed, and each range also gets the first document of the next. A text
    moves once and is walked once, together with the edited texts, whose blocks are mostly the same.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds, firsts = ranges_of(rows.select("doc_id"))
    order = list(firsts)
    follows = {order[n]: order[n - 1] for n in range(len(order))}  # the first range follows the last

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3)
        where, ids = range_of(batch.column("doc_id"), bounds).to_pylist(), batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        for n, value in enumerate(encoded(batch.column("text"))):
            tie = int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)
            rest = (ids[n], tie, pack.compress(value))
            out.append((where[n], False, *rest))
            if firsts[where[n]] == ids[n]:
                out.append((follows[where[n]], True, *rest))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PREPARED.split(", ")])

    def walk(batches):
        unpack = zstandard.ZstdDecompressor()

        def read():
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    yield row

        def pairs():
            for _, group in itertools.groupby(read(), key=lambda row: row[0]):
                before = None
                for _, copied, number, _, packed in group:
                    here = (number, unpack.decompress(packed).decode())
                    if before is not None:
                        yield before, here
                    if copied:
                        break
                    before = here

        held, size = [], 0
        for pair in pairs():
            held.append(pair)
            size += len(pair[0][1])
            if size > HELD_CHARACTERS:
                yield compare(held)
                held, size = [], 0
        if held:
            yield compare(held)

    prepared = map_slices(rows, "text", PREPARED, prepare)
    dealt = prepared.repartition("r").sortWithinPartitions("r", "copied", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.mapInArrow(tidy(walk), WALKED)


def compare(pairs: list) -> pa.RecordBatch:
    """The columns of WALKED for pairs of documents (id, text); the second of a pair is mostly the first of the next one."""
    n, edited, following, own = len(pairs), [], [], [here for (_, here), _ in pairs]
    others: list[str] = []
    for k, ((_, here), after) in enumerate(pairs):
        quarter = len(here) // 4
        edited.append((here[: len(here) - quarter] + after[1][:quarter]).encode())
        if k + 1 < n and pairs[k + 1][0] is after:
            following.append(k + 1)
        else:
            following.append(2 * n + len(others))
            others.append(after[1])
    blocks = Blocks([*(t.encode() for t in own), *edited, *(t.encode() for t in others)])
    found = blocks.components()
    kept = kept_bits(found)
    value, counts = blocks.sets(n)
    ids = pa.array([a[0] for a, _ in pairs], pa.int64())
    sketch = minhash_bbit.sketch(ids, value, counts, found[:n][counts > 0], COMPONENTS // BAND, BAND)
    ends = np.concatenate([[0], np.cumsum(counts)]) * 8
    columns = [
        ids, pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e).digest() for e in edited]),
        pa.array([r.tobytes() for r in kept[:n]]), pa.array([r.tobytes() for r in kept[n : 2 * n]]),
        pa.array([likeness(kept[k], kept[n + k]) for k in range(n)]), pa.array([likeness(kept[k], kept[f]) for k, f in enumerate(following)]),
        *sketch.columns[1:],
        pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(value.tobytes())]).cast(pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=WALKED.names)


def presented(found: DataFrame) -> DataFrame:
    """The columns COMPARED of `walked`, digests and fingerprints in hex."""
    return found.select(*(F.lower(F.hex(c)).alias(c) if isinstance(WALKED[c].dataType, T.BinaryType) else c for c in COMPARED))


def compared(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document, by ascending id."""
    return presented(walked(docs, id_column, text))


def compared_and_linked(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`compared` with the component of linked documents; what the walks give is stored in `folder`, which executors share."""
    with shuffles_dropped(docs.sparkSession):
        walked(docs, id_column, text).write.parquet(folder)
        found = docs.sparkSession.read.parquet(folder)
        linked = near_components(found)
    rows = presented(found)
    return rows.join(linked, rows.doc_id == linked.id, "left").select(*rows.columns, "component_id")
