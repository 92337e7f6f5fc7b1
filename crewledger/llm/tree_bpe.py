"""Byte-level BPE of long unsplit text by tree concatenation, and its decoding.

A text is halved down to leaves, the leaves are encoded on their own, and neighbours are joined bottom up:
a window around the join is encoded anew and grows until both sides agree with it exactly. What then
stands on the left of the window, in it and on its right are the ids of the whole.

Agreement is exact in two ways. Where the window reaches from one sure cut (a single blank between
characters that are none) to another, the ids outside it cannot depend on the join. Inside a run of letters
or of digits without blanks, one token of the window must be the left side's token in the same place, and
a later one the right side's: BPE accepts a sequence if and only if it accepts every neighbouring pair
in it, and every pair of the result then comes from an encoding. A window that finds no agreement
ends as the whole text.

Defined cases: null is encoded as the empty text (no ids); repeated rows and equal texts have equal ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import add_columns, free_name, map_slices
from crewledger.llm.tokens import byte_encoder, byte_table
from crewledger.llm.words import encoded

LEAF_BYTES = 8192
# Texts of more characters have their blocks encoded by different tasks.
WIDE_CHARS = 1 << 16
FIRST_WINDOW = 64

LAST_CUT = regex.compile(r"(?s).*(?<=\S)(?= \S)")
NEXT_CUT = regex.compile(r"(?<=\S)(?= \S)")
ONE_RUN = regex.compile(r"\p{L}+|\p{N}+")


def char_start(text: bytes, at: int) -> int:
    """The first start of a character at or after byte `at`."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def char_before(text: bytes, at: int) -> int:
    """The last start of a character at or before byte `at`."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def halves(text: bytes, low: int, high: int, leaf: int) -> list[tuple[int, int]]:
    """Byte ranges of the leaves below a node, left to right."""
    if high - low <= leaf:
        return [(low, high)]
    middle = char_start(text, (low + high) // 2)
    if not low < middle < high:
        return [(low, high)]
    return halves(text, low, middle, leaf) + halves(text, middle, high, leaf)


class Joiner:
    """Joins encodings of neighbouring stretches of one text."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.lengths = byte_table(path)[1]

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(byte_encoder(self.path)(text.decode()), np.uint32)

    def join(self, text: bytes, low: int, middle: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[low:high] from those of text[low:middle] and text[middle:high]."""
        left_ends = low + np.cumsum(self.lengths[left])
        right_ends = middle + np.cumsum(self.lengths[right])
        reach = FIRST_WINDOW
        while True:
            start, end = char_before(text, max(low, middle - reach)), char_start(text, min(high, middle + reach))
            from_cut, to_cut = self._cuts(text, low, start, middle, end, high)
            if from_cut is not None and to_cut is not None:
                before = int(np.searchsorted(left_ends, from_cut, "right"))
                after = int(np.searchsorted(right_ends, to_cut, "right")) if to_cut > middle else 0
                sides_agree = (from_cut == low or before and left_ends[before - 1] == from_cut) and (
                    to_cut == middle or after and right_ends[after - 1] == to_cut)
                if sides_agree or (start == low and end == high):
                    return np.concatenate([left[:before], self.encode(text[from_cut:to_cut]), right[after:]])
            elif ONE_RUN.fullmatch(text[start:end].decode()):
                found = self._agreed(text, start, end, left, left_ends, right, right_ends, middle)
                if found is not None:
                    return found
            reach *= 2

    @staticmethod
    def _cuts(text: bytes, low: int, start: int, middle: int, end: int, high: int) -> tuple[int | None, int | None]:
        """The last sure cut up to the join and the first from it on, inside the window."""
        # One character more on either side, for what stands around a cut.
        wide_start = char_before(text, max(0, start - 1))
        wide_end = char_start(text, min(len(text), end + 1))
        here = char_start(text, min(len(text), middle + 2))
        found = LAST_CUT.match(text[wide_start:here].decode())
        at = wide_start + len(found[0].encode()) if found else -1
        if at > middle:  # the cut behind the join is looked for from the other side
            found = LAST_CUT.match(text[wide_start : char_start(text, min(len(text), middle + 1))].decode())
            at = wide_start + len(found[0].encode()) if found else -1
        first = at if found and low < at <= middle else low if start == low else None
        before = char_before(text, max(0, middle - 1))
        found = NEXT_CUT.search(text[before:wide_end].decode())
        at = before + len(text[before:wide_end].decode()[: found.start()].encode()) if found else -1
        last = at if found and middle <= at < high else high if end == high else None
        return first, last

    def _agreed(self, text, start, end, left, left_ends, right, right_ends, middle) -> np.ndarray | None:
        """The join inside one run, from token boundaries of both sides; None if the window disagrees."""
        first = int(np.searchsorted(left_ends, start, "right"))
        last = int(np.searchsorted(right_ends, end, "left"))
        if not first or last >= len(right):
            return None
        begin, stop = int(left_ends[first - 1]), int(right_ends[last - 1]) if last else middle
        if char_start(text, begin) != begin or char_start(text, stop) != stop or begin >= middle or stop <= middle:
            return None
        window = self.encode(text[begin:stop])
        ends = begin + np.cumsum(self.lengths[window])
        starts = ends - self.lengths[window]
        on_left = {(int(e - self.lengths[t]), int(t)): n for n, (e, t) in enumerate(zip(left_ends[first:], left[first:], strict=True), first)}
        on_right = {(int(e - self.lengths[t]), int(t)): n for n, (e, t) in enumerate(zip(right_ends[:last], right[:last], strict=True))}
        same = [n for n in range(len(window)) if (int(starts[n]), int(window[n])) in on_left and ends[n] <= middle]
        also = [n for n in range(len(window)) if (int(starts[n]), int(window[n])) in on_right and starts[n] >= middle]
        if not same or not also:
            return None
        x, y = same[-1], also[0]
        upto = on_left[int(starts[x]), int(window[x])]
        onward = on_right[int(starts[y]), int(window[y])]
        return np.concatenate([left[: upto + 1], window[x + 1 : y], right[onward:]])

    def tree(self, text: bytes, ranges: list[tuple[int, int]], parts: list[np.ndarray]) -> np.ndarray:
        """Joins neighbours in rounds until one encoding is left."""
        while len(parts) > 1:
            joined, spans = [], []
            for n in range(0, len(parts) - 1, 2):
                (low, middle), (_, high) = ranges[n], ranges[n + 1]
                joined.append(self.join(text, low, middle, high, parts[n], parts[n + 1]))
                spans.append((low, high))
            if len(parts) % 2:
                joined.append(parts[-1])
                spans.append(ranges[-1])
            parts, ranges = joined, spans
        return parts[0] if parts else np.zeros(0, np.uint32)


def encode_texts(path: str, texts: list[bytes], leaf: int = LEAF_BYTES) -> list[np.ndarray]:
    """Ids of each text."""
    joiner, out = Joiner(path), []
    for text in texts:
        ranges = halves(text, 0, len(text), leaf)
        out.append(joiner.tree(text, ranges, [joiner.encode(text[a:b]) for a, b in ranges]))
    return out


def id_bytes(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", leaf: int = LEAF_BYTES, wide: int = WIDE_CHARS) -> DataFrame:
    """`docs` with a column `ids`: little-endian 32-bit token ids of the whole text.

    Texts of more than `wide` characters are halved into rows, so that different tasks encode their
    blocks; equal ones are encoded once.
    """
    ids = free_name(docs, ids)
    field = [T.StructField(ids, T.BinaryType())]
    inside = add_columns(
        docs.filter(F.coalesce(F.length(text), F.lit(0)) <= wide), text, field,
        lambda texts: [id_bytes(encode_texts(path, encoded(texts), leaf))],
    )
    key = free_name(docs, "text_key")
    long_rows = docs.filter(F.length(text) > wide).withColumn(key, F.sha2(text, 256))
    distinct = long_rows.groupBy(F.col(key).alias("k")).agg(F.first(text).alias("t"))
    blocks = distinct.select(
        "k", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("t") - 1) / wide).cast("int")), lambda n: F.substring("t", n * wide + 1, wide)
        )).alias("block", "part"),
    )
    # Blocks of one text go to different tasks.
    spread = blocks.repartition("k", "block")
    coded = add_columns(spread, "part", [T.StructField("ids", T.BinaryType())],
                        lambda parts: [id_bytes(encode_texts(path, encoded(parts), leaf))])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        parts = encoded(group.column("part").combine_chunks())
        ends = np.cumsum([len(p) for p in parts])
        ranges = [(int(e) - len(p), int(e)) for p, e in zip(parts, ends, strict=True)]
        arrays = [np.frombuffer(x, "<u4") for x in group.column("ids").to_pylist()]
        whole = Joiner(path).tree(b"".join(parts), ranges, arrays)
        return pa.table({"k": group.column("k")[:1], "ids": id_bytes([whole])})

    whole = coded.groupBy("k").applyInArrow(joined, "k string, ids binary")
    across = long_rows.join(whole.select(F.col("k").alias(key), F.col("ids").alias(ids)), key).select(*docs.columns, ids)
    return inside.union(across)


def decode_ids(path: str, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
    table = byte_table(path)[0]
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`coded` with a column `text` decoded from the ids; null ids give null."""

    def make(lists: pa.Array) -> list[pa.Array]:
        return [pa.array([None if x is None else decode_ids(path, np.frombuffer(x, "<u4")) for x in lists.to_pylist()], pa.string())]

    return add_columns(coded, ids, [T.StructField(free_name(coded, text), T.StringType())], make)


def digests(coded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Number of ids, and SHA-256 of the ids as text and of the decoded text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = [str(n).encode() for n in range(len(byte_table(path)[0]))]
        count, of_ids, of_text = [], [], []
        for raw in batch.column("ids").to_pylist():
            ids = np.frombuffer(raw, "<u4")
            count.append(len(ids))
            of_ids.append(hashlib.sha256(b",".join(map(numbers.__getitem__, ids.tolist()))).hexdigest())
            of_text.append(hashlib.sha256(decode_ids(path, ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(coded.select(F.col(id_column).cast("long").alias("doc_id"), "ids"), "ids", schema, make)
