"""Token counts of documents in flat token files without an index, by a scan for the end-of-document id.

Files hold 16-bit little-endian ids and nothing else. Each is cut into blocks; a block finds its
separators in one vectorised comparison, without knowing where its first document began. The number of
separators and the place of the last one go through a prefix scan over the blocks of a file, which
stitches and numbers the documents that cross boundaries.

Defined cases: an empty document counts 0; a file that does not end in a separator has its last ids counted
as one more, unterminated document; an empty file has none; an odd number of bytes raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewledger.llm.frames import map_slices, reach_package, segment_starts, settled, tidy
from crewledger.llm.tokens import pieces_of, special_ids

BLOCK_TOKENS = 1 << 16
# Files are written with about this many documents, and read one at a time.
FILE_DOCUMENTS = 20_000


# Stands for a separator that is part of a text; no token has this id.
SPELLED_OUT = 0xFFFF


def write_flat(docs: DataFrame, folder: str, path: str, separator: int, text: str = "text") -> None:
    """Writes the ids of all texts to flat files in `folder`, each text followed by `separator`.

    A null text is an empty document. A separator within a text is written as SPELLED_OUT and counts as the token it is. A task writes what it reads, so nothing is shuffled. The line end of Spark's
    text writer is the separator's two bytes.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = pieces_of(path).encode(batch.column("text"))
        if len(flat) and flat.max() >= SPELLED_OUT:
            raise ValueError("ids do not fit into 16 bits beside the one that stands for a separator in a text")
        # A text that spells the separator out would end early.
        flat = np.where(flat == separator, SPELLED_OUT, flat)
        starts = segment_starts(counts)
        ids = flat.astype("<u2")
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["ids"])

    ids = map_slices(docs.select(F.col(text).alias("text")), "text", "ids binary", make)
    end = separator.to_bytes(2, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.mode("overwrite").option(
        "lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_DOCUMENTS).text(folder)


def blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of all flat files in a folder.

    Spark reads a flat file whole, up to 2 GB; larger ones must be cut before. The blocks are cut in the JVM and
    handed out from there.
    """
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    count = F.ceil(F.col("length") / size).cast("int")
    cut = files.select(
        # The name without the writing job's random part.
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "").alias("file"),
        F.when(F.col("length") % 2 == 1, F.raise_error("an odd number of bytes")).otherwise(count).alias("n"), "content",
    ).filter("n > 0")
    return cut.select("file", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block")).select(
        "file", "block", F.expr(f"substring(content, block * {size} + 1, {size})").alias("ids"))


def scan_blocks(cut: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, stop, ends) per block: where it stops and where its separators stand, counted from the file's start."""
    reach_package(cut.sparkSession)
    schema = "file string, block int, stop long, ends array<long>"

    def run(batches):
        for batch in batches:
            ends, stops = [], []
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                ends.append(np.flatnonzero(ids == separator) + block * block_tokens)
                stops.append(block * block_tokens + len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ends])]).astype(np.int32)
            flat = np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(stops, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["file", "block", "stop", "ends"])

    return cut.mapInArrow(tidy(run), schema)


def count_documents(spark: SparkSession, folder: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, document, start, n_tokens) of all flat files in a folder; documents are numbered within their file from 0."""
    scanned = settled(scan_blocks(blocks(spark, folder, block_tokens), separator, block_tokens))
    # The prefix scan runs over one narrow row per block, at most 2 GB / 2 / BLOCK_TOKENS of them a file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last_end"))
    carry = summary.select(
        "file", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents_before"),
        F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)).alias("open_since"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )
    carried = scanned.join(carry, ["file", "block"])
    ended = F.expr("transform(ends, (e, i) -> struct(if(i = 0, open_since, ends[i - 1] + 1) as start, e as stop))")
    rest = F.expr("coalesce(array_max(ends) + 1, open_since)")
    unended = F.when(F.col("is_last") & (F.col("stop") > rest), F.array(F.struct(rest.alias("start"), F.col("stop").alias("stop"))))
    found = F.concat(ended, F.coalesce(unended, F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")))
    return carried.select("file", "documents_before", F.posexplode(found).alias("nth", "d")).select(
        "file", (F.col("documents_before") + F.col("nth")).alias("document"), F.col("d.start").alias("start"),
        (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def separator_of(path: str) -> int:
    """The end-of-text id of a tokenizer file."""
    return special_ids(path)["<|endoftext|>"]
