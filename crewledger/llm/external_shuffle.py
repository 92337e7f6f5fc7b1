"""Two-pass external shuffle: records are scattered into buckets that fit into memory, each bucket is shuffled.

Law: `key`. A record's shard is the one whose seeded hash with its id is highest, so that one more shard
takes records only into itself. Inside a shard a second hash scatters records over buckets; a bucket
is put into a Fisher-Yates order seeded by its number, and the buckets stand one behind the other.

Defined cases: a null text has size 8 and the checksum of no bytes; a null id is a key of its own; rows
that repeat an id share its shard, and its bucket only if their texts are equal too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import free_name, reach_package

SHARDS, SEED = 24, 20_240
# Text of a bucket, which one task holds at once.
BUCKET_BYTES = 8 << 20


def shard_of(id_column: str, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of id, shard and seed."""
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.struct(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), k).alias("h"), k.alias("k")))
    return F.array_max(ranked)["k"]


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shuffled(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with new last columns for the shard, the grown shard and the slot, in that order."""
    shard, grown, bucket, slot = (free_name(docs, n) for n in ("shard", "grown_shard", "bucket", "slot"))
    total = docs.agg(F.sum(size_of(text))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    scattered = docs.withColumns({
        shard: shard_of(id_column, shards, seed), grown: shard_of(id_column, shards + 1, seed),
        bucket: F.pmod(F.xxhash64(F.lit(seed + 1), id_column, text), F.lit(buckets)),
    })
    sizes = scattered.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket; a window holds those of one shard.
    before = sizes.select(
        shard, bucket, (F.sum("n").over(Window.partitionBy(shard).orderBy(bucket)) - F.col("n")).alias("before"))

    def shuffle(rows: pa.Table, ahead: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_column, "ascending"), (text, "ascending")])
        number = [seed, rows.column(shard)[0].as_py(), rows.column(bucket)[0].as_py()]
        order = np.arange(rows.num_rows)
        np.random.default_rng(number).shuffle(order)
        place = np.argsort(order) + ahead.column("before")[0].as_py()
        return rows.drop_columns([bucket]).append_column(slot, pa.array(place, pa.int64()))

    reach_package(docs.sparkSession)
    schema = T.StructType([*scattered.drop(bucket).schema.fields, T.StructField(slot, T.LongType())])
    # A record moves once, to its bucket; the number of rows ahead of the bucket comes to it there.
    return scattered.groupBy(shard, bucket).cogroup(before.groupBy(shard, bucket)).applyInArrow(shuffle, schema)


def write_shards(rows: DataFrame, folder: str) -> None:
    """Writes shuffled rows as Parquet, a folder per shard, in order of their slots."""
    shard, slot = rows.columns[-3], rows.columns[-1]
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(folder)
