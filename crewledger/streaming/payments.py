"""Payments as a stream that keeps invoice balances current.

The payment log is the only thing the stream writes; balances are the opening invoices with the
log applied. A crash can therefore not leave log and balances apart. The log itself tells which
payments are known, so the stream keeps no state of its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from crewledger.operators.payments import apply_payments
from crewledger.operators.quality import one_per_key
from crewledger.schemas import schema_of

ID_RANGE, BATCH = "Id_Range", "Batch"
# Payment ids that one folder of the log holds.
RANGE_IDS = 1_000_000
LOG = T.StructType([*schema_of("Payment"), T.StructField(ID_RANGE, T.LongType()), T.StructField(BATCH, T.StringType())])


def id_range() -> Column:
    return F.expr(f"Payment_ID div {RANGE_IDS}")


def payment_log_writer(payments: DataFrame, log: str, checkpoint: str) -> DataStreamWriter:
    """Write each payment id once to the log, whatever is sent again.

    A replayed payment is found in the log, in the folders of the id ranges that its batch touches, so a
    batch costs as much as its own rows and those ranges, however long the log. A batch that is run
    again after a crash writes the same folders again. There is no watermark: it would forget old ids and
    refuse late payments. A lost checkpoint only means that everything is sent again.

    One stream at a time may write to a log. A payment without an id, which the table cannot hold, is left out.
    """
    open_log(payments.sparkSession, log)
    owner = stream_name(payments.sparkSession, checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        append_payments(batch, log, f"{owner}-{number}")

    once = payments.select(schema_of("Payment").names)
    return once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def open_log(spark: SparkSession, log: str) -> None:
    """Make sure that the log can be read, be it empty."""
    spark.createDataFrame([], LOG).write.mode("append").partitionBy(ID_RANGE, BATCH).parquet(log)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lasts as long as the checkpoint: batch numbers start anew in a new one."""
    folder = f"{checkpoint.rstrip('/')}/log_owner"
    try:
        return spark.read.text(folder).first()["value"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.range(1).select(F.uuid().alias("value")).write.text(folder)
    return spark.read.text(folder).first()["value"]


def append_payments(batch: DataFrame, log: str, name: str) -> None:
    """Add the payments of a batch that the log does not have; done again under one name it stays done once.

    The files of a batch stand in folders of their own, one for each range. A batch that was broken off
    halfway takes no notice of what it wrote before and replaces those folders.
    """
    whole = batch.filter(F.col("Payment_ID").isNotNull())
    once = one_per_key(whole, ["Payment_ID"]).withColumn(ID_RANGE, id_range()).persist()
    try:
        new = once.join(known_ids(batch.sparkSession, log, touched_ranges(once), name), [ID_RANGE, "Payment_ID"], "left_anti")
        (new.withColumn(BATCH, F.lit(name)).sortWithinPartitions(ID_RANGE)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ID_RANGE, BATCH).parquet(log))
    finally:
        once.unpersist()


def touched_ranges(payments: DataFrame) -> list[int]:
    """The id ranges of a batch: one number for a million ids, a hundred thousand for 10^11 payments."""
    return sorted(row[0] for row in payments.select(ID_RANGE).distinct().collect())


def known_ids(spark: SparkSession, log: str, ranges: list[int], name: str) -> DataFrame:
    """Ids in the given ranges that other batches wrote; other folders are not listed."""
    stored = spark.read.schema(LOG).parquet(log)
    return stored.filter(F.col(ID_RANGE).isin(ranges) & (F.col(BATCH) != name)).select(ID_RANGE, "Payment_ID")


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log).select(schema_of("Payment").names)


def current_balances(opening: DataFrame, log: DataFrame) -> DataFrame:
    """Invoices with every payment of the log applied."""
    return apply_payments(opening, log)
