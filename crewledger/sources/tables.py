"""Scans and sinks of the eleven tables.

Scans always carry the declared schema: nothing is inferred, so no job runs before the query and
every column the query does not use is pruned from the read.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.functions.dates import as_of_date, days_after, in_period
from crewledger.schemas import PRIMARY_KEYS, SCHEMAS, schema_of

Tables = dict[str, DataFrame]

# Date column whose year lays out a large table on disk.
PARTITION_DATE = {
    "Estimate": "Estimate_Date",
    "Service": "Service_Date",
    "Invoice": "Invoice_Date",
    "Payment": "Payment_Date",
}
STORED_YEAR = "Stored_Year"
# The submission a row came from, where it is known. Files carry it beside the declared columns.
SUBMISSION, SUBMITTED = "submission_id", "Stored_Submission"


def read_table(
    spark: SparkSession, path: str, table: str, fmt: str = "parquet", stored_years: bool = False
) -> DataFrame:
    """The declared columns of a table and, with `stored_years`, the year a large one is laid out by.

    Reports of a period then list only the folders of its year (`in_stored_period`).
    """
    schema = schema_of(table)
    if stored_years and table in PARTITION_DATE:
        schema = T.StructType([*schema, T.StructField(STORED_YEAR, T.IntegerType())])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(fmt).load(f"{path.rstrip('/')}/{table}").select(schema.names)


def load_tables(
    spark: SparkSession, path: str, fmt: str = "parquet", names: Iterable[str] = SCHEMAS, stored_years: bool | None = None
) -> Tables:
    """All tables below one folder, each in a sub-folder of its own name; from Parquet with their stored years."""
    years = fmt == "parquet" if stored_years is None else stored_years
    return {name: read_table(spark, path, name, fmt, years) for name in names}


def in_stored_year(rows: DataFrame, year: Column) -> DataFrame:
    """Rows that may be dated in `year`, by their folder; all of them where no folder is known."""
    if STORED_YEAR not in rows.columns:
        return rows
    # Files outside a year's folder have no stored year. They stay for the filter on the date.
    return rows.filter(F.coalesce(F.col(STORED_YEAR) == year, F.lit(True)))


def in_stored_period(rows: DataFrame, date: str, month: int | None, year: int | None) -> DataFrame:
    """Rows dated in a month and/or year, None being open; folders of other years are not listed."""
    condition = in_period(F.col(date), month, year)
    if condition is None:
        return rows
    return (rows if year is None else in_stored_year(rows, F.lit(year))).filter(condition)


def jdbc_options(url: str, table: str, least: int, most: int, partitions: int) -> dict[str, str]:
    """Options of a parallel database read, split on the first key column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": PRIMARY_KEYS[table][0],
        "lowerBound": str(least),
        "upperBound": str(most),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_jdbc(
    spark: SparkSession, url: str, table: str, least: int, most: int, partitions: int, **extra: str
) -> DataFrame:
    """A table of a relational database; its driver must be on the class path."""
    options = jdbc_options(url, table, least, most, partitions)
    rows = spark.read.format("jdbc").options(**options, **extra).load()
    present = set(rows.columns)
    return rows.select([
        (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema_of(table)
    ])


def with_virtual(df: DataFrame, as_of: str | datetime.date | None = None) -> DataFrame:
    """Add the computed columns an invoice or a job-cost row carries."""
    if "Due_Date" in df.columns and "Invoice_Status" in df.columns:
        df = df.withColumn("Days_Outstanding", days_after(as_of_date(as_of), F.col("Due_Date")))
    if "Total_Actual_Cost" in df.columns:
        df = df.withColumn("Variance", F.col("Total_Actual_Cost") - F.col("Total_Estimated_Cost"))
    return df


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines in column order; NULLs are kept and dates are ISO text."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _declared(field: T.StructField) -> Column:
    """The column in its declared type; an error where a value does not fit."""
    typed = F.expr(f"try_cast(`{field.name}` AS {field.dataType.simpleString()})")
    lost = F.col(field.name).isNotNull() & typed.isNull()
    problem = F.raise_error(F.lit(f"{field.name} does not fit {field.dataType.simpleString()}"))
    return F.when(lost, problem).otherwise(typed).cast(field.dataType).alias(field.name)


def append(df: DataFrame, path: str, table: str) -> None:
    """Append rows in the declared types; large tables are laid out by the year of their date.

    A value that does not fit its declared type stops the write: stored, it could not be read back.
    The submission of a row, if `df` has one, goes into the same files: what is stored and what is known to
    be stored can then not come apart (`stored_submissions`).
    """
    submitted = [F.col(SUBMISSION).cast("string").alias(SUBMITTED)] if SUBMISSION in df.columns else []
    rows = df.select([_declared(field) for field in schema_of(table)] + submitted)
    date = PARTITION_DATE.get(table)
    target = f"{path.rstrip('/')}/{table}"
    if date is None:
        rows.write.mode("append").parquet(target)
    else:
        # Sorting by year inside each task keeps one open file per task without a shuffle, so a
        # year that holds most rows stays spread over all tasks.
        (rows.withColumn(STORED_YEAR, F.year(date)).sortWithinPartitions(STORED_YEAR)
         .write.mode("append").partitionBy(STORED_YEAR).parquet(target))


def stored_submissions(spark: SparkSession, path: str, table: str, submissions: DataFrame) -> DataFrame:
    """(Stored_Submission, key) of the given submissions that the table has rows of; two columns of the files are read."""
    key = schema_of(table)[0]
    named = submissions.select(F.col(SUBMISSION).cast("string").alias(SUBMITTED)).distinct()
    schema = T.StructType([key, T.StructField(SUBMITTED, T.StringType())])
    target = f"{path.rstrip('/')}/{table}"
    try:
        stored = spark.read.schema(schema).parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.select(SUBMITTED, key.name).filter(F.col(SUBMITTED).isNotNull()).join(named, SUBMITTED, "left_semi")


def without_stored(spark: SparkSession, path: str, table: str, submissions: DataFrame) -> DataFrame:
    """The submissions that the table has no rows of."""
    stored = stored_submissions(spark, path, table, submissions).select(F.col(SUBMITTED).alias("_stored")).distinct()
    return submissions.join(stored, F.col(SUBMISSION).cast("string") == F.col("_stored"), "left_anti")


def scan_years(
    spark: SparkSession, path: str, table: str, first: int, last: int
) -> DataFrame:
    """Rows of the years first..last of a table written by `append`; other years are not listed."""
    schema = T.StructType([*schema_of(table), T.StructField(STORED_YEAR, T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{table}")
    return rows.filter(F.col(STORED_YEAR).between(first, last)).drop(STORED_YEAR)

