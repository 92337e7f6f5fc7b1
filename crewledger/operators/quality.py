"""Data-quality checks: a check splits rows into accepted rows and rejects with a reason.

The row rules (required, length, range, allowed values) come from the column metadata of the
schema and are evaluated in one pass. Key checks are joins and aggregates on the keys alone.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.functions.text import blank_to_null
from crewledger.operators.joins import lookup
from crewledger.schemas import PRIMARY_KEYS, SCHEMAS, references_of, schema_of
from crewledger.sources.tables import Tables

REASON = "reason"
Rule = tuple[Column, str]


class Checked(NamedTuple):
    accepted: DataFrame
    rejects: DataFrame


def flag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the reason of the first rule a row breaks; a reason already there stays."""
    reasons = [F.when(broken, F.lit(reason)) for broken, reason in rules]
    if REASON in df.columns:
        reasons.insert(0, F.col(REASON))
    return df.withColumn(REASON, F.coalesce(*reasons, F.lit(None).cast("string")))


def split(flagged: DataFrame) -> Checked:
    good = F.col(REASON).isNull()
    return Checked(flagged.filter(good).drop(REASON), flagged.filter(~good))


def required_rules(columns: list[str]) -> list[Rule]:
    """A value is missing when it is NULL or blank."""
    return [(blank_to_null(F.col(c).cast("string")).isNull(), f"{c} is required") for c in columns]


def length_rules(table: str, columns: list[str] | None = None) -> list[Rule]:
    return [
        (F.length(field.name) > field.metadata["longest"],
         f"{field.name} is longer than {field.metadata['longest']}")
        for field in schema_of(table)
        if "longest" in field.metadata and (columns is None or field.name in columns)
    ]


def number_rules(table: str, columns: list[str] | None = None) -> list[Rule]:
    """Numbers that are no number or do not fit the column's decimal, as text or as a wider number."""
    return [
        (F.col(field.name).isNotNull()
         & F.expr(f"try_cast(`{field.name}` AS {field.dataType.simpleString()})").isNull(),
         f"{field.name} does not fit {field.dataType.simpleString()}")
        for field in schema_of(table)
        if isinstance(field.dataType, T.DecimalType) and (columns is None or field.name in columns)
    ]


def value_rules(table: str, columns: list[str] | None = None) -> list[Rule]:
    """Ranges and allowed values; NULL passes."""
    rules = []
    for field in schema_of(table):
        if columns is not None and field.name not in columns:
            continue
        allowed = field.metadata.get("allowed")
        if allowed:
            rules.append((~F.col(field.name).isin(allowed), f"{field.name} is not one of {', '.join(allowed)}"))
        if "least" in field.metadata:
            least, most = field.metadata["least"], field.metadata["most"]
            rules.append((~F.col(field.name).between(least, most), f"{field.name} is not in {least}..{most}"))
    return rules


def check_required(df: DataFrame, columns: list[str]) -> Checked:
    return split(flag(df, required_rules(columns)))


def check_sizes(df: DataFrame, table: str) -> Checked:
    present = df.columns
    return split(flag(df, length_rules(table, present) + number_rules(table, present)))


def check_values(df: DataFrame, table: str) -> Checked:
    return split(flag(df, value_rules(table, df.columns)))


def flag_unknown_parent(
    df: DataFrame, column: str, parents: DataFrame, row_key: str | list[str]
) -> DataFrame:
    """Flag rows whose key is not the (first-column) key of any parent; rows without a key pass.

    Parents are made distinct first, so that one stored twice does not multiply the rows.
    """
    known = parents.select(F.col(parents.columns[0]).alias(column)).distinct().withColumn("_known", F.lit(True))
    broken = F.col(column).isNotNull() & F.col("_known").isNull()
    return flag(lookup(df, known, column, row_key), [(broken, f"{column} is unknown")]).drop("_known")


def check_foreign_key(
    df: DataFrame, column: str, parents: DataFrame, row_key: str | list[str]
) -> Checked:
    return split(flag_unknown_parent(df, column, parents, row_key))


def check_foreign_keys(tables: Tables, table: str) -> Checked:
    """All foreign keys of a stored table."""
    rows = tables[table]
    for column, parent in references_of(table).items():
        rows = flag_unknown_parent(rows, column, tables[parent], PRIMARY_KEYS[table])
    return split(rows)


def unknown_keys(rows: DataFrame, references: dict[str, str], tables: Tables) -> DataFrame:
    """(key, missing): the keys that rows name and some parent does not have, with a bit for each such parent.

    `references` names the parent of each column. All columns are unpivoted into one list of distinct keys, each with the
    parents it is looked up in, so the rows are read once however many keys they carry. Every parent
    is read once and reduced to the keys named. Bits follow `parent_bits`.
    """
    bits = parent_bits(references)
    asked = rows.select(F.explode(F.array(*[
        F.struct(F.expr(f"try_cast(`{column}` AS bigint)").alias("key"), F.lit(bits[parent]).alias("parent"))
        for column, parent in references.items()])).alias("k")).filter("k.key IS NOT NULL").groupBy(
            F.col("k.key").alias("key")).agg(F.bit_or("k.parent").alias("asked"))
    found = functools.reduce(DataFrame.unionAll, [
        tables[parent].select(F.col(tables[parent].columns[0]).alias("key")).join(
            asked.filter(F.col("asked").bitwiseAND(bit) != 0), "key", "left_semi").select("key", F.lit(bit).alias("found"))
        for parent, bit in bits.items()]).groupBy("key").agg(F.bit_or("found").alias("found"))
    missing = F.col("asked").bitwiseAND(F.bitwise_not(F.coalesce("found", F.lit(0))))
    return asked.join(found, "key", "left").select("key", missing.alias("missing")).filter("missing <> 0")


def parent_bits(references: dict[str, str]) -> dict[str, int]:
    return {parent: 1 << n for n, parent in enumerate(dict.fromkeys(references.values()))}


def flag_unknown_keys(
    df: DataFrame, references: dict[str, str], tables: Tables, row_key: str | list[str], keys: DataFrame | None = None
) -> DataFrame:
    """Flag rows that name a key no parent has; rows without a key pass. `keys` are the rows to take the keys from, if not `df`.

    All columns are matched with one and the same list of unknown keys, which is computed once.
    """
    if not references:
        return df
    bits = parent_bits(references)
    unknown = unknown_keys(df if keys is None else keys, references, tables)
    rules, found = [], df
    for column, parent in references.items():
        name = f"_missing_{column}"
        found = lookup(found, unknown.select(F.col("key").alias(column), F.col("missing").alias(name)), column, row_key)
        rules.append((F.coalesce(F.col(name).bitwiseAND(bits[parent]) != 0, F.lit(False)), f"{column} is unknown"))
    return flag(found, rules).drop(*[f"_missing_{column}" for column in references])


def orphan_counts(tables: Tables, table: str) -> DataFrame:
    """Rejected rows of a stored table by reason."""
    rejects = check_foreign_keys(tables, table).rejects
    return rejects.groupBy(REASON).agg(F.count(F.lit(1)).alias("Row_Count"))


def all_orphan_counts(tables: Tables) -> DataFrame:
    """Rejected rows by table and reason, over every foreign key that is declared."""
    parts = []
    for table in SCHEMAS:
        for column, parent in references_of(table).items():
            rejects = check_foreign_key(tables[table], column, tables[parent], PRIMARY_KEYS[table]).rejects
            parts.append(rejects.groupBy(REASON).agg(F.count(F.lit(1)).alias("Row_Count")).select(
                F.lit(table).alias("Table_Name"), F.lit(column).alias("Column_Name"), "Row_Count"))
    return functools.reduce(DataFrame.unionAll, parts)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("Row_Count")).filter(F.col("Row_Count") > 1)


def check_unique(df: DataFrame, key: list[str]) -> Checked:
    """Accept rows whose key occurs once; rows of a repeated key, or with a NULL in it, are rejected.

    Counts combine on the map side, so a key held by most rows reaches the join as one row.
    """
    missing = F.lit(False)
    for column in key:
        missing = missing | F.col(column).isNull()
    whole = df.filter(~missing)
    repeated = duplicate_keys(whole, key).select(key)
    rejects = whole.join(repeated, key, "left_semi").withColumn(REASON, F.lit(f"{', '.join(key)} is not unique"))
    absent = df.filter(missing).withColumn(REASON, F.lit(f"{', '.join(key)} is required"))
    return Checked(whole.join(repeated, key, "left_anti"), rejects.unionByName(absent))


def one_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the least by all other columns, so that a rerun keeps the same row."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(key).agg(F.min(F.struct(others)).alias("_row")).select(*key, "_row.*").select(df.columns)


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Declared default values in place of NULL or absent columns."""
    filled = {}
    for field in schema_of(table):
        if "default" in field.metadata:
            default = F.lit(field.metadata["default"]).cast(field.dataType)
            filled[field.name] = F.coalesce(F.col(field.name), default) if field.name in df.columns else default
    return df.withColumns(filled) if filled else df
