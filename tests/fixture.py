"""A small company made up for the tests; the rows cover the corners the driver tables lack."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import types as T

from crewledger.schemas import SCHEMAS

AS_OF = "2024-07-01"

ROWS = {
    # Clients 2 and 5 share a name.
    "Client": """
        1|Ada Brook|100|ada@x|North Lane
        2|Kim Field|200||South Row
        3|Lee Marsh|||
        4|No Orders||no@x|Hill
        5|Kim Field|500|kim@x|West End
    """,
    "Employee": """
        1|Zoe Hart|Estimator|11|zoe@x|1
        2|Abe Lund|Mower||abe@x|1
        3|Mia Noor||33||0
    """,
    # Estimate 5 has no employee, 6 no hours, 7 no contract.
    "Estimate": """
        1|1|1|North Lane|Hedge|700.00|7.00|2024-01-10
        2|1|1|North Lane|Roof|100.00|3.00|2024-01-31
        3|2|2|South Row|Lawn|250.00|4.00|2024-02-01
        4|5|1|West End|Lawn|300.00|2.00|2023-01-15
        5|2||South Row||80.00|1.00|2024-02-29
        6|3|2||Fence|50.00|0.00|
        7|3|1||Gate|0.00|5.00|2024-03-01
    """,
    # Contract 6 has neither services nor invoices.
    "Contract": """
        1|1|1|2024-01-12|2024-04-12|700.00|Hedge|3 months
        2|2|1|2024-02-01|2024-03-01|100.00|Roof|1 month
        3|3|2|2024-02-02||250.00|Lawn|
        4|4|5|2023-01-16|2023-12-31|300.00|Lawn|1 year
        5|5|2|2024-03-01||80.00||
        6|6|3|2024-03-01||50.00|Fence|
    """,
    # Contract 1 has three services and two invoices; service 7 has no contract, 8 no date.
    "Service": """
        1|1|1|Trim|2024-02-01|100% Palm Court|Trim the north hedge
        2|1|1|Trim|2024-03-01|100% Palm Court|trim again
        3|1|1|Haul|2024-03-02|north lane|
        4|1|2|Roof|2024-07-01|North Lane|Fix ROOF
        5|2|3|Trim|2024-07-02||
        6|5|4|Haul|2023-02-01|West End|Haul
        7|2||Haul|2024-01-01|South Row|
        8|2|5|Roof||South Row|
    """,
    "Service_Employee": """
        1|1
        1|2
        2|2
        3|2
        4|1
        5|3
        6|2
    """,
    # Due 0, 1, 30, 31, 60, 61, 90, 91 days before AS_OF and without a due date.
    "Invoice": """
        1|1|1|2024-02-01|2024-07-01|700.00|350.00|Partial
        2|1|1|2024-03-01|2024-06-30|300.00|300.00|Paid
        3|2|1|2024-03-15|2024-06-01|100.00|0.00|Unpaid
        4|3|2|2024-03-15|2024-05-31|250.00|0.00|Unpaid
        5|4|5|2023-02-01|2024-05-02|300.00|100.00|Partial
        6|4|5|2023-03-01|2024-05-01|300.50|0.00|Unpaid
        7|5|2|2024-03-31|2024-04-02|80.00|0.00|Unpaid
        8|5|2|2024-04-01|2024-04-01|20.00|0.00|Overdue
        9|4|5|||10.00|0.00|Unpaid
        10|5|2|2024-05-01|2024-08-01||5.00|
    """,
    "Payment": """
        1|1|1|350.00|Check|2024-07-01|2024-06-30|Paid
        2|1|2|100.00|Cash|2024-06-30|2024-07-01|Paid
        3|1|2|200.00|Cash|2024-06-30|2024-07-31|Paid
        4|4|5|100.00|Card|2024-05-02|2023-07-04|Paid
        5|2||10.00|Card||2024-07-15|Pending
        6|4|5|1.00|Card||2024-08-01|Paid
    """,
    # Feedback 3 names no service, 4 a service that is not there.
    "Client_Feedback": """
        1|1|1|5|Neat|None|2024-02-03
        2|2|5|3|Slow||2024-02-03
        3|3||4|Kind|More|2024-03-01
        4|5|99|1|Lost||2024-04-01
    """,
    "Referral": """
        1|1|5|Kim Field|2024-01-01|Verified
        2|||bo stone|2024-02-01|Pending
        3|77||Al 100%|2024-02-01|Contacted
        4|2|3|Lee Marsh|2024-03-01|
    """,
    "Job_Costing": """
        1|1|1|7.00|300.00|100.00|400.00|700.00
        2|4|2|3.00|90.00|20.00|110.00|100.00
        3|5|3|4.00|200.00|50.00|250.00|250.00
        4|6||2.00|||310.10|300.00
    """,
}


def parse(text: str, kind: T.DataType):
    if text == "":
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(text)
    return int(text) if isinstance(kind, T.IntegralType) else text


def fixture_rows(table: str) -> list[dict]:
    fields = SCHEMAS[table].fields
    return [
        {field.name: parse(text, field.dataType) for field, text in zip(fields, line.strip().split("|"), strict=True)}
        for line in ROWS[table].strip().splitlines()
    ]


def frame(spark, table: str, rows: list[dict]):
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(row[name] for name in schema.names) for row in rows], schema)


def make_tables(spark) -> dict:
    return {table: frame(spark, table, fixture_rows(table)) for table in SCHEMAS}


def as_dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def column(df, name: str) -> list:
    return [row[name] for row in df.collect()]
