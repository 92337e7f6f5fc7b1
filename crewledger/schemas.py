"""The eleven tables: columns, types, keys and the rules their values obey.

Rules (length, range, allowed values, default) sit in the column metadata, so that the
data-quality checks and the ingest operators read them from one place.
Identifiers are 64-bit: a 32-bit key runs out long before 100 TB of rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
HOURS = T.DecimalType(6, 2)


def _column(name, kind, required=False, **rules):
    return T.StructField(name, kind, not required, rules)


def _id(name, required=False):
    return _column(name, T.LongType(), required)


def _text(name, longest=None, required=False, **rules):
    if longest:
        rules["longest"] = longest
    return _column(name, T.StringType(), required, **rules)


def _money(name, **rules):
    return _column(name, MONEY, **rules)


def _hours(name):
    return _column(name, HOURS)


def _date(name, required=False):
    return _column(name, T.DateType(), required)


# Table and column names, lengths, allowed values and defaults of the data model.
SCHEMAS: dict[str, T.StructType] = {
    "Client": T.StructType([
        _id("Client_ID", True),
        _text("Client_Name", 100, True),
        _text("Client_Phone", 20),
        _text("Client_Email", 100),
        _text("Property_Address", 255),
    ]),
    "Employee": T.StructType([
        _id("Employee_ID", True),
        _text("Employee_Name", 100, True),
        _text("Employee_Role", 50),
        _text("Employee_Phone", 20),
        _text("Employee_Email", 100),
        _column("Is_Available", T.ByteType(), default=1),
    ]),
    "Estimate": T.StructType([
        _id("Estimate_ID", True),
        _id("Client_ID", True),
        _id("Employee_ID"),
        _text("Property_Address", 255),
        _text("Service_Description"),
        _money("Estimated_Cost"),
        _hours("Estimated_Labor_Hours"),
        _date("Estimate_Date"),
    ]),
    "Contract": T.StructType([
        _id("Contract_ID", True),
        _id("Estimate_ID", True),
        _id("Client_ID", True),
        _date("Contract_StartDate"),
        _date("Contract_EndDate"),
        _money("Pricing"),
        _text("Service_Scope"),
        _text("Contract_Duration", 50),
    ]),
    "Service": T.StructType([
        _id("Service_ID", True),
        _id("Client_ID", True),
        _id("Contract_ID"),
        _text("Service_Type", 100),
        _date("Service_Date"),
        _text("Property_Location", 255),
        _text("Service_Description"),
    ]),
    "Service_Employee": T.StructType([
        _id("Service_ID", True),
        _id("Employee_ID", True),
    ]),
    "Invoice": T.StructType([
        _id("Invoice_ID", True),
        _id("Contract_ID", True),
        _id("Client_ID", True),
        _date("Invoice_Date"),
        _date("Due_Date"),
        _money("Total_Amount"),
        _money("Amount_Paid", default="0.00"),
        _text("Invoice_Status", 20, default="Unpaid"),
    ]),
    "Payment": T.StructType([
        _id("Payment_ID", True),
        _id("Contract_ID", True),
        _id("Invoice_ID"),
        _money("Payment_Amount"),
        _text("Payment_Method", 50),
        _date("Due_Date"),
        _date("Payment_Date"),
        _text("Payment_Status", 20, default="Pending"),
    ]),
    "Client_Feedback": T.StructType([
        _id("Feedback_ID", True),
        _id("Client_ID", True),
        _id("Service_ID"),
        _column("Rating", T.ByteType(), least=1, most=5),
        _text("Comments"),
        _text("Suggestions"),
        _date("Feedback_Date"),
    ]),
    "Referral": T.StructType([
        _id("Referral_ID", True),
        _id("Referrer_ID"),
        _id("Referee_ID"),
        _text("Referee_Name", 100, True),
        _date("Referral_Date", True),
        _text("Status", allowed=["Pending", "Contacted", "Verified"], default="Pending"),
    ]),
    "Job_Costing": T.StructType([
        _id("Job_Cost_ID", True),
        _id("Service_ID", True),
        _id("Estimate_ID"),
        _hours("Actual_Labor_Hours"),
        _money("Actual_Labor_Cost"),
        _money("Actual_Materials"),
        _money("Total_Actual_Cost"),
        _money("Total_Estimated_Cost"),
    ]),
}

# Every table is keyed by its first column; the crew assignment by both of its columns.
PRIMARY_KEYS: dict[str, list[str]] = {
    name: schema.names if name == "Service_Employee" else schema.names[:1]
    for name, schema in SCHEMAS.items()
}

# Fixed values: (table, column) -> table whose primary key the column refers to.
FOREIGN_KEYS: dict[tuple[str, str], str] = {
    ("Estimate", "Client_ID"): "Client",
    ("Estimate", "Employee_ID"): "Employee",
    ("Contract", "Estimate_ID"): "Estimate",
    ("Contract", "Client_ID"): "Client",
    ("Service", "Client_ID"): "Client",
    ("Service", "Contract_ID"): "Contract",
    ("Service_Employee", "Service_ID"): "Service",
    ("Service_Employee", "Employee_ID"): "Employee",
    ("Invoice", "Contract_ID"): "Contract",
    ("Invoice", "Client_ID"): "Client",
    ("Payment", "Contract_ID"): "Contract",
    ("Payment", "Invoice_ID"): "Invoice",
    ("Client_Feedback", "Client_ID"): "Client",
    ("Client_Feedback", "Service_ID"): "Service",
    ("Referral", "Referrer_ID"): "Client",
    ("Referral", "Referee_ID"): "Client",
    ("Job_Costing", "Service_ID"): "Service",
    ("Job_Costing", "Estimate_ID"): "Estimate",
}


def schema_of(table: str) -> T.StructType:
    try:
        return SCHEMAS[table]
    except KeyError:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(SCHEMAS)}") from None


def references_of(table: str) -> dict[str, str]:
    """Foreign-key columns of a table and the table each refers to."""
    return {column: parent for (child, column), parent in FOREIGN_KEYS.items() if child == table}
