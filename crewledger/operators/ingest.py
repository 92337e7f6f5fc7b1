"""Batches of form submissions checked and turned into table rows.

Every operator takes a DataFrame of submissions with the form's field names and a unique
`submission_id`, and returns the rows to append per table and the rejects with a reason. Absent
fields count as NULL. Nothing is written here; see `sources.tables.append`.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewledger.functions.dates import as_of_date, default_due_date
from crewledger.functions.status import budget_status, new_invoice_status
from crewledger.functions.text import blank_to_null
from crewledger.operators.order import numbered
from crewledger.operators.quality import (
    REASON, Checked, Rule, flag, flag_unknown_keys, length_rules, number_rules, required_rules, split, value_rules,
)
from crewledger.schemas import PRIMARY_KEYS, SCHEMAS, references_of, schema_of
from crewledger.session import use_checkpoints
from crewledger.sources.tables import SUBMISSION, SUBMITTED, Tables, append, stored_submissions, without_stored

Rows = dict[str, DataFrame]


class Ingested:
    """What a batch becomes: the rows to append per table, and the rejects with a reason.

    `rejects` alone are lazy. The first use of `rows` evaluates the checked batch once, into the cluster's checkpoint
    folder; rows of all tables and the rejects are then read from there.
    """

    def __init__(self, flagged: DataFrame, build: Callable[[DataFrame, Starts], Rows], keyed: Tables | None = None) -> None:
        self._flagged, self._build, self._keyed = flagged, build, keyed or {}

    @functools.cached_property
    def _checked(self) -> Checked:
        use_checkpoints(self._flagged.sparkSession)
        self._flagged = self._flagged.checkpoint()
        return split(self._flagged)

    @functools.cached_property
    def rows(self) -> Rows:
        return self._build(self._checked.accepted, self._keyed)

    @property
    def rejects(self) -> DataFrame:
        return split(self._flagged).rejects.select(SUBMISSION, REASON)

    def settled(self) -> Ingested:
        """The same with the greatest ids in use looked up now.

        Take this before writing more than one of the tables: ids then do not depend on what has
        been written in between.
        """
        greatest = {table: _greatest(rows).first()[0] for table, rows in self._keyed.items()}
        fixed = Ingested(self._flagged, self._build, greatest)
        fixed._checked = self._checked
        fixed._flagged = self._flagged
        return fixed


def _greatest(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.max(table.columns[0]), F.lit(0)).cast("bigint"))


Starts = dict[str, "DataFrame | int"]


def assign_ids(df: DataFrame, id_column: str, existing: DataFrame | int, checkpointed: bool = False) -> DataFrame:
    """Consecutive ids after the greatest existing one, without moving or sorting a row.

    Rows are numbered where they lie in a checkpoint, so a recomputed task gives them the same ids again. `existing`
    is the table the rows will join (keyed by its first column) or its greatest id. Rows that come straight from a
    checkpoint by narrow steps (`checkpointed`) are not written once more.
    """
    if not checkpointed:
        use_checkpoints(df.sparkSession)
        df = df.checkpoint()
    start = _greatest(existing).scalar() if isinstance(existing, DataFrame) else F.lit(existing).cast("bigint")
    return numbered(df, "_number").withColumn(id_column, start + F.col("_number")).drop("_number")


def ingest_once(
    operator: Callable[..., Ingested], submissions: DataFrame, tables: Tables, path: str, last_table: str, **options
) -> Ingested:
    """Run an ingest operator on the submissions that are not stored yet and append its rows below `path`.

    Rows carry their submission into the files, so a batch sent again, or run again after a crash, stores nothing
    twice. A form that makes rows of two tables counts as stored with the last of them; rows of the first that a
    crash left behind are kept and their ids used. One job at a time may write to a table.
    """
    spark = submissions.sparkSession
    done = operator(without_stored(spark, path, last_table, submissions), tables, **options).settled()
    known: dict[str, DataFrame] = {}
    for table in [*(t for t in done.rows if t != last_table), last_table]:
        rows = done.rows[table]
        for parent, stored in known.items():
            key = stored.columns[1]
            if key in rows.columns:
                rows = rows.withColumn(SUBMITTED, F.col(SUBMISSION).cast("string")).join(
                    stored.withColumnRenamed(key, "_stored_key"), SUBMITTED, "left").withColumn(
                        key, F.coalesce("_stored_key", key)).drop("_stored_key", SUBMITTED)
        if table != last_table:
            known[table] = stored_submissions(spark, path, table, rows).checkpoint()
            rows = without_stored(spark, path, table, rows)
        append(rows, path, table)
    return done


def _clean(text: str) -> Column:
    return blank_to_null(F.col(text))


def _or_zero(field: str) -> Column:
    """The field as text, `0` where it is NULL; text that is no number stays for the checks."""
    return F.coalesce(F.col(field).cast("string"), F.lit("0"))


def _filled_or_zero(field: str) -> Column:
    """As above, with blank text taken for 0 as well."""
    return F.coalesce(_clean(field), F.lit("0"))


def _with_fields(submissions: DataFrame, fields: list[str]) -> DataFrame:
    absent = {f: F.lit(None).cast("string") for f in fields if f not in submissions.columns}
    return submissions.withColumns(absent) if absent else submissions


def _number(column: str, kind: str) -> Column:
    return F.expr(f"try_cast(`{column}` AS {kind})")


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Cast the columns of a table after its rules have passed; a bad value is NULL, not an error."""
    return df.withColumns({
        field.name: _number(field.name, field.dataType.simpleString())
        for field in schema_of(table) if field.name in df.columns
    })


def _malformed_rules(table: str, columns: list[str]) -> list[Rule]:
    """Ids, small numbers and dates that cannot be read as such."""
    rules = []
    for field in schema_of(table):
        kind = field.dataType.simpleString()
        if field.name in columns and kind in ("bigint", "tinyint", "date"):
            unread = F.col(field.name).isNotNull() & _number(field.name, kind).isNull()
            rules.append((unread, f"{field.name} is not a {kind}"))
    return rules


def positive_rules(columns: list[str]) -> list[Rule]:
    """Amounts that a form page asks for: absent, 0 and less are refused."""
    return [(F.coalesce(F.col(c) <= 0, F.lit(True)), f"{c} is not positive") for c in columns]


def _check(
    rows: DataFrame, table: str, tables: Tables, required: list[str], further: list[Rule] | None = None, keys: dict[str, str] | None = None
) -> DataFrame:
    """Flag what the table's declaration rejects. Row rules first, `further` ones on typed values, then the keys referred to.

    The batch is read twice, for its keys and for its rows, and each table it refers to once.
    """
    own = [c for c in schema_of(table).names if c in rows.columns]
    rules = required_rules(required) + _malformed_rules(table, own) + length_rules(table, own) + number_rules(table, own)
    flagged = _typed(flag(rows, rules), table)
    flagged = flag(flagged, value_rules(table, own) + (further or []))
    if keys is None:
        keys = {column: parent for column, parent in references_of(table).items() if column in own}
    return flag_unknown_keys(flagged, keys, tables, SUBMISSION, keys=rows)


def _finish(flagged: DataFrame, table: str, tables: Tables, also: dict[str, Column] | None = None) -> Ingested:
    def build(accepted: DataFrame, starts: Starts) -> Rows:
        numbered_rows = assign_ids(accepted, PRIMARY_KEYS[table][0], starts[table], checkpointed=True)
        return {table: numbered_rows.select(SUBMISSION, *schema_of(table).names).withColumns(also or {})}

    return Ingested(flagged, build, {table: tables[table]})


def _rename(submissions: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return submissions.select(SUBMISSION, *[value.alias(name) for name, value in columns.items()])


def ingest_feedback(submissions: DataFrame, tables: Tables, as_of: str | datetime.date | None = None) -> Ingested:
    """Feedback of an existing client, optionally on a service, dated `as_of`."""
    fields = _with_fields(submissions, ["client_id", "service_id", "rating", "comments", "suggestions"])
    rows = _rename(fields, {
        "Client_ID": F.col("client_id"),
        "Service_ID": _clean("service_id"),
        "Rating": F.col("rating"),
        "Comments": F.coalesce("comments", F.lit("")),
        "Suggestions": F.coalesce("suggestions", F.lit("")),
        "Feedback_Date": as_of_date(as_of),
    })
    return _finish(_check(rows, "Client_Feedback", tables, ["Client_ID"]), "Client_Feedback", tables)


def ingest_estimate_requests(
    submissions: DataFrame, tables: Tables, as_of: str | datetime.date | None = None
) -> Ingested:
    """Requests of new clients: each becomes a client and an unassigned estimate for that client."""
    fields = _with_fields(submissions, [
        "client_name", "client_phone", "client_email", "property_address", "service_description",
        "estimated_cost", "estimated_labor_hours"])
    rows = _rename(fields, {
        "Client_Name": _clean("client_name"),
        "Client_Phone": _clean("client_phone"),
        "Client_Email": _clean("client_email"),
        "Property_Address": _clean("property_address"),
        "Service_Description": _clean("service_description"),
        "Estimated_Cost": _filled_or_zero("estimated_cost"),
        "Estimated_Labor_Hours": _filled_or_zero("estimated_labor_hours"),
    })
    flagged = _check(rows, "Client", {}, ["Client_Name", "Property_Address", "Service_Description"])
    numbers = ["Estimated_Cost", "Estimated_Labor_Hours"]

    def build(accepted: DataFrame, starts: Starts) -> Rows:
        both = assign_ids(assign_ids(accepted, "Client_ID", starts["Client"], checkpointed=True), "Estimate_ID", starts["Estimate"], checkpointed=True)
        filled = both.withColumns({"Employee_ID": F.lit(None).cast("bigint"), "Estimate_Date": as_of_date(as_of)})
        return {table: filled.select(SUBMISSION, *schema_of(table).names) for table in ("Client", "Estimate")}

    checked = _typed(flag(flagged, number_rules("Estimate", numbers)), "Estimate")
    return Ingested(checked, build, {table: tables[table] for table in ("Client", "Estimate")})


def ingest_clients(submissions: DataFrame, tables: Tables) -> Ingested:
    fields = _with_fields(submissions, ["client_name", "client_phone", "client_email", "property_address"])
    rows = _rename(fields, {
        "Client_Name": _clean("client_name"),
        "Client_Phone": F.col("client_phone"),
        "Client_Email": F.col("client_email"),
        "Property_Address": F.col("property_address"),
    })
    return _finish(_check(rows, "Client", tables, ["Client_Name"]), "Client", tables)


def ingest_contracts(submissions: DataFrame, tables: Tables, strict: bool = False, with_scope: bool = False) -> Ingested:
    """Contracts on an existing estimate of an existing client, with a positive price.

    `strict` also asks for both dates, as the form page does, `with_scope` for the scope, as the billing page does.
    """
    fields = _with_fields(submissions, [
        "estimate_id", "client_id", "start_date", "end_date", "pricing", "service_scope", "duration"])
    rows = _rename(fields, {
        "Estimate_ID": F.col("estimate_id"),
        "Client_ID": F.col("client_id"),
        "Contract_StartDate": F.col("start_date"),
        "Contract_EndDate": F.col("end_date"),
        "Pricing": F.col("pricing"),
        "Service_Scope": F.col("service_scope"),
        "Contract_Duration": F.col("duration"),
    })
    asked = ["Contract_StartDate", "Contract_EndDate"] * strict + ["Service_Scope"] * with_scope
    flagged = _check(rows, "Contract", tables, ["Estimate_ID", "Client_ID", "Pricing", *asked])
    flagged = flag(flagged, [(F.col("Pricing") <= 0, "Pricing is not positive")])
    return _finish(flagged, "Contract", tables)


def ingest_estimates(submissions: DataFrame, tables: Tables, with_costing: bool = True, strict: bool = False) -> Ingested:
    """Estimates; a submission that names a service and its actual cost also becomes a job-cost row.

    Both rows are kept or neither. Employees submit without costing. `strict` also asks for address, description,
    date, and a positive cost and number of hours, as the form page does.
    """
    costs = ["actual_labor_hours", "actual_labor_cost", "actual_materials", "total_actual_cost"]
    fields = _with_fields(submissions, [
        "client_id", "employee_id", "property_address", "service_description", "estimated_cost",
        "estimated_labor_hours", "estimate_date", "service_id", "total_estimated_cost", *costs])
    rows = _rename(fields, {
        "Client_ID": F.col("client_id"),
        "Employee_ID": _clean("employee_id"),
        "Property_Address": F.col("property_address"),
        "Service_Description": F.col("service_description"),
        "Estimated_Cost": _filled_or_zero("estimated_cost"),
        "Estimated_Labor_Hours": _filled_or_zero("estimated_labor_hours"),
        "Estimate_Date": F.col("estimate_date"),
        "Service_ID": _clean("service_id"),
        "Actual_Labor_Hours": _filled_or_zero("actual_labor_hours"),
        "Actual_Labor_Cost": _filled_or_zero("actual_labor_cost"),
        "Actual_Materials": _filled_or_zero("actual_materials"),
        "Total_Actual_Cost": F.col("total_actual_cost"),
        "Total_Estimated_Cost": F.when(
            _number("total_estimated_cost", "decimal(10,2)") == 0, _filled_or_zero("estimated_cost"),
        ).otherwise(F.coalesce(_clean("total_estimated_cost"), _filled_or_zero("estimated_cost"))),
    })
    costing = [c for c in SCHEMAS["Job_Costing"].names if c in rows.columns]
    if not with_costing:
        rows = rows.drop(*costing)
    asked = ["Property_Address", "Service_Description", "Estimate_Date"] if strict else []
    further = positive_rules(["Estimated_Cost", "Estimated_Labor_Hours"]) if strict else []
    keys = {column: parent for column, parent in references_of("Estimate").items() if column in rows.columns}
    flagged, named = _check(rows, "Estimate", tables, ["Client_ID", *asked], further, keys={}), rows
    if with_costing:
        # The service only matters to submissions that carry costs.
        carried = _number("Service_ID", "bigint").isNotNull() & (_number("Service_ID", "bigint") != 0) & (
            F.coalesce(_number("Total_Actual_Cost", "decimal(10,2)"), F.lit(0)) != 0)
        named = rows.withColumn("Service_ID", F.when(carried, F.col("Service_ID")))
        rules = _malformed_rules("Job_Costing", costing) + number_rules("Job_Costing", costing)
        keys["Service_ID"] = "Service"
        flagged = _typed(flag(flagged, rules), "Job_Costing").withColumn("Service_ID", F.when(carried, F.col("Service_ID")))
    flagged = flag_unknown_keys(flagged, keys, tables, SUBMISSION, keys=named)

    def build(accepted: DataFrame, starts: Starts) -> Rows:
        estimates = assign_ids(accepted, "Estimate_ID", starts["Estimate"], checkpointed=True)
        output = {"Estimate": estimates.select(SUBMISSION, *schema_of("Estimate").names)}
        if with_costing:
            costed = assign_ids(estimates.filter(F.col("Service_ID").isNotNull()), "Job_Cost_ID", starts["Job_Costing"], checkpointed=True)
            output["Job_Costing"] = costed.select(SUBMISSION, *schema_of("Job_Costing").names)
        return output

    return Ingested(flagged, build, {table: tables[table] for table in ("Estimate", "Job_Costing")[: 1 + with_costing]})


def ingest_invoices(submissions: DataFrame, tables: Tables, strict: bool = False) -> Ingested:
    """Invoices on an existing contract, their status derived from the amounts.

    `strict` also asks for both dates and a positive total, as the form page does.
    """
    fields = _with_fields(submissions, [
        "contract_id", "client_id", "invoice_date", "due_date", "total_amount", "amount_paid"])
    rows = _rename(fields, {
        "Contract_ID": F.col("contract_id"),
        "Client_ID": F.col("client_id"),
        "Invoice_Date": F.col("invoice_date"),
        "Due_Date": F.col("due_date"),
        "Total_Amount": _or_zero("total_amount"),
        "Amount_Paid": _or_zero("amount_paid"),
    })
    asked = ["Invoice_Date", "Due_Date"] if strict else []
    further = positive_rules(["Total_Amount"]) if strict else []
    flagged = _check(rows, "Invoice", tables, ["Contract_ID", "Client_ID", *asked], further).withColumns({
        "Due_Date": default_due_date(F.col("Due_Date"), F.col("Invoice_Date")),
        "Invoice_Status": new_invoice_status(F.col("Total_Amount"), F.col("Amount_Paid")),
    })
    return _finish(flagged, "Invoice", tables)


def ingest_payments(submissions: DataFrame, tables: Tables, strict: bool = False) -> Ingested:
    """Payments on an existing contract and, where named, an existing invoice; stored as Paid.

    `strict` also asks for an invoice and a positive amount, as the form page does. `apply_payments` carries the accepted rows over to the invoices.
    """
    fields = _with_fields(submissions, [
        "contract_id", "invoice_id", "payment_amount", "payment_method", "due_date", "payment_date"])
    rows = _rename(fields, {
        "Contract_ID": F.col("contract_id"),
        "Invoice_ID": F.col("invoice_id"),
        "Payment_Amount": F.col("payment_amount"),
        "Payment_Method": F.col("payment_method"),
        "Due_Date": F.col("due_date"),
        "Payment_Date": F.col("payment_date"),
        "Payment_Status": F.lit("Paid"),
    })
    asked = ["Invoice_ID"] if strict else []
    further = positive_rules(["Payment_Amount"]) if strict else []
    flagged = _check(rows, "Payment", tables, ["Contract_ID", "Payment_Amount", *asked], further)
    return _finish(flagged, "Payment", tables)


def ingest_job_costing(submissions: DataFrame, tables: Tables, strict: bool = False) -> Ingested:
    """Job-cost rows of an existing service, with variance and budget status beside them.

    `strict` also asks for positive totals, as the form page does.
    """
    fields = _with_fields(submissions, [
        "service_id", "estimate_id", "actual_labor_hours", "actual_labor_cost", "actual_materials",
        "total_actual_cost", "total_estimated_cost"])
    rows = _rename(fields, {
        "Service_ID": _clean("service_id"),
        "Estimate_ID": _clean("estimate_id"),
        "Actual_Labor_Hours": _filled_or_zero("actual_labor_hours"),
        "Actual_Labor_Cost": _filled_or_zero("actual_labor_cost"),
        "Actual_Materials": _filled_or_zero("actual_materials"),
        "Total_Actual_Cost": _filled_or_zero("total_actual_cost"),
        "Total_Estimated_Cost": _filled_or_zero("total_estimated_cost"),
    })
    further = positive_rules(["Total_Actual_Cost", "Total_Estimated_Cost"]) if strict else []
    variance = F.round(F.col("Total_Actual_Cost") - F.col("Total_Estimated_Cost"), 2)
    beside = {"Variance": variance, "Budget_Status": budget_status(variance)}
    return _finish(_check(rows, "Job_Costing", tables, ["Service_ID"], further), "Job_Costing", tables, also=beside)


def ingest_employees(submissions: DataFrame, tables: Tables) -> Ingested:
    """New employees, available from the start."""
    fields = _with_fields(submissions, ["employee_name", "employee_role", "employee_phone", "employee_email"])
    rows = _rename(fields, {
        "Employee_Name": _clean("employee_name"),
        "Employee_Role": _clean("employee_role"),
        "Employee_Phone": _clean("employee_phone"),
        "Employee_Email": _clean("employee_email"),
        "Is_Available": F.lit(1).cast("tinyint"),
    })
    flagged = _check(rows, "Employee", tables, ["Employee_Name", "Employee_Role"])
    return _finish(flagged, "Employee", tables)


def ingest_referrals(submissions: DataFrame, tables: Tables, as_of: str | datetime.date | None = None) -> Ingested:
    """Referrals by name, pending from `as_of`, with the referrer where known."""
    fields = _with_fields(submissions, ["referee_name", "referrer_id"])
    rows = _rename(fields, {
        "Referrer_ID": _clean("referrer_id"),
        "Referee_ID": F.lit(None).cast("bigint"),
        "Referee_Name": _clean("referee_name"),
        "Referral_Date": as_of_date(as_of),
        "Status": F.lit("Pending"),
    })
    return _finish(_check(rows, "Referral", tables, ["Referee_Name"]), "Referral", tables)


def apply_status_changes(submissions: DataFrame, tables: Tables) -> Ingested:
    """The employees after a batch of availability changes; the last change of an employee counts.

    Changes are reduced to one per employee before they meet the table.
    """
    employees = tables["Employee"]
    fields = _with_fields(submissions, ["employee_id", "is_active"]).select(
        SUBMISSION,
        _number("employee_id", "bigint").alias("Employee_ID"),
        _number("is_active", "tinyint").alias("is_active"),
        blank_to_null(F.col("employee_id").cast("string")).alias("_given"),
        blank_to_null(F.col("is_active").cast("string")).alias("_given_active"),
    )
    unread = [
        (F.col("_given").isNotNull() & F.col("Employee_ID").isNull(), "Employee_ID is not a bigint"),
        (F.col("_given_active").isNotNull() & F.col("is_active").isNull(), "is_active is not a tinyint"),
    ]
    flagged = flag(fields, unread + required_rules(["Employee_ID", "is_active"])).drop("_given", "_given_active")
    flagged = flag_unknown_keys(flagged, {"Employee_ID": "Employee"}, tables, SUBMISSION)

    def build(accepted: DataFrame, _: Starts) -> Rows:
        last = accepted.groupBy("Employee_ID").agg(F.max_by("is_active", SUBMISSION).alias("_last"))
        changed = employees.join(last, "Employee_ID", "left").withColumn(
            "Is_Available", F.coalesce("_last", "Is_Available")).select(employees.columns)
        return {"Employee": changed}

    return Ingested(flagged, build)
