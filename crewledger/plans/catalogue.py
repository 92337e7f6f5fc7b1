"""Every operator as a named query over the driver's tables, read in full.

Values are put into types that compare alike on any engine: decimals as double, dates as ISO
text, whole numbers and flags as bigint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.functions.dates import default_due_date, month_name, month_start
from crewledger.functions.text import stars
from crewledger.operators import (
    clients, costing, crew, estimates, ingest, invoices, payments, quality, revenue, services, totals,
)
from crewledger.operators.order import positioned, with_positions
from crewledger.plans import views
from crewledger.session import prepare, shared_folder, shuffles_dropped
from crewledger.sources import bindings
from crewledger.sources.tables import Tables, append, read_table, with_virtual
from crewledger.streaming import payments as payment_stream

Query = Callable[[SparkSession, str], DataFrame]

AGING_DAY = "2001-07-01"
SCHEDULE_DAY = "1998-06-15"
PAYMENT_DAY = "2024-01-15"
VIEW_DAY = "2024-01-15"
INGEST_DAY = "2024-02-01"
# Month and year of the billing periods shown together; None stands for any.
PERIODS = [(5, 1997), (None, 1997), (3, None), (None, None), (5, 1997), (1, 2030)]


def plain(rows: DataFrame) -> DataFrame:
    def column(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
            value = value.cast("bigint")
        return value.alias(field.name)

    return rows.select([column(field) for field in rows.schema])


def _star(tables: Tables, name: str) -> DataFrame:
    return bindings.read(tables._spark, tables._folder, name)


def _open_set(t: Tables) -> DataFrame:
    return t["Invoice"].filter(F.col("Invoice_Status").isin(invoices.OPEN_STATUSES))


def _periods(t: Tables) -> DataFrame:
    return t._spark.createDataFrame(PERIODS, "Month int, Year int")


def _period_rows(t: Tables) -> DataFrame:
    return invoices.period_totals(t["Invoice"], _periods(t))


# ── submissions made from the driver's tables ────────────────────────────────────────────────


def feedback_forms(t: Tables) -> DataFrame:
    """Documents as feedback: some ratings, clients and services do not exist."""
    return _star(t, "documents").select(
        F.col("doc_id").alias("submission_id"),
        (F.col("doc_id") * 3).alias("client_id"),
        F.when(F.col("lang") != "de", F.col("doc_id") * 10 + 1).alias("service_id"),
        (F.col("n_chars") % 7).alias("rating"),
        F.col("text").alias("comments"),
    )


def estimate_request_forms(t: Tables) -> DataFrame:
    """Documents as requests: the text is the description, its source the name."""
    blank = F.col("lang") == "es"
    return _star(t, "documents").select(
        F.col("doc_id").alias("submission_id"),
        F.when(blank, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("client_name"),
        F.col("lang").alias("property_address"),
        F.col("text").alias("service_description"),
        F.col("n_chars").alias("estimated_cost"),
        F.col("n_chars").alias("estimated_labor_hours"),
    )


def client_forms(t: Tables) -> DataFrame:
    """Documents as clients: the text is the address, too long for many."""
    return _star(t, "documents").select(
        F.col("doc_id").alias("submission_id"), F.col("source").alias("client_name"),
        F.col("lang").alias("client_phone"), F.col("text").alias("property_address"))


def _unless(condition: str, value) -> Column:
    """The value, or nothing in the rows that meet the condition."""
    return F.when(~F.expr(condition), value)


def contract_forms(t: Tables) -> DataFrame:
    """Events as contracts: price is the value less 20, so small ones are refused; some lack a date."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        F.when(F.col("event_type") != "error", F.col("event_id") * 2).alias("estimate_id"),
        F.col("user_id").alias("client_id"),
        _unless("event_id % 7 = 0", day).alias("start_date"),
        _unless("event_id % 3 = 0", day).alias("end_date"),
        (F.col("value").cast("decimal(10,2)") - 20).alias("pricing"),
        F.col("event_type").alias("service_scope"),
        F.lit("1 month").alias("duration"),
    )


def estimate_forms(t: Tables) -> DataFrame:
    """Events as estimates; purchases carry the actual cost of a service. Some lack what the form page asks for."""
    cost = F.col("value").cast("decimal(10,2)")
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        F.col("user_id").alias("client_id"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("employee_id"),
        _unless("event_id % 11 = 0", F.col("event_type")).alias("property_address"),
        _unless("event_id % 13 = 0", F.col("props")).alias("service_description"),
        _unless("event_id % 5 = 0", cost).alias("estimated_cost"),
        (F.col("event_id") % 4).alias("estimated_labor_hours"),
        _unless("event_id % 17 = 0", F.date_format("ts", "yyyy-MM-dd")).alias("estimate_date"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") * 10 + 1).alias("service_id"),
        F.when(F.col("event_type") == "purchase", cost + 1).alias("total_actual_cost"),
    )


def invoice_forms(t: Tables) -> DataFrame:
    """Events as invoices; clicks are unpaid, purchases overpaid, the rest half paid. Some lack a date or a total."""
    total = F.col("value").cast("decimal(10,2)")
    kind, day = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        F.when(kind != "error", F.col("event_id")).alias("contract_id"),
        F.col("user_id").alias("client_id"),
        _unless("event_id % 7 = 0", day).alias("invoice_date"),
        _unless("event_id % 3 = 0", day).alias("due_date"),
        _unless("event_id % 5 = 0", total).alias("total_amount"),
        F.when(kind == "purchase", total + 1).when(kind != "click", F.floor(F.col("value") / 2)).alias("amount_paid"),
    )


def payment_forms(t: Tables) -> DataFrame:
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        (F.col("event_id") * 3).alias("contract_id"),
        F.when(F.col("event_type") != "view", F.col("event_id") * 6).alias("invoice_id"),
        F.when(F.col("event_type") != "error", F.col("value").cast("decimal(10,2)") - 20).alias("payment_amount"),
        F.col("event_type").alias("payment_method"),
        F.date_format("ts", "yyyy-MM-dd").alias("payment_date"),
    )


def job_cost_forms(t: Tables) -> DataFrame:
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        F.when(F.col("event_type") != "signup", F.col("event_id") * 10 + 1).alias("service_id"),
        F.col("event_id").alias("estimate_id"),
        (F.col("value").cast("decimal(10,2)") - 20).alias("total_actual_cost"),
        (F.col("user_id") - 100).alias("total_estimated_cost"),
    )


def employee_forms(t: Tables) -> DataFrame:
    """Documents as applicants; those without a label have no role."""
    labels = _star(t, "labels").select("doc_id", F.concat(F.lit("Grade "), "quality").alias("employee_role"))
    return _star(t, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("submission_id"),
        F.concat(F.lit(" "), "source").alias("employee_name"), "employee_role",
        F.lit("").alias("employee_phone"))


def status_forms(t: Tables) -> DataFrame:
    """Events as availability changes: a signup sets 1, an error 0, other events nothing."""
    kind = F.col("event_type")
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"), F.col("user_id").alias("employee_id"),
        F.when(kind == "signup", 1).when(kind == "error", 0).alias("is_active"))


def referral_forms(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return _star(t, "events").select(
        F.col("event_id").alias("submission_id"),
        F.when(kind == "error", F.lit("")).otherwise(F.concat(F.lit(" guest "), "event_id")).alias("referee_name"),
        F.when(kind != "view", F.col("user_id")).alias("referrer_id"))


def _without_ids(rows: DataFrame, *ids: str) -> DataFrame:
    """Assigned ids depend on the hash order of a batch; they are checked by `assigned_ids`."""
    return rows.drop(*ids)


def _all_rejects(t: Tables) -> DataFrame:
    """Rejects of every ingest operator by reason, with the rules of the form pages."""
    day = INGEST_DAY
    batches = {
        "feedback": ingest.ingest_feedback(feedback_forms(t), t, day),
        "estimate request": ingest.ingest_estimate_requests(estimate_request_forms(t), t, day),
        "client": ingest.ingest_clients(client_forms(t), t),
        "contract": ingest.ingest_contracts(contract_forms(t), t, strict=True),
        "estimate": ingest.ingest_estimates(estimate_forms(t), t, strict=True),
        "invoice": ingest.ingest_invoices(invoice_forms(t), t, strict=True),
        "payment": ingest.ingest_payments(payment_forms(t), t, strict=True),
        "job costing": ingest.ingest_job_costing(job_cost_forms(t), t, strict=True),
        "employee": ingest.ingest_employees(employee_forms(t), t),
        "status change": ingest.apply_status_changes(status_forms(t), t),
        "referral": ingest.ingest_referrals(referral_forms(t), t, day),
    }
    rejects = [batch.rejects.select(F.lit(form).alias("form"), "reason") for form, batch in batches.items()]
    together = rejects[0]
    for more in rejects[1:]:
        together = together.unionByName(more)
    return together.groupBy("form", "reason").agg(F.count(F.lit(1)).alias("Row_Count"))


def _ingested_twice(t: Tables) -> DataFrame:
    """Payments of a batch that is run, run again, and run with rows sent twice: the stored rows."""
    spark, path = t._spark, f"{shared_folder(t._spark)}/{uuid.uuid4()}"
    batch = payment_forms(t)
    for sent in (batch, batch, batch.filter("submission_id % 2 = 0")):
        ingest.ingest_once(ingest.ingest_payments, sent, t, path, "Payment")
    return _without_ids(read_table(spark, path, "Payment"), "Payment_ID")


def _id_summary(t: Tables) -> DataFrame:
    """Ids given to a batch: consecutive, unique and above those in use."""
    rows = ingest.ingest_payments(payment_forms(t), t).rows["Payment"]
    return rows.agg(
        F.min("Payment_ID").alias("First_ID"), F.max("Payment_ID").alias("Last_ID"),
        F.count("Payment_ID").alias("Row_Count"), F.count_distinct("Payment_ID").alias("ID_Count"))


def _estimate_requests(t: Tables) -> DataFrame:
    """Client and estimate rows of a request side by side."""
    done = ingest.ingest_estimate_requests(estimate_request_forms(t), t, INGEST_DAY).rows
    people = done["Client"].select("submission_id", "Client_ID", "Client_Name", "Client_Phone")
    return people.join(done["Estimate"], ["submission_id", "Client_ID"]).drop("Client_ID", "Estimate_ID")


def _streamed_balances(t: Tables) -> DataFrame:
    """Stream all purchases, sent twice over, into a payment log and apply the log."""
    spark, folder = t._spark, t._folder
    state = f"{shared_folder(spark)}/payment-stream-{uuid.uuid4()}"
    source = spark.readStream.schema(_star(t, "events").schema).option("pathGlobFilter", "events.parquet")
    sent = bindings.payments_of(source.parquet(folder), _star(t, "orders"))
    log = f"{state}/log"
    query = (payment_stream.payment_log_writer(sent.unionByName(sent), log, f"{state}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return payment_stream.current_balances(t["Invoice"], payment_stream.read_log(spark, log))


def _lines(t: Tables) -> DataFrame:
    return _star(t, "lineitem")


def _size_forms(t: Tables) -> DataFrame:
    """Documents as clients with the text as address, and the whole text's length as the phone."""
    return _star(t, "documents").select(
        F.col("doc_id").alias("Client_ID"), F.col("source").alias("Client_Name"),
        F.col("text").alias("Property_Address"))


def _rated(t: Tables) -> DataFrame:
    return _star(t, "documents").select(
        F.col("doc_id").alias("Feedback_ID"), (F.col("n_chars") % 8).alias("Rating"))


def _reason_counts(checked: quality.Checked) -> DataFrame:
    """Accepted and rejected rows of a check by reason."""
    return checked.accepted.select(F.lit("accepted").alias("reason")).unionByName(
        checked.rejects.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("Row_Count"))


def _doubled(t: Tables, *names: str) -> Tables:
    """The tables with the rows of some of them stored twice."""
    changed = type(t)(t._spark, t._folder)
    for name in names:
        changed[name] = t[name].unionByName(t[name])
    return changed


def _stored(t: Tables, rows: DataFrame, table: str) -> DataFrame:
    """Rows written by `append` and read again."""
    folder = f"{shared_folder(t._spark)}/{uuid.uuid4()}"
    append(rows, folder, table)
    return read_table(t._spark, folder, table)


def _stored_totals(t: Tables) -> DataFrame:
    return totals.invoice_totals(_stored(t, t["Invoice"], "Invoice"))


def _kept(t: Tables, *names: str) -> Tables:
    """The tables with some of them computed once and stored; readers take only the columns they need."""
    changed = type(t)(t._spark, t._folder)
    for name in names:
        folder = f"{shared_folder(t._spark)}/{uuid.uuid4()}"
        t[name].write.parquet(folder)
        changed[name] = t._spark.read.schema(t[name].schema).parquet(folder)
    return changed


def _view_sizes(t: Tables) -> DataFrame:
    """Rows of every reporting view, selected by its name.

    Eight views read `Service`, which takes four shuffles of the largest table: it is made once. The views are counted one
    after another, so that the disk holds the shuffle files of one view at a time.
    """
    spark = t._spark
    with shuffles_dropped(spark):
        names = views.register_views(spark, _kept(t, "Service"), VIEW_DAY)
        counts = [spark.sql(f"SELECT count(*) FROM {name}").first()[0] for name in names]
    sizes = ", ".join(f"('{name}', {count}L)" for name, count in zip(names, counts))
    return spark.sql(f"SELECT * FROM VALUES {sizes} AS sizes (View_Name, Row_Count)")


def _view(name: str) -> Callable[[Tables], DataFrame]:
    """All rows of a reporting view, selected by its name."""

    def rows(t: Tables) -> DataFrame:
        views.register_views(t._spark, t, AGING_DAY if name == "vw_OutstandingInvoices" else
                             SCHEDULE_DAY if name == "vw_ScheduleWorkload" else VIEW_DAY, [name])
        return t._spark.sql(f"SELECT * FROM {name}")

    return rows


def _referrals_in_order(t: Tables) -> DataFrame:
    rows = clients.referrals(t, ordered=False)
    return with_positions(rows, *clients.referral_order(rows, "Referrer_Name", True))


TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # look-ups, projections, filters
    "clients_list": clients.clients_list,
    "clients_full": clients.clients_full,
    "client_by_id": lambda t: clients.client_by_id(t, t["Referral"].select("Referrer_ID")),
    "client_exists": lambda t: _reason_counts(clients.client_exists(
        t, _star(t, "events").select("event_id", F.col("event_id").alias("Client_ID")), row_key="event_id")),
    "employees_list": crew.employees_list,
    "employee_lookups": lambda t: crew.employee_lookups(t, _star(t, "events").select("user_id")),
    "service_employees": crew.service_employees,
    "vw_service_employees": crew.vw_service_employees,
    "services_by_client": lambda t: services.services_by_client(t, t["Client_Feedback"].select("Client_ID")),
    "contracts_list": invoices.contracts_list,
    "contracts_for_client": lambda t: invoices.contracts_for_client(t, client_id=t["Client_Feedback"].select("Client_ID")),
    "invoices_by_client": invoices.invoices_by_client,
    "filter_invoices": lambda t: invoices.filter_invoices(invoices.all_invoices(t), status="Partial"),
    "estimate_by_id": lambda t: estimates.estimate_by_id(t, t["Job_Costing"].select("Estimate_ID")),
    "filter_estimates": lambda t: estimates.filter_estimates(
        estimates.all_estimates(t), t["Client_Feedback"].select("Client_ID")),
    "services_report": lambda t: services.services_report(t, description=" RING", date_from="1996-01-01", date_to="1997-06-30"),
    "filter_referrals": lambda t: clients.filter_referrals(clients.referrals(t), " CUSTOMER#0000000"),
    "hourly_rates": lambda t: estimates.with_hourly_rate(t["Estimate"]).select(
        "Estimate_ID", "Estimated_Cost", "Estimated_Labor_Hours", "Hourly_Rate"),
    "days_overdue_clamped": lambda t: invoices.days_overdue_clamped(
        invoices.outstanding_invoices(t, "1998-06-30")).select("Invoice_ID", "Days_Overdue", "Aging_Bucket"),
    "labelled_estimates": lambda t: estimates.fill_labels(estimates.vw_estimate_employees(t)),
    "contract_drafts": lambda t: estimates.contract_draft_from_estimates(t["Estimate"]),
    "invoice_calendar": lambda t: with_virtual(t["Invoice"], AGING_DAY).select(
        "Invoice_ID", "Days_Outstanding", month_start(F.col("Invoice_Date")).alias("Month_Start"),
        month_name(F.month("Invoice_Date")).alias("Month_Name"),
        default_due_date(F.lit(None).cast("date"), F.col("Invoice_Date")).alias("Default_Due")),
    "feedback_stars": lambda t: t["Client_Feedback"].select("Feedback_ID", stars(F.col("Rating")).alias("Stars")),
    # listings
    "client_feedback": clients.client_feedback,
    "client_feedback_by_rating": lambda t: clients.client_feedback(t, rating="5"),
    "vw_client_feedback": clients.vw_client_feedback,
    "estimate_employees": estimates.estimate_employees,
    "estimate_employees_of_month": lambda t: estimates.estimate_employees(
        t, month="3", year="1997", employee_id=t["Employee"].filter("Is_Available = 1").select("Employee_ID")),
    "vw_estimate_employees": estimates.vw_estimate_employees,
    "all_estimates": estimates.all_estimates,
    "all_invoices": invoices.all_invoices,
    "vw_payments_this_month": lambda t: invoices.vw_payments_this_month(t, PAYMENT_DAY),
    "monthly_revenue": invoices.monthly_revenue,
    "monthly_revenue_of_month": lambda t: invoices.monthly_revenue(t, month="5", year="1997"),
    "monthly_revenue_of_any_year": lambda t: invoices.monthly_revenue(t, month=12),
    "outstanding_invoices": lambda t: invoices.outstanding_invoices(t, AGING_DAY),
    "vw_outstanding_invoices": lambda t: invoices.vw_outstanding_invoices(t, AGING_DAY),
    "recent_outstanding": lambda t: invoices.recent_outstanding(t, AGING_DAY),
    "client_service_history": clients.client_service_history,
    "client_service_history_at": lambda t: clients.client_service_history(t, location="tion_1"),
    "vw_client_service_history": clients.vw_client_service_history,
    "job_costing": costing.job_costing,
    "job_costing_of_year": lambda t: costing.job_costing(t, year=1997),
    "vw_job_costing": costing.vw_job_costing,
    "schedule_workload": lambda t: crew.schedule_workload(t, SCHEDULE_DAY),
    "referrals": clients.referrals,
    "sort_referrals": lambda t: clients.sort_referrals(clients.referrals(t), "Referrer_Name", True),
    # aggregates and ranks
    "revenue_by_service": revenue.revenue_by_service,
    "revenue_by_service_deduplicated": lambda t: revenue.revenue_by_service(t, dedupe_invoices=True),
    "vw_revenue_by_service_type": revenue.vw_revenue_by_service_type,
    "vw_revenue_by_location": revenue.vw_revenue_by_location,
    "vw_revenue_by_location_deduplicated": lambda t: revenue.vw_revenue_by_location(t, dedupe_invoices=True),
    "vw_monthly_revenue_report": revenue.vw_monthly_revenue_report,
    "top_clients": revenue.top_clients,
    "vw_top_clients_by_revenue": revenue.vw_top_clients_by_revenue,
    "rank_clients": lambda t: clients.rank_clients(t, 25),
    "rank_clients_with_feedback": lambda t: clients.rank_clients(
        t, 100, t["Client_Feedback"].select("Client_ID"), keep_global_rank=True),
    "vw_employee_clients": crew.employee_clients,
    "my_clients": lambda t: crew.my_clients(t, t["Employee"].filter("Is_Available = 1").select("Employee_ID")),
    "dashboard_stats": revenue.dashboard_stats,
    "employee_count": crew.employee_count,
    "service_types": services.service_types,
    "invoice_totals": lambda t: totals.invoice_totals(_open_set(t)),
    "period_totals": _period_rows,
    "period_grand_total": lambda t: invoices.grand_total(_period_rows(t)),
    "monthly_chart": lambda t: invoices.monthly_chart(t["Invoice"]),
    "estimate_totals": lambda t: totals.estimate_totals(t["Estimate"]),
    "service_totals": lambda t: totals.service_totals(t["Service"]),
    "job_cost_totals": lambda t: totals.job_cost_totals(t["Job_Costing"]),
    "outstanding_with_total": lambda t: totals.with_total_row(
        invoices.outstanding_invoices(t, AGING_DAY).select("Invoice_ID", "Total_Amount", "Amount_Paid", "Balance_Due"),
        ["Total_Amount", "Amount_Paid", "Balance_Due"]),
    "clients_ranked": lambda t: clients.rank_clients(t, 1_000_000),
    "clients_in_order": lambda t: positioned(clients.clients_list, t),
    "contracts_in_order": lambda t: positioned(invoices.contracts_list, t),
    "outstanding_in_order": lambda t: positioned(invoices.outstanding_invoices, t, AGING_DAY).select("Invoice_ID", "Days_Overdue", "Position"),
    "referrals_in_order": _referrals_in_order,
    "client_history_entries": clients.client_history_entries,
    "client_history_entries_at": lambda t: clients.client_history_entries(t, location="tion_1"),
    # checks
    "foreign_key_check": lambda t: quality.orphan_counts(t, "Client_Feedback"),
    "foreign_key_checks": quality.all_orphan_counts,
    # Tables stored twice over: counts and checks are those of the tables stored once.
    "foreign_key_check_repeated": lambda t: quality.orphan_counts(_doubled(t, "Service", "Client"), "Client_Feedback"),
    "revenue_by_service_repeated": lambda t: revenue.revenue_by_service(_doubled(t, "Service"), dedupe_invoices=True),
    "employee_clients_repeated": lambda t: crew.employee_clients(_doubled(t, "Service", "Service_Employee")),
    # stored and read again, and read by name
    "stored_round_trip": _stored_totals,
    "balances_round_trip": lambda t: _stored(t, payments.apply_payments(t["Invoice"], t["Payment"]), "Invoice"),
    "views_by_name": _view_sizes,
    "size_check": lambda t: _reason_counts(quality.check_sizes(_size_forms(t), "Client")),
    "value_check": lambda t: _reason_counts(quality.check_values(_rated(t), "Client_Feedback")),
    "required_check": lambda t: _reason_counts(quality.check_required(employee_forms(t), ["employee_role"])),
    "unique_check": lambda t: _reason_counts(quality.check_unique(_lines(t), ["l_orderkey", "l_linenumber"])),
    "duplicate_keys": lambda t: quality.duplicate_keys(_lines(t), ["l_orderkey", "l_linenumber"]),
    "one_per_key": lambda t: quality.one_per_key(
        _lines(t).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
        .withColumn("l_shipdate", F.col("l_shipdate").cast("date")), ["l_orderkey", "l_linenumber"]),
    "invoice_defaults": lambda t: quality.fill_defaults(
        t["Invoice"].withColumn("Invoice_Status", F.nullif("Invoice_Status", F.lit("Partial")))
        .withColumn("Amount_Paid", F.nullif("Amount_Paid", "Total_Amount")), "Invoice",
    ).select("Invoice_ID", "Amount_Paid", "Invoice_Status"),
    # ingest
    "ingest_feedback": lambda t: _without_ids(
        ingest.ingest_feedback(feedback_forms(t), t, INGEST_DAY).rows["Client_Feedback"], "Feedback_ID"),
    "ingest_estimate_requests": _estimate_requests,
    "ingest_clients": lambda t: _without_ids(ingest.ingest_clients(client_forms(t), t).rows["Client"], "Client_ID"),
    "ingest_contracts": lambda t: _without_ids(
        ingest.ingest_contracts(contract_forms(t), t).rows["Contract"], "Contract_ID"),
    "ingest_estimates": lambda t: _without_ids(
        ingest.ingest_estimates(estimate_forms(t), t).rows["Estimate"], "Estimate_ID"),
    "ingest_estimates_costed": lambda t: _without_ids(
        ingest.ingest_estimates(estimate_forms(t), t).rows["Job_Costing"], "Job_Cost_ID", "Estimate_ID"),
    "ingest_invoices": lambda t: _without_ids(
        ingest.ingest_invoices(invoice_forms(t), t).rows["Invoice"], "Invoice_ID"),
    "ingest_payments": lambda t: _without_ids(
        ingest.ingest_payments(payment_forms(t), t).rows["Payment"], "Payment_ID"),
    "ingest_job_costing": lambda t: _without_ids(
        ingest.ingest_job_costing(job_cost_forms(t), t).rows["Job_Costing"], "Job_Cost_ID"),
    "ingest_employees": lambda t: _without_ids(
        ingest.ingest_employees(employee_forms(t), t).rows["Employee"], "Employee_ID"),
    "ingest_referrals": lambda t: _without_ids(
        ingest.ingest_referrals(referral_forms(t), t, INGEST_DAY).rows["Referral"], "Referral_ID"),
    "apply_status_changes": lambda t: ingest.apply_status_changes(status_forms(t), t).rows["Employee"],
    "ingest_rejects": _all_rejects,
    "assigned_ids": _id_summary,
    "payments_ingested_twice": _ingested_twice,
    # payments and balances
    "apply_payments": lambda t: payments.apply_payments(t["Invoice"], t["Payment"]),
    "apply_payments_compat": lambda t: payments.apply_payments(t["Invoice"], t["Payment"], compat=True),
    "payment_stream_balances": _streamed_balances,
}


TABLE_QUERIES |= {f"{name}_by_name": _view(name) for name in views.NAMES}


def _over_folder(query: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(query(bindings.bound_tables(prepare(spark), folder)))

    return run


def queries() -> dict[str, Query]:
    return {name: _over_folder(query) for name, query in TABLE_QUERIES.items()}
