"""The eleven tables as projections of the driver's star schema.

An order is an estimate, the contract made from it and its invoice; the lines of an order that
share a line number are one service; suppliers are the crew. Urgent orders carry a second invoice.
Money is cast to decimal before anything is added up, and no computed double is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewledger.schemas import schema_of
from crewledger.sources.tables import Tables

# The columns of the driver's tables. A declared schema saves the job that reads it.
STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}
STATUS_OF_ORDER = {"F": "Paid", "P": "Partial", "O": "Unpaid"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _as(table: str, rows: DataFrame, **columns: Column) -> DataFrame:
    """Project to the declared columns; those not given are NULL."""
    return rows.select([
        columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema_of(table)
    ])


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def _count(rows: DataFrame) -> Column:
    return rows.agg(F.count(F.lit(1))).scalar()


def clients(spark: SparkSession, folder: str) -> DataFrame:
    customers = read(spark, folder, "customer").join(
        read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _as(
        "Client", customers,
        Client_ID=F.col("c_custkey"), Client_Name=F.col("c_name"),
        Client_Phone=F.concat(F.lit("555-"), F.col("c_custkey")),
        Client_Email=F.concat(F.lower("c_mktsegment"), F.lit("@"), F.lower("n_name")),
        Property_Address=F.col("n_name"),
    )


def employees(spark: SparkSession, folder: str) -> DataFrame:
    places = read(spark, folder, "nation").join(
        read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = read(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return _as(
        "Employee", suppliers,
        Employee_ID=F.col("s_suppkey"), Employee_Name=F.col("s_name"), Employee_Role=F.col("r_name"),
        Employee_Phone=F.concat(F.lit("555-"), F.col("s_suppkey")), Employee_Email=F.lower("n_name"),
        Is_Available=(F.col("s_acctbal") >= 5000).cast("int"),
    )


def estimates(spark: SparkSession, folder: str) -> DataFrame:
    """An order without a priority has no estimator."""
    crew = _count(read(spark, folder, "supplier"))
    return _as(
        "Estimate", read(spark, folder, "orders"),
        Estimate_ID=F.col("o_orderkey"), Client_ID=F.col("o_custkey"),
        Employee_ID=F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderkey") % crew),
        Property_Address=F.concat(F.lit("Site "), F.col("o_custkey")),
        Service_Description=F.col("o_orderpriority"),
        Estimated_Cost=F.col("o_totalprice"),
        Estimated_Labor_Hours=F.col("o_orderkey") % 40, Estimate_Date=_day("o_orderdate"),
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    return _as(
        "Contract", read(spark, folder, "orders"),
        Contract_ID=F.col("o_orderkey"), Estimate_ID=F.col("o_orderkey"), Client_ID=F.col("o_custkey"),
        Contract_StartDate=_day("o_orderdate"), Contract_EndDate=F.add_months(_day("o_orderdate"), 3),
        Pricing=F.col("o_totalprice"), Service_Scope=F.col("o_orderpriority"),
        Contract_Duration=F.lit("3 months"),
    )


def _service_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _cents(amount: Column) -> Column:
    return F.floor(amount * 100)


def _from_cents(cents: str) -> Column:
    return F.col(cents).cast("decimal(18,0)") / 100


def services(spark: SparkSession, folder: str) -> DataFrame:
    """Orders meet their customers before their lines, so that lines move once for both and end up beside those of their order."""
    visits = read(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("partkey"), F.min("l_shipdate").alias("shipdate"))
    homes = read(spark, folder, "customer").join(
        read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    ).select("c_custkey", "n_name")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey").join(
        homes, F.col("o_custkey") == F.col("c_custkey"))
    parts = read(spark, folder, "part").select("p_partkey", "p_type", "p_name")
    joined = (visits.join(parts, F.col("partkey") == F.col("p_partkey"))
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    return _as(
        "Service", joined,
        Service_ID=_service_id(), Client_ID=F.col("o_custkey"), Contract_ID=F.col("l_orderkey"),
        Service_Type=F.col("p_type"), Service_Date=_day("shipdate"),
        Property_Location=F.col("n_name"), Service_Description=F.col("p_name"),
    )


def service_employees(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select(_service_id().alias("service"), "l_suppkey").distinct()
    return _as("Service_Employee", lines, Service_ID=F.col("service"), Employee_ID=F.col("l_suppkey"))


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One scan yields both invoices of an urgent order; dates stay outside the generated rows."""
    status = F.col("o_orderstatus")
    label = F.coalesce(*[F.when(status == code, name) for code, name in STATUS_OF_ORDER.items()])
    price = F.col("o_totalprice")
    paid = F.when(status == "F", price).when(status == "P", F.floor(price / 2).cast("double")).otherwise(0.0)

    def invoice(step, total, paid, label):
        return F.struct(
            F.lit(step).alias("step"), total.cast("decimal(10,2)").alias("total"),
            paid.cast("decimal(10,2)").alias("paid"), label.alias("label"))

    main = invoice(0, price, paid, label)
    surcharge = invoice(1, F.floor(price / 10), F.lit(0), F.lit("Unpaid"))
    billed = read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", _day("o_orderdate").alias("day"),
        F.explode(F.when(F.col("o_orderpriority") == "1-URGENT", F.array(main, surcharge))
                  .otherwise(F.array(main))).alias("i"),
    )
    return _as(
        "Invoice", billed,
        Invoice_ID=F.col("o_orderkey") * 2 + F.col("i.step"), Contract_ID=F.col("o_orderkey"),
        Client_ID=F.col("o_custkey"), Invoice_Date=F.col("day"), Due_Date=F.date_add("day", 15),
        Total_Amount=F.col("i.total"), Amount_Paid=F.col("i.paid"), Invoice_Status=F.col("i.label"),
    )


# Payment methods in the order of event_id modulo 4.
METHODS = ["Check", "Bank Transfer", "Credit Card", "Cash"]


def payments_of(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Purchases as payments on the first invoice of a contract; works on a stream of events too."""
    contract = F.col("event_id") % _count(orders)
    return _as(
        "Payment", events.filter(F.col("event_type") == "purchase"),
        Payment_ID=F.col("event_id"), Contract_ID=contract, Invoice_ID=contract * 2,
        Payment_Amount=F.col("value"),
        Payment_Method=F.element_at(F.array(*map(F.lit, METHODS)), (F.col("event_id") % 4 + 1).cast("int")),
        Due_Date=F.date_add(_day("ts"), 10), Payment_Date=_day("ts"), Payment_Status=F.lit("Paid"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return payments_of(read(spark, folder, "events"), read(spark, folder, "orders"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as comments; German ones name no service."""
    people = _count(read(spark, folder, "customer"))
    orders = _count(read(spark, folder, "orders"))
    return _as(
        "Client_Feedback", read(spark, folder, "documents"),
        Feedback_ID=F.col("doc_id"), Client_ID=F.col("doc_id") % people,
        Service_ID=F.when(F.col("lang") != "de", (F.col("doc_id") % orders) * 10 + 1),
        Rating=F.col("n_chars") % 5 + 1, Comments=F.col("text"), Suggestions=F.col("source"),
        Feedback_Date=F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 365).cast("int")),
    )


# Referral status in the order of c_nationkey modulo 3.
REFERRAL_STATUSES = ["Pending", "Contacted", "Verified"]


def referrals(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as referees of the customer with half their key; machinery buyers came unreferred."""
    return _as(
        "Referral", read(spark, folder, "customer"),
        Referral_ID=F.col("c_custkey"),
        Referrer_ID=F.when(F.col("c_mktsegment") != "MACHINERY", F.floor(F.col("c_custkey") / 2)),
        Referee_ID=F.when(F.col("c_acctbal") > 0, F.col("c_custkey")), Referee_Name=F.col("c_name"),
        Referral_Date=F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey")),
        Status=F.element_at(F.array(*map(F.lit, REFERRAL_STATUSES)), (F.col("c_nationkey") % 3 + 1).cast("int")),
    )


def job_costs(spark: SparkSession, folder: str) -> DataFrame:
    price, kept, tax = F.col("l_extendedprice"), 1 - F.col("l_discount"), 1 + F.col("l_tax")
    jobs = read(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum((price.cast("decimal(10,2)") * 100).cast("bigint")).alias("estimated"),
        F.sum(F.col("l_quantity").cast("decimal(6,2)")).alias("hours"),
        F.sum(_cents(price * kept * tax)).alias("actual"),
        F.sum(_cents(price * kept)).alias("labor"),
    )
    return _as(
        "Job_Costing", jobs,
        Job_Cost_ID=_service_id(), Service_ID=_service_id(), Estimate_ID=F.col("l_orderkey"),
        Actual_Labor_Hours=F.col("hours"), Actual_Labor_Cost=_from_cents("labor"),
        Actual_Materials=(F.col("actual") - F.col("labor")).cast("decimal(18,0)") / 100,
        Total_Actual_Cost=_from_cents("actual"), Total_Estimated_Cost=_from_cents("estimated"),
    )


BINDINGS = {
    "Client": clients,
    "Employee": employees,
    "Estimate": estimates,
    "Contract": contracts,
    "Service": services,
    "Service_Employee": service_employees,
    "Payment": payments,
    "Invoice": invoices,
    "Client_Feedback": feedback,
    "Referral": referrals,
    "Job_Costing": job_costs,
}


class BoundTables(dict):
    """The tables, each built when first asked for: a query pays only for what it reads."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._spark, self._folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = BINDINGS[name](self._spark, self._folder)
        return self[name]


def bound_tables(spark: SparkSession, folder: str) -> Tables:
    return BoundTables(spark, folder)
