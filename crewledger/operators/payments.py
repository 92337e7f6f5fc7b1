"""Payments applied to invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.functions.status import settled_invoice_status


AMOUNT = "decimal(10,2)"


def apply_payments(invoices: DataFrame, payments: DataFrame, compat: bool = False) -> DataFrame:
    """The invoices after all payments: amount paid increased and status recomputed.

    Payments are summed per invoice before they meet the invoices, so both sides of the join have
    unique keys. Invoices without payments stay as they are, and so do those whose amount paid would
    not fit its declared type; `overflowing` lists these.

    `compat` gives the status a database with left-to-right assignment stores: there the status
    test sees the amount already increased and adds the last payment (greatest id) once more.
    """
    paid = F.col("Amount_Paid") + F.col("_received")
    tested = paid + F.col("_last") if compat else paid
    fits = F.coalesce(paid, F.lit(0)).try_cast(AMOUNT)
    touched = F.col("_received").isNotNull() & fits.isNotNull()
    status = settled_invoice_status(F.col("Total_Amount"), tested)
    return invoices.join(_per_invoice(payments), "Invoice_ID", "left").withColumns({
        "Invoice_Status": F.when(touched, status).otherwise(F.col("Invoice_Status")),
        "Amount_Paid": F.when(touched, paid.try_cast(AMOUNT)).otherwise(F.col("Amount_Paid").try_cast(AMOUNT)),
    }).select(invoices.columns)


def overflowing(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices that a batch would bring to an amount that does not fit, with the reason."""
    paid = F.col("Amount_Paid") + F.col("_received")
    return invoices.join(_per_invoice(payments), "Invoice_ID").filter(paid.isNotNull() & paid.try_cast(AMOUNT).isNull()).select(
        "Invoice_ID", F.lit(f"Amount_Paid does not fit {AMOUNT}").alias("reason"))


def _per_invoice(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("Invoice_ID").isNotNull()).groupBy("Invoice_ID").agg(
        F.sum("Payment_Amount").alias("_received"),
        F.max_by("Payment_Amount", "Payment_ID").alias("_last"),
    )
