"""Plain nested loops over a random company in which one client, contract and invoice is hot."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

from crewledger.schemas import SCHEMAS
from tests.fixture import frame


def random_company(seed: int) -> dict[str, list[dict]]:
    r = random.Random(seed)

    def pick(keys, hot, nothing=0.0):
        """A third of all picks is the hot key; some are a key that does not exist, some NULL."""
        roll = r.random()
        if roll < 0.34:
            return hot
        if roll < 0.34 + nothing:
            return None
        return r.choice(keys + [999])

    def money():
        return None if r.random() < 0.1 else Decimal(r.randrange(0, 100_000)) / 100

    def date():
        return datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randrange(200))

    def rows(table, count, **make):
        return [
            {name: number if i == 0 else make[name]() if name in make else None
             for i, name in enumerate(SCHEMAS[table].names)}
            for number in range(1, count + 1)
        ]

    return {
        "Client": rows("Client", 8, Client_Name=lambda: r.choice("ABC")),
        "Estimate": rows("Estimate", 20, Client_ID=lambda: pick([1, 2, 3, 4, 5], 1), Estimate_Date=date),
        "Contract": rows(
            "Contract", 15, Estimate_ID=lambda: pick([1, 2, 3, 4, 5, 6, 7], 2), Client_ID=lambda: pick([1, 2, 3], 1)),
        "Service": rows(
            "Service", 25, Client_ID=lambda: pick([1, 2, 3], 1), Contract_ID=lambda: pick(list(range(1, 12)), 3, 0.2),
            Service_Type=lambda: r.choice(["x", "y", None]), Service_Date=date),
        "Invoice": rows(
            "Invoice", 25, Contract_ID=lambda: pick(list(range(1, 12)), 3), Client_ID=lambda: pick([1, 2, 3], 1),
            Total_Amount=money, Amount_Paid=money),
        "Payment": rows(
            "Payment", 30, Contract_ID=lambda: 1, Invoice_ID=lambda: pick(list(range(1, 20)), 4, 0.2),
            Payment_Amount=money),
    }


def frames(spark, data):
    return {table: frame(spark, table, rows) for table, rows in data.items()}


def same_rows(df, expected: list[tuple]) -> bool:
    got = sorted((tuple(row) for row in df.collect()), key=str)
    wanted = sorted(expected, key=str)
    assert got == wanted, next((pair for pair in zip(got, wanted) if pair[0] != pair[1]), (len(got), len(wanted)))
    return True


def _children(rows, key, value):
    return [row for row in rows if value is not None and row[key] == value] or [{}]


def history(data) -> list[tuple]:
    out = []
    for c in data["Client"]:
        for e in _children(data["Estimate"], "Client_ID", c["Client_ID"]):
            for k in _children(data["Contract"], "Estimate_ID", e.get("Estimate_ID")):
                for s in _children(data["Service"], "Contract_ID", k.get("Contract_ID")):
                    for i in _children(data["Invoice"], "Contract_ID", k.get("Contract_ID")):
                        for p in _children(data["Payment"], "Invoice_ID", i.get("Invoice_ID")):
                            out.append((
                                c["Client_ID"], c["Client_Name"], c["Property_Address"], e.get("Estimate_ID"),
                                e.get("Estimate_Date"), e.get("Estimated_Cost"), k.get("Contract_ID"),
                                k.get("Contract_StartDate"), k.get("Contract_EndDate"), s.get("Service_ID"),
                                s.get("Service_Type"), s.get("Service_Date"), s.get("Property_Location"),
                                i.get("Invoice_ID"), i.get("Total_Amount"), i.get("Invoice_Status"),
                                p.get("Payment_ID"), p.get("Payment_Amount"), p.get("Payment_Date")))
    return out


def _sum(values):
    present = [v for v in values if v is not None]
    return sum(present, Decimal(0)) if present else None


def revenue_by_type(data, dedupe: bool) -> list[tuple]:
    contracts = {k["Contract_ID"] for k in data["Contract"]}
    groups: dict = {}
    for s in data["Service"]:
        for i in data["Invoice"]:
            if s["Contract_ID"] in contracts and s["Contract_ID"] == i["Contract_ID"]:
                groups.setdefault(s["Service_Type"], []).append((s["Service_ID"], i["Invoice_ID"], i["Total_Amount"]))
    out = []
    for kind, pairs in groups.items():
        amounts = dict((invoice, amount) for _, invoice, amount in pairs).values() if dedupe else [a for *_, a in pairs]
        out.append((kind, len({service for service, *_ in pairs}), _sum(amounts)))
    return out


def client_revenue(data) -> list[tuple]:
    out = []
    for c in data["Client"]:
        pairs = [(k["Contract_ID"], i) for k in data["Contract"] for i in data["Invoice"]
                 if k["Client_ID"] == c["Client_ID"] and i["Contract_ID"] == k["Contract_ID"]]
        if pairs:
            out.append((c["Client_ID"], len({k for k, _ in pairs}), _sum(i["Total_Amount"] for _, i in pairs),
                        _sum(i["Amount_Paid"] for _, i in pairs)))
    return out
