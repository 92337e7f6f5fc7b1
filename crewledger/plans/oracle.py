"""For every named query the SQL another engine runs on the same Parquet tables.

The statements join and aggregate in the plainest way, fan-out included, so that agreement also
proves the shortcuts the Spark plans take.
"""

from __future__ import annotations

from crewledger.schemas import FOREIGN_KEYS, SCHEMAS

# The eleven tables as projections of the star schema.
ROLES = {
    "client": """
        SELECT c_custkey AS Client_ID, c_name AS Client_Name, '555-' || c_custkey AS Client_Phone,
               lower(c_mktsegment) || '@' || lower(n_name) AS Client_Email, n_name AS Property_Address
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "employee": """
        SELECT s_suppkey AS Employee_ID, s_name AS Employee_Name, r_name AS Employee_Role,
               '555-' || s_suppkey AS Employee_Phone, lower(n_name) AS Employee_Email,
               CASE WHEN s_acctbal >= 5000 THEN 1 ELSE 0 END AS Is_Available
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "estimate": """
        SELECT o_orderkey AS Estimate_ID, o_custkey AS Client_ID,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                    THEN o_orderkey % (SELECT count(*) FROM supplier) END AS Employee_ID,
               'Site ' || o_custkey AS Property_Address, o_orderpriority AS Service_Description,
               CAST(o_totalprice AS DECIMAL(10,2)) AS Estimated_Cost,
               CAST(o_orderkey % 40 AS DECIMAL(6,2)) AS Estimated_Labor_Hours,
               CAST(o_orderdate AS DATE) AS Estimate_Date
        FROM orders""",
    "contract": """
        SELECT o_orderkey AS Contract_ID, o_orderkey AS Estimate_ID, o_custkey AS Client_ID,
               CAST(o_orderdate AS DATE) AS Contract_StartDate,
               CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS Contract_EndDate,
               CAST(o_totalprice AS DECIMAL(10,2)) AS Pricing, o_orderpriority AS Service_Scope
        FROM orders""",
    "service": """
        SELECT v.l_orderkey * 10 + v.l_linenumber AS Service_ID, o_custkey AS Client_ID,
               v.l_orderkey AS Contract_ID, p_type AS Service_Type, CAST(shipdate AS DATE) AS Service_Date,
               n_name AS Property_Location, p_name AS Service_Description
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_shipdate) AS shipdate
              FROM lineitem GROUP BY l_orderkey, l_linenumber) v
        JOIN part ON partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "crew": """
        SELECT DISTINCT l_orderkey * 10 + l_linenumber AS Service_ID, l_suppkey AS Employee_ID FROM lineitem""",
    "invoice": """
        SELECT o_orderkey * 2 AS Invoice_ID, o_orderkey AS Contract_ID, o_custkey AS Client_ID,
               CAST(o_orderdate AS DATE) AS Invoice_Date, CAST(o_orderdate AS DATE) + 15 AS Due_Date,
               CAST(o_totalprice AS DECIMAL(10,2)) AS Total_Amount,
               CAST(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN floor(o_totalprice / 2) ELSE 0 END
                    AS DECIMAL(10,2)) AS Amount_Paid,
               CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'Partial' WHEN 'O' THEN 'Unpaid' END
                   AS Invoice_Status
        FROM orders
        UNION ALL
        SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 15,
               CAST(floor(o_totalprice / 10) AS DECIMAL(10,2)), CAST(0 AS DECIMAL(10,2)), 'Unpaid'
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "payment": """
        SELECT event_id AS Payment_ID, event_id % (SELECT count(*) FROM orders) AS Contract_ID,
               event_id % (SELECT count(*) FROM orders) * 2 AS Invoice_ID,
               CAST(value AS DECIMAL(10,2)) AS Payment_Amount,
               (['Check', 'Bank Transfer', 'Credit Card', 'Cash'])[event_id % 4 + 1] AS Payment_Method,
               CAST(ts AS DATE) AS Payment_Date, 'Paid' AS Payment_Status
        FROM events WHERE event_type = 'purchase'""",
    "feedback": """
        SELECT doc_id AS Feedback_ID, doc_id % (SELECT count(*) FROM customer) AS Client_ID,
               CASE WHEN lang <> 'de' THEN doc_id % (SELECT count(*) FROM orders) * 10 + 1 END AS Service_ID,
               n_chars % 5 + 1 AS Rating, text AS Comments, source AS Suggestions,
               DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS Feedback_Date
        FROM documents""",
    "referral": """
        SELECT c_custkey AS Referral_ID,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS Referrer_ID,
               CASE WHEN c_acctbal > 0 THEN c_custkey END AS Referee_ID, c_name AS Referee_Name,
               DATE '2024-01-01' + CAST(c_nationkey AS INTEGER) AS Referral_Date,
               (['Pending', 'Contacted', 'Verified'])[c_nationkey % 3 + 1] AS Status
        FROM customer""",
    "job": """
        SELECT l_orderkey * 10 + l_linenumber AS Service_ID, l_orderkey AS Estimate_ID,
               sum(CAST(l_quantity AS DECIMAL(6,2))) AS Hours,
               sum(CAST(l_extendedprice AS DECIMAL(10,2))) AS Estimated,
               CAST(CAST(sum(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100)) AS BIGINT) / 100.0
                    AS DECIMAL(12,2)) AS Actual,
               CAST(CAST(sum(floor(l_extendedprice * (1 - l_discount) * 100)) AS BIGINT) / 100.0
                    AS DECIMAL(12,2)) AS Labor
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
}


def _sql(roles: str, body: str) -> str:
    names = roles.split()
    ctes = ",\n".join(f"{name} AS ({ROLES[name]})" for name in names)
    return f"WITH {ctes}\n{body}" if names else body


def _day(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


def _num(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def _big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def _mean(total: str, count: str) -> str:
    """Mean of positive money to six digits, halves up, in whole-number arithmetic."""
    return f"((2 * CAST({total} * 100 AS HUGEINT) * 10000 + {count}) // (2 * {count})) / 1000000.0"


def _fields(spec: str) -> str:
    """`name`, `name:kind` or `name:kind=expression`; kinds are day, num, big and any."""
    wrap = {"day": _day, "num": _num, "big": _big, "any": str}
    items = []
    for part in spec.split(","):
        head, _, expression = part.strip().partition("=")
        name, _, kind = head.partition(":")
        items.append(f"{wrap[kind or 'any'](expression or name)} AS {name.split('.')[-1]}")
    return ", ".join(items)


def _select(roles: str, spec: str, source: str) -> str:
    return _sql(roles, f"SELECT {_fields(spec)} FROM {source}")


INVOICE_SPEC = (
    "Invoice_ID, Invoice_Date:day, Due_Date:day, Total_Amount:num, Amount_Paid:num,"
    "Balance_Due:num=Total_Amount - Amount_Paid, Invoice_Status")


def _aging(day: str, scheme: str) -> str:
    days = f"date_diff('day', Due_Date, DATE '{day}')"
    if scheme == "short":
        tail = "ELSE '60+ Days'"
    else:
        tail = f"WHEN {days} <= 90 THEN '61-90 Days' ELSE 'Over 90 Days'"
    return (f"CASE WHEN {days} <= 0 THEN 'Current' WHEN {days} <= 30 THEN '1-30 Days' "
            f"WHEN {days} <= 60 THEN '31-60 Days' {tail} END")


OVERDUE = "date_diff('day', Due_Date, DATE '2001-07-01')"
FANOUT = "service s JOIN contract k ON s.Contract_ID = k.Contract_ID JOIN invoice i ON k.Contract_ID = i.Contract_ID"
JOBS = "job j JOIN service s ON j.Service_ID = s.Service_ID JOIN client c ON s.Client_ID = c.Client_ID"
JOB_SPEC = (
    "Job_Cost_ID=j.Service_ID, Service_ID=j.Service_ID, Service_Type, Service_Date:day, Client_Name,"
    "Property_Location, Total_Estimated_Cost:num=Estimated, Total_Actual_Cost:num=Actual,"
    "Actual_Labor_Hours:num=Hours, Actual_Labor_Cost:num=Labor, Actual_Materials:num=Actual - Labor,"
    "Variance:num=Actual - Estimated,"
    "Budget_Status=CASE WHEN Actual > Estimated THEN 'Over Budget' WHEN Actual < Estimated THEN 'Under Budget'"
    " ELSE 'On Budget' END")
ESTIMATES = "estimate e JOIN client c ON e.Client_ID = c.Client_ID LEFT JOIN employee m ON e.Employee_ID = m.Employee_ID"
ESTIMATE_SPEC = (
    "Estimate_ID, Client_Name, Property_Address=e.Property_Address, Service_Description, Estimated_Cost:num,"
    "Estimate_Date:day, Employee_ID=m.Employee_ID, Employee_Name, Employee_Role")
CLIENT_SPEC = "Client_ID, Client_Name, Client_Phone, Client_Email, Property_Address"
REVENUE_OF_CLIENT = (
    "client c JOIN contract k ON c.Client_ID = k.Client_ID JOIN invoice i ON k.Contract_ID = i.Contract_ID")
CLIENT_REVENUE_SPEC = (
    "Total_Contracts=count(DISTINCT k.Contract_ID), Total_Billed:num=sum(Total_Amount),"
    "Total_Collected:num=sum(Amount_Paid), Outstanding_Balance:num=sum(Total_Amount) - sum(Amount_Paid)")


def _top_clients(limit: int) -> str:
    return (f"SELECT {_fields('Client_ID=c.Client_ID, Client_Name,' + CLIENT_REVENUE_SPEC)} FROM {REVENUE_OF_CLIENT} "
            f"GROUP BY c.Client_ID, Client_Name ORDER BY sum(Amount_Paid) DESC, c.Client_ID LIMIT {limit}")


EMPLOYEE_CLIENTS = f"""
    SELECT x.Employee_ID AS Employee_ID, Employee_Name, c.Client_ID AS Client_ID, Client_Name, Client_Phone,
           Client_Email, c.Property_Address AS Property_Address, {_day('max(Service_Date)')} AS Last_Service_Date,
           count(DISTINCT s.Service_ID) AS Times_Served, max(Service_Description) AS Last_Description
    FROM crew x JOIN employee e ON x.Employee_ID = e.Employee_ID JOIN service s ON x.Service_ID = s.Service_ID
    JOIN client c ON s.Client_ID = c.Client_ID
    GROUP BY x.Employee_ID, Employee_Name, c.Client_ID, Client_Name, Client_Phone, Client_Email, c.Property_Address"""

PERIOD_ROWS = """
    SELECT p.m AS Month, p.y AS Year, count(Invoice_ID) AS n,
           coalesce(sum(Total_Amount), 0) AS billed, coalesce(sum(Amount_Paid), 0) AS paid
    FROM (VALUES (5, 1997), (NULL, 1997), (3, NULL), (NULL, NULL), (1, 2030)) p(m, y)
    LEFT JOIN invoice ON (p.m IS NULL OR month(Invoice_Date) = p.m) AND (p.y IS NULL OR year(Invoice_Date) = p.y)
    GROUP BY p.m, p.y"""


def _dedup_revenue(key: str) -> str:
    """Each invoice once per group."""
    return (f"(SELECT DISTINCT s.{key} AS grp, i.Invoice_ID, i.Total_Amount FROM {FANOUT})")


def _paid(compat: bool) -> str:
    tested = "Amount_Paid + received + last" if compat else "Amount_Paid + received"
    spec = (
        "Invoice_ID=i.Invoice_ID, Contract_ID, Client_ID, Invoice_Date:day, Due_Date:day, Total_Amount:num,"
        "Amount_Paid:num=Amount_Paid + coalesce(received~ 0),"
        f"Invoice_Status=CASE WHEN received IS NULL THEN Invoice_Status WHEN {tested} >= Total_Amount THEN 'Paid'"
        f" WHEN {tested} > 0 THEN 'Partial' ELSE 'Unpaid' END")
    return _sql("invoice payment", f"SELECT {_fields(spec).replace('~', ',')} FROM invoice i LEFT JOIN "
                "(SELECT Invoice_ID, sum(Payment_Amount) AS received, arg_max(Payment_Amount, Payment_ID) AS last "
                "FROM payment GROUP BY Invoice_ID) p ON i.Invoice_ID = p.Invoice_ID")


def _reasons(cases: list[tuple[str, str]], source: str, roles: str = "") -> str:
    """Row counts by the first reason that applies, `accepted` where none does."""
    return _sql(roles, f"SELECT reason, count(*) AS Row_Count FROM (SELECT {_first(cases)} AS reason FROM {source}) "
                       "GROUP BY reason")


def _first(cases: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {broken} THEN '{reason}'" for broken, reason in cases)
    return f"CASE {whens} ELSE 'accepted' END"


def _unknown(value: str, key: str, table: str) -> str:
    return f"{value} IS NOT NULL AND {value} NOT IN (SELECT {key} FROM {table})"


# Rules of each form in the order in which a first failure is reported.
FORM_RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "feedback": ("documents", [
        ("n_chars % 7 NOT BETWEEN 1 AND 5", "Rating is not in 1..5"),
        (_unknown("doc_id * 3", "c_custkey", "customer"), "Client_ID is unknown"),
        ("lang <> 'de' AND doc_id * 10 + 1 NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem)",
         "Service_ID is unknown"),
    ]),
    "estimate request": ("documents", [
        ("lang = 'es'", "Client_Name is required"),
        ("trim(text) = ''", "Service_Description is required"),
        ("n_chars >= 9999.995", "Estimated_Labor_Hours does not fit decimal(6,2)"),
    ]),
    "client": ("documents", [("length(text) > 255", "Property_Address is longer than 255")]),
    "contract": ("events", [
        ("event_type = 'error'", "Estimate_ID is required"),
        (_unknown("event_id * 2", "o_orderkey", "orders"), "Estimate_ID is unknown"),
        (_unknown("user_id", "c_custkey", "customer"), "Client_ID is unknown"),
        ("CAST(value AS DECIMAL(10,2)) <= 20", "Pricing is not positive"),
    ]),
    "estimate": ("events", [
        (_unknown("user_id", "c_custkey", "customer"), "Client_ID is unknown"),
        ("event_type <> 'view' AND user_id NOT IN (SELECT s_suppkey FROM supplier)", "Employee_ID is unknown"),
        ("event_type = 'purchase' AND event_id * 10 + 1 NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem)",
         "Service_ID is unknown"),
    ]),
    "invoice": ("events", [
        ("event_type = 'error'", "Contract_ID is required"),
        (_unknown("event_id", "o_orderkey", "orders"), "Contract_ID is unknown"),
        (_unknown("user_id", "c_custkey", "customer"), "Client_ID is unknown"),
    ]),
    "payment": ("events", [
        ("event_type = 'error'", "Payment_Amount is required"),
        (_unknown("event_id * 3", "o_orderkey", "orders"), "Contract_ID is unknown"),
    ]),
    "job costing": ("events", [
        ("event_type = 'signup'", "Service_ID is required"),
        (_unknown("event_id * 10 + 1", "l_orderkey * 10 + l_linenumber", "lineitem"), "Service_ID is unknown"),
        (_unknown("event_id", "o_orderkey", "orders"), "Estimate_ID is unknown"),
    ]),
    "employee": ("documents", [("doc_id NOT IN (SELECT doc_id FROM labels)", "Employee_Role is required")]),
    "status change": ("events", [
        ("event_type NOT IN ('signup', 'error')", "is_active is required"),
        (_unknown("user_id", "s_suppkey", "supplier"), "Employee_ID is unknown"),
    ]),
    "referral": ("events", [
        ("event_type = 'error'", "Referee_Name is required"),
        ("event_type <> 'view' AND user_id NOT IN (SELECT c_custkey FROM customer)", "Referrer_ID is unknown"),
    ]),
}


# Further rules of the form pages, as (rule of the form before which they stand, condition, reason).
PAGE_RULES: dict[str, list[tuple[str, str, str]]] = {
    "contract": [
        ("Estimate_ID is unknown", "event_id % 7 = 0", "Contract_StartDate is required"),
        ("Estimate_ID is unknown", "event_id % 3 = 0", "Contract_EndDate is required"),
    ],
    "estimate": [
        ("Client_ID is unknown", "event_id % 11 = 0", "Property_Address is required"),
        ("Client_ID is unknown", "event_id % 13 = 0 OR props IS NULL OR trim(props) = ''", "Service_Description is required"),
        ("Client_ID is unknown", "event_id % 17 = 0", "Estimate_Date is required"),
        ("Client_ID is unknown", "event_id % 5 = 0 OR CAST(value AS DECIMAL(10,2)) <= 0", "Estimated_Cost is not positive"),
        ("Client_ID is unknown", "event_id % 4 = 0", "Estimated_Labor_Hours is not positive"),
    ],
    "invoice": [
        ("Contract_ID is unknown", "event_id % 7 = 0", "Invoice_Date is required"),
        ("Contract_ID is unknown", "event_id % 3 = 0", "Due_Date is required"),
        ("Contract_ID is unknown", "event_id % 5 = 0 OR CAST(value AS DECIMAL(10,2)) <= 0", "Total_Amount is not positive"),
    ],
    "payment": [
        ("Contract_ID is unknown", "event_type = 'view'", "Invoice_ID is required"),
        ("Contract_ID is unknown", "CAST(value AS DECIMAL(10,2)) <= 20", "Payment_Amount is not positive"),
    ],
    "job costing": [
        ("Service_ID is unknown", "CAST(value AS DECIMAL(10,2)) <= 20", "Total_Actual_Cost is not positive"),
        ("Service_ID is unknown", "user_id <= 100", "Total_Estimated_Cost is not positive"),
    ],
}


def _page_rules(form: str) -> list[tuple[str, str]]:
    """The rules of a form with those of its page, in the order of checking."""
    rules = []
    for broken, reason in FORM_RULES[form][1]:
        rules += [(condition, further) for before, condition, further in PAGE_RULES.get(form, []) if before == reason]
        rules.append((broken, reason))
    return rules


def _accepted(form: str) -> str:
    source, rules = FORM_RULES[form]
    return f"(SELECT * FROM {source} WHERE {_first(rules)} = 'accepted')"


def _rejects() -> str:
    parts = [
        f"SELECT '{form}' AS form, {_first(_page_rules(form))} AS reason FROM {source}"
        for form, (source, _) in FORM_RULES.items()
    ]
    return (f"SELECT form, reason, count(*) AS Row_Count FROM ({' UNION ALL '.join(parts)}) "
            "WHERE reason <> 'accepted' GROUP BY form, reason")


def _form(form: str, spec: str) -> str:
    return f"SELECT {_fields(spec).replace('~', ',')} FROM {_accepted(form)}"


INGEST_DATE = "'2024-02-01'"
VALUE = "CAST(value AS DECIMAL(10,2))"


# Role of each table, in the order of the schema, and the query that each view has a row for.
TABLE_ROLES = {
    "Client": "client", "Employee": "employee", "Estimate": "estimate", "Contract": "contract", "Service": "service",
    "Service_Employee": "crew", "Invoice": "invoice", "Payment": "payment", "Client_Feedback": "feedback",
    "Referral": "referral", "Job_Costing": "job",
}
VIEW_QUERIES = {
    "vw_ClientFeedback": "vw_client_feedback", "vw_EstimateEmployees": "vw_estimate_employees",
    "vw_ServiceEmployees": "vw_service_employees", "vw_PaymentsThisMonth": "vw_payments_this_month",
    "vw_RevenueByServiceType": "vw_revenue_by_service_type", "vw_TopClientsByRevenue": "vw_top_clients_by_revenue",
    "vw_RevenueByLocation": "vw_revenue_by_location", "vw_MonthlyRevenueReport": "vw_monthly_revenue_report",
    "vw_OutstandingInvoices": "vw_outstanding_invoices", "vw_ClientServiceHistory": "vw_client_service_history",
    "vw_JobCostingReport": "vw_job_costing", "vw_ScheduleWorkload": "schedule_workload", "vw_Employee_Clients": "vw_employee_clients",
}


def _unknown_parents() -> str:
    keys = {table: SCHEMAS[table].names[0] for table in SCHEMAS}
    checks = [
        f"""SELECT '{child}' AS Table_Name, '{column}' AS Column_Name, count(*) AS Row_Count FROM {TABLE_ROLES[child]}
            WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {keys[parent]} FROM {TABLE_ROLES[parent]}) HAVING count(*) > 0"""
        for (child, column), parent in FOREIGN_KEYS.items()
    ]
    return _sql(" ".join(TABLE_ROLES.values()), " UNION ALL ".join(checks))


def oracle_sql() -> dict[str, str]:
    found = _plain_sql()
    counted = " UNION ALL ".join(f"SELECT '{view}' AS View_Name, (SELECT count(*) FROM ({found[query]})) AS Row_Count"
                                 for view, query in VIEW_QUERIES.items())
    return found | {
        "foreign_key_checks": _unknown_parents(),
        "foreign_key_check_repeated": found["foreign_key_check"],
        "employee_clients_repeated": found["vw_employee_clients"],
        "stored_round_trip": _sql("invoice", f"""
            SELECT count(*) AS Invoice_Count, {_num('sum(Total_Amount)')} AS Total_Billed, {_num('sum(Amount_Paid)')} AS Total_Collected,
                   {_num('sum(Total_Amount) - sum(Amount_Paid)')} AS Total_Outstanding FROM invoice"""),
        "balances_round_trip": found["apply_payments"],
        "views_by_name": counted,
        "revenue_by_service_repeated": found["revenue_by_service_deduplicated"],
        **{f"{view}_by_name": found[query] for view, query in VIEW_QUERIES.items()},
        "payments_ingested_twice": found["ingest_payments"].replace("event_id AS submission_id, ", "", 1),
    }


def _plain_sql() -> dict[str, str]:
    month = "strftime(Invoice_Date, '%B')"
    wanted = "(SELECT Client_ID FROM feedback)"
    return {
        # look-ups, projections, filters
        "clients_list": _select("client", "Client_ID, Client_Name", "client"),
        "clients_full": _select("client", CLIENT_SPEC, "client"),
        "client_by_id": _select(
            "client referral", CLIENT_SPEC, "client WHERE Client_ID IN (SELECT Referrer_ID FROM referral)"),
        "client_exists": _reasons([(_unknown("event_id", "c_custkey", "customer"), "Client_ID is unknown")], "events"),
        "employees_list": _select("employee", "Employee_ID, Employee_Name, Employee_Role", "employee"),
        "employee_lookups": _sql("employee", """
            SELECT u.user_id AS Employee_ID, Employee_Name, Employee_Role, CAST(Is_Available AS BIGINT) AS Is_Available,
                   CAST(e.Employee_ID IS NOT NULL AS BIGINT) AS Found
            FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN employee e ON u.user_id = e.Employee_ID"""),
        "service_employees": _select(
            "employee", "Employee_ID, Employee_Name, Employee_Role, Employee_Phone, Employee_Email, Is_Available:big",
            "employee WHERE Is_Available = 1"),
        "vw_service_employees": _select(
            "employee", "Employee_ID, Employee_Name, Employee_Role, Employee_Phone, Is_Available:big",
            "employee WHERE Is_Available = 1"),
        "services_by_client": _select(
            "service feedback", "Client_ID, Service_ID, Service_Type, Service_Date:day",
            f"service WHERE Client_ID IN {wanted}"),
        "contracts_list": _select(
            "client contract", "Contract_ID, Client_Name, Pricing:num, Service_Scope",
            "contract k JOIN client c ON k.Client_ID = c.Client_ID"),
        "contracts_for_client": _select(
            "client contract feedback", "Contract_ID, Client_Name, Pricing:num, Service_Scope",
            f"contract k JOIN client c ON k.Client_ID = c.Client_ID WHERE k.Client_ID IN {wanted}"),
        "invoices_by_client": _select("invoice", f"Contract_ID, Client_ID, {INVOICE_SPEC}", "invoice"),
        "filter_invoices": _select(
            "invoice client", f"Contract_ID, Client_ID=i.Client_ID, Client_Name, {INVOICE_SPEC}",
            "invoice i JOIN client c ON i.Client_ID = c.Client_ID WHERE Invoice_Status = 'Partial'"),
        "estimate_by_id": _select(
            "estimate client employee", f"{ESTIMATE_SPEC}, Client_ID=e.Client_ID, Estimated_Labor_Hours:num",
            f"{ESTIMATES} WHERE Estimate_ID IN (SELECT l_orderkey FROM lineitem)"),
        "filter_estimates": _select(
            "estimate client employee feedback", f"{ESTIMATE_SPEC}, Client_ID=e.Client_ID, Estimated_Labor_Hours:num",
            f"{ESTIMATES} WHERE e.Client_ID IN {wanted}"),
        "services_report": _select(
            "service client",
            "Service_ID, Client_ID=s.Client_ID, Client_Name, Service_Description, Service_Date:day, Property_Location",
            "service s JOIN client c ON s.Client_ID = c.Client_ID WHERE Service_Description ILIKE '%ring%' "
            "AND Service_Date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"),
        "filter_referrals": _select(
            "referral client",
            "Referral_ID, Referee_Name, Referrer_ID, Referrer_Name=a.Client_Name, Referee_ID,"
            "Referee_Client_Name=b.Client_Name, Referral_Date:day, Status",
            "referral LEFT JOIN client a ON Referrer_ID = a.Client_ID LEFT JOIN client b ON Referee_ID = b.Client_ID "
            "WHERE lower(Referee_Name) LIKE '%customer#0000000%'"),
        "hourly_rates": _sql("estimate", f"""
            SELECT Estimate_ID, {_num('Estimated_Cost')} AS Estimated_Cost,
                   {_num('Estimated_Labor_Hours')} AS Estimated_Labor_Hours,
                   CASE WHEN Estimated_Cost > 0 AND Estimated_Labor_Hours > 0 THEN
                       ((2 * CAST(Estimated_Cost * 100 AS BIGINT) + CAST(Estimated_Labor_Hours AS BIGINT))
                        // (2 * CAST(Estimated_Labor_Hours AS BIGINT))) / 100.0 ELSE 0.0 END AS Hourly_Rate
            FROM estimate"""),
        "days_overdue_clamped": _sql("invoice client", f"""
            SELECT Invoice_ID, greatest(date_diff('day', Due_Date, DATE '1998-06-30'), 0) AS Days_Overdue,
                   {_aging('1998-06-30', 'short')} AS Aging_Bucket
            FROM invoice JOIN client USING (Client_ID) WHERE Invoice_Status IN ('Unpaid', 'Partial')"""),
        "labelled_estimates": _sql("estimate client employee", f"""
            SELECT Estimate_ID, {_day('Estimate_Date')} AS Estimate_Date, Client_Name,
                   e.Property_Address AS Property_Address, Service_Description,
                   {_num('Estimated_Cost')} AS Estimated_Cost, m.Employee_ID AS Employee_ID,
                   coalesce(Employee_Name, 'Unassigned') AS Employee_Name,
                   coalesce(Employee_Role, 'No Role') AS Employee_Role FROM {ESTIMATES}"""),
        "contract_drafts": _select(
            "estimate",
            "estimate_id=Estimate_ID, client_id=Client_ID, pricing:num=Estimated_Cost, service_scope=Service_Description",
            "estimate"),
        "invoice_calendar": _sql("invoice", f"""
            SELECT Invoice_ID, {OVERDUE} AS Days_Outstanding, strftime(Invoice_Date, '%Y-%m-01') AS Month_Start,
                   {month} AS Month_Name, {_day('Invoice_Date + 15')} AS Default_Due FROM invoice"""),
        "feedback_stars": _sql("feedback", "SELECT Feedback_ID, repeat('⭐', CAST(Rating AS BIGINT)) AS Stars FROM feedback"),
        # listings
        "client_feedback": _select(
            "feedback client service",
            "Feedback_ID, Client_ID=f.Client_ID, Client_Name, Service_Type, Service_Date:day, Rating, Comments,"
            "Suggestions, Feedback_Date:day",
            "feedback f JOIN client c ON f.Client_ID = c.Client_ID JOIN service s ON f.Service_ID = s.Service_ID"),
        "client_feedback_by_rating": _select(
            "feedback client service",
            "Feedback_ID, Client_ID=f.Client_ID, Client_Name, Service_Type, Service_Date:day, Rating, Comments,"
            "Suggestions, Feedback_Date:day",
            "feedback f JOIN client c ON f.Client_ID = c.Client_ID JOIN service s ON f.Service_ID = s.Service_ID "
            "WHERE Rating = 5"),
        "vw_client_feedback": _select(
            "feedback client service",
            "Feedback_ID, Client_ID=f.Client_ID, Client_Name, Service_ID=s.Service_ID, Service_Type, Rating, Comments,"
            "Suggestions, Feedback_Date:day",
            "feedback f JOIN client c ON f.Client_ID = c.Client_ID LEFT JOIN service s ON f.Service_ID = s.Service_ID"),
        "estimate_employees": _select(
            "estimate client employee", f"{ESTIMATE_SPEC}, Estimated_Labor_Hours:num", ESTIMATES),
        "estimate_employees_of_month": _select(
            "estimate client employee", f"{ESTIMATE_SPEC}, Estimated_Labor_Hours:num",
            f"{ESTIMATES} WHERE month(Estimate_Date) = 3 AND year(Estimate_Date) = 1997 AND m.Is_Available = 1"),
        "vw_estimate_employees": _select("estimate client employee", ESTIMATE_SPEC, ESTIMATES),
        "all_estimates": _select(
            "estimate client employee", f"{ESTIMATE_SPEC}, Client_ID=e.Client_ID, Estimated_Labor_Hours:num", ESTIMATES),
        "all_invoices": _select(
            "invoice client", f"Contract_ID, Client_ID=i.Client_ID, Client_Name, {INVOICE_SPEC}",
            "invoice i JOIN client c ON i.Client_ID = c.Client_ID"),
        "vw_payments_this_month": _select(
            "payment contract client invoice",
            "Payment_ID, Client_Name, Contract_ID=k.Contract_ID, Payment_Amount:num, Payment_Method, Payment_Date:day,"
            "Payment_Status, Invoice_ID=i.Invoice_ID, Invoice_Total:num=i.Total_Amount",
            "payment p JOIN contract k ON p.Contract_ID = k.Contract_ID JOIN client c ON k.Client_ID = c.Client_ID "
            "LEFT JOIN invoice i ON p.Invoice_ID = i.Invoice_ID "
            "WHERE month(Payment_Date) = 1 AND year(Payment_Date) = 2024"),
        "monthly_revenue": _select(
            "invoice client", f"{INVOICE_SPEC}, Client_Name, Year=year(Invoice_Date), Month=month(Invoice_Date)",
            "invoice i JOIN client c ON i.Client_ID = c.Client_ID"),
        "monthly_revenue_of_month": _select(
            "invoice client", f"{INVOICE_SPEC}, Client_Name, Year=year(Invoice_Date), Month=month(Invoice_Date)",
            "invoice i JOIN client c ON i.Client_ID = c.Client_ID "
            "WHERE month(Invoice_Date) = 5 AND year(Invoice_Date) = 1997"),
        "monthly_revenue_of_any_year": _select(
            "invoice client", f"{INVOICE_SPEC}, Client_Name, Year=year(Invoice_Date), Month=month(Invoice_Date)",
            "invoice i JOIN client c ON i.Client_ID = c.Client_ID WHERE month(Invoice_Date) = 12"),
        "outstanding_invoices": _sql("invoice client", f"""
            SELECT {_fields(INVOICE_SPEC)}, Client_Name, Client_ID, {OVERDUE} AS Days_Overdue,
                   {_aging('2001-07-01', 'short')} AS Aging_Bucket
            FROM invoice JOIN client USING (Client_ID) WHERE Invoice_Status IN ('Unpaid', 'Partial')"""),
        "vw_outstanding_invoices": _sql("invoice client contract", f"""
            SELECT {_fields(INVOICE_SPEC.rpartition(',')[0])}, c.Client_ID AS Client_ID, Client_Name, Client_Email,
                   {OVERDUE} AS Days_Overdue, {_aging('2001-07-01', 'long')} AS Aging_Bucket
            FROM invoice i JOIN contract k ON i.Contract_ID = k.Contract_ID JOIN client c ON i.Client_ID = c.Client_ID
            WHERE Invoice_Status <> 'Paid'"""),
        "recent_outstanding": _sql("invoice client", f"""
            SELECT Invoice_ID, Client_Name, {_num('Total_Amount - Amount_Paid')} AS Balance_Due,
                   {OVERDUE} AS Days_Overdue, {_aging('2001-07-01', 'short')} AS Aging_Bucket,
                   count(*) OVER () - 5 AS More_Count
            FROM invoice JOIN client USING (Client_ID) WHERE Invoice_Status IN ('Unpaid', 'Partial')
            ORDER BY Days_Overdue DESC, Invoice_ID LIMIT 5"""),
        "client_service_history": _history("TRUE"),
        "client_service_history_at": _history("Property_Location ILIKE '%tion_1%'"),
        "vw_client_service_history": _select(
            "client estimate contract service invoice payment",
            "Client_ID=c.Client_ID, Client_Name, Property_Address=c.Property_Address, Estimate_ID=e.Estimate_ID,"
            "Estimate_Date:day, Estimated_Cost:num, Contract_ID=k.Contract_ID, Contract_StartDate:day,"
            "Contract_EndDate:day, Service_ID=s.Service_ID, Service_Type, Service_Date:day, Property_Location,"
            "Invoice_ID=i.Invoice_ID, Total_Amount:num, Invoice_Status, Payment_ID, Payment_Amount:num, Payment_Date:day",
            "client c LEFT JOIN estimate e ON c.Client_ID = e.Client_ID "
            "LEFT JOIN contract k ON e.Estimate_ID = k.Estimate_ID LEFT JOIN service s ON k.Contract_ID = s.Contract_ID "
            "LEFT JOIN invoice i ON k.Contract_ID = i.Contract_ID LEFT JOIN payment p ON i.Invoice_ID = p.Invoice_ID"),
        "job_costing": _select(
            "job service client",
            f"{JOB_SPEC}, Estimate_ID, Grand_Total_Actual:num=sum(Actual) OVER (),"
            "Grand_Total_Estimated:num=sum(Estimated) OVER ()", JOBS),
        "job_costing_of_year": _select(
            "job service client",
            f"{JOB_SPEC}, Estimate_ID, Grand_Total_Actual:num=sum(Actual) OVER (),"
            "Grand_Total_Estimated:num=sum(Estimated) OVER ()", f"{JOBS} WHERE year(Service_Date) = 1997"),
        "vw_job_costing": _select("job service client", JOB_SPEC, JOBS),
        "schedule_workload": _select(
            "service client crew employee",
            "Service_ID=s.Service_ID, Service_Date:day, Service_Type, Client_Name, Property_Location, Employee_Name,"
            "Employee_Role, Status=CASE WHEN Service_Date < DATE '1998-06-15' THEN 'Completed'"
            " WHEN Service_Date = DATE '1998-06-15' THEN 'Today' ELSE 'Upcoming' END",
            "service s JOIN client c ON s.Client_ID = c.Client_ID JOIN crew x ON s.Service_ID = x.Service_ID "
            "JOIN employee e ON x.Employee_ID = e.Employee_ID"),
        "referrals": _referrals(),
        "sort_referrals": _referrals(),
        # aggregates and ranks
        "revenue_by_service": _sql("service contract invoice", f"""
            SELECT Service_Type, count(DISTINCT s.Service_ID) AS Total_Services,
                   {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_mean('sum(Total_Amount)', 'count(Total_Amount)')} AS Avg_Revenue,
                   {_day('min(Service_Date)')} AS First_Service, {_day('max(Service_Date)')} AS Latest_Service
            FROM {FANOUT} GROUP BY Service_Type"""),
        "revenue_by_service_deduplicated": _sql("service contract invoice", f"""
            SELECT Service_Type, Total_Services, {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_mean('sum(Total_Amount)', 'count(Total_Amount)')} AS Avg_Revenue, First_Service, Latest_Service
            FROM {_dedup_revenue('Service_Type')} d JOIN (
                SELECT Service_Type, count(DISTINCT s.Service_ID) AS Total_Services,
                       {_day('min(Service_Date)')} AS First_Service, {_day('max(Service_Date)')} AS Latest_Service
                FROM {FANOUT} GROUP BY Service_Type) t ON d.grp = t.Service_Type
            GROUP BY Service_Type, Total_Services, First_Service, Latest_Service"""),
        "vw_revenue_by_service_type": _sql("service contract invoice", f"""
            SELECT Service_Type, count(s.Service_ID) AS Total_Services,
                   {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_mean('sum(Total_Amount)', 'count(Total_Amount)')} AS Avg_Revenue_Per_Service,
                   {_day('min(Service_Date)')} AS Earliest_Service, {_day('max(Service_Date)')} AS Latest_Service
            FROM {FANOUT} GROUP BY Service_Type"""),
        "vw_revenue_by_location": _sql("service contract invoice", f"""
            SELECT Property_Location, count(s.Service_ID) AS Total_Services,
                   {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_mean('sum(Total_Amount)', 'count(Total_Amount)')} AS Avg_Revenue
            FROM {FANOUT} WHERE Property_Location IS NOT NULL GROUP BY Property_Location"""),
        "vw_revenue_by_location_deduplicated": _sql("service contract invoice", f"""
            SELECT Property_Location, Total_Services, {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_mean('sum(Total_Amount)', 'count(Total_Amount)')} AS Avg_Revenue
            FROM {_dedup_revenue('Property_Location')} d JOIN (
                SELECT Property_Location, count(s.Service_ID) AS Total_Services
                FROM {FANOUT} GROUP BY Property_Location) t ON d.grp = t.Property_Location
            GROUP BY Property_Location, Total_Services"""),
        "vw_monthly_revenue_report": _sql("service client contract invoice", f"""
            SELECT year(Service_Date) AS Revenue_Year, month(Service_Date) AS Revenue_Month, Service_Type, Client_Name,
                   Property_Location, {_num('sum(Total_Amount)')} AS Total_Revenue,
                   {_num('sum(Amount_Paid)')} AS Total_Received, count(s.Service_ID) AS Services_Rendered
            FROM {FANOUT} JOIN client c ON s.Client_ID = c.Client_ID
            GROUP BY year(Service_Date), month(Service_Date), Service_Type, Client_Name, Property_Location"""),
        "top_clients": _sql("client contract invoice", _top_clients(10)),
        "vw_top_clients_by_revenue": _sql(
            "client contract invoice",
            f"SELECT {_fields('Client_ID=c.Client_ID, Client_Name, Client_Email, Client_Phone,' + CLIENT_REVENUE_SPEC)} "
            f"FROM {REVENUE_OF_CLIENT} GROUP BY c.Client_ID, Client_Name, Client_Email, Client_Phone"),
        "rank_clients": _sql(
            "client contract invoice",
            f"SELECT *, row_number() OVER (ORDER BY Total_Collected DESC, Client_ID) AS Rank FROM ({_top_clients(25)})"),
        "rank_clients_with_feedback": _sql(
            "client contract invoice feedback",
            "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY Total_Collected DESC, Client_ID) AS Rank "
            f"FROM ({_top_clients(100)})) WHERE Client_ID IN {wanted}"),
        "clients_ranked": _sql(
            "client contract invoice",
            f"SELECT *, row_number() OVER (ORDER BY Total_Collected DESC, Client_ID) AS Rank FROM ({_top_clients(1_000_000)})"),
        "clients_in_order": _sql(
            "client", "SELECT Client_ID, Client_Name, row_number() OVER (ORDER BY Client_Name, Client_ID) AS Position FROM client"),
        "contracts_in_order": _sql("client contract", f"""
            SELECT Contract_ID, Client_Name, {_num('Pricing')} AS Pricing, Service_Scope,
                   row_number() OVER (ORDER BY Contract_ID DESC) AS Position
            FROM contract k JOIN client c ON k.Client_ID = c.Client_ID"""),
        "outstanding_in_order": _sql("invoice client", f"""
            SELECT Invoice_ID, {OVERDUE} AS Days_Overdue, row_number() OVER (ORDER BY {OVERDUE} DESC, Invoice_ID) AS Position
            FROM invoice JOIN client USING (Client_ID) WHERE Invoice_Status IN ('Unpaid', 'Partial')"""),
        "referrals_in_order": "SELECT *, row_number() OVER (ORDER BY lower(coalesce(Referrer_Name, '')), Referral_ID) AS Position "
                              f"FROM ({_referrals()})",
        "client_history_entries": _entries("TRUE"),
        "client_history_entries_at": _entries("Property_Location ILIKE '%tion_1%'"),
        "vw_employee_clients": _sql("crew employee service client", EMPLOYEE_CLIENTS),
        "my_clients": _sql("crew employee service client", f"""
            SELECT * EXCLUDE (Employee_Name) FROM ({EMPLOYEE_CLIENTS})
            WHERE Employee_ID IN (SELECT Employee_ID FROM employee WHERE Is_Available = 1)"""),
        "dashboard_stats": _sql("invoice", f"""
            SELECT (SELECT count(*) FROM customer) AS Clients, (SELECT count(*) FROM orders) AS Contracts,
                   count(*) FILTER (WHERE Invoice_Status IN ('Unpaid', 'Partial')) AS Open_Invoices,
                   {_num('coalesce(sum(Total_Amount), 0)')} AS Total_Invoiced FROM invoice"""),
        "employee_count": "SELECT count(*) AS Employee_Count FROM supplier",
        "service_types": _sql("service", "SELECT DISTINCT Service_Type AS Service_Type FROM service"),
        "invoice_totals": _sql("invoice", f"""
            SELECT count(*) AS Invoice_Count, {_num('sum(Total_Amount)')} AS Total_Billed,
                   {_num('sum(Amount_Paid)')} AS Total_Collected,
                   {_num('sum(Total_Amount - Amount_Paid)')} AS Total_Outstanding
            FROM invoice WHERE Invoice_Status IN ('Unpaid', 'Partial')"""),
        "period_totals": _sql("invoice", f"""
            SELECT coalesce(CAST(Month AS VARCHAR), 'all') || '-' || coalesce(CAST(Year AS VARCHAR), 'all') AS Period,
                   {_big('Month')} AS Month, {_big('Year')} AS Year, CASE Month WHEN 1 THEN 'January' WHEN 3 THEN 'March'
                   WHEN 5 THEN 'May' END AS Month_Name, n AS Invoice_Count, {_num('billed')} AS Total_Billed,
                   {_num('paid')} AS Total_Collected, {_num('billed - paid')} AS Total_Outstanding FROM ({PERIOD_ROWS})"""),
        "period_grand_total": _sql("invoice", f"""
            SELECT count(*) AS Period_Count, {_big('sum(n)')} AS Invoice_Count, {_num('sum(billed)')} AS Total_Billed,
                   {_num('sum(paid)')} AS Total_Collected, {_num('sum(billed - paid)')} AS Total_Outstanding
            FROM ({PERIOD_ROWS})"""),
        "monthly_chart": _sql("invoice", f"""
            SELECT y AS Year, m AS Month, n AS Invoice_Count, {_num('billed')} AS Total_Billed,
                   greatest({_big('(2 * cents * 140 + top) // (2 * top)')}, 4) AS Bar_Height
            FROM (SELECT *, CAST(billed * 100 AS HUGEINT) AS cents, CAST(max(billed) OVER () * 100 AS HUGEINT) AS top
                  FROM (SELECT year(Invoice_Date) AS y, month(Invoice_Date) AS m, count(*) AS n,
                               sum(Total_Amount) AS billed FROM invoice GROUP BY 1, 2))"""),
        "estimate_totals": _sql("estimate", f"""
            SELECT count(*) AS Estimate_Count, {_num('sum(Estimated_Cost)')} AS Total_Cost,
                   {_num('sum(Estimated_Labor_Hours)')} AS Total_Hours, {_mean('sum(Estimated_Cost)', 'count(*)')} AS Avg_Cost
            FROM estimate"""),
        "service_totals": _sql("service", """
            SELECT count(*) AS Total_Services, count(*) FILTER (WHERE Service_Description <> '') AS With_Description,
                   count(DISTINCT Client_ID) AS Unique_Clients FROM service"""),
        "job_cost_totals": _sql("job", f"""
            SELECT count(*) AS Record_Count, {_num('sum(Estimated)')} AS Total_Estimated,
                   {_num('sum(Actual)')} AS Total_Actual, {_num('sum(Actual) - sum(Estimated)')} AS Total_Variance FROM job"""),
        "outstanding_with_total": _sql("invoice", f"""
            SELECT Invoice_ID, {_num('Total_Amount')} AS Total_Amount, {_num('Amount_Paid')} AS Amount_Paid,
                   {_num('Total_Amount - Amount_Paid')} AS Balance_Due, CAST(NULL AS BIGINT) AS Row_Count,
                   'detail' AS Row_Kind FROM invoice WHERE Invoice_Status IN ('Unpaid', 'Partial')
            UNION ALL
            SELECT NULL, {_num('sum(Total_Amount)')}, {_num('sum(Amount_Paid)')},
                   {_num('sum(Total_Amount - Amount_Paid)')}, count(*), 'total'
            FROM invoice WHERE Invoice_Status IN ('Unpaid', 'Partial')"""),
        # checks
        "foreign_key_check": _sql("feedback service", """
            SELECT 'Service_ID is unknown' AS reason, count(*) AS Row_Count FROM feedback
            WHERE Service_ID IS NOT NULL AND Service_ID NOT IN (SELECT Service_ID FROM service) HAVING count(*) > 0"""),
        "size_check": _reasons([("length(text) > 255", "Property_Address is longer than 255")], "documents"),
        "value_check": _reasons([("n_chars % 8 NOT BETWEEN 1 AND 5", "Rating is not in 1..5")], "documents"),
        "required_check": _reasons(
            [("doc_id NOT IN (SELECT doc_id FROM labels)", "employee_role is required")], "documents"),
        "unique_check": _reasons(
            [("count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1", "l_orderkey, l_linenumber is not unique")],
            "lineitem"),
        "duplicate_keys": """
            SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS Row_Count
            FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "one_per_key": f"""
            SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
                   {_day('l_shipdate')} AS l_shipdate, l_partkey, l_suppkey
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                               ORDER BY l_shipdate, l_partkey, l_suppkey) AS place FROM lineitem)
            WHERE place = 1""",
        "invoice_defaults": _sql("invoice", f"""
            SELECT Invoice_ID, {_num('CASE WHEN Amount_Paid = Total_Amount THEN 0 ELSE Amount_Paid END')} AS Amount_Paid,
                   CASE WHEN Invoice_Status = 'Partial' THEN 'Unpaid' ELSE Invoice_Status END AS Invoice_Status
            FROM invoice"""),
        # ingest
        "ingest_feedback": _form("feedback", f"""
            submission_id=doc_id, Client_ID=doc_id * 3, Service_ID=CASE WHEN lang <> 'de' THEN doc_id * 10 + 1 END,
            Rating=n_chars % 7, Comments=text, Suggestions='', Feedback_Date={INGEST_DATE}"""),
        "ingest_estimate_requests": _form("estimate request", f"""
            submission_id=doc_id, Client_Name=source, Client_Phone=CAST(NULL AS VARCHAR),
            Employee_ID=CAST(NULL AS BIGINT), Property_Address=lang, Service_Description=trim(text),
            Estimated_Cost:num=n_chars, Estimated_Labor_Hours:num=n_chars, Estimate_Date={INGEST_DATE}"""),
        "ingest_clients": _form("client", """
            submission_id=doc_id, Client_Name=source, Client_Phone=lang, Client_Email=CAST(NULL AS VARCHAR),
            Property_Address=text"""),
        "ingest_contracts": _form("contract", f"""
            submission_id=event_id, Estimate_ID=event_id * 2, Client_ID=user_id,
            Contract_StartDate:day=CASE WHEN event_id % 7 <> 0 THEN ts END, Contract_EndDate:day=CASE WHEN event_id % 3 <> 0 THEN ts END, Pricing:num={VALUE.replace(',', '~')} - 20,
            Service_Scope=event_type, Contract_Duration='1 month'"""),
        "ingest_estimates": _form("estimate", f"""
            submission_id=event_id, Client_ID=user_id, Employee_ID=CASE WHEN event_type <> 'view' THEN user_id END,
            Property_Address=CASE WHEN event_id % 11 <> 0 THEN event_type END,
            Service_Description=CASE WHEN event_id % 13 <> 0 THEN props END,
            Estimated_Cost:num=CASE WHEN event_id % 5 = 0 THEN 0 ELSE {VALUE.replace(',', '~')} END,
            Estimated_Labor_Hours:num=event_id % 4, Estimate_Date:day=CASE WHEN event_id % 17 <> 0 THEN ts END"""),
        "ingest_estimates_costed": _form("estimate", f"""
            submission_id=event_id, Service_ID=event_id * 10 + 1, Actual_Labor_Hours=CAST(0 AS DOUBLE),
            Actual_Labor_Cost=CAST(0 AS DOUBLE), Actual_Materials=CAST(0 AS DOUBLE),
            Total_Actual_Cost:num={VALUE.replace(',', '~')} + 1,
            Total_Estimated_Cost:num=CASE WHEN event_id % 5 = 0 THEN 0 ELSE {VALUE.replace(',', '~')} END""") + " WHERE event_type = 'purchase'",
        "ingest_invoices": f"""
            SELECT submission_id, Contract_ID, Client_ID, {_day('day')} AS Invoice_Date, {_day('coalesce(due, day + 15)')} AS Due_Date,
                   {_num('total')} AS Total_Amount, {_num('paid')} AS Amount_Paid,
                   CASE WHEN paid <= 0 THEN 'Unpaid' WHEN paid >= total THEN 'Paid' ELSE 'Partial' END AS Invoice_Status
            FROM (SELECT event_id AS submission_id, event_id AS Contract_ID, user_id AS Client_ID,
                         CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END AS due,
                         CASE WHEN event_id % 5 = 0 THEN 0 ELSE {VALUE} END AS total,
                         CASE WHEN event_type = 'purchase' THEN {VALUE} + 1 WHEN event_type <> 'click' THEN floor(value / 2) ELSE 0 END AS paid
                  FROM {_accepted('invoice')})""",
        "ingest_payments": _form("payment", f"""
            submission_id=event_id, Contract_ID=event_id * 3,
            Invoice_ID=CASE WHEN event_type <> 'view' THEN event_id * 6 END,
            Payment_Amount:num={VALUE.replace(',', '~')} - 20, Payment_Method=event_type,
            Due_Date=CAST(NULL AS VARCHAR), Payment_Date:day=ts, Payment_Status='Paid'"""),
        "ingest_job_costing": _form("job costing", f"""
            submission_id=event_id, Service_ID=event_id * 10 + 1, Estimate_ID=event_id,
            Actual_Labor_Hours=CAST(0 AS DOUBLE), Actual_Labor_Cost=CAST(0 AS DOUBLE), Actual_Materials=CAST(0 AS DOUBLE),
            Total_Actual_Cost:num={VALUE.replace(',', '~')} - 20, Total_Estimated_Cost:num=user_id - 100,
            Variance:num={VALUE.replace(',', '~')} - user_id + 80,
            Budget_Status=CASE WHEN {VALUE.replace(',', '~')} + 80 > user_id THEN 'Over Budget'
                WHEN {VALUE.replace(',', '~')} + 80 < user_id THEN 'Under Budget' ELSE 'On Budget' END"""),
        "ingest_employees": _form("employee", """
            submission_id=doc_id, Employee_Name=source,
            Employee_Role=(SELECT 'Grade ' || any_value(quality) FROM labels b WHERE b.doc_id = t.doc_id),
            Employee_Phone=CAST(NULL AS VARCHAR), Employee_Email=CAST(NULL AS VARCHAR),
            Is_Available=CAST(1 AS BIGINT)""") + " t",
        "ingest_referrals": _form("referral", f"""
            submission_id=event_id, Referrer_ID=CASE WHEN event_type <> 'view' THEN user_id END,
            Referee_ID=CAST(NULL AS BIGINT), Referee_Name='guest ' || event_id, Referral_Date={INGEST_DATE},
            Status='Pending'"""),
        "apply_status_changes": _sql("employee", f"""
            SELECT e.Employee_ID AS Employee_ID, Employee_Name, Employee_Role, Employee_Phone, Employee_Email,
                   CAST(coalesce(last, Is_Available) AS BIGINT) AS Is_Available
            FROM employee e LEFT JOIN (
                SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END, event_id) AS last
                FROM {_accepted('status change')} GROUP BY user_id) c ON e.Employee_ID = c.user_id"""),
        "ingest_rejects": _rejects(),
        "assigned_ids": f"""
            SELECT (SELECT max(event_id) FROM events WHERE event_type = 'purchase') + 1 AS First_ID,
                   (SELECT max(event_id) FROM events WHERE event_type = 'purchase') + count(*) AS Last_ID,
                   count(*) AS Row_Count, count(*) AS ID_Count FROM {_accepted('payment')}""",
        # payments and balances
        "apply_payments": _paid(False),
        "apply_payments_compat": _paid(True),
        "payment_stream_balances": _paid(False),
    }


def _history(condition: str) -> str:
    return _select(
        "client service contract invoice",
        "Client_ID=c.Client_ID, Client_Name, Client_Phone, Client_Email, Service_ID, Service_Date:day, Service_Type,"
        "Property_Location, Contract_ID=k.Contract_ID, Contract_Price:num=Pricing, Invoice_ID, Invoice_Status,"
        "Total_Amount:num, Amount_Paid:num",
        "client c JOIN service s ON s.Client_ID = c.Client_ID JOIN contract k ON s.Contract_ID = k.Contract_ID "
        f"JOIN invoice i ON k.Contract_ID = i.Contract_ID WHERE {condition}")


def _entries(condition: str) -> str:
    pairs = (f"SELECT s.Client_ID, Client_Name, s.Contract_ID, s.Service_ID, Service_Date, Service_Type, i.Invoice_ID, Invoice_Date, Invoice_Status, Total_Amount "
             f"FROM service s JOIN client c ON s.Client_ID = c.Client_ID JOIN contract k ON s.Contract_ID = k.Contract_ID "
             f"JOIN invoice i ON k.Contract_ID = i.Contract_ID WHERE {condition}")
    head = "Client_ID, Client_Name, Contract_ID"
    return _sql("client service contract invoice payment", f"""
        SELECT DISTINCT {head}, 'service' AS Entry_Kind, Service_ID AS Entry_ID, {_day('Service_Date')} AS Entry_Date, Service_Type AS Detail,
               CAST(NULL AS DOUBLE) AS Amount FROM ({pairs})
        UNION ALL
        SELECT DISTINCT {head}, 'invoice', Invoice_ID, {_day('Invoice_Date')}, Invoice_Status, {_num('Total_Amount')} FROM ({pairs})
        UNION ALL
        SELECT DISTINCT Client_ID, Client_Name, p.Contract_ID, 'payment', Payment_ID, {_day('Payment_Date')}, Payment_Method, {_num('Payment_Amount')}
        FROM ({pairs}) x JOIN payment p ON x.Contract_ID = p.Contract_ID""")


def _referrals() -> str:
    return _select(
        "referral client",
        "Referral_ID, Referee_Name, Referrer_ID, Referrer_Name=a.Client_Name, Referee_ID,"
        "Referee_Client_Name=b.Client_Name, Referral_Date:day, Status",
        "referral LEFT JOIN client a ON Referrer_ID = a.Client_ID LEFT JOIN client b ON Referee_ID = b.Client_ID")
