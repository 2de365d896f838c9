"""The books of sources.books in DuckDB SQL, for the SQL counterparts of the queries."""

F1 = """li AS (SELECT l_orderkey, count(*) AS line_items,
             cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS total_units
           FROM lineitem GROUP BY l_orderkey),
snap AS (SELECT max(o_orderdate) AS snap_ts FROM orders),
aged AS (SELECT o_orderkey AS account_id,
    cast(floor(datediff('day', o_orderdate, snap_ts) / 30.0) AS int) AS tenure,
    o_totalprice AS MonthlyCharges, cast(coalesce(line_items, 0) AS bigint) AS line_items, total_units,
    nullif(o_orderpriority, '3-MEDIUM') AS Contract, c_mktsegment AS PaymentMethod,
    CASE WHEN n_nationkey % 3 = 0 THEN 'No' WHEN n_nationkey % 3 = 1 THEN 'Yes' ELSE 'No add-on' END AS TechSupport,
    r_name AS Region,
    CASE WHEN o_orderpriority = '1-URGENT'
         THEN CASE WHEN datediff('day', o_orderdate, snap_ts) < 730 THEN 'b333' ELSE '7333' END
         ELSE CASE WHEN datediff('day', o_orderdate, snap_ts) < 730 THEN '4ccd' ELSE '1999' END END AS thr
  FROM orders CROSS JOIN snap JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN li ON l_orderkey = o_orderkey),
f1 AS (SELECT account_id, tenure, MonthlyCharges, line_items, total_units, Contract, PaymentMethod, TechSupport, Region,
    CASE WHEN substr(md5(concat(cast(account_id AS varchar), '-y')), 1, 4) < thr THEN 'Yes' ELSE 'No' END AS Churn
  FROM aged),
book AS (SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS _y,
    1.0::double - least(tenure, 80) / 80.0::double AS score FROM f1)"""

F2 = """snap AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS snap_ts FROM orders),
h AS (SELECT o_custkey, count(*) AS n_orders, min(o_orderdate) AS first_order,
        cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total_spend
      FROM orders CROSS JOIN snap WHERE o_orderdate <= snap_ts GROUP BY o_custkey),
f AS (SELECT DISTINCT o_custkey FROM orders CROSS JOIN snap WHERE o_orderdate > snap_ts),
book AS (SELECT c_custkey AS customer_id, n_orders, total_spend, c_acctbal,
    cast(floor(datediff('day', first_order, snap_ts) / 30.0) AS int) AS tenure,
    c_mktsegment AS segment, r_name AS region, CASE WHEN f.o_custkey IS NULL THEN 1 ELSE 0 END AS churned
  FROM customer CROSS JOIN snap JOIN h ON h.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

F3 = F1 + """,
dirty AS (SELECT
    CASE WHEN account_id > 0 AND account_id % 97 = 0 THEN account_id - 1 ELSE account_id END AS account_id,
    CASE WHEN account_id % 11 = 0 THEN NULL WHEN account_id % 13 = 0 THEN ' ' WHEN account_id % 17 = 0 THEN 'n/k'
         ELSE ' $' || cast(cast(MonthlyCharges AS decimal(18,2)) AS varchar) || ' ' END AS MonthlyCharges,
    CASE WHEN account_id % 7 = 0 THEN ' ' || Contract || ' ' WHEN account_id % 19 = 0 THEN 'none' ELSE Contract END AS Contract,
    CASE WHEN account_id % 23 = 0 THEN 'unknown' WHEN account_id % 5 = 0 THEN upper(Churn) ELSE Churn || ' ' END AS Churn,
    'X' AS const_col, '2001-01-01' AS churn_date
  FROM f1)"""

F4 = """book AS (SELECT d.doc_id, lang, source, 1 - quality AS _y
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def sql(body: str, *books: str) -> str:
    """Prefix the body with the CTEs of its books."""
    return "WITH " + ",\n".join(books or (F1,)) + "\n" + body


def stacked(columns: list[str], source: str, keep: str = "", cast: str = "varchar") -> str:
    """UNION ALL of one SELECT per column: (column, value, keep…)."""
    extra = f", {keep}" if keep else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast({c} AS {cast}) AS value{extra} FROM {source}" for c in columns
    )


def number(expr: str) -> str:
    """The number cleaner."""
    text = f"trim(translate({expr}, ',$', ''), {BLANKS})"
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN try_cast({text} AS double) END"


def label(expr: str) -> str:
    """The outcome reader for the values the books contain."""
    return f"CASE WHEN lower(trim({expr}, {BLANKS})) = 'yes' THEN 1 ELSE 0 END"
