"""Disclosure tables derived from the star-schema tables.

The texts below are plain SQL that Spark and other engines read alike; only
their table names are bound.  ``row_id`` is unique (the whole row of lineitem
is), so it breaks ties wherever order matters, without a global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = """
SELECT cast(l_orderkey AS varchar(20)) || '-' || cast(l_linenumber AS varchar(20)) || '-' || cast(l_partkey AS varchar(20)) || '-' || cast(l_suppkey AS varchar(20))
         || '-' || cast(cast(round(l_quantity) AS bigint) AS varchar(20)) || '-' || cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar(20))
         || '-' || cast(cast(round(l_discount * 100) AS bigint) AS varchar(20)) || '-' || cast(cast(round(l_tax * 100) AS bigint) AS varchar(20)) AS row_id,
       l_suppkey AS lsp_id, s_name AS lsp_name,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 3 THEN '' ELSE 'Lender ' || l_returnflag || l_linestatus END AS lender,
       CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN ' ' ELSE ' P' || cast(l_partkey % 50 AS varchar(20)) END AS portfolio,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS amount,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_shipdate END AS scrape_timestamp,
       CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN o_orderdate ELSE l_shipdate - INTERVAL 1 MONTH END AS as_on_timestamp,
       CASE l_orderkey % 40 WHEN 0 THEN 'Error' WHEN 1 THEN 'Missing' WHEN 2 THEN 'NoData' WHEN 3 THEN 'Stale' WHEN 4 THEN 'Partial' WHEN 5 THEN 'unknown' WHEN 6 THEN NULL ELSE ' Completed ' END AS complete,
       'https://' || lower(replace(s_name, '#', '-')) || '.example.com/dlg' AS dlg_url
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

MASTER = """
SELECT s_suppkey AS id, s_name AS name, n_name || '-' || cast(s_suppkey AS varchar(20)) AS brand_name,
       CASE s_suppkey % 9 WHEN 0 THEN 'Bank' WHEN 1 THEN 'NBFC' WHEN 2 THEN 'NBFC-AA' WHEN 3 THEN 'NBFC-FinTech' WHEN 4 THEN 'Lending Tech With In-house NBFC'
            WHEN 5 THEN 'Lending Tech Without In-house NBFC' WHEN 6 THEN 'Marketplace' WHEN 7 THEN 'Multiproduct' ELSE 'Other' END AS lsp_type,
       'https://' || lower(replace(s_name, '#', '-')) || '.example.com/' AS home_url, s_acctbal > 0 AS active,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://' || lower(replace(s_name, '#', '-')) || '.example.com/dlg' END AS dlg_url,
       CASE s_suppkey % 7 WHEN 0 THEN 'plain_text' WHEN 1 THEN 'ocr_simple' WHEN 2 THEN 'pdf_table' WHEN 3 THEN 'html_table' WHEN 4 THEN 'playwright' WHEN 5 THEN NULL ELSE 'auto' END AS parse_hint,
       CASE WHEN s_suppkey % 4 = 0 THEN 'playwright' WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'auto' END AS fetch_hint
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

AUDIT = """
SELECT event_id AS id, CASE WHEN user_id % 20 = 0 THEN NULL ELSE user_id % 20 END AS lsp_id,
       CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS auto_manual, cast(user_id AS varchar(20)) AS user_id,
       event_type AS action_taken, ts AS log_timestamp, CASE WHEN event_id % 10 = 0 THEN 'not json' ELSE props END AS payload
FROM {events}
"""

USERS = """
SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) AS username, c_mktsegment AS role, c_name AS firstname,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'L' || cast(c_nationkey AS varchar(20)) END AS lastname, c_acctbal > 0 AS active
FROM {customer}
"""

PROXIES = {"raw": RAW, "master": MASTER, "audit": AUDIT, "users": USERS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


class Tables:
    """The tables of a folder and the disclosure tables over them, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROXIES:
            text = PROXIES[name]
            used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
            return self.spark.sql(text.replace("varchar(20)", "string"), **used)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_tables(sql: str) -> str:
    """``sql`` after the common table expressions that it names."""
    ctes = []
    for name, text in PROXIES.items():
        if f"dlg_{name}" in sql:
            for t in TABLES:
                text = text.replace("{" + t + "}", t)
            ctes.append(f"dlg_{name} AS ({text.strip()})")
    body = sql.strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
