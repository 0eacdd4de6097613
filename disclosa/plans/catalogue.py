"""Queries over the disclosure tables, each with its SQL where SQL has it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from disclosa.functions import amounts, dates, status, text
from disclosa.operators import filters, joins, links, mutations, normalise, sequences, summary, windows
from disclosa.plans.proxies import Tables, with_tables
from disclosa.shared import SHUFFLES_GO, configured, deleted, fresh_dir, stored
from disclosa.sources import fetch, lines, tables
from disclosa.streaming import summary as streaming

QUERIES, SQL = {}, {}
#: The order of raw rows: newest pages last, ties by the unique row_id.
ORDER = ["scrape_timestamp", "row_id"]
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(name, sql=None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return build

    return add


def stamp(c):
    return F.date_format(c, STAMP)


def money(c):
    return F.round(c, 2)


# ---------------------------------------------------------------- summaries

FILLED = """
windowed AS (
  SELECT *, extract(year FROM scrape_timestamp - INTERVAL 1 MONTH) AS wy, extract(month FROM scrape_timestamp - INTERVAL 1 MONTH) AS wm
  FROM dlg_raw WHERE scrape_timestamp IS NOT NULL
), filled AS (
  SELECT *, last_value(nullif(trim(lender), '') IGNORE NULLS) OVER (PARTITION BY lsp_id, wy, wm ORDER BY scrape_timestamp, row_id ROWS UNBOUNDED PRECEDING) AS lf,
         CASE trim(complete) WHEN 'Completed' THEN 1 WHEN 'Partial' THEN 2 WHEN 'Stale' THEN 3 WHEN 'NoData' THEN 4 WHEN 'Missing' THEN 5 WHEN 'Error' THEN 6 END AS sev
  FROM windowed
), grouped AS (
  SELECT lsp_id, wy, wm, max(lsp_name) AS name, max(dlg_url) AS dlg_url,
         count(DISTINCT nullif(lower(trim(lender)), '')) AS total_lenders,
         count(DISTINCT CASE WHEN trim(portfolio) <> '' THEN coalesce(lower(trim(lf)), '') || '|' || trim(portfolio) END) AS pairs,
         count(DISTINCT lower(trim(lf))) AS lenders,
         coalesce(sum(amount), 0.0) AS total_amount, max(as_on_timestamp) AS as_on, max(sev) AS sev, max(scrape_timestamp) AS last_crawl
  FROM filled GROUP BY lsp_id, wy, wm
), dlg_summary AS (
  SELECT lsp_id, name, total_lenders, CASE WHEN pairs > 0 THEN pairs ELSE lenders END AS total_portfolios, total_amount, dlg_url,
         extract(year FROM as_on) AS as_on_year, extract(month FROM as_on) AS as_on_month, wy AS scrape_year, wm AS scrape_month,
         CASE WHEN coalesce(sev, 5) <= 3 AND (as_on IS NULL OR extract(year FROM as_on) <> wy OR extract(month FROM as_on) <> wm) THEN 'Stale'
              WHEN sev = 1 THEN 'Completed' WHEN sev = 2 THEN 'Partial' WHEN sev = 3 THEN 'Stale' WHEN sev = 4 THEN 'NoData' WHEN sev = 6 THEN 'Error' ELSE 'Missing' END AS status,
         last_crawl AS last_crawl_date
  FROM grouped
)
"""


def monthly(t):
    return summary.monthly_summary(t.raw, ORDER)


@query("a1_monthly_summary", f"WITH {FILLED} SELECT lsp_id, scrape_year, scrape_month, name, total_lenders, total_portfolios, round(total_amount, 2) AS total_amount, dlg_url, as_on_year, as_on_month, status, strftime(last_crawl_date, '%Y-%m-%d %H:%M:%S') AS last_crawl_date FROM dlg_summary")
def a1(t):
    return monthly(t).withColumns({"total_amount": money("total_amount"), "last_crawl_date": stamp("last_crawl_date")})


def raw_streams(t, name, again=False):
    """The raw rows as they arrive: a stream of a folder after each of four parts in the
    order of time has been added to it, by as many tasks as it has; with ``again`` each part
    comes a second time, as a copy of its files.  Whoever asks for the next stream has run
    the one before to its end, so that what it read is deleted."""
    at = fresh_dir(t.spark, name)
    month = F.coalesce(F.date_format("scrape_timestamp", "yyyy-MM"), F.lit("0000"))

    def arrives(rows, part):
        with configured(t.spark, SHUFFLES_GO):
            rows.write.option("compression", "zstd").parquet(f"{at}/{part}")

    def stream():
        return t.spark.readStream.schema(t.raw.schema).parquet(f"{at}/*")

    last = None
    for lo, hi in (("0000", "1996"), ("1996", "1997-06"), ("1997-06", "1999"), ("1999", "9999")):
        if last:
            deleted(t.spark, f"{at}/{last}")
        arrives(t.raw.where((month >= lo) & (month < hi)), lo)
        yield stream()
        last = lo
        if again:
            arrives(t.spark.read.schema(t.raw.schema).parquet(f"{at}/{lo}"), f"{lo}-again")
            deleted(t.spark, f"{at}/{lo}")
            yield stream()
            last = f"{lo}-again"


@query("a1_stream", f"WITH {FILLED} SELECT lsp_id, scrape_year, scrape_month, name, total_lenders, total_portfolios, round(total_amount, 2) AS total_amount, dlg_url, as_on_year, as_on_month, status, strftime(last_crawl_date, '%Y-%m-%d %H:%M:%S') AS last_crawl_date FROM dlg_summary")
def a1_stream(t):
    """The monthly summary by keyed state; the stream is run to its end after each arrival,
    then once more."""
    at = fresh_dir(t.spark, "a1-stream")
    for raw in raw_streams(t, "a1-raw"):
        streaming.summarise_stream(raw, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    streaming.summarise_stream(raw, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return streaming.summary_of(t.spark, f"{at}/out").withColumns({"total_amount": money("total_amount"), "last_crawl_date": stamp("last_crawl_date")})


@query("u1_stream_repeats", "SELECT lsp_id, count(*) AS n, count(DISTINCT row_id) AS ids, round(sum(amount), 2) AS total_amount FROM dlg_raw WHERE scrape_timestamp IS NOT NULL GROUP BY lsp_id")
def u1_stream(t):
    """Raw rows that come twice, appended once."""
    at = fresh_dir(t.spark, "u1-stream")
    for raw in raw_streams(t, "u1-raw", again=True):
        streaming.append_stream(raw, f"{at}/out", f"{at}/checkpoint", ["row_id"]).awaitTermination()
    rows = t.spark.read.schema(t.raw.schema).parquet(f"{at}/out")
    return rows.groupBy("lsp_id").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.round(F.sum("amount"), 2).alias("total_amount"))


@query("a2_sum_null_zero", "SELECT lsp_id, complete, round(coalesce(sum(amount), 0.0), 2) AS total_amount FROM dlg_raw GROUP BY lsp_id, complete")
def a2(t):
    return summary.amounts_of(t.raw, ["lsp_id", "complete"]).withColumn("total_amount", money("total_amount"))


@query("a4_distinct_lenders", "SELECT lsp_id, count(DISTINCT nullif(lower(trim(lender)), '')) AS lenders FROM dlg_raw GROUP BY lsp_id")
def a4(t):
    return summary.lender_counts(t.raw, ["lsp_id"])


@query("a6_worst_status", """
SELECT lsp_id, coalesce(CASE max(CASE trim(complete) WHEN 'Completed' THEN 1 WHEN 'Partial' THEN 2 WHEN 'Stale' THEN 3 WHEN 'NoData' THEN 4 WHEN 'Missing' THEN 5 WHEN 'Error' THEN 6 END)
  WHEN 1 THEN 'Completed' WHEN 2 THEN 'Partial' WHEN 3 THEN 'Stale' WHEN 4 THEN 'NoData' WHEN 5 THEN 'Missing' WHEN 6 THEN 'Error' END, 'Missing') AS status,
  strftime(max(scrape_timestamp), '%Y-%m-%d %H:%M:%S') AS last_scrape
FROM dlg_raw GROUP BY lsp_id""")
def a6(t):
    worst = status.of_severity(F.max(status.severity(text.status_of(F.col("complete"), status.STATUSES))))
    return t.raw.groupBy("lsp_id").agg(F.coalesce(worst, F.lit("Missing")).alias("status"), stamp(F.max("scrape_timestamp")).alias("last_scrape"))


@query("a8_graph_rollup", f"WITH {FILLED} SELECT cast(scrape_year AS varchar) || '-' || lpad(cast(scrape_month AS varchar), 2, '0') AS month_year, cast(sum(total_lenders) AS bigint) AS total_lenders, cast(sum(total_portfolios) AS bigint) AS total_portfolios, round(sum(total_amount), 2) AS total_amount FROM dlg_summary WHERE lsp_id >= 3 GROUP BY 1")
def a8(t):
    return summary.graph_rollup(monthly(t).where("lsp_id >= 3")).withColumn("total_amount", money("total_amount"))


LATEST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY lsp_id ORDER BY last_crawl_date DESC NULLS FIRST, scrape_year DESC NULLS FIRST, scrape_month DESC NULLS FIRST) AS rn FROM dlg_summary)"


@query("a9_running_totals", f"WITH {FILLED}, {LATEST} SELECT cast(sum(total_portfolios) AS bigint) AS total_portfolios, round(sum(total_amount), 2) AS total_amount, cast(sum(total_lenders) AS bigint) AS total_lenders FROM ranked WHERE rn = 1")
def a9(t):
    return summary.running_totals(windows.latest(monthly(t), ["lsp_id"], ["last_crawl_date", "scrape_year", "scrape_month"])).withColumn("total_amount", money("total_amount"))


@query("a10_raw_totals", """
WITH month AS (
  SELECT *, last_value(CASE WHEN trim(lender) <> '' THEN lender END IGNORE NULLS) OVER (PARTITION BY lsp_id ORDER BY scrape_timestamp DESC, row_id ROWS UNBOUNDED PRECEDING) AS lf
  FROM dlg_raw WHERE scrape_timestamp >= TIMESTAMP '1997-03-01' AND scrape_timestamp < TIMESTAMP '1997-04-01'
)
SELECT count(DISTINCT CASE WHEN trim(portfolio) <> '' THEN coalesce(lf, '?') || '|' || portfolio END) AS total_portfolios, round(sum(amount), 2) AS total_amount, count(DISTINCT lf) AS total_lenders FROM month""")
def a10(t):
    rows = filters.in_month(t.raw, 1997, 3)
    day = F.col("scrape_timestamp").cast("date")
    return summary.raw_totals(rows, ["lsp_id"], [F.desc("scrape_timestamp"), F.col("row_id")], day, F.desc("part__of")).withColumn("total_amount", money("total_amount"))


@query("a11_count_filtered", "SELECT count(*) AS total_count FROM dlg_audit WHERE action_taken = 'click' AND lsp_id = 7")
def a11(t):
    return filters.equal_where_given(t.audit, action_taken="click", lsp_id=7, user_id=None).agg(F.count("*").alias("total_count"))


@query("a13_null_scrapes", "SELECT cast(count(*) AS bigint) AS n_null FROM dlg_raw WHERE scrape_timestamp IS NULL")
def a13(t):
    return summary.null_count(t.raw, "scrape_timestamp")


WORDS = """
words AS (
  SELECT cast(l_partkey % 5 AS int) AS page, cast(l_suppkey % 7 AS int) AS block_num, cast(l_linenumber AS int) AS par_num, cast(l_orderkey % 3 AS int) AS line_num,
         l_orderkey * 10 + l_linenumber AS word_no, l_returnflag || cast(l_partkey AS varchar) AS text, cast(l_quantity * 2 AS double) AS conf, cast(l_partkey % 100 AS int) AS x, cast(l_suppkey % 100 AS int) AS y
  FROM lineitem
)"""


@query("a7_ocr_lines", f"WITH {WORDS} SELECT page, block_num, par_num, line_num, count(*) AS n, md5(string_agg(text, ' ' ORDER BY word_no, text)) AS line, round(avg(conf), 6) AS confidence, min(x) AS \"left\", min(y) AS top, max(x + 5) AS \"right\", max(y + 6) AS bottom FROM words WHERE conf >= 60 GROUP BY ALL")
def a7(t):
    w = t.lineitem.select(
        (F.col("l_partkey") % 5).cast("int").alias("page"), (F.col("l_suppkey") % 7).cast("int").alias("block_num"), F.col("l_linenumber").alias("par_num"), (F.col("l_orderkey") % 3).cast("int").alias("line_num"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("word_no"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") * 2).alias("conf"),
        (F.col("l_partkey") % 100).cast("int").alias("left"), (F.col("l_suppkey") % 100).cast("int").alias("top"), F.lit(5).alias("width"), F.lit(6).alias("height"),
    )
    out = summary.ocr_lines(w, 60)
    return out.withColumns({"n": F.size(F.split("line", " ")).cast("long"), "line": F.md5("line"), "confidence": F.round("confidence", 6)})


@query("a14_best_candidate", """
WITH l AS (SELECT s_suppkey % 7 AS id, 'https://x.example/' || cast(s_suppkey % 50 AS varchar) AS url, s_suppkey % 11 AS score, s_suppkey AS pos FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rn FROM l)
SELECT id, url, score FROM r WHERE rn = 1""")
def a14(t):
    s = F.col("s_suppkey")
    rows = t.supplier.select((s % 7).alias("id"), F.concat(F.lit("https://x.example/"), (s % 50).cast("string")).alias("url"), (s % 11).alias("score"), s.alias("pos"))
    return summary.best_candidate(rows, ["id"])


# ---------------------------------------------------------------- windows


@query("w1_latest_per_lsp", f"WITH {FILLED}, {LATEST} SELECT r.lsp_id, m.name AS master_name, status, scrape_year, scrape_month, total_portfolios FROM ranked r JOIN dlg_master m ON m.id = r.lsp_id WHERE rn = 1 AND m.name ILIKE '%0%' ")
def w1(t):
    top = windows.latest(monthly(t), ["lsp_id"], ["last_crawl_date", "scrape_year", "scrape_month"])
    return filters.containing(joins.with_master(top, t.master), "0", "master_name").select("lsp_id", "master_name", "status", "scrape_year", "scrape_month", "total_portfolios")


@query("w2_ffill_lender", "SELECT row_id, last_value(CASE WHEN trim(lender) <> '' THEN lender END IGNORE NULLS) OVER (PARTITION BY lsp_id ORDER BY scrape_timestamp NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING) AS lender_filled FROM dlg_raw")
def w2(t):
    order = [F.asc_nulls_first("scrape_timestamp"), F.col("row_id")]
    month = F.trunc(F.col("scrape_timestamp").cast("date"), "month")
    return windows.forward_fill_parts(t.raw, ["lender"], ["lsp_id"], month, order, F.asc_nulls_first("part__of"), "_filled").select("row_id", "lender_filled")


@query("w3_latest_filled", """
WITH r AS (SELECT lsp_id, portfolio, row_number() OVER (PARTITION BY lsp_id ORDER BY scrape_timestamp DESC NULLS LAST, row_id DESC) AS rn FROM dlg_raw WHERE trim(portfolio) <> '')
SELECT lsp_id, portfolio FROM r WHERE rn = 1""")
def w3(t):
    return t.raw.groupBy("lsp_id").agg(windows.latest_filled(F.col("portfolio"), F.col("scrape_timestamp"), F.col("row_id")).alias("portfolio"))


@query("w4_sum_total_rows", """
WITH g AS (SELECT row_id, amount, sum(amount) OVER (PARTITION BY lsp_id, complete, lender) AS s, count(amount) OVER (PARTITION BY lsp_id, complete, lender) AS n FROM dlg_raw)
SELECT row_id, coalesce(abs(2 * amount - s) <= 20000 AND n > 2, false) AS is_sum FROM g""")
def w4(t):
    return windows.sum_rows(t.raw, ["lsp_id", "complete", "lender"], within=20000).select("row_id", "is_sum")


@query("w6_page_ffill", "SELECT row_id, last_value(CASE WHEN trim(lender) <> '' THEN lender END IGNORE NULLS) OVER (PARTITION BY lsp_id ORDER BY scrape_timestamp DESC NULLS LAST, row_id ROWS UNBOUNDED PRECEDING) AS lender_filled FROM dlg_raw WHERE scrape_timestamp >= TIMESTAMP '1997-01-01' AND scrape_timestamp < TIMESTAMP '1997-02-01'")
def w6(t):
    rows, day = filters.in_month(t.raw, 1997, 1), F.col("scrape_timestamp").cast("date")
    return windows.forward_fill_parts(rows, ["lender"], ["lsp_id"], day, [F.desc_nulls_last("scrape_timestamp"), F.col("row_id")], F.desc_nulls_last("part__of"), "_filled").select("row_id", "lender_filled")


@query("w7_segment_carry", """
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
SELECT event_id, cast(segment AS bigint) AS segment, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM s""")
def w7(t):
    e = t.events.withColumn("carried", F.when(F.col("event_type") == "click", F.col("event_id")))
    return windows.segment_carry(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", ["carried"]).select("event_id", "segment", "carried")


@query("w8_pending_amount", """
WITH k AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN 'amount' WHEN event_type = 'purchase' THEN 'portfolio' ELSE 'other' END AS kind, CASE WHEN event_type <> 'purchase' OR event_id % 3 = 0 THEN value END AS amount FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN kind = 'portfolio' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM k),
f AS (SELECT *, coalesce(CASE WHEN kind = 'portfolio' THEN amount END, last_value(CASE WHEN kind = 'amount' THEN amount END IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS taken FROM s)
SELECT event_id, taken AS amount FROM f WHERE kind = 'portfolio'""")
def w8(t):
    kind = F.when(F.col("event_type") == "click", "amount").when(F.col("event_type") == "purchase", "portfolio").otherwise("other")
    own = F.when((F.col("event_type") != "purchase") | (F.col("event_id") % 3 == 0), F.col("value"))
    rows = t.events.select("event_id", "user_id", "ts", kind.alias("kind"), own.alias("amount"))
    return normalise.carried_amounts(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "amount")


@query("w10_context", """
SELECT event_id, nullif(concat_ws(' | ', lag(event_type, 2) OVER w, lag(event_type, 1) OVER w), '') AS context_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w10(t):
    return windows.context_before(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "context_before")


# ---------------------------------------------------------------- joins


@query("j1_summary_master", f"WITH {FILLED} SELECT lsp_id, scrape_year, scrape_month, m.brand_name, m.lsp_type, m.active FROM dlg_summary s JOIN dlg_master m ON m.id = s.lsp_id")
def j1(t):
    return joins.with_master(monthly(t), t.master).select("lsp_id", "scrape_year", "scrape_month", "brand_name", "lsp_type", "active")


@query("j2_minute_audit_join", """
WITH s AS (SELECT lsp_id, max(log_timestamp) AS last_crawl_date FROM dlg_audit WHERE lsp_id IS NOT NULL GROUP BY lsp_id)
SELECT s.lsp_id, strftime(last_crawl_date, '%Y-%m-%d %H:%M:%S') AS last_crawl_date, a.id AS audit_id, a.action_taken
FROM s LEFT JOIN dlg_audit a ON a.lsp_id = s.lsp_id AND date_trunc('minute', a.log_timestamp) = date_trunc('minute', s.last_crawl_date)""")
def j2(t):
    s = t.audit.where("lsp_id is not null").groupBy("lsp_id").agg(F.max("log_timestamp").alias("last_crawl_date"))
    return joins.with_minute_audit(s, t.audit).select("lsp_id", stamp("last_crawl_date").alias("last_crawl_date"), "audit_id", "action_taken")


@query("j3_audit_left", "SELECT a.id, a.action_taken, m.name AS lsp_name FROM dlg_audit a LEFT JOIN dlg_master m ON a.lsp_id IS NOT NULL AND a.lsp_id = m.id")
def j3(t):
    return joins.audit_with_source(t.audit, t.master).select("id", "action_taken", "lsp_name")


def kept(t, *cols):
    """These columns of the raw rows, made once by their joins, for queries that read them
    several times."""
    return stored(t.raw.select(*cols), "raw")


KEYS7 = ["lsp_id", "lender", "portfolio", "amount", "as_on_timestamp", "y", "m"]


@query("j5_null_safe_anti", """
WITH a AS (SELECT *, extract(year FROM scrape_timestamp) AS y, extract(month FROM scrape_timestamp) AS m FROM dlg_raw),
b AS (SELECT lsp_id, CASE WHEN lsp_id % 4 = 0 THEN lender ELSE lender || ' x' END AS lender, portfolio, amount, as_on_timestamp, y, CASE WHEN row_id > '3' THEN m ELSE m % 12 + 1 END AS m FROM a)
SELECT a.row_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lsp_id IS NOT DISTINCT FROM a.lsp_id AND b.lender IS NOT DISTINCT FROM a.lender
  AND b.portfolio IS NOT DISTINCT FROM a.portfolio AND b.amount IS NOT DISTINCT FROM a.amount AND b.as_on_timestamp IS NOT DISTINCT FROM a.as_on_timestamp AND b.y IS NOT DISTINCT FROM a.y AND b.m IS NOT DISTINCT FROM a.m)""")
def j5(t):
    raw = kept(t, "row_id", "lsp_id", "lender", "portfolio", "amount", "as_on_timestamp", "scrape_timestamp")
    a = raw.withColumns({"y": F.year("scrape_timestamp"), "m": F.month("scrape_timestamp")})
    b = a.withColumns({"lender": F.when(F.expr("lsp_id % 4 = 0"), F.col("lender")).otherwise(F.concat("lender", F.lit(" x"))), "m": F.when(F.col("row_id") > "3", F.col("m")).otherwise(F.col("m") % 12 + 1)})
    return joins.null_safe_anti(a, b, KEYS7).select("row_id")


@query("j6_scraped_semi", "SELECT id, name FROM dlg_master m WHERE EXISTS (SELECT 1 FROM dlg_raw r WHERE r.lsp_id = m.id)")
def j6(t):
    return joins.scraped_sources(t.master, t.raw).select("id", "name")


@query("j7_or_semi", """
WITH n AS (SELECT c_custkey AS id, 'Supplier#' || lpad(cast(c_custkey % 300 AS varchar), 9, '0') AS name, 'B' || cast(c_custkey AS varchar) AS brand_name, CASE WHEN c_custkey % 2 = 0 THEN 'Bank' ELSE 'NBFC' END AS lsp_type, 'https://none/' || cast(c_custkey AS varchar) AS home_url FROM customer)
SELECT n.id FROM n WHERE EXISTS (SELECT 1 FROM dlg_master m WHERE m.lsp_type = n.lsp_type AND (m.name = n.name OR m.brand_name = n.name OR m.name = n.brand_name OR m.brand_name = n.brand_name OR m.home_url = n.home_url))""")
def j7(t):
    c = F.col("c_custkey")
    new = t.customer.select(c.alias("id"), F.concat(F.lit("Supplier#"), F.lpad((c % 300).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("B"), c.cast("string")).alias("brand_name"), F.when(c % 2 == 0, "Bank").otherwise("NBFC").alias("lsp_type"), F.concat(F.lit("https://none/"), c.cast("string")).alias("home_url"))
    return joins.duplicate_sources(new, t.master).select("id")


@query("j8_null_safe_semi", """
WITH b AS (SELECT lsp_id, CASE WHEN complete = ' Completed ' THEN lender ELSE lender || ' x' END AS lender, portfolio, amount FROM dlg_raw)
SELECT a.row_id FROM dlg_raw a WHERE EXISTS (SELECT 1 FROM b WHERE b.lsp_id IS NOT DISTINCT FROM a.lsp_id AND b.lender IS NOT DISTINCT FROM a.lender AND b.portfolio IS NOT DISTINCT FROM a.portfolio AND b.amount IS NOT DISTINCT FROM a.amount)""")
def j8(t):
    raw = kept(t, "row_id", "lsp_id", "lender", "portfolio", "amount", "complete")
    b = raw.withColumn("lender", F.when(F.col("complete") == " Completed ", F.col("lender")).otherwise(F.concat("lender", F.lit(" x"))))
    return joins.null_safe_semi(raw, b, ["lsp_id", "lender", "portfolio", "amount"]).select("row_id")


@query("j9_lookup", "SELECT id, username, role FROM dlg_users WHERE username = 'customer.000000077' AND role = (SELECT c_mktsegment FROM customer WHERE c_custkey = 77)")
def j9(t):
    role = t.customer.where("c_custkey = 77").select(F.col("c_mktsegment").alias("role"))
    return joins.lookup(t.users, "customer.000000077", role).select("id", "username", "role")


@query("j10_zip", """
WITH a AS (SELECT l_orderkey AS id, l_returnflag AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
b AS (SELECT o_custkey AS id, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.id, x AS portfolio, y AS amount FROM a JOIN b ON a.id = b.id AND a.rn = b.rn""")
def j10(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("xs"))
    b = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ys"))
    return joins.zip_lists(a.join(b, "id"), "xs", "ys", ("portfolio", "amount"))


# ---------------------------------------------------------------- filters


@query("f1_range", "SELECT row_id FROM dlg_raw WHERE scrape_timestamp BETWEEN TIMESTAMP '1998-01-15' AND TIMESTAMP '1998-02-15'")
def f1(t):
    return filters.scraped_between(t.raw, dt.datetime(1998, 1, 15), dt.datetime(1998, 2, 15)).select("row_id")


@query("f2_optional_equals", "SELECT id FROM dlg_master WHERE lsp_type = 'NBFC'")
def f2(t):
    return filters.equal_where_given(t.master, lsp_type="NBFC", id=0, fetch_hint="").select("id")


@query("f3_inactive", "SELECT id FROM dlg_master WHERE active = false")
def f3(t):
    return filters.active_rows(t.master, False).select("id")


@query("f4_ilike", "SELECT id FROM dlg_master WHERE name ILIKE '%er#0000000_1%' OR brand_name ILIKE '%er#0000000_1%'")
def f4(t):
    return filters.containing(t.master, "er#0000000_1", "name", "brand_name").select("id")


@query("f5_date_bounds", "SELECT id FROM dlg_audit WHERE log_timestamp >= TIMESTAMP '2024-01-05' AND log_timestamp <= TIMESTAMP '2024-01-12'")
def f5(t):
    return filters.logged_between(t.audit, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12)).select("id")


@query("f6_year_month", "SELECT row_id FROM dlg_raw WHERE extract(year FROM scrape_timestamp) = 1996 AND extract(month FROM scrape_timestamp) = 12")
def f6(t):
    return filters.in_month(t.raw, 1996, 12).select("row_id")


@query("f7_relabel", "SELECT id AS lsp_id, name AS lsp, brand_name AS brand, coalesce(dlg_url, 'NA') AS url FROM dlg_master")
def f7(t):
    return filters.shown_names(t.master)


@query("f8_null_defaults", "SELECT row_id, coalesce(amount, 0.0) AS amount, coalesce(extract(year FROM as_on_timestamp), 0) AS as_on_year FROM dlg_raw")
def f8(t):
    return filters.with_defaults(t.raw).select("row_id", "amount", "as_on_year")


@query("f9_scraped", "SELECT lsp_id, count(*) AS n FROM dlg_raw WHERE scrape_timestamp IS NOT NULL GROUP BY lsp_id")
def f9(t):
    return filters.scraped_rows(t.raw)[0].groupBy("lsp_id").agg(F.count("*").alias("n"))


@query("f10_rule_filter", "SELECT row_id, lower(trim(coalesce(lender, ''))) = 'lender ro' AS kept, NOT regexp_matches(trim(coalesce(portfolio, '')), '(?i)^p1') AS stays FROM dlg_raw")
def f10(t):
    cells = F.create_map(F.lit("Lender"), F.col("lender"), F.lit("Portfolio"), F.col("portfolio"))
    return t.raw.select("row_id", filters.keep_by_rule(cells, "Lender", " Lender RO ", True).alias("kept"), filters.drop_by_rule(cells, "Portfolio", regex="^p1", ignore_case=True).alias("stays"))


LABELS = "labels AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Total' WHEN 1 THEN ' Portfolio ' WHEN 2 THEN 'Summary ' || p_brand WHEN 3 THEN NULL WHEN 4 THEN 'Sub total' WHEN 5 THEN '' ELSE p_name END AS portfolio, CASE p_partkey % 5 WHEN 0 THEN 'Lender' WHEN 1 THEN 'Overall' WHEN 2 THEN NULL ELSE p_brand END AS lender, CASE WHEN p_partkey % 6 = 0 THEN 'Sumo' ELSE 'Acme' END AS lsp, p_retailprice AS amount FROM part)"
HEADS = ", ".join(f"'{x}'" for x in filters.HEADER_WORDS)
TOTALS = "(total|grand total|sum|aggregate|overall|combined|consolidated)"


def labels(t):
    k = F.col("p_partkey")
    portfolio = F.when(k % 8 == 0, "Total").when(k % 8 == 1, " Portfolio ").when(k % 8 == 2, F.concat(F.lit("Summary "), "p_brand")).when(k % 8 == 3, None).when(k % 8 == 4, "Sub total").when(k % 8 == 5, "").otherwise(F.col("p_name"))
    lender = F.when(k % 5 == 0, "Lender").when(k % 5 == 1, "Overall").when(k % 5 == 2, None).otherwise(F.col("p_brand"))
    return t.part.select(k.alias("id"), portfolio.alias("portfolio"), lender.alias("lender"), F.when(k % 6 == 0, "Sumo").otherwise("Acme").alias("lsp"), F.col("p_retailprice").alias("amount"))


@query("f11_raw_total", f"WITH {LABELS} SELECT id, coalesce(regexp_matches(portfolio, '(?i)\\btotal\\b'), false) OR coalesce(regexp_matches(lender, '(?i)\\btotal\\b'), false) AS is_total FROM labels")
def f11(t):
    cells = F.create_map(F.lit("a"), F.col("portfolio"), F.lit("b"), F.col("lender"))
    return labels(t).select("id", filters.raw_total(cells, F.lit(False)).alias("is_total"))


@query("f12_header_row", f"WITH {LABELS} SELECT id, coalesce(lower(trim(portfolio)) IN ({HEADS}), false) OR coalesce(lower(trim(lender)) IN ({HEADS}), false) AS is_header FROM labels")
def f12(t):
    return labels(t).select("id", filters.header_row(F.col("portfolio"), F.col("lender")).alias("is_header"))


@query("f13_total_row", f"WITH {LABELS} SELECT id, coalesce(portfolio, '') <> '' AND regexp_matches(lower(concat_ws('|', lsp, coalesce(lender, ''), coalesce(portfolio, ''))), '{TOTALS}') AS is_total FROM labels")
def f13(t):
    return labels(t).select("id", filters.total_row(F.col("lsp"), F.col("lender"), F.col("portfolio")).alias("is_total"))


@query("f14_empty_row", f"WITH {LABELS} SELECT id, lender IS NULL AND portfolio IS NULL AS is_empty FROM labels")
def f14(t):
    return labels(t).select("id", filters.empty_row(F.col("lender"), F.col("portfolio"), F.col("amount")).alias("is_empty"))


@query("f15_missing_fields", f"WITH {LABELS} SELECT id, concat_ws(',', CASE WHEN coalesce(portfolio, '') = '' THEN 'portfolio' END, CASE WHEN coalesce(lender, '') = '' THEN 'lender' END, CASE WHEN coalesce(amount, 0) = 0 THEN 'amount' END) AS missing FROM labels")
def f15(t):
    return labels(t).select("id", F.array_join(filters.missing_fields(portfolio=F.col("portfolio"), lender=F.col("lender"), amount=F.col("amount")), ",").alias("missing"))


@query("f16_status_parse", "SELECT row_id, CASE WHEN trim(complete) IN ('Completed', 'Partial', 'Stale', 'NoData', 'Missing', 'Error') THEN trim(complete) END AS status FROM dlg_raw")
def f16(t):
    return t.raw.select("row_id", text.status_of(F.col("complete"), status.STATUSES).alias("status"))


@query("f17_url_predicates", """
SELECT page_id, regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|svg|webp|css|js|ico|zip|mp4)(\\?|#|$)') AS is_asset, regexp_matches(lower(trim(url)), '^(mailto:|tel:|javascript:|whatsapp:|intent:)') OR trim(url) = '' AS is_bad,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) IN ('', 'tionsh.example.net') AS same FROM pages""")
def f17(t):
    u = F.col("url")
    return t.pages.select("page_id", filters.asset_url(u).alias("is_asset"), filters.bad_href(u).alias("is_bad"), filters.same_site(F.lit("https://tionsh.example.net/"), u).alias("same"))


# ---------------------------------------------------------------- order, limits, sets


@query("l1_sorted_sources", "SELECT name, row_number() OVER (ORDER BY name, id) AS pos FROM dlg_master ORDER BY name, id LIMIT 50")
def l1(t):
    from pyspark.sql import Window

    return joins.page(t.master, ["name", "id"], 1, 50).withColumn("pos", F.row_number().over(Window.orderBy("name", "id")).cast("long")).select("name", "pos")


@query("l2_recent_audit", "SELECT id FROM dlg_audit ORDER BY log_timestamp DESC, id LIMIT 100")
def l2(t):
    return joins.page(t.audit, [F.desc("log_timestamp"), F.col("id")], 1, 100).select("id")


@query("l3_page", "SELECT id, username FROM dlg_users WHERE active ORDER BY id LIMIT 25 OFFSET 50")
def l3(t):
    return joins.page(filters.active_rows(t.users), ["id"], 3, 25).select("id", "username")


@query("l3_deep_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 5 OFFSET 49995")
def l3_deep(t):
    """Page 10,000 of lineitem."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]
    return joins.page(t.lineitem, order, 10_000, 5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").alias("price"))


@query("l4_best", "SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def l4(t):
    return windows.first_of_all(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")), [F.desc("score"), F.col("id")])


@query("l5_top_per_group", "SELECT lsp_id, row_id FROM (SELECT lsp_id, row_id, row_number() OVER (PARTITION BY lsp_id ORDER BY amount DESC NULLS LAST, row_id) AS rn FROM dlg_raw) WHERE rn <= 12")
def l5(t):
    return windows.top_per_group(t.raw, ["lsp_id"], [F.desc_nulls_last("amount"), F.col("row_id")], 12).select("lsp_id", "row_id")


@query("u1_keep_first", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY lsp_id, lender, portfolio, complete ORDER BY row_id) AS rn FROM dlg_raw) WHERE rn = 1")
def u1(t):
    return windows.keep_first(t.raw, ["lsp_id", "lender", "portfolio", "complete"], [F.col("row_id")]).select("row_id")


@query("u3_ordered_union", """
WITH u AS (SELECT 0 AS kind, s_suppkey AS pos, 'x' || cast(s_suppkey % 40 AS varchar) AS link FROM supplier UNION ALL SELECT 1, s_suppkey, 'x' || cast(s_suppkey * 7 % 60 AS varchar) FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY kind, pos) AS rn FROM u)
SELECT kind, link FROM r WHERE rn = 1 AND link NOT IN (SELECT 'x' || cast(n_nationkey AS varchar) FROM nation)""")
def u3(t):
    s = F.col("s_suppkey")
    link = lambda n, kind: t.supplier.select(F.lit(kind).alias("kind"), s.alias("pos"), F.concat(F.lit("x"), n.cast("string")).alias("link"))
    both = windows.keep_first(link(s % 40, 0).unionByName(link(s * 7 % 60, 1)), ["link"], [F.col("kind"), F.col("pos")])
    visited = t.nation.select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("link"))
    return both.join(visited, "link", "left_anti").select("kind", "link")


# ---------------------------------------------------------------- mutations


@query("c1_insert_sources", """
WITH n AS (SELECT 100000 + c_custkey AS id, 'Supplier#' || lpad(cast(c_custkey % 300 AS varchar), 9, '0') AS name, 'B' || cast(c_custkey AS varchar) AS brand_name, 'Bank' AS lsp_type, 'https://none/' || cast(c_custkey AS varchar) AS home_url FROM customer)
SELECT id, name, parse_hint FROM dlg_master UNION ALL
SELECT id, name, 'auto' FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM n) n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM dlg_master m WHERE m.lsp_type = n.lsp_type AND (m.name = n.name OR m.brand_name = n.name OR m.name = n.brand_name OR m.brand_name = n.brand_name OR m.home_url = n.home_url))""")
def c1(t):
    c = F.col("c_custkey")
    null = F.lit(None).cast("string")
    new = t.customer.select((c + 100000).alias("id"), F.concat(F.lit("Supplier#"), F.lpad((c % 300).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("B"), c.cast("string")).alias("brand_name"), F.lit("Bank").alias("lsp_type"), F.concat(F.lit("https://none/"), c.cast("string")).alias("home_url"), F.lit(None).cast("boolean").alias("active"), null.alias("dlg_url"), null.alias("parse_hint"), null.alias("fetch_hint"))
    return mutations.insert_sources(t.master, new).select("id", "name", "parse_hint")


@query("c2_partial_update", """
WITH ch AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'New ' || s_name END AS name, 'https://moved/' || cast(s_suppkey AS varchar) AS home_url, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE true END AS active FROM supplier WHERE s_suppkey % 4 <> 1),
scraped AS (SELECT DISTINCT lsp_id FROM dlg_raw)
SELECT m.id, coalesce(ch.name, m.name) AS name, CASE WHEN m.id IN (SELECT lsp_id FROM scraped) THEN m.home_url ELSE coalesce(ch.home_url, m.home_url) END AS home_url, CASE WHEN ch.id IS NOT NULL THEN ch.active ELSE m.active END AS active
FROM dlg_master m LEFT JOIN ch ON ch.id = m.id""")
def c2(t):
    s = F.col("s_suppkey")
    ch = t.supplier.where(s % 4 != 1).select(s.alias("id"), F.when(s % 2 == 0, F.concat(F.lit("New "), "s_name")).alias("name"), F.concat(F.lit("https://moved/"), s.cast("string")).alias("home_url"), F.when(s % 3 != 0, F.lit(True)).alias("active"))
    return mutations.update_sources(t.master, ch, t.raw).select("id", "name", "home_url", "active")


@query("c3_deactivate", "SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE active END AS active FROM dlg_master")
def c3(t):
    return mutations.deactivate(t.master, t.master.where("id % 3 = 0").select("id")).select("id", "active")


@query("c4_raw_update_delete", "SELECT row_id, CASE WHEN lsp_id % 4 = 0 THEN 'fixed' ELSE lender END AS lender, CASE WHEN lsp_id % 4 = 0 AND amount IS NULL THEN NULL ELSE amount END AS amount FROM dlg_raw WHERE lsp_id % 7 <> 0")
def c4(t):
    ch = t.raw.where("lsp_id % 4 = 0").select("row_id", F.lit("fixed").alias("lender"), F.lit(None).cast("double").alias("amount"))
    out = mutations.partial_update(t.raw, ch, "row_id")
    return mutations.delete_rows(out, t.raw.where("lsp_id % 7 = 0"), "row_id").select("row_id", "lender", "amount")


STALE = "extract(year FROM scrape_timestamp) * 100 + extract(month FROM scrape_timestamp)"


@query("c4_insert_raw", """
WITH new AS (SELECT lsp_id, lsp_name, CASE WHEN lsp_id % 2 = 0 THEN lender || ' new' ELSE lender END AS lender, portfolio, amount, as_on_timestamp, scrape_timestamp FROM dlg_raw WHERE scrape_timestamp IS NOT NULL),
fresh AS (SELECT lsp_id, lender, portfolio, amount, as_on_timestamp, min(scrape_timestamp) AS scrape_timestamp FROM new n WHERE NOT EXISTS (SELECT 1 FROM dlg_raw r WHERE r.lsp_id = n.lsp_id AND r.lender IS NOT DISTINCT FROM n.lender AND r.portfolio IS NOT DISTINCT FROM n.portfolio AND r.amount IS NOT DISTINCT FROM n.amount AND r.as_on_timestamp IS NOT DISTINCT FROM n.as_on_timestamp) GROUP BY ALL),
every AS (SELECT lsp_id, lender FROM dlg_raw UNION ALL SELECT lsp_id, lender FROM fresh)
SELECT lsp_id, lender, count(*) AS n FROM every GROUP BY ALL""")
def c4_insert(t):
    """Every raw row entered by hand once more, every second source under other lenders."""
    raw = kept(t, "lsp_id", "lsp_name", "lender", "portfolio", "amount", "as_on_timestamp", "scrape_timestamp", "complete", "dlg_url")
    new = raw.where("scrape_timestamp is not null").drop("complete").withColumn("lender", F.when(F.col("lsp_id") % 2 == 0, F.concat("lender", F.lit(" new"))).otherwise(F.col("lender")))
    return mutations.insert_raw(raw, new).groupBy("lsp_id", "lender").agg(F.count("*").alias("n"))


@query("a3_months_from_days", """
SELECT lsp_id, strftime(scrape_timestamp, '%Y-%m') AS month, count(DISTINCT nullif(lower(trim(lender)), '')) AS lenders, count(DISTINCT nullif(trim(portfolio), '')) AS portfolios, round(coalesce(sum(amount), 0.0), 2) AS total_amount, cast(count(*) AS bigint) AS n_rows,
       count(DISTINCT CASE WHEN coalesce(trim(lender), '') <> '' OR coalesce(trim(portfolio), '') <> '' THEN coalesce(lower(trim(lender)), '') || '|' || coalesce(trim(portfolio), '') END) AS pairs
FROM dlg_raw WHERE scrape_timestamp IS NOT NULL GROUP BY ALL""")
def a3_days(t):
    """Months made from stored days alone."""
    days = stored(summary.day_parts(t.raw), "days")
    return summary.merged_days(days, [F.col("lsp_id"), F.date_format("day", "yyyy-MM")], ["lsp_id", "month"]).withColumn("total_amount", money("total_amount"))


@query("d1_two_tiers", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def d1_tiers(t):
    """Texts that the patterns know, that they miss, and blanks."""
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 4
    told = F.when(k == 0, f("dd.MM.yyyy")).when(k == 1, f("MMM/dd/yyyy")).when(k == 2, F.concat(F.lit("as on "), f("MMMM dd, yyyy"))).otherwise(F.lit("  "))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), told.alias("text"))
    return dates.with_dates(rows, "text", "day").select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("c5_append", f"""
WITH new AS (SELECT * REPLACE ('n' || row_id AS row_id, CASE WHEN lsp_id % 3 = 0 THEN lender || ' x' ELSE ' ' || lender || ' ' END AS lender) FROM dlg_raw),
cl AS (SELECT *, coalesce(trim(lender), '') AS cl, coalesce(trim(portfolio), '') AS cp, {STALE} AS ym FROM dlg_raw),
cn AS (SELECT *, coalesce(trim(lender), '') AS cl, coalesce(trim(portfolio), '') AS cp, {STALE} AS ym FROM new)
SELECT row_id, lender FROM dlg_raw UNION ALL SELECT row_id, cl FROM cn WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.lsp_id IS NOT DISTINCT FROM cn.lsp_id AND cl.cl = cn.cl AND cl.cp = cn.cp AND cl.amount IS NOT DISTINCT FROM cn.amount AND cl.as_on_timestamp IS NOT DISTINCT FROM cn.as_on_timestamp AND cl.ym IS NOT DISTINCT FROM cn.ym)""")
def c5(t):
    other = F.when(F.expr("lsp_id % 3 = 0"), F.concat("lender", F.lit(" x"))).otherwise(F.concat(F.lit(" "), "lender", F.lit(" ")))
    raw = kept(t, "row_id", "lsp_id", "lender", "portfolio", "amount", "as_on_timestamp", "scrape_timestamp")
    return mutations.append_raw(raw, raw.withColumns({"row_id": F.concat(F.lit("n"), F.col("row_id").cast("string")), "lender": other})).select("row_id", "lender")


@query("c6_stale_replace", f"""
WITH new AS (SELECT * FROM dlg_raw WHERE scrape_timestamp >= TIMESTAMP '1999-06-01' AND scrape_timestamp < TIMESTAMP '1999-07-01'),
touched AS (SELECT DISTINCT lsp_id, {STALE} AS ym FROM new),
first AS (SELECT lsp_id, as_on_timestamp, scrape_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY lsp_id ORDER BY row_id) AS rn FROM new) WHERE rn = 1),
none AS (SELECT lsp_id FROM first WHERE date_trunc('month', as_on_timestamp) = date_trunc('month', scrape_timestamp))
SELECT row_id, 'old' AS part FROM dlg_raw r WHERE NOT (coalesce(complete, '') = 'Stale' AND EXISTS (SELECT 1 FROM touched x WHERE x.lsp_id = r.lsp_id AND x.ym = {STALE.replace('scrape', 'r.scrape')}))
UNION ALL SELECT row_id, 'new' FROM new WHERE lsp_id NOT IN (SELECT lsp_id FROM none)""")
def c6(t):
    old = t.raw.withColumn("part", F.lit("old"))
    new = filters.in_month(t.raw, 1999, 6).withColumn("part", F.lit("new"))
    return mutations.replace_stale(old, new, [F.col("row_id")]).select("row_id", "part")


@query("c7_placeholder", "SELECT id AS lsp_id, name AS lsp_name, 'Missing' AS complete, coalesce(dlg_url, 'NA') AS dlg_url FROM dlg_master WHERE dlg_url IS NULL")
def c7(t):
    return mutations.placeholder(t.master.where("dlg_url is null"), "Missing", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).select("lsp_id", "lsp_name", "complete", "dlg_url")


@query("c8_upsert", f"WITH {FILLED} SELECT lsp_id, scrape_year, scrape_month, CASE WHEN lsp_id % 2 = 0 THEN 'new' ELSE status END AS status FROM dlg_summary")
def c8(t):
    old = monthly(t).select("lsp_id", "scrape_year", "scrape_month", "status")
    new = old.where("lsp_id % 2 = 0").withColumn("status", F.lit("new"))
    return mutations.upsert_summary(old.unionByName(old.where("lsp_id % 5 = 0")), new)


@query("c9_user_update", "SELECT id, firstname, CASE WHEN id % 2 = 0 THEN 'Renamed' ELSE lastname END AS lastname FROM dlg_users")
def c9(t):
    ch = t.users.where("id % 2 = 0").select("id", F.lit("Renamed").alias("lastname"), F.lit(None).cast("string").alias("firstname"))
    return mutations.partial_update(t.users, ch).select("id", "firstname", "lastname")


@query("c11_payload", """SELECT id, CASE WHEN payload LIKE '{%' THEN payload ELSE '{"raw":"' || payload || '"}' END AS payload FROM dlg_audit""")
def c11(t):
    return t.audit.select("id", mutations.decoded_payload(F.col("payload")).alias("payload"))


# ---------------------------------------------------------------- scalars

AMOUNTS = "a AS (SELECT o_orderkey AS id, o_totalprice AS v, CASE o_orderkey % 6 WHEN 0 THEN '₹ ' || cast(o_orderkey AS varchar) || ',34,567' WHEN 1 THEN 'INR ' || cast(o_orderkey AS varchar) || ' Cr' WHEN 2 THEN 'Rs. -' || cast(o_orderkey AS varchar) || '.25' WHEN 3 THEN 'none' WHEN 4 THEN NULL ELSE ' Rs ' || cast(o_orderkey AS varchar) || '000 00' END AS x FROM orders)"
PARSED = "try_cast(nullif(regexp_extract(regexp_replace(replace(replace(replace(replace(replace(x, '₹', ''), 'INR', ''), 'Rs.', ''), 'Rs', ''), ',', ''), '\\s+', '', 'g'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS double)"


def amount_texts(t):
    k = F.col("o_orderkey")
    s = k.cast("string")
    x = F.when(k % 6 == 0, F.concat(F.lit("₹ "), s, F.lit(",34,567"))).when(k % 6 == 1, F.concat(F.lit("INR "), s, F.lit(" Cr"))).when(k % 6 == 2, F.concat(F.lit("Rs. -"), s, F.lit(".25"))).when(k % 6 == 3, "none").when(k % 6 == 4, None).otherwise(F.concat(F.lit(" Rs "), s, F.lit("000 00")))
    return t.orders.select(k.alias("id"), F.col("o_totalprice").alias("v"), x.alias("x"))


@query("n1_parse_amount", f"WITH {AMOUNTS} SELECT id, {PARSED} AS amount FROM a")
def n1(t):
    return amount_texts(t).select("id", amounts.parse_amount(F.col("x")).alias("amount"))


@query("n2_crores", f"WITH {AMOUNTS} SELECT id, CASE WHEN v >= 100000 THEN round(v / 10000000, 4) ELSE v END AS amount FROM a")
def n2(t):
    return amount_texts(t).select("id", amounts.to_crores(F.col("v")).alias("amount"))


@query("n3_lakhs", f"WITH {AMOUNTS} SELECT id, CASE WHEN id % 2 = 0 THEN round(v / 100, 4) ELSE v END AS amount FROM a")
def n3(t):
    heads = F.array(F.lit("Portfolio"), F.when(F.col("id") % 2 == 0, "Amount (in Lakhs)").otherwise("Lakhsmi Bank"))
    return amount_texts(t).select("id", amounts.scale_lakhs(F.col("v"), heads).alias("amount"))


@query("n4_coerce", f"WITH {AMOUNTS}, p AS (SELECT id, CASE WHEN id % 4 = 0 THEN v END AS v, {PARSED} AS n FROM a) SELECT id, coalesce(v, CASE WHEN n >= 100000 THEN round(n / 10000000, 4) ELSE n END) AS amount FROM p")
def n4(t):
    return amount_texts(t).select("id", amounts.coerce(F.col("x"), F.when(F.col("id") % 4 == 0, F.col("v"))).alias("amount"))


@query("n5_n6_recover", """
WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Bank ' || cast(o_orderkey AS varchar) || '000' WHEN 2 THEN '12' ELSE NULL END AS lender,
  CASE o_orderkey % 3 WHEN 0 THEN cast(o_orderkey AS varchar) || ',000' WHEN 1 THEN 'P' || cast(o_orderkey AS varchar) ELSE '' END AS portfolio, CASE WHEN o_orderkey % 5 = 0 THEN 7.5 END AS amount FROM orders),
p AS (SELECT *, amount IS NULL AND coalesce(regexp_matches(portfolio, '^[0-9₹]'), false) AS ip, try_cast(replace(portfolio, ',', '') AS double) AS pn, try_cast(nullif(regexp_extract(lender, '(\\d+)', 1), '') AS double) AS ln FROM r),
q AS (SELECT *, CASE WHEN ip THEN CASE WHEN pn >= 100000 THEN round(pn / 10000000, 4) ELSE pn END ELSE amount END AS a FROM p),
s AS (SELECT *, a IS NULL AND coalesce(regexp_matches(lender, '[0-9]') AND NOT regexp_matches(lender, '^[0-9]{1,3}$'), false) AS il FROM q)
SELECT id, CASE WHEN il THEN '' ELSE lender END AS lender, CASE WHEN ip THEN '' ELSE portfolio END AS portfolio, CASE WHEN il THEN CASE WHEN ln >= 100000 THEN round(ln / 10000000, 4) ELSE ln END ELSE a END AS amount FROM s""")
def n5(t):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    lender = F.when(k % 4 == 0, "Bank").when(k % 4 == 1, F.concat(F.lit("Bank "), s, F.lit("000"))).when(k % 4 == 2, "12")
    portfolio = F.when(k % 3 == 0, F.concat(s, F.lit(",000"))).when(k % 3 == 1, F.concat(F.lit("P"), s)).otherwise("")
    rows = t.orders.select(k.alias("id"), lender.alias("lender"), portfolio.alias("portfolio"), F.when(k % 5 == 0, F.lit(7.5)).alias("amount"))
    a, b, c = amounts.recover(F.col("lender"), F.col("portfolio"), F.col("amount"))
    return rows.select("id", a.alias("lender"), b.alias("portfolio"), c.alias("amount"))


@query("n7_ocr_repair", """
WITH r AS (SELECT o_orderkey AS id, translate(cast(o_orderkey AS varchar), '0158', 'OlSB') || CASE o_orderkey % 3 WHEN 0 THEN '.2.5' WHEN 1 THEN ',0OO.' ELSE ' Cr' END AS x FROM orders),
c AS (SELECT id, regexp_replace(regexp_replace(translate(x, 'OoIl|SsBb/', '0011155887'), '[^0-9.,-]', '', 'g'), '^[.,]+|[.,]+$', '', 'g') AS t FROM r)
SELECT id, CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 THEN CASE WHEN strpos(t, '.') > 0 THEN split_part(t, '.', 1) || '.' || replace(substr(t, strpos(t, '.') + 1), '.', '') ELSE t END END AS amount FROM c""")
def n7(t):
    k = F.col("o_orderkey")
    x = F.concat(F.translate(k.cast("string"), "0158", "OlSB"), F.when(k % 3 == 0, ".2.5").when(k % 3 == 1, ",0OO.").otherwise(" Cr"))
    return t.orders.select(k.alias("id"), amounts.ocr_digits(x).alias("amount"))


@query("n8_parse_bool", "SELECT id, lower(trim(x)) IN ('true', '1', 't', 'yes', 'y') AS flag FROM (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' WHEN 2 THEN '0' WHEN 3 THEN 'no' ELSE '1' END AS x FROM customer)")
def n8(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), text.parse_bool(F.when(k % 5 == 0, " TRUE ").when(k % 5 == 1, "y").when(k % 5 == 2, "0").when(k % 5 == 3, "no").otherwise("1")).alias("flag"))


@query("n9_units", "SELECT o_orderkey AS id, round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 100 ELSE o_totalprice / 10000000 END, 9) AS amount FROM orders")
def n9(t):
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, "Crore").when(k % 3 == 1, "lakh")
    return t.orders.select(k.alias("id"), F.round(amounts.from_unit(F.col("o_totalprice"), unit), 9).alias("amount"))


def date_texts(t):
    """Texts of dates; Mon'YY of the years before 2000 are read as 20YY."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    x = F.when(k % 6 == 0, f("dd.MM.yyyy")).when(k % 6 == 1, f("dd-MM-yyyy")).when(k % 6 == 2, F.concat(F.lit("as on "), f("MMMM dd, yyyy"))).when(k % 6 == 3, f("dd'th' MMM yyyy")).when(k % 6 == 4, f("MMM''yy")).otherwise(f("MMM-yyyy"))
    return t.orders.select(k.alias("id"), x.alias("x"), d.alias("ts"))


@query("d1_dates", """
WITH o AS (SELECT o_orderkey AS id, cast(o_orderdate AS date) AS d FROM orders WHERE o_orderkey % 6 = 4)
SELECT id, strftime(last_day(make_date(2000 + extract(year FROM d) % 100, extract(month FROM d), 1)), '%Y-%m-%d') AS day FROM o UNION ALL
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 6 < 4 THEN cast(o_orderdate AS date) ELSE last_day(cast(o_orderdate AS date)) END, '%Y-%m-%d') FROM orders WHERE o_orderkey % 6 <> 4""")
def d1(t):
    return date_texts(t).select("id", F.date_format(dates.parse_date(F.col("x")), "yyyy-MM-dd").alias("day"))


@query("d3_prev_month_end", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders")
def d3(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.date_format(dates.previous_month_end(F.col("o_orderdate")), "yyyy-MM-dd").alias("day"))


@query("d4_prev_quarter_end", "SELECT o_orderkey AS id, strftime(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders")
def d4(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.date_format(dates.previous_quarter_end(F.col("o_orderdate")), "yyyy-MM-dd").alias("day"))


@query("d5_window", "SELECT row_id, extract(year FROM scrape_timestamp - INTERVAL 1 MONTH) AS y, extract(month FROM scrape_timestamp - INTERVAL 1 MONTH) AS m FROM dlg_raw")
def d5(t):
    w = dates.month_window(F.col("scrape_timestamp"))
    return t.raw.select("row_id", w["year"].alias("y"), w["month"].alias("m"))


@query("d6_subtract_months", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH, '%Y-%m-%d') AS day FROM orders")
def d6(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.date_format(dates.subtract_months(F.col("o_orderdate"), 5), "yyyy-MM-dd").alias("day"))


@query("d7_url_token", """
WITH u AS (SELECT o_orderkey AS id, o_orderdate AS d, 'https://x.example/f/' || CASE o_orderkey % 4 WHEN 0 THEN 'DLG-' || strftime(o_orderdate, '%B-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/') WHEN 2 THEN 'r_' || strftime(o_orderdate, '%b%Y') ELSE 'none' END || '.pdf' AS url FROM orders)
SELECT id, CASE WHEN id % 4 IN (0, 2) OR id % 4 = 1 AND d >= TIMESTAMP '2000-01-01' THEN extract(year FROM d) END AS y, CASE WHEN id % 4 IN (0, 2) OR id % 4 = 1 AND d >= TIMESTAMP '2000-01-01' THEN CASE WHEN id % 4 = 1 AND extract(month FROM d) >= 10 THEN 1 ELSE extract(month FROM d) END END AS m FROM u""")
def d7(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    name = F.when(k % 4 == 0, F.concat(F.lit("DLG-"), f("MMMM-yyyy"))).when(k % 4 == 1, f("yyyy/MM/")).when(k % 4 == 2, F.concat(F.lit("r_"), f("MMMyyyy"))).otherwise("none")
    at = dates.url_month(F.concat(F.lit("https://x.example/f/"), name, F.lit(".pdf")))
    return t.orders.select(k.alias("id"), at["year"].alias("y"), at["month"].alias("m"))


@query("d8_d9_promoted_url", """
WITH u AS (SELECT o_orderkey AS id, o_orderdate AS d FROM orders)
SELECT id, CASE id % 3 WHEN 0 THEN 'https://x.example/' || CASE WHEN extract(month FROM d) = 7 THEN strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%b-%Y') ELSE strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%B-%Y') END || '.pdf' WHEN 1 THEN CASE WHEN d >= TIMESTAMP '2000-03-01' AND extract(month FROM date_trunc('month', d) - INTERVAL 2 MONTH) < 10 THEN 'https://x.example/' || strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y/%m/') || 'f.pdf' END END AS url FROM u""")
def d8(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda n, p: F.date_format(dates.subtract_months(d, n), p)
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x.example/"), f(2, "MMMM-yyyy"), F.lit(".pdf"))).when(k % 3 == 1, F.concat(F.lit("https://x.example/"), f(2, "yyyy/MM/"), F.lit("f.pdf"))).otherwise(F.concat(F.lit("https://x.example/"), f(3, "MMMyyyy"), F.lit(".pdf")))
    return t.orders.select(k.alias("id"), dates.promoted_url(url, d).alias("url"))


@query("d11_label", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month_year FROM orders")
def d11(t):
    return t.orders.select(dates.month_label(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_year")).distinct()


@query("t1_extract", "SELECT doc_id, nullif(trim(regexp_extract(text, '(?is)licensed\\s+under\\s+(?:the\\s+)?([A-Z-]+)', 1)), '') AS licence FROM documents")
def t1(t):
    return t.documents.select("doc_id", text.extract(F.col("text"), r"licensed\s+under\s+(?:the\s+)?([A-Z-]+)").alias("licence"))


@query("t2_normalise", "SELECT row_id, lower(trim(coalesce(lender, ''))) AS lender, trim(coalesce(portfolio, '')) AS portfolio FROM dlg_raw")
def t2(t):
    return t.raw.select("row_id", text.normalise(F.col("lender"), True).alias("lender"), text.normalise(F.col("portfolio")).alias("portfolio"))


@query("t3_placeholder", "SELECT id, CASE WHEN x IN ('', 'None', '-', '--', '---') THEN NULL ELSE x END AS x FROM (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN '--' WHEN 3 THEN '----' ELSE c_name END AS x FROM customer)")
def t3(t):
    k = F.col("c_custkey")
    x = F.when(k % 6 == 0, "").when(k % 6 == 1, "None").when(k % 6 == 2, "--").when(k % 6 == 3, "----").otherwise(F.col("c_name"))
    return t.customer.select(k.alias("id"), text.without_placeholder(x, True).alias("x"))


@query("t4_portfolio_hint", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'Portfolio ' || cast(p_partkey AS varchar) END AS hint FROM part")
def t4(t):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("see PORTFOLIO "), k.cast("string"), F.lit(": 5"))).when(k % 3 == 1, F.concat(F.lit("portfolio "), k.cast("string"))).otherwise(F.lit("nothing"))
    return t.part.select(k.alias("id"), text.portfolio_hint(line).alias("hint"))


@query("t5_safe_numbers", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey AS int) END AS i, CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey AS double) WHEN c_custkey % 3 = 1 THEN cast(c_custkey AS double) + 0.5 END AS f FROM customer")
def t5(t):
    k = F.col("c_custkey")
    x = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise("x")
    return t.customer.select(k.alias("id"), F.when(k % 3 != 1, text.safe_int(x)).alias("i"), text.safe_double(x).alias("f"))


OFFENCE = "CASE WHEN portfolio IS NULL OR amount IS NULL THEN 'Partial' WHEN as_on_timestamp IS NULL OR date_trunc('month', as_on_timestamp) <> date_trunc('month', scrape_timestamp) - INTERVAL 1 MONTH THEN 'Stale' END"


@query("k1_status", f"""
WITH o AS (SELECT lsp_id, extract(year FROM scrape_timestamp) AS y, row_id, {OFFENCE} AS off FROM dlg_raw),
f AS (SELECT lsp_id, y, off, row_number() OVER (PARTITION BY lsp_id, y ORDER BY CASE WHEN off IS NULL THEN 1 ELSE 0 END, row_id) AS rn FROM o)
SELECT lsp_id, y, coalesce(off, 'Completed') AS status FROM f WHERE rn = 1""")
def k1(t):
    off = status.row_offence(F.col("portfolio"), F.col("amount"), F.col("as_on_timestamp"), F.col("scrape_timestamp"))
    rows = t.raw.select("lsp_id", F.year("scrape_timestamp").alias("y"), "row_id", off.alias("off"))
    return rows.groupBy("lsp_id", "y").agg(status.set_status(F.col("off"), F.col("row_id")).alias("status"))


@query("k3_manual_status", f"SELECT row_id, coalesce({OFFENCE}, 'Completed') AS status FROM dlg_raw")
def k3(t):
    return t.raw.select("row_id", status.manual_status(F.col("portfolio"), F.col("amount"), F.col("as_on_timestamp"), F.col("scrape_timestamp")).alias("status"))


@query("k4_fetch_status", "SELECT id, CASE WHEN dlg_url IS NULL THEN 'Missing' WHEN id % 4 = 0 THEN 'Error' END AS status FROM dlg_master")
def k4(t):
    return t.master.select("id", status.fetch_status(F.col("dlg_url"), F.col("id") % 4 == 0).alias("status"))


# ---------------------------------------------------------------- sources and links


@query("s6_fetch_mode", "SELECT id, CASE WHEN lower(coalesce(fetch_hint, 'auto')) = 'playwright' THEN 'playwright' ELSE 'requests' END AS mode FROM dlg_master")
def s6(t):
    return t.master.select("id", fetch.fetch_mode(F.col("fetch_hint")).alias("mode"))


@query("e1_strategy", "SELECT id, CASE WHEN parse_hint IN ('plain_text', 'ocr_simple') THEN parse_hint WHEN parse_hint = 'pdf_table' OR id % 6 = 0 THEN 'pdf_table' WHEN parse_hint = 'html_table' THEN 'html_table' ELSE 'auto' END AS strategy FROM dlg_master")
def e1(t):
    url = F.when(F.col("id") % 6 == 0, F.lit("https://x.example/A.PDF")).otherwise(F.col("dlg_url"))
    return t.master.select("id", fetch.strategy(F.col("parse_hint"), fetch.looks_like_pdf(F.lit(None).cast("string"), url)).alias("strategy"))


@query("s18_crawl_sources", "SELECT id FROM dlg_master WHERE active")
def s18(t):
    return tables.crawl_sources(t.master).select("id")


@query("s19_enums", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in (("CrawlStatus", status.STATUSES), ("AuditAction", status.ACTIONS), ("LSPType", status.LSP_TYPES)) for v in vs) + ") AS e(kind, value)")
def s19(t):
    return tables.enum_catalog(t.spark)


@query("g1_score", """
WITH u AS (SELECT page_id, lower(url || CASE page_id % 6 WHEN 0 THEN '/dlg-disclosure' WHEN 1 THEN '/legal' WHEN 2 THEN '/blog/other-disclosures/' WHEN 3 THEN '.pdf' ELSE '' END) AS u, CASE page_id % 4 WHEN 0 THEN 'dlg declaration' WHEN 1 THEN 'compliance' ELSE '' END AS t FROM pages)
SELECT page_id, CASE WHEN t LIKE '%dlg%' THEN 20.0 ELSE 0 END + CASE WHEN u LIKE '%dlg%' THEN 15.0 ELSE 0 END
 + CASE WHEN regexp_matches(u, '(/dlg[-_/]?disclosure|/dlg[-_/]?portfolio|/other[-_/]?disclosures|/rbi[-_/]?disclosures|/policy[-_/]?disclosure|/website[-_/]?disclosure|/disclosures?)(/|$)') THEN 10.0 ELSE 0 END
 + CASE WHEN regexp_matches(u, 'default\\s+loss|dlg\\b|fldg\\b|disclosur|declarati|compliance') THEN 5.0 ELSE 0 END + CASE WHEN regexp_matches(t, 'dlg\\b|declarati|compliance') THEN 5.0 ELSE 0 END
 + CASE WHEN u LIKE '%.pdf' OR u LIKE '%.pdf?%' THEN 3.0 ELSE 0 END - CASE WHEN regexp_matches(u, '/blog|/careers|/jobs|/press|/news|/privacy|/terms|/cookie') THEN 5.0 ELSE 0 END
 - CASE WHEN regexp_matches(u, '/legal|/policies|/disclaimer|/compliance') AND u NOT LIKE '%dlg%' AND t NOT LIKE '%dlg%' THEN 3.0 ELSE 0 END AS score FROM u""")
def g1(t):
    k = F.col("page_id")
    u = F.concat("url", F.when(k % 6 == 0, "/dlg-disclosure").when(k % 6 == 1, "/legal").when(k % 6 == 2, "/blog/other-disclosures/").when(k % 6 == 3, ".pdf").otherwise(""))
    return t.pages.select("page_id", links.score(u, F.when(k % 4 == 0, "DLG Declaration").when(k % 4 == 1, "Compliance").otherwise("")).alias("score"))


@query("g4_links", """
WITH a AS (SELECT url, html, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT url AS page_url, href, count(*) AS n FROM a GROUP BY ALL""")
def g4(t):
    return links.links(t.pages).groupBy("page_url", "href").agg(F.count("*").alias("n"))


@query("g5_content", "SELECT page_id, regexp_matches(html, '(?i)default\\s+loss\\s+guarantee') AS says FROM pages")
def g5(t):
    return t.pages.select("page_id", links.says_so(F.col("html"), F.lit(False)).alias("says"))


@query("g9_origin", "SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin, regexp_replace(url, '/+$', '') AS home FROM pages")
def g9(t):
    return t.pages.select("page_id", links.origin(F.col("url")).alias("origin"), links.home(F.col("url")).alias("home"))


@query("g10_acceptable", "SELECT page_id, page_id % 3 <> 0 AND length(trim(html)) >= 200 AS ok FROM pages")
def g10(t):
    return t.pages.select("page_id", links.acceptable(F.when(F.col("page_id") % 3 == 0, 404).otherwise(200), F.lit("text/HTML"), F.col("html")).alias("ok"))


@query("g11_diagnosis", "SELECT id, concat_ws('; ', CASE WHEN id % 2 = 0 THEN 'no home page is known' END, CASE WHEN id % 3 = 0 THEN 'the home page could not be read' END, CASE WHEN id % 5 > 0 THEN 'no disclosure on ' || cast(id % 5 AS varchar) || ' pages' END) AS why FROM dlg_master")
def g11(t):
    k = F.col("id")
    return t.master.select("id", links.diagnosis(k % 2 == 0, k % 3 == 0, k % 5).alias("why"))


# ---------------------------------------------------------------- state machines over lines

USER_ORDER = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("w9_pairs_in_runs", f"""
WITH RECURSIVE l AS (
  SELECT *, {USER_ORDER} AS n, CASE event_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'D' WHEN 2 THEN 'A' WHEN 3 THEN 'D' ELSE 'O' END AS kind,
         CASE event_id % 5 WHEN 2 THEN '1,' || cast(event_id AS varchar) WHEN 4 THEN event_type ELSE cast(event_id AS varchar) END AS line FROM events
), s AS (
  SELECT user_id, n, event_id, line, CASE WHEN kind = 'D' THEN line END AS open, cast(NULL AS varchar) AS label, event_id % 97 = 96 AS stopped FROM l WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.n, l.event_id, l.line, CASE WHEN s.open IS NULL AND kind = 'D' THEN l.line END, CASE WHEN kind <> 'O' AND NOT (stopped OR l.event_id % 97 = 96) THEN s.open END, stopped OR l.event_id % 97 = 96
  FROM s JOIN l ON l.user_id = s.user_id AND l.n = s.n + 1
)
SELECT event_id, label, line AS amount FROM s WHERE label IS NOT NULL""")
def w9(t):
    k = F.col("event_id") % 5
    line = F.when(k == 2, F.concat(F.lit("1,"), F.col("event_id").cast("string"))).when(k == 4, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    rows = t.events.withColumn("line", line)
    found = sequences.pairs_in_runs(rows, ["user_id"], ["ts", "event_id"], "line", F.col("line").rlike(r"^\d+$"), F.col("line").rlike(r"^[\d,.]+$"), F.col("event_id") % 97 == 96)
    return found.select("event_id", "label", F.col("line").alias("amount"))


@query("w13_skip_next", """
WITH l AS (
  SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'amount' WHEN 2 THEN 'amount' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'total' ELSE 'text' END END AS kind FROM orders
), a AS (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM l x WHERE kind = 'amount' AND NOT EXISTS (
    SELECT 1 FROM l t WHERE t.o_custkey = x.o_custkey AND t.kind = 'total' AND t.o_orderkey < x.o_orderkey AND NOT EXISTS (
      SELECT 1 FROM l b WHERE b.o_custkey = x.o_custkey AND b.kind = 'amount' AND b.o_orderkey > t.o_orderkey AND b.o_orderkey < x.o_orderkey))
), b AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM l WHERE kind = 'label'
)
SELECT o_custkey, b.o_orderkey AS portfolio, round(a.o_totalprice, 2) AS amount FROM b JOIN a USING (o_custkey, n)""")
def w13(t):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "label").when(k < 3, "amount").when(F.col("o_orderkey") % 3 == 0, "total").otherwise("text")
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", kind.alias("kind"))
    amounts = sequences.without_next(rows, ["o_custkey"], ["o_orderkey"], "kind", "total", "amount").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("amount"))
    labels = rows.where("kind = 'label'").select("o_custkey", "o_orderkey")
    return sequences.nth_with_nth(labels, amounts, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("portfolio"), money("amount").alias("amount"))


@query("w10_keyword_window", f"""
WITH RECURSIVE l AS (
  SELECT event_id, user_id, {USER_ORDER} AS n, event_id % 4 = 0 OR event_type = 'error' AS kw, event_id % 3 <> 0 AS hit FROM events
), s AS (
  SELECT user_id, n, event_id, hit AND kw AS told, CASE WHEN NOT kw OR hit THEN 0 ELSE 2 END AS win FROM l WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.n, l.event_id, hit AND (kw OR win > 0), CASE WHEN hit AND (kw OR win > 0) THEN 0 WHEN kw THEN 2 ELSE greatest(0, win - 1) END
  FROM s JOIN l ON l.user_id = s.user_id AND l.n = s.n + 1
)
SELECT event_id FROM s WHERE told""")
def w10(t):
    keyword = (F.col("event_id") % 4 == 0) | (F.col("event_type") == "error")
    return sequences.within_keyword(t.events, ["user_id"], ["ts", "event_id"], keyword, F.col("event_id") % 3 != 0).select("event_id")


@query("w11_carried_headers", """
WITH RECURSIVE c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_partkey % 5 = 0 THEN ['Lender', 'Amount', 'Note'] WHEN l_partkey % 5 < 3 THEN ['L' || cast(l_suppkey AS varchar), cast(l_quantity AS varchar), 'x'] ELSE ['L' || cast(l_suppkey AS varchar), cast(l_quantity AS varchar)] END AS cells,
         CASE WHEN l_partkey % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS n
  FROM lineitem
), f AS (
  SELECT l_orderkey, l_linenumber, cells, l_partkey % 5 = 0 AS head, day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS t FROM c WHERE n = 1
), s AS (
  SELECT l_orderkey, l_linenumber, t, cells AS headers, true AS own, day FROM f WHERE t = 1
  UNION ALL
  SELECT f.l_orderkey, f.l_linenumber, f.t, CASE WHEN head OR len(cells) <> len(headers) THEN cells ELSE headers END, head OR len(cells) <> len(headers), coalesce(s.day, f.day) FROM s JOIN f ON f.l_orderkey = s.l_orderkey AND f.t = s.t + 1
)
SELECT l_orderkey, l_linenumber, cells[1] || '|' || cells[2] AS vals, array_to_string(headers, '|') AS headers, s.day AS as_on FROM c JOIN s USING (l_orderkey, l_linenumber) WHERE NOT own OR n > 1""")
def w11(t):
    """Orders as reports, their line numbers as tables, whose rows have two or three cells."""
    k = F.col("l_partkey") % 5
    lender, quantity = F.concat(F.lit("L"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string")
    cells = F.when(k == 0, F.array(*map(F.lit, ["Lender", "Amount", "Note"]))).when(k < 3, F.array(lender, quantity, F.lit("x"))).otherwise(F.array(lender, quantity))
    place = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", place.alias("place"), cells.alias("cells"), F.when(F.col("l_partkey") % 4 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("as_on"))
    found = sequences.carried_headers(rows, ["l_orderkey"], ["l_linenumber"], "place", "cells", F.get("cells", 0) == "Lender", "as_on")
    return found.select("l_orderkey", "l_linenumber", F.concat_ws("|", F.slice("cells", 1, 2)).alias("vals"), F.concat_ws("|", "headers").alias("headers"), "as_on")
