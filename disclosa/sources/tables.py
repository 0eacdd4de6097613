"""Tables: scans, creation, appends, swaps and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disclosa.functions.status import ACTIONS, LSP_TYPES, STATUSES
from disclosa.operators.filters import active_rows
from disclosa.operators.joins import null_safe_anti
from disclosa.operators.mutations import audit_record, fresh_raw, replace_stale

SCHEMAS = {
    "lsp_master": "id int, name string, brand_name string, lsp_type string, home_url string, active boolean, dlg_url string, parse_hint string, fetch_hint string, rules_json string, last_crawl_date timestamp_ntz",
    "dlg_raw": "id long, lsp_id int, lsp_name string, lender string, portfolio string, amount double, as_on_timestamp timestamp_ntz, scrape_timestamp timestamp_ntz, complete string, dlg_url string",
    "audit_log": "id long, lsp_id int, auto_manual string, user_id string, payload string, action_taken string, log_timestamp timestamp_ntz",
    "dlg_users": "id int, username string, role string, firstname string, lastname string, active boolean, reset_password boolean, create_date timestamp_ntz, modify_date timestamp_ntz, last_login timestamp_ntz",
    "lsp_summary": "id long, lsp_id int, name string, total_lenders int, total_portfolios int, total_amount double, dlg_url string, as_on_year int, as_on_month int, scrape_year int, scrape_month int, status string, last_crawl_date timestamp_ntz",
}


_MONTH, _HASH = "coalesce(date_format({}, 'yyyy-MM'), 'none')", "cast(pmod(xxhash64(cast(id AS int)), 16) AS string)"
#: The partition that a row of a table lies in, and the key of tables whose rows are
#: merged; the others are logs, whose rows are added in batches.
PARTS = {
    "dlg_raw": _MONTH.format("scrape_timestamp"),
    "audit_log": _MONTH.format("log_timestamp"),
    "lsp_summary": "concat(coalesce(cast(scrape_year AS string), 'none'), '-', coalesce(lpad(cast(scrape_month AS string), 2, '0'), 'none'))",
    "lsp_master": _HASH,
    "dlg_users": _HASH,
}
KEYS = {"lsp_summary": ["lsp_id", "scrape_year", "scrape_month"], "lsp_master": ["id"], "dlg_users": ["id"]}


class MonthTables:
    """Parquet tables in a folder, partitioned by month (or by a hash of the key).

    Every write replaces whole partitions and becomes visible when its job commits
    (dynamic partition overwrite).  A batch of a log has partitions of its own, named by
    its id: run again it replaces itself, and two writers cannot lose each other's rows.
    A merge reads and writes the partitions that its rows touch, no others; run again it
    gives the same; of two merges into one partition at a time the later one stands.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create_missing(self) -> list[str]:
        """The names of the tables that had to be created."""
        made = []
        for name in SCHEMAS:
            fs, p = self._fs(self.path(name))
            if not fs.exists(p):
                fs.mkdirs(p)
                made.append(name)
        return made

    def _by(self, name: str) -> list[str]:
        return ["part"] if name in KEYS else ["part", "batch"]

    def stored(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """The rows with their partition columns, of some partitions or all."""
        schema = ", ".join([SCHEMAS[name], *(f"{c} string" for c in self._by(name))])
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return self.stored(name, parts).drop("part", "batch")

    def _placed(self, name: str, rows: DataFrame, batch: str | None) -> DataFrame:
        """``rows`` with the table's columns (what they lack is null) and partitions."""
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMAS[name]).fields)).withColumn("part", F.expr(PARTS[name]))
        return full if name in KEYS else full.withColumn("batch", F.lit(batch))

    def _write(self, name: str, placed: DataFrame) -> None:
        placed.write.partitionBy(*self._by(name)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    def parts_of(self, name: str, rows: DataFrame) -> list[str]:
        """The partitions of ``rows``: months, or some hashes."""
        return sorted(r["part"] for r in rows.select(F.expr(PARTS[name]).alias("part")).distinct().collect())

    def append(self, name: str, rows: DataFrame, batch: str) -> None:
        """Add a batch to a log; the same batch again replaces itself."""
        self._write(name, self._placed(name, rows, batch))

    def append_crawled(self, rows: DataFrame, batch: str) -> None:
        """Crawled rows that no other batch has stored in their scrape month; only those
        months are read and cleansed."""
        others = self.stored("dlg_raw", self.parts_of("dlg_raw", rows)).where(F.col("batch") != batch).drop("part", "batch")
        self.append("dlg_raw", fresh_raw(others, rows), batch)

    def replace_stale(self, rows: DataFrame, batch: str, order: list) -> None:
        """``replace_stale`` on the stored months of the rows: other batches lose their
        stale rows of the crawled sources (a batch that has no others goes), then the rows
        that count are a batch."""
        month = F.trunc(F.col("scrape_timestamp").cast("date"), "month")
        touched = rows.select("lsp_id", month.alias("m")).distinct()
        old = self.stored("dlg_raw", self.parts_of("dlg_raw", rows)).where(F.col("batch") != batch).withColumn("m", month)
        gone = F.coalesce(F.col("complete") == "Stale", F.lit(False)) & F.col("hit__").isNotNull()
        marked = old.join(touched.withColumn("hit__", F.lit(True)), ["lsp_id", "m"], "left").withColumn("gone", gone)
        hit = marked.groupBy("part", "batch").agg(F.max("gone").alias("hit"), F.min("gone").alias("empty")).where("hit").collect()
        fields = [f.name for f in T._parse_datatype_string(SCHEMAS["dlg_raw"]).fields]
        if changed := [(r["part"], r["batch"]) for r in hit if not r["empty"]]:
            of = F.broadcast(self.spark.createDataFrame(changed, "part string, batch string"))
            self._write("dlg_raw", marked.where(~F.col("gone")).join(of, ["part", "batch"], "left_semi").select(*fields, "part", "batch"))
        for r in hit:
            if r["empty"]:
                fs, p = self._fs(f"{self.path('dlg_raw')}/part={r['part']}/batch={r['batch']}")
                fs.delete(p, True)
        nothing = self.spark.createDataFrame([], SCHEMAS["dlg_raw"])
        self.append("dlg_raw", replace_stale(nothing, rows, order), batch)

    def merge(self, name: str, rows: DataFrame) -> None:
        """New rows replace those of their key, in the partitions that they touch."""
        new = self._placed(name, rows, None)
        old = self.stored(name, self.parts_of(name, rows))
        self._write(name, null_safe_anti(old, new, KEYS[name]).select(*new.columns).unionByName(new))

    def record(self, actions: DataFrame, batch: str) -> None:
        """Audit rows with their user's details (``audit_record``)."""
        self.append("audit_log", audit_record(actions, self.read("dlg_users")), batch)


def jdbc_table(spark: SparkSession, url: str, name: str, schema: str | None = None, **options) -> DataFrame:
    """A table of a database, with partition bounds in ``options`` if it is large."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{name}" if schema else name, **options).load()


def crawl_sources(master: DataFrame, lsp_id: int | None = None) -> DataFrame:
    rows = active_rows(master)
    return rows.where(F.col("id") == lsp_id) if lsp_id else rows


def enum_catalog(spark: SparkSession) -> DataFrame:
    """(kind, value) of all enumerations."""
    rows = [("CrawlStatus", x) for x in STATUSES] + [("AuditAction", x) for x in ACTIONS] + [("LSPType", x) for x in LSP_TYPES]
    return spark.createDataFrame(rows, "kind string, value string")


def write_ocr(records: DataFrame, path: str, kind: str = "json", simple: bool = False) -> None:
    """Recognised records as JSON, or as CSV (with ``simple`` two columns)."""
    if kind == "json":
        records.write.json(path)
    else:
        (records.select("portfolio_hint", "amount") if simple else records).write.csv(path, header=True)
