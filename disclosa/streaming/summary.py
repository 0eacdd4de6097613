"""Streams of raw rows: the monthly summary by keyed state, and rows without repeats."""

from __future__ import annotations

import datetime as dt
import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from disclosa.functions.dates import month_window
from disclosa.functions.status import STATUSES, of_severity, severity, staleness
from disclosa.functions.text import filled, normalise, status_of
from disclosa.shared import SHUFFLES_GO, configured

#: How a stream keeps its state, and what goes once it is not needed any more.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
} | SHUFFLES_GO
KEYS = ["lsp_id", "scrape_year", "scrape_month"]
OUT = "lsp_id long, scrape_year int, scrape_month int, n_rows long, final boolean, name string, total_lenders int, total_portfolios int, total_amount double, dlg_url string, as_on string, severity int, last_crawl string"


COLUMNS = [f.split()[0] for f in OUT.split(", ")]
#: What a state is given of a row; "" or 0 for null.
GIVEN = ["source", "month", "ts", "row_id", "name", "lender", "portfolio", "amount", "as_on", "severity", "url"]
#: Sources with ids in a row whose open months are one state.
SOURCES = 64


def fold(state: dict | None, rows: list[tuple]) -> dict:
    """The state of a source's month after more rows (ts, row_id, name, lender, portfolio,
    amount, as_on, severity, url), which may come in any order: running values, and the
    lenders and portfolios with their places, for a lender goes down to rows that may
    still come."""
    s = state or {"n": 0, "amount": 0.0, "as_on": None, "severity": None, "last": None, "name": None, "url": None, "lines": []}
    for ts, row_id, name, lender, portfolio, amount, as_on, sev, url in rows:
        at = [ts, row_id]
        s["n"] += 1
        s["amount"] += amount or 0.0
        s["as_on"] = max(filter(None, (s["as_on"], as_on)), default=None)
        s["severity"] = max(filter(None, (s["severity"], sev)), default=None)
        s["last"] = max(filter(None, (s["last"], ts)))
        for k, v in (("name", name), ("url", url)):
            if v and (s[k] is None or s[k][0] < at):
                s[k] = [at, v]
        s["lines"].append([ts, row_id, lender, portfolio])
    return s


def told(state: dict) -> dict:
    """The summary of a state; the lender of a row without one is that of the row before."""
    lender, pairs, lenders = "", set(), set()
    for _, _, own, portfolio in sorted(state["lines"]):
        lender = own or lender
        lenders.add(lender)
        if portfolio:
            pairs.add((lender, portfolio))
    own = {x[2] for x in state["lines"]} - {""}
    value = lambda k: state[k] and state[k][1]
    return {"n_rows": state["n"], "name": value("name"), "total_lenders": len(own), "total_portfolios": len(pairs) or len(lenders - {""}), "total_amount": state["amount"], "dlg_url": value("url"), "as_on": state["as_on"], "severity": state["severity"], "last_crawl": state["last"]}


def closes(month: str) -> int:
    """When a month (yyyy-mm) is over, in ms: rows of a window are scraped in the month
    after it, and 31 days later none comes."""
    year, after = int(month[:4]), int(month[5:]) + 2
    end = dt.datetime(year + (after - 1) // 12, (after - 1) % 12 + 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=31)
    return int(end.timestamp() * 1000)


class MonthsOfSources(StatefulProcessor):
    """The summaries of the open months of some sources (``SOURCES``): each batch tells what
    those that it touches are by then, and when the watermark has passed a month a timer
    tells its last and drops it.  These months are one state with one timer, for a call on
    the state costs more than the rows of a source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("months", "rows string")

    def _open(self) -> dict:
        known = self.state.get()
        return {(source, month): state for source, month, state in json.loads(known[0])} if known else {}

    def _keep(self, months: dict) -> None:
        if months:
            self.state.update((json.dumps([(*k, state) for k, state in months.items()]),))
            self.handle.registerTimer(min(map(closes, {m for _, m in months})))
        else:
            self.state.clear()

    def _frame(self, months: dict, final: bool) -> pd.DataFrame:
        rows = []
        for (source, month), state in months.items():
            row = dict(zip(KEYS, (int(source) if source else None, int(month[:4]), int(month[5:])))) | {"final": final} | told(state)
            rows.append([row[c] for c in COLUMNS])
        return pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        months, new = self._open(), defaultdict(list)
        for frame in rows:
            for source, month, *given in zip(*(frame[c].tolist() for c in GIVEN)):
                new[source, month].append(given)
        for k, given in new.items():
            months[k] = fold(months.get(k), given)
        self._keep(months)
        yield self._frame({k: months[k] for k in new}, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        months, now = self._open(), timerValues.getCurrentWatermarkInMs()
        over = {m for m in {m for _, m in months} if closes(m) <= now}
        done = {k: months.pop(k) for k in list(months) if k[1] in over}
        if done:
            self._keep(months)
            yield self._frame(done, True)

    def close(self) -> None:
        pass


def month_states(raw: DataFrame, tie: str = "row_id", late: str = "31 days") -> DataFrame:
    """A stream of summaries (``OUT``) of a stream of raw rows: for each batch one row for
    each source and month that it touches.  Rows without a scrape time drop out, as do
    rows later than ``late``; state lives in RocksDB and goes with its month."""
    w = month_window(F.col("scrape_timestamp"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    given = lambda x, none="": F.coalesce(x, F.lit(none))  # noqa: E731 (a null would be a NaN in pandas)
    rows = raw.where(F.col("scrape_timestamp").isNotNull()).withColumn("event_time", F.col("scrape_timestamp").cast("timestamp")).withWatermark("event_time", late)
    rows = rows.select(
        F.expr(f"cast(lsp_id AS bigint) div {SOURCES}").alias("sources"), "event_time", given(F.col("lsp_id").cast("long").cast("string")).alias("source"), F.format_string("%04d-%02d", w["year"], w["month"]).alias("month"),
        text("scrape_timestamp").alias("ts"), given(F.col(tie).cast("string")).alias("row_id"), given(filled(F.col("lsp_name"))).alias("name"), given(normalise(F.col("lender"), True)).alias("lender"), given(normalise(F.col("portfolio"))).alias("portfolio"),
        given(F.col("amount").cast("double"), 0.0).alias("amount"), given(text("as_on_timestamp")).alias("as_on"), given(severity(status_of(F.col("complete"), STATUSES)).cast("int"), 0).alias("severity"), given(filled(F.col("dlg_url"))).alias("url"),
    )
    return rows.groupBy("sources").transformWithStateInPandas(MonthsOfSources(), OUT, "Update", "EventTime")


def summarise_stream(raw: DataFrame, sink: str, checkpoint: str, tie: str = "row_id", late: str = "31 days") -> StreamingQuery:
    """Run ``month_states`` over what there is and write each batch to ``sink``, a batch
    as a partition: run again it replaces itself, so a replay changes nothing."""

    def batch(found: DataFrame, n: int) -> None:
        found.withColumn("batch", F.lit(n)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(sink)

    return _started(raw.sparkSession, lambda: month_states(raw, tie, late).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _started(spark: SparkSession, start) -> StreamingQuery:
    """A stream whose state lies in RocksDB, on disk (the default holds it in the memory of
    the executors), and which keeps on disk what it needs: its last batches, the keys that
    the watermark has not passed, the shuffle files of the batch it is at."""
    with configured(spark, STREAM):
        return start()


def summary_of(spark: SparkSession, sink: str) -> DataFrame:
    """The monthly summary that ``summarise_stream`` has written so far: of each source
    and month the state of most rows."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("n_rows"), F.desc("final"), F.desc("batch"))
    rows = spark.read.schema(f"{OUT}, batch int").parquet(sink).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    as_on = F.to_timestamp_ntz("as_on", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = rows.withColumns({"name": F.coalesce("name", F.concat(F.lit("LSP-"), F.col("lsp_id").cast("string"))), "as_on_year": F.year(as_on), "as_on_month": F.month(as_on), "last_crawl_date": F.to_timestamp_ntz("last_crawl", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))})
    status = staleness(F.coalesce(of_severity(F.col("severity")), F.lit("Missing")), F.col("as_on_year"), F.col("as_on_month"), F.col("scrape_year"), F.col("scrape_month"))
    return rows.select(*KEYS, "name", "total_lenders", "total_portfolios", "total_amount", "dlg_url", "as_on_year", "as_on_month", status.alias("status"), "last_crawl_date")


def without_repeats(raw: DataFrame, keys: list[str], late: str = "31 days") -> DataFrame:
    """A stream of raw rows without those whose ``keys`` came before within ``late``.
    Rows without a scrape time drop out: no watermark could ever forget them."""
    rows = raw.where(F.col("scrape_timestamp").isNotNull()).withColumn("event_time", F.col("scrape_timestamp").cast("timestamp"))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys).drop("event_time")


def append_stream(raw: DataFrame, sink: str, checkpoint: str, keys: list[str], late: str = "31 days") -> StreamingQuery:
    """Append a stream to a folder of Parquet, each row once however often it comes."""
    return _started(raw.sparkSession, lambda: without_repeats(raw, keys, late).writeStream.format("parquet").option("compression", "zstd").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event-time counts and sums of a stream of events, late rows bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
