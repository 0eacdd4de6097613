"""Disclosures in plain text, by layout, as windows over typed lines (no Python workers).

A document's lines are typed by the first wording that fits; what a line means by the
lines before it are the state machines of ``operators.sequences``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclosa.functions.dates import parse_date
from disclosa.functions.text import once
from disclosa.operators.sequences import nth_with_nth, pairs_in_runs, without_next
from disclosa.operators.windows import keep_first
from disclosa.shared import stored
from disclosa.sources.rules import with_specs

#: Sources and wordings that have a layout of their own.
AGENT_NAME, AGENT_WORDING = "FinAGG", "Portfolio OS as on"
PAIRED_NAME, PAIRED_WORDINGS = "Finnable", ("Portfolio Number", "Disbursement")
GRID_NAMES, GRID_WORDING = ("nira", "shuhari"), "nirafinance"
#: Wordings of dates, and of the lines of a layout by kind.
APP_LINES = {"app": r"^Digital Lending App:\s*(.+)$", "as_on": r"\bas on\b\s+(.+?)(?:\s*\(|\s*$)", "lender": r"^(Lender\s+[A-Za-z0-9]+)\b.*?:\s*$", "portfolio": r"^Portfolio\s+([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)?)\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*$"}
GRID_DATE = r"Last updated on ([A-Za-z]+ \d{1,2},?\s*\d{4})"
GRID_LINES = {"label": r"^Portfolio\s+(\d+)$", "total": r"^Total", "amount": r"^.*?(?:Rs\.?|INR)\s*([\d,]+(?:\.\d+)?)\s*Crore?"}
PAIRED_DATE = r"Last updated as of ([A-Za-z]+ \d{4})"
AGENT_DATE = r"as\s+on\s+([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})"
AGENT_LINES = {"portfolio": r"^Portfolio\s*([0-9l]+)(?:\s+([0-9,\s]+))?\s*(?:(Yes|No))?\s*$", "merged": r"^Portfolio\s+(\d[\d,]+)\s+Yes\s*$", "alone": r"^[0-9,\s]+$"}
#: From more than this amount on a line of the agent layout is its total.
LARGEST = 7_000_000_000
#: Characters of documents whose lines a task sorts: some hundred MB of rows.
TASK_CHARS = 1 << 23

ROW = ["source_id", "row_pos", "layout", "lsp_name", "lender", "portfolio", "amount", "as_on", "error"]
BY, ORDER = ["source_id"], ["pos"]


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, ignoring case; null where nothing fits or it is empty."""
    return F.nullif(F.regexp_extract(x, _i(pattern), group), F.lit(""))


def number(x: Column) -> Column:
    return F.regexp_replace(x, r"[,\s]", "").try_cast("double")


def lines_of(docs: DataFrame) -> DataFrame:
    """The filled lines of documents, white space made one blank: pos, line, and ``as_on``
    and ``own`` of the document where it has them."""
    parts = F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    rows = docs.select("source_id", "lsp_name", *(c for c in ("as_on", "own") if c in docs.columns), F.posexplode(parts).alias("pos", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\s+", " "))).where("line <> ''")


def typed_lines(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Lines with their ``kind``, the first wording that fits, else null."""
    kind = reduce(lambda k, x: k.when(F.col("line").rlike(_i(x[1])), x[0]), kinds.items(), F)
    return lines_of(docs).withColumn("kind", kind)


def layout_of() -> Column:
    """agent, paired, grid, pattern or app: by the source's name, the wording and rules
    whose every named field is a pattern."""
    name, text = F.coalesce("lsp_name", F.lit("")), F.coalesce("text", F.lit(""))
    has = lambda x, *words: reduce(lambda a, b: a | b, (x.contains(w) for w in words))
    at = lambda path: F.get_json_object("rules_json", f"$.field_map.{path}")
    named = [at(f).isNull() | at(f"{f}.regex").isNotNull() for f in ("lender", "portfolio", "amount")]
    ruled = F.coalesce(F.size(F.json_object_keys("rules_json")) > 0, F.lit(False))
    return (
        F.when(has(name, AGENT_NAME) | has(text, AGENT_WORDING), "agent")
        .when(has(name, PAIRED_NAME) | (has(text, PAIRED_WORDINGS[0]) & has(text, PAIRED_WORDINGS[1])), "paired")
        .when(has(F.lower(name), *GRID_NAMES) | has(F.lower(text), GRID_WORDING), "grid")
        .when(ruled & named[0] & named[1] & named[2], "pattern")
        .otherwise("app")
    )


def _last(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(x, ignorenulls=True).over(w)


def dated(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents with the day in their text, which then goes down with their lines (a join
    of it by source would be broadcast, however many there are)."""
    return docs.withColumn("as_on", parse_date(_part(F.coalesce("text", F.lit("")), pattern)))


def app_layout(docs: DataFrame) -> DataFrame:
    """Headings of apps, below each an as-on line, lender lines and portfolio lines; a
    heading begins a segment without lender and date; equal rows once.

    Lines go on as what they say, not as texts.  What is carried down has its place with
    it, so that one above the last heading counts no more and one window does for all.
    """
    says = lambda kind, x: F.when(F.col("kind") == kind, once(x, lambda v: F.when(v.isNotNull(), F.struct(F.col("pos"), v.alias("x")))))
    part = lambda kind, group=1: _part(F.col("line"), APP_LINES[kind], group)
    wording = F.regexp_replace(F.regexp_replace(part("as_on"), r"(?i)\bunaudited\b.*$", ""), r"^[ :.-]+|[ :.-]+$", "")
    of = F.col("kind") == "portfolio"
    rows = typed_lines(docs, APP_LINES).select(
        *BY, "pos", says("app", part("app")).alias("app"), says("as_on", parse_date(wording)).alias("day"), says("lender", part("lender")).alias("by"),
        F.when(of, part("portfolio")).alias("portfolio"), F.when(of, number(part("portfolio", 2))).alias("amount"),
    )
    rows = rows.withColumns({c: _last(F.col(c), BY) for c in ("app", "day", "by")}).where("portfolio is not null and app is not null")
    below = lambda c: F.when(F.col(c)["pos"] > F.col("app")["pos"], F.col(c)["x"])
    rows = rows.select(*BY, "pos", F.col("app")["x"].alias("lsp_name"), below("by").alias("lender"), "portfolio", "amount", below("day").alias("as_on"))
    return keep_first(rows, ["source_id", "lsp_name", "lender", "portfolio", "amount", "as_on"], [F.col("pos")])


def grid_layout(docs: DataFrame) -> DataFrame:
    """Portfolio labels and crore amounts in any interleaving: n-th with n-th, the amount
    after a Total left out."""
    rows = typed_lines(dated(docs, GRID_DATE), GRID_LINES)
    amounts = without_next(rows, BY, ORDER, "kind", "total", "amount").withColumn("amount", number(_part(F.col("line"), GRID_LINES["amount"]))).where("amount is not null")
    labels = rows.where("kind = 'label'").withColumn("portfolio", F.concat(F.lit("Portfolio "), _part(F.col("line"), GRID_LINES["label"])))
    return nth_with_nth(labels, amounts.select("source_id", "pos", "amount"), BY, ORDER)


def paired_layout(docs: DataFrame) -> DataFrame:
    """After 'Portfolio Number': a number line and an amount line in turn, to the total or
    the update line; the date is the month's end."""
    begin = F.sum(F.when(F.col("line").contains(PAIRED_WORDINGS[0]), 1).otherwise(0)).over(Window.partitionBy(*BY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    rows = lines_of(dated(docs, PAIRED_DATE)).withColumn("begun", begin).where("begun > 0")
    low = F.lower("line")
    found = pairs_in_runs(rows, BY, ORDER, "line", F.col("line").rlike(r"^\d+$"), F.col("line").rlike(r"^[\d,.]+$"), low.startswith("total") | low.contains("last updated"))
    found = found.withColumns({"portfolio": F.concat(F.lit("Portfolio "), "label"), "amount": number(F.col("line"))}).where("amount is not null")
    return found.withColumn("as_on", F.last_day("as_on"))


def agent_layout(docs: DataFrame) -> DataFrame:
    """'Portfolio n [amount] Yes|No'; an amount line alone belongs to the next portfolio
    without one.  Only guaranteed (Yes) rows count; l reads 1; the label stands as lender.

    A portfolio line ends a segment in which the last amount alone is spare."""
    w = Window.partitionBy(*BY).orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line, p = F.col("line"), AGENT_LINES["portfolio"]
    rows = typed_lines(dated(docs, AGENT_DATE), AGENT_LINES).withColumn("above", F.lag("line").over(w)).where("kind is not null")
    alone = (F.col("kind") == "alone") & ~F.coalesce(F.col("above"), F.lit("")).contains("Total") & (F.length(F.regexp_replace("line", r"\D", "")) >= 6)
    rows = rows.withColumn("seg", F.coalesce(F.sum(F.when(F.col("kind") == "portfolio", 1).otherwise(0)).over(before), F.lit(0)))
    spare = F.last(F.when(alone, line), ignorenulls=True).over(Window.partitionBy(*BY, "seg").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    merged = F.col("kind") == "merged"
    given = F.when(merged, _part(line, AGENT_LINES["merged"])).otherwise(F.coalesce(F.nullif(F.trim(_part(line, p, 2)), F.lit("")), spare))
    rows = rows.withColumn("amount", number(given)).where("kind <> 'alone'")
    sure = merged | ((F.lower(_part(line, p, 3)) == "yes") & (F.col("amount") <= LARGEST))
    rows = rows.where(F.col("amount").isNotNull() & F.coalesce(sure, F.lit(False)))
    label = F.when(merged, F.row_number().over(w).cast("string")).otherwise(F.translate(_part(line, p), "lL", "11"))
    return rows.withColumn("lender", F.concat(F.lit("Portfolio "), label))


def pattern_layout(docs: DataFrame) -> DataFrame:
    """Patterns of the source: a lender line sets the lender; a row needs both a portfolio
    and an amount."""
    found = lambda text, pattern: F.call_function("regexp_extract", text, pattern, F.lit(1))
    fits = lambda pattern: F.call_function("rlike", F.col("line"), pattern)
    own = F.col("spec.lines")
    day = F.coalesce(parse_date(found(F.coalesce("text", F.lit("")), own["as_on"])), parse_date(own["day"]))
    per = docs.where("spec.lines.lender is not null and spec.lines.portfolio is not null and spec.lines.amount is not null").withColumns({"as_on": day, "own": own})
    rows = lines_of(per)
    named = F.when(fits(F.col("own.lender")), F.trim(found(F.col("line"), F.col("own.lender"))))
    rows = rows.withColumns({"is_lender": named.isNotNull(), "lender": _last(named, BY)}).where("not is_lender")
    rows = rows.where(fits(F.col("own.portfolio")) & fits(F.col("own.amount")))
    return rows.withColumns({"portfolio": F.trim(found(F.col("line"), F.col("own.portfolio"))), "amount": number(found(F.col("line"), F.col("own.amount")))}).where("amount is not null")


def dealt(docs: DataFrame, chars: int) -> DataFrame:
    """Documents of so many characters in all, dealt by source over as many tasks as keep
    to ``TASK_CHARS``: their texts travel, once, instead of their lines, and a task holds
    the lines of as many whatever there is (but of one source at least)."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), *BY)


LAYOUTS = {"agent": agent_layout, "paired": paired_layout, "grid": grid_layout, "pattern": pattern_layout, "app": app_layout}


def text_rows(docs: DataFrame) -> DataFrame:
    """Rows (``ROW``) of documents (source_id, lsp_name, text, rules_json), each by its
    layout, numbered in the order of their lines.

    A source of the pattern layout whose rules are broken is one row with ``error``, and
    hurts no other source.
    """
    known = docs.select("source_id", "lsp_name", "text", "rules_json", *(["spec"] if "spec" in docs.columns else []))
    known = stored((known if "spec" in docs.columns else with_specs(known)).withColumn("layout", layout_of()), "layouts")
    bad = (F.col("layout") == "pattern") & F.col("spec.error").isNotNull()
    kinds = dict(source_id="long", pos="int", amount="double", as_on="date")
    there = {r["layout"]: r["chars"] or 0 for r in known.groupBy("layout").agg(F.sum(F.length("text")).alias("chars")).collect()}  # of five; only these are planned
    parts = []
    for name, parse in LAYOUTS.items():
        if name not in there and (there or name != "app"):
            continue
        own = dealt(known.where(~bad & (F.col("layout") == name)), there.get(name, 0))
        found = parse(own).withColumns({"layout": F.lit(name), "error": F.lit(None)})
        parts.append(found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ["pos", *(c for c in ROW if c != "row_pos")]]))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("pos")) - 1
    rows = reduce(DataFrame.unionByName, parts).withColumn("row_pos", place).select(*ROW)
    return rows.unionByName(known.where(bad).select("source_id", "lsp_name", F.col("spec.error").alias("error")), allowMissingColumns=True)
