"""Mutations as functions (target, changes) -> new target.

Parquet has no MERGE; ``sources.tables.swap`` writes the new target beside the
old one and moves the pointer, so a table is never overwritten while read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.amounts import coerce, recover
from disclosa.functions.dates import parse_date
from disclosa.functions.status import manual_status
from disclosa.functions.text import normalise

from disclosa.shared import stored

from .joins import duplicate_sources, null_safe_anti
from .windows import keep_first


def insert_sources(master: DataFrame, new: DataFrame) -> DataFrame:
    """Sources that do not exist yet are added, hints auto and active by default.

    As if they came one by one in the order of their ids: one that shares a name,
    brand (crosswise too) or home page with an accepted one of the same kind is
    refused.  A round accepts those that come first in all they share.
    """
    unknown = new.join(duplicate_sources(new, master).select("id"), "id", "left_anti")
    sign = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    signs = F.array_compact(F.array_distinct(F.array(sign("name ", "name"), sign("name ", "brand_name"), sign("page ", "home_url"))))
    unknown = stored(unknown.select("id", "lsp_type", signs.alias("signs")), "unknown")
    left, accepted = unknown.select("id", "lsp_type", F.explode("signs").alias("sign")), unknown.where(F.size("signs") == 0).select("id")
    while not left.isEmpty():
        first = left.groupBy("lsp_type", "sign").agg(F.min("id").alias("first"))
        own = left.join(first, ["lsp_type", "sign"]).groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("ok")).where("ok").select("id")
        own = stored(own, "accepted")
        accepted = accepted.unionByName(own)
        taken = left.join(own, "id").select("lsp_type", "sign").distinct()
        refused = left.join(taken, ["lsp_type", "sign"], "left_semi").select("id").distinct()
        left = stored(left.join(refused, "id", "left_anti"), "signs")
    fresh = new.join(accepted, "id", "left_semi")
    filled = fresh.withColumns({"parse_hint": F.coalesce("parse_hint", F.lit("auto")), "fetch_hint": F.coalesce("fetch_hint", F.lit("auto")), "active": F.coalesce("active", F.lit(True))})
    return master.unionByName(filled.select(*master.columns))


def one_change(changes: DataFrame, key: str) -> DataFrame:
    """Of repeated keys one change: the greatest in its columns, in their order."""
    cols = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max(F.struct(*cols)).alias("c")).select(key, *(F.col("c")[c].alias(c) for c in cols)) if cols else changes.distinct()


def update_sources(master: DataFrame, changes: DataFrame, raw: DataFrame) -> DataFrame:
    """Given values win; home_url only where nothing was scraped yet; active is
    taken as it is given; of several changes of a source ``one_change``."""
    changes = one_change(changes, "id")
    scraped = raw.select(F.col("lsp_id").alias("id"), F.lit(True).alias("scraped")).distinct()
    cols = [c for c in master.columns if c != "id"]
    given = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in cols if c in changes.columns), F.lit(True).alias("changed"))
    rows = master.join(given, "id", "left").join(scraped, "id", "left")

    def value(c: str) -> Column:
        if f"new_{c}" not in given.columns:
            return F.col(c)
        new, old = F.col(f"new_{c}"), F.col(c)
        if c == "active":
            return F.when(F.col("changed"), new).otherwise(old).alias(c)
        if c == "home_url":
            return F.when(F.coalesce(F.col("scraped"), F.lit(False)), old).otherwise(F.coalesce(new, old)).alias(c)
        return F.coalesce(new, old).alias(c)

    return rows.select("id", *map(value, cols)).select(*master.columns)


def deactivate(master: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return master.join(gone, "id", "left").withColumn("active", F.when(F.coalesce("gone", F.lit(False)), False).otherwise(F.col("active"))).drop("gone")


def partial_update(target: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Values given in ``changes`` win, nulls leave what is there; of several changes
    of a row ``one_change``."""
    changes = one_change(changes, key)
    cols = [c for c in changes.columns if c != key]
    given = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in cols))
    rows = target.join(given, key, "left")
    return rows.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns))


def insert_raw(raw: DataFrame, new: DataFrame) -> DataFrame:
    """Manual rows unless they exist (five keys, nulls equal), with their status; of
    equal ones in the batch the earliest."""
    keys = ["lsp_id", "lender", "portfolio", "amount", "as_on_timestamp"]
    fresh = keep_first(null_safe_anti(new, raw, keys), keys, [F.col("scrape_timestamp")])
    status = manual_status(F.col("portfolio"), F.col("amount"), F.col("as_on_timestamp"), F.col("scrape_timestamp"))
    return raw.unionByName(fresh.withColumn("complete", status), allowMissingColumns=True)


def delete_rows(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def cleanse(rows: DataFrame) -> DataFrame:
    """Crawled rows as they are stored: texts stripped, amounts coerced, an amount
    in the wrong column put back, the as-on text parsed."""
    amount = coerce(F.col("amount_text"), F.col("amount")) if "amount_text" in rows.columns else F.col("amount")
    lender, portfolio, amount = recover(normalise(F.col("lender")), normalise(F.col("portfolio")), amount)
    out = rows.withColumns({"lender": lender, "portfolio": portfolio, "amount": amount})
    if "as_on_text" in rows.columns:
        out = out.withColumn("as_on_timestamp", F.coalesce(F.col("as_on_timestamp"), parse_date(F.col("as_on_text")).cast("timestamp_ntz")))
    return out.drop("amount_text", "as_on_text")


def fresh_raw(raw: DataFrame, crawled: DataFrame) -> DataFrame:
    """Cleansed rows whose cleansed keys are not stored in their scrape month.
    Equal rows within the batch stay, for the normaliser has removed them."""
    month = {"y": F.year("scrape_timestamp"), "m": F.month("scrape_timestamp")}
    keys = ["lsp_id", "lender", "portfolio", "amount", "as_on_timestamp", "y", "m"]
    return null_safe_anti(cleanse(crawled).withColumns(month), cleanse(raw).withColumns(month), keys).drop("y", "m")


def same_months(raw: DataFrame, crawled: DataFrame) -> DataFrame:
    """Stored rows from the first to the last scrape month of the crawled ones, as a
    range that reaches the scan, and those without a time if there are such."""
    ts = F.col("scrape_timestamp")
    at = crawled.agg(F.min(F.trunc(ts.cast("date"), "month")).alias("lo"), F.max(F.add_months(F.trunc(ts.cast("date"), "month"), 1)).alias("hi"), F.count_if(ts.isNull()).alias("nulls")).first()
    inside = F.lit(False) if at["lo"] is None else (ts >= F.lit(at["lo"]).cast("timestamp_ntz")) & (ts < F.lit(at["hi"]).cast("timestamp_ntz"))
    return raw.where(inside | ts.isNull() if at["nulls"] else inside)


def append_raw(raw: DataFrame, crawled: DataFrame) -> DataFrame:
    """Stored rows and the crawled ones that are not among them (``fresh_raw``)."""
    return raw.unionByName(fresh_raw(raw, crawled), allowMissingColumns=True)


def replace_stale(raw: DataFrame, crawled: DataFrame, order: list) -> DataFrame:
    """Stale rows of the crawled sources in the scrape month go; then the crawled
    rows are added, but for sources whose first row has an as-on date of the
    scrape month itself."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    touched = crawled.select("lsp_id", month("scrape_timestamp").alias("m")).distinct()
    left = raw.withColumn("m", month("scrape_timestamp"))
    kept = left.where("complete is null or complete <> 'Stale'").unionByName(left.where("complete = 'Stale'").join(touched, ["lsp_id", "m"], "left_anti").select(*left.columns)).drop("m")
    first = keep_first(crawled, ["lsp_id"], order)
    none = first.where(month("as_on_timestamp") == month("scrape_timestamp")).select("lsp_id")
    return kept.unionByName(crawled.join(none, "lsp_id", "left_anti").select(*crawled.columns), allowMissingColumns=True)


def placeholder(sources: DataFrame, status: str | Column, scraped: Column) -> DataFrame:
    """A row without measures that tells how a source's crawl failed."""
    null = lambda t: F.lit(None).cast(t)
    return sources.select(
        F.col("id").alias("lsp_id"), F.col("name").alias("lsp_name"), null("string").alias("lender"), null("string").alias("portfolio"),
        null("double").alias("amount"), null("timestamp_ntz").alias("as_on_timestamp"), scraped.alias("scrape_timestamp"),
        (F.lit(status) if isinstance(status, str) else status).alias("complete"), F.coalesce(F.nullif(F.trim("dlg_url"), F.lit("")), F.lit("NA")).alias("dlg_url"),
    )


def upsert_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their source and month; surplus old ones go first."""
    keys = ["lsp_id", "scrape_year", "scrape_month"]
    order = ["id"] if "id" in old.columns else keys
    single = keep_first(old, keys, [F.col(c) for c in order])
    return null_safe_anti(single, new, keys).select(*new.columns).unionByName(new)


def create_users(users: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``users`` and those of ``new`` (id, username, role, firstname, lastname) whose
    username and role are not there yet, of equal ones that of least id; they are
    active and must set a password."""
    once = keep_first(new, ["username", "role"], [F.col("id")])
    made = once.join(users.select("username", "role"), ["username", "role"], "left_anti")
    made = made.withColumns({"active": F.lit(True), "reset_password": F.lit(True), "create_date": now, "modify_date": now})
    return users.unionByName(made.select(*[c for c in users.columns if c in made.columns]), allowMissingColumns=True)


def last_logins(users: DataFrame, logins: DataFrame) -> DataFrame:
    """``users`` with the latest of their ``logins`` (id, at) as last_login."""
    last = logins.groupBy("id").agg(F.max("at").alias("at"))
    return users.join(last, "id", "left").withColumn("last_login", F.greatest("last_login", "at")).drop("at")


def audit_record(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows whose payload holds the user's name and role beside what was given."""
    u = users.select(F.col("username").alias("user_id"), "role", "firstname", "lastname")
    extra = F.to_json(F.struct("details", F.struct(F.col("user_id").alias("username"), "role", "firstname", "lastname").alias("user")))
    return actions.join(u, "user_id", "left").withColumn("payload", extra).drop("role", "firstname", "lastname", "details")


def decoded_payload(payload: Column) -> Column:
    """JSON objects as they are; anything else as {"raw": ...}."""
    ok = F.try_parse_json(payload).isNotNull() & F.trim(payload).rlike(r"^\{")
    return F.when(payload.isNull(), None).when(ok, payload).otherwise(F.to_json(F.struct(payload.alias("raw"))))
