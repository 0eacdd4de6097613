"""Per-source rules as data.

The rules of a source are read once into a record of plain values (``SPEC``), and one
generic expression interprets the record of a row over its headers and cells, so a plan
is as large for ten thousand sources as for one.  A broken pattern marks its own source
when its record is made and does not stop the job.

A row has ``headers`` (array, in order) and ``vals`` (array beside it).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclosa.functions.dates import parse_date, parse_date_by
from disclosa.functions.text import normalise, once, strip
from disclosa.shared import stored

#: Keys sought where a rule names none.
DEFAULTS = {
    "lender": ["Lender", "Lending Partner", "Partner", "NBFC", "Bank"],
    "portfolio": ["Portfolio", "DLG set", "Cohort", "Set", "Portfolio Name"],
    "amount": ["Amount", "Outstanding AUM", "AUM", "Outstanding", "DLG Amount", "Outstanding AUM (₹ crores)", "Outstanding AUM (INR crore)"],
    "as_on": ["ason", "As on", "As-on", "AsOn", "As on date", "Date", "AsOnTimestamp"],
}
#: Names that rules give to the columns to fill.
FILLS = {"lender": "lender", "portfolio": "portfolio", "amount": "amount", "asontimestamp": "as_on", "as_on": "as_on", "ason": "as_on"}
FIELDS = tuple(DEFAULTS)

#: How a field is found: a constant; else the first filled cell under a header that fits
#: ``header``; else the cell of the first key, of which ``regex`` may take a group.
_FIELD = "struct<constant:string,header:string,keys:array<string>,regex:string,grp:int,must:boolean>"
#: Where a date may stand in a header: of this name, that fits this, or has one of these.
_DATED = "struct<name:string,header:string,keys:array<string>,regex:string,grp:int,form:string>"
_PAGE = "struct<regex:string,grp:int,nth:int,constant:string>"
_TEST = "struct<col:string,value:string,regex:string,ignore_case:boolean>"
#: The record of a source's rules.
SPEC = (
    f"struct<error:string,{','.join(f'{f}:{_FIELD}' for f in FIELDS)},dated:{_DATED},page_lender:{_PAGE},page_as_on:{_PAGE},"
    f"lines:struct<lender:string,portfolio:string,amount:string,as_on:string,day:string>,keep:{_TEST},drop:{_TEST},fill:array<string>,table_index:int,skip_captions:boolean,ocr:struct<unit:string,quarterly:boolean,error:string>>"
)


def load_rules(text: str | None) -> dict:
    """A source's rules; text that is no JSON object is none."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


class BadRule(ValueError):
    """A rule that cannot be used."""


def java_pattern(pattern: str) -> str:
    """The pattern for the JVM; BadRule if it is no pattern there."""
    try:
        re.compile(pattern)
    except re.error as why:
        raise BadRule(f"{pattern!r}: {why}") from why
    if re.search(r"(?<!\\)\(\?\(", pattern):
        raise BadRule(f"{pattern!r}: conditions are not supported")
    named = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
    return re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", named).replace(r"\Z", r"\z")


def _grouped(pattern: str, group) -> dict:
    """The pattern, across line ends, and the group to take; without such a group it
    finds nothing."""
    own = java_pattern(pattern)
    there = 0 <= int(group) <= re.compile(pattern).groups
    return {"regex": f"(?is){own}" if there else "(?!)", "grp": int(group) if there else 0}


def _field(spec, name: str) -> dict:
    """``_FIELD`` of one field of a rule's map."""
    out = dict.fromkeys(("constant", "header", "keys", "regex", "grp"), None) | {"must": name == "amount"}
    if isinstance(spec, str):
        return out | {"keys": [spec]}
    spec = spec if isinstance(spec, dict) else {}
    if spec.get("constant") is not None:
        return out | {"constant": str(spec["constant"]).strip()}
    if spec.get("regex") and "keys" not in spec and name != "as_on":
        return out | {"header": "(?i)" + java_pattern(spec["regex"])}
    out["keys"] = [str(k) for k in spec.get("keys") or DEFAULTS[name]]
    if spec.get("regex") and name != "as_on":
        out |= _grouped(spec["regex"], spec.get("group", 1))
    return out


def _dated(fields: dict) -> dict | None:
    """``_DATED`` where the date is to be read from the amount's or portfolio's header."""
    spec = fields.get("as_on")
    if not isinstance(spec, dict) or spec.get("constant") is not None or not spec.get("extract_regex"):
        return None
    name = {"amount_column": "amount", "portfolio_column": "portfolio"}.get(spec.get("extract_from", "amount_column"))
    of = fields.get(name)
    out = dict.fromkeys(("name", "header", "keys"), None) | _grouped(spec["extract_regex"], 1) | {"form": spec.get("date_format")}
    if isinstance(of, str):
        return out | {"name": of}
    if not isinstance(of, dict):
        return None
    if of.get("regex") and "keys" not in of:
        return out | {"header": "(?i)" + java_pattern(of["regex"])}
    return out | {"keys": [str(k) for k in of.get("keys") or DEFAULTS[name]]}


def _page(rules: dict, name: str) -> dict:
    page = rules.get("page_level") if isinstance(rules.get("page_level"), dict) else {}
    pattern, constant = page.get(f"{name}_regex"), page.get(f"{name}_constant")
    nth = rules.get("table_index") if name == "as_on" else None
    taken = _grouped(pattern, page.get(f"{name}_group", 1)) if pattern else {"regex": None, "grp": None}
    return taken | {"nth": None if nth is None else int(nth), "constant": None if constant is None else str(constant)}


def _test(rule) -> dict | None:
    if not isinstance(rule, dict) or rule.get("column") is None:
        return None
    fold = bool(rule.get("case_insensitive", True))
    value, pattern = rule.get("value"), rule.get("regex")
    value = None if value is None else str(value).strip().lower() if fold else str(value).strip()
    return {"col": str(rule["column"]), "value": value, "regex": ("(?i)" if fold else "") + java_pattern(pattern) if pattern else None, "ignore_case": fold}


def _lines(fields: dict) -> dict:
    """Patterns for lines of text, and a constant day."""
    specs = {f: fields[f] if isinstance(fields.get(f), dict) else {} for f in FIELDS}
    # a pattern without a group takes the whole match
    taken = lambda p: p if re.compile(p).groups else f"({p})"
    day = specs["as_on"].get("constant")
    return {f: "(?i)" + java_pattern(taken(x["regex"])) if x.get("regex") and java_pattern(x["regex"]) else None for f, x in specs.items()} | {"day": None if day is None else str(day)}


def _ocr(rules: dict) -> dict:
    own = rules.get("ocr") if isinstance(rules.get("ocr"), dict) else {}
    own = own["simple"] if isinstance(own.get("simple"), dict) else own
    error = None if own else "Missing 'ocr' configuration for parse_hint=ocr_simple"
    if own and str(own.get("method") or "simple").lower() != "simple":
        error = f"Unsupported OCR method '{own['method']}'"
    as_on = (rules.get("field_map") or {}).get("as_on")
    return {"unit": str(own.get("amount_unit") or "rupees").lower(), "quarterly": isinstance(as_on, dict) and as_on.get("fallback") == "previous_quarter_end", "error": error}


def spec_of(rules_json: str | None) -> dict:
    """The record (``SPEC``) of a source's rules; text that is no JSON object is no rules."""
    rules = load_rules(rules_json)
    empty = dict.fromkeys(("error", *FIELDS, "dated", "page_lender", "page_as_on", "lines", "keep", "drop", "fill", "table_index", "skip_captions", "ocr"))
    try:
        fields = rules.get("field_map") if isinstance(rules.get("field_map"), dict) else {}
        index = rules.get("table_index")
        fill = [FILLS[k] for c in rules.get("forward_fill") or [] if (k := re.sub(r"[\s_]+", "", str(c).lower())) in FILLS]
        found = {f: _field(fields.get(f), f) for f in FIELDS} | {"dated": _dated(fields), "page_lender": _page(rules, "lender"), "page_as_on": _page(rules, "as_on")}
        found |= {"lines": _lines(fields), "keep": _test(rules.get("row_filter")), "drop": _test(rules.get("row_exclude")), "fill": fill, "ocr": _ocr(rules)}
        return empty | found | {"table_index": None if index is None else int(index), "skip_captions": bool(rules.get("skip_th_captions"))}
    except (ValueError, TypeError, AttributeError, KeyError, re.error) as why:  # BadRule is a ValueError
        return empty | {"error": str(why), "skip_captions": False}


def with_specs(sources: DataFrame, rules: str = "rules_json", spec: str = "spec") -> DataFrame:
    """``sources`` with the record of their rules: a Python worker reads each source's
    rules once, rows of pages never."""

    @F.pandas_udf(SPEC)
    def read(texts: pd.Series) -> pd.DataFrame:
        known = {t: spec_of(t) for t in texts.unique()}
        return pd.DataFrame([known[t] for t in texts], columns=[*empty])

    empty = spec_of(None)
    return sources.withColumn(spec, read(F.col(rules)))


# ---------------------------------------------------------------- the interpreter


def _plain(x: Column) -> Column:
    """Headers and keys are compared in small letters, rupee signs as '?'."""
    return F.translate(F.lower(x), "₹₨", "??")


def filled_cells() -> Column:
    """The filled cells of a row: header, value without blanks, header as keys see it."""
    cells = F.arrays_zip(F.col("headers").alias("h"), F.col("vals").alias("v"))
    known = F.transform(cells, lambda c: F.struct(c["h"].alias("h"), strip(F.coalesce(c["v"], F.lit(""))).alias("v"), _plain(c["h"]).alias("p")))
    return F.filter(known, lambda c: c["v"] != "")


def _first(cells: Column) -> Column:
    return F.get(cells, 0)["v"]


def _has(pattern: Column, text: Column) -> Column:
    return F.call_function("rlike", text, pattern)


def _taken(text: Column, pattern: Column, group: Column) -> Column:
    """The group of the first match, rupee signs of the text as '?'; null without one."""
    plain = F.translate(text, "₹₨", "??")
    return F.when(_has(pattern, plain), strip(F.call_function("regexp_extract", plain, pattern, group)))


def pick(keys: list[str] | Column, full: Column | None = None) -> Column:
    """The first filled cell: by exact header in the order of the keys, then by a
    header that contains a key, rupee signs reading as '?', ignoring case."""
    wanted = keys if isinstance(keys, Column) else F.array(*map(F.lit, keys))
    full = filled_cells() if full is None else full
    exact = F.filter(F.transform(wanted, lambda k: _first(F.filter(full, lambda c: c["h"] == k))), lambda x: x.isNotNull())
    some = once(F.transform(wanted, _plain), lambda plain: _first(F.filter(full, lambda c: F.exists(plain, lambda k: F.contains(c["p"], k)))))
    return F.coalesce(F.get(exact, 0), some)


def field(spec: Column, name: str, full: Column, dated: Column) -> Column:
    """lender, portfolio, amount or as_on of a row as text, by the record of its rules;
    ``dated`` is what a header says of the date (no second reading day first)."""
    own = spec[name]
    if name == "as_on":
        day = F.date_format(parse_date_by(dated, spec["dated"]["form"]), "yyyy-MM-dd")
        return F.coalesce(own["constant"], day, pick(own["keys"], full))
    by_header = _first(F.filter(full, lambda c: _has(own["header"], c["h"])))

    def taken(value):
        part = F.nullif(_taken(value, own["regex"], own["grp"]), F.lit(""))
        return F.when(own["regex"].isNull(), value).when(own["must"], part).otherwise(F.coalesce(part, value))

    found = once(pick(own["keys"], full), taken)
    return F.when(own["constant"].isNotNull(), own["constant"]).when(own["header"].isNotNull(), by_header).otherwise(found)


def _header_text(dated: Column) -> Column:
    """The text of the date in a header."""
    fits = F.filter("headers", lambda h: _has(dated["header"], h))
    holds = F.filter("headers", lambda h: F.exists(dated["keys"], lambda k: F.contains(F.lower(h), F.lower(k))))
    header = F.coalesce(dated["name"], F.get(fits, 0), F.get(holds, 0))
    return _taken(header, dated["regex"], dated["grp"])


def page_value(page: Column, text: Column) -> Column:
    """A value that holds for a whole page: by pattern (its nth match, if a number is
    given), else the constant."""
    every = F.call_function("regexp_extract_all", text, page["regex"], page["grp"])
    found = F.when(page["nth"].isNotNull(), strip(F.get(every, page["nth"]))).otherwise(_taken(text, page["regex"], page["grp"]))
    return F.coalesce(F.nullif(found, F.lit("")), page["constant"])


def row_stays(spec: Column, cells: Column) -> Column:
    """Whether a row passes its source's row_filter and row_exclude; a cell that is
    missing or null is ''."""
    at = lambda test: normalise(F.try_element_at(cells, test["col"]))
    same = lambda test: F.when(test["ignore_case"], F.lower(at(test))).otherwise(at(test)) == F.coalesce(test["value"], F.lit(""))
    keep, drop = spec["keep"], spec["drop"]
    gone = F.when(drop["regex"].isNotNull(), _has(drop["regex"], at(drop))).when(drop["value"].isNotNull(), same(drop))
    return F.coalesce(F.when(keep["col"].isNotNull(), same(keep)), F.lit(True)) & ~F.coalesce(F.when(drop["col"].isNotNull(), gone), F.lit(False))


NAMES = ("lender", "portfolio", "amount_text", "as_on_text", "error")


def interpreted(rows: DataFrame, text: str = "page_text", spec: str = "spec") -> DataFrame:
    """Adds lender, portfolio, amount_text, as_on_text and error (of the rules) by the
    record in each row."""
    s, own, page = F.col(spec), (F.col("full__"), F.col("dated__")), F.col(text) if text in rows.columns else F.lit(None).cast("string")
    good = lambda x: F.when(s["error"].isNull(), x).cast("string")
    # columns of their own, for they are used many times
    found = rows.withColumns({"full__": filled_cells(), "dated__": _header_text(s["dated"])}).withColumns({
        "lender": good(F.coalesce(field(s, "lender", *own), page_value(s["page_lender"], page))),
        "portfolio": good(field(s, "portfolio", *own)),
        "amount_text": good(field(s, "amount", *own)),
        "as_on_text": good(F.coalesce(field(s, "as_on", *own), page_value(s["page_as_on"], page))),
        "error": s["error"],
    })
    return found.drop("full__", "dated__")


def resolved_each(rows: DataFrame, text: str = "page_text") -> DataFrame:
    """``interpreted`` for rows that carry their rules as text in ``rules_json``: the
    distinct rules are read once and joined to the rows, null rules too.  They are stored,
    so that the planner knows how many there are: a few go to the rows, which otherwise
    would lie in as many tasks as there are rules."""
    known = stored(with_specs(rows.select(F.col("rules_json").alias("rules__")).distinct(), "rules__"), "rules")
    return interpreted(rows.join(known, F.col("rules_json").eqNullSafe(F.col("rules__"))).drop("rules__"), text).drop("spec")


def resolved(rows: DataFrame, rules_json: str | None, text: str = "page_text") -> DataFrame:
    """``interpreted`` by one source's rules."""
    known = with_specs(rows.sparkSession.createDataFrame([(rules_json,)], "rules__ string"), "rules__").select("spec")
    return interpreted(rows.crossJoin(F.broadcast(known)), text).drop("spec")
