"""Rules, normaliser, store and stream."""

import datetime as dt
import re

from pyspark.sql import functions as F

from disclosa.functions import dates
from disclosa.operators import links, mutations, normalise, summary, windows
from disclosa.sources import fetch, rules, tables

NOV = dt.date(2025, 11, 30)


def rows(spark, *vals, headers=("Portfolio", "Amount (₹ in lakhs) as on 05.12.2025", "Lender name")):
    return spark.createDataFrame([(1, i, list(headers), list(v)) for i, v in enumerate(vals)], "source_id int, row_pos int, headers array<string>, vals array<string>")


def test_rules_resolve_fields_and_header_dates(spark):
    spec = '{"field_map": {"portfolio": "Portfolio", "amount": {"regex": "^amount"}, "lender": {"keys": ["lender"]}, "as_on": {"extract_regex": "as on ([0-9.]+)", "date_format": "DD.MM.YYYY"}}}'
    got = normalise.typed(rules.resolved(rows(spark, ["P1", "250", "A"], ["-", "Rs. 1,00", "None"]), spec)).collect()
    assert [(r.portfolio, r.amount, r.lender, r.as_on) for r in got] == [("P1", 2.5, "A", dt.date(2025, 12, 5)), (None, 1.0, None, dt.date(2025, 12, 5))]


def test_a_broken_pattern_marks_its_rows(spark):
    got = rules.resolved(rows(spark, ["P1", "2", "A"]), '{"field_map": {"amount": {"regex": "(("}}}').first()
    assert got.error and got.amount_text is None
    assert rules.resolved(rows(spark, ["P1", "2", "A"]), "{broken").first().portfolio == "P1"


def test_page_values_take_the_nth_match(spark):
    df = spark.createDataFrame([("as on 1 Jan 2025 x as on 2 Feb 2025",)], "page_text string")
    rule = '{"table_index": 1, "page_level": {"as_on_regex": "as on (\\\\d+ \\\\w+ \\\\d+)", "lender_constant": "L"}}'
    known = rules.with_specs(df.withColumn("rules_json", F.lit(rule)))
    v = {k: rules.page_value(F.col(f"spec.page_{k}"), F.col("page_text")) for k in ("as_on", "lender")}
    assert tuple(known.select(v["as_on"].alias("a"), v["lender"].alias("b")).first()) == ("2 Feb 2025", "L")


def base(spark, data):
    return spark.createDataFrame([(1, i, "Acme", *r) for i, r in enumerate(data)], "source_id int, row_pos int, lsp_name string, lender string, portfolio string, amount double, as_on date").withColumn("scrape_ts", F.lit(dt.datetime(2025, 12, 10)).cast("timestamp_ntz"))


def test_cleaning_and_status(spark):
    raw = base(spark, [("A", "P1", 1.0, NOV), ("A", "P1", 1.0, NOV), (None, "P2", 2.0, NOV), ("Lender", "x", 9.0, NOV), ("B", "Grand total", 3.0, NOV), (None, None, 5.0, NOV), ("C", "P3", 3.0, NOV)])
    out = normalise.cleaned(raw, ["lender"]).orderBy("row_pos").collect()
    assert [(r.lender, r.portfolio, r.amount) for r in out] == [("A", "P1", 1.0), ("A", "P2", 2.0)]  # 3.0 is their sum
    src = spark.createDataFrame([(1, None), (2, None), (3, "boom")], "source_id int, error string")
    got = {r.source_id: r.status for r in normalise.statuses(src, normalise.cleaned(raw, ["lender"])).collect()}
    assert got == {1: "Completed", 2: "NoData", 3: "Error"}


def test_sums_are_sought_among_rows_of_a_name(spark):
    raw = base(spark, [("A", "P1", 1.0, NOV), ("A", "P2", 2.0, NOV), ("A", "P3", 3.0, NOV)])
    got = lambda name: sorted(r.amount for r in normalise.cleaned(raw.withColumn("lsp_name", F.lit(name).cast("string"))).collect())
    assert got("Acme") == [1.0, 2.0] and got(None) == got("") == [1.0, 2.0, 3.0]


def test_crawls_keep_rows_that_are_the_sum_of_the_others(spark, tmp_path):
    from disclosa.plans.catalogue import QUERIES

    day = dt.datetime(1996, 1, 1)
    orders = [(k, 8, "O", p, day, "x") for k, p in ((1, 10000.0), (3, 20000.0), (4, 30000.0))]  # the last the sum of the others
    orders += [(100_000 + k, 11, "O", 7.0, day, "x") for k in (1, 2, 3, 4, 5)] + [(100_000 + 15 + 4001, 11, "O", 7.0, day, "x")]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, kind).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["e18_recognised_rows"](spark, str(tmp_path)).where("source_id = 8").count() == 3
    assert QUERIES["e18_own_rules"](spark, str(tmp_path)).where("source_id = 11").count() == 6


def test_the_first_offence_decides(spark):
    raw = base(spark, [("A", "P1", 1.0, None), ("A", None, 1.0, NOV)])
    src = spark.createDataFrame([(1,)], "source_id int")
    assert normalise.statuses(src, raw).first().status == "Stale"


def test_windows_in_january_and_period_ends(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 31),)], "t timestamp_ntz")
    got = df.select(dates.month_window(F.col("t")), dates.previous_month_end(F.col("t")), dates.previous_quarter_end(F.col("t")), dates.subtract_months(F.col("t"), 2)).first()
    assert tuple(got[0]) == (2024, 12) and got[1:] == (dt.date(2024, 12, 31), dt.date(2024, 12, 31), dt.date(2024, 11, 1))


def test_sum_rows_by_the_closed_form(spark):
    mk = lambda xs: {r.i for r in windows.sum_rows(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i int, amount double"), ["g"]).where("is_sum").collect()}
    assert mk([1.0, 2.0, 3.05]) == {2} and mk([1.0, 2.0, 3.06]) == set() and mk([1.0, 1.0]) == set()


def raw_rows(spark, rows):
    """(id, lsp_id, lender, portfolio, amount, as_on, scraped, complete)"""
    return spark.createDataFrame([(i, s, "n", lender, p, a, on, at, c, "u") for i, s, lender, p, a, on, at, c in rows], tables.SCHEMAS["dlg_raw"])


JAN, FEB, MAR = (dt.datetime(2025, m, 5) for m in (1, 2, 3))


def test_batches_replace_themselves(spark, tmp_path):
    store = tables.MonthTables(spark, f"file://{tmp_path}/store")
    assert len(store.create_missing()) == 5 and store.create_missing() == []
    assert store.read("dlg_raw").count() == 0
    new = raw_rows(spark, [(1, 5, " A ", "P", 1.0, None, JAN, "Completed"), (2, 5, "A", "Q", 1.0, None, FEB, "Completed"), (3, 6, "A", "Q", 1.0, None, None, "Error")])
    for _ in range(2):
        store.append_crawled(new, "b1")  # a replay
    store.append_crawled(raw_rows(spark, [(9, 5, "A", "P", 1.0, None, JAN, "Completed"), (8, 5, "A", "R", 1.0, None, JAN, "Completed")]), "b2")
    assert sorted((r.lender, r.portfolio, r.id) for r in store.read("dlg_raw").collect()) == [("A", "P", 1), ("A", "Q", 2), ("A", "Q", 3), ("A", "R", 8)]
    months = {f.split("part=")[1].split("/")[0] for f in store.read("dlg_raw", ["2025-01"]).inputFiles()}
    assert months >= {"2025-01"} and store.read("dlg_raw", ["2025-01"]).count() == 2
    plan = store.read("dlg_raw", ["2025-01"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_two_writers_lose_nothing(spark, tmp_path):
    from threading import Thread

    store = tables.MonthTables(spark, f"file://{tmp_path}/store")
    store.create_missing()
    batch = lambda k: raw_rows(spark, [(k * 100 + i, k, "A", f"P{i}", 1.0, None, (JAN, FEB)[i % 2], "Completed") for i in range(10)])
    writers = [Thread(target=store.append, args=("dlg_raw", batch(k), f"b{k}")) for k in range(4)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert sorted(r.id for r in store.read("dlg_raw").collect()) == sorted(k * 100 + i for k in range(4) for i in range(10))


def test_stale_rows_are_replaced_in_their_months(spark, tmp_path):
    store = tables.MonthTables(spark, f"file://{tmp_path}/store")
    store.create_missing()
    old = [(1, 5, "A", "P", 1.0, None, JAN, "Stale"), (2, 5, "A", "Q", 1.0, None, JAN, "Completed"), (3, 6, "A", "P", 1.0, None, JAN, "Stale"), (4, 5, "A", "P", 1.0, None, FEB, "Stale")]
    store.append("dlg_raw", raw_rows(spark, old), "b1")
    store.append("dlg_raw", raw_rows(spark, [(5, 5, "A", "S", 1.0, None, JAN, "Stale")]), "b2")  # a batch of stale rows only
    new = raw_rows(spark, [(10, 5, "A", "P", 2.0, dt.datetime(2024, 12, 31), JAN, "Completed"), (11, 7, "A", "P", 2.0, JAN, JAN, "Completed")])
    for _ in range(2):
        store.replace_stale(new, "b3", ["id"])
        assert sorted(r.id for r in store.read("dlg_raw").collect()) == [2, 3, 4, 10]


def test_a_merge_touches_its_partitions_only(spark, tmp_path):
    import os

    store = tables.MonthTables(spark, f"file://{tmp_path}/store")
    store.create_missing()
    cols = "lsp_id int, scrape_year int, scrape_month int, status string"
    store.merge("lsp_summary", spark.createDataFrame([(1, 2025, 1, "a"), (2, 2025, 1, "b"), (1, 2025, 2, "c"), (None, None, 3, "n")], cols))
    files = lambda: {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{tmp_path}/store/lsp_summary/part=2025-02") for f in names}
    before = files()
    for _ in range(2):
        store.merge("lsp_summary", spark.createDataFrame([(1, 2025, 1, "x"), (3, 2025, 1, "y"), (None, None, 3, "m")], cols))
        got = sorted((r.lsp_id or 0, r.scrape_month, r.status) for r in store.read("lsp_summary").collect())
        assert got == [(0, 3, "m"), (1, 1, "x"), (1, 2, "c"), (2, 1, "b"), (3, 1, "y")] and files() == before


def test_the_stream_tells_months_and_closes_them(spark, tmp_path):
    from disclosa.streaming import summary as streaming

    schema = "row_id string, lsp_id int, lsp_name string, lender string, portfolio string, amount double, as_on_timestamp timestamp_ntz, scrape_timestamp timestamp_ntz, complete string, dlg_url string"
    row = lambda i, lender, p, at: (str(i), 5, "n", lender, p, 1.0, dt.datetime(2024, 12, 1), at, "Completed", "u")
    batches = [[row(2, None, "P2", dt.datetime(2025, 1, 9, 2)), row(0, "late", "P0", None)], [row(1, "A", "P1", dt.datetime(2025, 1, 9, 1))], [row(7, "B", "P", dt.datetime(2025, 6, 1))], [row(8, "B", "P", dt.datetime(2025, 6, 2))]]
    run = lambda: streaming.summarise_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/raw"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        run()
    got = {(r.scrape_month, r.total_lenders, r.total_portfolios, r.total_amount, r.status) for r in streaming.summary_of(spark, f"{tmp_path}/out").collect()}
    # the row that came first takes the lender of the one before it; June's window is May
    assert got == {(12, 1, 2, 2.0, "Completed"), (5, 1, 1, 2.0, "Stale")}
    told = spark.read.parquet(f"{tmp_path}/out").where("final").collect()
    assert [(r.scrape_month, r.n_rows) for r in told] == [(12, 2)]  # the watermark has passed January
    run()  # nothing new: nothing changes
    assert spark.read.parquet(f"{tmp_path}/out").where("final").count() == 1


def test_streams_keep_a_state_a_source_and_keep_it_on_disk(spark, tmp_path):
    from disclosa.streaming import summary as streaming

    schema = "row_id string, lsp_id int, lsp_name string, lender string, portfolio string, amount double, as_on_timestamp timestamp_ntz, scrape_timestamp timestamp_ntz, complete string, dlg_url string"
    rows = [(f"{i}", 5, "n", "A", "P", 1.0, None, dt.datetime(2025, m, 9), "Completed", "u") for i, m in enumerate((1, 2, 2))]
    spark.createDataFrame(rows + rows[:1], schema).write.parquet(f"{tmp_path}/raw")
    raw = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/raw")
    told, once = streaming.summarise_stream(raw(), f"{tmp_path}/told", f"{tmp_path}/c1"), streaming.append_stream(raw(), f"{tmp_path}/once", f"{tmp_path}/c2", ["row_id"])
    for query, n in ((told, 1), (once, 3)):
        query.awaitTermination()
        state = query.recentProgress[0]["stateOperators"][0]
        assert state["numRowsUpdated"] == n and any(k.startswith("rocksdb") for k in state["customMetrics"])
    assert spark.read.parquet(f"{tmp_path}/told").where("not final").count() == 2 and spark.read.parquet(f"{tmp_path}/once").count() == 3


def test_raw_rows_arrive_by_several_tasks(spark, sf):
    from disclosa.plans import catalogue, proxies

    t = proxies.Tables(spark, sf)
    first = next(catalogue.raw_streams(t, "arrivals"))
    assert first.isStreaming and set(first.columns) == set(t.raw.columns)


def test_months_of_many_sources_are_one_state(spark, tmp_path):
    from disclosa.streaming import summary as streaming

    schema = "row_id string, lsp_id long, lsp_name string, lender string, portfolio string, amount double, as_on_timestamp timestamp_ntz, scrape_timestamp timestamp_ntz, complete string, dlg_url string"
    at = dt.datetime(2025, 2, 9)
    rows = [("0", 1, "n", "A", "P", 1.0, None, at, "Completed", "u"), ("1", 2, None, None, None, None, None, at, None, None), ("2", 2, " ", "B", "P", 2.0, at, at, "Error", "u"), ("3", 3, None, None, None, None, None, at, "x", None), (None, None, None, None, None, 4.0, None, at, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/raw")
    query = streaming.summarise_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/raw"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] == 2  # sources 1 to 3, and rows without one
    got = {(r.lsp_id, r.name, r.total_lenders, r.total_portfolios, r.total_amount, r.dlg_url, r.as_on_month, r.status) for r in streaming.summary_of(spark, f"{tmp_path}/out").collect()}
    assert got == {(1, "n", 1, 1, 1.0, "u", None, "Stale"), (2, "LSP-2", 1, 1, 2.0, "u", 2, "Error"), (3, "LSP-3", 0, 0, 0.0, None, None, "Missing"), (None, None, 0, 0, 4.0, None, None, "Missing")}


def test_streams_delete_what_they_have_taken_in(spark, sf, tmp_path):
    import os
    import time

    from disclosa.plans import catalogue, proxies
    from disclosa.shared import shared_dir
    from disclosa.streaming import summary as streaming

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(".data" in files.getAllFiles().apply(k).getName() for k in range(files.getAllFiles().size()))
    had, there, name = shuffles(), [], f"taken-{tmp_path.name}"
    for raw in catalogue.raw_streams(proxies.Tables(spark, sf), name, again=True):
        streaming.append_stream(raw, f"{tmp_path}/out", f"{tmp_path}/check", ["row_id"]).awaitTermination()
        root = shared_dir(spark).removeprefix("file://")
        there += [sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root) if d.startswith(name)]
    assert there == [[f"{lo}{again}"] for lo in ("0000", "1996", "1997-06", "1999") for again in ("", "-again")]
    until = time.time() + 20
    while shuffles() > had and time.time() < until:
        time.sleep(0.5)
    assert shuffles() <= had
    assert not any(f.startswith("0") for f in os.listdir(tmp_path / "check" / "commits"))  # batches long past


def test_null_safe_joins_deal_the_target_once(spark):
    from disclosa.operators import joins

    nan, cols = float("nan"), "k long, x double, s string"
    rows = spark.createDataFrame([(1, 0.0, None), (2, None, "a"), (3, nan, "a"), (None, 0.1, "b"), (5, 1.0, "c"), (6, 2.0, None)], cols)
    target = spark.createDataFrame([(1, -0.0, None), (2, None, "a"), (3, nan, "a"), (None, 0.1, "b"), (None, 0.1, "b"), (5, 1.0, None)], cols)
    there = {1, 2, 3, None}
    assert {r.k for r in joins.null_safe_semi(rows, target, ["k", "x", "s"]).collect()} == there
    assert {r.k for r in joins.null_safe_anti(rows, target, ["k", "x", "s"]).collect()} == {5, 6}
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    big = [own.createDataFrame(df.collect(), cols) for df in (rows, target)]
    plan = joins.null_safe_anti(*big, ["k", "x", "s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one a side


def test_raw_rows_read_several_times_are_joined_once(spark, sf):
    from disclosa.plans import catalogue

    for name in ("c5_append", "c4_insert_raw", "j8_null_safe_semi", "j5_null_safe_anti"):
        read = catalogue.QUERIES[name](spark, sf).inputFiles()
        assert read and all("/raw-" in f for f in read), name


def test_failed_fetches_are_rows(spark):
    src = spark.createDataFrame([(1, "http://a"), (2, "http://b")], "source_id long, url string")

    def get(url):
        if url.endswith("b"):
            raise OSError("down")
        return 200, "application/pdf", b"%PDF-1"

    got = fetch.fetched(src, get).withColumn("pdf", fetch.starts_as_pdf(F.col("body"))).orderBy("source_id").collect()
    assert (got[0].status_code, got[0].pdf) == (200, True) and got[1].error == "down"


def test_links_crawl_and_fallbacks(spark):
    body = "x" * 50
    pages = spark.createDataFrame([
        ("https://a.example/", f'<a href="/about">About</a><a href="/x.png">i</a><footer><a href="legal/dlg-disclosure">DLG</a></footer>{body}'),
        ("https://a.example/about", "nothing"),
        ("https://a.example/legal/dlg-disclosure", "DLG portfolio of each lender"),
        ("https://a.example/dlg-disclosure", "default loss guarantee"),
    ], "url string, html string")
    found = links.links(pages)
    assert [r.link for r in links.followed(found).where("page_url = 'https://a.example/'").orderBy("kind").collect()] == ["https://a.example/legal/dlg-disclosure", "https://a.example/about"]
    start = spark.createDataFrame([(1, "https://a.example/")], "id int, url string")
    assert [r.url for r in links.crawl(start, pages).where("hit").collect()] == ["https://a.example/legal/dlg-disclosure"]
    homes = spark.createDataFrame([(1, "https://a.example/home")], "id int, home_url string")
    assert links.fast_path(homes, pages).first().url == "https://a.example/dlg-disclosure"
    xml = spark.createDataFrame([("o", "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>https://a/dlg</loc></url><url><loc>https://a/b</loc></url></urlset>")], "origin string, xml string")
    assert [r.loc for r in links.sitemap_hits(xml).collect()] == ["https://a/dlg"]
    assert len(links.PATHS) == len(set(links.PATHS)) == 35


def test_crawl_goes_as_deep_as_its_pages(spark):
    at = lambda k: f"https://a.example/{'legal/dlg-disclosure' if k == 9 else f'p{k}' if k else ''}"
    pages = spark.createDataFrame([(at(k), f'<a href="{at(k + 1)}">next</a> DLG portfolio of each lender') for k in range(10)], "url string, html string")
    start = spark.createDataFrame([(1, at(0))], "id int, url string")
    assert [(r.url, r.depth) for r in links.crawl(start, pages).where("hit").collect()] == [(at(9), 9)]
    assert links.crawl(start, pages, most=8).count() == 8


def test_upsert_twice_is_once(spark):
    new = spark.createDataFrame([(1, 2025, 1, "a"), (2, 2025, 1, "b")], "lsp_id int, scrape_year int, scrape_month int, status string")
    once = mutations.upsert_summary(new.limit(0), new)
    assert sorted(map(tuple, mutations.upsert_summary(once, new).collect())) == sorted(map(tuple, new.collect()))


def test_audit_record_merges_the_user(spark):
    act = spark.createDataFrame([("u1", "LOGIN", "{}")], "user_id string, action_taken string, details string")
    users = spark.createDataFrame([("u1", "admin", "F", None)], "username string, role string, firstname string, lastname string")
    assert '"role":"admin"' in mutations.audit_record(act, users).first().payload


def sources(spark, rows):
    full = [(i, n, b, "Bank", u, None, None, None, None) for i, n, b, u in rows]
    return spark.createDataFrame(full, "id int, name string, brand_name string, lsp_type string, home_url string, active boolean, dlg_url string, parse_hint string, fetch_hint string")


def test_sources_of_a_batch_come_one_by_one(spark):
    master = sources(spark, [(1, "A", None, "a"), (2, "B", "bee", "b")])
    new = sources(spark, [(10, "C", "cee", "c"), (11, "cee", "x", "d"), (12, "x", "y", "e"), (13, "y", "z", "c"), (14, "bee", None, None), (15, None, None, None), (16, "x", "w", "f")])
    got = {r.id for r in mutations.insert_sources(master, new).collect()}
    # 11 shares cee with 10; 12 is free, for 11 was refused; 13 shares y with 12; 14 is known; 16 shares x with 12
    assert got == {1, 2, 10, 12, 15}


def test_repeated_changes_give_one_row(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, amount double")
    changes = spark.createDataFrame([(1, "c", None), (1, "d", 5.0), (1, "d", 4.0), (3, "e", 1.0)], "id int, name string, amount double")
    assert sorted(tuple(r) for r in mutations.partial_update(target, changes).collect()) == [(1, "d", 5.0), (2, "b", 2.0)]
    master = sources(spark, [(1, "A", None, "a")])
    twice = spark.createDataFrame([(1, "X", True), (1, "Y", False)], "id int, name string, active boolean")
    raw = spark.createDataFrame([], "lsp_id int")
    assert [(r.name, r.active) for r in mutations.update_sources(master, twice, raw).collect()] == [("Y", False)]


def test_upsert_with_null_keys_does_not_pile_up(spark):
    old = spark.createDataFrame([(None, 2025, 1, "a"), (1, None, 1, "b"), (1, 2025, 1, "c")], "lsp_id int, scrape_year int, scrape_month int, status string")
    new = spark.createDataFrame([(None, 2025, 1, "x"), (1, None, 1, "y")], old.schema)
    got = mutations.upsert_summary(old, new)
    assert sorted(r.status for r in got.collect()) == ["c", "x", "y"] == sorted(r.status for r in mutations.upsert_summary(got, new).collect())


def test_fill_by_parts_equals_the_whole_fill(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([1, 2, None]), None if r.random() < 0.1 else dt.datetime(2025, r.randint(1, 4), r.randint(1, 28)), r.choice([None, "", " ", f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, ts timestamp_ntz, v string")
    for up in (True, False):
        order = [F.asc_nulls_first("ts") if up else F.desc_nulls_last("ts"), F.col("id")]
        part = F.asc_nulls_first("part__of") if up else F.desc_nulls_last("part__of")
        a = windows.forward_fill(df, ["v"], ["g"], order, "_f").select("id", "v_f")
        b = windows.forward_fill_parts(df, ["v"], ["g"], F.trunc(F.col("ts").cast("date"), "month"), order, part, "_f")
        assert b.columns == [*df.columns, "v_f"] and sorted(a.collect()) == sorted(b.select("id", "v_f").collect())


def test_rules_of_many_sources(spark):
    specs = [None, "{broken", '{"field_map": {"amount": "B"}}', '{"field_map": {"amount": {"regex": "(("}}}', '{"field_map": {"amount": {"constant": "7"}}}']
    df = spark.createDataFrame([(i, ["Amount", "B"], [str(i), "9"], s) for i, s in enumerate(specs * 2)], "source_id int, headers array<string>, vals array<string>, rules_json string")
    got = {r.source_id: (r.amount_text, r.error is None) for r in rules.resolved_each(df).collect()}
    assert got == {i: [(str(i), True), (str(i), True), ("9", True), (None, False), ("7", True)][i % 5] for i in range(10)}


def test_scrape_reports_and_empty_inputs(spark):
    from disclosa.sources import cells, scrape

    srcs = spark.createDataFrame([(1, "S", "https://x/a.pdf", "pdf_table", None), (2, "Finsall", "https://x/b", "plain_text", None), (3, "T", "https://x/c", "auto", None)], "source_id long, lsp_name string, dlg_url string, parse_hint string, rules_json string")
    pages = spark.createDataFrame([(1, "application/pdf", "", None), (2, "text/html", "<p>a total of 2 portfolios, amounting to INR 5 Cr</p>", None), (3, "text/html", "<p>nothing</p>", None)], "source_id long, content_type string, body string, error string").withColumn("scrape_ts", F.lit(dt.datetime(2025, 12, 10)).cast("timestamp_ntz"))
    docs = spark.createDataFrame([(1, [("as on 30 November 2025", [[["Lender", "Portfolio", "Amount"], ["A", "P1", "3"]]])])], "source_id long, pages array<struct<text: string, tables: array<array<array<string>>>>>")
    rows, found = scrape.scraped(srcs, pages, reports=cells.report_table_rows(docs))
    assert sorted((r.source_id, r.lender, r.portfolio, r.amount, r.as_on) for r in rows.collect()) == [(1, "A", "P1", 3.0, NOV), (2, None, "Grand Total (2 portfolios)", 5.0, None)]
    assert {r.source_id: r.status for r in found.collect()} == {1: "Completed", 2: "Stale", 3: "NoData"}
    rows, found = scrape.scraped(srcs.limit(0), pages)
    assert rows.count() == found.count() == 0


def test_users_and_audit_records(spark, tmp_path):
    store = tables.MonthTables(spark, f"file://{tmp_path}/store")
    store.create_missing()
    store.merge("dlg_users", spark.createDataFrame([(1, "ann", "admin", "Ann", "B")], "id int, username string, role string, firstname string, lastname string"))
    store.record(spark.createDataFrame([(7, 1, "ann", "LOGIN", "d")], "id int, lsp_id int, user_id string, action_taken string, details string"), "b1")
    got = store.read("audit_log").first()
    assert got.id == 7 and '"role":"admin"' in got.payload
    tables.write_ocr(spark.createDataFrame([("Portfolio 1", 2.0, "x")], "portfolio_hint string, amount double, context_before string"), f"file://{tmp_path}/ocr", "csv", simple=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/ocr").columns == ["portfolio_hint", "amount"]


def test_tables_of_a_database_are_read_in_parts(spark):
    url, driver = "jdbc:derby:memory:disclosa;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("Source "), "id").alias("NAME"))
    rows.write.format("jdbc").options(url=url, dbtable="SOURCES", driver=driver).mode("overwrite").save()
    found = tables.jdbc_table(spark, url, "SOURCES", driver=driver, partitionColumn="ID", lowerBound="0", upperBound="100", numPartitions="4")
    assert found.rdd.getNumPartitions() == 4 and found.where("ID < 10").count() == 10
    assert sorted(r.NAME for r in found.collect()) == sorted(r.NAME for r in rows.collect())


def test_footers_are_places(spark):
    body = '<nav><a href="/x">X</a></nav><footer><a href="/x">X</a></footer><a href="/y">Y</a><FOOTER id=2><a href="/z">Z</a></FOOTER><footer><a href="/open">O</a>'
    got = links.links(spark.createDataFrame([("https://a/", body)], "url string, html string")).orderBy("pos").collect()
    assert [(r.pos, r.href, r.in_footer) for r in got] == [(0, "/x", False), (1, "/x", True), (2, "/y", False), (3, "/z", True), (4, "/open", False)]


def test_deep_pages_sort_their_ranges_only(spark, monkeypatch):
    from disclosa.operators import joins

    monkeypatch.setattr(joins, "SHALLOW", 10)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id").repartition(5)
    for number, size in ((1, 5), (3, 5), (40, 20), (50, 20), (51, 20), (143, 7)):
        got = [r.x for r in joins.page(df, [F.desc("x")], number, size).collect()]
        assert got == list(range(999, -1, -1))[(number - 1) * size : number * size]


def test_only_texts_that_the_patterns_miss_reach_a_worker(spark):
    df = spark.createDataFrame([("31.12.2025",), ("Dec/31/2025",), (" ",), (None,), ("none",)], "t string")
    got = dates.with_dates(df, "t", "d")
    assert [r.d for r in got.collect() if r.d] == [dt.date(2025, 12, 31)] * 2 and got.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Filter" in plan.split("ArrowEvalPython")[1]


def test_rows_of_a_few_rules_are_not_dealt_by_them(spark):
    rows = spark.range(1 << 20, numPartitions=4).select("id", F.array(F.lit("Bank")).alias("headers"), F.array(F.col("id").cast("string")).alias("vals"), F.when(F.col("id") % 2 == 0, "{}").alias("rules_json"))
    got = rules.resolved_each(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert {(r.lender, r.n) for r in got.groupBy((F.col("lender") == F.col("id").cast("string")).alias("lender")).agg(F.count("*").alias("n")).collect()} == {(True, 1 << 20)}


def test_a_date_text_is_cleaned_once_however_many_wordings_are_tried(spark, monkeypatch):
    df = spark.createDataFrame([("31.02.2025 or 1 Jan 2026",), ("as on June 31, 2025, Dec'25",), ("12/31/2025",), (None,)], "t string").select(dates.parse_date(F.col("t")).alias("day"))
    assert [r.day for r in df.collect()] == [dt.date(2026, 1, 1), dt.date(2031, 6, 30), dt.date(2025, 12, 31), None]
    assert df._jdf.queryExecution().analyzed().toString().count("st|nd|rd|th") == 1
    asked = []
    monkeypatch.setattr(dates, "any_date", asked.append)
    assert [dates._known_date(t) for t in ("odd wording",) * 3] == [None] * 3 and len(asked) == 1
    dates._known_date.cache_clear()


def test_a_crawl_reads_its_pages_once_and_not_in_each_round(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def html(n):
        read.add(1)
        return f"<a href='/p{n + 1}'>on</a>"

    pages = spark.range(6).select(F.concat(F.lit("https://s.example.com/p"), F.col("id").cast("string")).alias("url"), html.asNondeterministic()("id").alias("html"))
    start = spark.createDataFrame([(1, "https://s.example.com/p0")], "id int, url string")
    assert sorted((r.depth, r.url[-2:]) for r in links.crawl(start, pages).collect()) == [(k, f"p{k}") for k in range(6)]
    assert read.value <= 12


def test_months_are_gathered_after_one_shuffle(spark):
    """Also where nothing of the fill is wanted, so not in the tasks that join the raw rows."""
    raw = spark.createDataFrame([], "row_id string, lsp_id long, lsp_name string, lender string, portfolio string, amount double, scrape_timestamp timestamp_ntz, as_on_timestamp timestamp_ntz, complete string, dlg_url string")
    months = summary.monthly_summary(raw.repartition(3), ["scrape_timestamp", "row_id"])
    for wanted in (months, months.select("lsp_id", "scrape_year", "scrape_month")):
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        dealt = plan.index("Exchange hashpartitioning")
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" in plan[:dealt] and "Aggregate" not in plan[dealt:]
