from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import facts, grid, layout
from ledgerspark.plans.storage import tier


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def classified(spark, tables, anchor="BẢNG CÂN ĐỐI KẾ TOÁN", report_id="AAA_financial_statements_2018_consolidated"):
    """tables: (anchor, rows)."""
    rows = [(report_id, k + 1, a, html(r), "consolidated") for k, (a, r) in enumerate(tables)]
    found = grid.grids(spark.createDataFrame(rows, "report_id string, table_no int, anchor string, html string, report_type string"))
    return tier(layout.statements(layout.layouts(found)), "test")


def test_grid_spans_and_entities():
    assert grid.parse_grid('<table><tr><td colspan="3">NGUỒN VỐN</td></tr><tr><td>a</td><td>b</td></tr></table>') == [["NGUỒN VỐN"] * 3, ["a", "b", ""]]
    assert grid.parse_grid("<table><tr><td>LU&#x27;U <b>CHUYÊN</b> TIÊN</td></tr></table>") == [["LU'U CHUYÊN TIÊN"]]
    assert grid.parse_grid("<table><tr><td>1</td><td></td><td> 3 </td></tr></table>") == [["1", "", "3"]]
    assert grid.parse_grid('<table><tr><td>a</td><td rowspan="2">b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>') == [["a", "b", "c"], ["d", "b", "e"]]
    assert grid.parse_grid("<table></table>") == [] and grid.parse_grid(None) == []


def test_pages_and_tables(spark):
    text = "lost <table></table>\n===== PAGE 1 =====\none\n\ntwo <table>\n<tr><td>1</td></tr></table> and <table></table>\n===== PAGE 3 =====\n<table><tr></tr></table>"
    reports = spark.createDataFrame([("r", text), ("s", None), ("t", "no pages")], "report_id string, text string")
    got = grid.tables(reports).orderBy("table_no").collect()
    assert [(r.table_no, r.page_no, r.start_line) for r in got] == [(1, 1, 5), (2, 1, 6), (3, 3, 8)]
    assert got[0].anchor == "one\ntwo" and got[1].html == "<table></table>"


CASES = {
    "vas": ([["", "Mã số", "Thuyết minh", "2018 VND", "2017 VND"], ["Doanh thu", "10", "", "1", "2"], ["Giá vốn", "11", "", "1", "2"], ["Lãi", "20", "", "1", "2"]], {"code_col": 1, "label_col": 0, "period_cols": [3, 4], "notes_cols": [2]}),
    "bank": ([["STT", "Chỉ tiêu", "Thuyết minh", "31/12/2022Triệu VND"], ["I", "Tiền mặt", "4", "8.460.892"], ["II", "Tiền gửi", "5.1", "2"], ["1", "Vay", "12(b)", "3"], ["a", "Khác", "15(c)", "4"], ["XII", "Cộng", "", "5"]], {"code_col": 0, "label_col": 1, "period_cols": [3], "unit_factor": 1e6}),
    "two_tier": ([["STT", "Chỉ tiêu", "Thuyết minh", "Tại ngày", "Tại ngày"], ["", "", "", "31/12/2022", "31/12/2021"], ["I", "Tiền mặt", "4", "8.460.892", "1.000"]], {"header_idx": 0, "period_row_idx": 1, "period_cols": [3, 4]}),
    "no_periods": ([["Tên công ty", "Tỷ lệ sở hữu"], ["Công ty A", "51%"], ["Công ty B", "100%"]], {"period_cols": [], "value_col": 1, "label_col": 0}),
    "note": ([["", "2018VND", "2017VND"], ["Lãi tiền gửi", "208.253.201.298", "1.000"]], {"period_cols": [1, 2], "label_col": 0, "code_col": None}),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(spark, name):
    rows, want = CASES[name]
    found = classified(spark, [("", rows)]).first().layout.asDict()
    assert {k: found[k] for k in want} == want


def test_groups_choose_the_period_columns(spark):
    rows = [["Chỉ tiêu", "Tập đoàn", "Công ty"], ["", "2018 VND", "2018 VND"], ["Lãi", "1", "2"]]
    assert classified(spark, [("", rows)]).first().layout.period_cols == [1]


INCOME = [["Chỉ tiêu", "Mã số", "2018 VND", "2017 VND"], ["Lợi nhuận (60 = 50 - 51 - 52)", "60", "8.600", "7.000"], ["", "70", "5", ""], ["Cộng", "", "", "-"]]


def test_fragments_merge_and_codes_count_once(spark):
    more = [["Chỉ tiêu", "Mã số", "2018 VND", "2017 VND"], ["Lợi nhuận", "60", "1", "1"], ["Lãi cơ bản", "61", "3", ""], ["Lãi suy giảm", "62", "4", ""]]
    title = "BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH"
    tables = classified(spark, [(title, INCOME), (title, more), ("Thuyết minh", more), (title, more)])
    assert [r.statement for r in tables.orderBy("table_no").collect()] == ["income", "income", None, "income"]
    assert [r.asset for r in facts.fragments(tables).orderBy("table_no").collect()] == [1, 1, 3]
    got = facts.facts(tables.filter("table_no <= 2")).orderBy("ord").collect()
    assert [(r.item_code, r.period_year, r.value) for r in got] == [("60", 2018, 8600), ("60", 2017, 7000), ("70", 2018, 5), ("61", 2018, 3), ("62", 2018, 4)]
    assert got[2].item_label == got[0].item_label  # carried forward
    assert facts.formula_labels(facts.facts(tables.filter("table_no = 1"))).count() == 3


@pytest.mark.parametrize("anchor", ["Các chỉ tiêu ngoài bảng cân đối kế toán", "Thuyết minh"])
def test_no_statement(spark, anchor):
    assert classified(spark, [(anchor, INCOME)]).first().statement is None


def merge(spark, rows, year):
    """rows: code, label, period_key, period_label, value, table_no."""
    df = spark.createDataFrame([("R", "balance_sheet", i, *r) for i, r in enumerate(rows)], "report_id string, statement string, ord long, item_code string, item_label string, period_key string, period_label string, value double, table_no int")
    return [(r.code, r.item, r.period, r.value) for r in facts.merge_statements(df, F.lit(year)).orderBy("ord").collect()]


def test_merging(spark):
    assert merge(spark, [("100", "tài sản", "year_end", "31/12/2018", 1000.0, 1), ("100", "tài sản", "year_start", "1/1/2018", 500.0, 1)], 2018) == [("100", "tài sản", 2018, 1000)]
    assert [r[2] for r in merge(spark, [("1", "a", "flow_year", "2016 VND", 1.0, 1), ("1", "a", "", "Trong nam", 2.0, 1)], 2017)] == [2016, 2017]
    assert merge(spark, [("100", "a", "year_end", "2018", 1000.0, 1), ("100", "a", "restated_cur", "2018", 999.0, 1)], 2018)[0][3] == 1000
    assert merge(spark, [("1", "", "", "2015", 5.0, 1), ("2", "x", "", "Theo Quyết định 15/2006/QĐ-BTC", 6.0, 1), ("3", "y", "", "2015", 7.0, 1)], 2015) == [("3", "y", 2015, 7)]
    assert [r[1] for r in merge(spark, [("", "a", "", "2015", 5.0, 1), ("", "b", "", "2015", 6.0, 1), ("", "a", "", "2015", 7.0, 1)], 2015)] == ["a", "b"]
    assert merge(spark, [("1", r"\( (50 = 20 + 30) \)", "", "2015", 5.0, 1)], 2015)[0][1] == "( (50 = 20 + 30) )"


def test_cross_foot(spark):
    df = spark.createDataFrame([("R", "balance_sheet", 1, "270", "year_end", 10.0), ("R", "balance_sheet", 2, "440", "year_end", 12.5), ("R", "balance_sheet", 3, "270", "year_start", 1.0)], "report_id string, statement string, ord long, item_code string, period_key string, value double")
    assert [tuple(r) for r in facts.cross_foot(df).collect()] == [("R", "year_end", 10.0, 12.5)]


def test_a_ticker_is_no_period(spark):
    rows = [("C1992_financial_statements_2018_separate_7", "income", 1, "10", "Lãi", "flow_year", "2018 VND", 5.0, 2), ("C1992_financial_statements_2018_separate_7", "income", 2, "10", "Lãi", "flow_year", "2017 VND", 4.0, 2)]
    df = spark.createDataFrame(rows, "report_id string, statement string, ord long, item_code string, item_label string, period_key string, period_label string, value double, table_no int")
    assert sorted((r.period, r.value) for r in facts.merge_statements(df).collect()) == [(2017, 4.0), (2018, 5.0)]


def test_bare_tables_are_cut_as_the_parser_would():
    from unittest import mock

    tables = [html(INCOME), html([["a &amp; b", " x "], []]), '<table><tr><td colspan="3">T</td></tr><tr><td>1</td></tr></table>', '<table><tr><td colspan="0">T</td></tr></table>', '<table><tr><td colspan="5000">T</td></tr></table>']
    other = ['<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>', "<table><tr><td>a<br>b</td></tr></table>", "<table><tr><td>a<3</td></tr></table>", "<table>\n<tr><td>a</td></tr></table>", "<table></table>"]
    with mock.patch.object(grid, "_rows", side_effect=AssertionError):
        got = [grid.parse_grid(t) for t in tables]
    assert all(grid._bare(t) is None for t in other)
    with mock.patch.object(grid, "_bare", return_value=None):
        assert got == [grid.parse_grid(t) for t in tables]


def test_tests_stop_at_the_first_hit(spark):
    from ledgerspark.functions.text import first_index

    found = spark.sql("select array('a', 'b', '0', 'b') as c, cast(array() as array<string>) as e").select(first_index(F.col("c"), lambda x: x == "b").alias("b"), first_index(F.col("c"), lambda x: F.when(x == "0", F.raise_error(F.lit("tested"))).otherwise(x == "b")).alias("s"), first_index(F.col("e"), lambda x: x == "b").alias("n")).first()
    assert found[:] == (1, 1, None)


def test_facts_are_shuffled_once(spark):
    tables = classified(spark, [("BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH", INCOME)])
    plan = facts.facts(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_periods_of_a_table_are_read_once(spark):
    plan = facts.tidy(classified(spark, [("", INCOME)]))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode", 1)
    assert "dau ky" in below and "dau ky" not in above
