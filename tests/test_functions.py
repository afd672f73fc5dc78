from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import numeric, periods, text


def values(spark, cells, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_vietnamese_numbers(spark):
    want = {"8.600.550.706.227": 8600550706227, "(11.078.921.256)": -11078921256, "-1.234": -1234, " -1.046.320.000.000": -1046320000000, "-": None, "–": None, "": None, "  ": None, "4.037": 4037, "1.234,56": 1234.56, "0": 0, "31/12/2018": None, "Mã số": None, "(trình bày lại)": None, "12%": 12, None: None, "1.2.3,4,5": None}
    assert values(spark, list(want), numeric.parse_vn_number("c")) == list(want.values())


def test_english_numbers(spark):
    want = {"8,198,590,237,083": 8198590237083, "(24,779,418)": -24779418, "1,234.56": 1234.56}
    assert values(spark, list(want), numeric.parse_number("c", ",", ".")) == list(want.values())


@pytest.mark.parametrize(("cells", "fmt"), [(["1,234,567", "2,345,678", "12,345"], "en"), (["1.234.567", "2.345.678", "12.345"], "vi"), (["1.234,56"], "vi"), (["1,234.56"], "en"), ([], "vi"), (["-", "(1,234)"], "en")])
def test_number_format(spark, cells, fmt):
    array = F.array(*(F.lit(c) for c in cells)) if cells else F.array().cast("array<string>")
    assert spark.range(1).select(numeric.number_format(array)).first()[0] == fmt


def test_units(spark):
    header = lambda c: numeric.unit(F.array(F.col("c")), F.lit(""))
    got = values(spark, ["31/12/2018 VND", "31/12/2022Triệu VND", "2018VND", "2018 Triệu đồng", "Mã số"], header("c"))
    assert [(r.factor, r.label) for r in got] == [(1, "VND"), (1e6, "Triệu VND"), (1, "VND"), (1e6, "Triệu đồng"), (1, "VND")]
    assert values(spark, ["trieu dong viet nam", "dong viet nam", "ty dong", "nghin dong", "", "nghìn tỷ đồng"], numeric.unit_factor("c")) == [1e6, 1, 1e9, 1e3, 1, 1e12]
    got = values(spark, ["Đơn vị tính: Triệu đồng Việt Nam", "x\nĐơn vị tiền tệ: Triệu đồng\ny", "none", "Đơn vị báo cáo: Công ty"], numeric.unit(F.array(F.lit("Mã số")), "c")["factor"])
    assert got == [1e6, 1e6, 1, 1]


def test_labels(spark):
    want = {"Triệu Đông Việt Nam": "trieu dong viet nam", "Lợi nhuận sau thuế": "loi nhuan sau thue", "  Doanh thu thuần  ": "doanh thu thuan", None: "", "Đ đ": "d d"}
    assert values(spark, list(want), text.normalize_label("c")) == list(want.values())
    assert values(spark, [r"Lãi \( (50 = 20) \)"], text.clean_label("c")) == ["Lãi ( (50 = 20) )"]


def test_periods(spark):
    cells = ["31/12/2018 VND", "1/1/2018VND", "2017 VND", "31/12/2021Triệu VND(trình bày lại)", "Mã số", "", "01.01.2022"]
    got = values(spark, cells, periods.parse_period("c"))
    assert [r and (r.key, r.year) for r in got] == [("year_end", 2018), ("year_start", 2018), ("flow_year", 2017), ("restated_cur", 2021), None, None, ("year_start", 2022)]
    assert values(spark, ["Số cuối năm", "Số năm", "Closing balance"], periods.is_period_cell("c")) == [True, False, True]
    assert values(spark, ["31/12/2020", "Số đầu năm", "Trong năm", "31/1/2020"], periods.period_year("c", F.lit(2019))) == [2020, None, 2019, 2020]


def test_a_ticker_is_no_year(spark):
    ids = ["C2007_financial_statements_1998_separate_1", "C1992_financial_statements_x", "2018VND", "a\nFY2019", "C2007"]
    assert values(spark, ids, text.first_year("c")) == [1998, 0, 2018, 2019, 2007]


def test_names(spark):
    ids = ["AAA_financial_statements_2015_consolidated", "AAA_financial_statements_2015_separate", "X_aggregated", "XYZ_note_01", "HDB_financial_statements_2022_separate_1"]
    assert values(spark, ids, text.report_type("c")) == ["consolidated", "separate", "aggregated", "other", "separate"]
    assert values(spark, ids, text.first_year("c")) == [2015, 2015, 0, 0, 2022]
    assert [r and (r.ticker, r.year, r.report_type) for r in values(spark, ids, text.report_parts("c"))][:3] == [("AAA", 2015, "consolidated"), ("AAA", 2015, "separate"), None]
    got = values(spark, ["CTCP Tập đoàn Hòa Phát", "Tập đoàn Vingroup - CTCP"], text.name_variants("c"))
    assert {"ctcp tap doan hoa phat", "tap doan hoa phat", "hoa phat"} == set(got[0]) and "tap doan vingroup" in got[1]
