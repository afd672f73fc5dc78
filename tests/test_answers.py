from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import answer, entities, package, retrieval
from ledgerspark.plans import config
from ledgerspark.sources import readers

STOCKS = [("VJC", "CTCP Hàng không Vietjet"), ("FPT", "CTCP FPT"), ("FTS", "CTCP Chứng khoán FPT"), ("BID", "Ngân hàng TMCP Đầu tư và Phát triển Việt Nam"), ("ABB", "Ngân hàng TMCP An Bình"), ("HPG", "CTCP Tập đoàn Hòa Phát")]
QUESTIONS = {
    "Lãi tiền gửi năm 2018 của công ty mẹ CTCP Hàng không Vietjet (VJC) là bao nhiêu triệu đồng?": (["VJC"], [2018], "separate", "income", 1e6),
    "Tổng tài sản của CTCP Chứng khoán FPT cuối năm 2020-2022 là bao nhiêu tỷ đồng?": (["FTS"], [2020, 2021, 2022], None, "balance_sheet", 1e9),
    "Doanh thu hợp nhất của BIDV năm 2022 so với 2021": (["BID"], [2021, 2022], "consolidated", "income", 1.0),
    "Tổng tài sản bình quân giai đoạn 2018–2024 bao nhiêu nghìn tỷ đồng?": ([], list(range(2018, 2025)), None, "balance_sheet", 1e12),
    "Lưu chuyển tiền thuần của Hoà Phát năm 2017?": (["HPG"], [2017], None, "cash_flow", 1.0),
}


def test_entities(spark):
    stocks = spark.createDataFrame(STOCKS, "ticker string, company_name string")
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, question string")
    got = entities.entities(asked, stocks).orderBy("id").collect()
    assert [(r.tickers, r.years, r.report_type, r.statement, r.unit_factor) for r in got] == list(QUESTIONS.values())
    assert [r.complex for r in got] == [False, False, True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([(["lai", "tien", "gui"], ["lai", "tien", "gui"]), (["lai"], ["lai", "tien"]), ([], ["a"])], "label array<string>, metric array<string>")
    assert [round(r[0], 4) for r in df.select(answer.label_score(F.col("label"), F.col("metric"), F.lit(True))).collect()] == [0.95, 0.6, 0.0]


DENIED = ["select 1; select 2", "drop table df1", "select java_method('a', 'b') from df1", "select reflect('a', 'b')", "select * from parquet.`/etc`", "select * from other", "select value from df1 -- x", "insert into df1 values (1)", "select value from df1 join secret on true", "select input_file_name() from df1", "select value from df1, other where 1 = 1",
    "select value from df1 where value > 5 union all table secret", "select y.value from (select * from df1) x, secret y", "select (select max(value) from secret) from df1", "with a as (select 1) select * from a", "select value from df1 where exists (select 1 from secret)",
    "select value from df1 where value in (select value from secret)", "select sum(value) over () from df1", "table secret", "values (1)", "select * from range(5)", "select explode(array(1)) from df1", "select db.round(1) from df1", "set x = 1", "select system.builtin.java_method('a', 'b')"]


@pytest.mark.parametrize("sql", DENIED)
def test_denied_programs(spark, sql):
    assert answer.check_program(sql, {"df1"}) is not None


def test_programs(spark):
    df = spark.createDataFrame([("lai tien gui", "", 2018, 208253201298.0, 1), ("khac", "60", 2018, 5.0, 2)], "item string, code string, period int, value double, ord long")
    assert answer.run_program(spark, answer.lookup_program("df1", 2018, 1e6, label="lai tien gui"), {"df1": df}) == {"ok": True, "result": 208253.2, "error": None}
    assert answer.run_program(spark, answer.lookup_program("df1", 2018, 1.0, code="60"), {"df1": df})["result"] == 5
    assert answer.run_program(spark, answer.lookup_program("df1", 1999, 1.0, code="60"), {"df1": df})["result"] == 0
    assert answer.run_program(spark, "select vn_num('1.234,5') as result from df1 where ord = 1", {"df1": df})["result"] == 1234.5
    assert not answer.run_program(spark, "select nothing as result from df1", {"df1": df})["ok"]
    assert answer.check_program("select " + "1 + " * 3000 + "1", set()) == "too long"
    for sql, want in {"select sum(a.value) from df1 a join df1 b on a.ord = b.ord where a.period between 2000 and 2020 and a.code is not null and a.code = ''": 208253201298.0, "select max(v) from (select max(value) v from df1 group by code having count(*) > 0) t": 208253201298.0, "select case when -value < 0 then cast(ord as double) else 0 end from df1 where item like 'kh%' or item in ('x')": 2.0, "select (select max(ord) from df1) + 1 from df1 where ord = 1": 3.0}.items():
        assert answer.run_program(spark, sql, {"df1": df}) == {"ok": True, "result": want, "error": None}
    assert "global_temp" not in str([t.name for t in spark.catalog.listTables("global_temp")]) and not spark.catalog.listTables("global_temp")


def test_programs_end_in_time(spark):
    df = spark.range(200_000).selectExpr("id as ord", "cast(id as double) as value", "1 as one")
    got = answer.run_program(spark, "select sum(a.value * b.value) from df1 a join df1 b on a.one = b.one", {"df1": df}, seconds=2)
    assert not got["ok"] and got["result"] is None


@pytest.mark.parametrize("n", [0, 1, 2, 29, 52, 56, 58, 60, 87])
def test_latency_is_exact(spark, n):
    got = package.latency(spark.range(n).selectExpr("cast((id * 37) % 89 as double) as t").repartition(5), "t").first()
    values = sorted(float(i * 37 % 89) for i in range(n))
    assert tuple(got) == ((values[n // 2], values[95 * n // 100]) if n else (None, None))


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, d string, rank int")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "qid int, d string, rank int")
    got = retrieval.rrf([a, b], "qid", "d", 10).orderBy("rank").collect()
    assert [(r.d, round(r.score, 4)) for r in got] == [("x", 0.0328), ("y", 0.0161), ("z", 0.0161)]
    pairs = spark.createDataFrame([(1, "x", "a b", "c", 0.1, 1), (1, "y", "a b", "b a", 0.0, 2)], "qid int, d string, q string, t string, score double, rank int")
    assert retrieval.rerank(pairs, "q", "t", "qid", "d").orderBy("rank").first().d == "y"
    cached = spark.createDataFrame([("5d41402abc4b2a76b9719d911017c592",)], "hash string")
    assert [r.text for r in retrieval.uncached(spark.createDataFrame([("hello",), ("new",)], "text string"), cached).collect()] == ["new"]


def test_package(tmp_path):
    assert package.renumber("df3 + df1 - df13", ["df3", "df13"]) == "df1 + df1 - df2"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text("{}")
    assert list(package.pack(tmp_path / "s", tmp_path / "o.zip")["files"]) == ["a.json"]
    (tmp_path / "s" / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        package.pack(tmp_path / "s", tmp_path / "o.zip")


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"retrieval": {"k": 5}}')
    (tmp_path / "b.json").write_text('{"retrieval": {"min_n_rows": 3}, "data_dir": "x"}')
    c = config.load(tmp_path / "a.json", tmp_path / "b.json")
    assert (c.retrieval.k, c.retrieval.min_n_rows, c.data_dir, c.answering.tolerance) == (5, 3, "x", 0.01)
    with pytest.raises(ValueError):
        config.build({"retrieval": {"kk": 1}})


def test_readers_and_streaming(spark, tmp_path):
    from ledgerspark.streaming import ingest

    (tmp_path / "s.csv").write_text("﻿Mã CK,Tên công ty\nAAA,First\n,blank\nAAA,Second\nBBB,Other\n", encoding="utf-8")
    assert {tuple(r) for r in readers.stocks(spark, str(tmp_path / "s.csv")).collect()} == {("AAA", "Second"), ("BBB", "Other")}
    (tmp_path / "q.jsonl").write_text('{"id": 1, "question": "a"}\n\nbroken\n{"id": 2, "question": "b"}\n')
    assert [(r.id, r.question) for r in readers.questions(spark, str(tmp_path / "q.jsonl")).orderBy("ord").collect()] == [(1, "a"), (2, "b")]
    assert {r.id for r in readers.done(spark, str(tmp_path / "q.jsonl")).collect()} == {1, 2}
    for year in ("2018", "notes"):
        folder = tmp_path / "reports" / "AAA" / year / f"AAA_financial_statements_{year}_separate"
        folder.mkdir(parents=True)
        (folder / "x_extracted.txt").write_text("===== PAGE 1 =====\n<table><tr><td>1</td></tr></table>\n<table></table>")
    assert [(r.ticker, r.year, r.report_type) for r in readers.reports(spark, str(tmp_path / "reports")).collect()] == [("AAA", 2018, "separate")]
    for _ in range(2):
        ingest.ingest(ingest.report_stream(spark, str(tmp_path / "reports")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_company_names_of_more_than_twelve_words(spark):
    from ledgerspark.operators import entities

    name = "Nhà xuất bản sách giáo khoa và thiết bị trường học miền trung Tây Nguyên"
    stocks = spark.createDataFrame([("XYZ", name)], "ticker string, company_name string")
    questions = spark.createDataFrame([(1, f"Doanh thu của {name} năm 2023 là bao nhiêu?"), (2, "Doanh thu năm 2023?")], "id int, question string")
    assert [(r.id, r.tickers) for r in entities.tickers(questions, stocks).collect()] == [(1, ["XYZ"])]
