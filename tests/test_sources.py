"""Stored tables, quarantine, runs that are cut, evidence files."""

from __future__ import annotations

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import grid, package
from ledgerspark.sources import evidence, extraction, readers, sinks

TABLE = "<table><tr><td>x</td><td>{}</td></tr></table>"
REPORTS = "report_id string, ticker string, year int, report_type string, text string"
BROKEN = "<table><tr>" + '<td rowspan="60000" colspan="1000">y</td></tr>' + "<tr></tr>" * 5000 + "</table>"


def reports(spark, broken: bool = True):
    text = lambda *t: "===== PAGE 1 =====\n" + "\n".join(t)
    rows = [("A1", "A", 2020, "other", text(TABLE.format(1), TABLE.format(2))), ("A2", "A", 2021, "other", text(TABLE.format(3), BROKEN if broken else TABLE.format(4))), ("B1", "B", 2020, "other", text(TABLE.format(5))), ("C1", "C", 2020, "other", None)]
    return spark.createDataFrame(rows, REPORTS)


def content(spark, folder: str):
    return sorted((r.report_id, r.table_no, r.grid, r.ticker) for r in spark.read.parquet(f"{folder}/tables").collect())


def files(folder: str) -> dict:
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/tables/*/*.parquet")}


def test_a_broken_table_is_set_aside(spark, tmp_path):
    folder = str(tmp_path)
    bad = extraction.extract(reports(spark), folder).collect()
    assert [(r.report_id, r.table_no, r.ticker) for r in bad] == [("A2", 2, "A")] and bad[0].error.startswith("ValueError: spans cover")
    whole = [("A1", 1, [["x", "1"]], "A"), ("A1", 2, [["x", "2"]], "A"), ("B1", 1, [["x", "5"]], "B")]
    assert content(spark, folder) == whole
    before = files(folder)
    assert extraction.extract(reports(spark), folder).count() == 0 and files(folder) == before  # nothing is done again
    assert extraction.retry(reports(spark), folder).count() == 1 and content(spark, folder) == whole
    # Mended, it runs alone: B's file is the same.
    assert extraction.retry(reports(spark, broken=False), folder).count() == 0
    assert content(spark, folder) == sorted([*whole, ("A2", 1, [["x", "3"]], "A"), ("A2", 2, [["x", "4"]], "A")])
    assert [f for f in before if "ticker=B" in f] == [f for f in files(folder) if "ticker=B" in f] and spark.read.parquet(f"{folder}/quarantine").count() == 0
    assert extraction.retry(reports(spark), str(tmp_path / "none")).count() == 0


def test_errors_are_values_of_their_rows(spark):
    found = grid.parsed(grid.tables(reports(spark).select("report_id", "text"))).collect()
    assert {(r.report_id, r.table_no): (r.grid is None, r.html is None, r.error is None) for r in found} == {("A1", 1): (False, True, True), ("A1", 2): (False, True, True), ("A2", 1): (False, True, True), ("A2", 2): (True, False, False), ("B1", 1): (False, True, True)}
    assert grid.grids(grid.tables(reports(spark))).count() == 4


def test_merge_rewrites_touched_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, n int, v string, ticker string")
    sinks.merge_partitions(rows((1, 1, "a", "A"), (2, None, "b", "A"), (1, 1, "c", "B"), (3, 1, "z", None)), path, ["k", "n"])
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    for _ in range(2):  # the same rows again change nothing
        sinks.merge_partitions(rows((2, None, "new", "A"), (4, 4, "d", "A"), (9, 9, "e", "D")), path, ["k", "n"])
        got = sorted((r.k, r.v, r.ticker or "") for r in spark.read.parquet(path).collect())
        assert got == [(1, "a", "A"), (1, "c", "B"), (2, "new", "A"), (3, "z", ""), (4, "d", "A"), (9, "e", "D")]
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    same = {f for f in before if before[f] == after.get(f)}
    assert {f.split("/")[-2] for f in same} == {"ticker=B", "ticker=__HIVE_DEFAULT_PARTITION__"}


def test_questions_open_their_partitions_alone(spark, tmp_path):
    sinks.write_partitions(spark.range(400).select((F.col("id") % 40).cast("string").alias("ticker"), "id"), str(tmp_path / "f"))
    facts = spark.read.schema("id long, ticker string").parquet(str(tmp_path / "f"))
    asked = spark.createDataFrame([(1, ["7", "9"]), (2, []), (3, None), (4, ["x"])], "id int, tickers array<string>").filter("id < 9")
    found = readers.of_questions(facts, asked)
    assert sorted({r.ticker for r in found.collect()}) == ["7", "9"] and found.count() == 20
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_cut_run_gives_the_records_of_an_uncut_one(spark, tmp_path):
    asked = spark.range(60).selectExpr("id", "cast(id * 2 as double) as x")
    right = lambda q: q.select("id", F.col("x").alias("answer"), F.lit("p").alias("program"))
    assert extraction.answer_all(asked, right, str(tmp_path / "whole"), chunks=4) == {"answered": 4, "cut": 0, "done": 0}
    calls = []

    def breaks(at):
        def answer(q):
            calls.append(1)
            if len(calls) == at:
                raise RuntimeError("cut")
            return right(q)

        return answer

    for at in (2, 4):
        with pytest.raises(RuntimeError):
            extraction.answer_all(asked, breaks(at), str(tmp_path / "cut"), chunks=4)
    assert extraction.answer_all(asked, breaks(0), str(tmp_path / "cut"), chunks=4)["done"] == 2
    key = lambda p: sorted(map(tuple, extraction.records(spark, str(tmp_path / p)).select("id", "answer", "program", "error").collect()))
    assert key("cut") == key("whole") and len(key("whole")) == 60
    assert extraction.answer_all(asked, right, str(tmp_path / "cut"), chunks=4) == {"answered": 0, "cut": 0, "done": 4}


def test_late_questions_get_fallback_records(spark, tmp_path):
    def slow(q):
        wait = F.udf(lambda x, late: (time.sleep(30) if late else None) or x, "double")
        return q.select("id", wait("x", F.pmod(F.xxhash64("id"), F.lit(2)) == 1).alias("answer"), F.lit("p").alias("program"))

    asked = spark.range(20).selectExpr("id", "cast(id + 1 as double) as x")
    began = time.time()
    got = extraction.answer_all(asked, slow, str(tmp_path / "r"), chunks=2, seconds=8)
    assert got == {"answered": 1, "cut": 1, "done": 0} and time.time() - began < 60
    rows = extraction.records(spark, str(tmp_path / "r")).collect()
    assert sorted(r.id for r in rows) == list(range(20))
    assert all((r.answer, r.program, r.error) == ((r.id + 1, "p", None) if r.error is None else (0.0, None, "time limit")) for r in rows) and len({r.error for r in rows}) == 2


def test_evidence_files_have_fixed_names(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("data/R1__table_7.csv", 'a, "b"\nc', "01", 2020, 1.5, 2), ("data/R1__table_7.csv", "first", None, 2020, None, 1), ("data/R 2__income.csv", "é\\", "", 2019, -3.0, 1)]
    df = spark.createDataFrame(rows, "csv_path string, item string, code string, period int, value double, ord int")
    assert sorted(map(tuple, evidence.write(df, folder, ["ord"]).collect())) == [("data/R 2__income.csv", 1), ("data/R1__table_7.csv", 2)]
    assert sorted(os.listdir(f"{folder}/data")) == ["R 2__income.csv", "R1__table_7.csv"]
    assert open(f"{folder}/data/R1__table_7.csv", encoding="utf-8").read() == 'chi_tieu,Mãsố,ky,value\nfirst,,2020,\n"a, ""b""\nc",01,2020,1.500000\n'
    got = sorted(tuple(r) for r in evidence.read(spark, folder).filter("value is not null").collect())
    assert got == [("data/R 2__income.csv", "é\\", "", "2019", -3.0), ("data/R1__table_7.csv", 'a, "b"\nc', "01", "2020", 1.5)]
    os.remove(f"{folder}/data/R 2__income.csv")
    kept = os.stat(f"{folder}/data/R1__table_7.csv").st_mtime_ns
    assert [r.csv_path for r in evidence.write_missing(df, folder, ["ord"]).collect()] == ["data/R 2__income.csv"]
    assert os.stat(f"{folder}/data/R1__table_7.csv").st_mtime_ns == kept
    assert evidence.write(df.limit(0), str(tmp_path / "none"), ["ord"]).count() == 0


def test_a_killed_task_leaves_no_half_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("data/R__table_1.csv", "x", "", 2020, 1.0, k) for k in range(50)], "csv_path string, item string, code string, period int, value double, ord int")
    die = F.udf(lambda k: 1 / (k - 49) and float(k), "double")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        evidence.write(rows.withColumn("value", die("ord")), folder, ["ord"]).collect()
    assert not glob.glob(f"{folder}/**/*.*", recursive=True)


def test_retrieval_lines_are_read_back(spark, tmp_path):
    questions = spark.createDataFrame([(1, 'say "a", b\nc', ["VCB"], 2020), (2, "", [], None), (3, None, None, None)], "id long, question string, tickers array<string>, year int")
    hits = spark.createDataFrame([(1, 2, "R1|table_3", 0.5), (1, 1, "R2|17", 1.23456), (3, 1, "R3|table_1", 2.0)], "id long, rank int, table_key string, score double")
    lines = package.topk_lines(questions, hits, ["tickers", "year"])
    got = {r.id: r for r in lines.collect()}
    assert got[1].topk == "R2|17|1.2346;R1|table_3|0.5000" and got[1].entity_json == '{"tickers":["VCB"],"year":2020}'
    assert got[2].topk == "" and got[2].entity_json == '{"tickers":[]}' and got[3].question is None and got[3].topk == "R3|table_1|2.0000"
    sinks.write_topk(lines, str(tmp_path / "topk"))
    back = [tuple(r) for r in sinks.read_topk(spark, str(tmp_path / "topk")).orderBy("id", "rank").collect()]
    assert back == [(1, 1, "R2|17", 1.2346), (1, 2, "R1|table_3", 0.5), (3, 1, "R3|table_1", 2.0)]
    assert package.topk_lines(questions.limit(0), hits, ["year"]).count() == 0
    metrics = package.run_metrics(spark.createDataFrame([(1, 1, 1, 2), (0, 1, 0, 0)], "n_results int, n_tickers int, n_years int, n_facts int"))
    sinks.write_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().asDict() == {"n": 2, "coverage": 0.5, "ticker_rate": 1.0, "year_rate": 0.5, "mean_facts": 1.0}
