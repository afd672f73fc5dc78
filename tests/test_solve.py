"""Questions to records on a small fixture, programs run again, sinks written and read back."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerspark.functions.text import normalize_label
from ledgerspark.operators import matching, package, rerun, solve
from ledgerspark.operators.answer import lookup_program, run_program
from ledgerspark.operators.facts import tidy
from ledgerspark.sources import sinks

QUESTIONS = "id int, question string, tickers array<string>, matched map<string,string>, years array<int>, report_type string, statement string, unit_factor double, complex boolean"
R = "AAA_financial_statements_2020_consolidated"


def tables(spark):
    asked = [
        (1, "Lợi nhuận gộp của AAA năm 2020 là bao nhiêu triệu đồng ?", ["AAA"], {"AAA": "aaa"}, [2020], None, "income", 1e6, False),
        (2, "Chi phí khác của AAA năm 2020 ?", ["AAA"], {"AAA": "aaa"}, [2020], "separate", "income", 1.0, False),
        (3, "So với 2019 ?", ["AAA"], {"AAA": "aaa"}, [2019], None, "income", 1.0, True),
        (4, None, [], None, [], None, None, 1.0, False),
        (5, "Chi phí khác của AAA và BBB năm 2020 ?", ["AAA", "BBB"], None, [2020], None, "income", 1.0, False),
    ]
    facts = [(R, "AAA", 2020, "consolidated", "income", "loi nhuan gop", "20", 5e6, 1), (R, "AAA", 2020, "consolidated", "income", "loi nhuan gop", "20", 9e6, 2), (R, "AAA", 2020, "consolidated", "income", "chi phi khac", None, None, 3)]
    plan = [(q, v, n, R, k, name, f) for q in (1, 2) for v, n, k, name, f in (("df1", 1, "stmt", "income", [1, 2]), ("df2", 2, "table", "table_7", [7]))]
    evidence = [(R, "table_7", "Chi phí khác", "", 2020, 12.5, 1), (R, "table_7", "Chi phí khác", None, 2019, 99.0, 2), (R, "income", "loi nhuan gop", "20", 2020, 5e6, 1)]
    return (
        spark.createDataFrame(asked, QUESTIONS),
        spark.createDataFrame(facts, "report_id string, ticker string, year int, report_type string, statement string, item_label string, item_code string, value double, ord int"),
        spark.createDataFrame(plan, "id int, variable string, var_no int, report_id string, kind string, name string, fragments array<int>"),
        spark.createDataFrame(evidence, "report_id string, name string, item string, code string, period int, value double, ord int"),
    )


def test_answers_and_records(spark):
    asked, facts, plan, evidence = tables(spark)
    solved = solve.solve(asked, facts, plan, evidence, ["ord"], ["ord"])
    got = {r.id: (r.answer, r.tier, r.variable) for r in solved.collect()}
    assert got == {1: (5.0, "facts", "df1"), 2: (12.5, "evidence", "df2"), 3: (0.0, None, None), 4: (0.0, None, None), 5: (0.0, None, None)}
    programs = {r.id: r.program for r in solved.collect()}
    frame = evidence.withColumn("item", normalize_label("item"))  # as tidy tables have it
    for q, name, variable in ((1, "income", "df1"), (2, "table_7", "df2")):
        ran = run_program(spark, programs[q], {variable: frame.filter(F.col("name") == name)})
        assert ran == {"ok": True, "result": got[q][0], "error": None}
    records = solve.records(asked, plan.select("id", "report_id", F.col("var_no").alias("rank")), plan, solved)
    rows = {r.id: r for r in solve.submission(records).collect()}
    assert [e.csv_path for e in rows[1].evidence] == [f"data/{R}__income.csv"] and rows[1].relevant_tables == [f"{R}|table_{t}" for t in (1, 2, 7)]
    assert rows[2].relevant_tables == [f"{R}|table_7"] and rows[1].relevant_docs == [R] and rows[1].ok
    assert rows[4].evidence == [] and rows[4].relevant_docs == [] and not rows[4].ok
    found, lost = solve.evidence_files(solve.submission(records), evidence.filter("name = 'income'"))
    assert found.count() == 1 and [r.csv_path for r in lost.collect()] == [f"data/{R}__table_7.csv"]


def test_candidates_lose_no_label_that_scores(spark):
    """Every label of a key against every metric, by brute force."""
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.25)), 14)}" for _ in range(400)]
    pick = lambda most: [rng.choice(words) for _ in range(rng.randint(0, most))]
    labels = [(k, rng.choice("AB"), " ".join(pick(7)), rng.choice(["", "1"])) for k in range(250)]
    asks = [(k, rng.choice("AB"), pick(6)) for k in range(120)]
    rows = spark.createDataFrame(labels, "ord int, company string, label string, code string")
    index = matching.label_index(rows, ["company"], F.filter(F.split("label", " "), lambda t: t != ""), F.col("code") != "", ["ord"], ["label"])
    asked = spark.createDataFrame(asks, "ask int, company string, metric array<string>")
    for bonus in (True, False):
        one = index if bonus else index.filter("not coded")
        pairs = matching.candidates(asked, one, ["company"], bonus)
        got = sorted((r.ask, r.first.ord) for r in matching.scored(pairs).collect())
        first = {}
        for o, c, label, code in labels:
            if label and (bonus or not code):
                first.setdefault((c, label, code != ""), o)
        want = []
        for a, c, m in asks:
            for (company, label, coded), o in first.items():
                found, size = set(label.split()), len(m)
                if company == c and m and round(sum(t in found for t in m) / size * 0.8 - min(0.25, (len(found) / size - 1) * 0.1) + 0.15 * coded, 9) >= 0.5:
                    want.append((a, o))
        assert got == sorted(want) and len(want) > 50
        n = pairs.count()
        assert n == pairs.select("ask", "coded", "words", "company").distinct().count() and n < len(asks) * len(first) / 4


def test_programs_run_on_raw_tidy_output(spark):
    """Labels with marks, parentheses, short words, quotes and backslashes: each program gives its answer over tidy tables."""
    names = ["Lãi tiền gửi", "Chi phí sản xuất số 3 khác", "Lãi (lỗ) thuần từ HĐ", "Thuế 'TNDN' nộp thừa hoàn trả \\(ab\\)", "Quỹ   đầu tư"]
    grid = [["Chỉ tiêu", "Năm 2020"]] + [[n, f"{k + 1}.000"] for k, n in enumerate([*names, "Chi phí sản xuất số 3 khác nữa", names[0]])]
    layout = {"header_idx": 0, "period_row_idx": 0, "label_col": 0, "code_col": None, "periods": [{"label": "31/12/2020", "col": 1}], "value_col": None, "number_format": "vi", "unit_factor": 1.0}
    kind = "report_id string, table_no int, grid array<array<string>>, layout struct<header_idx:int,period_row_idx:int,label_col:int,code_col:int,periods:array<struct<label:string,col:int>>,value_col:int,number_format:string,unit_factor:double>"
    evidence = tidy(spark.createDataFrame([(R, 7, grid, layout)], kind)).withColumn("name", F.lit("table_7"))
    assert {r.item for r in evidence.collect()} >= {"lai tien gui", "quy dau tu"}
    asked = spark.createDataFrame([(k, n + " của AAA năm 2020 ?", ["AAA"], {"AAA": "aaa"}, [2020], None, None, 1.0, False) for k, n in enumerate(names)], QUESTIONS)
    plan = spark.createDataFrame([(k, "df1", 1, R, "table", "table_7", [7]) for k in range(len(names))], "id int, variable string, var_no int, report_id string, kind string, name string, fragments array<int>")
    solved = solve.solve(asked, tables(spark)[1].limit(0), plan, evidence, ["ord"], ["ord"])
    rows = solved.collect()
    assert [r.answer for r in sorted(rows, key=lambda r: r.id)] == [1000.0, 2000.0, 3000.0, 4000.0, 5000.0]
    for r in rows:
        assert run_program(spark, r.program, {"df1": evidence}) == {"ok": True, "result": r.answer, "error": None}
    made = solve.records(asked, plan.select("id", "report_id", F.col("var_no").alias("rank")), plan, solved)
    assert {(r.status, r.executed) for r in rerun.verdicts(made, evidence, ["ord"]).collect()} == {("ok", 1000.0 * k) for k in range(1, 6)}


def test_gaps_of_several_companies_are_filled(spark):
    kind = "id int, tickers array<string>, years array<int>, report_type string, statement string"
    asked = spark.createDataFrame([(1, ["AAA", "BBB"], [2020, 2021], None, "cash_flow"), (2, ["AAA", "BBB"], [2020], "separate", None), (3, ["AAA"], [2020], None, None), (4, ["AAA", "CCC"], [], None, None)], kind)
    report = "{}_financial_statements_{}_{}".format
    plan = spark.createDataFrame([(1, "df1", 1, report("AAA", 2020, "consolidated"), "stmt", "balance_sheet"), (1, "df2", 2, report("AAA", 2020, "consolidated"), "stmt", "income")], "id int, variable string, var_no int, report_id string, kind string, name string")
    merged = [(report("AAA", 2020, "consolidated"), "cash_flow"), (report("AAA", 2021, "separate"), "cash_flow"), (report("AAA", 2021, "separate"), "income"), (report("BBB", 2020, "separate"), "income"), (report("BBB", 2020, "separate"), "balance_sheet"), (report("BBB", 2021, "consolidated"), "income")]
    got = solve.fill_gaps(asked, plan, spark.createDataFrame(merged * 2, "report_id string, name string"))
    want = [
        (1, "df3", 3, report("AAA", 2020, "consolidated"), "stmt", "cash_flow"), (1, "df4", 4, report("AAA", 2021, "separate"), "stmt", "cash_flow"),
        (1, "df5", 5, report("BBB", 2020, "separate"), "stmt", "balance_sheet"), (1, "df6", 6, report("BBB", 2021, "consolidated"), "stmt", "income"),
        (2, "df1", 1, report("BBB", 2020, "separate"), "stmt", "balance_sheet"),
    ]
    assert sorted(map(tuple, got.collect())) == want
    assert solve.fill_gaps(asked.limit(0), plan, spark.createDataFrame(merged, "report_id string, name string")).count() == 0


def test_verdicts(spark):
    path = f"data/{R}__table_7.csv"
    program = lambda **k: lookup_program("df1", 2020, 10.0, **k)
    cases = {
        "code": (1.5, program(code="20"), [("df1", path)], "ok", 1.5),
        "label": (2.0, program(label="it's"), [("df1", path)], "ok", 2.0),
        "both": (0.0, program(code="21", label="it's"), [("df1", path)], "ok", 0.0),
        "first": (1.505, program(label="a"), [("df1", path)], "ok", 1.5),
        "wrong": (9.0, program(label="a"), [("df1", path)], "mismatch", 1.5),
        "null answer": (None, program(label="none"), [("df1", path)], "ok", 0.0),
        "variable": (0.0, program(label="a").replace("df1", "df2"), [("df1", path)], "crash", None),
        "other": (1.0, "select 1 as result", [("df1", path)], "crash", None),
        "open": (1.0, "select coalesce(round(min_by(value, ord) / 1.0, 2), 0.0) as result from df1 where period = 2020", [("df1", path)], "crash", None),
        "lost": (1.5, program(code="20"), [("df1", path), ("df2", f"data/{R}__table_8.csv")], "bad_path", None),
        "outside": (1.5, program(code="20"), [("df1", "x/" + path[5:])], "bad_path", None),
        "none": (0.0, "", None, "ok", 0.0),
        "null": (3.0, None, [], "mismatch", 0.0),
    }
    records = spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in cases.items()], "id string, answer double, program string, evidence array<struct<variable:string,csv_path:string>>")
    rows = [(R, "table_7", "a", "20", 2020, 15.0, 2), (R, "table_7", "a", None, 2020, 7.0, 3), (R, "table_7", "it's", "", 2020, 20.0, 4), (R, "table_7", "a", "20", 2019, 99.0, 1)]
    evidence = spark.createDataFrame(rows, "report_id string, name string, item string, code string, period int, value double, ord int")
    found = rerun.verdicts(records, evidence, ["ord"])
    got = {r.id: r for r in found.collect()}
    assert {k: (r.status, r.executed) for k, r in got.items()} == {k: v[3:] for k, v in cases.items()}
    assert {k for k, r in got.items() if r.no_evidence} == {"none", "null"} and (got["lost"].error, got["other"].error, got["variable"].error, got["code"].error) == (f"no table: data/{R}__table_8.csv", "no lookup", "variable without evidence", None)
    for k in ("code", "label", "both", "first", "wrong", "null answer"):  # the same as each program run by itself
        assert run_program(spark, cases[k][1], {"df1": evidence.filter("name = 'table_7'")})["result"] == got[k].executed
    assert rerun.summary(found).first().asDict() == {"total": 13, "ok": 6, "crash": 3, "mismatch": 2, "bad_path": 2, "no_evidence": 2}
    assert rerun.summary(rerun.verdicts(records.limit(0), evidence.limit(0), ["ord"])).first().total == 0


def test_empty_tables(spark):
    asked, facts, plan, evidence = (t.limit(0) for t in tables(spark))
    solved = solve.solve(asked, facts, plan, evidence, ["ord"], ["ord"])
    assert solved.count() == 0 and solve.records(asked, plan.select("id", "report_id", F.col("var_no").alias("rank")), plan, solved).count() == 0
    assert package.run_metrics(spark.createDataFrame([], "n_results int, n_tickers int, n_years int, n_facts int")).first().asDict() == {"n": 0, "coverage": 0.0, "ticker_rate": 0.0, "year_rate": 0.0, "mean_facts": 0.0}


def test_cards(spark):
    evidence = tables(spark)[3].withColumn("kind", F.when(F.col("name") == "income", "stmt").otherwise("table"))
    got = {r.name: r for r in solve.cards(evidence, "ord", most_chars=10).collect()}
    assert got["income"].sample == "loi nhuan gop | 20 | 2020 | 5000000.0" and [tuple(h) for h in got["income"].hints] == [("20", "loi nhuan gop")]
    assert got["table_7"].sample == "Chi phí kh ..." and got["table_7"].hints == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, None), ("B", 2, "bad")], "ticker string, v int, error string")
    good, bad = sinks.split_quarantine(rows)
    assert [r.v for r in good.collect()] == [1] and [r.v for r in bad.collect()] == [2]
    sinks.write_partitions(good, f"{tmp_path}/p")
    sinks.write_partitions(good.withColumn("v", F.lit(5)).unionByName(bad.drop("error")), f"{tmp_path}/p")
    assert sorted((r.ticker, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [("A", 5), ("B", 2)]
    sinks.append_records(good, f"{tmp_path}/j")
    sinks.append_records(good, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert sorted((r.ticker, r.v) for r in sinks.upsert(good, good.withColumn("v", F.lit(9)), ["ticker"]).collect()) == [("A", 9)]
    tidy = spark.createDataFrame([("R", "a", "1", 2020, 1.5)], "report_id string, item string, code string, period int, value double")
    sinks.write_evidence(tidy, f"{tmp_path}/e", ["report_id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/e").first().value == "1.500000"


def test_what_grows_is_not_broadcast_by_the_size_of_its_files(spark):
    from ledgerspark.operators import entities, rerun, solve
    from ledgerspark.operators.retrieval import small
    from ledgerspark.plans.storage import tier

    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stocks = tier(spark.createDataFrame([("AAA", "Holding AAA")], "ticker string, company_name string"), "test")
    asked = tier(spark.createDataFrame([(1, "Doanh thu của AAA năm 2020")], "id int, question string"), "test")
    assert "Broadcast" not in plan_of(entities.entities(asked, stocks))
    assert "Broadcast" not in plan_of(small(asked, 0).join(stocks, F.col("id").cast("string") == F.col("ticker")))
    results = tier(spark.createDataFrame([(1, "R", 1)], "id int, report_id string, rank int"), "test")
    plan = tier(spark.createDataFrame([(1, "df1", 1, "R", "stmt", "income", [1])], "id int, variable string, var_no int, report_id string, kind string, name string, fragments array<int>"), "test")
    solved = tier(spark.createDataFrame([(1, 1.0, "x", "facts")], "id int, answer double, program string, tier string"), "test")
    made = solve.records(asked, results, plan, solved)
    assert "Broadcast" not in plan_of(made) and "Broadcast" not in plan_of(solve.missing_statements(asked.withColumn("statement", F.lit("income")), plan))
    evidence = tier(spark.createDataFrame([("R", "income", "a", "", 2020, 1.0, 1)], "report_id string, name string, item string, code string, period int, value double, o int"), "test")
    assert "Broadcast" not in plan_of(rerun.verdicts(tier(made, "test"), evidence, ["o"]))
