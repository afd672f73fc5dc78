"""The way from questions to records, over parts and their line items.

A brand is a company, a line item a fact (returned ones in its income statement, others in a table of notes), and each part
asks for a figure of its brand by its own name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, rerun, solve
from ..operators.retrieval import small
from ..plans.storage import tier
from ..registry import query
from ..sources.readers import table

ORDER = ["o1", "o2", "o3", "o4", "o5"]
_SQL = """l AS (SELECT 'B' || split_part(p_brand, '#', 2) AS ticker, year(l_shipdate) + 23 AS y, l_returnflag AS f, lower(p_name) AS label, l_extendedprice * 1000 AS value, CASE WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR ELSE '' END AS code, l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, l_extendedprice AS o5 FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT p_partkey AS id, 'B' || split_part(p_brand, '#', 2) AS ticker, 2017 + p_partkey % 5 AS y, p_partkey % 3 <> 0 AS hint, p_partkey % 7 = 0 AS hard, p_partkey % 4 <> 1 AS has, CASE WHEN p_partkey % 3 <> 0 THEN ['thu'] ELSE [] END || string_split(lower(p_name), ' ') AS m FROM part),
s AS (SELECT id, has, f, l.y, value, label, code, o1, o2, o3, o4, o5, round(0.8 * len(list_filter(m, lambda w: list_contains(string_split(label, ' '), w))) / len(m) - least(0.25, (len(list_distinct(string_split(label, ' '))) / len(m) - 1) * 0.1) + CASE WHEN f = 'A' THEN 0.15 ELSE 0 END, 9) AS score
  FROM q JOIN l ON q.ticker = l.ticker AND q.y = l.y WHERE NOT hard AND (f = 'N' OR (hint AND has))),
best AS (SELECT *, CASE WHEN f = 'N' THEN 'evidence' ELSE 'facts' END AS tier FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY id, f = 'N' ORDER BY score DESC, o1, o2, o3, o4, o5) = 1),
r AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier DESC) = 1)"""


def _ticker() -> F.Column:
    return F.concat(F.lit("B"), F.element_at(F.split("p_brand", "#"), 2))


def _report(ticker: str, year: str) -> F.Column:
    return F.concat(F.col(ticker), F.lit("_financial_statements_"), F.col(year).cast("string"), F.lit("_consolidated"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("t", _ticker())
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 != 0, "Doanh thu ").otherwise(""), F.col("p_name"), F.lit(" của "), F.col("t"), F.lit(" năm "), (k % 5 + 2017).cast("string"), F.when(k % 7 == 0, " so với năm trước").otherwise(""), F.lit(" là bao nhiêu nghìn đồng ?"))
    stocks = part.select(F.col("t").alias("ticker")).distinct().withColumn("company_name", F.concat(F.lit("Holding "), F.col("ticker")))
    return tier(entities.entities(part.select(k.alias("id"), text.alias("question")), stocks), "questions")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, plan and evidence."""
    part = table(spark, sf_dir, "part").withColumn("ticker", _ticker())
    items = table(spark, sf_dir, "lineitem").join(small(part), F.col("l_partkey") == F.col("p_partkey"))
    code = F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("string")).otherwise("")
    order = [F.col(c).alias(o) for c, o in zip(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ORDER, strict=True)]
    rows = items.select("ticker", (F.year("l_shipdate") + 23).alias("year"), "l_returnflag", F.lower("p_name").alias("item_label"), code.alias("item_code"), (F.col("l_extendedprice") * 1000).alias("value"), *order).withColumn("report_id", _report("ticker", "year"))
    facts = rows.filter("l_returnflag <> 'N'").withColumns({"report_type": F.lit("consolidated"), "statement": F.lit("income")})
    evidence = rows.filter("l_returnflag = 'N'").select("report_id", F.lit("table_3").alias("name"), F.col("item_label").alias("item"), F.col("item_code").alias("code"), F.col("year").alias("period"), "value", *ORDER)
    asked = part.select(F.col("p_partkey").alias("id"), "ticker", (F.col("p_partkey") % 5 + 2017).alias("year")).withColumn("report_id", _report("ticker", "year"))
    notes = asked.select("id", F.lit("df1").alias("variable"), F.lit(1).alias("var_no"), "report_id", F.lit("table").alias("kind"), F.lit("table_3").alias("name"), F.array(F.lit(3)).alias("fragments"))
    income = asked.filter("id % 4 <> 1").select("id", F.lit("df2").alias("variable"), F.lit(2).alias("var_no"), "report_id", F.lit("stmt").alias("kind"), F.lit("income").alias("name"), F.array(F.lit(1), F.lit(2)).alias("fragments"))
    return tier(facts, "facts"), tier(notes.unionByName(income), "plans"), tier(evidence, "evidence")


def _solved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, (facts, plan, evidence) = questions(spark, sf_dir), inputs(spark, sf_dir)
    return asked, plan, tier(solve.solve(asked, facts, plan, evidence, ORDER, ORDER), "solved")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'thu ' ELSE '' END || lower(p_name) || CASE WHEN p_partkey % 7 = 0 THEN ' truoc' ELSE '' END AS metric FROM part")
def question_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question asks for, when names, years, units and filler are taken out."""
    text = F.regexp_replace("question", " so với", "")
    return questions(spark, sf_dir).select("id", F.array_join(solve.metric_tokens(text, F.map_values("matched")), " ").alias("metric"))


@query(f"WITH {_SQL} SELECT q.id, coalesce(round(value / 1000, 2), 0.0) AS answer, tier, CASE tier WHEN 'facts' THEN 'df2' WHEN 'evidence' THEN 'df1' END AS variable, r.y::INTEGER AS year, label, code FROM q LEFT JOIN r USING (id)")
def answer_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions answered in one job: facts first, then evidence, else 0."""
    return _solved(spark, sf_dir)[2].drop("program")


@query("SELECT p_partkey AS id, 'income' AS statement FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 = 1")
def statement_gap_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose statement is not in their plan."""
    return solve.missing_statements(questions(spark, sf_dir), inputs(spark, sf_dir)[1])


_RECORD = """p AS (SELECT id, ticker || '_financial_statements_' || y || '_consolidated' AS report, has, coalesce(round(value / 1000, 2), 0.0) AS answer, tier FROM (SELECT id, ticker, q.y, q.has, r.value, r.tier FROM q LEFT JOIN r USING (id)))"""


@query(f"""WITH {_SQL}, {_RECORD} SELECT id, answer, answer <> 0 OR tier IS NOT NULL AS ok, report AS docs,
CASE tier WHEN 'facts' THEN report || '|table_3,' || report || '|table_1,' || report || '|table_2' WHEN 'evidence' THEN report || '|table_3' ELSE report || '|table_3' || CASE WHEN has THEN ',' || report || '|table_1,' || report || '|table_2' ELSE '' END END AS tables,
CASE WHEN tier = 'facts' THEN 'df2' WHEN tier = 'evidence' OR NOT has THEN 'df1' ELSE 'df1,df2' END AS variables FROM p""")
def submission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the evidence that their programs use, and the tables that belong to it."""
    asked, plan, solved = _solved(spark, sf_dir)
    results = plan.select("id", "report_id", F.col("var_no").alias("rank"))
    out = solve.submission(solve.records(asked, results, plan, solved))
    return out.select("id", "answer", "ok", F.array_join("relevant_docs", ",").alias("docs"), F.array_join("relevant_tables", ",").alias("tables"), F.array_join("evidence.variable", ",").alias("variables"))


@query(f"WITH {_SQL}, {_RECORD} SELECT count(*) AS n, round(avg(1 + has::INTEGER), 6) AS mean_evidence, round(avg((tier IS NOT NULL)::INTEGER), 6) AS mean_used, count(*) FILTER (WHERE tier IS NULL OR has)::BIGINT AS n_fewer FROM p")
def evidence_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of their entries programs use."""
    asked, plan, solved = _solved(spark, sf_dir)
    return solve.usage(solve.records(asked, plan.select("id", "report_id", F.col("var_no").alias("rank")), plan, solved))


@query("""WITH q AS (SELECT p_partkey AS id, split_part(p_brand, '#', 2)::INTEGER AS b, 2017 + p_partkey % 5 AS y FROM part),
t AS (SELECT id, y, 'B' || b AS ticker, id % 2 = 0 AS has FROM q WHERE id % 5 <> 0 UNION ALL SELECT id, y, 'B' || (b % 25 + 1), false FROM q WHERE id % 5 <> 0),
k AS (SELECT id, ticker, has, y + a.a AS y, r.n AS type_no, r.t AS type FROM t, (VALUES (0), (1)) a(a), (VALUES (0, 'consolidated'), (1, 'separate')) r(n, t) WHERE id % 4 > 1 OR r.n = id % 4),
m AS (SELECT DISTINCT 'B' || split_part(p_brand, '#', 2) AS ticker, year(l_shipdate) + 23 AS y, CASE WHEN l_linenumber % 2 = 0 THEN 'consolidated' ELSE 'separate' END AS type, CASE l_returnflag WHEN 'A' THEN 'balance_sheet' WHEN 'R' THEN 'income' ELSE 'cash_flow' END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (year(l_shipdate) + split_part(p_brand, '#', 2)::INTEGER * 3 + ascii(l_returnflag)) % 4 <> 0),
f AS (SELECT id, k.ticker, k.y, type_no, k.type, min(name) AS name FROM k JOIN m ON k.ticker = m.ticker AND k.y = m.y AND k.type = m.type WHERE (name <> 'cash_flow' OR id % 3 = 0) AND NOT (has AND name = 'income') GROUP BY ALL)
SELECT id, 'df' || (CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END + row_number() OVER (PARTITION BY id ORDER BY ticker, y, type_no)) AS variable, ticker || '_financial_statements_' || y || '_' || type AS report_id, name FROM f""")
def company_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the plans of questions about two brands lack, from the questions' text."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.split("p_brand", "#"), 2).cast("int").alias("b"), (F.col("p_partkey") % 5 + 2017).alias("y"))
    k, other = F.col("id"), (F.col("b") % 25 + 1).cast("string")
    text = F.concat(F.when(k % 3 == 0, "Dòng tiền").when(k % 3 == 1, "Doanh thu").otherwise("Số liệu"), F.when(k % 4 == 0, " hợp nhất").when(k % 4 == 1, " công ty mẹ").otherwise(""), F.lit(" của B"), F.col("b").cast("string"), F.when(k % 5 != 0, F.concat(F.lit(" và B"), other)).otherwise(""), F.lit(" năm "), F.col("y").cast("string"), F.lit(" và "), (F.col("y") + 1).cast("string"))
    stocks = part.select(F.concat(F.lit("B"), F.col("b").cast("string")).alias("ticker")).distinct().withColumn("company_name", F.concat(F.lit("Holding "), F.col("ticker")))
    asked = tier(entities.entities(part.select("id", text.alias("question")), stocks), "questions")
    report = lambda b: F.concat(F.lit("B"), b, F.lit("_financial_statements_"), F.col("y").cast("string"), F.lit("_consolidated"))
    plan = part.select("id", F.lit("df1").alias("variable"), F.lit(1).alias("var_no"), report(other).alias("report_id"), F.lit("table").alias("kind"), F.lit("table_3").alias("name"))
    plan = plan.unionByName(part.filter(k % 2 == 0).select("id", F.lit("df2").alias("variable"), F.lit(2).alias("var_no"), report(F.col("b").cast("string")).alias("report_id"), F.lit("stmt").alias("kind"), F.lit("income").alias("name")))
    items = table(spark, sf_dir, "lineitem").join(small(table(spark, sf_dir, "part")), F.col("l_partkey") == F.col("p_partkey")).withColumns({"b": F.element_at(F.split("p_brand", "#"), 2), "y": F.year("l_shipdate") + 23})
    kind = F.when(F.col("l_returnflag") == "A", "balance_sheet").when(F.col("l_returnflag") == "R", "income").otherwise("cash_flow")
    there = items.filter((F.year("l_shipdate") + F.col("b").cast("int") * 3 + F.ascii("l_returnflag")) % 4 != 0)
    merged = there.select(F.concat(F.lit("B"), F.col("b"), F.lit("_financial_statements_"), F.col("y").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "_consolidated").otherwise("_separate")).alias("report_id"), kind.alias("name"))
    return solve.fill_gaps(asked, plan, merged).select("id", "variable", "report_id", "name")


def _evidence_of_programs(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Tables of notes, and each company's facts of a year as its merged statement."""
    merged = facts.select("report_id", F.col("statement").alias("name"), F.col("item_label").alias("item"), F.col("item_code").alias("code"), F.col("year").alias("period"), "value", *ORDER)
    return evidence.unionByName(merged)


_VERDICT = f"""WITH {_SQL}, {_RECORD},
k AS (SELECT ticker || '_financial_statements_' || y || '_consolidated' AS report, bool_or(f = 'N') AS notes, bool_or(f <> 'N') AS income FROM l GROUP BY ALL),
b AS (SELECT p.*, id % 13 = 0 OR (tier IS NULL AND (NOT coalesce(notes, false) OR (has AND NOT coalesce(income, false)))) AS bad FROM p LEFT JOIN k USING (report)),
v AS (SELECT id, CASE WHEN bad THEN 'bad_path' WHEN id % 17 = 0 THEN 'crash' WHEN id % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN bad OR id % 17 = 0 THEN NULL ELSE answer END AS executed FROM b)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records some of which got another answer, a path that is none, or a program that is no lookup."""
    asked, (facts, plan, evidence) = questions(spark, sf_dir), inputs(spark, sf_dir)
    solved = tier(solve.solve(asked, facts, plan, evidence, ORDER, ORDER), "solved")
    made = solve.submission(solve.records(asked, plan.select("id", "report_id", F.col("var_no").alias("rank")), plan, solved))
    k = F.col("id")
    made = made.withColumns({
        "answer": F.col("answer") + F.when(k % 11 == 0, 1).otherwise(0),
        "evidence": F.when(k % 13 == 0, F.transform("evidence", lambda e: F.struct(e["variable"].alias("variable"), F.concat(F.lit("../"), e["csv_path"]).alias("csv_path")))).otherwise(F.col("evidence")),
        "program": F.when(k % 17 == 0, "select max(value) as result from df1").otherwise(F.col("program")),
    })
    return rerun.verdicts(tier(made, "records"), tier(_evidence_of_programs(facts, evidence), "evidence-of-programs"), ORDER)


@query(f"{_VERDICT} SELECT id, status, executed FROM v")
def program_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's program run again over its evidence, all in one job."""
    return _verdicts(spark, sf_dir).select("id", "status", "executed")


@query(f"""{_VERDICT} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok')::BIGINT AS ok, count(*) FILTER (WHERE status = 'crash')::BIGINT AS crash, count(*) FILTER (WHERE status = 'mismatch')::BIGINT AS mismatch, count(*) FILTER (WHERE status = 'bad_path')::BIGINT AS bad_path, 0::BIGINT AS no_evidence FROM v""")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerun.summary(_verdicts(spark, sf_dir))


@query("SELECT o_custkey AS report_id, (o_orderkey % 9)::INTEGER AS table_no, max(o_orderpriority) AS statement FROM orders GROUP BY ALL")
def table_to_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's statement, the last of several."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderpriority").alias("statement"), (F.col("o_orderkey") % 9).cast("int").alias("t"))
    return solve.table_statements(orders.groupBy("report_id", "statement").agg(F.collect_set("t").alias("table_nos")))


@query("SELECT l_orderkey AS report_id, l_linenumber AS table_no, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (o_orderkey, o_custkey % 7 + 1) FROM orders)")
def facts_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of one table of each report."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("table_no"), "l_partkey")
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 7 + 1).alias("table_no"))
    return solve.table_facts(tables, rows)


@query("SELECT p_partkey, 'R' || p_partkey AS report_id, CASE p_partkey % 3 WHEN 0 THEN 'table_' || p_size WHEN 1 THEN 'income' ELSE 'cash_flow' END AS item FROM part")
def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of evidence, made and taken apart."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("table_"), F.col("p_size").cast("string"))).when(k % 3 == 1, "income").otherwise("cash_flow")
    paths = table(spark, sf_dir, "part").select("p_partkey", solve.evidence_path(F.concat(F.lit("R"), k.cast("string")), name).alias("path"))
    return paths.select("p_partkey", solve.evidence_source("path").alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, left('B' || p_partkey || '|table_' || p_size || ' | ' || CASE WHEN p_size > 25 THEN 'income' ELSE 'thuyet minh' END || ' | ' || p_type || ' | ' || p_name, 40) AS doc FROM part")
def rerank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"r": F.concat(F.lit("B"), F.col("p_partkey").cast("string")), "s": F.when(F.col("p_size") > 25, "income")})
    return part.select("p_partkey", solve.rerank_text("r", "p_size", "s", "p_type", "p_name", 40).alias("doc"))


@query("""WITH e AS (SELECT l_suppkey AS report_id, l_returnflag AS name, p_name AS item, CASE WHEN l_linenumber < 3 THEN l_linenumber::VARCHAR ELSE '' END AS code, year(l_shipdate)::INTEGER AS period, l_orderkey::BIGINT * 1000 + l_linenumber AS o, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT report_id, name, item, code, period, o FROM e QUALIFY row_number() OVER (PARTITION BY report_id, name, o ORDER BY l_partkey) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY report_id, name ORDER BY o) AS n FROM u)
SELECT report_id, name, string_agg(item || ' | ' || code || ' | ' || period || ' | ' || o, chr(10) ORDER BY o) FILTER (WHERE n <= 8) AS sample FROM t GROUP BY ALL""")
def table_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each table, as text."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    o = F.col("l_orderkey").cast("long") * 1000 + F.col("l_linenumber")
    rows = items.select(F.col("l_suppkey").alias("report_id"), F.col("l_returnflag").alias("name"), "p_name", "l_linenumber", F.year("l_shipdate").alias("period"), "l_partkey", o.alias("o"))
    once = rows.groupBy("report_id", "name", "o", "l_linenumber").agg(F.min_by(F.struct("p_name", "period"), "l_partkey").alias("r"))
    evidence = once.select("report_id", "name", F.lit("table").alias("kind"), F.col("r.p_name").alias("item"), F.when(F.col("l_linenumber") < 3, F.col("l_linenumber").cast("string")).otherwise("").alias("code"), F.col("r.period").alias("period"), F.col("o").alias("value"), "o")
    return solve.cards(evidence, "o").select("report_id", "name", "sample")
