"""Answering over the given tables: scores, tiers, plans, derived figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import answer
from ..registry import query
from ..sources.readers import table


@query("""WITH q AS (SELECT DISTINCT p_brand AS brand, split_part(min(p_name), ' ', 1) AS word FROM part GROUP BY p_brand),
s AS (SELECT brand, p_partkey, len(list_filter([word, 'bolt'], lambda m: list_contains(string_split(lower(p_name), ' '), m))) / 2.0 * 0.8 - least(0.25, (len(list_distinct(string_split(lower(p_name), ' '))) / 2.0 - 1.0) * 0.1) + CASE WHEN p_size > 25 THEN 0.15 ELSE 0 END AS score FROM q JOIN part ON p_brand = brand)
SELECT brand, p_partkey, round(score, 6) AS score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY round(score, 6) DESC, p_partkey) = 1""")
def label_score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each brand whose name matches two words best, with a bonus for large ones."""
    part = table(spark, sf_dir, "part")
    words = part.groupBy("p_brand").agg(F.element_at(F.split(F.min("p_name"), " "), 1).alias("word"))
    score = answer.label_score(tokens("p_name"), F.array("word", F.lit("bolt")), F.col("p_size") > 25)
    scored = part.join(words, "p_brand").select(F.col("p_brand").alias("brand"), "p_partkey", F.round(score, 6).alias("score"))
    return answer.best_match(scored, "brand", ["p_partkey"])


@query("""WITH f AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), e AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, coalesce(round(coalesce(f.v, e.v) / 1000, 2), 0.0) AS answer, CASE WHEN f.v IS NOT NULL THEN 'facts' WHEN e.v IS NOT NULL THEN 'evidence' END AS tier FROM customer LEFT JOIN f ON f.k = c_custkey LEFT JOIN e ON e.k = c_custkey""")
def tier_fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    best = lambda s: orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))
    questions = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1000.0).alias("unit_factor"))
    return answer.tiered(questions, best("P"), best("F"), "c_custkey")


@query("""WITH r AS (SELECT o_custkey AS qid, o_orderstatus AS report_id, (o_orderkey % 4)::INTEGER AS table_no, min(o_orderkey) AS rank FROM orders GROUP BY ALL),
n AS (SELECT qid, report_id, CASE WHEN table_no < 2 THEN 'stmt' ELSE 'table' END AS kind, CASE WHEN table_no < 2 THEN 'income' ELSE 'table_' || table_no END AS name, min(rank) AS rank FROM r GROUP BY ALL)
SELECT qid, 'df' || row_number() OVER (PARTITION BY qid ORDER BY rank, report_id, name) AS variable, report_id, kind, name FROM n""")
def evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked tables of each customer, merged statements once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("report_id"), (F.col("o_orderkey") % 4).cast("int").alias("table_no"), "o_orderkey")
    results = orders.groupBy("qid", "report_id", "table_no").agg(F.min("o_orderkey").alias("rank"))
    statements = orders.select("report_id", "table_no").distinct().filter("table_no < 2").withColumn("statement", F.lit("income"))
    return answer.plan_evidence(results, statements).drop("var_no")


@query("""WITH p AS (SELECT o_custkey AS qid, o_orderkey AS var_no, o_orderstatus AS company, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'stmt' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'income' ELSE 'cash_flow' END AS name FROM orders),
g AS (SELECT qid, count(*) > 6 AND count(DISTINCT company) >= 2 AND bool_or(kind = 'stmt') AS large FROM p GROUP BY qid)
SELECT qid, var_no, company, kind, name FROM p JOIN g USING (qid) QUALIFY NOT large OR (kind = 'stmt' AND row_number() OVER (PARTITION BY qid, company, kind, name ORDER BY var_no) = 1)""")
def compact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of several companies, without what they can do without."""
    k = F.col("o_orderkey")
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), k.alias("var_no"), F.col("o_orderstatus").alias("company"), F.when(k % 3 == 0, "table").otherwise("stmt").alias("kind"), F.when(k % 2 == 0, "income").otherwise("cash_flow").alias("name"))
    return answer.compact_plan(plan, "qid", "company")


_YEARLY = """y AS (SELECT n_name AS entity, year(o_orderdate)::INTEGER AS period, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("entity"), F.year("o_orderdate").alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


@query(f"WITH {_YEARLY}, l AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY period) AS previous FROM y) SELECT entity, period, value, previous, round((value - previous) / nullif(abs(previous), 0) * 100, 2) AS growth_pct FROM l")
def growth_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.growth(_yearly(spark, sf_dir), "entity", "period", "value")


@query(f"WITH {_YEARLY} SELECT a.entity, a.period, round(a.value / nullif(b.value, 0), 4) AS share, round(abs(a.value - b.value), 2) AS difference FROM y a JOIN y b ON b.entity = (SELECT min(n_name) FROM nation) AND b.period = a.period")
def ratio_and_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's yearly figure against one other's."""
    y = _yearly(spark, sf_dir)
    first = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("entity"))
    other = y.join(first, "entity").select("period", F.col("value").alias("other"))
    return y.join(other, "period").select("entity", "period", answer.ratio("value", "other").alias("share"), F.round(F.abs(F.col("value") - F.col("other")), 2).alias("difference"))


@query(f"WITH {_YEARLY} SELECT period, entity, value FROM y QUALIFY row_number() OVER (PARTITION BY period ORDER BY value DESC, entity) = 1")
def argmax_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.arg_best(_yearly(spark, sf_dir), "period", "entity", "value")


@query(f"WITH {_YEARLY} SELECT entity, round(avg(value), 2) AS mean, round(sum(value::DECIMAL(18, 2)), 2)::DOUBLE AS total, count(*)::BIGINT AS n FROM y GROUP BY entity")
def period_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return _yearly(spark, sf_dir).groupBy("entity").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(total, 2).alias("total"), F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, round(arg_min(l_extendedprice, l_linenumber * 1000000 + l_partkey) / 1000, 2) AS result FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def lookup_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup program's plan for every order at once: the first value, over the unit."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumn("ord", F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.min_by("l_extendedprice", "ord") / 1000, 2).alias("result"))
