"""Packaging and figures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import package
from ..registry import query
from ..sources.readers import table


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("event_id").alias("o"))
    return package.last_records(events, "user_id", "o").drop("o")


@query("SELECT c_custkey AS id, coalesce(max(o_totalprice), 0.0) AS answer, coalesce(max(o_orderstatus), 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("answer"), F.max("o_orderstatus").alias("status"))
    return package.fill_missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), have, "id", {"answer": 0.0, "status": "none"})


@query("SELECT o_orderkey, 'df' || (o_orderkey % 4 + 1) || CASE WHEN o_orderkey % 4 + 1 <> o_orderkey % 3 + 1 THEN ',df' || (o_orderkey % 3 + 1) ELSE '' END AS used, CASE WHEN o_orderkey % 4 + 1 = 2 OR o_orderkey % 3 + 1 = 2 THEN 1 ELSE 0 END::INTEGER AS kept FROM orders")
def unused_input_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of programs that the programs name."""
    k = F.col("o_orderkey")
    program = F.concat(F.lit("select a.value - b.value from df"), (k % 4 + 1).cast("string"), F.lit(" a join df"), (k % 3 + 1).cast("string"), F.lit(" b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", program.alias("p"), F.array(F.struct(F.lit("df2").alias("variable")), F.struct(F.lit("df9").alias("variable"))).alias("e"))
    return rows.select("o_orderkey", F.array_join(package.used_variables("p"), ",").alias("used"), F.size(package.prune_inputs(F.col("e"), "p")).alias("kept"))


@query("""WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS answer FROM lineitem GROUP BY l_orderkey)
SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN answer IS NULL THEN 'crash' WHEN abs(o_totalprice - answer) <= 50000 THEN 'ok' ELSE 'mismatch' END AS status FROM orders LEFT JOIN s ON o_orderkey = l_orderkey) GROUP BY status""")
def validate_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals against recomputed ones, by status."""
    executed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("answer"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("answer"))
    return package.validate(stored, executed, "id", 50_000).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT (list_sort(list(value)))[(count(*) // 2 + 1)::INTEGER] AS median, (list_sort(list(value)))[(floor(0.95 * count(*)) + 1)::INTEGER] AS p95 FROM events WHERE value IS NOT NULL")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and 95th percentile of latencies."""
    return package.latency(table(spark, sf_dir, "events"), "value")


@query("""SELECT b AS bucket, count(event_id)::BIGINT AS n FROM (SELECT unnest(['large', 'middle', 'small', 'negative']) AS b) LEFT JOIN events ON b = CASE WHEN value < 0 THEN 'negative' WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'middle' ELSE 'large' END GROUP BY b""")
def method_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("value") < 0, "negative").when(F.col("value") < 10, "small").when(F.col("value") < 100, "middle").otherwise("large")
    return package.histogram(table(spark, sf_dir, "events"), bucket, ["large", "middle", "small", "negative"])


@query("""SELECT 'huge' AS rule, count(*) FILTER (WHERE NOT coalesce(value <= 100, false))::BIGINT AS n FROM events UNION ALL SELECT 'negative', count(*) FILTER (WHERE NOT coalesce(value >= 0, false))::BIGINT FROM events
UNION ALL SELECT 'json', count(*) FILTER (WHERE NOT coalesce(regexp_matches(props, '^\\{"k": [0-9]+\\}$'), false))::BIGINT FROM events""")
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"huge": F.col("value") <= 100, "negative": F.col("value") >= 0, "json": F.col("props").rlike(r'^\{"k": [0-9]+\}$')}
    return package.violations(table(spark, sf_dir, "events"), rules)


@query("""SELECT (SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+$'))::BIGINT AS bad_names, (SELECT count(*) - count(DISTINCT c_custkey) FROM customer)::BIGINT AS repeated, (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey)::BIGINT AS orphans,
 (SELECT min(o_orderkey) FROM orders) AS least, (SELECT max(o_orderkey) FROM orders) AS largest""")
def format_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, uniqueness, references and range of keys."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    names = customer.agg(F.count_if(~F.col("c_name").rlike("^Customer#[0-9]+$")).alias("bad_names"), (F.count("*") - F.count_distinct("c_custkey")).alias("repeated"))
    orphans = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))
    return names.crossJoin(orphans).crossJoin(orders.agg(F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("largest")))  # of one row each


@query("SELECT o_orderkey, 'R' || o_custkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'table_' || (o_orderkey % 7) ELSE (o_orderkey % 3)::VARCHAR END AS ref FROM orders")
def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("r"), (F.col("o_orderkey") % 7).alias("t"), (F.col("o_orderkey") % 3).alias("l"))
    return rows.select("o_orderkey", package.table_reference("r", "t", "l").alias("ref"))


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS r, count(*) FILTER (WHERE o_orderstatus = 'F') AS t, count(*) FILTER (WHERE o_orderstatus = 'P') AS y FROM orders GROUP BY 1)
SELECT count(*) AS n, round(avg((coalesce(r, 0) > 0)::INTEGER), 6) AS coverage, round(avg((coalesce(t, 0) > 0)::INTEGER), 6) AS ticker_rate, round(avg((coalesce(y, 0) > 0)::INTEGER), 6) AS year_rate, round(avg(coalesce(r, 0)), 6) AS mean_facts FROM customer LEFT JOIN n ON k = c_custkey""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over customers as questions, with their orders as results."""
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_results"), of("F").alias("n_tickers"), of("P").alias("n_years"))
    joined = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    return package.run_metrics(joined.withColumn("n_facts", F.coalesce("n_results", F.lit(0))))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END AS answer FROM orders ORDER BY o_orderstatus <> 'P', md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def record_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred records, those with an answer first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0).alias("answer"))
    return package.sample_records(rows)


@query("SELECT page_id % 7 AS kind, count(*) AS n_reports, sum(len(regexp_extract_all(coalesce(html, ''), '(?i)<table\\b')))::BIGINT AS n_tables FROM pages GROUP BY 1")
def page_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("kind"), "html")
    return package.table_counts(pages, "kind", "html")


@query("SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || ' ' || lower(p_type) AS metric, p_retailprice + 1000 AS number, [p_partkey, p_size]::INTEGER[]::VARCHAR AS ids, left('B' || chr(10) || p_name, 9) AS chunk FROM part WHERE len(split_part(p_name, ' ', 1)) >= 3 AND NOT contains(p_type, ' ')")
def small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question tokens, numbers of programs, lists of numbers and chunks of search texts."""
    from ..functions import numeric, text
    from ..operators import grid, retrieval

    first = F.element_at(F.split("p_name", " "), 1)
    part = table(spark, sf_dir, "part").filter((F.length(first) >= 3) & ~F.contains("p_type", F.lit(" ")))
    ids = F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit(", "), F.col("p_size").cast("string"), F.lit("]"))
    question = F.concat(F.lit("What is 2020 of "), first, F.lit(" "), F.col("p_type"))
    metric = text.metric_tokens(question, ["what"])
    number = numeric.to_number(F.format_number(F.col("p_retailprice") + 1000, 2))
    chunk = text.truncate(retrieval.chunk_text([F.lit("B"), F.lit(" "), F.lit(None).cast("string"), F.col("p_name")], 50), 9)
    return part.select("p_partkey", F.array_join(metric, " ").alias("metric"), number.alias("number"), grid.int_list(ids).cast("string").alias("ids"), chunk.alias("chunk"))
