"""Windows, deduplication, unpivoting and joins, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import entities, facts
from ..registry import query
from ..sources.readers import table


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN event_type = 'error' OR before = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT user_id, island::BIGINT AS island, event_type, count(*)::BIGINT AS n FROM s WHERE event_type <> 'error' GROUP BY ALL""")
def fragment_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one type are one fragment; an error breaks it."""
    layout = F.struct(F.array(F.lit(1)).alias("period_cols"), F.lit(0).alias("code_col"), F.lit(0).alias("label_col"))
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    tables = table(spark, sf_dir, "events").select(F.col("user_id").alias("report_id"), F.struct("ts", "event_id").alias("table_no"), kind.alias("statement"), layout.alias("layout"))
    counts = facts.fragments(tables).groupBy("report_id", "asset", "statement").agg(F.count("*").alias("n"))
    island = F.row_number().over(Window.partitionBy("report_id").orderBy("asset")).cast("long")
    return counts.select(F.col("report_id").alias("user_id"), island.alias("island"), F.col("statement").alias("event_type"), "n")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def label_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", facts.carry_forward("v", ["user_id"], ["ts", "event_id"]).alias("carried"))


_PLACE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY l_returnflag = 'N' OR row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_PLACE}) = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = facts.first_wins(rows, ["l_orderkey", "l_returnflag"], _PLACE.split(", "), F.col("l_returnflag") == "N")
    return out.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, item, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME item VALUE value) WHERE value <> 0")
def unpivot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "item", "value")
    return long.filter("value <> 0")


@query("WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, round(o_totalprice, 2) AS stated, total FROM orders JOIN s ON o_orderkey = l_orderkey WHERE abs(o_totalprice - total) > 1")
def cross_foot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two totals of a key, stated and summed, as codes of one statement."""
    row = lambda key, code, value: [F.col(key).alias("report_id"), F.lit("balance_sheet").alias("statement"), F.lit(code).alias("item_code"), F.lit("all").alias("period_key"), F.lit(1).alias("ord"), value.alias("value")]
    stated = table(spark, sf_dir, "orders").select(*row("o_orderkey", "270", F.col("o_totalprice")))
    summed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).select(*row("l_orderkey", "440", F.col("total")))
    out = facts.cross_foot(stated.unionByName(summed))
    return out.select(F.col("report_id").alias("o_orderkey"), F.round("left_total", 2).alias("stated"), F.col("right_total").alias("total"))


@query("SELECT p_type, string_agg(p_brand, '|' ORDER BY o) AS labels FROM (SELECT p_type, p_brand, min(p_partkey) AS o FROM part GROUP BY ALL) GROUP BY p_type")
def ordered_distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.ordered_labels(table(spark, sf_dir, "part"), ["p_type"], "p_brand", "p_partkey")
    return out.select("p_type", F.array_join("labels", "|").alias("labels"))


@query("SELECT o_orderkey, bool_or(o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS has_open, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS has_final FROM orders")
def flags_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key has rows of either kind, as report types of a company."""
    kind = F.when(F.col("o_orderstatus") == "O", "consolidated").when(F.col("o_orderstatus") == "F", "separate").otherwise("aggregated")
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"), kind.alias("report_type"))
    stocks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("company_name"))
    return facts.documents(reports, stocks).select(F.col("report_id").alias("o_orderkey"), F.col("has_consolidated").alias("has_open"), F.col("has_separate").alias("has_final"))


@query("SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('O', 'F') AND o_totalprice > 1000")
def facts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that reach the scan."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("year"), F.col("o_totalprice").alias("total"))
    return facts.filter_facts(rows, 7, ["O", "F"]).filter("total > 1000").select("key", "total")


_NAMES = "regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')"


@query("""WITH p AS (SELECT DISTINCT lower(p_name) AS pattern FROM part), q AS (SELECT p_partkey, lower(p_name) || ' of ' || lower(p_type) AS q FROM part)
SELECT p_partkey, pattern, (len(string_split(split_part(' ' || q || ' ', ' ' || pattern || ' ', 1), ' ')) - 1)::INTEGER AS at FROM q JOIN p ON contains(' ' || q || ' ', ' ' || pattern || ' ')""")
def entity_pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts found in texts, by an equi-join of word runs."""
    part = table(spark, sf_dir, "part")
    patterns = part.select(F.lower("p_name").alias("pattern")).distinct().withColumns({"ticker": F.lit(""), "kind": F.lit("name")})
    texts = part.select("p_partkey", F.concat(F.lower("p_name"), F.lit(" of "), F.lower("p_type")).alias("q"))
    return entities.phrase_hits(texts, patterns, "p_partkey", "q").select("p_partkey", "pattern", "at")


@query("SELECT p_partkey, split_part(lower(p_type), ' ', 1) AS ticker FROM part")
def span_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short name inside a longer one's span does not count, elsewhere it does."""
    part = table(spark, sf_dir, "part")
    texts = part.select("p_partkey", F.concat(F.lower("p_name"), F.lit(" and "), F.element_at(F.split(F.lower("p_type"), " "), 1)).alias("q"))
    whole = part.select(F.lower("p_name").alias("pattern")).distinct().withColumns({"ticker": F.col("pattern"), "kind": F.lit("name")})
    short = part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1))), " ")).alias("pattern")).distinct().withColumns({"ticker": F.col("pattern"), "kind": F.lit("ticker")})
    hits = entities.suppress_inside(entities.phrase_hits(texts, whole.unionByName(short), "p_partkey", "q"), "p_partkey")
    return hits.filter("kind = 'ticker' and pattern <> 'and'").select("p_partkey", "ticker")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, where there is a supplier in their nation."""
    from ..operators.answer import gaps

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    have = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("k")).select("k", "n").distinct()
    nations = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")).distinct()
    return gaps(c, have, c.join(nations, "n", "left_semi"), ["k", "n"]).select(F.col("k").alias("c_custkey"))


@query("""SELECT c_custkey AS id, p AS name FROM customer JOIN (SELECT DISTINCT c_nationkey, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey) USING (c_nationkey)
EXCEPT SELECT o_custkey, o_orderpriority FROM orders""")
def statement_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of orders that occur in a customer's nation, but not for the customer."""
    from ..operators.answer import gaps

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    needed = people.join(people.join(have, "id").select("c_nationkey", "name").distinct(), "c_nationkey")
    return gaps(needed, have, needed, ["id", "name"])
