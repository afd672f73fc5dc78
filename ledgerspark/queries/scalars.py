"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, periods, text
from ..operators import entities
from ..registry import query
from ..sources.readers import table

#: DuckDB's side of label normalisation.
NORMAL = "trim(regexp_replace(replace(lower(strip_accents({0})), 'đ', 'd'), '[\\s\\x{{A0}}]+', ' ', 'g'))"
_COMPACT = "trim(regexp_replace(" + NORMAL + ", '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_filter(string_split(" + _COMPACT + ", ' '), lambda t: t <> '')"


@query(f"SELECT doc_id, {NORMAL.format('text')} AS label FROM documents")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_label("text").alias("label"))


@query(f"SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens("text")).alias("token"))
    per_doc = each.groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(f"SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 2097152 AS bucket, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL")
def tf_hash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import term_counts

    return term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS vn, -round(l_extendedprice, 2) AS negative, round(l_extendedprice, 2) AS en, NULL::DOUBLE AS dash FROM lineitem")
def vn_number_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in Vietnamese and English style, parsed back."""
    vn, en = numeric.format_vn("l_extendedprice", 2), F.format_number("l_extendedprice", 2)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", numeric.parse_vn_number(vn).alias("vn"), numeric.parse_vn_number(F.concat(F.lit("( "), vn, F.lit(")"))).alias("negative"), numeric.parse_number(en, ",", ".").alias("en"), numeric.parse_vn_number(F.lit("–")).alias("dash"))


@query("SELECT l_returnflag, CASE WHEN count(*) FILTER (WHERE l_linenumber > 2 AND l_extendedprice >= 1000) > count(*) FILTER (WHERE l_linenumber <= 2 AND l_extendedprice >= 1000) THEN 'en' ELSE 'vi' END AS fmt FROM lineitem GROUP BY l_returnflag")
def number_format_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("l_linenumber") > 2, F.format_number("l_extendedprice", 2)).otherwise(numeric.format_vn("l_extendedprice", 2))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", shown.alias("c")).groupBy("l_returnflag").agg(numeric.number_format_votes("c").alias("fmt"))


_UNIT = "CASE o_orderkey % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 WHEN 2 THEN 1e3 WHEN 3 THEN 1.0 ELSE 1e12 END"


@query(f"SELECT o_orderkey, {_UNIT} AS factor, round(o_totalprice * {_UNIT}, 0) AS value FROM orders")
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in header cells and in unit lines, applied to prices."""
    names = F.array(*(F.lit(x) for x in ("31/12/2022Triệu VND", "2018 Tỷ đồng", "Nghìn VND", "2018VND", "nghìn tỷ đồng")))
    label = F.get(names, (F.col("o_orderkey") % 5).cast("int"))
    line = F.concat(F.lit("Công ty\nĐơn vị tính: "), F.get(F.array(*(F.lit(x) for x in ("Triệu đồng Việt Nam", "tỷ đồng", "Nghìn đồng", "VND", "nghìn tỷ đồng"))), (F.col("o_orderkey") % 5).cast("int")))
    found = F.when(F.col("o_orderkey") % 2 == 0, numeric.unit(F.array(F.lit("Mã số"), label), F.lit(""))).otherwise(numeric.unit(F.array(F.lit("Mã số")), line))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["factor"].alias("factor"), F.round(F.col("o_totalprice") * found["factor"], 0).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'restated_cur' WHEN o_orderkey % 3 = 1 THEN 'flow_year' WHEN day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN 'year_start' ELSE 'year_end' END AS key,
  (year(o_orderdate) + 20)::INTEGER AS year, CASE WHEN o_orderkey % 3 = 0 AND day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN NULL ELSE year(o_orderdate) + 20 END::INTEGER AS period FROM orders""")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.year("o_orderdate") + 20).cast("string")
    date = F.concat_ws("/", F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), y)
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(date, F.lit(" VND"))).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit("VND"))).otherwise(F.concat(F.lit("31/12/"), y, F.lit("Triệu VND(trình bày lại)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("c")).select("o_orderkey", periods.parse_period("c")["key"].alias("key"), periods.parse_period("c")["year"].alias("year"), periods.period_year("c", F.lit(0)).alias("period"))


@query("SELECT p_partkey, CASE WHEN p_partkey < 10000 THEN true ELSE false END AS vas, p_partkey < 100 AS bank FROM part")
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", periods.is_vas_code(c).alias("vas"), periods.is_bank_code(c).alias("bank"))


@query("""SELECT o_orderkey, list_transform(range(greatest(year(o_orderdate) + 20, 2015), least(year(o_orderdate) + 23, 2025) + 1), lambda y: y::INTEGER)::VARCHAR AS years FROM orders""")
def year_extract_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of years in questions, expanded within the corpus' years."""
    a = F.year("o_orderdate") + 20
    q = F.concat(F.lit("Doanh thu giai đoạn "), a.cast("string"), F.lit("–"), (a + 3).cast("string"), F.lit(" là bao nhiêu?"))
    years = entities.years(q)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(years.cast("array<string>"), ", "), F.lit("]")).alias("years"))


_KINDS = ["Lợi nhuận sau thuế", "Lưu chuyển tiền thuần", "Tổng tài sản", "Số nhân viên"]


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'income' WHEN 1 THEN 'cash_flow' WHEN 2 THEN 'balance_sheet' END AS statement, CASE WHEN o_orderkey % 2 = 0 THEN 'separate' ELSE 'consolidated' END AS report_type,
  CASE o_orderkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e12 ELSE 1.0 END AS factor, o_orderkey % 5 = 0 AS complex FROM orders""")
def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement, report type, unit and complexity of questions made of orders."""
    k = F.col("o_orderkey")
    pick = lambda words, n: F.get(F.array(*(F.lit(w) for w in words)), (k % n).cast("int"))
    q = F.concat_ws(" ", pick(_KINDS, 4), pick(["của công ty mẹ", "hợp nhất"], 2), pick(["cao nhất", "năm 2020", "cuối kỳ", "đầu kỳ", "tháng 1"], 5), F.lit("là bao nhiêu"), pick(["triệu đồng?", "nghìn tỷ đồng?", "?"], 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q")).select("o_orderkey", entities.statement_hint("q").alias("statement"), entities.report_type("q").alias("report_type"), entities.unit("q")["factor"].alias("factor"), entities.is_complex("q").alias("complex"))


@query("""SELECT o_orderkey, 'C' || o_custkey AS ticker, year(o_orderdate)::INTEGER AS year, 'separate' AS report_type, year(o_orderdate)::INTEGER AS first_year FROM orders""")
def report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("_financial_statements_"), F.year("o_orderdate").cast("string"), F.lit("_separate_1"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("r"))
    return rows.select("o_orderkey", text.report_parts("r")["ticker"].alias("ticker"), text.report_parts("r")["year"].alias("year"), text.report_type("r").alias("report_type"), text.first_year("r").alias("first_year"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"[^\"]*\"'))::INTEGER AS links FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.size(F.regexp_extract_all(F.col("html"), F.lit('<a href="[^"]*"'), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"))
