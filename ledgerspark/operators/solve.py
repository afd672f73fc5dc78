"""From questions with entities to answers and records, all questions in one job.

Questions: id, question, tickers, matched, years, report_type, statement, unit_factor, complex (see `entities.entities`).
Facts: report_id, ticker, year, report_type, statement, item_label, item_code, value and columns of an order.
Plan: id, variable, var_no, report_id, kind (stmt, table), name (see `answer.plan_evidence`).
Evidence: report_id, name, item, code, period, value and columns of an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, clean_label, col, normalize_label
from ..plans.storage import shuffled
from . import matching
from .answer import best_match, tiered
from .entities import UNITS
from .package import prune_inputs, used_variables

#: Words of a question that do not name its figure.
FILLER = """
cua trong nam la bao nhieu con ty me hop nhat rieng le cuoi dau ngay thang gio
do cac ai cong ty doanh nghiep ngan hang tmcp tct cty tap doan sacom vj
tong so du ton cuoi ky dau ky vnd dong trieu ty nghin duoc va cho voi
noi bo ctcp ket qua hoat dong bieu hien tai san co dinh vo von cong ty me
""".split()
#: A card's rows, and its codes with labels, for single tables and for merged statements.
SAMPLE_ROWS, TABLE_HINTS, STATEMENT_HINTS = 8, 25, 400


def metric_tokens(question: ColumnLike, names: Column) -> Column:
    """Tokens that name the figure: without the companies' names as found, tickers in parentheses, years, units and filler.
    Repeats stay. names: array of normalised names; null removes nothing."""
    text = F.aggregate(F.coalesce(names, F.array().cast("array<string>")), normalize_label(question), lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), n, F.lit(r"\E(?![a-z0-9])")), F.lit(" ")))
    text = F.regexp_replace(text, r"\(\s*[a-z]{2,4}[0-9]?\s*\)|(?<!\d)20\d\d(?!\d)", " ")
    for label in UNITS:
        text = F.replace(text, F.lit(f" {label} "), F.lit(" "))
    filler = F.array(*(F.lit(w) for w in dict.fromkeys(FILLER)))
    return F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~F.array_contains(filler, w))


def simple_lookups(questions: DataFrame) -> DataFrame:
    """The questions that ask for one figure of one company: id, ticker, year (the latest), years, report_type, statement,
    unit_factor, metric."""
    out = questions.filter((F.size("tickers") == 1) & ~F.col("complex") & (F.size("years") > 0))
    out = out.select("id", F.col("tickers")[0].alias("ticker"), F.array_max("years").alias("year"), "years", "report_type", "statement", "unit_factor", metric_tokens("question", F.map_values("matched")).alias("metric"))
    return out.filter(F.size("metric") > 0)


def statement_variables(lookups: DataFrame, plan: DataFrame) -> DataFrame:
    """id and variable: the first merged statement of the plan that is the question's, of its company and report type."""
    stmt = plan.filter("kind = 'stmt'").select("id", "variable", "var_no", "report_id", F.col("name").alias("statement"))
    joined = lookups.select("id", "ticker", "report_type", "statement").join(shuffled(stmt), ["id", "statement"])
    fits = F.contains("report_id", "ticker") & (F.col("report_type").isNull() | F.contains("report_id", "report_type"))
    return joined.filter(fits).groupBy("id").agg(F.min_by("variable", "var_no").alias("variable"))


def _words(label: Column) -> Column:
    return F.filter(F.split(label, " "), lambda t: t != "")


def fact_candidates(lookups: DataFrame, facts: DataFrame, order: list[str]) -> DataFrame:
    """Pairs of questions with a statement and facts' labels of their company, statement, one of their years and their type."""
    keys = ["ticker", "statement", "year"]
    f = facts.select(*keys, F.col("report_type").alias("type"), F.col("item_label").alias("label"), F.coalesce("item_code", F.lit("")).alias("code"), "value", *order)
    index = matching.label_index(f, [*keys, "type"], _words(F.col("label")), F.col("code") != "", order, ["type", "year", "label", "code", "value"])
    asks = lookups.filter("statement is not null").select(F.struct("id", "report_type").alias("ask"), "ticker", "statement", F.explode(F.array_distinct("years")).alias("year"), "metric")
    return matching.candidates(asks, index, keys).filter(F.col("ask.report_type").isNull() | (F.col("ask.report_type") == F.col("first.type")))


def match_facts(lookups: DataFrame, facts: DataFrame, order: list[str]) -> DataFrame:
    """id, score, label, code, period, value: the fact of the question's company, years, type and statement whose label fits
    best. Questions without statement have none."""
    pairs = matching.scored(fact_candidates(lookups, facts, order))
    best = best_match(pairs.select("ask.id", "score", "first.*"), "id", order)
    return best.select("id", "score", "label", "code", F.col("year").alias("period"), "value")


def match_evidence(lookups: DataFrame, plan: DataFrame, evidence: DataFrame, order: list[str]) -> DataFrame:
    """id, score, variable, label, code, period, value: the row of the question's year, in the tables of its plan, whose
    label fits best; codes do not count here."""
    keys = ["report_id", "name", "year"]
    rows = evidence.select("report_id", "name", F.col("item").alias("label"), F.coalesce("code", F.lit("")).alias("code"), F.col("period").alias("year"), "value", *order)
    index = matching.label_index(rows, keys, _words(normalize_label("label")), F.lit(False), order, ["label", "code", "value"])
    wanted = lookups.select("id", "year", "metric").join(shuffled(plan.select("id", "variable", "var_no", "report_id", "name")), "id")
    asks = wanted.select(F.struct("id", "variable", "var_no").alias("ask"), *keys, "metric")
    pairs = matching.scored(matching.candidates(asks, index, keys, bonus=False))
    best = best_match(pairs.select("ask.*", "score", F.col("year").alias("period"), "first.*"), "id", ["var_no", *order])
    return best.select("id", "score", "variable", "label", "code", "period", "value")


def solve(questions: DataFrame, facts: DataFrame, plan: DataFrame, evidence: DataFrame, facts_order: list[str], evidence_order: list[str]) -> DataFrame:
    """id, answer, tier, variable, year, label, code, program for every question. A fact counts if its merged statement is
    in the plan; else the evidence's best row; else the answer is 0 without tier or program. Null values match nothing."""
    lookups = simple_lookups(questions)
    a = match_facts(lookups, facts.filter("value is not null"), facts_order).join(shuffled(statement_variables(lookups, plan)), "id")
    b = match_evidence(lookups, plan, evidence.filter("value is not null"), evidence_order)
    asked = questions.select("id", "unit_factor", F.array_max("years").alias("year"))
    out = tiered(asked, a, b, "id", ("variable", "label", "code", "period"), ("unit_factor", "year"))
    year = F.when(F.col("tier").isNotNull(), F.col("year"))
    return out.select("id", "answer", "tier", "variable", year.alias("year"), "label", "code", program().alias("program"))


def program() -> Column:
    """The SQL of a row's lookup, as `answer.lookup_program` writes it, from variable, period, unit_factor, code and label.
    Evidence has labels normalised, those of merged statements without backslashes."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    item = F.when(F.col("tier") == "facts", clean_label(normalize_label("label"))).otherwise(normalize_label("label"))
    test = F.concat(F.when(F.col("code") != "", F.concat(F.lit("code = "), quote(F.col("code")), F.lit(" and "))).otherwise(""), F.lit("item = "), quote(item))
    return F.concat(F.lit("select coalesce(round(min_by(value, ord) / "), F.col("unit_factor").cast("string"), F.lit(", 2), 0.0) as result from "), F.col("variable"), F.lit(" where "), test, F.lit(" and period = "), F.col("period").cast("string"))


def missing_statements(questions: DataFrame, plan: DataFrame) -> DataFrame:
    """id, statement of the questions whose statement is not among their plan's, as a hint to look at the notes."""
    wanted = questions.filter("statement is not null").select("id", "statement")
    return wanted.join(shuffled(plan.filter("kind = 'stmt'").select("id", F.col("name").alias("statement"))), ["id", "statement"], "left_anti")


def fill_gaps(questions: DataFrame, plan: DataFrame, merged: DataFrame) -> DataFrame:
    """The entries that plans of several companies lack: id, variable, var_no, report_id, kind, name.

    Each company of such a question should have a balance sheet, an income statement and the question's own statement. For
    each of its years and report types (both where none is asked for) the first by name that its plan has for no report of
    the company, and that is there among merged statements (report_id, name), is added after the plan's entries."""
    asked = questions.filter(F.size("tickers") >= 2).select("id", "tickers", "years", "report_type", "statement")
    types = F.when(F.col("report_type").isNotNull(), F.array("report_type")).otherwise(F.array(F.lit("consolidated"), F.lit("separate")))
    needed = F.array_distinct(F.array_compact(F.array(F.lit("balance_sheet"), F.lit("income"), F.col("statement"))))
    each = asked.select("id", F.explode("tickers").alias("ticker"), "years", types.alias("types"), needed.alias("needed"))
    have = plan.select("id", F.substring_index("report_id", "_", 1).alias("ticker"), "name").groupBy("id", "ticker").agg(F.collect_set("name").alias("have"))
    lacking = each.join(shuffled(have), ["id", "ticker"], "left").withColumn("missing", F.array_except("needed", F.coalesce("have", F.array().cast("array<string>")))).filter(F.size("missing") > 0)
    keys = lacking.select("id", "ticker", "missing", "types", F.explode(F.array_distinct("years")).alias("year")).select("id", "ticker", "missing", "year", F.posexplode("types").alias("type_no", "type"))
    keys = keys.withColumn("report_id", F.concat(F.col("ticker"), F.lit("_financial_statements_"), F.col("year").cast("string"), F.lit("_"), F.col("type"))).withColumn("name", F.explode("missing"))
    found = keys.join(shuffled(merged.select("report_id", "name").distinct()), ["report_id", "name"], "left_semi")
    first = found.groupBy("id", "ticker", "year", "type_no", "report_id").agg(F.min("name").alias("name"))
    last = plan.groupBy("id").agg(F.max("var_no").alias("last"))
    numbered = first.join(shuffled(last), "id", "left").withColumn("var_no", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("id").orderBy("ticker", "year", "type_no")))
    return numbered.select("id", F.concat(F.lit("df"), F.col("var_no").cast("string")).alias("variable"), "var_no", "report_id", F.lit("stmt").alias("kind"), "name")


def table_statements(meta: DataFrame) -> DataFrame:
    """report_id, table_no, statement of the tables in merged statements (report_id, statement, table_nos). Of a table in
    several, the last statement by name counts."""
    return meta.select("report_id", "statement", F.explode("table_nos").alias("table_no")).groupBy("report_id", "table_no").agg(F.max("statement").alias("statement"))


def table_facts(tables: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of given tables (report_id, table_no)."""
    return facts.join(shuffled(tables.select("report_id", "table_no").distinct()), ["report_id", "table_no"], "left_semi")


def cards(evidence: DataFrame, order: str, most_chars: int = 1200, most_chars_statement: int = 6000) -> DataFrame:
    """report_id, name, sample (first rows as text, all of a merged statement, cut with ` ...`), hints (distinct code and
    label in order), for evidence with kind. A table is a group; its rows are as many as one report's table has."""
    first = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "item", "code", "period", "value")))
    grouped = evidence.groupBy("report_id", "name", "kind").agg(first.alias("rows"))
    merged = F.col("kind") == "stmt"
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shown = F.when(merged, F.col("rows")).otherwise(F.slice("rows", 1, SAMPLE_ROWS))
    sample = F.array_join(F.transform(shown, lambda r: F.concat_ws(" | ", text(r["item"]), text(r["code"]), text(r["period"]), text(r["value"]))), "\n")
    most = F.when(merged, most_chars_statement).otherwise(most_chars)
    coded = F.filter("rows", lambda r: (F.coalesce(r["code"], F.lit("")) != "") & (F.coalesce(r["item"], F.lit("")) != ""))
    hints = F.array_distinct(F.transform(coded, lambda r: F.struct(r["code"].alias("code"), r["item"].alias("label"))))
    out = grouped.select("report_id", "name", "kind", sample.alias("sample"), F.slice(hints, F.lit(1), F.when(merged, STATEMENT_HINTS).otherwise(TABLE_HINTS)).alias("hints"), most.alias("most"))
    return out.withColumn("sample", F.when(F.length("sample") > F.col("most"), F.concat(F.left("sample", F.col("most")), F.lit(" ..."))).otherwise(F.col("sample"))).drop("most")


def evidence_path(report_id: ColumnLike, name: ColumnLike) -> Column:
    return F.concat(F.lit("data/"), col(report_id), F.lit("__"), col(name), F.lit(".csv"))


def evidence_source(path: ColumnLike) -> Column:
    """report_id and item (table_N, or a statement's name) of an evidence path; null if it is none."""
    pattern = r"^(?:[^/]*/)?(.+?)__(table_.+|balance_sheet|income|cash_flow)\.csv$"
    return F.when(col(path).rlike(pattern), F.struct(F.regexp_extract(col(path), pattern, 1).alias("report_id"), F.regexp_extract(col(path), pattern, 2).alias("item")))


def rerank_text(report_id: str, table_no: str, statement: str, header: str, labels: str, most: int = 500) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ref = F.concat(text(report_id), F.lit("|table_"), text(table_no))
    return F.substring(F.concat_ws(" | ", ref, F.coalesce(F.nullif(F.col(statement), F.lit("")), F.lit("thuyet minh")), text(header), text(labels)), 1, most)


def records(questions: DataFrame, results: DataFrame, plan: DataFrame, solved: DataFrame) -> DataFrame:
    """id, question, answer, relevant_docs, relevant_tables, evidence (variable, csv_path), program, ok for every question.

    results: id, report_id, rank; plan also has fragments, the table_nos of an entry. Documents and tables are distinct, in
    the order of rank and of variables; a question without either has empty arrays, and is ok if its answer is not 0."""
    docs = results.groupBy("id", "report_id").agg(F.min("rank").alias("rank")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "report_id")))["report_id"].alias("relevant_docs"))
    refs = F.transform(F.coalesce("fragments", F.array().cast("array<int>")), lambda t: F.concat(F.col("report_id"), F.lit("|table_"), t.cast("string")))
    entries = F.array_sort(F.collect_list(F.struct("var_no", "variable", evidence_path("report_id", "name").alias("csv_path"), refs.alias("refs"))))
    used = plan.groupBy("id").agg(entries.alias("e"))
    used = used.select("id", F.array_distinct(F.flatten(F.col("e")["refs"])).alias("relevant_tables"), F.transform("e", lambda e: F.struct(e["variable"].alias("variable"), e["csv_path"].alias("csv_path"))).alias("evidence"))
    out = questions.select("id", "question").join(shuffled(solved.select("id", "answer", "program", "tier")), "id", "left").join(shuffled(docs), "id", "left").join(shuffled(used), "id", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", "question", F.coalesce("answer", F.lit(0.0)).alias("answer"), F.coalesce("relevant_docs", empty).alias("relevant_docs"), F.coalesce("relevant_tables", empty).alias("relevant_tables"), F.coalesce("evidence", F.array().cast("array<struct<variable:string,csv_path:string>>")).alias("evidence"), F.coalesce("program", F.lit("")).alias("program"), ((F.coalesce("answer", F.lit(0.0)) != 0) | F.col("tier").isNotNull()).alias("ok"))


def submission(records: DataFrame) -> DataFrame:
    """Records with only the evidence that their programs use, and only the tables of that evidence: all tables of a report
    whose merged statement is used, else the tables themselves. A program that names no variable keeps everything."""
    used = used_variables("program")
    kept = F.when(F.size(used) > 0, prune_inputs(F.col("evidence"), "program")).otherwise(F.col("evidence"))
    out = records.withColumn("evidence", kept)
    sources = F.transform("evidence", lambda e: evidence_source(e["csv_path"]))
    whole = F.transform(F.filter(sources, lambda s: ~s["item"].startswith("table_")), lambda s: s["report_id"])
    single = F.transform(F.filter(sources, lambda s: s["item"].startswith("table_")), lambda s: F.concat_ws("|", s["report_id"], s["item"]))
    keep = lambda t: F.array_contains(whole, F.substring_index(t, "|", 1)) | F.array_contains(single, t)
    return out.withColumn("relevant_tables", F.when(F.size(used) > 0, F.filter("relevant_tables", keep)).otherwise(F.col("relevant_tables")))


def evidence_files(submitted: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the evidence that records name, each table once, with csv_path; and the paths that have no rows."""
    named = submitted.select(F.explode("evidence.csv_path").alias("csv_path")).distinct()
    rows = evidence.withColumn("csv_path", evidence_path("report_id", "name")).join(named, "csv_path", "left_semi")
    return rows, named.join(rows.select("csv_path"), "csv_path", "left_anti")


def usage(submitted: DataFrame) -> DataFrame:
    """One row: n, mean_evidence, mean_used, n_fewer: how many entries records have and their programs name."""
    counts = submitted.select(F.size("evidence").alias("e"), F.size(used_variables("program")).alias("u"))
    return counts.agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_evidence"), F.round(F.avg("u"), 6).alias("mean_used"), F.count_if(F.col("u") < F.col("e")).alias("n_fewer"))
