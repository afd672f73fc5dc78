"""Answers: evidence planning, scored lookups, and programs over evidence as SQL."""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import shuffled

THRESHOLD = 0.5


def label_score(label_tokens: Column, metric: Column, has_code: Column | None = None) -> Column:
    """0.8 times the share of the metric's tokens in the label, less up to 0.25 for a long label, plus 0.15 for a code."""
    label = F.array_distinct(label_tokens)
    share = F.size(F.filter(metric, lambda m: F.array_contains(label, m))) / F.size(metric)
    brevity = F.size(label) / F.greatest(F.size(metric), F.lit(1))
    score = share * 0.8 - F.least(F.lit(0.25), (brevity - 1.0) * 0.1)
    score = score if has_code is None else score + F.when(has_code, 0.15).otherwise(0.0)
    return F.when((F.size(label) > 0) & (F.size(metric) > 0), score).otherwise(0.0)


def best_match(scored: DataFrame, query_key: str, order: list[str], least: float = THRESHOLD) -> DataFrame:
    """The row with the best score of each query, the first of equals, if it reaches the threshold; combined before the
    shuffle."""
    best = F.min_by(F.struct(*(c for c in scored.columns if c != query_key)), F.struct((-F.col("score")).alias("__s"), *order))
    return scored.filter(F.col("score") >= least).groupBy(query_key).agg(best.alias("__b")).select(query_key, "__b.*")


def tiered(questions: DataFrame, first: DataFrame, second: DataFrame, key: str, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """key, answer, tier, columns to keep of the tier that counts and to carry of the questions: the first tier's value over
    the unit, else the second's, else 0 and no tier."""
    row = lambda tier: F.struct(F.lit(tier).alias("tier"), "value", *keep)
    found = first.select(key, row("facts").alias("__a")).join(second.select(key, row("evidence").alias("__b")), key, "full").select(key, F.when(F.col("__a.value").isNotNull(), F.col("__a")).when(F.col("__b.value").isNotNull(), F.col("__b")).alias("__r"))
    joined = questions.select(key, *dict.fromkeys(["unit_factor", *carry])).join(shuffled(found), key, "left")
    return joined.select(key, F.coalesce(F.round(F.col("__r.value") / F.col("unit_factor"), 2), F.lit(0.0)).alias("answer"), "__r.tier", *(f"__r.{c}" for c in keep), *carry)


def plan_evidence(results: DataFrame, table_statement: DataFrame, query_key: str = "qid") -> DataFrame:
    """query_key, variable, report_id, kind (stmt, table), name in order: each merged statement once, other tables
    themselves. results: query_key, report_id, table_no, rank; table_statement: report_id, table_no, statement."""
    joined = results.join(table_statement, ["report_id", "table_no"], "left")
    named = joined.withColumns({"kind": F.when(F.col("statement").isNotNull(), "stmt").otherwise("table"), "name": F.coalesce("statement", F.concat(F.lit("table_"), F.col("table_no").cast("string")))})
    once = named.groupBy(query_key, "report_id", "kind", "name").agg(F.min("rank").alias("rank"))
    number = F.row_number().over(Window.partitionBy(query_key).orderBy("rank", "report_id", "name"))
    return once.withColumn("var_no", number).select(query_key, F.concat(F.lit("df"), F.col("var_no").cast("string")).alias("variable"), "var_no", "report_id", "kind", "name")


def gaps(needed: DataFrame, have: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Needed keys that are not there yet but available."""
    return needed.select(*keys).distinct().join(have.select(*keys), keys, "left_anti").join(available.select(*keys), keys, "left_semi")


def compact_plan(plan: DataFrame, query_key: str, company: str, most: int = 6) -> DataFrame:
    """For plans of several companies with more than `most` entries: without single tables, each company's statement
    once; other plans, and those that would be empty, stay."""
    by = Window.partitionBy(query_key)
    companies = F.size(F.collect_set(company).over(by))
    large = (F.count("*").over(by) > most) & (companies >= 2) & (F.max((F.col("kind") == "stmt").cast("int")).over(by) == 1)
    marked = plan.withColumn("__large", large)
    first = F.row_number().over(Window.partitionBy(query_key, company, "kind", "name").orderBy("var_no"))
    return marked.withColumn("__n", first).filter(~F.col("__large") | ((F.col("kind") == "stmt") & (F.col("__n") == 1))).drop("__large", "__n")


# Programs


#: Functions that a program may call, and what its parsed plan may consist of.
ALLOWED = {"coalesce", "round", "min_by", "max_by", "first", "sum", "avg", "min", "max", "abs", "contains", "lower", "nullif", "vn_num", "try_cast", "count", "any_value", "greatest", "least", "between"}
PLANS = {"Project", "Filter", "Aggregate", "UnresolvedHaving", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "Distinct", "Sort", "SortOrder", "ScalarSubquery"}
EXPRESSIONS = {
    "Alias", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedFunction", "Literal", "Cast", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not",
    "IsNull", "IsNotNull", "In", "Like", "Between", "CaseWhen", "Coalesce", "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive",
}


def _parsed(sql: str) -> list[dict]:
    """The nodes of the plan that Spark's parser makes of a statement, with those of subqueries."""
    found: list[dict] = []

    def walk(x: object) -> None:
        if isinstance(x, dict):
            found.extend([x] if "class" in x else [])
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(json.loads(SparkSession.active()._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()))
    return found


def check_program(sql: str, views: set[str], most_chars: int = 4000, most_nodes: int = 400) -> str | None:
    """Why a program may not run, or None: one query over the given views, with known functions, of bounded size. It is
    judged by the plan that Spark's parser makes of it, where every relation, function and kind of node is looked at."""
    if len(sql) > most_chars:
        return "too long"
    if re.search(r"--|/\*|`|;", re.sub(r"'(?:[^'\\]|''|\\.)*'", "''", sql)):
        return "one plain statement only"
    try:
        nodes = _parsed(sql)
    except Exception as e:  # what does not parse is refused
        return f"not one statement: {str(e).strip().splitlines()[0][:200]}"
    if len(nodes) > most_nodes:
        return "too many parts"
    for node in nodes:
        kind = node["class"].split(".")[-1].rstrip("$")
        names = [x.strip().lower() for x in str(node.get("multipartIdentifier" if kind == "UnresolvedRelation" else "nameParts", "")).strip("[]").split(",")]
        if kind not in PLANS | EXPRESSIONS:
            return f"kind {kind}"
        if kind == "UnresolvedRelation" and (len(names) != 1 or names[0] not in views):
            return f"relation {'.'.join(names)}"
        if kind == "UnresolvedFunction" and (len(names) != 1 or names[0] not in ALLOWED):
            return f"function {'.'.join(names)}"
    return None


def run_program(spark: SparkSession, sql: str, frames: dict[str, DataFrame], seconds: float = 60.0) -> dict:
    """Runs a checked program over frames named df1, df2, ...: ok, result (a number or None) and error. It has a session of
    its own, so that programs that run at once don't see each other's frames, and is cancelled after so many seconds."""
    if error := check_program(sql, set(frames)):
        return {"ok": False, "result": None, "error": error}
    own, group = spark.newSession(), uuid.uuid4().hex
    shared = {name: f"frame_{group}_{k}" for k, name in enumerate(frames)}
    for name, frame in frames.items():
        frame.createOrReplaceGlobalTempView(shared[name])
        own.table(f"global_temp.{shared[name]}").createOrReplaceTempView(name)
    own.sql("CREATE OR REPLACE TEMPORARY FUNCTION vn_num(s STRING) RETURNS DOUBLE RETURN try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE)")
    spark.sparkContext.setJobGroup(group, "program", True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        rows = own.sql(sql).limit(2).collect()
        value = rows[0][0] if len(rows) == 1 and len(rows[0]) == 1 else None
        return {"ok": value is not None, "result": None if value is None else round(float(value), 2), "error": None if value is not None else "not one number"}
    except Exception as e:  # errors of a program are its result
        return {"ok": False, "result": None, "error": str(e).splitlines()[0][:300]}
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name in shared.values():
            spark.catalog.dropGlobalTempView(name)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


def lookup_program(variable: str, year: int, unit_factor: float, code: str | None = None, label: str | None = None) -> str:
    """The SQL of a lookup by code and normalised label, as far as given: the first row's value, 0 if there is none."""
    tests = [f"{name} = {_quoted(value)}" for name, value in (("code", code), ("item", label)) if value]
    return f"select coalesce(round(min_by(value, ord) / {unit_factor!r}, 2), 0.0) as result from {variable} where {' and '.join([*tests, f'period = {int(year)}'])}"


# Derived figures over (entity, period, value)


def growth(rows: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Adds previous and growth_pct against the period before."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy(period))
    return rows.withColumn("previous", before).withColumn("growth_pct", F.round((F.col(value) - F.col("previous")) / F.nullif(F.abs("previous"), F.lit(0)) * 100, 2))


def ratio(a: str, b: str) -> Column:
    return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)


def arg_best(rows: DataFrame, by: str, entity: str, value: str, largest: bool = True) -> DataFrame:
    """The entity with the largest or smallest value in each period, the first by name of equals."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value) if largest else F.asc(value), entity))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")
