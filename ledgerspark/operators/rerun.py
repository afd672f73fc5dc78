"""Programs of all records run again in one job: parsed to lookups, which are joined with the evidence.

`answer.run_program` runs any allowed program, one at a time. Lookup programs, which is what `solve.program` and
`answer.lookup_program` write, need no session each: their text gives a variable, a code, a label, a period and a unit,
the record's evidence gives the variable's table, and equal lookups of many records are made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shuffled
from .solve import evidence_source

_STRING = r"'((?:[^'\\]|''|\\.)*)'"
LOOKUP = rf"(?s)^select coalesce\(round\(min_by\(value, ord\) / ([0-9.eE+]+), 2\), 0\.0\) as result from (df[0-9]+) where (?:code = {_STRING} and )?(?:item = {_STRING} and )?period = (-?[0-9]+)$"


def lookup(program: str) -> Column:
    """unit, variable, code, label (null where the program does not test it) and period of a lookup program; null of others."""
    part = lambda k: F.regexp_extract(F.col(program), LOOKUP, k)
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("''"), F.lit("'")), r"\\(.)", "$1")
    has = lambda name: F.regexp_extract(F.col(program), rf"where (?:code = {_STRING} and )?{name} = '", 0) != ""
    code = F.when(F.col(program).rlike(" where code = '"), plain(part(3)))
    label = F.when(has("item"), plain(part(4)))
    found = F.struct(part(1).cast("double").alias("unit"), part(2).alias("variable"), code.alias("code"), label.alias("label"), part(5).cast("int").alias("period"))
    return F.when(F.col(program).rlike(LOOKUP) & (code.isNotNull() | label.isNotNull()), found)


def execute(lookups: DataFrame, evidence: DataFrame, order: list[str]) -> DataFrame:
    """lookups (report_id, name, code, label, period, each once) with value: that of the first row of the table that has the
    code, the label and the period; null if there is none. Evidence: report_id, name, item, code, period, value."""
    keys = ["report_id", "name", "period"]
    once = lookups.select(*keys, "code", "label").distinct()
    rows = evidence.select(*keys, "item", F.coalesce("code", F.lit("")).alias("has"), F.struct(F.struct(*order).alias("o"), "value").alias("r"))
    # By label where one is given, else by code: either way a join on the whole of what is asked.
    by_label = once.filter("label is not null").join(shuffled(rows.withColumnRenamed("item", "label")), [*keys, "label"]).filter(F.col("code").isNull() | (F.col("code") == F.col("has")))
    by_code = once.filter("label is null").join(shuffled(rows.withColumn("code", F.col("has"))), [*keys, "code"])
    found = by_label.select(*keys, "code", "label", "r").unionByName(by_code.select(*keys, "code", "label", "r"))
    return found.groupBy(*keys, "code", "label").agg(F.min_by("r.value", "r.o").alias("value"))


def verdicts(records: DataFrame, evidence: DataFrame, order: list[str], tolerance: float = 0.01) -> DataFrame:
    """id, status, executed, error, no_evidence of every record (id, answer, program, evidence).

    bad_path: a path of its evidence is none, or names a table that has no rows; crash: a program that is no lookup, or of a
    variable that the evidence lacks; else ok or mismatch by the tolerance. A record without program gives 0."""
    entries = F.transform("evidence", lambda e: F.struct(e["variable"].alias("variable"), e["csv_path"].alias("csv_path"), evidence_source(e["csv_path"]).alias("source")))
    all_ = records.select("id", F.coalesce(F.col("answer"), F.lit(0.0)).alias("answer"), F.trim(F.coalesce("program", F.lit(""))).alias("program"), F.coalesce(entries, F.array().cast("array<struct<variable:string,csv_path:string,source:struct<report_id:string,item:string>>>")).alias("entries"))
    paths = all_.select("id", F.explode("entries").alias("e")).select("id", "e.csv_path", F.col("e.source.report_id").alias("report_id"), F.col("e.source.item").alias("name"))
    known = evidence.select("report_id", "name").distinct().withColumn("known", F.lit(True))
    wrong = paths.join(shuffled(known), ["report_id", "name"], "left").filter(F.col("known").isNull() | ~F.col("csv_path").startswith("data/"))
    wrong = wrong.groupBy("id").agg(F.min("csv_path").alias("bad_path"))
    parsed = all_.withColumn("l", F.when(F.col("program") != "", lookup("program")))
    source = F.get(F.filter("entries", lambda e: e["variable"] == F.col("l.variable")), F.lit(0))["source"]
    asked = parsed.withColumn("s", source).select("id", "answer", "program", F.size("entries").alias("n"), F.col("l").isNotNull().alias("is_lookup"), F.col("s").isNotNull().alias("has_table"), F.col("s.report_id").alias("report_id"), F.col("s.item").alias("name"), "l.code", "l.label", "l.period", "l.unit")
    values = execute(asked.filter("is_lookup and has_table"), evidence, order)
    same = [asked[c].eqNullSafe(values[c]) for c in ("code", "label")] + [asked[c] == values[c] for c in ("report_id", "name", "period")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    ran = asked.join(shuffled(values), condition, "left").select("id", "answer", "program", "n", "is_lookup", "has_table", "unit", values["value"]).join(shuffled(wrong), "id", "left")
    executed = F.when(F.col("bad_path").isNull(), F.when(F.col("program") == "", 0.0).when(F.col("is_lookup") & F.col("has_table"), F.coalesce(F.round(F.col("value") / F.col("unit"), 2), F.lit(0.0))))
    status = F.when(F.col("bad_path").isNotNull(), "bad_path").when(F.col("executed").isNull(), "crash").when(F.abs(F.col("executed") - F.col("answer")) <= tolerance, "ok").otherwise("mismatch")
    error = F.when(F.col("status") == "bad_path", F.concat(F.lit("no table: "), F.coalesce("bad_path", F.lit("")))).when(F.col("status") == "crash", F.when(F.col("is_lookup"), "variable without evidence").otherwise("no lookup")).when(F.col("status") == "mismatch", F.concat(F.lit("ran to "), F.col("executed").cast("string")))
    return ran.withColumn("executed", executed).withColumn("status", status).select("id", "status", "executed", error.alias("error"), (F.col("n") == 0).alias("no_evidence"))


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: total, ok, crash, mismatch, bad_path, no_evidence."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return verdicts.agg(F.count("*").alias("total"), *map(count, ("ok", "crash", "mismatch", "bad_path")), F.count_if("no_evidence").alias("no_evidence"))
