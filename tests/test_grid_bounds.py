from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.text import name_variants
from ledgerspark.operators.grid import parse_grid


def test_large_spans_are_clamped():
    assert [len(r) for r in parse_grid("<table><tr><td colspan='1001'>a</td></tr></table>")] == [1000]
    assert parse_grid("<table><tr><td rowspan='99999'>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["a", "c"]]
    assert parse_grid("<table><tr><td colspan='0' rowspan='x'>a</td></tr></table>") == [["a"]]


def test_all_legal_forms_are_taken_off(spark):
    name = "cong ty co phan " * 9 + "hoa phat"
    got = spark.createDataFrame([(name,)], "n string").select(name_variants(F.col("n"))).first()[0]
    assert "hoa phat" in got
