"""Entities of questions: companies, years, report type, statement, unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, compact, name_variants, normalize_label
from ..plans.storage import shuffled, tier
from .retrieval import small

#: Brand names of tickers.
ALIASES = {"bidv": "BID", "vietcombank": "VCB", "vietinbank": "CTG", "sacombank": "STB", "vinamilk": "VNM", "masan": "MSN", "vingroup": "VIC", "hoa sen": "HSG", "hoa phat": "HPG", "techcombank": "TCB"}
#: Words that hint at a statement; the first kind with a hit wins.
HINTS = {
    "income": ["loi nhuan", "doanh thu", "gia von", "lai thuan", "lai vay", "lai tien gui", "lai lo", "lai ty gia", "thu nhap", "chi phi", "bien loi nhuan", "eps", "co tuc", "loi nhuan sau thue", "loi nhuan gop", "loi nhuan truoc thue"],
    "cash_flow": ["luu chuyen tien", "dong tien", "cfo", "tien thuan", "dong tien hoat dong"],
    "balance_sheet": ["tai san", "no phai tra", "phai thu", "phai tra", "ton kho", "tien gui", "von chu so huu", "quy", "du phong", "phai sinh", "tai san co dinh", "dau tu", "tien mat", "vo von", "du no", "no ngan han", "no dai han"],
}
#: Units of answers, the longest first.
UNITS = {"nghin ty dong": 1e12, "ty dong": 1e9, "trieu dong": 1e6, "nghin dong": 1e3, "dong": 1.0}
#: Words of questions that ask for more than one figure.
_COMPLEX = ["tang", "giam", "so voi", "chenh lech", "nhieu hon", "it hon", "ty le", "phan tram", "bien loi nhuan", "per", "eps", "cao nhat", "thap nhat", "nhanh nhat", "cham nhat", "trung binh", "tong cong", "quy do"]
FIRST_YEAR, LAST_YEAR = 2015, 2025


def any_word(c: Column, words: list[str]) -> Column:
    return c.rlike(r"\b(?:" + "|".join(words) + r")\b")


def report_type(q: ColumnLike) -> Column:
    n = normalize_label(q)
    return F.when(any_word(n, ["cong ty me", "bctc rieng", "bao cao rieng"]), "separate").when(any_word(n, ["hop nhat"]), "consolidated")


def statement_hint(q: ColumnLike) -> Column:
    n, out = compact(q), None
    for kind, words in HINTS.items():
        out = F.when(any_word(n, words), kind) if out is None else out.when(any_word(n, words), kind)
    return out


def unit(q: ColumnLike) -> Column:
    """factor and label of the answer's unit."""
    n, out = normalize_label(q), None
    for label, factor in UNITS.items():
        hit = F.struct(F.lit(factor).alias("factor"), F.lit(label).alias("label"))
        out = F.when(any_word(n, [label]), hit) if out is None else out.when(any_word(n, [label]), hit)
    return out.otherwise(F.struct(F.lit(1.0).alias("factor"), F.lit("").alias("label")))


def is_complex(q: ColumnLike) -> Column:
    return any_word(normalize_label(q), _COMPLEX)


def years(q: ColumnLike, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """Years that a question names, those of its ranges (within first and last) included, in order."""
    text = F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit(""))
    span = r"(?<!\d)(20\d\d)\s*[-–]\s*(20\d\d)(?!\d)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(span), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(span), F.lit(2)).alias("b"))
    inside = F.filter(F.transform(pairs, lambda p: F.struct(F.greatest(p["a"].cast("int"), F.lit(first)).alias("a"), F.least(p["b"].cast("int"), F.lit(last)).alias("b"))), lambda p: p["a"] <= p["b"])
    ranges = F.flatten(F.transform(inside, lambda p: F.sequence(p["a"], p["b"])))
    single = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(first, last))
    return F.array_sort(F.array_union(ranges, single))


def company_patterns(stocks: DataFrame) -> DataFrame:
    """pattern, ticker and kind (name, alias, ticker) under which companies are found. Aliases of other tickers go."""
    names = stocks.select(F.explode(name_variants("company_name")).alias("pattern"), F.upper("ticker").alias("ticker"), F.lit("name").alias("kind"))
    tickers = stocks.select(F.lower("ticker").alias("pattern"), F.upper("ticker").alias("ticker"), F.lit("ticker").alias("kind"))
    aliases = stocks.sparkSession.createDataFrame([(a, t, "alias") for a, t in ALIASES.items()], "pattern string, ticker string, kind string")
    return names.unionByName(aliases.join(tickers.select("ticker"), "ticker", "left_semi").select("pattern", "ticker", "kind")).unionByName(tickers).distinct()


def phrase_hits(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern, ticker, kind, at, n: where phrases of some words stand in compact texts (word numbers from 0).

    A phrase is found by joining word runs of the lengths that occur among the patterns with the patterns, so it is an
    equi-join, whatever the number of patterns, and no pattern is tried against all texts."""
    lengths = [r[0] for r in patterns.select(F.size(F.split("pattern", " ")).alias("n")).distinct().filter("n > 0").orderBy("n").collect()]  # as many as the longest pattern has words, at most
    words = texts.select(key, F.split(compact(text), " ").alias("w"))
    runs = None
    for n in lengths:
        part = words.filter(F.size("w") >= n).select(key, F.posexplode(F.expr(f"transform(sequence(0, size(w) - {n}), i -> array_join(slice(w, i + 1, {n}), ' '))")).alias("at", "pattern")).withColumn("n", F.lit(n))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        runs = words.select(key, F.lit(0).alias("at"), F.lit("").alias("pattern"), F.lit(0).alias("n")).limit(0)
    return runs.join(small(patterns), "pattern").select(key, "pattern", "ticker", "kind", "at", "n")


def suppress_inside(hits: DataFrame, key: str, kinds: tuple[str, ...] = ("name", "alias"), inner: str = "ticker") -> DataFrame:
    """Hits without those of kind `inner` that lie inside a hit of the other kinds."""
    spans = hits.filter(F.col("kind").isin(*kinds)).select(F.col(key).alias("__k"), F.explode(F.expr("sequence(at, at + n - 1)")).alias("__at")).distinct()
    weak = hits.filter(F.col("kind") == inner).join(shuffled(spans), (F.col(key) == F.col("__k")) & (F.col("at") == F.col("__at")), "left_anti")
    return hits.filter(F.col("kind") != inner).unionByName(weak)


def tickers(questions: DataFrame, stocks: DataFrame, key: str = "id", text: str = "question") -> DataFrame:
    """key, tickers (array, in order), matched (map of ticker to what was found). A name's longest hit at a place counts;
    a bare ticker inside a name's span does not, one in parentheses always does."""
    # Written, as all that follows looks at the hits several times.
    hits = tier(suppress_inside(tier(phrase_hits(questions, company_patterns(stocks), key, text), "phrase-hits"), key), "company-hits")
    inside = hits.filter("kind = 'name'").alias("a").join(shuffled(hits.filter("kind = 'name'").alias("b")), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.at") <= F.col("a.at")) & (F.col("b.at") + F.col("b.n") >= F.col("a.at") + F.col("a.n")) & (F.col("b.n") > F.col("a.n")), "left_anti")
    found = inside.select(key, "ticker", "pattern").unionByName(hits.filter("kind <> 'name'").select(key, "ticker", "pattern"))
    named = questions.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\(\s*([A-Za-z]{2,4}[0-9]?)\s*\)"), F.lit(1))).alias("t")).select(key, F.upper("t").alias("ticker"), F.lower("t").alias("pattern"))
    named = named.join(shuffled(stocks.select(F.upper("ticker").alias("ticker"))), "ticker", "left_semi").select(key, "ticker", "pattern")
    each = found.unionByName(named).groupBy(key, "ticker").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern"))["pattern"].alias("pattern"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "pattern")))).alias("matched"))


def entities(questions: DataFrame, stocks: DataFrame) -> DataFrame:
    """All entities of questions (id, question)."""
    out = questions.join(shuffled(tickers(questions, stocks)), "id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
    out = out.withColumns({"years": years("question"), "report_type": report_type("question"), "statement": statement_hint("question"), "unit": unit("question"), "complex": is_complex("question")})
    return out.select("id", "question", "tickers", "matched", "years", "report_type", "statement", F.col("unit.factor").alias("unit_factor"), F.col("unit.label").alias("unit_label"), "complex")
