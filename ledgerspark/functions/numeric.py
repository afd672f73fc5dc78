"""Numbers and units of report cells. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, col, let, normalize_label

#: Cells that stand for no number.
NO_NUMBER = ["", "-", "–", "--", "/", "x", "X", "n/a", "N/A"]
_SHAPE = r"^[-–]?\(?[0-9.,]+\)?%?$"


def parse_number(c: ColumnLike, thousands: str | Column = ".", decimal: str | Column = ",") -> Column:
    """A cell's number under the given separators; parentheses or a leading dash make it negative; null if it is none."""
    return number_of(dense(c), thousands, decimal)


def dense(c: ColumnLike) -> Column:
    """A cell without white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s ]+", "")


def number_of(s: Column, thousands: str | Column = ".", decimal: str | Column = ",") -> Column:
    """parse_number of a cell without white space, which should be a column, as it is looked at several times."""
    thousands, decimal = (F.lit(x) if isinstance(x, str) else x for x in (thousands, decimal))
    digits = F.regexp_extract(s, r"([0-9.,]+)", 1)
    plain = F.replace(F.replace(digits, thousands, F.lit("")), decimal, F.lit("."))
    negative = s.rlike("^[-–]") | s.rlike(r"^\(.*\)$")
    value = plain.try_cast("double")
    return F.when(s.isin(NO_NUMBER) | ~s.rlike(_SHAPE), F.lit(None).cast("double")).when(negative, -value).otherwise(value)


def parse_vn_number(c: ColumnLike) -> Column:
    return parse_number(c, ".", ",")


def _token(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", "")
    return F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), r"^[+-]+|%+$", "")


_ENGLISH, _VIETNAMESE = r"^\d{1,3}(,\d{3})+(\.\d+)?$", r"^\d{1,3}(\.\d{3})+(,\d+)?$"


def looks_english(c: ColumnLike) -> Column:
    return _token(col(c)).rlike(_ENGLISH)


def looks_vietnamese(c: ColumnLike) -> Column:
    return _token(col(c)).rlike(_VIETNAMESE)


def format_lead(cells: Column) -> Column:
    """How many more cells of the array have English than Vietnamese thousands. Cells without separator have neither."""
    vote = lambda c: F.when(c.rlike("[.,]"), let(_token(c), lambda t: F.when(t.rlike(_ENGLISH), 1).when(t.rlike(_VIETNAMESE), -1).otherwise(0))).otherwise(0)
    return F.aggregate(F.transform(cells, vote), F.lit(0), lambda a, v: a + v)


def number_format(cells: Column) -> Column:
    """`en` if more cells of the array have English than Vietnamese thousands, else `vi`."""
    return F.when(format_lead(cells) > 0, "en").otherwise("vi")


def number_format_votes(c: ColumnLike) -> Column:
    """The same vote as an aggregate over rows."""
    return F.when(F.count_if(looks_english(c)) > F.count_if(looks_vietnamese(c) & ~looks_english(c)), "en").otherwise("vi")


def parse_formatted(c: ColumnLike, fmt: ColumnLike) -> Column:
    """parse_number with the separators of a number format."""
    return formatted_of(dense(c), fmt)


def formatted_of(s: Column, fmt: ColumnLike) -> Column:
    """parse_formatted of a cell without white space."""
    english = col(fmt) == "en"
    return number_of(s, F.when(english, ",").otherwise("."), F.when(english, ".").otherwise(","))


def unit_factor(c: ColumnLike) -> Column:
    """How many VND the unit in a label is."""
    return _factor(normalize_label(c))


def _factor(n: Column) -> Column:
    return F.when(n.rlike(r"\bnghin ty\b"), 1e12).when(n.rlike(r"\bnghin\b"), 1e3).when(n.rlike(r"\btrieu\b"), 1e6).when(n.rlike(r"\bty\b"), 1e9).when(n.rlike(r"\btram\b"), 1e2).otherwise(1.0)


#: How headers and unit lines name units.
HEADER_UNIT = r"(?iu)((?:Nghìn\s*tỷ|Nghìn|Triệu|Tỷ|Trăm)?\s*(?:VND|đồng))"
UNIT_LINE = r"(?iu)(?:Đơn\s*vị\s*(?:tính|tiền\s*tệ)?\s*[::/]|ĐVT\s*[::/])\s*([^:\n]+)"


def _unit(label: Column) -> Column:
    """factor and label of a unit; null if there is none."""
    return let(label, lambda x: F.when(x.isNotNull(), F.struct(let(normalize_label(x), _factor).alias("factor"), x.alias("label"))))


def unit_in_header(cells: Column) -> Column:
    """factor and label of the first header cell with a unit; null if there is none."""
    found = F.filter(F.transform(cells, lambda c: F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), HEADER_UNIT, 1))), lambda x: x != "")
    return _unit(F.get(found, F.lit(0)))


def unit_in_text(c: ColumnLike) -> Column:
    """factor and label of the first unit line of a text that names a currency; null if there is none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(UNIT_LINE), F.lit(1)), lambda x: F.trim(x))
    found = F.filter(found, lambda x: normalize_label(x).rlike("vnd|dong"))
    return _unit(F.get(found, F.lit(0)))


def unit(cells: Column, context: ColumnLike) -> Column:
    """The header's unit, else the context's, else VND."""
    return F.coalesce(unit_in_header(cells), unit_in_text(context), F.struct(F.lit(1.0).alias("factor"), F.lit("VND").alias("label")))


def to_number(c: ColumnLike) -> Column:
    """A program's scalar result as a number: thousands commas go, other text is null."""
    return F.replace(col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def format_vn(c: ColumnLike, decimals: int = 0) -> Column:
    """A number in Vietnamese style: dots for thousands, a comma before decimals."""
    return F.translate(F.format_number(col(c), decimals), ",.", ".,")
