"""From report text to pages, tables, grids and cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.periods import is_period_cell
from ..functions.text import ColumnLike, col, first_index

PAGE = r"===== PAGE (\d+) ====="
TABLE = r"(?s)<table>.*?</table>"
#: Cells of a table, spans spread, at most: more is an error of the table, not of the task's memory.
MAX_CELLS = 4_000_000


def _lines(c: ColumnLike) -> Column:
    """Line ends in a text."""
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("\n"), F.lit("")))


def _before(counts: Column) -> Column:
    """For each count the sum of those before it."""
    return F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _page_arrays(reports: DataFrame) -> DataFrame:
    """report_id with arrays over pages: number, lines_before, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = reports.select("report_id", F.regexp_extract_all(text, F.lit(PAGE), F.lit(1)).alias("number"), F.split(text, PAGE).alias("parts"))
    return split.select("report_id", F.transform("number", lambda n: n.cast("int")).alias("number"), F.slice(_before(F.transform("parts", _lines)), F.lit(2), F.size("number")).alias("lines_before"), F.slice("parts", F.lit(2), F.size("number")).alias("text"))


def pages(reports: DataFrame) -> DataFrame:
    """report_id, page_no, page_pos, lines_before (line ends before the page's text) and text of each page; what stands
    before the first page mark goes. A null text has no pages."""
    each = _page_arrays(reports).select("report_id", F.posexplode(F.arrays_zip("number", "lines_before", "text")).alias("page_pos", "p"))
    return each.select("report_id", F.col("p.number").alias("page_no"), "page_pos", "p.lines_before", "p.text")


def anchor(before: Column, lines: int = 6) -> Column:
    """The last non-blank lines of a text, stripped."""
    kept = F.filter(F.transform(F.split(before, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - (lines - 1), F.lit(1)), lines), "\n")


def _tail(text: Column, lines: int = 6) -> Column:
    """As much of a text's end as anchors look at: its last line, and the non-blank ones before that."""
    whole = F.transform(F.array(F.split(text, "\n")), lambda ls: F.concat(F.reverse(F.slice(F.reverse(F.filter(F.slice(ls, F.lit(1), F.size(ls) - 1), lambda x: F.trim(x) != "")), 1, lines)), F.slice(ls, -1, 1)))
    return F.array_join(F.flatten(whole), "\n")


def tables(reports: DataFrame) -> DataFrame:
    """report_id, table_no (from 1 in the report), page_no, start_line, anchor and html of each table without attributes.
    Numbers, lines and anchors are running sums and tails within a report's row: nothing is shuffled."""
    found = _page_arrays(reports).select("report_id", "number", "lines_before", F.transform("text", lambda t: F.regexp_extract_all(t, F.lit(TABLE), F.lit(0))).alias("found"), F.transform("text", lambda t: F.split(t, TABLE)).alias("between"))
    counted = found.select("report_id", F.explode(F.arrays_zip("number", "lines_before", "found", "between", F.slice(_before(F.transform("found", F.size)), F.lit(1), F.size("number")).alias("first"))).alias("p")).select("report_id", "p.*")
    # What stands between a table and the one before it, that one included.
    pieces = F.transform("found", lambda f, i: F.concat(F.when(i > 0, F.get("found", i - 1)).otherwise(""), F.get("between", i)))
    start = F.struct(F.lit("").alias("tail"), F.lit(0).alias("lines"), F.array().cast("array<struct<tail:string,lines:int>>").alias("out"))
    step = lambda acc, piece: F.transform(F.array(F.struct(_tail(F.concat(acc["tail"], piece)).alias("tail"), (acc["lines"] + _lines(piece)).alias("lines"))), lambda s: F.struct(s["tail"].alias("tail"), s["lines"].alias("lines"), F.concat(acc["out"], F.array(s)).alias("out")))[0]
    marked = counted.withColumn("pieces", pieces).select("report_id", "number", "lines_before", "found", "first", F.aggregate("pieces", start, step)["out"].alias("marks"))
    each = marked.select("report_id", "number", "lines_before", "first", F.posexplode(F.arrays_zip("found", "marks")).alias("pos", "t"))
    return each.select("report_id", (F.col("first") + F.col("pos") + 1).alias("table_no"), F.col("number").alias("page_no"), (F.col("lines_before") + F.col("t.marks.lines") + 1).alias("start_line"), anchor(F.col("t.marks.tail")).alias("anchor"), F.col("t.found").alias("html"))


_WIDE = re.compile(r'<td colspan="([0-9]{1,9})">([^<]*)</td>')
_ATTRIBUTE = re.compile(r'([a-zA-Z]+)="([^"]*)"')


class _Rows(HTMLParser):
    """Rows of (text, colspan, rowspan) of one table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.said: list[str] | None = None
        self.span = (1, 1)

    def _close(self) -> None:
        if self.said is not None and self.rows:
            self.rows[-1].append((" ".join(x for x in (s.strip() for s in self.said) if x), *self.span))
        self.said = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            # Larger spans are clamped, to the bounds that HTML has.
            number = lambda k, most: min(max(int(v), 1), most) if (v := dict(attrs).get(k) or "").isascii() and v.isdigit() else 1
            self.said, self.span = [], (number("colspan", 1000), number("rowspan", 65534)) if attrs else (1, 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.said is not None:
            self.said.append(data)


#: Tags of plain tables, whose attributes are all quoted and without references.
_PLAIN = re.compile(r'<(/?)(table|thead|tbody|tr|td|th|b|i|p|br|span|strong)((?:\s+[a-zA-Z]+="[^"<>&]*")*)\s*>', re.IGNORECASE)


def _rows(html: str) -> list[list[tuple[str, int, int]]]:
    """Rows of a table. Where all that looks like markup is a plain tag, the text is cut at those tags, which gives what
    the parser would; anything else goes to the parser."""
    parser = _Rows()
    parts = _PLAIN.split(html)
    if any("<" in text for text in parts[::4]):
        parser.feed(html)
        parser.close()
    else:
        for end, name, attributes, text in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4], strict=True):
            if end:
                parser.handle_endtag(name.lower())
            else:
                parser.handle_starttag(name.lower(), [(a.lower(), v) for a, v in _ATTRIBUTE.findall(attributes)] if attributes else [])
            if parser.said is not None and text:
                parser.said.append(unescape(text) if "&" in text else text)
    parser._close()
    return parser.rows


def _bare(html: str) -> list[list[str]] | None:
    """The rows of a table of bare rows and cells, of which those that are alone in their row may span columns; None of
    any other table. Cut at the tags, which takes a tenth of `_rows`' time."""
    if not (html.startswith("<table><tr>") and html.endswith("</tr></table>")):
        return None
    out, spans = [], False
    for row in html[11:-13].split("</tr><tr>"):
        if row.startswith("<td>") and row.endswith("</td>"):
            cells = row[4:-5].split("</td><td>")
            if row.count("<") != 2 * len(cells):
                return None
            out.append([(unescape(c) if "&" in c else c).strip() for c in cells])
        elif m := _WIDE.fullmatch(row):
            out.append([unescape(m[2]).strip()] * min(max(int(m[1]), 1), 1000))
            spans = True
        elif row:
            return None
        else:
            out.append([])
    if spans and sum(map(len, out)) > MAX_CELLS:
        raise ValueError(f"spans cover more than {MAX_CELLS} cells")
    width = max(map(len, out))
    return [row + [""] * (width - len(row)) if len(row) < width else row for row in out] if width else []


def parse_grid(html: str | None) -> list[list[str]]:
    """The table's cells in a rectangle: spanning cells repeat in every place that they cover, as HTML lays them out."""
    if (bare := _bare(html or "")) is not None:
        return bare
    found = _rows(html or "")
    rows = len(found)
    if all(cell[1:] == (1, 1) for row in found for cell in row):
        width = max(map(len, found), default=0)
        return [[cell[0] for cell in row] + [""] * (width - len(row)) for row in found] if width else []
    if sum(wide * min(high, rows - r) for r, row in enumerate(found) for _, wide, high in row) > MAX_CELLS:
        raise ValueError(f"spans cover more than {MAX_CELLS} cells")
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(found):
        c = 0
        for text, wide, high in row:
            while (r, c) in taken:
                c += 1
            for dr in range(min(high, rows - r)):
                for dc in range(wide):
                    taken.setdefault((r + dr, c + dc), text)
            c += wide
    width = max((c + 1 for _, c in taken), default=0)
    return [[taken.get((r, c), "") for c in range(width)] for r in range(rows if width else 0)]


def _nested(grids: list[list[list[str]] | None]) -> pa.Array:
    """Grids as one Arrow array, from their cells and the places where rows and tables end."""
    rows = [row for g in grids if g for row in g]
    cells = pa.array([c for row in rows for c in row], pa.string())
    row_ends, ends = list(accumulate(map(len, rows), initial=0)), list(accumulate((len(g or ()) for g in grids), initial=0))
    inner = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), cells)
    # A null offset makes a null list.
    return pa.ListArray.from_arrays(pa.array([None if k < len(grids) and grids[k] is None else e for k, e in enumerate(ends)], pa.int32()), inner)


def parsed(found: DataFrame) -> DataFrame:
    """Adds grid (array of rows of cells), n_rows, n_cols and error. The nesting of HTML is beyond expressions, so Arrow
    batches go through the standard library's parser. A table that it fails on has its reason as error, keeps its html and
    has no grid; the others have no html any more."""
    kept = [f for f in found.schema.fields if f.name != "html"]
    schema = T.StructType([*kept, *T._parse_datatype_string("html string, grid array<array<string>>, n_rows int, n_cols int, error string").fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            html = batch.column("html").to_pylist()
            made: list[tuple] = []
            for h in html:
                try:
                    g = parse_grid(h)
                    made.append((None, g, len(g), len(g[0]) if g else 0, None))
                except Exception as e:  # whatever it is, it is this table's error and no other's
                    made.append((h, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            added = [_nested([m[k] for m in made]) if k == 1 else pa.array([m[k] for m in made], arrow.field(len(kept) + k).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(arrow.field(f.name).type) for f in kept), *added], schema=arrow)

    return found.mapInArrow(parse, schema)


def grids(found: DataFrame) -> DataFrame:
    """Tables with grid, n_rows and n_cols; without those that cannot be parsed (`parsed` has them, with their errors)."""
    return parsed(found).filter("error is null").drop("html", "error")


def cells(found: DataFrame) -> DataFrame:
    """A row per cell: the keys, row_idx, col_idx and text."""
    keys = [c for c in ("report_id", "table_no") if c in found.columns]
    rows = found.select(*keys, F.posexplode("grid").alias("row_idx", "row"))
    return rows.select(*keys, "row_idx", F.posexplode("row").alias("col_idx", "text"))


def header_row(grid: ColumnLike) -> Column:
    """The first row with a period cell, or 0."""
    return F.greatest(first_index(col(grid), lambda r: F.exists(r, is_period_cell)), F.lit(0))


def is_section_title(row: Column) -> Column:
    """Whether all non-blank cells of a row are alike."""
    return F.size(F.array_distinct(F.filter(F.transform(row, lambda x: F.trim(x)), lambda x: x != ""))) == 1


def header_and_labels(grid: ColumnLike, header: Column, label_col: Column, most: int = 10) -> Column:
    """header_text and row_labels of a table: the header's cells, and the first labels below it, without section titles."""
    g = col(grid)
    body = F.filter(F.slice(g, header + 2, F.greatest(F.size(g), F.lit(1))), lambda r: ~is_section_title(r))
    labels = F.filter(F.transform(body, lambda r: F.trim(F.coalesce(F.get(r, label_col), F.lit("")))), lambda x: x != "")
    head = F.filter(F.transform(F.coalesce(F.get(g, header), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.array_join(head, " | ").alias("header_text"), F.array_join(F.slice(labels, 1, most), " | ").alias("row_labels"))


def int_list(c: ColumnLike) -> Column:
    """An array of numbers from JSON, or else from what commas separate."""
    s = F.coalesce(col(c), F.lit(""))
    loose = F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return F.coalesce(F.from_json(s, "array<int>"), loose)
