"""HTML tables to grids.

Markup has no built-in reader in Spark, so this is the one place (next to a plugged
encoder) where text goes through Arrow to Python workers. The work per table is a
single regex scan over its tags; Spark keeps partitioning and pruning.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridmine import schemas
from gridmine.functions.predicates import as_col
from gridmine.functions.text import HEADER_STYLES, collapse_header
from gridmine.functions.vectors import costly

_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
_SPAN = re.compile(r"\b(rowspan|colspan)\s*=\s*[\"'\\/]*\s*(\d+)", re.I)
_VOID = {"br", "hr", "img", "input", "col", "meta", "link", "wbr"}
Row = list[str | None]


def clean_table_html(c: str | Column) -> Column:
    """Drop double quotes, newlines to blanks, header cells to plain cells."""
    c = F.translate(as_col(c), '"', "")
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.regexp_replace(c, r"<(/?)th(?=[ >])", "<$1td")


@dataclass(slots=True)
class _Cell:
    rowspan: int = 1
    colspan: int = 1
    text: list[str] = field(default_factory=list)

    def value(self) -> str:
        text = "".join(self.text)
        return html.unescape(text) if "&" in text else text


def _cell(attributes: str) -> _Cell:
    cell = _Cell()
    if attributes:
        for name, number in _SPAN.findall(attributes):
            setattr(cell, name.lower(), int(number))
    return cell


def _sections(markup: str) -> dict[str, list[list[_Cell]]]:
    """Rows of the first thead and the first tbody.

    Elements stay open until their own end tag, so text, cells and rows of a nested
    table also count for every cell, row and section around them.
    """
    sections: dict[str, list[list[_Cell]]] = {}
    stack: list[str] = []
    open_cells: list[_Cell] = []
    open_rows: list[list[_Cell]] = []
    open_sections: list[list[list[_Cell]] | None] = []
    opened = {"td": open_cells, "tr": open_rows, "thead": open_sections, "tbody": open_sections}
    at = 0
    for tag in _TAG.finditer(markup):
        start = tag.start()
        if open_cells and start > at:
            piece = markup[at:start]
            for cell in open_cells:
                cell.text.append(piece)
        at = tag.end()
        closing, name, attributes = tag.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in stack:
                while True:
                    top = stack.pop()
                    if top in opened:
                        opened[top].pop()
                    if top == name:
                        break
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        stack.append(name)
        if name == "td":
            cell = _cell(attributes)
            for row in open_rows:
                row.append(cell)
            open_cells.append(cell)
        elif name == "tr":
            row = []
            for section in open_sections:
                if section is not None:
                    section.append(row)
            open_rows.append(row)
        elif name in ("thead", "tbody"):
            first = name not in sections
            open_sections.append(sections.setdefault(name, []) if first else None)
    return sections


def _place_plain(rows: list[list[_Cell]], width: int) -> list[Row] | None:
    """Cells in order, no spans; a row longer than the width voids the table."""
    if any(len(r) > width for r in rows):
        return None
    return [[c.value() for c in r] + [None] * (width - len(r)) for r in rows]


def _place_rectangular(rows: list[list[_Cell]], width: int) -> list[Row] | None:
    """Standard fill: a cell covers its whole rowspan x colspan block from the next free slot."""
    grid: list[Row] = [[None] * width for _ in rows]
    taken = [[False] * width for _ in rows]
    for i, row in enumerate(rows):
        j = 0
        for cell in row:
            while j < width and taken[i][j]:
                j += 1
            if j >= width:
                return None
            text = cell.value()
            for r in range(i, min(i + cell.rowspan, len(rows))):
                for c in range(j, min(j + cell.colspan, width)):
                    grid[r][c], taken[r][c] = text, True
            j += cell.colspan
    return grid


_PLACERS = {"none": _place_plain, "fill": _place_rectangular}


def _collapse(rows: list[Row], width: int, style: str) -> list[str]:
    joiner, leading, trimmed = HEADER_STYLES[style]
    out = []
    for j in range(width):
        path = ""
        for row in rows:
            part = "0" if row[j] is None else row[j]
            part = part.strip() if trimmed else part
            if part == path:
                continue
            path = path + joiner + part if path or leading else part
        out.append(path)
    return out


def _read(markup: str | None, header_optional: bool) -> tuple[list[list[_Cell]] | None, list[list[_Cell]]] | None:
    """(header rows, body rows); None without a body, or without a header where one is asked for."""
    if markup is None or markup.strip() in ("", "{}", "nan"):
        return None
    sections = _sections(markup)
    body, head = sections.get("tbody"), sections.get("thead")
    return None if not body or (head is None and not header_optional) else (head, body)


def parse_one(markup: str | None, spans: str, style: str, header_optional: bool) -> dict | None:
    """One table; None when it cannot be read as header plus body."""
    read = _read(markup, header_optional)
    if read is None:
        return None
    head, body = read
    width = sum(c.colspan for c in body[0])
    place = _PLACERS[spans]
    rows = place(body, width)
    if rows is None:
        return None
    header = None
    if head is not None:
        placed = place(head, width)
        if placed is None and not header_optional:
            return None
        header = None if placed is None else _collapse(placed, width, style)
    return {"header": header, "rows": rows}


def _raw_cells(c: Column, header_optional: bool) -> Column:
    """Cleaned markup to struct<head, body>, rows of cells with their spans as they are written."""
    arrow_type = to_arrow_type(schemas.RAW_TABLE)

    def plain(rows: list[list[_Cell]] | None) -> list[list[dict]] | None:
        return rows and [[{"rowspan": x.rowspan, "colspan": x.colspan, "text": x.value()} for x in r] for r in rows]

    @F.arrow_udf(schemas.RAW_TABLE)
    def read(markups: pa.Array) -> pa.Array:
        found = (_read(m, header_optional) for m in markups.to_pylist())
        return pa.array([f and {"head": plain(f[0]), "body": plain(f[1])} for f in found], type=arrow_type)

    return costly(read)(c)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fill_free_slots(rows: Column, width: Column) -> Column:
    """Rows of cells (rowspan, colspan, text) to a grid; NULL where a cell lies past the width.

    Slots are numbered row by row, and the free ones are kept in order. The cells of a row lie in neighbouring
    columns, from its first free slot on (from column 0 if it has none). A cell takes the next ``rowspan`` free slots
    of its column, from its row down, and the next ``colspan`` - 1 free slots of its row, to the right of its column;
    spans that run out of slots end there.
    """
    cells = F.flatten(
        F.transform(rows, lambda r, i: F.transform(r, lambda x, k: F.struct(i.alias("row"), k.alias("at"), x.alias("cell"))))
    )
    slots = F.slice(F.sequence(F.lit(0), F.size(rows) * width), 1, F.size(rows) * width)
    state = "struct<free: array<int>, filled: array<struct<slot: int, text: string>>, start: int, void: boolean>"
    empty = F.struct(slots.alias("free"), F.array().alias("filled"), F.lit(0).alias("start"), F.lit(False).alias("void"))

    def add(acc: Column, x: Column) -> Column:
        left = x["row"] * width  # slot of the row's first column
        of_row = F.filter(acc["free"], lambda s: (s >= left) & (s < left + width))
        start = F.when(x["at"] > 0, acc["start"]).otherwise(F.coalesce(F.get(of_row, 0) - left, F.lit(0)))

        def place(start: Column) -> Column:
            own = left + start + x["at"]
            below = F.filter(acc["free"], lambda s: (s >= own) & ((s - own) % width == 0))
            beside = F.filter(acc["free"], lambda s: (s > own) & (s < left + width))
            taken = F.concat(
                F.slice(below, 1, x["cell"]["rowspan"]), F.slice(beside, 1, F.greatest(x["cell"]["colspan"] - 1, F.lit(0)))
            )

            def after(taken: Column) -> Column:
                filled = F.transform(taken, lambda s: F.struct(s.alias("slot"), x["cell"]["text"].alias("text")))
                return F.struct(
                    F.array_except(acc["free"], taken).alias("free"),
                    F.concat(acc["filled"], filled).alias("filled"),
                    start.alias("start"),
                    (acc["void"] | (start + x["at"] >= width)).alias("void"),
                )

            return _bind(taken, after)

        return F.when(acc["void"], acc).otherwise(_bind(start, place))

    def grid(end: Column) -> Column:
        texts = F.map_from_entries(end["filled"])
        line = lambda i: F.transform(F.slice(slots, i * width + 1, width), lambda s: F.try_element_at(texts, s))
        return F.when(~end["void"], F.transform(rows, lambda _, i: line(i)))

    return _bind(F.aggregate(cells, empty.cast(state), add), grid)


def _slot_table(t: Column, style: str, header_optional: bool) -> Column:
    """Raw cells to struct<header, rows> with free slots filled; NULL for tables that cannot be placed."""
    width = F.aggregate(F.get(t["body"], 0), F.lit(0), lambda n, x: n + x["colspan"])

    def result(placed: Column) -> Column:
        head, rows = placed["head"], placed["rows"]
        paths = F.when((F.size(head) > 0) & (width > 0), collapse_header(head, style))
        header = F.coalesce(paths, F.when(head.isNotNull(), F.array_repeat(F.lit(""), width)))
        bad = rows.isNull() if header_optional else rows.isNull() | head.isNull()
        return F.when(~bad, F.struct(header.alias("header"), rows.alias("rows")))

    placed = F.struct(fill_free_slots(t["head"], width).alias("head"), fill_free_slots(t["body"], width).alias("rows"))
    return _bind(placed, result)


def parse_table(c: str | Column, spans: str = "none", style: str = "colon", header_optional: bool = False) -> Column:
    """Cleaned markup to struct<header, rows>; NULL for tables that cannot be read.

    ``spans``: ``none`` (cells as they come), ``fill`` (rectangular span fill) or
    ``slots`` (``fill_free_slots``, for comparability with earlier results). Width is the sum of colspans of the
    first body row.
    """
    if spans not in (*_PLACERS, "slots") or style not in HEADER_STYLES:
        raise ValueError(f"unknown spans {spans!r} or style {style!r}")
    if spans == "slots":
        raw = _raw_cells(clean_table_html(c), header_optional)
        return _bind(raw, lambda t: F.when(t.isNotNull(), _slot_table(t, style, header_optional)))
    arrow_type = to_arrow_type(schemas.PARSED_TABLE)

    @F.arrow_udf(schemas.PARSED_TABLE)
    def parse(markups: pa.Array) -> pa.Array:
        return pa.array([parse_one(m, spans, style, header_optional) for m in markups.to_pylist()], type=arrow_type)

    return costly(parse)(clean_table_html(c))


def html_grid(c: str | Column, spans: str = "none") -> Column:
    """Body rows only."""
    return parse_table(c, spans, header_optional=True)["rows"]


def html_header(c: str | Column, spans: str = "none", style: str = "colon") -> Column:
    return parse_table(c, spans, style)["header"]
