"""Table markup to grids."""

import pytest

from gridmine.functions.html import parse_one, parse_table

SPANS = (
    "<table><thead><tr><td colspan=2>Dose</td><td rowspan=2>Age</td></tr><tr><td>mg</td><td>ml</td></tr></thead>"
    "<tbody><tr><td rowspan=2>1-5</td><td>0.5</td><td>60</td></tr><tr><td>7</td><td>na</td></tr></tbody></table>"
)


def body(rows: str, head: str = "<thead><tr><td>a</td><td>b</td></tr></thead>") -> str:
    return f"<table>{head}<tbody>{rows}</tbody></table>"


def test_spans_are_filled():
    out = parse_one(SPANS, "fill", "colon", False)
    assert out == {"header": ["Dose : mg", "Dose : ml", "Age"], "rows": [["1-5", "0.5", "60"], ["1-5", "7", "na"]]}


def slots(spark, markups, header_optional):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(markups)], "i int, m string")
    rows = df.select("i", parse_table("m", "slots", "colon", header_optional).alias("t")).collect()
    return [r.t and (r.t.header, r.t.rows) for r in sorted(rows, key=lambda r: r.i)]


def test_free_slots(spark):
    inner = [
        # The cell after the wide one lands in the next column and moves down, where it displaces "2".
        ("<tr><td colspan=2>x</td><td>y</td></tr><tr><td>1</td><td>2</td><td>3</td></tr>", [["x", "x", None], ["1", "y", "3"]]),
        # A tall cell ends with the table; the row below starts at its first free column.
        ("<tr><td rowspan=9>x</td><td>1</td></tr><tr><td>2</td></tr>", [["x", "1"], ["x", "2"]]),
        ("<tr><td>1</td><td>2</td></tr><tr><td>3</td></tr>", [["1", "2"], ["3", None]]),
        # A cell past the width voids the table, also one that would find no free slot.
        ("<tr><td>1</td></tr><tr><td>1</td><td>2</td></tr>", None),
        # A full row starts at column 0 again, and its cell falls into the row below.
        ("<tr><td rowspan=2>a</td><td rowspan=2>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr>", [["a", "b"], ["a", "b"], ["c", "d"]]),
        ("<tr><td rowspan=0 colspan=0>a</td></tr>", None),
        ("<tr></tr><tr></tr>", [[], []]),
    ]
    found = slots(spark, [body(rows) for rows, _ in inner], True)
    assert [t and t[1] for t in found] == [want for _, want in inner]


def test_free_slots_of_headers(spark):
    row = "<tr><td>1</td><td>2</td></tr>"
    markups = [SPANS, body(row, head=""), body(row, head="<thead></thead>"), body(row, head="<thead><tr><td>a</td><td>b</td><td>c</td></tr></thead>"), None, "nan"]
    # "Age" meets the wide "Dose" in its column and moves down, "ml" finds no slot.
    first = (["Dose : mg", "Dose : Age", "0"], [["1-5", "0.5", "60"], ["1-5", "7", "na"]])
    rows = [["1", "2"]]
    assert slots(spark, markups, False) == [first, None, (["", ""], rows), None, None, None]
    assert slots(spark, markups, True) == [first, (None, rows), (["", ""], rows), (None, rows), None, None]


def test_rectangular_fill_of_wide_cell():
    markup = body("<tr><td colspan=2>x</td><td>y</td></tr><tr><td>1</td><td>2</td><td>3</td></tr>")
    assert parse_one(markup, "fill", "colon", True)["rows"] == [["x", "x", "y"], ["1", "2", "3"]]


def test_short_rows_leave_gaps_and_long_rows_void():
    assert parse_one(body("<tr><td>1</td><td>2</td></tr><tr><td>3</td></tr>"), "none", "colon", False)["rows"] == [
        ["1", "2"],
        ["3", None],
    ]
    assert parse_one(body("<tr><td>1</td></tr><tr><td>1</td><td>2</td></tr>"), "none", "colon", False) is None


@pytest.mark.parametrize("markup", [None, "", "{}", "nan", "<p>no table</p>", "<table><thead></thead></table>"])
def test_not_a_table(markup):
    assert parse_one(markup, "none", "colon", False) is None


def test_headless_table_only_where_allowed():
    markup = body("<tr><td>1</td></tr>", head="")
    assert parse_one(markup, "none", "colon", False) is None
    assert parse_one(markup, "none", "colon", True) == {"header": None, "rows": [["1"]]}


def test_inner_markup_entities_and_comments():
    markup = body("<tr><td>a <b>b</b><br>&lt;&amp;<!-- <td>x</td> --></td><td title='a>b'>2</td></tr>")
    assert parse_one(markup, "none", "colon", False)["rows"] == [["a b<&", "2"]]


def test_column_function(spark):
    df = spark.createDataFrame([(SPANS.replace("<td", "<th").replace("</td", "</th"),), ("<p>x</p>",)], "m string")
    rows = [r.t for r in df.select(parse_table("m", "fill").alias("t")).collect()]
    assert rows[0].header == ["Dose : mg", "Dose : ml", "Age"]
    assert rows[1] is None
