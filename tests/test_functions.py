"""Column functions on small frames; expected values are worked out from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from gridmine.functions import numbers, predicates as pr, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column.alias("out")).first()["out"]


def test_missing_empty_and_any_element(spark):
    schema = "id int, xs array<struct<text:string>>"
    rows = [(1, None), (2, []), (3, [("a",), ("CKD",)]), (4, [(None,), ("ckd",)])]
    df = spark.createDataFrame(rows, schema)
    ids = lambda cond: sorted(r.id for r in df.filter(cond).collect())
    assert ids(pr.not_empty("xs")) == [1, 3, 4]
    assert ids(pr.not_empty("xs", missing_passes=False)) == [3, 4]
    assert ids(pr.matches("xs.text", [("CKD", False)])) == [3]
    assert ids(pr.matches("xs.text", [("CKD", True)])) == [3, 4]
    assert ids(pr.rx_none("xs.text", [("CKD", False)])) == [1, 2, 4]


@pytest.mark.parametrize(
    ("profile", "raw", "expected"),
    [
        ("row_corpus", "5-7 mg, 0.5% -3 <12 ~x", " RANGE  mg SMALLPOS PERCENT   NEG   LESS INT  APPROX x"),
        ("row_corpus", "a 3 January2020 days 5ug/ml", "a INT DATE UNITTIME 5UNITML"),
        ("erase", "['12 [1 to 3]', 'a7 b', '5%']", "to,a,b"),
        ("classes", "['-3', '0.5', 'dose 7']", "neg smallpos dose float"),
        ("keep_numbers", "['5%', 'dose 12', '<3']", "5,percent,dose,12,less,3"),
        ("term", "12.5%", "PERCENT"),
        ("term", "", "nan"),
        ("term_v0", "0 and 5 - 7", "ZERO and RANGE"),
    ],
)
def test_profiles(spark, profile, raw, expected):
    assert one(spark, text.normalise("x", profile), x=("string", raw)) == expected


def test_classifier_profile_is_a_list(spark):
    out = one(spark, text.normalise("x", "classifier"), x=("string", "['0.5', '12', 'a-b', 'May', '3 - 5']"))
    assert out == ["smallpos", "int", "anegb", "date", "range"]


def test_terms(spark):
    assert one(spark, text.terms("x"), x=("string", "['Size (cm)', '-5 mg/kg']")) == ["size", "cm", "neg", "mgunitkg"]


@pytest.mark.parametrize("raw", ["-", "–", "NA", " n/a ", "NaN"])
def test_null_like(spark, raw):
    assert one(spark, text.null_like("x"), x=("string", raw)) == "null"


def test_pad_keeps_the_last_part(spark):
    assert one(spark, text.pad("x", 3), x=("array<bigint>", [1, 2, 3, 4])) == [2, 3, 4]
    assert one(spark, text.pad("x", 3), x=("array<bigint>", [1])) == [1, 0, 0]
    assert one(spark, text.pad("x", 3), x=("array<bigint>", [])) == [0, 0, 0]


def test_tree_text(spark):
    tree = "array<struct<text:string, children:array<struct<text:string>>>>"
    value = [("a", [("b",), ("c",)]), ("d", [("e",), ("f",)])]
    assert one(spark, text.tree_text("x", 2, "all"), x=(tree, value)) == "a b c d e f"
    assert one(spark, text.tree_text("x", 2, "last"), x=(tree, value)) == "d f"
    assert one(spark, text.tree_text("x", 2, "last"), x=(tree, [])) == ""
    assert one(spark, text.tree_text("x", 2, "all"), x=(tree, [("a", None)])) == "a"


def test_collapse_header_styles(spark):
    rows = ("array<array<string>>", [["Dose", " Age"], ["mg", "Age"]])
    assert one(spark, text.collapse_header("x", "colon"), x=rows) == ["Dose : mg", "Age"]
    assert one(spark, text.collapse_header("x", "space"), x=rows) == ["Dose mg", "Age"]
    assert one(spark, text.collapse_header("x", "leading"), x=rows) == [" : Dose : mg", " :  Age : Age"]


def test_one_decimal_equals_exact_rounding(spark):
    rng = random.Random(3)
    values = [0.25, 0.35, 2.25, 2.75, 0.05, 0.45, 1e15 / 3, 4019182544600493.6, 0.0, 99.95, 9.96]
    values += [rng.uniform(0, 10 ** rng.randint(0, 12)) for _ in range(500)]
    values += [rng.randint(0, 2000) / 20 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", numbers.fixed1(F.col("x")).alias("t")).collect():
        assert r.t == f"{r.x:.1f}"


def test_float_text(spark):
    values = ["5", "05", "1.50", "0", "0.0", "10", "100.25", "00.5", "1234567890123"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for r in df.select("x", numbers.float_text("x").alias("t")).collect():
        assert r.t == str(float(r.x))


def test_numbers_to_intervals(spark):
    raw = "10 IL6 5-7 -4 0 2.5 x"
    out = one(spark, numbers.numbers_to_intervals("x"), x=("string", raw))
    assert out == "[9.0|11.0] IL6 5-7 -4 [-0.1|0.1] [2.2|2.8] x"
    assert one(spark, numbers.format_ranges("x"), x=("string", "a 5-7.25 b")) == "a 5.0-7.2 b"


def test_a_number_is_read_once_for_its_interval(spark):
    df = spark.range(1).select(numbers.numbers_to_intervals(F.col("id").cast("string")).alias("x"), numbers.fixed1(F.col("id") * 0.5).alias("y"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("AS DOUBLE)") < 100 and len(plan) < 20_000
    assert one(spark, numbers.numbers_to_intervals("x"), x=("string", "0.05 1e3 99999999999999999999")) == "[0.0|0.1] 1e3 [90000000000000000000.0|110000000000000000000.0]"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("age 5 Years old", "years"),
        ("(years)", None),
        ("5 mg and 3 years x", "years"),
        ("x mggh/l y", "mg*h/l"),
        ("x g l-1 y", "g l-1"),
        ("x mg/m2 y", "mg/m2"),
        ("5mg", None),
    ],
)
def test_detect_unit(spark, raw, expected):
    assert one(spark, numbers.detect_unit("x"), x=("string", raw)) == expected


def test_ranges_and_tokens(spark):
    found = one(spark, numbers.find_ranges("x"), x=("string", "5-7, 1.5–2 and a1-2, IL-6"))
    assert [(r.lo, r.hi) for r in found] == [("5", "7"), ("1.5", "2")]
    from hashlib import sha256

    letters = numbers.TOKEN_LETTERS
    expected = "".join(letters[b % 52] for b in sha256(b"Age|years|5.0|7.5").digest())
    token = numbers.range_token(F.col("a"), F.lit("years"), F.lit("5"), F.lit("7.50"))
    assert one(spark, token, a=("string", "Age")) == expected
    cell = numbers.tokenise_ranges("x", F.lit("Age"), F.lit("years"))
    assert one(spark, cell, x=("string", "a 5-7.5 b")) == f"a  {expected}  b"


def test_literals(spark):
    assert one(spark, numbers.parse_vector("x", 2), x=("string", "[1, 2.5, 3")) == [1.0, 2.5]
    assert one(spark, numbers.parse_vector("x"), x=("string", "[1, oops")) is None
    assert one(spark, numbers.parse_grid("x"), x=("string", "[['a', 'b'], []]")) == [["a", "b"], []]
    interval = one(spark, numbers.parse_interval("x"), x=("string", "[1.5|x]"))
    assert (interval.lo, interval.hi) == (1.5, None)


def test_plain_terms_skip_the_rules_of_their_profile(spark):
    words = ["Dose", "daily", "Birthday", "Days", "lifetimes", "YEAR", "Yearly", "x9", "٣", "a<b", "~", "5mg/kg", "/ml", "a|b/ml", "x/mg", "-", "é_É", "(0.0)", "-3.5%", "7/12/2020", "Zeit Jahr"]
    df = spark.createDataFrame([(w,) for w in [*words, "'0' [1 to 2] 3 [1 to 2], " + " ".join(words), "", " , "]], "c string")
    every = F.transform(
        F.filter(F.split(text.strip_chars("c", "[]()'"), r"(?U)[,\s]+"), lambda t: t != ""),
        lambda t: F.lower(F.regexp_replace(text.normalise(t, "term"), r"(?U)[^\w]", "")),
    )
    got = df.select(text.terms("c").alias("a"), every.alias("b"))
    assert all(r["a"] == r["b"] for r in got.collect())
    # one test decides whether a word meets the rules at all
    assert "RLIKE" in df.select(text.terms("c"))._jdf.queryExecution().analyzed().toString().upper()
