"""Sorts, limits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.filters import NEGATIVE, POSITIVE, TOPIC_SQL, VIRUS_SQL
from catalog.fixtures import PAPERS_SQL, TERM_PAPERS_SQL, papers, papers_of, sql_any, sql_path, with_terms
from catalog.registry import query, table
from gridmine.operators import ordering, sampling, unnest
from gridmine.plans.labelled import QUERY_SETS, keyword_filter, labelled_set
from gridmine.session import materialise


@query(
    "o1_sort_descending",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
)
def o1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("o2_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1017")
def o2(spark, sf):
    return ordering.limit(table(spark, sf, "orders"), 1017, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey")


@query("o3_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def o3(spark, sf):
    return ordering.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 1000, 500, ["o_orderkey"])


@query(
    "o4_sample_n",
    "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 200",
)
def o4(spark, sf):
    return sampling.sample_n(table(spark, sf, "documents").select("doc_id"), 200, "doc_id", 7)


@query(
    "o5_balance_classes",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id) AS rn FROM labels WHERE quality = 1)
    WHERE rn <= (SELECT count(*) FROM labels WHERE quality = 0)""",
)
def o5(spark, sf):
    rows = table(spark, sf, "labels")
    return sampling.balance(rows.filter("quality = 0"), rows.filter("quality = 1"), "doc_id", 7).select("doc_id")


@query(
    "o6_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id) AS place FROM documents",
)
def o6(spark, sf):
    """The shuffled order, shown by the place of every row."""
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.shuffle(sampling.hash_rank(docs, "doc_id", 7, "place"), "doc_id", 7)


@query(
    "o7_one_per_group",
    """SELECT o_orderstatus, arg_min(o_orderkey, md5(o_orderkey::VARCHAR || '|7')) AS o_orderkey
    FROM orders GROUP BY o_orderstatus""",
)
def o7(spark, sf):
    return sampling.sample_one(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 7)


@query(
    "o8_random_split",
    "SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR || '|100'), 1, 8))::BIGINT / 4294967296.0 < 0.7)::INTEGER AS is_train FROM documents",
)
def o8(spark, sf):
    return sampling.hash_split(table(spark, sf, "documents").select("doc_id"), 0.7, "doc_id", 100)


@query("o8_builtin_split", "SELECT doc_id, 1::BIGINT AS n FROM documents")
def o8_builtin(spark, sf):
    """The two parts together hold every id once."""
    train, test = sampling.random_split(table(spark, sf, "documents").select("doc_id"), [0.7, 0.3], 100)
    both = unnest.label(train, 1, "is_train").unionByName(unnest.label(test, 0, "is_train"))
    return both.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "x1_bag_union",
    "SELECT doc_id, 1 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE toxic = 1",
)
def x1(spark, sf):
    rows = table(spark, sf, "labels")
    pos = unnest.label(rows.filter("quality = 1").select("doc_id"), 1)
    return sampling.union_all(pos, unnest.label(rows.filter("toxic = 1").select("doc_id"), 0))


_META_H = "array_to_string(string_split(caption, '. '), ' ')"
_POSITIVE, _NEGATIVE = (c.replace("regexp_matches(title", "regexp_matches(p.title") for c in (f"{TOPIC_SQL} AND {VIRUS_SQL}", f"NOT {TOPIC_SQL} AND NOT {VIRUS_SQL}"))


def _rows_sql(label: int, condition: str) -> str:
    return f"""SELECT t._id AS id, table_id, caption, {_META_H} AS meta_h, caption AS meta_v,
      to_json(list_transform(string_split(caption, '. '), lambda s: string_split(s, ' ')))::VARCHAR AS data, {label} AS label
      FROM tables t JOIN papers p ON p._id = t._id WHERE {condition}"""


@query(
    "x2_labelled_set",
    f"""WITH {PAPERS_SQL}, pos AS ({_rows_sql(1, _POSITIVE)}),
    neg AS ({_rows_sql(0, _NEGATIVE)} ORDER BY t._id, table_id LIMIT 1017)
    SELECT * FROM pos UNION ALL SELECT * FROM neg""",
)
def x2(spark, sf):
    return labelled_set(papers(spark, sf), POSITIVE, NEGATIVE, 1017)


@query(
    "x2_fixed_query_sets",
    f"WITH {PAPERS_SQL} SELECT 'q1' AS name, 0 AS label, count(*) AS papers FROM papers WHERE (captions IS NULL OR len(captions) > 0) AND NOT regexp_matches(title, 'covid|corona', 'i')"
    f" UNION ALL SELECT 'q2', 0, count(*) FROM papers WHERE (captions IS NULL OR len(captions) > 0)"
    f" AND NOT regexp_matches(array_to_string(list_concat([title], abstract, captions, figures), ' '), 'kidney disease|renal disease', 'i')"
    f" AND NOT regexp_matches(array_to_string(list_concat([title], abstract, captions, figures), ' '), 'CKD')"
    f" AND NOT regexp_matches(title || ' ' || array_to_string(abstract, ' '), 'covid|corona|SARS-CoV-2', 'i')",
)
def x2_fixed(spark, sf):
    """Papers selected by the negative side of the fixed query sets."""
    p = papers(spark, sf, ())
    frames = [
        keyword_filter(p, QUERY_SETS[q][1]).agg(F.count("*").alias("papers")).select(F.lit(q).alias("name"), F.lit(0).alias("label"), "papers")
        for q in ("q1", "q2")
    ]
    return sampling.union_all(*frames)


@query(
    "m14_train_test_sets",
    """WITH ids AS (SELECT doc_id FROM documents WHERE source = 'src7'), pos AS (SELECT doc_id FROM labels WHERE quality = 1), neg AS (SELECT doc_id FROM labels WHERE quality = 0),
    tp AS (SELECT doc_id FROM (SELECT doc_id FROM pos ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 2500) WHERE doc_id NOT IN (SELECT doc_id FROM ids)),
    tn AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id) AS rn FROM neg WHERE doc_id NOT IN (SELECT doc_id FROM ids))
           WHERE rn <= (SELECT count(*) FROM tp)),
    train AS (SELECT doc_id, 1 AS label FROM tp UNION ALL SELECT doc_id, 0 FROM tn),
    test AS (SELECT doc_id, 1 AS label FROM pos WHERE doc_id IN (SELECT doc_id FROM ids) UNION ALL SELECT doc_id, 0 FROM neg WHERE doc_id IN (SELECT doc_id FROM ids))
    SELECT doc_id, label, CASE WHEN (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|8'), doc_id) - 1) % 1000 = 0 THEN 'validation' ELSE 'train' END AS part FROM train
    UNION ALL SELECT doc_id, label, 'test' FROM test""",
)
def m14(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    pos = unnest.label(rows.filter("quality = 1").select("doc_id"), 1)
    neg = unnest.label(rows.filter("quality = 0").select("doc_id"), 0)
    ids = table(spark, sf, "documents").filter("source = 'src7'").select("doc_id")
    train, test = sampling.split_sets(pos, neg, ids, "doc_id", 7)
    placed = sampling.hash_rank(train, "doc_id", 8)
    part = F.when((F.col("_draw") - 1) % 1000 == 0, "validation").otherwise("train")
    return placed.select("doc_id", "label", part.alias("part")).unionByName(test.withColumn("part", F.lit("test")))


_TOPIC = [("kidney disease", True), ("renal disease", True), ("CKD", False)]
_WIDE = [("kidney", True), ("renal", True), ("CKD", False)]
_SIGNS = [(t, True) for t in ("kidney stones", "electrolyte imbalance", "edema", "pruritus", "urine", "dialysis", "anemia", "urina")]
_PAIN = [*_SIGNS, ("abdominal pain", True), ("abdominal discomfort", True)]
_VIRUS = [("covid", True), ("corona", True)]
_VIRUS_MORE = [*_VIRUS, ("SARS-CoV-2", True)]


def _sides_sql() -> str:
    """Papers on either side of every fixed query set, spelled out per field."""
    title = lambda p: sql_any("coalesce(title, '')", p)

    def topic(words, abstract, body=False):
        parts = [title(words), sql_path("abstract", abstract), sql_path("captions", words), sql_path("figures", words)]
        return "(" + " OR ".join([*parts, *([sql_path("body", abstract)] if body else [])]) + ")"

    virus = f"({title(_VIRUS_MORE)} OR {sql_path('abstract', _VIRUS_MORE)})"
    first, second = topic(_TOPIC, _TOPIC), topic([*_TOPIC, *_SIGNS], [*_TOPIC, *_PAIN])
    wide = topic([*_WIDE, *_SIGNS], [*_WIDE, *_PAIN], body=True)
    sides = [
        ("q1", 1, f"{title(_VIRUS)} AND {sql_path('captions', _TOPIC)}"),
        ("q1", 0, f"NOT {title(_VIRUS)}"),
        ("q2", 1, f"{first} AND {virus}"),
        ("q2", 0, f"NOT {first} AND NOT {virus}"),
        ("q3", 1, f"{second} AND {virus}"),
        ("q3", 0, f"NOT {second} AND NOT {virus}"),
        ("wide", 1, f"{wide} AND {virus}"),
    ]
    whole = "(captions IS NULL OR len(captions) > 0)"
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {l} AS label, _id FROM papers WHERE {whole} AND {c}" for n, l, c in sides)


@query("x2_query_sets_with_terms", f"WITH {TERM_PAPERS_SQL} {_sides_sql()}")
def x2_terms(spark, sf):
    """Both sides of the fixed query sets, and the wide one over body text, on papers that hold the terms."""
    p = materialise(papers_of(with_terms(table(spark, sf, "documents").select("doc_id", "lang", "text"))))
    frames = []
    for name, (positive, negative, _) in QUERY_SETS.items():
        for side, label in ((positive, 1), (negative, 0)):
            if side is not None:
                frames.append(keyword_filter(p, side).select(F.lit(name).alias("name"), F.lit(label).alias("label"), "_id"))
    return sampling.union_all(*frames)
