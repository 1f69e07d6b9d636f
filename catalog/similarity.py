"""Similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import document_tokens, PAPERS_SQL, PART_CELLS_SQL, VECTORS_SQL, papers, part_tables, word_vectors
from catalog.numbers import unit_sql
from catalog.registry import query, table
from gridmine.functions.html import parse_table
from gridmine.functions.numbers import UNITS_COLUMN
from gridmine.functions.text import row_texts
from gridmine.operators.embed import embed_tokens, embed_with, text_vector, vector_digest
from gridmine.operators.joins import cross_refs
from gridmine.plans import similarity
from gridmine.plans.labelled import unwound
from gridmine.session import spread

#: Width of the encoder.
DIMS = WIDTH = 768


def token_vector_sql(t: str, dims: int) -> str:
    """Vector of a token from three 32-bit words of its md5."""
    word = ", ".join(f"{n} := ('0x' || substr(md5({t}), {8 * k + 1}, 8))::BIGINT" for k, n in enumerate("abc"))
    number = "((s.a + s.b * i + s.c * i * i) % 4294967296 // 65536) / 32768.0::DOUBLE - 1"
    return f"list_transform([struct_pack({word})], lambda s: list_transform(generate_series(0, {dims - 1}), lambda i: {number}))[1]"


def text_vector_sql(c: str, dims: int = DIMS) -> str:
    """Mean of the token vectors of a text (lower case, split on blanks); NULL without tokens."""
    words = f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
    vectors = f"list_transform({words}, lambda t: {token_vector_sql('t', dims)})"
    return (
        f"CASE WHEN len({words}) > 0 THEN list_transform([{vectors}], lambda vs: "
        f"list_transform(generate_series(1, {dims}), lambda i: list_avg(list_transform(vs, lambda v: v[i]))))[1] END"
    )


@query(
    "q1_similar_words",
    f"""WITH {VECTORS_SQL}, q AS (SELECT id AS query, vector AS qv FROM v WHERE word IN ('3', '7')),
    s AS (SELECT query, id, word, text, abs(round(list_cosine_similarity(vector, qv), 6)) AS similarity FROM v, q)
    SELECT query, id, word, text, similarity FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 10""",
)
def q1(spark, sf):
    """Every occurrence of two words against the whole store."""
    return similarity.similar_words(word_vectors(spark, sf), ["3", "7"])


@query(
    "q1_similar_words_first_100",
    f"""WITH {VECTORS_SQL}, q AS (SELECT id AS query, vector AS qv FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY id) AS n FROM v WHERE word = '5') WHERE n <= 100),
    s AS (SELECT query, id, word, text, abs(round(list_cosine_similarity(vector, qv), 6)) AS similarity FROM v, q)
    SELECT query, id, word, text, similarity FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 10""",
)
def q1_first(spark, sf):
    return similarity.similar_words(word_vectors(spark, sf), ["5"], max_occurrences=100)


_ATTRIBUTES_SQL = f"""attrs AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS attribute, p_brand AS unit FROM part),
av AS (SELECT attribute, unit, lower(replace(attribute, ' ', '') || ' ' || unit) AS word,
  list_concat({text_vector_sql('attribute')}, {text_vector_sql('unit')}) AS vector FROM attrs)"""


@query(
    "q2_similar_attributes",
    f"""WITH {_ATTRIBUTES_SQL}, found AS (SELECT search, word AS query, vector AS qv
      FROM av JOIN (SELECT unnest(['ring', 'promo']) AS search) ON contains(word, search)),
    s AS (SELECT search, query, word, abs(round(list_cosine_similarity(vector, qv), 6)) AS similarity FROM av, found)
    SELECT search, query, word, similarity FROM (SELECT *, rank() OVER (PARTITION BY search, query ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 10""",
)
def q2(spark, sf):
    attributes = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("attribute"), F.col("p_brand").alias("unit")
    )
    return similarity.similar_attributes(attributes, ["ring", "promo"], DIMS)


@query(
    "q2_similar_attributes_sampled",
    f"""WITH {_ATTRIBUTES_SQL}, found AS (SELECT search, word AS query, vector AS qv, row_number() OVER (PARTITION BY search ORDER BY md5(word || '|0'), word) AS n
      FROM av JOIN (SELECT unnest(['ring', 'promo']) AS search) ON contains(word, search)),
    s AS (SELECT search, query, word, abs(round(list_cosine_similarity(vector, qv), 6)) AS similarity FROM av, found WHERE n <= 15 AND length(word) <= 500)
    SELECT search, query, word, similarity FROM (SELECT *, rank() OVER (PARTITION BY search, query ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 10""",
)
def q2_sampled(spark, sf):
    """The variant with 15 sampled keys per word and a length guard."""
    attributes = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("attribute"), F.col("p_brand").alias("unit")
    )
    return similarity.similar_attributes(attributes, ["ring", "promo"], DIMS, queries=15, max_length=500)


_NULLED = "CASE WHEN lower(trim(value, ' ')) IN ('-', '–', 'na', 'n/a', 'nan') THEN 'null' ELSE value END"
_USABLE_SQL = f"""{PART_CELLS_SQL}, usable AS (
  SELECT paper_id, table_id, row, col, header, n_rows, {_NULLED} AS value FROM part_cells WHERE value IS NOT NULL AND trim(value, ' ') <> '' AND trim(header, ' ') <> '')"""


def _parsed(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", parse_table("html").alias("t"))
    return parsed.select("paper_id", "table_id", "t.*")


def _fold_sql(mode: str) -> str:
    weight = "1.0::DOUBLE / m" if mode == "mean" else "pow(n_rows::DOUBLE, -(m - k + 1))"
    return f"""folded AS (SELECT paper_id, table_id, col, header, list(x ORDER BY i) AS vector FROM (
      SELECT paper_id, table_id, col, header, i, sum(vec[i] * {weight}) AS x FROM (
        SELECT *, row_number() OVER (PARTITION BY paper_id, table_id, col ORDER BY row) AS k, count(*) OVER (PARTITION BY paper_id, table_id, col) AS m
        FROM (SELECT *, {text_vector_sql('value')} AS vec FROM usable)), (SELECT unnest(generate_series(1, {DIMS})) AS i)
      GROUP BY paper_id, table_id, col, header, i) GROUP BY paper_id, table_id, col, header)"""


def _centroid_sql(rows: str, dims: int) -> str:
    """refs(ref, ref_vector) from rows(ref, vec)."""
    return f"""refs AS (SELECT ref, list(x ORDER BY i) AS ref_vector FROM (
      SELECT ref, i, avg(vec[i]) AS x FROM ({rows}), (SELECT unnest(generate_series(1, {dims})) AS i) GROUP BY ref, i) GROUP BY ref)"""


# References are columns of the tables themselves: all names of a type, by name.
_REF_SQL = f"SELECT p_type AS ref, {text_vector_sql('p_name')} AS vec FROM (SELECT DISTINCT p_type, p_name FROM part WHERE p_type IN ('PROMO', 'SMALL'))"


def _refs(spark, sf):
    types = table(spark, sf, "part").filter(F.col("p_type").isin("PROMO", "SMALL"))
    return types.select(F.col("p_type").alias("ref"), F.col("p_name").alias("phrase")).distinct()


def _column_sql(mode: str) -> str:
    return f"""WITH {_USABLE_SQL}, {_fold_sql(mode)}, {_centroid_sql(_REF_SQL, DIMS)}
    SELECT paper_id, table_id, col, header, max(s) FILTER (WHERE ref = 'PROMO') AS "PROMO_similarity", max(s) FILTER (WHERE ref = 'SMALL') AS "SMALL_similarity" FROM (
      SELECT *, abs(round(list_cosine_similarity(vector, ref_vector), 6)) AS s FROM folded, refs) GROUP BY paper_id, table_id, col, header"""


@query("q4_column_similarity", _column_sql("mean"))
def q4(spark, sf):
    scores = similarity.column_similarity(_parsed(spark, sf), _refs(spark, sf), DIMS)
    return similarity.pivot_scores(scores, ["paper_id", "table_id", "col", "header"], ["PROMO", "SMALL"])


@query("q4_column_similarity_decay", _column_sql("decay"))
def q4_decay(spark, sf):
    scores = similarity.column_similarity(_parsed(spark, sf), _refs(spark, sf), DIMS, mode="decay")
    return similarity.pivot_scores(scores, ["paper_id", "table_id", "col", "header"], ["PROMO", "SMALL"])


_ANU_REF_SQL = f"""SELECT ref, list_concat(list_concat({text_vector_sql('attribute')}, {text_vector_sql('number')}), {text_vector_sql('unit')}) AS vec FROM (
  SELECT DISTINCT 'age' AS ref, 'Mean age (years)' AS attribute, p_size::VARCHAR AS number, 'years' AS unit FROM part
  UNION ALL SELECT DISTINCT 'dose', 'Dose level', p_size::VARCHAR, 'mg/ml' FROM part)"""


@query(
    "q3_column_similarity_attribute_number_unit",
    f"""WITH {_USABLE_SQL}, {_fold_sql('mean')}, units AS (
      SELECT paper_id, table_id, col, arg_max(coalesce({unit_sql('value', UNITS_COLUMN)}, {unit_sql('header', UNITS_COLUMN)}, 'UNKNOWN'), row) AS unit FROM usable GROUP BY paper_id, table_id, col),
    whole AS (SELECT paper_id, table_id, col, header, list_concat(list_concat({text_vector_sql('header')}, vector), {text_vector_sql('unit')}) AS vector FROM folded JOIN units USING (paper_id, table_id, col)),
    {_centroid_sql(_ANU_REF_SQL, 3 * DIMS)}
    SELECT paper_id, table_id, col, header, ref, abs(round(list_cosine_similarity(vector, ref_vector), 6)) AS similarity FROM whole, refs""",
)
def q3(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("number")).distinct()
    age = sizes.select(F.lit("age").alias("ref"), F.lit("Mean age (years)").alias("attribute"), "number", F.lit("years").alias("unit"))
    dose = sizes.select(F.lit("dose").alias("ref"), F.lit("Dose level").alias("attribute"), "number", F.lit("mg/ml").alias("unit"))
    return similarity.column_similarity_anu(_parsed(spark, sf), age.unionByName(dose), DIMS)


# Tables of papers against three reference tables.
_REF_TABLES = {
    "ref1": {"id": "0", "table_id": 1},
    "ref2": {"id": "1", "table_id": 2},
    "ref3": {"id": "2", "table_id": 1},
}
_ROWS_SQL = f"{PAPERS_SQL}, tv AS (SELECT _id AS id, table_id, list_transform(string_split(caption, '. '), lambda s: replace(s, '~', '')) AS rows FROM tables)"


def _paper_rows(spark, sf):
    rows = unwound(papers(spark, sf, ("Data",)), ("Data",))
    return rows.select("id", "table_id", row_texts("t.Data").alias("rows"))


def _table_sql(vector: str) -> str:
    refs = ", ".join(
        f"coalesce(abs(round(list_cosine_similarity(vector, (SELECT vector FROM x WHERE id = '{k['id']}' AND table_id = {k['table_id']})), 6)), 0) AS {r}_similarity"
        for r, k in _REF_TABLES.items()
    )
    return f"WITH {_ROWS_SQL}, x AS MATERIALIZED (SELECT id, table_id, {vector} AS vector FROM tv) SELECT id, table_id, {refs} FROM x"


@query("q5_table_similarity", _table_sql(text_vector_sql("array_to_string(rows, ' ')")))
def q5(spark, sf):
    return similarity.table_similarity(_paper_rows(spark, sf), _REF_TABLES, DIMS)


# Row vectors are listed once per table, then added up position by position.
_SUM_SQL = _table_sql("vector").replace(
    "x AS MATERIALIZED (SELECT id, table_id, vector AS vector FROM tv)",
    f"""rv AS (SELECT id, table_id, list_filter(list_transform(rows, lambda r: {text_vector_sql('r')}), lambda z: z IS NOT NULL) AS vs FROM tv),
    x AS MATERIALIZED (SELECT id, table_id, CASE WHEN len(vs) > 0 THEN list_transform(generate_series(1, {DIMS}), lambda p: list_sum(list_transform(vs, lambda z: z[p]))) END AS vector FROM rv)""",
)


@query("q5_table_similarity_row_sum", _SUM_SQL)
def q5_sum(spark, sf):
    return similarity.table_similarity(_paper_rows(spark, sf), _REF_TABLES, DIMS, pool="sum")


@query("q5_table_similarity_row_mean", _SUM_SQL)
def q5_rows(spark, sf):
    """Dividing by the number of rows does not turn a vector, so scores equal those of the sum."""
    return similarity.table_similarity(_paper_rows(spark, sf), _REF_TABLES, DIMS, pool="rows")


@query("q5_table_similarity_last_row", _table_sql(text_vector_sql("rows[-1]")))
def q5_last(spark, sf):
    return similarity.table_similarity(_paper_rows(spark, sf), _REF_TABLES, DIMS, pool="last")


@query(
    "q6_rank_words",
    f"""WITH {VECTORS_SQL}, probe AS (SELECT vector AS p FROM v WHERE word = '4' ORDER BY id LIMIT 1)
    SELECT id, word, round(list_cosine_similarity(vector[1:60], p[1:60]), 6) + 0.0 AS similarity FROM v, probe""",
)
def q6(spark, sf):
    ranked = similarity.rank_words(word_vectors(spark, sf), "4")
    return ranked.withColumn("similarity", F.round("similarity", 6))


def digest_sql(v: str) -> str:
    """Sum of a vector, and its sum weighed by place."""
    return f"round(list_sum({v}), 6) + 0.0 AS total, round(list_sum(list_transform({v}, lambda x, i: x * i)), 6) + 0.0 AS weighed"


def _with_digest(vector, places):
    d = vector_digest(vector)
    return [F.size(vector).alias("width"), F.round(d[0], places).alias("total"), F.round(d[1], places).alias("weighed")]


@query(
    "m12_embed_tokens",
    f"""SELECT token, len(v)::INTEGER AS width, {digest_sql("v")} FROM (SELECT token, {token_vector_sql('token', WIDTH)} AS v
    FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents) WHERE token <> '')""",
)
def m12(spark, sf):
    """One vector per distinct token, shown by two numbers that every component enters."""
    tokens = document_tokens(spark, sf).select("token").distinct()
    return embed_tokens(tokens, WIDTH).select("token", *_with_digest("vector", 6))


def _millionths(x):
    """Whole number next to a component times 10^6, halves away from 0."""
    return F.when(x < 0, -F.floor(0.5 - x * 1e6)).otherwise(F.floor(x * 1e6 + 0.5))


# The digest of a mean vector is the mean of the digests of its tokens.
@query(
    "m12_embed_texts",
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS token FROM documents),
    d AS MATERIALIZED (SELECT token, v, list_sum(v) AS total, list_sum(list_transform(v, lambda x, i: x * i)) AS weighed
      FROM (SELECT token, {token_vector_sql('token', WIDTH)} AS v FROM (SELECT DISTINCT token FROM w))),
    digests AS (SELECT doc_id, {WIDTH} AS width, round(avg(total), 3) + 0.0 AS total, round(avg(weighed), 3) + 0.0 AS weighed FROM w JOIN d USING (token) GROUP BY doc_id),
    parts AS (SELECT doc_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT doc_id, token, count(*) AS n FROM w GROUP BY doc_id, token) JOIN d USING (token)),
    vectors AS (SELECT doc_id, string_agg(round(x * 1000000)::BIGINT::VARCHAR, ' ' ORDER BY i) AS vector
      FROM (SELECT doc_id, i, sum((x + 1) * n) / sum(n) - 1 AS x FROM parts GROUP BY doc_id, i) GROUP BY doc_id)
    SELECT doc_id, width, total, weighed, vector FROM digests JOIN vectors USING (doc_id)""",
)
def m12_texts(spark, sf):
    """One vector per document: every component, in millionths, and the two numbers."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text_vector("text", WIDTH).alias("vector"))
    whole = F.array_join(F.transform("vector", lambda x: _millionths(x).cast("string")), " ").alias("vector")
    return docs.where(F.col("vector").isNotNull()).select("doc_id", *_with_digest("vector", 3), whole)


def _letter_encoder():
    """A plugged encoder: share of five vowels in a text."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[t.lower().count(v) / max(1, len(t)) for v in "aeiou"] for t in texts]

    return encode


@query(
    "m12_embed_plugged_encoder",
    """SELECT doc_id, round((length(text) - length(replace(lower(text), 'a', ''))) / greatest(1, length(text)), 6) + 0.0 AS share_a,
      round((length(text) - length(replace(lower(text), 'e', ''))) / greatest(1, length(text)), 6) + 0.0 AS share_e FROM documents""",
)
def m12_plugged(spark, sf):
    embedded = embed_with(table(spark, sf, "documents").select("doc_id", "text"), "text", _letter_encoder)
    return embedded.select("doc_id", F.round(F.get("vector", 0), 6).alias("share_a"), F.round(F.get("vector", 1), 6).alias("share_e"))


@query(
    "j1_rows_by_many_references",
    f"""WITH {VECTORS_SQL}, q AS (SELECT id AS ref, vector AS rv FROM v WHERE word = '8')
    SELECT id, ref, abs(round(list_cosine_similarity(vector, rv), 6)) AS similarity FROM v, q""",
)
def j1_many(spark, sf):
    """The block form for reference sets that must not travel with the plan."""
    v = word_vectors(spark, sf)
    refs = v.filter("word = '8'").select(F.col("id").alias("ref"), F.col("vector").alias("ref_vector"))
    return cross_refs(v.select("id", "vector"), refs, max_inline=0)


def _register_large_query_set(name: str, **limits: int) -> None:
    """Query sets that must not travel with the plan."""

    @query(
        f"q1_similar_words_{name}",
        f"""WITH {VECTORS_SQL}, q AS (SELECT id AS query, vector AS qv FROM v WHERE word = '8'),
        s AS (SELECT query, id, word, abs(round(list_cosine_similarity(vector, qv), 6)) AS similarity FROM v, q)
        SELECT query, id, word, similarity FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 10""",
    )
    def words(spark, sf):
        v = word_vectors(spark, sf)
        queries = v.filter("word = '8'").select(F.col("id").alias("query"), "vector")
        return similarity.nearest(v.select("id", "word", "vector"), queries, 10, max_inline=0, **limits)


_register_large_query_set("in_blocks")
_register_large_query_set("pruned", max_scan=0)


# Vectors of mixed length, NULL and zero, as rows and as references; the same rows either way.
def _mixed_sql(short: int, refs: str) -> str:
    return f"""WITH m AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN NULL
      WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
      WHEN vec_id % {short} = 0 THEN embedding[1:32]::DOUBLE[] WHEN vec_id % 13 = 0 THEN list_concat(embedding, embedding[1:8])::DOUBLE[]
      ELSE embedding::DOUBLE[] END AS vector FROM embeddings),
    ok AS (SELECT * FROM m WHERE vector IS NOT NULL AND list_sum(list_transform(vector, lambda x: x * x)) > 0),
    s AS (SELECT a.id, b.id AS ref, abs(round(list_cosine_similarity(a.vector, b.vector), 6)) AS similarity FROM ok a JOIN ok b ON len(a.vector) = len(b.vector) WHERE b.{refs})"""


def _mixed(spark, sf, short):
    v, i = F.col("embedding").cast("array<double>"), F.col("vec_id")
    mixed = F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.transform(v, lambda x: F.lit(0.0)))
    mixed = mixed.when(i % short == 0, F.slice(v, 1, 32)).when(i % 13 == 0, F.concat(v, F.slice(v, 1, 8))).otherwise(v)
    return table(spark, sf, "embeddings").select(i.alias("id"), mixed.alias("vector"))


#: Every fifth vector is short; two ids in nine are references or queries.
_MIXED = (5, "id % 9 < 2")


def _register_mixed(name: str, **limit: int) -> None:
    """References inline if they are small, and in blocks."""
    short, chosen = _MIXED

    @query(f"j1_mixed_vectors_{name}", f"{_mixed_sql(*_MIXED)} SELECT id, ref, similarity FROM s")
    def refs(spark, sf):
        m = _mixed(spark, sf, short)
        return cross_refs(m, m.where(chosen).select(F.col("id").alias("ref"), F.col("vector").alias("ref_vector")), **limit)


def _register_mixed_search(name: str, kinds: tuple[int, str] = _MIXED, **limits: int) -> None:
    short, chosen = kinds

    @query(
        f"q1_mixed_vectors_{name}",
        f"{_mixed_sql(*kinds)} SELECT ref AS query, id, similarity FROM (SELECT *, rank() OVER (PARTITION BY ref ORDER BY similarity DESC) AS rk FROM s) WHERE rk <= 5",
    )
    def words(spark, sf):
        m = _mixed(spark, sf, short)
        return similarity.nearest(m, m.where(chosen).select(F.col("id").alias("query"), "vector"), 5, **limits)


_register_mixed("inline")
_register_mixed("in_blocks", max_inline=0)
_register_mixed_search("inline")
_register_mixed_search("in_blocks", max_inline=0)
_register_mixed_search("pruned", (3, "id % 20 = 0"), max_inline=0, max_scan=0)


@query("q6_rank_absent_word", "SELECT vec_id AS id, '' AS word, 0.0::DOUBLE AS similarity FROM embeddings WHERE false")
def q6_absent(spark, sf):
    return similarity.rank_words(word_vectors(spark, sf), "no such word")


# Web tables: the cells of the part tables as list literals, the header first; every tenth cannot be read.


def _web_tables(spark, sf):
    parsed = _parsed(spark, sf)
    texts = F.transform(F.concat(F.array("header"), "rows"), lambda r: F.concat(F.lit("['"), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "', '"), F.lit("']")))
    literal = F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))
    broken = F.col("paper_id").cast("long") % 10 == 3
    return parsed.select("paper_id", "table_id", F.when(broken, F.lit("[['a', ")).otherwise(literal).alias("table"))


def _read_web_tables(spark, sf):
    return similarity.literal_tables(_web_tables(spark, sf), keys=("paper_id", "table_id"))


@query("q4_web_table_columns", _column_sql("mean").replace("WHERE value IS NOT NULL", "WHERE paper_id::BIGINT % 10 <> 3 AND value IS NOT NULL"))
def q4_web(spark, sf):
    """Column similarity over tables stored as literals."""
    scores = similarity.column_similarity(_read_web_tables(spark, sf), _refs(spark, sf), DIMS)
    return similarity.pivot_scores(scores, ["paper_id", "table_id", "col", "header"], ["PROMO", "SMALL"])


_PART_REFS = {"ref1": {"id": "1", "table_id": 1}, "ref2": {"id": "12", "table_id": 1}, "ref3": {"id": "25", "table_id": 1}}


def _part_rows_sql(where: str) -> str:
    refs = ", ".join(
        f"coalesce(abs(round(list_cosine_similarity(vector, (SELECT vector FROM x WHERE id = '{k['id']}')), 6)), 0) AS {r}_similarity"
        for r, k in _PART_REFS.items()
    )
    return f"""WITH {PART_CELLS_SQL}, t AS (SELECT paper_id AS id, table_id, string_agg(value, ' ' ORDER BY row, col) AS body FROM part_cells WHERE {where} GROUP BY paper_id, table_id),
    x AS MATERIALIZED (SELECT id, table_id, {text_vector_sql('body')} AS vector FROM t) SELECT id, table_id, {refs} FROM x"""


@query("q5_web_tables", _part_rows_sql("paper_id::BIGINT % 10 <> 3"))
def q5_web(spark, sf):
    """Table similarity over tables stored as literals."""
    tables = _read_web_tables(spark, sf).select(F.col("paper_id").alias("id"), "table_id", row_texts("rows").alias("rows"))
    return similarity.table_similarity(tables, _PART_REFS, DIMS)


@query("q5_html_tables_without_header", _part_rows_sql("true"))
def q5_html(spark, sf):
    """Table similarity straight from markup that has no header."""
    bare = part_tables(spark, sf).select(F.col("paper_id").alias("id"), "table_id", F.regexp_replace("html", "<thead>.*</thead>", "").alias("html"))
    return similarity.table_similarity(similarity.html_row_texts(bare), _PART_REFS, DIMS)
