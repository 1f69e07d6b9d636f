"""Similarity search over words, attributes, columns and tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmine.functions.html import parse_table
from gridmine.functions.numbers import UNITS_COLUMN, detect_unit, parse_grid, resolve_unit
from gridmine.functions.predicates import cell_guard, guard, header_guard, search
from gridmine.functions.text import null_like, row_texts
from gridmine.functions.vectors import cosine, score_refs, vec_concat
from gridmine.operators.aggregates import token_key, vec_mean
from gridmine.operators.embed import fold_vector, row_sum_vector, text_vector, words_of
from gridmine.operators.joins import block_cogroup, cross_refs, pair_cosines, small_table
from gridmine.operators.neighbours import block_candidates, near_candidates, reaching
from gridmine.operators.ordering import topk_ties
from gridmine.operators.sampling import seeded_hash
from gridmine.session import materialise, short_batches


#: Query sets up to this many vectors travel with the plan; larger ones are joined in blocks.
MAX_INLINE_QUERIES = 4_096
#: Up to this many vectors, comparing all blocks costs less than the rounds that leave some out.
MAX_SCAN = 1 << 18


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    query_id: str = "query",
    max_inline: int = MAX_INLINE_QUERIES,
    max_scan: int = MAX_SCAN,
) -> DataFrame:
    """Top ``k`` with ties for every query: (query_id, columns of ``vectors``, similarity).

    Queries are scored as matrices per Arrow batch, and a task only emits rows that reach
    its own current k-th score, so the final ranking shuffles a few rows per task. A query
    set that is too large to travel meets only the cells of vectors that can hold its nearest ones
    (``near_candidates``, nothing is missed); up to ``max_scan`` vectors it meets all of them in bounded blocks.
    All ways score with ``pair_cosines``: no row for NULL, zero and differently long vectors.
    """
    keep = [c for c in vectors.columns if c != "vector"]
    kind = queries.schema[query_id].dataType
    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"`{query_id}` {kind.simpleString()}, {fields}, `similarity` double"
    vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>")).select(*keep, "vector")
    queries = queries.select(query_id, F.col("vector").cast("array<double>").alias("_query_vector"))
    few = small_table(queries, max_inline)
    if few is None:
        vectors, queries = materialise(vectors), materialise(queries)
        n = vectors.count()
        if n > max_scan:
            candidates = near_candidates(vectors, queries, n, k, query_id)
        else:
            asked = queries.withColumn("_kth", F.lit(-1.0))
            candidates = block_cogroup(vectors, asked, block_candidates(keep, query_id, k), schema)
    else:
        candidates = vectors.mapInArrow(_batch_candidates(keep, query_id, few, k), schema)
    return topk_ties(materialise(candidates), [query_id], k, "similarity")


def _batch_candidates(keep: Sequence[str], query_id: str, queries: pa.Table, k: int):
    """Map function: rows that reach the running k-th best score of their task, per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((queries.num_rows, k), -np.inf)
        for batch in batches:
            for first in range(0, queries.num_rows, _QUERIES_AT_ONCE):
                own = queries.slice(first, _QUERIES_AT_ONCE)
                part = slice(first, first + _QUERIES_AT_ONCE)
                sims = pair_cosines(batch["vector"], own["_query_vector"]).T
                query, row, best[part] = reaching(sims, best[part])
                if len(row):
                    picked = batch.select(keep).take(pa.array(row))
                    ids = own[query_id].take(pa.array(query)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, *picked.columns, pa.array(sims[query, row])], names=[query_id, *keep, "similarity"])

    return run


_QUERIES_AT_ONCE = 256


def similar_words(
    vectors: DataFrame, words: Sequence[str], k: int = 10, max_occurrences: int | None = None
) -> DataFrame:
    """Nearest vectors for every occurrence of the words; ``vectors`` is (id, word, text, vector).

    ``max_occurrences`` keeps the first occurrences (by id) of each word as queries.
    """
    queries = vectors.filter(F.col("word").isin(list(words)))
    if max_occurrences is not None:
        w = W.partitionBy("word").orderBy("id")
        queries = queries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_occurrences).drop("_n")
    return nearest(vectors, queries.select(F.col("id").alias("query"), "vector"), k)


# Attribute texts that are skipped.
ATTRIBUTE_STOP = ["0", "", "na"]


def attribute_key(attribute: str, unit: str) -> Column:
    return token_key(words_of(attribute, lower=False), F.array_join(words_of(unit, lower=False), ""))


def attribute_vectors(attributes: DataFrame, dims: int, max_length: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(attribute, unit) to key and attribute vector joined with the unit vector; no shuffle.

    ``max_length`` leaves out longer attributes, for encoders that need it.
    """
    kept = attributes.filter(guard("attribute", max_length, ATTRIBUTE_STOP))
    return kept.select(
        *also,
        "attribute",
        "unit",
        attribute_key("attribute", "unit").alias("word"),
        vec_concat(text_vector("attribute", dims), text_vector("unit", dims)).alias("vector"),
    )


def similar_attributes(
    attributes: DataFrame,
    words: Sequence[str],
    dims: int,
    k: int = 10,
    queries: int | None = None,
    seed: int = 0,
    max_length: int | None = None,
    **limits: int,
) -> DataFrame:
    """Nearest attribute/unit keys for the keys that contain a word.

    ``queries`` samples so many keys per word; by default all of them are queries. Keys are
    found before anything is encoded. ``limits`` go to ``nearest``.
    """
    distinct = attributes.select("attribute", "unit").distinct()
    keyed = distinct.filter(guard("attribute", max_length, ATTRIBUTE_STOP)).withColumn("_key", attribute_key("attribute", "unit"))
    hits = F.array_compact(F.array(*[F.when(search("_key", w), F.lit(w)) for w in words]))
    found = keyed.select("attribute", "unit", F.explode(hits).alias("search"), "_key")
    if queries is not None:
        w = W.partitionBy("search").orderBy(seeded_hash("_key", seed), "_key")
        found = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= queries)
    drawn = attribute_vectors(found, dims, max_length, ["search"])
    drawn = drawn.filter(F.col("vector").isNotNull()).select(F.concat_ws("|", "search", "word").alias("query"), "vector")
    vectors = attribute_vectors(distinct, dims, max_length).filter(F.col("vector").isNotNull())
    return nearest(vectors.select("word", "vector"), drawn.dropDuplicates(["query"]), k, **limits).select(
        F.substring_index("query", "|", 1).alias("search"),
        F.expr("substring(query, instr(query, '|') + 1)").alias("query"),
        "word",
        "similarity",
    )


def table_columns(tables: DataFrame, keys: tuple[str, ...] = ("paper_id", "table_id")) -> DataFrame:
    """Parsed tables (keys, header, rows) to named columns: (keys, col, header, cells, n_rows).

    ``cells`` holds the usable cells in row order; blank headers and empty columns vanish.
    Everything is turned inside the row of the table, so nothing is shuffled.
    """

    def column(c: Column) -> Column:
        cells = F.transform("rows", lambda r: null_like(F.get(r, c)))
        return F.struct(
            c.alias("col"), F.get("header", c).alias("header"), F.filter(cells, lambda v: cell_guard(v)).alias("cells")
        )

    last = F.size("header") - 1
    kept = tables.filter(F.size("header") > 0)
    columns = kept.select(
        *keys, F.size("rows").alias("n_rows"), F.explode(F.transform(F.sequence(F.lit(0), last), column)).alias("_c")
    )
    return columns.select(*keys, "_c.*", "n_rows").filter(header_guard("header") & (F.size("cells") > 0))


def literal_tables(tables: DataFrame, literal: str = "table", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Tables stored as list-of-lists literals: (keys, header, rows), the first row being the header.

    Literals that cannot be read, and those without a row, are left out.
    """
    grids = tables.select(*keys, parse_grid(literal).alias("_g")).filter(F.size("_g") > 0)
    return grids.select(*keys, F.get("_g", F.lit(0)).alias("header"), F.slice("_g", F.lit(2), F.size("_g")).alias("rows"))


def html_row_texts(tables: DataFrame, html: str = "html", keys: Sequence[str] = ("id", "table_id")) -> DataFrame:
    """Stored markup, with or without a header, to (keys, rows): one text per body row, for ``table_similarity``."""
    return tables.select(*keys, row_texts(parse_table(html, header_optional=True)["rows"]).alias("rows"))


def _centroids(refs: DataFrame) -> DataFrame:
    """(ref, vector) to (ref, ref_vector)."""
    return vec_mean(refs.select("ref", F.col("vector").alias("ref_vector")), ["ref"], "ref_vector")


def reference_vectors(refs: DataFrame, text: str, dims: int) -> DataFrame:
    """Reference columns (ref, phrase) to their centroids (ref, ref_vector)."""
    return _centroids(refs.select("ref", text_vector(text, dims).alias("vector")))


def attribute_number_unit(attribute: str, number: Column, unit: str, dims: int) -> Column:
    return vec_concat(text_vector(attribute, dims), number, text_vector(unit, dims))


def column_similarity_anu(
    tables: DataFrame, refs: DataFrame, dims: int, mode: str = "mean", keys: tuple[str, ...] = ("paper_id", "table_id")
) -> DataFrame:
    """Columns as (attribute, number, unit) vectors against reference triples (ref, attribute, number, unit).

    The unit of a column is that of its last cell, else of its header, else ``UNKNOWN``.
    """
    unit = resolve_unit(
        detect_unit("header", UNITS_COLUMN), detect_unit(F.element_at("cells", -1), UNITS_COLUMN), "cell", "UNKNOWN"
    )
    columns = table_columns(tables, keys).withColumn("unit", unit)
    numbers = fold_vector("cells", "n_rows", dims, mode)
    whole = columns.select(*keys, "col", "header", attribute_number_unit("header", numbers, "unit", dims).alias("vector"))
    centroids = _centroids(
        refs.select("ref", attribute_number_unit("attribute", text_vector("number", dims), "unit", dims).alias("vector"))
    )
    return cross_refs(whole, centroids)


def column_similarity(
    tables: DataFrame, refs: DataFrame, dims: int, mode: str = "mean", keys: tuple[str, ...] = ("paper_id", "table_id")
) -> DataFrame:
    """Literal cells of every column against reference columns (ref, phrase)."""
    columns = table_columns(tables, keys)
    vectors = columns.select(*keys, "col", "header", fold_vector("cells", "n_rows", dims, mode).alias("vector"))
    return cross_refs(vectors, reference_vectors(refs, "phrase", dims))


def pivot_scores(scores: DataFrame, keys: Sequence[str], refs: Sequence[str]) -> DataFrame:
    """One ``<ref>_similarity`` column per reference; a missing score is 0."""
    return scores.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("ref") == r, F.col("similarity"))), F.lit(0.0)).alias(f"{r}_similarity")
            for r in refs
        ]
    )


def table_vector(row_texts: Column, dims: int, pool: str = "text") -> Column:
    """Vector of a table from its row texts; nothing is exploded or shuffled.

    ``text`` embeds the whole text; ``rows`` sums row vectors over the number of rows,
    blank rows counted; ``sum`` adds row vectors; ``last`` takes the last row.
    """
    if pool == "text":
        return text_vector(F.array_join(row_texts, " "), dims)
    if pool == "last":
        return text_vector(F.element_at(row_texts, -1), dims)
    total = row_sum_vector(row_texts, dims)
    if pool == "rows":
        total = F.transform(total, lambda x: x / F.size(row_texts))
    return total


def table_similarity(tables: DataFrame, refs: dict[str, dict], dims: int, pool: str = "text") -> DataFrame:
    """Every table against named reference tables, given by their key values.

    ``tables`` is (id, table_id, rows array<string>). Tables without a vector score 0.
    """
    tables = short_batches(tables)
    vector = table_vector(F.col("rows"), dims, pool).alias("vector")
    is_ref = [reduce(and_, [F.col(c) == v for c, v in key.items()]) for key in refs.values()]
    found = {}
    if refs:  # all references in one job; the key filters run below the encoder
        named = F.array_compact(F.array(*[F.when(hit, F.lit(r)) for r, hit in zip(refs, is_ref, strict=True)]))
        rows = tables.filter(reduce(or_, is_ref)).select(F.explode(named).alias("ref"), vector)
        one = rows.groupBy("ref").agg(F.first("vector", ignorenulls=True).alias("vector"))
        found = {r["ref"]: r["vector"] for r in one.collect() if r["vector"] is not None}
    names = list(found)
    vectors = tables.select("id", "table_id", vector)
    scores = score_refs("vector", np.array(list(found.values()), dtype=float)) if found else F.lit(None).cast("array<double>")
    scored = vectors.select("id", "table_id", scores.alias("_s"))
    return scored.select(
        "id",
        "table_id",
        *[
            (F.coalesce(F.get("_s", names.index(r)), F.lit(0.0)) if r in names else F.lit(0.0)).alias(f"{r}_similarity")
            for r in refs
        ],
    )


def rank_words(vectors: DataFrame, word: str, dims: int = 60) -> DataFrame:
    """Plain cosine of the whole store to the first vector of a word, over the first components, sorted.

    A word that is not in the store has no row.
    """
    probe = vectors.filter(F.col("word") == word).agg(F.min_by("vector", "id").alias("vector")).first()
    if probe["vector"] is None:
        return vectors.select("id", "word", F.lit(0.0).alias("similarity")).limit(0)
    target = F.from_json(F.lit(str(list(probe["vector"])[:dims])), "array<double>")
    return (
        vectors.select("id", "word", cosine(F.slice("vector", 1, dims), target).alias("similarity"))
        .orderBy(F.col("similarity").desc(), "id")
    )
