"""Labelled table sets from keyword queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.functions.predicates import (
    ABSTRACT_SYMPTOMS,
    SYMPTOMS,
    TOPIC,
    TOPIC_WIDE,
    VIRUS,
    VIRUS_WIDE,
    Pattern,
    all_of,
    matches_any,
    matches_none,
    not_empty,
)
from gridmine.functions.text import tree_text
from gridmine.operators.ordering import limit
from gridmine.operators.sampling import union_all
from gridmine.operators.unnest import label, unwind

Paths = dict[str, list[Pattern]]


@dataclass(frozen=True)
class KeywordQuery:
    """Papers with tables where each ``any`` group matches somewhere and each ``none`` group nowhere."""

    any: tuple[Paths, ...] = ()
    none: tuple[Paths, ...] = ()

    def condition(self) -> Column:
        return all_of(
            not_empty(F.col("tables.tableId")),  # as long as tables, but cheaper to scan
            *(matches_any(paths) for paths in self.any),
            *(matches_none(paths) for paths in self.none),
        )


def keyword_filter(papers: DataFrame, query: KeywordQuery) -> DataFrame:
    return papers.filter(query.condition())


def any_table(papers: DataFrame, path: str, condition: Callable[[Column], Column]) -> DataFrame:
    """Papers where ``condition`` holds for the field ``path`` of at least one table; all their tables stay."""
    return papers.filter(F.exists(F.col(path), lambda v: F.coalesce(condition(v), F.lit(False))))


def topic_paths(patterns: list[Pattern], abstract: list[Pattern] | None = None, body: bool = False) -> Paths:
    paths = {
        "title": patterns,
        "abstract.text": abstract or patterns,
        "tables.tableCaption": patterns,
        "figures.figCaption": patterns,
    }
    if body:
        paths["bodyTextFlat.text"] = abstract or patterns
    return paths


def _virus(patterns: list[Pattern]) -> Paths:
    return {"title": patterns, "abstract.text": patterns}


_T2, _V2 = topic_paths(TOPIC), _virus(VIRUS_WIDE)
_T3 = topic_paths([*TOPIC, *SYMPTOMS], [*TOPIC, *ABSTRACT_SYMPTOMS])
_TW = topic_paths([*TOPIC_WIDE, *SYMPTOMS], [*TOPIC_WIDE, *ABSTRACT_SYMPTOMS], body=True)

#: name -> (positive query, negative query, cap on negatives)
QUERY_SETS: dict[str, tuple[KeywordQuery, KeywordQuery | None, int | None]] = {
    "q1": (
        KeywordQuery(any=({"title": VIRUS}, {"tables.tableCaption": TOPIC})),
        KeywordQuery(none=({"title": VIRUS},)),
        1017,
    ),
    "q2": (KeywordQuery(any=(_T2, _V2)), KeywordQuery(none=(_T2, _V2)), 20000),
    "q3": (KeywordQuery(any=(_T3, _V2)), KeywordQuery(none=(_T3, _V2)), 33000),
    "wide": (KeywordQuery(any=(_TW, _V2)), None, None),
}


def unwound(papers: DataFrame, fields: tuple[str, ...] = ("tableCaption", "HMD", "VMD", "Data")) -> DataFrame:
    """(id, table_id, t): one row per table, still nested."""
    tables = unwind(papers.select(F.col("_id").alias("id"), "tables"), "tables", ("tableId", *fields))
    return tables.select("id", F.col("tables.tableId").alias("table_id"), F.col("tables").alias("t"))


def table_rows(tables: DataFrame, tree_depth: int = 2, mode: str = "all") -> DataFrame:
    """Flat rows of unwound tables: (id, table_id, caption, meta_h, meta_v, data)."""
    return tables.select(
        "id",
        "table_id",
        F.col("t.tableCaption").alias("caption"),
        tree_text("t.HMD", tree_depth, mode).alias("meta_h"),
        tree_text("t.VMD", tree_depth, mode).alias("meta_v"),
        F.coalesce(F.to_json("t.Data"), F.lit("[]")).alias("data"),
    )


def labelled_set(
    papers: DataFrame,
    positive: KeywordQuery,
    negative: KeywordQuery,
    cap: int | None,
    tree_depth: int = 2,
    mode: str = "all",
) -> DataFrame:
    """Tables of positive papers (label 1) and of negative papers (label 0, first ``cap`` by id)."""
    pos = unwound(keyword_filter(papers, positive))
    neg = unwound(keyword_filter(papers, negative))
    if cap is not None:  # before the texts are made
        neg = limit(neg, cap, ["id", "table_id"])
    return union_all(label(table_rows(pos, tree_depth, mode), 1), label(table_rows(neg, tree_depth, mode), 0))
