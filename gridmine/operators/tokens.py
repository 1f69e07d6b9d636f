"""Merging token runs: sub-words and bracket spans (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col
from gridmine.functions.text import hold


def _mean_of(vectors: Column) -> Column:
    total = F.aggregate(
        F.slice(vectors, F.lit(2), F.size(vectors)),
        F.get(vectors, 0),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    return F.when(F.size(vectors) == 1, F.get(vectors, 0)).otherwise(F.transform(total, lambda x: x / F.size(vectors)))


def _merge(tokens: DataFrame, doc: Sequence[str], island: Column, piece: Column, vector: str | None) -> DataFrame:
    """One row per island. An island lies inside one text, so collecting its pieces is bounded,
    and the rows already stand together by text, so no further shuffle is needed."""
    fields = ["pos", "_piece", *([vector] if vector else [])]
    runs = (
        tokens.withColumn("_island", island)
        .withColumn("_piece", piece)
        .groupBy(*doc, "_island")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_run"))
    )
    return runs.select(
        *doc,
        F.get("_run.pos", 0).alias("pos"),
        F.array_join("_run._piece", "").alias("token"),
        F.size("_run").cast("long").alias("pieces"),
        *([_mean_of(F.col(f"_run.{vector}")).alias(vector)] if vector else []),
    )


def _runs(items: Column, starts: Column, piece) -> Column:
    """Runs of (pos, token) items that begin at ``starts``: (pos, token, pieces, parts) each."""

    def run(held: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            def fields(part: Column) -> Column:
                return F.struct(
                    F.get(part, 0)["pos"].alias("pos"),
                    F.array_join(F.transform(part, lambda x: piece(x["token"])), "").alias("token"),
                    F.size(part).cast("long").alias("pieces"),
                    F.transform(part, lambda x: x["token"]).alias("parts"),
                )

            return hold(F.slice(items, s + 1, F.coalesce(F.get(held, k + 1), F.size(items)) - s), fields)

        return F.transform(held, one)

    return hold(starts, run)


def _places(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def subword_runs(items: str | Column) -> Column:
    """Runs ``tok ##a ##b`` of an array of (pos, token), in order: (pos, token, pieces, parts) per word.

    All inside the row of a text: nothing is exploded or shuffled.
    """
    items = as_col(items)
    follows = lambda t: F.startswith(t, F.lit("##"))
    starts = F.filter(_places(items), lambda i: (i == 0) | ~follows(F.get(items, i)["token"]))
    return _runs(items, starts, lambda t: F.when(follows(t), F.substring(t, 3, 2**31 - 1)).otherwise(t))


def span_runs(items: str | Column, opening: str = "[", closing: str = "]") -> Column:
    """Tokens from an opening to the next closing bracket as one, of an array of (pos, token).

    Tokens up to the first bracket, and after a closing one up to the next bracket, stand alone.
    """
    items = as_col(items)
    brackets = F.filter(_places(items), lambda i: F.get(items, i)["token"].isin(opening, closing))

    def alone(held: Column) -> Column:
        last = F.size(items) - 1
        none = F.array().cast("array<int>")
        head = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.coalesce(F.get(held, F.lit(0)), last))).otherwise(none)

        def after(b: Column, k: Column) -> Column:
            upto = F.coalesce(F.get(held, k + 1), last)
            return F.when((F.get(items, b)["token"] == closing) & (b < upto), F.sequence(b + 1, upto)).otherwise(none)

        return F.concat(head, F.flatten(F.transform(held, after)))

    return _runs(items, hold(brackets, alone), lambda t: t)


def merge_subwords(tokens: DataFrame, doc: Sequence[str], vector: str | None = None) -> DataFrame:
    """Runs ``tok ##a ##b`` to one word with the mean vector. Windows stay inside one text."""
    w = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    follows = F.col("token").startswith("##")
    island = F.sum(F.when(follows, 0).otherwise(1)).over(w)
    piece = F.when(follows, F.substring("token", 3, 2**31 - 1)).otherwise(F.col("token"))
    return _merge(tokens, doc, island, piece, vector)


def merge_spans(
    tokens: DataFrame, doc: Sequence[str], opening: str = "[", closing: str = "]", vector: str | None = None
) -> DataFrame:
    """Tokens from an opening to the next closing bracket to one token with the mean vector.

    A token stands inside a span if the last bracket before it opened one.
    """
    before = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    bracket = F.when(F.col("token").isin(opening, closing), F.col("token"))
    inside = F.coalesce(F.last(bracket, ignorenulls=True).over(before) == opening, F.lit(False))
    tokens = tokens.withColumn("_inside", inside)
    island = F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(upto)
    return _merge(tokens, doc, island, F.col("token"), vector)
