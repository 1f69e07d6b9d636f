"""Aggregations: vector pooling, vocabularies, dictionaries, scoring reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmine.functions.numbers import range_token
from gridmine.functions.predicates import Pattern, as_col, matches_any, not_empty
from gridmine.operators.ordering import assign_ids, number_rows
from gridmine.session import materialise, partition_count


def vec_mean(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean per group.

    The summarizer merges partial results before the shuffle, so one frequent key
    costs one vector per map task.
    """
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias(vector))


def vec_sum(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    return df.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector(vector))).alias(vector))


def centroid(refs: DataFrame, by: Sequence[str] = (), vector: str = "vector") -> DataFrame:
    """Mean vector of a reference set."""
    return vec_mean(refs, by, vector)


def vec_row_mean(df: DataFrame, by: Sequence[str], rows: Column, vector: str = "vector") -> DataFrame:
    """Vector sum divided by the number of rows of the table, blank rows included."""
    total = df.groupBy(*by).agg(
        vector_to_array(Summarizer.sum(array_to_vector(vector))).alias(vector), F.max(rows).alias("_n")
    )
    return total.withColumn(vector, F.transform(vector, lambda x: x / F.col("_n"))).drop("_n")


def vec_last(df: DataFrame, by: Sequence[str], order: str, vector: str = "vector") -> DataFrame:
    """Vector of the last row of a group."""
    return df.groupBy(*by).agg(F.max_by(vector, order).alias(vector))


def vec_fold(
    cells: DataFrame,
    by: Sequence[str],
    rows: str,
    order: Sequence[str] = ("row",),
    mode: str = "mean",
    vector: str = "vector",
) -> DataFrame:
    """Column vector from its cell vectors.

    ``mean`` is the plain mean. ``decay`` divides the running sum by the number of body rows n
    after every cell; unrolled, the cell that is r-th from the end weighs n^-r. That fold merges: a
    stretch of a column is (cells, weighted sum), and two stretches in row order are (a + b, A * n^-b + B).
    Tasks hold ranges of the order, so one huge column is folded in many of them, and only a vector per
    stretch is shuffled.
    """
    if mode == "mean":
        return vec_mean(cells, by, vector)
    parts = _folded_stretches(cells, list(by), rows, list(order), vector)
    later = W.partitionBy(*by).orderBy(F.desc("_seq")).rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.sum("_cells").over(later), F.lit(0))
    weight = F.pow(F.col("_rows"), -after.cast("double"))
    return vec_sum(parts.withColumn("_w", weight).withColumn(vector, _scaled(vector, F.col("_w"))), by, vector)


def _folded_stretches(cells: DataFrame, by: list[str], rows: str, order: list[str], vector: str) -> DataFrame:
    """(by, _seq, _cells, _rows, vector): the fold of each stretch of a group, numbered in row order."""
    keys = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            codes = [np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices) for k in range(len(by))]
            lists = batch.column(len(by) + 1)
            width = np.asarray(lists.value_lengths().fill_null(0))
            for code in [*codes, width]:  # vectors of other length are told apart, as they cannot be added
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            body = np.asarray(batch.column(len(by)).cast(pa.float64()))
            place = np.repeat(ends, ends - starts) - np.arange(n)  # 1 for the last cell of its stretch
            weight = body ** -place.astype(float)
            flat = np.asarray(lists.flatten(), dtype=float)
            at = np.concatenate([[0], np.cumsum(width)])
            sums = [weight[a:b] @ flat[at[a] : at[b]].reshape(b - a, -1) for a, b in zip(starts, ends, strict=True)]
            folded = pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))
            picked = [batch.column(k).take(pa.array(starts)) for k in range(len(by))]
            numbers = [pa.array(seq + np.arange(len(starts))), pa.array(ends - starts), pa.array(body[starts])]
            seq += len(starts)
            yield pa.record_batch([*picked, *numbers, folded], [*by, "_seq", "_cells", "_rows", vector])

    wanted = cells.select(*by, rows, F.col(vector).cast("array<double>").alias(vector), *[c for c in order if c not in by])
    n = partition_count(cells.sparkSession)
    ordered = wanted.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    return ordered.mapInArrow(run, f"{keys}_seq long, _cells long, _rows double, `{vector}` array<double>")


def _scaled(vector: str, weight: Column) -> Column:
    return F.transform(F.col(vector), lambda x: x * weight)


def keyword_counts(papers: DataFrame, terms: Sequence[str], fields: Sequence[str], ignore_case: bool = True) -> DataFrame:
    """Per keyword: documents hit and tables in them. One pass over the papers, no join."""

    def hit(term: str) -> Column:
        pattern: list[Pattern] = [(term, ignore_case)]
        return F.when(matches_any({f: pattern for f in fields}), F.lit(term))

    tables = F.col("tables.tableId")  # as long as tables, but cheaper to scan
    return (
        papers.filter(not_empty(tables, missing_passes=False))
        .select(F.explode(F.array_compact(F.array(*[hit(t) for t in terms]))).alias("keyword"), F.size(tables).alias("_t"))
        .groupBy("keyword")
        .agg(F.count("*").alias("documents"), F.sum("_t").alias("tables"))
    )


def range_dictionary(ranges: DataFrame, seen: str | None = None) -> DataFrame:
    """Distinct (attribute, unit, lo, hi) with the token of the range; lo and hi are number texts.

    ``seen`` names a column whose smallest value tells where a range is first seen.
    """
    keys = ["attribute", "unit", "lo", "hi"]
    known = ranges.select(*keys).distinct() if seen is None else ranges.groupBy(*keys).agg(F.min(seen).alias("seen"))
    return known.withColumn("token", range_token(F.col("attribute"), F.col("unit"), F.col("lo"), F.col("hi")))


def range_dictionary_ids(ranges: DataFrame, seen: Sequence[str]) -> DataFrame:
    """Distinct (attribute, lo, hi, unit) with sequential ids in order of first sight."""
    keys = ["attribute", "lo", "hi", "unit"]
    first = ranges.groupBy(*keys).agg(F.min(F.struct(*seen)).alias("_seen"))
    return assign_ids(materialise(first), ["_seen", *keys]).drop("_seen")


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent (word, freq), ties in word order.

    A histogram of frequencies tells the frequency at the cut; only words of just that frequency are ordered.
    """
    histogram = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("words"))
    # one row per frequency, of which a corpus of n tokens has at most sqrt(2 n)
    above = F.coalesce(F.sum("words").over(W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = histogram.withColumn("above", above).where(F.col("above") + F.col("words") > size).orderBy("above").first()
    if cut is None:
        return counts
    tied = counts.where(F.col("freq") == cut["freq"]).orderBy("word").limit(max(0, size - cut["above"]))
    return counts.where(F.col("freq") > cut["freq"]).unionByName(tied)


#: Survivors of a cut that are numbered in one task.
MOST_SORTED = 200_000


def vocabulary(tokens: DataFrame, size: int | None, min_df: int = 1, doc: str | None = None) -> DataFrame:
    """Most frequent words (all if no size is given) with index 1..; ties in word order; optional minimum document count.

    Words are counted once and cut before any are numbered.
    """
    word = F.col("token").alias("word")
    if min_df > 1:
        inside = tokens.groupBy(doc, word).agg(F.count(F.lit(1)).alias("n"))
        counts = inside.groupBy("word").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("_df"))
        counts = counts.filter(F.col("_df") >= min_df).drop("_df")
    else:
        counts = tokens.groupBy(word).agg(F.count(F.lit(1)).alias("freq"))
    return number_words(counts, size)


def number_words(counts: DataFrame, size: int | None) -> DataFrame:
    """The most frequent (word, freq), all if no size is given, with idx 1..; ties in word order."""
    if size is not None:
        counts = most_frequent(materialise(counts), size)
        if size <= MOST_SORTED:
            return counts.withColumn("idx", F.row_number().over(W.orderBy(F.desc("freq"), "word")).cast("long"))
    return number_rows(counts.withColumn("_less", -F.col("freq")), ["_less", "word"], "idx").drop("_less")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: precision, recall, f1, support, and the overall accuracy.

    Everything after the confusion matrix works on classes x classes rows.
    """
    matrix = confusion(df, label, prediction).select(
        F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p"), "n"
    )
    long = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("l").alias("class"), F.lit(1).alias("is_label"), "l", "p", "n"),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("is_label"), "l", "p", "n"),
            )
        ).alias("x")
    ).select("x.*")
    hit = F.when((F.col("l") == F.col("p")) & (F.col("is_label") == 1), F.col("n")).otherwise(0)
    per_class = long.groupBy("class").agg(
        F.sum(hit).alias("tp"),
        F.sum(F.when(F.col("is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_label") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    precision, recall = ratio("tp", "predicted"), ratio("tp", "support")
    everything = W.partitionBy(F.lit(0))  # one row per class
    return per_class.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
        (F.sum("tp").over(everything) / F.sum("support").over(everything)).alias("accuracy"),
    )


def precision_of(tp: Column, fp: Column) -> Column:
    """Precision in percent from true and false positive counts."""
    return F.round(F.try_divide(tp * F.lit(100.0), tp + fp), 1)


def token_key(tokens: str | Column, unit: str | Column) -> Column:
    """Tokens joined without separator, a blank, the unit; lower case."""
    return F.lower(F.trim(F.concat(F.trim(F.array_join(as_col(tokens), "")), F.lit(" "), as_col(unit))))
