"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (an item with fewer words is one window).
Of the hashes of the ``GRAM``-word grams in a window, winnowing keeps the smallest, so whoever shares
a window shares that fingerprint: every occurrence is found. Documents keep the smallest gram hash of
each of their windows, these fingerprints are joined with the benchmark's, and hits are extended: in
documents that share a fingerprint, every place with its hash is compared word by word with the
windows it stands for. Short items are fingerprinted by all their words.

DataFrame functions only. Documents are read twice: once for fingerprints (only those that meet the
benchmark leave the task), once for the result. The benchmark's fingerprints are broadcast while
their number is below ``MOST_BROADCAST``; beyond it the join shuffles distinct fingerprints.

Nulls: a null text has no words; a null item_id is an item named ``''``; rows with a null or repeated
doc_id each give a row (rows of equal id and text give equal rows). Items of equal id are one item. Empty texts and
tables give rows without hits or no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import ascii_lower, materialise, text_or_empty, words

#: What stands between words: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
#: Fingerprint rows (of two longs) that may be broadcast: at most 32 MB.
MOST_BROADCAST = 2_000_000


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def gram_hashes(w: Column, n: int, tag: int = 0) -> Column:
    """Hashes of all runs of n words; the tag keeps lengths apart."""
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda first, i: F.xxhash64(F.lit(tag), first, *[F.get(w, i + k) for k in range(1, n)]))


def window_minima(grams: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Smallest gram hash of each window of words, in order of windows."""
    span = window - gram + 1
    starts = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (span - 1), F.lit(0)))
    return F.transform(starts, lambda first, i: F.least(first, *[F.get(grams, i + k) for k in range(1, span)]))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, n, window, f, at): distinct windows of each item, their fingerprint and its place inside."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(text_or_empty()).alias("w"))
    items = items.select("item", "w", gram_hashes(F.col("w"), GRAM).alias("g"))
    full = items.where(F.size("w") >= WINDOW).select("item", "w", "g", F.explode(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))).alias("i"))
    full = full.select("item", F.lit(WINDOW).alias("n"), F.slice("w", F.col("i"), F.lit(WINDOW)).alias("window"), F.slice("g", F.col("i"), F.lit(WINDOW - GRAM + 1)).alias("g"))
    full = full.select("item", "n", "window", F.array_min("g").alias("f"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("at"))
    short = items.where((F.size("w") > 0) & (F.size("w") < WINDOW)).select("item", F.size("w").alias("n"), F.col("w").alias("window"))
    return full.unionByName(short.select("item", "n", "window", _whole_hash(F.col("window")).alias("f"), F.lit(0).alias("at"))).distinct()


def _whole_hash(w: Column) -> Column:
    """Hash of a short item, as ``gram_hashes`` of its length gives it."""
    cases = F.lit(None).cast("long")
    for n in range(1, WINDOW):
        cases = F.when(F.size(w) == n, F.xxhash64(F.lit(n), *[F.get(w, F.lit(k)) for k in range(n)])).otherwise(cases)
    return cases


def _fitting(prints: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(prints) if rows <= MOST_BROADCAST else prints


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, digest, item, start, n): every window of an item in every document, ``start`` from 0."""
    windows = materialise(benchmark_windows(benchmark))
    prints = materialise(windows.select("f").distinct())
    n_prints, n_windows = prints.count(), windows.count()
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ten numbers
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    read = whole.select("doc_id", "digest", item_words(F.col("text")).alias("w"))

    # 1. fingerprints of documents that are fingerprints of the benchmark too
    kept = [window_minima(F.col("g"))] if WINDOW in lengths else []
    kept += [gram_hashes(F.col("w"), n, n) for n in lengths if n < WINDOW]
    if not kept:
        kept = [F.array().cast("array<long>")]
    marked = read.select("doc_id", "digest", "w", gram_hashes(F.col("w"), GRAM).alias("g"))
    marked = marked.select("doc_id", "digest", F.explode(F.array_distinct(F.concat(*kept))).alias("f"))
    met = materialise(marked.join(_fitting(prints, n_prints), "f").select("doc_id", "digest").distinct())

    # 2. extension, in these documents only: places with the hash, then the words of the window
    known = whole.join(met, whole["doc_id"].eqNullSafe(met["doc_id"]) & (whole["digest"] == met["digest"]), "left_semi")
    known = known.dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", item_words(F.col("text")).alias("w"))
    parts = []
    for n in lengths:
        # a place carries the words around it that any window through it can hold
        back = WINDOW - GRAM if n == WINDOW else 0
        grams = gram_hashes(F.col("w"), GRAM) if n == WINDOW else gram_hashes(F.col("w"), n, n)
        around = _around(F.col("g"), F.col("w"), back, 2 * n)
        places = known.select("doc_id", "digest", "w", grams.alias("g")).select("doc_id", "digest", F.explode(around).alias("p")).select("doc_id", "digest", "p.*")
        own = windows.where(F.col("n") == n).select("item", "window", "f", "at")
        joined = places.join(_fitting(own, n_windows), "f")
        skip = F.col("j") - F.col("at") - F.greatest(F.col("j") - back, F.lit(0))
        same = (F.col("j") >= F.col("at")) & (F.slice("near", F.greatest(skip, F.lit(0)) + 1, F.lit(n)) == F.col("window"))
        parts.append(joined.where(same).select("doc_id", "digest", "item", (F.col("j") - F.col("at")).alias("start"), F.lit(n).alias("n")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest long, item string, start int, n int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _around(grams: Column, w: Column, back: int, most: int) -> Column:
    """Each gram hash with its place and the words near it."""
    return F.transform(grams, lambda f, j: F.struct(f.alias("f"), j.alias("j"), F.slice(w, F.greatest(j - back, F.lit(0)) + 1, F.lit(most)).alias("near")))


def _digest() -> Column:
    return F.xxhash64(F.lit(11), text_or_empty())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids), contaminated; and its digest."""
    found = hits(docs, benchmark)
    per_doc = found.groupBy("doc_id", "digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.size(item_words(text_or_empty())).cast("long").alias("n_words"))
    per_doc = materialise(per_doc)
    joined = read.join(per_doc, read["doc_id"].eqNullSafe(per_doc["doc_id"]) & (read["digest"] == per_doc["digest"]), "left")
    return joined.select(
        read["doc_id"],
        read["digest"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with the columns they had."""
    bad = materialise(hits(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct())
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(bad["_doc"]) & (_digest() == bad["_digest"]), "left_anti")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
