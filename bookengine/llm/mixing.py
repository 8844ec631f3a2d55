"""Mixing sources to target weights with hash-threshold histograms.

A document's place is a hash of its id. A source's budget is a threshold on that hash: documents below
it are in. The threshold is found from histograms (words by source and hash bucket): cumulative sums
name the bucket that the budget ends in, and only that bucket is counted again, finer. Nothing is
sorted; the mix itself is a filter. Thresholds are nested: a larger budget takes a superset. The document at the
threshold gives as many words as the budget still lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookengine.llm.columns import as_docs, byte_steps, doc_text, free_name, hash_bits, numbered, own_columns, word_bounds
from bookengine.llm.store import materialize, scratch

HASH_BITS = 60
LEVEL_BITS = 12
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for start, end, data, offsets in byte_steps(batch):
            sizes[start:end] = np.diff(word_bounds(data, offsets)[2])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes)], ["doc_id", "source", "size"])


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words between ASCII white space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs, "source").mapInArrow(_sizes, f"doc_id {kind}, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code-point order, null last.

    Resharing the excess over ``most_times`` x size by weight ends at one level L: a source gets
    weight x L or its cap. Sources in order of cap / weight are capped up to a point; the level that is left
    for the rest rises up to that point and falls behind it, so L is the largest of the levels that two
    running sums give. The windows run over one row per source, not over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most_times))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "lighter": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
            "all_words": F.sum("source_size").over(whole),
            "all_weight": F.sum("weight").over(whole),
        }
    )
    level = (F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("lighter"))
    ranked = ranked.withColumn("level", F.max(level).over(whole))
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.lit(0.0)).alias("target"))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def budget_thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash that its budget ends in: source, threshold, part (share of that hash's words that the budget still holds).

    ``hashed``: source, hash, size. ``budgets``: source, budget (double). Each round adds up the words
    by source and bucket inside the boundary bucket of the last round and narrows it by 12 bits, until
    a boundary holds one hash value. Documents of equal hash share what is left in proportion to their sizes.
    """
    shift = HASH_BITS
    state = budgets.select("source", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"), "budget")
    while shift > 0:
        shift -= LEVEL_BITS
        inside = _same_source(hashed, state).where(F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS))
        histogram = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "below", "budget").agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        marked = histogram.withColumn("upto", F.col("below") + running)
        # the boundary is the first bucket that reaches the budget; if none does, the last
        reached = marked.groupBy("source", "budget").agg(
            F.min(F.when(F.col("upto") >= F.col("budget"), F.struct("bucket", "upto", "words"))).alias("hit"),
            F.max(F.struct("bucket", "upto", "words")).alias("end"),
        )
        edge = F.coalesce("hit", "end")
        state = reached.select("source", F.shiftleft(edge["bucket"], shift).alias("low"), (edge["upto"] - edge["words"]).alias("below"), "budget", edge["words"].alias("words"))
        state = materialize(state, "boundary")
    # at most the whole of it, where rounding leaves a budget just over all words
    part = F.least(F.col("budget") - F.col("below"), F.col("words").cast("double"))
    return state.select("source", F.col("low").alias("threshold"), part.alias("left"), "words")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: doc_id, size, source_size, target, taken, copies. A source that must give ``r`` times its words
    gives every document floor(r) times and once more the documents under its threshold; the document at the
    threshold gives a part of its words, so that a source takes its target but for less than a word (a word for each
    document, where several have the hash of the threshold). ``copies`` counts whole documents: the one at the
    threshold is in where at least half of it is.

    Null text has size 0; null sources form one source, last in order; a null doc_id is hashed as the
    empty string; rows that repeat a doc_id go together; empty table: empty result.
    """
    with scratch(docs.sparkSession) as keep:
        sizes = word_counts(docs).withColumn("hash", hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        sizes = materialize(sizes, "sizes")
        targets = materialize(source_targets(sizes, weights, most_times), "targets")
        times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        targets = targets.withColumn("times", F.least(times, F.lit(most_times)))
        budgets = targets.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))
        plan = materialize(_same_source(targets, budget_thresholds(sizes.where("size > 0"), budgets), "left"), "plan")
        keep(sizes, plan)
    once_more = F.when(F.col("hash") < F.col("threshold"), F.col("size")).when(F.col("hash") == F.col("threshold"), F.floor(F.col("size") * F.col("left") / F.col("words")))
    taken = F.least(F.col("size") * F.col("times") + F.coalesce(once_more, F.lit(0)), F.col("size") * most_times)
    whole = F.when(F.col("hash") < F.col("threshold"), 1).when((F.col("hash") == F.col("threshold")) & (2 * F.col("left") >= F.col("words")) & (F.col("left") > 0), 1).otherwise(0)
    copies = F.least(F.col("times") + whole, F.lit(most_times))
    return _same_source(sizes, plan).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The documents, with their own columns, as often as the mix takes them, whole. Rows that share an id are mixed each on its own."""
    rows, row = numbered(docs)
    copies = mix_sources(as_docs(rows, row, "source"), weights, most_times).where("copies > 0").select(F.col("doc_id").alias(row), "copies")
    each = free_name("copies", rows)
    joined = rows.join(copies.withColumnRenamed("copies", each), row)
    times = F.explode(F.sequence(F.lit(1), F.col(each).cast("int")))
    return joined.select(*own_columns(docs), times.alias(free_name("copy", docs))).select(*own_columns(docs))
