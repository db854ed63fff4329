"""Mix of sources to target weights along a training curriculum; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lookout.llm.common import documents, packed, stored, words
from lookout.operators.joins import lookup

MAX_REPEATS = 3
# Slope of a source's weight over the training run by its base weight 1, 2, 3: below zero
# it fades out, above zero it grows.
SLOPES = (-0.6, 0.0, 0.6)
# Hex digits of the order key that part a source, so that no task sorts a whole source.
BUCKET_DIGITS = 3


def size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, rank, weight, source_size, target`` of ``sizes(source, size)``.

    Sources share all words by weight; one whose share is above three times its size gets
    just that, and the rest is shared anew. In the order of cap by weight the capped
    sources come first, so one running sum over the sources, not the documents, finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    cap = F.col("source_size") * MAX_REPEATS
    filled = Window.orderBy(cap / F.col("weight"), "rank")
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - cap)
        .withColumn("left", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", cap * F.col("left") <= F.col("weight") * (F.col("total") - F.col("before")))
    )
    free = ~F.col("capped")
    level = F.min(F.when(free, F.struct(cap / F.col("weight"), F.col("rank"), F.col("total") - F.col("before"), F.col("left")))).over(everything)
    per = per.withColumn("level", level)
    rest, weights = F.col("level")["col3"].cast("double"), F.col("level")["left"]
    return per.select(
        "source", "rank", "weight", "source_size",
        F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * rest / weights).alias("target"),
    )


def mix(rows: DataFrame) -> DataFrame:
    """Adds ``source_size, target, taken, passes, position, positions`` to ``rows(doc_id, source, size, ...)``.

    A source's documents stand in the order of the MD5 of their ids. Whole passes over
    the source and one pass that ends within it fill the target to the word below. The
    weight of a source at time t of 0 to 1 is linear, its integral quadratic, and the
    inverse of that at the share of words before a document in a pass is its position in
    that pass. ``positions`` has one for each pass, ``position`` is the first.
    Running sums go through sums by buckets of the order key, so a source with a third of
    all rows is summed in thousands of parts.

    A null source is one of its own, a null doc_id sorts like an empty one, repeated rows
    each take their own part, documents without words take none and have no position.
    """
    own = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_order", own).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    narrow = rows.select("source", "size", "_bucket")
    shares = targets(narrow)
    sums = narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    up_to = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_sum").over(up_to) - F.col("_sum")).drop("_sum")
    keyed = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    plan = lookup(keyed(sums), keyed(shares).drop("source"), ["_source"], "inner").drop("source")
    placed = keyed(rows).join(plan, ["_source", "_bucket"])
    within = (
        Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start = F.col("_before") + F.sum("size").over(within) - F.col("size")
    placed = placed.withColumns({"_start": start, "_demand": F.floor("target").cast("long")})
    placed = placed.withColumn("_whole", F.expr("coalesce(_demand div nullif(source_size, 0), 0)"))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("_demand") - F.col("_whole") * F.col("source_size") - F.col("_start")))
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), F.col("weight"))

    def position(start: Column) -> Column:
        share = start / F.col("_demand")
        return 2 * share / (1 - slope + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))

    every = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda k: position(k * F.col("source_size") + F.col("_start"))
    )
    return (
        placed.withColumn("taken", F.col("_whole") * F.col("size") + part)
        .withColumn("passes", F.when(F.col("taken") > 0, F.col("_whole") + F.when(part > 0, 1).otherwise(0)).otherwise(0))
        .withColumn("position", F.when(F.col("taken") > 0, position(F.col("_start"))))
        .withColumn("positions", F.when(F.col("taken") > 0, every).otherwise(F.array().cast("array<double>")))
        .drop("_source", "_bucket", "_order", "_before", "_start", "_demand", "_whole", "rank", "weight")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """All of ``docs`` with their part in the mix, in the order of their first pass.

    The later passes stand in ``positions``; ``training_order`` has a row for each.
    """
    rows = packed(docs).select(
        "_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"),
        size(F.col("_doc.text")).alias("size"),
    )
    out = mix(rows).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    added = ["size", "source_size", "target", "taken", "passes", "position", "positions"]
    kept = [c for c in docs.columns if c.lower() not in added]
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in kept], *added)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", size(F.col("text")).alias("size"))
    out = mix(stored(rows, "mixing"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "passes", "position").orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def training_order(rows: DataFrame) -> DataFrame:
    """``doc_id, source, pass, words, position`` of ``rows(doc_id, source, size)``, sorted.

    One row for each pass over a document, from 1; the last may take its first words only.
    """
    each = mix(rows).select("doc_id", "source", "size", "taken", F.posexplode("positions").alias("_k", "position"))
    words_of = F.least(F.col("size"), F.col("taken") - F.col("_k") * F.col("size"))
    out = each.select("doc_id", "source", (F.col("_k") + 1).alias("pass"), words_of.alias("words"), "position")
    return out.orderBy("position", "doc_id", "pass")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size"))
    return training_order(stored(rows, "mixing"))
