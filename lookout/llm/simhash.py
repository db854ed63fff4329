"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_digest

from lookout.llm.common import documents, packed, stored
from lookout.llm.components import components
from lookout.operators.joins import lookup

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
# Four blocks of 16 bits: two differing bits leave two blocks untouched, so a pair shares
# one of six keys of two blocks.
BLOCK = 16
BLOCKS = tuple(combinations(range(4), 2))
# Fingerprints of a key that are compared pair by pair; fuller keys go the linear way.
PAIRWISE = 64


def fingerprint(text: str | None) -> int:
    """64 majority bits over the XXH64 of all shingles, as a signed number."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + n + 1))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    digests = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :] or ends[-1:])]
    # Big-endian bytes; a histogram of each of the eight gives the ones of its bits.
    h = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    seen = np.stack([np.bincount(h[:, k], minlength=256) for k in range(8)])
    bits = np.packbits(2 * (seen @ BYTE_BITS) > len(h))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _bits(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, block * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all of ``fps(fp)``, distinct, within two bits.

    Keys of two blocks are joined and the Hamming distance is verified. A key with more
    than ``PAIRWISE`` fingerprints isn't expanded into pairs: two of them within two bits
    are both within one bit of some value, so each lists its value and the 32 values one
    flip away outside the key, and each value links its fingerprints to their least.
    """
    keys = fps.select("fp", F.posexplode(F.array(*[
        F.shiftleft(_bits(F.col("fp"), i), BLOCK).bitwiseOR(_bits(F.col("fp"), j)) for i, j in BLOCKS
    ]))).select("fp", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col")).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(lookup(keys, sizes, ["key"], "inner"), "simhash-blocks")
    few = shared.where(F.col("n") <= PAIRWISE)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
    outside = F.array(*[
        F.array(*[F.lit(1 << (k * BLOCK + i) if k * BLOCK + i < 63 else -(1 << 63)).cast("long")
                  for k in range(4) if k not in kept for i in range(BLOCK)])
        for kept in BLOCKS
    ])
    many = shared.where(F.col("n") > PAIRWISE).select("key", "fp", F.explode(F.concat(
        F.array(F.lit(0).cast("long")), F.element_at(outside, (F.shiftrightunsigned("key", 32) + 1).cast("int"))
    )).alias("flip")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = many.groupBy("key", "near").agg(F.min("fp").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = lookup(many, least, ["key", "near"], "inner").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return pairs.select("a", "b").union(stars)


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    A null or empty text has fingerprint zero, a null doc_id takes part without lending
    its id (a group of only such rows has a null component_id), repeated rows and ties
    share a group, an empty table gives no rows, other columns are not read.
    """
    rows = stored(fingerprints(docs), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    labelled = stored(
        lookup(distinct, comps, ["fp"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")),
        "simhash-labels",
    )
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = lookup(labelled, least, ["component"], "inner").select("fp", "component_id")
    return lookup(rows, named, ["fp"], "inner").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` that stay: of each group the document with the smallest doc_id.

    ``groups(doc_id, component_id)`` are those within two bits unless given.
    Of rows that repeat a document, id and text, one stays. Rows without a doc_id can't
    be told from each other by the groups: they stay, one for each text.
    """
    groups = near_groups(docs) if groups is None else groups
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").cast("string").alias("_key")).distinct()
    rows = packed(docs)
    text = F.xxhash64(F.col("_doc.text").cast("string"), F.col("_doc.text").isNull())
    key = F.coalesce(F.col("_doc.doc_id").cast("string"), F.concat(F.lit("null "), text.cast("string")))
    rows = rows.withColumns({"_key": key, "_text": text}).join(gone, "_key", "left_anti")
    first = F.row_number().over(Window.partitionBy("_key", "_text").orderBy("_text"))
    return rows.withColumn("_n", first).where("_n = 1").select("_doc.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
