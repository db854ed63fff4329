"""Ranked lexical search: an Aho-Corasick automaton of the items' terms reads the texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lookout.llm.common import documents, stored
from lookout.llm.decontamination import tokens

BEST = 20
# Bytes of terms that one block of items holds on average. Each block is an automaton and a
# pass over the texts of its own, so that what is broadcast has a bound.
BLOCK_BYTES = 8 << 20
# Cells of the block of scores that a task computes at once: documents by items.
CELLS = 1 << 21
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Terms:
    """The distinct terms of a block of items, and for each term the items that hold it."""

    words: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    n_items: int

    def automaton(self) -> ahocorasick.Automaton:
        """Spaces around a term hold its matches to whole words; the output is its number."""
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(self.words):
            found.add_word(f" {word.decode('latin-1')} ", k)
        if self.words:
            found.make_automaton()
        return found


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, word, repeats`` of ``items(item_id, text)``; rows alike in both count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, word, n)
                for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())
                for word, n in Counter(tokens(text)).items()
            ]
            columns = list(zip(*rows)) or [[]] * 3
            kinds = (batch.schema.field("item_id").type, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["item_id", "word", "repeats"])

    narrow = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = dict(items.dtypes)["item_id"]
    found = narrow.mapInArrow(run, f"item_id {kind}, word binary, repeats long")
    return found.groupBy("item_id", "word").agg(F.sum("repeats").alias("repeats"))


def term_counts(docs: DataFrame, held: Broadcast) -> DataFrame:
    """``doc_id, n, terms, tf`` of every text with a term; ``terms`` are those of the automaton.

    ``n`` counts all terms of the text, found or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, output = held.value.automaton(), itemgetter(1)
        search = automaton.iter if held.value.words else lambda line: ()
        for batch in batches:
            ids, n, terms, tf, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = tokens(text)
                if not words:
                    continue
                counts = Counter(map(output, search(f" {b' '.join(words).decode('latin-1')} ")))
                ids.append(doc)
                n.append(len(words))
                terms += counts.keys()
                tf += counts.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists one after another, and the lists' lengths."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)


class Best:
    """The ``BEST`` documents of each item among those shown so far."""

    def __init__(self, n_items: int):
        self.least = np.ones(n_items, np.int64)
        empty = np.zeros(0, np.int64)
        self.held = (empty, empty, empty, np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray):
        """``scores`` of documents by items; ties go to the smaller id, rows without come last."""
        doc, item = np.nonzero(scores >= self.least)
        fresh = (item, scores[doc, item], ids[doc], no_id[doc])
        item, score, doc, bare = (np.concatenate(x) for x in zip(self.held, fresh))
        order = np.lexsort((doc, bare, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        full = place == BEST - 1
        self.least[item[full]] = score[order][full]
        kept = order[place < BEST]
        self.held = (item[place < BEST], score[kept], doc[kept], bare[kept])


def scored(counts: DataFrame, held: Broadcast, weights: Broadcast, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = held.value
        fan = np.diff(terms.starts)
        rows = max(1, CELLS // max(1, terms.n_items))
        best = Best(terms.n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                term, sizes = _flat(batch.column("terms"))
                tf, _ = _flat(batch.column("tf"))
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                n = batch.column("n").to_numpy()
                m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n.tolist()], np.int64)
                value = weights.value[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                # Each found term goes to the items that hold it.
                many = fan[term]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                posting = np.repeat(terms.starts[term], many) + step
                scores = np.zeros(batch.num_rows * terms.n_items, np.int64)
                np.add.at(scores, np.repeat(doc, many) * terms.n_items + terms.items[posting], np.repeat(value, many) * terms.repeats[posting])
                ids = batch.column("doc_id")
                best.add(scores.reshape(batch.num_rows, terms.n_items), ids.fill_null(LAST_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, doc, bare = best.held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=bare), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def _block(rows: pd.DataFrame) -> Terms:
    """Postings of one block; ``rows(item, word, repeats)``."""
    rows = rows.sort_values(["word", "item"], kind="stable")
    words, first = np.unique(rows["word"].to_numpy(object), return_index=True)
    return Terms(
        list(words), np.r_[first, len(rows)].astype(np.int64), rows["item"].to_numpy(np.int64),
        rows["repeats"].to_numpy(np.int64), int(rows["item"].max()) + 1 if len(rows) else 0,
    )


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``BEST`` documents of each item.

    All texts are read once for a block of items by an automaton of the block's terms;
    every document is scored against every item where it lies, and a task hands on its
    best alone. Null and empty texts have no terms and count nowhere, an item without
    terms and an empty table give no rows, rows of one item_id alike in text count once
    and others add their terms, each row of a repeated doc_id is a document, a null doc_id
    ranks last among ties, a null item_id is an item like others, other columns aren't
    read. An item isn't cut, so its distinct terms have to fit into one automaton.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items), "search-terms")
    held_bytes = terms.agg(F.sum(F.length("word") + 16)).first()[0] or 0
    blocks = -(-held_bytes // BLOCK_BYTES)
    kind = dict(items.dtypes)["item_id"]
    results = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for k in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        if not mine.num_rows:
            continue
        numbers: dict = {}
        item = [numbers.setdefault(x, len(numbers)) for x in mine.column("item_id").to_pylist()]
        rows = pd.DataFrame({"item": item, "word": mine.column("word").to_pylist(), "repeats": mine.column("repeats").to_pylist()})
        held = spark.sparkContext.broadcast(_block(rows))
        counts = stored(term_counts(docs, held), "search-counts")
        size = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            break
        # One row per term of the block, whose size is bounded as the block is.
        df = counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        weights = np.zeros(len(held.value.words), np.int64)
        for r in df:
            weights[r.t] = weight(size.docs, r["count"])
        tops = scored(counts, held, spark.sparkContext.broadcast(weights), size.docs, size.terms)
        named = spark.createDataFrame([(i, x) for x, i in numbers.items()], f"item int, item_id {kind}")
        results = results.union(stored(tops, "search-best").join(named, "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
