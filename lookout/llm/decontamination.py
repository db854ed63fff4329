"""Benchmark decontamination: one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lookout.llm.common import documents

WINDOW = 10
# Text of the items that one automaton takes; a larger benchmark is cut into several, each
# run over the texts in turn, so that what a task holds stays bounded.
AUTOMATON_BYTES = 32 << 20
# Word bytes are digits, letters and everything beyond ASCII; all others become spaces.
NORMAL = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as bytes."""
    return (text or "").encode().translate(NORMAL).split()


def windows(text: str | None) -> set[bytes]:
    words = tokens(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))}


class Matcher:
    """Finds windows of the items in normalised words."""

    def __init__(self, items: list[tuple[str, str]]):
        owners = defaultdict(set)
        for item, text in items:
            for w in windows(text):
                owners[w].add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            # One character for each byte; the spaces hold the match to whole words.
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, tuple(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def find(self, line: str, ends: np.ndarray | None, hit: np.ndarray | None, words: list[bytes]):
        """Marks hit words; ``line``: the words with spaces between and around."""
        items = set()
        if not self.empty:
            for end, (length, ids) in self.automaton.iter(line):
                if hit is None:
                    ends = np.cumsum([len(w) + 1 for w in words])
                    hit = np.zeros(len(words), bool)
                # The space before the window stands at the end of the word before it.
                first, last = np.searchsorted(ends, (end - length + 1, end))
                hit[first + (end - length + 1 > 0) : last + 1] = True
                items.update(ids)
        return ends, hit, items


def match(text: str | None, matchers: list[Matcher]) -> tuple[int, np.ndarray | None, set]:
    words = tokens(text)
    ends, hit, items = None, None, set()
    if words:
        line = f" {b' '.join(words).decode('latin-1')} "
        for m in matchers:
            ends, hit, found = m.find(line, ends, hit, words)
            items |= found
    return len(words), hit, items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of runs of hit words in the text as it was given."""
    spans: list[tuple[int, int]] = []
    open_run = False
    for k, m in enumerate(WORD.finditer(text)):
        if hit[k] and open_run:
            spans[-1] = (spans[-1][0], m.end())
        elif hit[k]:
            spans.append(m.span())
        open_run = bool(hit[k])
    return spans


def _shards(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """Items in shares of at most ``AUTOMATON_BYTES`` of windows; an item isn't cut."""
    shards, held = [[]], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for row in rows.orderBy("i").toLocalIterator():
        cost = len(row.t) * (WINDOW + 1)
        if held and held + cost > AUTOMATON_BYTES:
            shards.append([])
            held = 0
        shards[-1].append((row.i, row.t))
        held += cost
    return [s for s in shards if s]


SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<start: int, end: int>>"
)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, with hit words and their original spans.

    The benchmark is a stated query set: its items are read once by the driver in shares
    of bounded size, each share is one broadcast automaton for one pass. Null and empty
    texts have no words, items without words or id match nothing, repeated items count
    once, a null doc_id gives a row with a null doc_id, an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = [spark.sparkContext.broadcast(s) for s in _shards(benchmark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _matchers(held)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, hit, items = match(text, matchers)
                n_hit = 0 if hit is None else int(hit.sum())
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                spans = [{"start": a, "end": b} for a, b in original_spans(text, hit)] if n_hit else []
                rows.append((doc, n, n_hit, len(items), digest, n_hit > 0, spans))
            yield _batch(rows)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 7
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs, all columns as they were."""
    held = [docs.sparkSession.sparkContext.broadcast(s) for s in _shards(benchmark)]

    @F.pandas_udf("boolean")
    def contaminated(texts):
        matchers = _matchers(held)
        return pd.Series([match(t, matchers)[1] is not None for t in texts], dtype=bool)

    return docs.where(~contaminated(docs["text"].cast("string")))


_built: dict[tuple, list[Matcher]] = {}


def _matchers(held) -> list[Matcher]:
    """The automata of the broadcasts, built once in each Python worker."""
    key = tuple(id(h.value) for h in held)
    if key not in _built:
        _built.clear()
        _built[key] = [Matcher(h.value) for h in held]
    return _built[key]


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")
