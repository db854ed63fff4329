"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lookout.llm.common import documents

# What an automaton is built from: so many documents of a language at most, taken whole
# in the order of a hash of their ids until they hold so many symbols.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 40_000
LONG = 10_000
# Symbols: 0 all but letters, 1 to LETTERS the commonest letters, then rare letters, then
# the filling of a last block.
LETTERS = 62
RARE, FILL, WIDTH = LETTERS + 1, LETTERS + 2, LETTERS + 3
# Texts are parsed in blocks of so many symbols side by side; each begins a new phrase.
BLOCK = 512
BLOCKS_AT_ONCE = 4096


class Symbols:
    """Maps lower-cased text to symbols; runs of other characters become one 0."""

    def __init__(self, texts: list[str]):
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        self.letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.table: np.ndarray | None = None

    def encode(self, text: str) -> np.ndarray:
        if self.table is None:
            self.table = np.full(0x3000, RARE, np.uint8)
            self.table[[i for i in range(0x3000) if not chr(i).isalpha()]] = 0
            self.high = {ord(c): i for i, c in enumerate(self.letters, 1) if ord(c) >= 0x3000}
            for i, c in enumerate(self.letters, 1):
                if ord(c) < 0x3000:
                    self.table[ord(c)] = i
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[np.minimum(points, 0x2FFF)]
        for i in np.flatnonzero(points >= 0x3000):
            p = int(points[i])
            out[i] = self.high.get(p, RARE if chr(p).isalpha() else 0)
        keep = out != 0
        keep[1:] |= out[:-1] != 0
        return out[keep]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all factors of ``s``; state 0 is its start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def parser(step: list[dict[int, int]], base: int) -> np.ndarray:
    """Flat table of the parse: at state * WIDTH + symbol, twice the next one, plus 1
    where a phrase begins. ``base`` is where this table will lie among the others."""
    first = np.full(WIDTH, base * 2 + 1, np.int32)
    for c, t in step[0].items():
        first[c] = (base + t * WIDTH) * 2 + 1
    table = np.tile(first, (len(step), 1))
    for s, to in enumerate(step):
        if s:
            for c, t in to.items():
                table[s, c] = (base + t * WIDTH) * 2
        table[s, FILL] = (base + s * WIDTH) * 2
    return table.ravel()


class Languages:
    """Automata of all languages; ``classify`` gives language and score of texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.symbols = Symbols([t for texts in samples.values() for t in texts])
        tables, self.starts, sizes = [], [], []
        for name in self.names:
            coded = [self.symbols.encode(t) for t in samples[name]]
            joined = np.concatenate([np.append(c, 0).astype(np.uint8) for c in coded]) if coded else np.zeros(1, np.uint8)
            base = sum(map(len, tables))
            tables.append(parser(suffix_automaton(joined.tolist()), base))
            self.starts.append(base)
            sizes.append(max(2, len(joined)))
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.cost = np.log(np.array(sizes, float))

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language: rows are texts."""
        blocks = [max(1, -(-len(c) // BLOCK)) for c in coded]
        flat = np.full(sum(blocks) * BLOCK, FILL, np.uint8)
        at = 0
        for c, b in zip(coded, blocks):
            flat[at : at + len(c)] = c
            at += b * BLOCK
        grid = flat.reshape(-1, BLOCK)
        counts = np.zeros((len(self.names), len(grid)), np.int32)
        for lo in range(0, len(grid), BLOCKS_AT_ONCE):
            part = np.ascontiguousarray(grid[lo : lo + BLOCKS_AT_ONCE].T).astype(np.int32)
            for k, start in enumerate(self.starts):
                state = np.full(part.shape[1], start * 2, np.int32)
                n = counts[k, lo : lo + BLOCKS_AT_ONCE]
                for row in part:
                    state >>= 1
                    state += row
                    state = self.table[state]
                    n += state & 1
        return np.add.reduceat(counts, np.cumsum([0, *blocks[:-1]]), axis=1).T

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        coded = {i: c for i, t in enumerate(texts) if t and (c := self.symbols.encode(t)).any()}
        if not coded:
            return out
        need = self.phrases(list(coded.values())) * self.cost
        for i, row in zip(coded, need):
            best = int(row.argmin())
            others = np.delete(row, best)
            out[i] = (self.names[best], float(others.min() / (others.min() + row[best])) if len(others) else 1.0)
        return out


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame) -> Languages:
    """Automata from a bounded sample of labelled rows: ``SAMPLE_DOCS`` of each language."""
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string"), F.col("lang")).alias("h"), _held_out(F.col("doc_id")).alias("out"),
    ).where("not out and lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.length("text") > LONG, "h")
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    samples: dict[str, list[str]] = {}
    held: Counter = Counter()
    for row in sorted(chosen.select("lang", "n", "text").toLocalIterator(), key=lambda r: (r.lang, r.n)):
        if held[row.lang] < SAMPLE_CHARS and (len(row.text) <= LONG or not held[row.lang]):
            samples.setdefault(row.lang, []).append(row.text)
            held[row.lang] += len(row.text)
    return Languages(samples)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    Whole texts are parsed. Null texts and texts without a letter are ``und`` with score
    0, ties go to the first language by name, a null doc_id counts as held out (it is
    never learned from), without any labelled row all are ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = held.value.classify(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))
