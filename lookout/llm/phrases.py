"""Removal of repeated passages by phrase automata.

Of each window of 13 words the five-word string with the smallest hash is its anchor, the
first if there are several; any copy of the window has the same. Neighbouring windows of
one anchor form a segment. Anchors of several documents show which segments may hold a
recurring passage. Segments are dealt by anchor to shards; each shard confirms its phrases,
compiles them into an Aho-Corasick automaton over word numbers, and streams its segments
past it, so that every occurrence of a phrase is found where it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lookout.llm.common import documents, stored
from lookout.llm.substrings import MIX, NO_ID, ODD, _mixed
from lookout.operators.joins import lookup

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
# Bytes of segments that a shard holds on average, and of one segment with its columns. The
# windows of an anchor whose segments alone would fill a shard are compared by an aggregate.
SHARD_BYTES = 2 << 20
SEGMENT_BYTES = 150
CROWDED = SHARD_BYTES // SEGMENT_BYTES
# Text whose segments a task looks for at a time, and whose words it hashes at a time.
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 17
SPACES = b" \t\n\x0b\x0c\r"
FILTER_BITS = 1 << 25


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as they are asked for."""

    def __init__(self, seed: int = 0):
        self.base = (int(ODD) + 2 * seed) % (1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            every = [np.full(n, x, np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64))]
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), x], dtype=np.uint64) for x in every)
        return self.up, self.down


def words_of(data: bytes, powers: Powers, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between ``gaps``, block by block; a block ends at a gap."""
    is_gap, gap = np.zeros(256, bool), re.compile(b"[" + re.escape(gaps) + b"]")
    is_gap[list(gaps)] = True
    parts, at = [], 0
    while at < len(data):
        cut = gap.search(data, min(at + BLOCK_BYTES, len(data)))
        end = cut.end() if cut else len(data)
        b = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~is_gap[b], [False]])
        first, last = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        up, down = powers.to(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * up[: len(b)], out=total[1:])
        h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * MIX
        parts.append((first + at, last + at, _mixed(h)))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*parts)))


class Chunk:
    """The words of some texts one after another, and the segments of their windows."""

    def __init__(self, texts: list[bytes], powers: Powers):
        self.data = b"\n".join(texts)
        self.start, self.end, h = words_of(self.data, powers, SPACES)
        self.n = len(h)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.ends = np.searchsorted(self.start, begin)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.ends))
        m = self.n - WINDOW + 1
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :]) if m > 0 else np.zeros(0, np.int64)
        if not len(inside):
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.anchor = self.segment = np.zeros(0, np.int64)
            return
        up, down = powers.to(self.n + 1)
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[: self.n], out=total[1:])
        gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: self.n - GRAM + 1])
        least, at = gram[:m].copy(), np.zeros(m, np.int8)
        for j in range(1, SPAN):
            np.copyto(at, j, where=gram[j : j + m] < least)
            np.minimum(least, gram[j : j + m], out=least)
        at = inside + at[inside]
        fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
        self.first, self.last = inside[fresh], inside[np.r_[fresh[1:], len(inside)] - 1]
        self.doc, self.anchor = doc[self.first], gram[at[fresh]].view(np.int64)
        end = self.last + WINDOW
        size = (end - self.first).astype(np.uint64) * MIX
        self.segment = _mixed((total[end] - total[self.first]) * down[self.first] + size).view(np.int64)


    def words(self, first: int, last: int) -> bytes:
        """Those of the windows from ``first`` to ``last``, one space between them."""
        return b" ".join(self.data[self.start[first] : self.end[last + WINDOW - 1]].split())


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Values row by row; few of them are Python objects at a time, whatever the batch's size."""
    for at in range(0, batch.num_rows, 64):
        part = batch.slice(at, 64)
        yield from zip(*(part.column(n).to_pylist() for n in names))


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in shares of about ``most`` bytes, with each share's first row."""
    share, size, at = [], 0, 0
    for (text,) in rows_of(batch, "text"):
        data = text.encode()
        share.append(data)
        size += len(data)
        if size >= most:
            yield at, share
            share, size, at = [], 0, at + len(share)
    if share:
        yield at, share


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, key, d, text``: the order of documents, and the hash that names one."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return narrow.withColumn("d", F.xxhash64("key", "text"))


def _recurring(texts: DataFrame) -> DataFrame:
    """``v``: anchors that several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for at, share in _chunks(batch, CHUNK_BYTES):
                c = Chunk(share, powers)
                key = keys[at : at + len(share)][c.doc]
                order = np.lexsort((key, c.anchor))
                v, key = c.anchor[order], key[order]
                first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][: len(v)])
                last = np.r_[first[1:], len(v)][: len(first)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[first], key[first], key[last])], names=["v", "lo", "hi"])

    found = texts.select("key", "text").mapInArrow(run, "v long, lo long, hi long")
    return found.groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("v")


def _filter(anchors: DataFrame) -> np.ndarray:
    """A bit for each recurring anchor's hash, in a fixed number of bits.

    It saves most rows that the exact join would drop; where it is full, it passes all.
    """
    place = F.pmod(F.col("v"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = anchors.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def _segments(texts: DataFrame, recurring: Broadcast) -> DataFrame:
    """``d, key, v, c``: anchor and hash of the segments, once for each document and segment.

    Most of those whose anchor isn't recurring are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), recurring.value
        for batch in batches:
            keys, ds = batch.column("key").to_numpy(), batch.column("d").to_numpy()
            for at, share in _chunks(batch, CHUNK_BYTES):
                c = Chunk(share, powers)
                place = c.anchor & (FILTER_BITS - 1)
                passed = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                # Once for each document: its first of equal names.
                once = passed[np.unique(_named(c.doc[passed], c.segment[passed]), return_index=True)[1]]
                doc = at + c.doc[once]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ds[doc], keys[doc], c.anchor[once], c.segment[once])], names=["d", "key", "v", "c"])

    return texts.select("d", "key", "text").mapInArrow(run, "d long, key long, v long, c long")


def _lists(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of all lists' structs one after another, and each value's list."""
    ends = column.offsets.to_numpy()
    part = column.values.slice(ends[0], ends[-1] - ends[0])
    fields = part.flatten() if pa.types.is_struct(part.type) else [part]
    return [f.to_numpy() for f in fields], np.repeat(np.arange(len(column)), np.diff(ends))


def _named(doc: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """One number for a text of a share and a segment's hash."""
    return segment.view(np.uint64) + doc.astype(np.uint64) * MIX


def _words_of(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """``v, c, crowded, owner, last, words`` of the segments, read from the document that owns each."""
    wanted = segments.groupBy("d").agg(F.collect_set(F.struct("c", "last", "crowded")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            (asked, last, crowded), row = _lists(batch.column("asked"))
            for at, share in _chunks(batch, CHUNK_BYTES):
                c = Chunk(share, powers)
                mine = np.flatnonzero((row >= at) & (row < at + len(share)))
                name = _named(row[mine] - at, asked[mine])
                mine, name = mine[np.argsort(name)], np.sort(name)
                own = _named(c.doc, c.segment)
                _, one = np.unique(own, return_index=True)
                place = np.minimum(np.searchsorted(name, own[one]), max(0, len(name) - 1))
                if len(name):
                    met = name[place] == own[one]
                    one, place = one[met], mine[place[met]]
                else:
                    one = place = one[:0]
                words = list(map(c.words, c.first[one].tolist(), c.last[one].tolist()))
                columns = (c.anchor[one], c.segment[one], crowded[place], keys[at + c.doc[one]], last[place])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], names=["v", "c", "crowded", "owner", "last", "words"])

    found = lookup(texts, wanted, ["d"], "inner").select("key", "text", "asked")
    found = found.mapInArrow(run, "v long, c long, crowded int, owner long, last long, words binary")
    # A repeated row of a document gives its segments again.
    return found.dropDuplicates(["v", "c"])


class Phrases:
    """Phrases of a shard that recur, in an automaton over word numbers.

    A segment that several documents have in full is a phrase as a whole; of the others,
    each window that stands in two of them is one. The value of a phrase is the smallest
    document that holds it.
    """

    def __init__(self, segments: list[list[bytes]], anchor: list[int], owner: list[int], last: list[int]):
        numbers: dict[bytes, int] = {}
        for s in segments:
            for w in s:
                if w not in numbers:
                    numbers[w] = len(numbers)
        self.lines = [tuple(map(numbers.__getitem__, s)) for s in segments]
        windows: dict[tuple, tuple[int, int]] = {}
        beside = Counter(anchor)
        for line, v, o in zip(self.lines, anchor, owner):
            # A window has one anchor, so it can only stand in segments of the same.
            for i in range(len(line) - WINDOW + 1 if beside[v] > 1 else 0):
                w = line[i : i + WINDOW]
                n, least = windows.get(w, (0, o))
                windows[w] = n + 1, min(least, o)
        phrases = {w: least for w, (n, least) in windows.items() if n > 1}
        for line, o, k in zip(self.lines, owner, last):
            if k > o:
                phrases[line] = min(o, phrases.get(line, o))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, least in phrases.items():
            self.automaton.add_word(phrase, (len(phrase), least))
        self.empty = not phrases
        if phrases:
            self.automaton.make_automaton()

    def least(self, line: tuple) -> list[int]:
        """For each window of a segment the smallest document that has it."""
        out = [NO_ID] * (len(line) - WINDOW + 1)
        for end, (n, o) in () if self.empty else self.automaton.iter(line):
            for i in range(end - n + 1, end - WINDOW + 2):
                if o < out[i]:
                    out[i] = o
        return out


def _located(segments: DataFrame, shards: int) -> DataFrame:
    """``v, c, least``: the smallest documents of the windows of segments, by sharded automata."""

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        last = rows["last"].tolist()
        found = Phrases([bytes(w).split() for w in rows["words"]], rows["v"].tolist(), rows["owner"].tolist(), last)
        least = list(map(found.least, found.lines))
        take = np.array([min(x) < k for x, k in zip(least, last)], bool)
        return pd.DataFrame({"v": rows["v"], "c": rows["c"], "least": pd.Series(least, rows.index, object)})[take]

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(shard, "v long, c long, least array<long>")


def _compared(segments: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: their windows are keys themselves."""
    w = F.split(F.col("words").cast("string"), " ")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(WINDOW)), " ")
    )
    many = segments.withColumn("w", w).select("v", "c", "owner", "last", F.posexplode(windows).alias("at", "w"))
    least = many.groupBy("w").agg(F.min("owner").alias("least"))
    met = lookup(many, least, ["w"], "inner").groupBy("v", "c", "last").agg(F.sort_array(F.collect_list(F.struct("at", "least"))).alias("least"))
    return met.select("v", "c", "last", F.col("least.least").alias("least")).where(F.array_min("least") < F.col("last")).drop("last")


def _answers(texts: DataFrame) -> DataFrame:
    """``d, answers``: the segments of a text that hold windows of smaller documents, as masks."""
    anchors = stored(_recurring(texts), "phrases-anchors")
    bits = texts.sparkSession.sparkContext.broadcast(_filter(anchors))
    rows = stored(lookup(_segments(texts, bits), anchors, ["v"], "left_semi"), "phrases-segments")
    owned = rows.groupBy("v", "c").agg(F.min("key").alias("owner"), F.min_by("d", "key").alias("d"), F.max("key").alias("last"))
    owned = stored(owned, "phrases-owned")
    crowded = owned.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("v", F.lit(1).alias("crowded"))
    flagged = lookup(owned, stored(crowded, "phrases-crowded"), ["v"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    words = stored(_words_of(texts, flagged), "phrases-words")
    shards = max(1, owned.count() * SEGMENT_BYTES // SHARD_BYTES)
    least = _located(words.where("crowded = 0"), shards).union(_compared(words.where("crowded = 1")))
    least = stored(least, "phrases-least")
    bits = "aggregate(transform(least, (x, i) -> if(x < key, shiftleft(1, i), 0)), 0, (a, b) -> a | b)"
    hits = lookup(rows, least, ["v", "c"], "inner").select("d", "c", F.expr(bits).alias("mask")).where("mask != 0")
    return hits.groupBy("d").agg(F.collect_set(F.struct("c", "mask")).alias("answers"))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: what is removed, and the words kept.

    Null and empty texts have no words, texts under 13 words stay whole, rows that repeat
    a doc_id remove nothing from each other, a null doc_id counts as the largest, other
    columns aren't read, an empty table gives no rows. A segment that many documents have
    is streamed past its automaton once. Segments are told apart by two hashes of 64 bits,
    of their anchor and of all their words; within an automaton words are compared.
    """
    texts = _texts(docs)
    answers = _answers(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            docs_of = batch.column("doc_id")
            (asked, mask), row = _lists(batch.column("answers"))
            for at, share in _chunks(batch, CHUNK_BYTES):
                mine = (row >= at) & (row < at + len(share))
                # Only texts with answers are hashed again.
                some, number = np.unique(row[mine] - at, return_inverse=True)
                c = Chunk([share[k] for k in some], powers)
                gone = removed(c, number, asked[mine], mask[mine])
                lost = [0] * len(share)
                every = list(map(bytes.split, share))
                kept = list(map(b" ".join, every))
                for k, a, b in zip(some.tolist(), c.ends[:-1].tolist(), c.ends[1:].tolist()):
                    out = gone[a:b]
                    lost[k] = int(out.sum())
                    kept[k] = b" ".join(compress(every[k], (~out).tolist()))
                columns = [
                    docs_of.slice(at, len(share)), pa.array(list(map(len, every)), pa.int64()), pa.array(lost, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return lookup(texts, answers, ["d"], "left").select("doc_id", "text", "answers").mapInArrow(run, RESULT)


def removed(chunk: Chunk, doc: np.ndarray, segment: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which words of the chunk lie in a window that a smaller document has."""
    step = np.zeros(chunk.n + 1, np.int64)
    if len(doc):
        name = _named(doc, segment)
        order = np.argsort(name)
        name, mask = name[order], mask[order]
        own = _named(chunk.doc, chunk.segment)
        place = np.minimum(np.searchsorted(name, own), len(name) - 1)
        hit = name[place] == own
        which, window = np.nonzero((mask[place[hit]][:, None] >> np.arange(SPAN)) & 1)
        start = chunk.first[hit][which] + window
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def op11_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
