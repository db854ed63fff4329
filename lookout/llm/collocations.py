"""Collocations by weighted acyclic automata.

A task counts the n-grams of its texts in automata whose paths are n-grams and whose last
arcs weigh how often they occur; symbols are 64-bit hashes of words, in their order. Each
automaton is cut into ranges of prefixes, and the cuts of one range are united with their
weights summed. Frequent paths are the candidates; the weights of their parts come from
composing the automaton of all parts asked for with that of the counts, range by range.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_intdigest

from lookout.llm.common import documents, stored
from lookout.llm.phrases import Powers, rows_of, words_of
from lookout.operators.joins import lookup

LEAST = 10
BEST = 2000
SHARE = 50
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t" + ENDS
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
# Text of a language that a task reads before it sorts its words, and paths it holds before
# it passes its automata on.
CHUNK_BYTES = 1 << 20
HELD_PATHS = 1 << 20
# Paths that a range of prefixes holds on average, texts whose n-grams show where to cut.
RANGE_PATHS = 1 << 20
SAMPLE_DOCS = 256
# Bits of the filter of frequent paths. Its size is fixed: where it fills up it passes more,
# and what passes wrongly is counted and dropped for its count.
FILTER_BITS = 1 << 24
SALT = np.uint64(0x9E3779B97F4A7C15)

Columns = tuple[np.ndarray, ...]


def starts(columns: Columns) -> np.ndarray:
    """Where a new path begins in sorted columns."""
    n = len(columns[0])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


class Automaton:
    """Sorted paths of equal length with weights, as levels of states.

    ``symbols[k]`` are the arcs of level k in the order of their paths, ``fan[k]`` the arcs
    that leave the state behind each of them; the arcs of the last level carry ``weights``.
    Paths come sorted, so the states of a prefix are closed as soon as the next one begins.
    """

    def __init__(self, columns: Columns, weights: np.ndarray):
        self.symbols, self.fan, self.weights = [], [], weights
        for k in range(len(columns) - 1):
            at = np.flatnonzero(starts(columns[: k + 1]))
            below = np.flatnonzero(starts(columns[: k + 2]))
            self.symbols.append(columns[k][at])
            self.fan.append(np.diff(np.r_[np.searchsorted(below, at), len(below)]).astype(np.uint32))
        self.symbols.append(columns[-1])

    @staticmethod
    def of(columns: Columns, weights: np.ndarray) -> "Automaton":
        """From paths in any order, repeated ones added up."""
        order = np.lexsort(columns[::-1])
        columns = tuple(c[order] for c in columns)
        first = np.flatnonzero(starts(columns))
        total = np.add.reduceat(weights[order], first) if len(first) else weights
        return Automaton(tuple(c[first] for c in columns), total)

    def paths(self) -> Columns:
        out: list[np.ndarray] = []
        for k, symbols in enumerate(self.symbols):
            out.append(symbols)
            if k < len(self.fan):
                out = [np.repeat(c, self.fan[k]) for c in out]
        return tuple(out)

    def union(self, *others: "Automaton") -> "Automaton":
        """All paths, the weights of common ones added."""
        every = [self, *others]
        columns = [np.concatenate(c) for c in zip(*(a.paths() for a in every))]
        return Automaton.of(tuple(columns), np.concatenate([a.weights for a in every]))

    def compose(self, counts: "Automaton") -> "Automaton":
        """Own paths weighted by ``counts``; a path that isn't there weighs nothing."""
        asked, known = self.paths(), counts.paths()
        if not len(known[0]):
            return Automaton(asked, np.zeros(len(asked[0]), np.int64))
        lo, hi = np.zeros(len(asked[0]), np.int64), np.full(len(asked[0]), len(known[0]))
        # Level by level a state's arcs are a narrower run of the sorted paths.
        for want, have in zip(asked, known):
            lo, hi = _run(have, want, lo, hi)
        found = counts.weights[np.minimum(lo, len(known[0]) - 1)]
        return Automaton(asked, np.where(lo < hi, found, 0))

    def cut(self, edges: list[int]) -> Iterator["Automaton"]:
        columns = self.paths()
        for a, b in zip(edges[:-1], edges[1:]):
            yield Automaton(tuple(c[a:b] for c in columns), self.weights[a:b])

    def blobs(self) -> tuple[list[bytes], list[bytes], bytes]:
        return [s.tobytes() for s in self.symbols], [f.tobytes() for f in self.fan], self.weights.tobytes()

    @staticmethod
    def read(symbols: list[bytes], fan: list[bytes], weights: bytes) -> "Automaton":
        made = object.__new__(Automaton)
        made.symbols = [np.frombuffer(s, np.uint64) for s in symbols]
        made.fan = [np.frombuffer(f, np.uint32) for f in fan]
        made.weights = np.frombuffer(weights, np.int64)
        return made


def _run(have: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within ``have[lo:hi]``, sorted, the run that equals ``want``, by halving all runs at once."""
    edges = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) // 2
            value = have[np.minimum(mid, len(have) - 1)]
            less = (value <= want if right else value < want) & open_
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        edges.append(a)
    return edges[0], edges[1]


def lang_symbol(lang: str) -> np.uint64:
    return np.uint64(xxh64_intdigest(lang.encode()))


def filter_place(lang: np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * SALT) ^ (lang >> np.uint64(7))) * SALT
    return ((h ^ (h >> np.uint64(32))) % np.uint64(FILTER_BITS)).astype(np.int64)


def in_filter(bits: np.ndarray, lang: np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = filter_place(lang, a, b)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Shard:
    """Counts of the n-grams of one language in a task.

    ``order`` 2 counts words and pairs, 3 the triples whose pairs both pass ``frequent``.
    """

    def __init__(self, order: int, powers: Powers, frequent: np.ndarray | None, lang: str):
        self.order, self.powers, self.frequent = order, powers, frequent
        self.lang = lang_symbol(lang)
        self.texts: list[bytes] = []
        self.read = 0
        self.n = 0
        self.made: list[Automaton] = []
        self.spelled: dict[int, bytes] = {}

    def add(self, text: str | None):
        if text:
            self.texts.append(text.encode().translate(LOWER))
            self.read += len(self.texts[-1])
        if self.read >= CHUNK_BYTES:
            self.sort()

    def sort(self):
        """One more automaton, of the texts read since the last."""
        # The line feed between texts ends a piece.
        data = b"\n".join(self.texts)
        self.texts, self.read = [], 0
        start, end, h = words_of(data, self.powers, GAPS)
        if not len(h):
            return
        # Zero is the end of a lone word.
        s = np.maximum(h, np.uint64(1))
        piece = np.cumsum(IS_END[np.frombuffer(data, np.uint8)], dtype=np.int32)[start]
        pair = piece[1:] == piece[:-1]
        if self.order == 2:
            first = np.concatenate([s, s[:-1][pair]])
            columns = (first, np.concatenate([np.zeros(len(s), np.uint64), s[1:][pair]]))
            self.n += len(s)
        else:
            pair &= in_filter(self.frequent, self.lang, s[:-1], s[1:])
            triple = pair[1:] & pair[:-1]
            columns = (s[:-2][triple], s[1:-1][triple], s[2:][triple])
            symbols, at = np.unique(s, return_index=True)
            self._spell(symbols, data, start[at], end[at])
        self.made.append(Automaton.of(columns, np.ones(len(columns[0]), np.int64)))

    def _spell(self, symbols: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray):
        """Keeps the words that may be frequent, to be read from their symbols later."""
        passed = in_filter(self.frequent, self.lang, symbols, np.zeros(len(symbols), np.uint64))
        for h, a, b in zip(symbols[passed].tolist(), start[passed].tolist(), end[passed].tolist()):
            if h not in self.spelled:
                self.spelled[h] = data[a:b]

    def held(self) -> int:
        return self.read // 3 + sum(len(a.weights) for a in self.made)

    def automaton(self) -> Automaton:
        self.sort()
        return self.made[0].union(*self.made[1:])


Cut = tuple  # language, then a path: the first of a range


def edges(columns: Columns, cuts: list[Cut], lang: str) -> tuple[int, list[int]]:
    """The number of the range in which sorted paths of ``lang`` begin, and where they are cut."""
    base, out = bisect_left(cuts, (lang,)), [0]
    for cut in cuts[base : bisect_left(cuts, (lang + "\0",))]:
        lo, hi = 0, len(columns[0])
        for c, x in zip(columns, cut[1:]):
            x = np.uint64(x)
            lo, hi = lo + int(np.searchsorted(c[lo:hi], x)), lo + int(np.searchsorted(c[lo:hi], x, "right"))
        out.append(lo)
    return base, [*out, len(columns[0])]


def _narrow(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


BLOBS = "at int, lang string, n long, symbols array<binary>, fan array<binary>, weights binary, spelled array<long>, words array<binary>"


def counted(docs: DataFrame, order: int, seed: int, cuts: list[Cut], frequent: Broadcast | None = None) -> DataFrame:
    """Automata of all n-grams, one row for each language, range of prefixes and flush of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(seed), None if frequent is None else frequent.value
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in rows_of(batch, "lang", "text"):
                if lang not in shards:
                    shards[lang] = Shard(order, powers, bits, lang)
                shards[lang].add(text)
                if not shards[lang].texts and sum(x.held() for x in shards.values()) >= HELD_PATHS:
                    yield from _flushed(shards, cuts)
                    shards = {}
            # Many languages with few words each.
            if sum(x.held() for x in shards.values()) >= HELD_PATHS:
                yield from _flushed(shards, cuts)
                shards = {}
        yield from _flushed(shards, cuts)

    return _narrow(docs).mapInArrow(run, BLOBS)


def _flushed(shards: dict[str, Shard], cuts: list[Cut]) -> Iterator[pa.RecordBatch]:
    for lang, shard in shards.items():
        shard.sort()
        if not shard.made:
            continue
        whole = shard.automaton()
        base, at = edges(whole.paths(), cuts, lang)
        spelled = list(shard.spelled.items())
        for k, part in enumerate(whole.cut(at)):
            if k and not len(part.weights):
                continue
            row = (base + k, lang, 0 if k else shard.n, *part.blobs(),
                   [h - (1 << 64) if h >> 63 else h for h, _ in spelled] if not k else [], [w for _, w in spelled] if not k else [])
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
            names = ["at", "lang", "n", "symbols", "fan", "weights", "spelled", "words"]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)


def united(blobs: DataFrame, order: int, ranges: int) -> DataFrame:
    """``at, lang, a, b, c, f, place``: the paths of weight ``LEAST`` or more, of all automata.

    A range's automata come one after another and are united as they come, so a task holds
    the distinct paths of its range, however many automata have them.
    """

    def close(at: int, lang: str, held: list[Automaton]) -> pa.RecordBatch:
        whole = held[0].union(*held[1:])
        take = whole.weights >= LEAST
        columns = [c[take] for c in whole.paths()]
        zero = np.zeros(int(take.sum()), np.uint64)
        columns += [zero] * (3 - order)
        place = filter_place(lang_symbol(lang), columns[0], columns[1])
        out = [np.full(len(zero), at, np.int32), pa.array([lang] * len(zero), pa.string()), *(c.view(np.int64) for c in columns), whole.weights[take], place]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["at", "lang", "a", "b", "c", "f", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for at, lang, *blobs in rows_of(batch, "at", "lang", "symbols", "fan", "weights"):
                if now != (at, lang):
                    if held:
                        yield close(*now, held)
                    now, held, size = (at, lang), [], 0
                held.append(Automaton.read(*blobs))
                size += len(held[-1].weights)
                if size >= HELD_PATHS and len(held) > 1:
                    held = [held[0].union(*held[1:])]
                    size = 0
        if held:
            yield close(*now, held)

    dealt = blobs.select("at", "lang", "symbols", "fan", "weights").repartition(ranges, "at").sortWithinPartitions("at", "lang")
    return dealt.mapInArrow(run, "at int, lang string, a long, b long, c long, f long, place long")


def cuts_of(docs: DataFrame, order: int, seed: int, total: int, ranges: int, frequent: Broadcast | None = None) -> list[Cut]:
    """First paths of the ranges, evenly from the paths of some texts.

    A prefix that many paths begin with is cut within. The texts set the balance alone.
    """
    if ranges < 2:
        return []
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total))) < SAMPLE_DOCS)

    # Counted and listed by one Python worker: a second one beside it would hold as much.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(seed), None if frequent is None else frequent.value
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in rows_of(batch, "lang", "text"):
                shards.setdefault(lang, Shard(order, powers, bits, lang)).add(text)
        for lang, shard in shards.items():
            shard.sort()
            if shard.made:
                columns = shard.automaton().paths()
                out = [c.view(np.int64) for c in columns] + [np.zeros(len(columns[0]), np.int64)] * (3 - order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *map(pa.array, out)], names=["lang", "a", "b", "c"])

    found = _narrow(chosen).mapInArrow(run, "lang string, a long, b long, c long")
    rows = found.orderBy(F.xxhash64("lang", "a", "b", "c")).limit(64 * ranges).collect()
    paths = sorted({(r.lang, *(x % (1 << 64) for x in (r.a, r.b, r.c)[:order])) for r in rows})
    return sorted({paths[len(paths) * k // ranges] for k in range(1, ranges)}) if paths else []


def filter_of(grams: DataFrame) -> np.ndarray:
    """The filter's bits, put together in words of 64 by an aggregate of bounded size."""
    word, bit = F.shiftright("place", 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = grams.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        bits[r.w] = r.bits
    return bits.view(np.uint8)


def composed(asked: DataFrame, grams: DataFrame, cuts: list[Cut]) -> DataFrame:
    """``lang, a, b, f``: the weights of the paths ``asked(lang, a, b)``, range by range."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for lang, mine in rows.groupby("lang"):
                paths = Automaton.of(_columns(mine), np.zeros(len(mine), np.int64)).paths()
                base, at = edges(paths, cuts, lang)
                number = base + np.repeat(np.arange(len(at) - 1), np.diff(at))
                out = [pa.array(number, pa.int32()), pa.array([lang] * len(number), pa.string()), *(pa.array(c.view(np.int64)) for c in paths)]
                yield pa.RecordBatch.from_arrays(out, names=["at", "lang", "a", "b"])

    def meet(counts: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, object), *np.zeros((3, 0), np.int64))]
        for lang, mine in parts.groupby("lang"):
            known = counts[counts["lang"] == lang]
            have = Automaton.of(_columns(known), known["f"].to_numpy(np.int64))
            found = Automaton.of(_columns(mine), np.zeros(len(mine), np.int64)).compose(have)
            a, b = found.paths()
            out.append((np.full(len(a), lang, object), a.view(np.int64), b.view(np.int64), found.weights))
        return pd.DataFrame(dict(zip(("lang", "a", "b", "f"), map(np.concatenate, zip(*out)))))

    dealt = asked.distinct().mapInArrow(deal, "at int, lang string, a long, b long")
    counts = grams.select("at", "lang", "a", "b", "f")
    return counts.groupBy("at").cogroup(dealt.groupBy("at")).applyInPandas(meet, "lang string, a long, b long, f long")


def _columns(rows: pd.DataFrame) -> Columns:
    return tuple(rows[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))


PARTS = """
    if(c = 0, array(named_struct('k', 1, 'la', a, 'lb', 0L, 'ra', b, 'rb', 0L)),
       array(named_struct('k', 1, 'la', a, 'lb', 0L, 'ra', b, 'rb', c),
             named_struct('k', 2, 'la', a, 'lb', b, 'ra', c, 'rb', 0L)))
"""


def _whole(name: str) -> Column:
    """Counts as decimals wide enough that no product of two of them passes 38 digits."""
    return F.col(name).cast("decimal(15,0)")


def scored(candidates: DataFrame, grams: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Adds ``l, r, score`` of the lowest cut to ``candidates(lang, a, b, c, f)``."""
    parts = stored(candidates.select("*", F.inline(F.expr(PARTS))), "collocations-parts")
    asked = parts.select("lang", F.col("la").alias("a"), F.col("lb").alias("b")).union(parts.select("lang", "ra", "rb"))
    known = stored(composed(asked, grams, cuts), "collocations-weights")
    left = known.select("lang", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("f").alias("l"))
    right = known.select("lang", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("f").alias("r"))
    met = lookup(lookup(parts, left, ["lang", "la", "lb"], "inner"), right, ["lang", "ra", "rb"], "inner")
    met = met.withColumns({"_f": _whole("f"), "_l": _whole("l"), "_r": _whole("r")})
    met = met.withColumn("score", F.expr("(1000000BD * (_f * _f)) div (_l * _r)"))
    lowest = met.groupBy("lang", "a", "b", "c", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("_low"))
    return lowest.select("lang", "a", "b", "c", "f", "_low.score", "_low.l", "_low.r")


def uncontained(candidates: DataFrame) -> DataFrame:
    """Candidates but those that a longer one holds at least half as often."""
    pairs = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))
    inside = candidates.where("c != 0").select("lang", F.col("f").alias("_f"), F.inline(pairs))
    most = inside.groupBy("lang", "a", "b").agg(F.max("_f").alias("_most"))
    most = most.withColumn("c", F.lit(0).cast("long"))
    kept = lookup(candidates, most, ["lang", "a", "b", "c"], "left")
    return kept.where(F.col("_most").isNull() | (100 * F.col("_most") < SHARE * F.col("f"))).drop("_most")


def mined(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``BEST`` phrases of each language.

    Null and empty texts have no words, a null lang is ``und``, repeated rows and ids count
    as often as they stand there, ties go to the more frequent and then to the smaller
    phrase by bytes, an empty table gives no rows, other columns aren't read. Two words of
    one symbol would be counted as one: the words of all symbols in use are compared, and
    if two differ, all is counted anew with other symbols.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.length(F.col("text").cast("string"))).alias("chars")).first()
    # Words and pairs: about two paths for each six characters.
    ranges = 1 + (size.chars or 0) // (3 * RANGE_PATHS)
    cuts = cuts_of(docs, 2, seed, size.rows, ranges)
    blobs = stored(counted(docs, 2, seed, cuts), "collocations-pairs")
    grams = stored(united(blobs, 2, ranges), "collocations-frequent")
    totals = stored(blobs.groupBy("lang").agg(F.sum("n").alias("n")), "collocations-totals")

    frequent = spark.sparkContext.broadcast(filter_of(grams))
    longer = stored(counted(docs, 3, seed, cuts_of(docs, 3, seed, size.rows, ranges, frequent), frequent), "collocations-triples")
    triples = united(longer, 3, ranges)
    spelled = longer.select(F.inline(F.arrays_zip(F.col("spelled").alias("s"), F.col("words").alias("w"))).alias("s", "w"))
    words = spelled.groupBy("s").agg(F.min("w").alias("w"), F.max("w").alias("_other"))
    words = stored(words, "collocations-words")
    if not words.where("w != _other").isEmpty():
        return mined(docs, seed + 1)

    columns = ["lang", "a", "b", "c", "f"]
    candidates = stored(grams.where("b != 0").select(*columns).union(triples.select(*columns)), "collocations-candidates")
    kept = lookup(scored(candidates, grams, cuts), uncontained(candidates).select("lang", "a", "b", "c"), ["lang", "a", "b", "c"], "left_semi")
    for name in ("a", "b", "c"):
        spelling = words.select(F.col("s").alias(name), F.col("w").cast("string").alias(f"_{name}"))
        kept = lookup(kept, spelling, [name], "left")
    # The symbol zero, the end of a pair, has no word.
    kept = kept.select("lang", F.concat_ws(" ", "_a", "_b", "_c").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    kept = lookup(_cut_down(kept), totals, ["lang"], "inner")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*_order())).cast("long"))
    return ranked.where(F.col("rank") <= BEST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SALTS = 64


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("a"), F.asc("phrase")]


def _cut_down(phrases: DataFrame) -> DataFrame:
    """At most ``BEST`` phrases of each language and salt: a superset of its first ``BEST``."""
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*_order()))
    return salted.withColumn("_n", place).where(F.col("_n") <= BEST).drop("_n", "_salt")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(documents(spark, sf_dir))
