"""Documents alike in their five-word shingles: every pair of Jaccard 0.8 or more, exactly.

SimHash fingerprints link the closest documents, each link checked by exact Jaccard; a join of
prefixes finds the pairs that lie more bits apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from lookout.llm import simhash
from lookout.llm.common import discard, stored
from lookout.llm.components import components
from lookout.operators.joins import lookup

SHINGLE = 5
# Least similarity in tenths.
ALIKE = 8
# Sets of a shingle that are joined pair by pair; fuller shingles are compared in a task each.
PAIRWISE = 64
# Sets of a shingle beyond which pivots settle some first, and rounds of pivots.
CHUNK = 4096
ROUNDS = 6
# Shingles of the sets that one task compares with as many others.
CHUNK_SHINGLES = 1 << 18
# Texts that show which shingles are common, and the shingles taken as such. They only set
# the order in which a set's shingles stand, whatever that is no pair is lost.
SAMPLE_DOCS = 4_000
COMMON_FROM = 4
COMMON_MOST = 50_000


def shingles(text: str | None) -> np.ndarray:
    """Distinct XXH64 of the five-word shingles; fewer words are one shingle, none is none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + n + 1))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    found = [xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :] or ends[-1:])]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in an order that all sets share, rare before common.

    Two sets with a Jaccard of t or more share at least t of each, so the first shingle
    that both have stands among the first n - ceil(t * n) + 1 of either.
    """
    n = len(own)
    keep = n - -(-ALIKE * n // 10) + 1 if n else 0
    place = np.zeros(n, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        place = np.where(common[at] == own, rank[at], 0)
    return own[np.lexsort((own, place))[:keep]]


def parities(own: np.ndarray) -> bytes:
    """Whether an odd number of a set's shingles falls into each of 2n to 4n fields, at least 64.

    Fields that differ between two sets each hold a shingle that only one of them has.
    """
    fields = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own.view(np.uint64) & np.uint64(fields - 1)).astype(np.int64), minlength=fields) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that only one of two sets has, at least, by their parities."""
    short = 4 * min(len(x), len(y))
    x, y = ((int.from_bytes(v), 8 * len(v)) for v in (x, y))
    folded = []
    for v, size in (x, y):
        while size > 2 * short:
            size //= 2
            v = (v >> size) ^ (v & ((1 << size) - 1))
        folded.append(v)
    return (folded[0] ^ folded[1]).bit_count()


def _pass(docs: DataFrame, columns: Callable[[list, list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """``doc_id, text_hash, sig, n`` of every row, hash and size of its set, and further columns."""
    names = ["doc_id", "text_hash", "sig", "n", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            cols = [
                batch.column("doc_id"), batch.column("text_hash"),
                pa.array([xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()), *columns(texts, sets),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return narrow.mapInArrow(run, f"doc_id long, text_hash long, sig long, n int, {schema}")


def _sets(docs: DataFrame) -> DataFrame:
    """``own``: the whole set of every row."""
    return _pass(docs, lambda texts, sets: [pa.array(sets, pa.list_(pa.int64()))], "own array<long>")


def _described(docs: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Prefix, parities and SimHash fingerprint of every row."""
    columns = lambda texts, sets: [
        pa.array([prefix(s, common, rank) for s in sets], pa.list_(pa.int64())),
        pa.array([parities(s) for s in sets], pa.binary()),
        pa.array([simhash.fingerprint(t) for t in texts], pa.int64()),
    ]
    return _pass(docs, columns, "prefix array<long>, odd binary, fp long")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a bounded sample that several texts share, sorted, with their counts."""
    total = max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(total)) < SAMPLE_DOCS)
    seen = _sets(chosen).dropDuplicates(["sig"]).select(F.explode("own").alias("s")).groupBy("s").count()
    top = seen.where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "s").limit(COMMON_MOST).collect()
    top = sorted((r.s, r["count"]) for r in top)
    return np.array([s for s, _ in top], np.int64), np.array([n for _, n in top], np.int64)


def _may(apart: Column, sizes: Column) -> Column:
    """Whether sets of together ``sizes`` shingles may be alike with ``apart`` in only one of them."""
    return 10 * (sizes - apart) >= ALIKE * (sizes + apart)


def _bounded(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Adds ``apart`` (at least), ``sum`` of the sizes, and ``may`` to distinct ``pairs(a, b)``."""
    least = F.pandas_udf(lambda x, y: pd.Series([least_apart(*v) for v in zip(x, y)], dtype="int32"), "int")
    one, two = (about.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    met = lookup(lookup(pairs, one, ["a"], "inner"), two, ["b"], "inner")
    met = met.select("a", "b", least("odd_a", "odd_b").alias("apart"), (F.col("n_a") + F.col("n_b")).alias("sum"))
    return met.withColumn("may", _may(F.col("apart"), F.col("sum")))


def _scored(bounded: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, far, alike`` of pairs: the exact distance where they may be alike, else a lower bound."""
    one, two = sets.select(F.col("sig").alias("a"), F.col("own").alias("x")), sets.select(F.col("sig").alias("b"), F.col("own").alias("y"))
    met = lookup(lookup(bounded.where("may").select("a", "b"), one, ["a"], "inner"), two, ["b"], "inner")
    met = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    both, every = F.col("both"), F.col("sum") - F.col("both")
    exact = met.select("a", "b", (1 - both / every).alias("far"), (10 * both >= ALIKE * every).alias("alike"))
    bound = 2 * F.col("apart") / (F.col("sum") + F.col("apart"))
    return exact.union(bounded.where("NOT may").select("a", "b", bound.alias("far"), F.lit(False)))


# Length of a set's prefix, from its size.
PREFIX = f"(n - cast(ceil({ALIKE} * n / 10) as int) + 1)"


def _pairs(rows: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Distinct pairs that share shingles of ``rows(key, sig, n)`` and may be alike.

    By size, and, with ``full(sig, full)``, by the shingles that the prefixes share: what
    two sets have in common lies in both prefixes, or behind the one that ends first.
    ``full`` counts the shingles of a set that aren't among the rows; they may be shared.
    """
    behind = F.col("n") - F.expr(PREFIX)
    rows = rows.withColumn("behind", behind)
    if full is None:
        rows = rows.withColumn("full", F.lit(0))
    else:
        rows = lookup(rows, full, ["sig"], "left").withColumn("full", F.coalesce("full", F.lit(0)))
    a, b = (rows.select("key", F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "behind", "full")]) for x in "ab")
    fits = 10 * F.least("n_a", "n_b") >= ALIKE * F.greatest("n_a", "n_b")
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & fits)
    if full is None:
        return met.select("a", "b").distinct()
    bound = F.least("full_a", "full_b") + F.greatest("behind_a", "behind_b")
    shared = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first(bound).alias("more"), F.first(F.col("n_a") + F.col("n_b")).alias("sum"))
    return shared.where((10 + ALIKE) * (F.col("c") + F.col("more")) >= ALIKE * F.col("sum")).select("a", "b")


def _dealt(rows: DataFrame, about: DataFrame, group: DataFrame) -> DataFrame:
    """``rows(key, sig)`` with ``n, g`` and further columns of ``about``, dealt by ``key, i, j``.

    The sets of a key meet in one task. Where they are more than a task holds, they are cut
    into chunks of which every two meet.
    """
    rows = lookup(lookup(rows.select("key", "sig"), about, ["sig"], "inner"), group, ["sig"], "left")
    rows = rows.withColumn("g", F.coalesce("g", "sig"))
    load = F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)
    rows = lookup(rows, rows.groupBy("key").agg(F.ceil(load).alias("chunks")), ["key"], "inner")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("sig", "key"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.where("chunk != other OR chunks = 1")
    return rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunk", "other", "chunks")


def with_partner(n: np.ndarray, g: np.ndarray, odd: list[bytes]) -> np.ndarray:
    """Which sets may be alike to one of another group, by sizes and parities."""
    size = np.array([len(x) for x in odd])
    found = np.zeros(len(odd), bool)
    for fields in np.unique(size):
        # Sets of one number of fields with those of as many or twice as many, folded.
        mine, twice = np.flatnonzero(size == fields), np.flatnonzero(size == 2 * fields)
        matrix = np.stack([np.frombuffer(odd[k], np.uint64) for k in mine])
        if len(twice):
            wide = np.stack([np.frombuffer(odd[k], np.uint64) for k in twice])
            matrix = np.concatenate([matrix, wide[:, : fields // 8] ^ wide[:, fields // 8 :]])
        every = np.concatenate([mine, twice])
        n_, g_ = n[every], g[every]
        for at, k in enumerate(every):
            if found[k]:
                continue
            # Twice as many fields meet in their own turn.
            near = slice(0, len(mine) if at >= len(mine) else None)
            total, apart = n_[near] + n[k], np.abs(n_[near] - n[k])
            chosen = np.flatnonzero((g_[near] != g[k]) & (10 * (total - apart) >= ALIKE * (total + apart)))
            if len(chosen):
                apart = np.bitwise_count(matrix[chosen] ^ matrix[at]).sum(axis=1, dtype=np.int64)
                good = chosen[10 * (total[chosen] - apart) >= ALIKE * (total[chosen] + apart)]
                found[every[good]] = True
                found[k] = len(good) > 0
    return found


def forest(g: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets alike that connect, with the groups ``g``, all sets alike; fewer than sets.

    A set is compared, exactly, with those that no set has reached yet.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    g = g[order]
    ends = np.cumsum(sizes)
    _, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    codes = codes.astype(np.int32)
    own = np.zeros(codes.max() + 1, bool)
    # Sets not reached, by size, and their shingles one after the other.
    left, rest = np.arange(len(order)), codes
    pairs, queue = [], []
    while len(left):
        if not queue:
            reached = g[left] == g[left[0]]
        else:
            k = queue.pop()
            n = sizes[k]
            lo, hi = np.searchsorted(sizes[left], [-(-ALIKE * n // 10), 10 * n // ALIKE + 1])
            if lo == hi:
                continue
            starts = np.cumsum(sizes[left]) - sizes[left]
            mine = codes[ends[k] - n : ends[k]]
            own[mine] = True
            stop = starts[hi] if hi < len(left) else len(rest)
            both = np.add.reduceat(own[rest[starts[lo] : stop]], starts[lo:hi] - starts[lo], dtype=np.int32)
            own[mine] = False
            near = left[lo:hi][10 * both >= ALIKE * (n + sizes[left[lo:hi]] - both)]
            if not len(near):
                continue
            # One pair for each group that is met.
            met, first = np.unique(g[near], return_index=True)
            pairs += [(int(order[k]), int(order[x])) for x in near[first]]
            reached = np.isin(g[left], met)
        queue += left[reached].tolist()
        rest, left = rest[np.repeat(~reached, sizes[left])], left[~reached]
    return pairs


def _open(rows: DataFrame, about: DataFrame, group: DataFrame) -> DataFrame:
    """The ``rows(key, sig)`` whose set may be alike to one of the key and another group."""

    def compare(block: pa.Table) -> pa.Table:
        n, g = (block.column(c).to_numpy().astype(np.int64) for c in ("n", "g"))
        return block.select(["key", "sig"]).filter(pa.array(with_partner(n, g, block.column("odd").to_pylist())))

    dealt = _dealt(rows, about, group).select("key", "i", "j", "sig", "n", "g", "odd")
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "key long, sig long").distinct()


def _crowded(rows: DataFrame, sets: DataFrame, group: DataFrame) -> DataFrame:
    """``a, b``: pairs that connect all sets of a key of ``rows(key, sig)`` alike.

    A task holds whole sets, ``sets(sig, own)``, and gives fewer pairs than it holds sets.
    """

    def compare(block: pa.Table) -> pa.Table:
        sig, g = (block.column(c).to_numpy() for c in ("sig", "g"))
        own = [x.values.to_numpy() for x in block.column("own")]
        pairs = sig[np.array(forest(g, own), np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    about = sets.select("sig", F.size("own").alias("n"), "own")
    dealt = _dealt(rows, about, group).select("key", "i", "j", "sig", "g", "own")
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys that several sets have, with the number of these sets."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return lookup(keys, sizes, ["key"], "inner")


def _closest(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` of sets that SimHash links: one fingerprint, or within two bits.

    Sets of a fingerprint are paired with the least, and the least of linked fingerprints.
    """
    least = stored(rows.groupBy("fp").agg(F.min("sig").alias("least")), "similar-fps")
    own = lookup(rows.select("fp", "sig").distinct(), least, ["fp"], "inner").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    near = simhash.links(least.select("fp"))
    for c in "ab":
        near = lookup(near, least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")), [c], "inner")
    every = own.union(near.select("_a", "_b")).where("a != b")
    pairs = stored(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-closest")
    discard(least)
    return pairs


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all distinct sets of ``rows(sig, n, prefix, odd, fp, text_hash)`` alike.

    Sets that SimHash links are compared first; those found alike form groups, inside which
    nothing more is compared. Then sets that share a shingle of their prefixes are. Whole sets
    are moved only for pairs that may be alike by their parities. The sets of a shingle with
    more than ``PAIRWISE`` meet in a task, which gives only as many pairs as connect them.
    A shingle with more than ``CHUNK`` first compares all of them with one, its pivot. The
    Jaccard distance is a metric: with g the least distance to the pivot among the sets not
    alike to it, a set nearer to the pivot than g - 0.2 has no pair outside and is settled by
    its link to the pivot. The others take a further pivot, and after ``ROUNDS`` those of a
    shingle meet in chunks.
    """
    distinct = rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    keys = stored(distinct.select("sig", "n", F.explode("prefix").alias("key")), "similar-keys")
    shared = stored(_shared(keys), "similar-blocks")
    discard(keys)
    about = stored(rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("odd").alias("odd")), "similar-about")
    closest = _closest(rows)
    first = stored(_bounded(closest, about), "similar-bounded")
    many = stored(shared.where(F.col("size") > PAIRWISE), "similar-full")
    full = many.groupBy("sig").agg(F.count("*").cast("int").alias("full"))
    second = stored(_bounded(_pairs(shared.where(F.col("size") <= PAIRWISE), full), about), "similar-bounded")
    texts = docs.select("doc_id", "text").withColumn("_text", F.xxhash64(F.col("text").cast("string")))

    def whole(nodes: DataFrame) -> DataFrame:
        """The sets of ``nodes(sig)``, built anew from the texts and written."""
        wanted = lookup(rows, nodes, ["sig"], "left_semi").groupBy("sig").agg(F.min("text_hash").alias("_text")).select("_text").distinct()
        return stored(_sets(lookup(texts, wanted, ["_text"], "left_semi")).select("sig", "own").dropDuplicates(["sig"]), "similar-sets")

    def exact(bounded: DataFrame) -> DataFrame:
        """Scored pairs, written. The sets that may be alike are moved once and then gone."""
        may = bounded.where("may")
        sets = whole(may.select(F.col("a").alias("sig")).union(may.select("b")).distinct())
        scored = stored(_scored(bounded, sets), "similar-scored")
        discard(sets)
        return scored

    def alike(bounded: DataFrame) -> DataFrame:
        return exact(bounded.where("may")).where("alike").select("a", "b")

    edges = alike(first)
    # Sets that are linked by now; a set without a link is a group of its own.
    group = stored(components(edges), "similar-group").select(F.col("node").alias("sig"), F.col("component").alias("g"))

    def apart(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = lookup(pairs, group.select(F.col("sig").alias(c), F.col("g").alias(f"g_{c}")), [c], "left")
        return pairs.where(F.coalesce("g_a", "a") != F.coalesce("g_b", "b")).drop("g_a", "g_b")

    edges = edges.union(alike(apart(second)))
    for table in (shared, closest, first, second):
        discard(table)
    old = [many]
    left, crowded = (many.where(c).select("key", "sig", "n") for c in (F.col("size") > CHUNK, F.col("size") <= CHUNK))
    for turn in range(ROUNDS):
        if left.isEmpty():
            break
        pivots = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("sig", F.lit(turn)), "sig"))["sig"].alias("p"))
        met = stored(lookup(left, pivots, ["key"], "inner").where("sig != p"), "similar-met")
        bounded = stored(_bounded(met.select(F.col("sig").alias("a"), F.col("p").alias("b")).distinct(), about), "similar-bounded")
        scored = exact(bounded)
        edges = edges.union(stored(scored.where("alike").select("a", "b"), "similar-edges"))
        known = scored.select(F.col("a").alias("sig"), F.col("b").alias("p"), "far", "alike")
        placed = stored(lookup(met, known, ["sig", "p"], "inner"), "similar-placed")
        gaps = placed.groupBy("key").agg(F.coalesce(F.min(F.when(~F.col("alike"), F.col("far"))), F.lit(2.0)).alias("gap"))
        open_ = ~F.col("alike") | (F.col("far") >= F.col("gap") - (1 - ALIKE / 10) - 1e-9)
        open_rows = stored(lookup(placed, gaps, ["key"], "inner").where(open_).select("key", "sig", "n"), "similar-open")
        rest = stored(_shared(open_rows), "similar-rest")
        for table in (met, bounded, scored, placed, open_rows):
            discard(table)
        left, few = (rest.where(c).select("key", "sig", "n") for c in (F.col("size") > CHUNK, F.col("size") <= CHUNK))
        crowded = crowded.union(few)
        old.append(rest)
    near = stored(_open(crowded.union(left), about, group), "similar-near")
    sets = whole(near.select("sig").distinct())
    edges = edges.union(stored(_crowded(near, sets, group), "similar-edges"))
    for table in (*old, near, sets, about, group):
        discard(table)
    return edges


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs(doc_id, text)``, rows as in SimHash's."""
    common, rank = _common(docs)
    given = docs.select("doc_id", "text")
    rows = stored(_described(given, common, rank), "similar")
    distinct = rows.groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    comps = stored(components(links(given, rows)), "similar-components").withColumnRenamed("node", "sig")
    labelled = stored(
        lookup(distinct, comps, ["sig"], "left").select("sig", "first_id", F.coalesce("component", "sig").alias("component")),
        "similar-labels",
    )
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = lookup(labelled, least, ["component"], "inner").select("sig", "component_id")
    return lookup(rows.select("doc_id", "sig"), named, ["sig"], "inner").select("doc_id", "component_id")
