"""Exact removal of passages that repeat across documents.

Texts are cut into shards by anchors: of each window of 50 bytes the 20-byte string with
the smallest hash, which any copy of the window picks as well. Around an anchor stands its
context, the 80 bytes that hold all windows that can pick it. Contexts equal in full are
settled by their hash; different contexts of an anchor go into a shard whose suffix array
is induced, and whose common prefixes of 50 bytes or more tell which windows they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lookout.llm.common import documents, stored
from lookout.llm.suffixes import permuted_prefixes, suffix_array
from lookout.operators.joins import lookup

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
# Bytes of contexts that a shard holds on average, and contexts of one anchor beyond which
# it would fill a shard alone: its windows are compared by an aggregate instead.
CONTEXT_BYTES = 2 * LENGTH - GRAM + 5
SHARD_BYTES = 2 << 20
CROWDED = SHARD_BYTES // CONTEXT_BYTES
NO_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(29))


def _spread(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over each run of ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as texts reach."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, ODD)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)], dtype=np.uint64)
        return self.up, self.down


def anchors(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, hashes of their 20 bytes, hashes of their contexts."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(b)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = powers.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[:n], out=total[1:])
    h = _mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = _spread(h, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    most = _spread(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    at = np.flatnonzero(h == most)
    lo, hi = np.maximum(at - (SPAN - 1), 0), np.minimum(at + LENGTH, n)
    # With the anchor's own hash: in a short text, several anchors have one context.
    c = _mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * MIX + _mixed(h[at]))
    return at, h[at].view(np.int64), c.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _found(texts: DataFrame) -> DataFrame:
    """``key, v, c, gone``: anchors and contexts of each text.

    Within a batch of rows, a context's smallest document asks the rest of the corpus;
    the other documents with it are gone: a smaller one has all that it holds. They have a
    ``v`` of their own, so a context that a third of all documents share is asked about once
    for each batch, and no task gets its copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                _, v, c = anchors(text.encode(), powers)
                parts.append((np.full(len(c), key, np.int64), v, c))
            if not parts:
                continue
            found = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((found[0], found[2]))
            key, c = found[0][order], found[2][order]
            fresh = np.r_[True, c[1:] != c[:-1]][: len(c)]
            first = key[np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))] if len(c) else key
            settled = (key > first) & np.r_[True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])][: len(c)]
            gone = np.zeros(len(c), bool)
            gone[order[settled]] = True
            # In the order of the texts: neighbouring rows then differ little.
            take = np.sort(order[fresh | settled])
            key, v, c, gone = (x[take] for x in (*found, gone))
            own = _mixed(key.view(np.uint64) * ODD + c.view(np.uint64)).view(np.int64)
            columns = (key, np.where(gone, own, v), c, gone)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "v", "c", "gone"])

    return texts.select("key", "text").mapInArrow(run, "key long, v long, c long, gone boolean")


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Values of each list, by field where they are structs; a null list is empty."""
    values = column.values
    fields = values.flatten() if pa.types.is_struct(values.type) else [values]
    fields = [f.to_numpy() for f in fields]
    ends = column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield tuple(f[a:b] for f in fields)


def _contexts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, v, c, context`` for the contexts that a document is asked for."""
    wanted = asked.groupBy("key").agg(F.collect_set("c").alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            keys, texts_of = (batch.column(c).to_pylist() for c in ("key", "text"))
            for key, text, (cs,) in zip(keys, texts_of, _lists(batch.column("cs"))):
                data = text.encode()
                at, v, c = anchors(data, powers)
                _, one = np.unique(c, return_index=True)
                one = one[np.isin(c[one], cs)]
                for p, vp, cp in zip(*(x[one].tolist() for x in (at, v, c))):
                    rows.append((key, vp, cp, data[max(p - SPAN + 1, 0) : p + LENGTH]))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["key", "v", "c", "context"])

    return texts.join(wanted, "key").select("key", "text", "cs").mapInArrow(run, "key long, v long, c long, context binary")


def shared_windows(contexts: list[bytes], keys: list[int]) -> list[int]:
    """For each context a mask of the windows that one of a smaller key has, too.

    Contexts stand between separators; windows that meet in the suffix array with 50
    common bytes form a class, of which the smallest key counts.
    """
    lengths = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8).astype(np.int64) + 2
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    flat[starts + lengths] = 1
    s = np.r_[flat, 0]
    sa = suffix_array(s)
    plcp = permuted_prefixes(s, sa, 2 * LENGTH, starts)
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    offset = np.arange(len(flat)) - np.repeat(starts, lengths + 1)
    ranked = sa[sa < len(flat)]
    joined = plcp[ranked] >= LENGTH
    whole = offset[ranked] + LENGTH <= lengths[owner[ranked]]
    kind = np.cumsum(~joined)
    kind, at = kind[whole], ranked[whole]
    if not len(at):
        return [0] * len(contexts)
    key = np.array(keys, np.int64)[owner[at]]
    fresh = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    least = np.repeat(np.minimum.reduceat(key, fresh), np.diff(np.r_[fresh, len(kind)]))
    masks = np.zeros(len(contexts), np.int64)
    hit = at[least < key]
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << offset[hit])
    return masks.tolist()


def _shared(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, c, mask`` of the windows that smaller documents have, too."""
    n = asked.groupBy("crowded").count().collect()
    sizes = {r.crowded: r["count"] for r in n}
    shards = max(1, sizes.get(False, 0) * CONTEXT_BYTES // SHARD_BYTES)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        masks = shared_windows(rows["context"].map(bytes).tolist(), rows["key"].tolist())
        return pd.DataFrame({"key": rows["key"], "c": rows["c"], "mask": masks}).query("mask != 0")

    few = _contexts(texts, asked.where("not crowded")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).drop("v")
    masks = few.groupBy("shard").applyInPandas(shard, "key long, c long, mask long")
    if sizes.get(True):
        masks = masks.union(_compared(_contexts(texts, asked.where("crowded"))))
    return stored(masks, "substrings-masks")


def _compared(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: their windows are keys themselves."""
    at = F.explode(F.sequence(F.lit(0), F.length("context") - LENGTH))
    many = contexts.where(F.length("context") >= LENGTH).select("key", "c", "context", at.alias("at"))
    many = many.select("key", "c", "at", F.substring("context", F.col("at") + 1, F.lit(LENGTH)).alias("w"))
    least = many.groupBy("w").agg(F.min("key").alias("least"))
    hit = lookup(many, least, ["w"], "inner").where("least < key")
    return hit.groupBy("key", "c").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def removed(text: bytes, answered: np.ndarray, masks: np.ndarray, powers: Powers) -> np.ndarray:
    """Which bytes lie in a window that a smaller document has.

    ``masks`` are of the contexts ``answered``; -1 stands for all windows of a context.
    """
    order = np.argsort(answered)
    answered, masks = answered[order], masks[order]
    fresh = np.flatnonzero(np.r_[True, answered[1:] != answered[:-1]])
    answered, masks = answered[fresh], np.bitwise_or.reduceat(masks, fresh)
    at, _, c = anchors(text, powers)
    k = np.minimum(np.searchsorted(answered, c), len(answered) - 1)
    hit = answered[k] == c
    at, mask = at[hit], masks[k[hit]]
    lo, whole = np.maximum(at - (SPAN - 1), 0), mask < 0
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, lo[whole], 1)
    np.add.at(step, np.minimum(at[whole] + LENGTH, len(text)), -1)
    lo, mask = lo[~whole], mask[~whole]
    if len(lo):
        row, window = np.nonzero((mask[:, None] >> np.arange(SPAN)) & 1)
        np.add.at(step, lo[row] + window, 1)
        np.add.at(step, lo[row] + window + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: what is removed, and the bytes kept.

    Null texts are empty, texts under 50 bytes stay whole, rows that repeat a doc_id don't
    remove anything from each other, a null doc_id counts as the largest, an empty table
    gives no rows. Hashes are of 64 bits: two different contexts of an equal anchor with
    equal hashes, one pair in 10^19, would be taken for each other.
    """
    texts = _texts(docs)
    asked = _found(texts).repartition("v")
    asked = asked.withColumn("gone", F.col("gone") | (F.col("key") > F.min("key").over(Window.partitionBy("v", "c"))))
    # Contexts of an anchor: the rows that aren't gone, one for each.
    asked = asked.withColumn("n", F.count(F.when(~F.col("gone"), 1)).over(Window.partitionBy("v")))
    asked = asked.where("gone or n > 1").select("key", "c", "gone", (F.col("n") > CROWDED).alias("crowded"))
    asked = stored(asked, "substrings-asked")
    masks = _shared(texts, asked.where("not gone"))
    answers = (
        asked.where("gone").select("key", "c", F.lit(-1).cast("long").alias("mask"))
        .union(masks)
    )
    answers = answers.groupBy("key").agg(F.collect_list(F.struct("c", "mask")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            docs_of, texts_of = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for doc, text, (answered, found) in zip(docs_of, texts_of, _lists(batch.column("answers"))):
                data, runs, lost = text.encode(), 0, 0
                kept = data
                if len(answered):
                    out = removed(data, answered, found, powers)
                    lost = int(out.sum())
                    runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~out].tobytes()
                rows.append((doc, len(data), lost, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=names)

    return texts.join(answers, "key", "left").select("doc_id", "text", "answers").mapInArrow(run, RESULT)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
