"""Removal of repeated phrases against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lookout.llm import phrases
from test_llm_rows import given, in_order, odd, pairs  # noqa: F401


def brute(rows):
    held = [(phrases.NO_ID if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    owners = {}
    for k, _, w in held:
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            owners[x] = min(owners.get(x, k), k)
    out = []
    for k, d, w in held:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if owners[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages(spark):
    """Copies, edited copies, shared passages at all offsets, and one word over and over."""
    r = random.Random(4)
    words = ["a", "b", "c"] + [f"w{i}é" for i in range(200)]
    passage = [r.choices(words, k=n) for n in (13, 14, 20, 40, 60)]
    rows = []
    for i in range(240):
        text = r.choices(words[: r.choice([2, 203])], k=r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, 8)
            text += p[a : a + r.randint(10, 60)] + r.choices(words, k=r.randint(0, 5))
        rows.append((r.randrange(400), r.choice([" ", "\n", " \t"]).join(text)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[5][1]), (1000, "a " * 70), (1001, "a " * 30), (-5, rows[7][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("table,crowded,shard", [
    ("odd", 10_000, 4 << 20), ("given", 10_000, 20_000), ("given", 1, 4 << 20), ("passages", 10_000, 4 << 20), ("passages", 2, 5_000),
])
def test_removal(table, crowded, shard, request, spark, monkeypatch):
    monkeypatch.setattr(phrases, "CROWDED", crowded)
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3_000)
    docs = passages(spark) if table == "passages" else request.getfixturevalue(table)
    extra = docs.withColumn("key", F.lit(1)).withColumn("d", F.lit(2)).withColumn("answers", F.lit("x"))
    got = [tuple(r) for r in phrases.without_repeats(extra).collect()]
    assert in_order(got) == in_order(brute(pairs(docs)))
    assert phrases.without_repeats(docs.where("false")).count() == 0


def test_batches_do_not_matter(spark, given):
    want = in_order(brute(pairs(given)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in phrases.without_repeats(given.repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert in_order(got) == want
