"""Ranked search against scores computed text by text."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lookout.llm import lexical_search
from test_llm_rows import given, odd, pairs  # noqa: F401


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    held = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(list)
    for item, text in dict.fromkeys(items):
        asked[item] += terms(text)
    out = []
    for item, words in asked.items():
        found = []
        for d, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in words if t in c
            )
            if score:
                found.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:20])]
    return out


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (3, "The same line here, THE same"), (3, "The same line here, THE same"), (3, "mail and token"), (4, None), (5, ""),
        (None, "other é one"), (6, "unheard of"), (7, "a b a"), (8, "1234 x555 988"), (9, "don't  STOP 你好 мир"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("word", F.lit(1)).withColumn("rank", F.lit(2))


@pytest.mark.parametrize("block,cells", [(8 << 20, 1 << 21), (60, 3)])
def test_search_on_odd_rows(spark, odd, items, block, cells, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    extra = odd.withColumn("n", F.lit(1)).withColumn("score", F.lit(2)).withColumn("item", F.lit(3))
    got = [tuple(r) for r in lexical_search.search(extra, items).collect()]
    want = brute(pairs(odd), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ties_and_hot_terms(spark):
    r = random.Random(5)
    rows = [(i, "common words " * 3 if i % 3 == 0 else " ".join(r.choices(["common", "rare", "odd", "words", "x"], k=r.randint(1, 9)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [("a", "common words"), ("b", "rare rare odd"), ("c", "nothing")]
    got = [tuple(x) for x in lexical_search.search(docs, spark.createDataFrame(items, "item_id string, text string")).collect()]
    assert sorted(got) == sorted(brute(rows, items)) and {g[0] for g in got} == {"a", "b"}


def test_empty_tables(spark, odd, items):
    assert lexical_search.search(odd.where("false"), items).count() == 0
    assert lexical_search.search(odd, items.where("false")).count() == 0
