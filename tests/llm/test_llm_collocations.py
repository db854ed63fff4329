"""Collocations against counts of n-grams in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.llm import collocations
from lookout.llm.collocations import Automaton
from test_llm_rows import given, odd  # noqa: F401


def brute(rows, least=10, best=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        most = Counter()
        for g, a in found.items():
            for inner in (g[:2], g[1:]) if len(g) == 3 else ():
                most[inner] = max(most[inner], a)
        kept = []
        for g, a in found.items():
            if g in most and 100 * most[g] >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(frame):
    return sorted(tuple(r) for r in collocations.mined(frame).collect())


def rows_of(frame):
    return [(r.lang, r.text) for r in frame.select("lang", "text").collect()]


@pytest.mark.parametrize("paths,held", [(2 << 20, 4 << 20), (300, 500)])
def test_equal_brute_force(spark, odd, paths, held, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_PATHS", paths)
    monkeypatch.setattr(collocations, "HELD_PATHS", held)
    r = random.Random(3)
    words = ["the", "The", "of", "a", "é", "New", "york", "city", "x\x1cy", "z\x85"] + [f"w{i}" for i in range(60)]
    joins = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "; "]
    rows = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice(joins) for _ in range(r.randint(0, 60)))
        rows.append((i, text + " new york city " * (i % 3) + "the the the " * (i % 5 == 0), r.choice(["en", "fr", None, "und"])))
    rows += [rows[1]] * 12 + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    extra = docs.withColumns({c: F.lit(1) for c in ("a", "f", "n", "phrase", "at")})
    assert mined(extra) == brute(rows_of(docs))
    assert mined(odd) == brute(rows_of(odd))
    assert mined(docs.where("false")) == []


def test_ties_at_the_cut(spark, monkeypatch):
    """All phrases score alike; the frequent and then the smaller come first."""
    monkeypatch.setattr(collocations, "BEST", 7)
    rows = [(i, ". ".join(f"p{k}é q{k}" for k in range(40)) + (". p9é q9" if i < 3 else ""), "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mined(docs)
    assert got == brute(rows_of(docs), best=7) and got[0][2] == "p9é q9"


def test_exact_products(spark):
    big = 30_000_000_000_007
    frame = spark.createDataFrame([(big - 3, big - 1, big), (10, 10, 10), (10, 3, 7)], "f long, l long, r long")
    frame = frame.select("f", "l", "r", F.expr("(1000000BD * (cast(f as decimal(15,0)) * cast(f as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))").alias("s"))
    for x in frame.collect():
        assert x.s == 1_000_000 * x.f * x.f // (x.l * x.r)


def test_symbols_of_two_words_are_changed(spark, monkeypatch):
    """Where the first symbols fall together, others are taken."""
    seeds = []
    plain = collocations.counted

    def counted(docs, order, seed, cuts, frequent=None):
        seeds.append(seed)
        found = plain(docs, order, seed, cuts, frequent)
        if order == 3 and seed == 0:
            found = found.withColumn("words", F.expr("transform(words, (w, i) -> cast(if(i < 2, concat(string(w), string(monotonically_increasing_id()), at), string(w)) as binary))"))
            found = found.union(found.withColumn("words", F.expr("transform(words, w -> cast('other' as binary))")))
        return found

    monkeypatch.setattr(collocations, "counted", counted)
    rows = [(i, "good words here", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert mined(docs) == brute(rows_of(docs)) and set(seeds) == {0, 1}


def test_automata():
    r = random.Random(8)
    for order in (1, 2, 3):
        for _ in range(30):
            bags = [Counter(tuple(r.choices(range(1, 6), k=order)) for _ in range(r.randint(0, 50))) for _ in range(3)]
            made = []
            for bag in bags:
                paths = [*bag, *bag]
                r.shuffle(paths)
                columns = tuple(np.array([p[k] for p in paths], np.uint64) for k in range(order))
                half = Automaton.of(columns, np.array([bag[p] for p in paths], np.int64))
                made.append(Automaton.read(*half.blobs()))
                assert weights(made[-1]) == {p: 2 * n for p, n in bag.items()}
            total = made[0].union(*made[1:])
            assert weights(total) == {p: 2 * n for p, n in sum(bags, Counter()).items()}
            assert weights(made[0].compose(total)) == {p: 2 * sum(b[p] for b in bags) for p in bags[0]}
            assert weights(made[0].compose(made[1])) == {p: 2 * bags[1][p] for p in bags[0]}


def weights(automaton):
    columns = automaton.paths()
    return dict(zip(zip(*(c.tolist() for c in columns)), automaton.weights.tolist()))


def test_hot_prefixes_are_cut_within():
    columns = (np.repeat(np.uint64(5), 10), np.arange(10, dtype=np.uint64))
    cuts = [("de", 9, 9), ("en", 5, 3), ("en", 5, 7), ("fr", 1, 1)]
    assert collocations.edges(columns, cuts, "en") == (1, [0, 3, 7, 10])
    assert collocations.edges(columns, cuts, "es") == (3, [0, 10])
