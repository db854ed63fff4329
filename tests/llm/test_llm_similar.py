"""The pipeline's near duplicates against brute-force Jaccard of five-word shingles."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lookout.llm import simhash, similar
from test_llm_rows import given, odd, pairs  # noqa: F401


def brute_kept(rows):
    """Least doc_id of each component of pairs with a Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    every = list(group)
    for i, a in enumerate(every):
        for b in every[:i]:
            if 10 * len(a & b) >= 8 * len(a | b) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {s: new if g == old else g for s, g in group.items()}
    ids = defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if d is not None:
            ids[group[s]].append(d)
    return sorted(min(i) for i in ids.values())


def copies(spark):
    """Chains and clusters of swapped words at all distances, and a passage that many share."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (60, 120, 300):
        base = r.choices(words, k=n)
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(1 + n // 30)):
                own[r.randrange(n)] = r.choice(words)
            texts.append(own)
            chain = list(own)
            for _ in range(r.randrange(1 + n // 60)):
                chain[r.randrange(n)] = r.choice(words)
            texts.append(chain)
    # Small sets around four shingles, and many texts that begin alike and go on apart.
    core = words[:8]
    texts += [core] + [core + [w] for w in words[100:112]] + [core[:7] + [w] for w in words[200:206]]
    texts += [words[300:312] + r.choices(words, k=r.randint(2, 30)) for _ in range(30)]
    passage = r.choices(words, k=40)
    texts += [passage + r.choices(words, k=k) for k in range(0, 60, 2)]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("pairwise, rounds, common", [(64, 6, 4), (3, 6, 4), (3, 1, 10_000)])
@pytest.mark.parametrize("table", ["odd", "given", "copies"])
def test_near_duplicates_equal_brute_force(table, pairwise, rounds, common, request, spark, sf_dir, monkeypatch):
    if table == "odd" and pairwise != 64:
        pytest.skip("few rows")
    docs = copies(spark) if table == "copies" else request.getfixturevalue(table)
    monkeypatch.setattr(similar, "PAIRWISE", pairwise)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "COMMON_FROM", common)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == brute_kept(pairs(docs))


def swapped(n_sets=60, seed=4):
    """Sets of all sizes in families, and the shingles that only one of two has."""
    r = random.Random(seed)
    out = []
    for n in (1, 3, 30, 70, 500, 3000):
        base = [r.getrandbits(64) for _ in range(n)]
        for _ in range(n_sets // 6):
            out.append(np.unique(np.array([x if r.random() > 0.1 else r.getrandbits(64) for x in base], np.uint64).view(np.int64)))
    return out


def test_parities_never_count_too_much():
    sets = swapped()
    far = []
    for a in sets:
        for b in sets:
            true, least = len(np.setxor1d(a, b)), similar.least_apart(similar.parities(a), similar.parities(b))
            assert least <= true and (true - least) % 2 == 0
            if len(a) == len(b) > 400 and true > len(a):
                far.append(least / true)
    assert not far or min(far) > 0.5


def roots(nodes, edges):
    """Least node of each node's component."""
    root = {v: v for v in nodes}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {v: low if r == high else r for v, r in root.items()}
    return root


@pytest.mark.parametrize("chunk", [7, 4096])
def test_crowded_shingles_connect_all_sets_alike(chunk, spark, monkeypatch):
    """Sets with a partner are all found, and few pairs of them connect all that are alike."""
    monkeypatch.setattr(similar, "CHUNK", chunk)
    r = random.Random(8)
    sets = swapped(120)
    # A chain, of which each set is alike to the next, and a cluster of pairs mostly not alike.
    chain = np.array([r.getrandbits(63) for _ in range(100)], np.int64)
    for k in range(30):
        chain = np.concatenate([chain[3:], np.array([r.getrandbits(63) for _ in range(3)], np.int64)])
        sets.append(np.sort(chain))
    base = [r.getrandbits(63) for _ in range(100)]
    sets += [np.unique(np.array(r.sample(base, 89) + [r.getrandbits(63) for _ in range(11)], np.int64)) for _ in range(40)]
    sets = dict(enumerate(sets))
    about = spark.createDataFrame([(i, len(s), bytearray(similar.parities(s))) for i, s in sets.items()], "sig long, n int, odd binary")
    whole = spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "sig long, own array<long>")
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in sets], "key long, sig long")
    group = spark.createDataFrame([(10, 10), (11, 10)], "sig long, g long")
    partner, alike = set(), []
    for a in sets:
        for b in range(a):
            apart = max(similar.least_apart(similar.parities(sets[a]), similar.parities(sets[b])), abs(len(sets[a]) - len(sets[b])))
            total = len(sets[a]) + len(sets[b])
            if (b, a) != (10, 11) and 10 * (total - apart) >= 8 * (total + apart):
                partner |= {a, b}
            both = len(np.intersect1d(sets[a], sets[b]))
            if 10 * both >= 8 * (total - both):
                alike.append((b, a))
    near = similar._open(rows, about, group)
    got = [tuple(x) for x in near.collect()]
    assert sorted(got) == sorted((k, i) for k in (1, 2) for i in partner) and len(partner) < len(sets)
    edges = [tuple(x) for x in similar._crowded(near, whole, group).collect()]
    assert set(edges) <= set(alike) and len(alike) > 1.5 * len(sets)
    assert roots(sets, [*edges, (10, 11)]) == roots(sets, [*alike, (10, 11)])
    assert len(edges) < len(sets) or chunk == 7


@pytest.mark.parametrize("chunk, rounds", [(5, 6), (5, 1), (5, 0)])
def test_shingles_with_more_sets_than_a_task_holds(chunk, rounds, spark, sf_dir, monkeypatch):
    for name, value in (("PAIRWISE", 3), ("CHUNK", chunk), ("ROUNDS", rounds)):
        monkeypatch.setattr(similar, name, value)
    docs = copies(spark)
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(pairs(docs))


def test_near_duplicates_start_from_simhash_and_move_few_sets(spark, sf_dir, monkeypatch):
    """SimHash's links are compared, and whole sets only of pairs that their parities leave open."""
    linked, moved, links, scored = [], [], simhash.links, similar._scored
    monkeypatch.setattr(simhash, "links", lambda fps: linked.append(fps.count()) or links(fps))
    monkeypatch.setattr(similar, "_scored", lambda pairs, sets: moved.append(pairs.where("may").count()) or scored(pairs, sets))
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = r.choices(words, k=30)
    # Texts that share a passage, none of them alike, and two copies but for one of many words.
    texts = [passage + r.choices(words, k=100) for _ in range(30)]
    texts += [texts[0][:-1] + ["end"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == list(range(30))
    assert linked and linked[0] >= 30 and sum(moved) <= 4
