"""Suffix arrays and the removal of repeated passages, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lookout.llm import substrings, suffixes
from test_llm_rows import given, in_order, odd, pairs  # noqa: F401


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    r = random.Random(letters)
    for n in (1, 2, 3, 7, 50, 400):
        for _ in range(10):
            s = np.array([r.randint(1, letters) for _ in range(n)] + [0])
            if n == 400:
                s[200:300] = s[50:150]
            want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
            for names in (1024, 0):
                suffixes.NAMES = names
                sa = suffixes.suffix_array(s)
                assert sa.tolist() == want
            suffixes.NAMES = 1024
            plcp = suffixes.permuted_prefixes(s, sa, n)
            for a, b in zip(want, want[1:]):
                k = 0
                while a + k <= n and b + k <= n and s[a + k] == s[b + k]:
                    k += 1
                assert plcp[b] == k


def test_only_suffixes_that_are_still_equal_are_sorted_again(monkeypatch):
    r = random.Random(5)
    s = np.array([*r.sample(range(1, 20_000), 6000), *[1, 2, 3, 4] * 200, 0])
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or argsort(x, *a, **k))
    assert suffixes._doubling(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert sum(sorted_) < 3 * len(s)


def brute(rows):
    owners = {}
    key = lambda d: substrings.NO_ID if d is None else d
    data = [(key(d), d, (t or "").encode()) for d, t in rows]
    for k, _, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            owners[w] = min(owners.get(w, k), k)
    out = []
    for k, d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if owners[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("table,crowded", [("odd", 2000), ("given", 2000), ("given", 1), ("cases", 2000), ("cases", 2)])
def test_removal(table, crowded, request, spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    if table == "cases":
        r = random.Random(9)
        word = lambda: "".join(r.choices("abcdeé ", k=r.randint(1, 9)))
        passage = [" ".join(word() for _ in range(30)) for _ in range(6)]
        rows = [(i, " ".join(word() for _ in range(r.randint(0, 40))) + r.choice(passage)[r.randint(0, 40):] + word() * r.randint(0, 30) + r.choice(passage)[: r.randint(20, 90)]) for i in range(150)]
        docs = spark.createDataFrame([*rows, rows[3], (None, rows[5][1])], "doc_id long, text string").repartition(5)
    else:
        docs = request.getfixturevalue(table)
    rows = pairs(docs)
    got = [tuple(x)[:5] for x in substrings.without_repeats(docs).collect()]
    assert in_order(got) == in_order(brute(rows))
    assert substrings.without_repeats(docs.where("false")).count() == 0


def test_each_text_is_searched_for_anchors_once_before_its_contexts(spark, monkeypatch):
    """Copies inside a batch are gone at once, from the same pass that asks about the others."""
    text = "a passage that three of these documents hold in full, and some more of it"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text), (4, "short")], "doc_id long, text string").coalesce(1)
    passes, found = [], substrings._found
    monkeypatch.setattr(substrings, "_found", lambda *a, **k: passes.append(a) or found(*a, **k))
    rows = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs).collect()}
    assert rows == {1: 0, 2: len(text), 3: len(text), 4: 0} and len(passes) == 1
    asked = found(substrings._texts(docs)).collect()
    copies = [r for r in asked if r.gone]
    assert {r.key for r in copies} == {2, 3} and {r.key for r in asked if not r.gone} == {1}
    assert len({r.v for r in copies}) == len(copies)
