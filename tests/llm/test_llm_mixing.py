"""Every pass of the mix has its place in the training order."""

from collections import defaultdict

from pyspark.sql import functions as F

from lookout.llm import mixing
from test_llm_rows import in_order


def test_words_up_to_a_time_follow_the_integrated_weight(spark):
    # Sources a to d: small ones beside a large one, so that they repeat; d is of weight 1.
    n = {"a": 300, "b": 300, "c": 300, "d": 6000}
    rows = [(1000 * i + k, s, " ".join(["w"] * (1 + k % 7))) for i, s in enumerate(n) for k in range(n[s])]
    docs = spark.createDataFrame([(i, s, t, 9) for i, s, t in rows], "doc_id long, source string, text string, positions int")
    sizes = docs.select("doc_id", "source", mixing.size(F.col("text")).alias("size"))
    order = mixing.training_order(sizes).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    mixed = mixing.mixed(docs).collect()
    assert len(mixed) == len(rows) and max(r.passes for r in mixed) == 3
    assert all(len(r.positions) == r.passes and (r.position is None or r.positions[0] == r.position) for r in mixed)
    assert in_order((r.doc_id, k + 1, p) for r in mixed for k, p in enumerate(r.positions)) == in_order((r.doc_id, r["pass"], r.position) for r in order)
    taken, target = defaultdict(int), {r.source: int(r.target) for r in mixed}
    for r in mixed:
        taken[r.source] += r.taken
    for k, s in enumerate(n):
        slope = mixing.SLOPES[k % 3]
        own = [(r.position, r.words) for r in order if r.source == s]
        assert sum(w for _, w in own) == taken[s]
        for t in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
            want = target[s] * ((1 - slope) * t + slope * t * t)
            assert abs(sum(w for p, w in own if p < t) - want) <= 7
