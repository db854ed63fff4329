"""Personal data: high-recall candidates, boosted trees, calibrated thresholds."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.llm.common import documents, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# One candidate in how many is kept back from the trees for the thresholds.
HELD_OUT = 5
# Scores are rounded to so many steps, so that those of all rows kept back are few values.
SCORES = 1 << 16
PRECISION = 0.99
TREES, DEPTH = 15, 3

# Possessive forms of the base patterns: a run is taken whole, so none is walked twice.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates: wider than the base, and overlapping across kinds.
AT_LIKE = re.compile(r"[^\s@]{1,64}+@[^\s@]{1,255}+")
SPELLED = re.compile(r"[\w.+-]{2,64}+ ?(?:\[at\]|\(at\)| at ) ?[\w-]{2,64}+ ?(?:\[dot\]|\(dot\)| dot ) ?\w{2,24}", re.A)
QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.:][0-9]{1,3}){3,7}(?![0-9])")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}")
GROUP = re.compile(r"[0-9]+")
WORD_BEFORE = re.compile(r"(\w+)\W*$")
# Words that often stand before such data.
CUES = {
    EMAIL: {"email", "mail", "contact", "write", "to", "from"},
    IP: {"ip", "host", "server", "address", "from"},
    CARD: {"card", "visa", "pay", "number", "account"},
    PHONE: {"phone", "tel", "call", "fax", "mobile", "number"},
}
FEATURES = (
    "email", "ip", "card", "phone", "chars", "digits", "letters", "groups", "longest", "shortest", "first",
    "luhn", "octets", "dots", "different", "glued_before", "glued_after", "cue", "upper", "spaces",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the base patterns, by kind, then start."""
    out = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            # The local part is the longest run before the sign that is still free.
            before = text[max(free, text.rfind("@", 0, m.start()) + 1) : m.start()]
            n = len(before) - len(before.rstrip(LOCAL))
            if n:
                out.append((EMAIL, m.start() - n, m.end()))
                free = m.end()
    digits = DIGIT.search(text) is not None
    if digits:
        out += [(IP, *m.span()) for m in DOTTED.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CHAIN.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((CARD, *m.span()))
    if digits and "+" in text:
        out += [(PHONE, *m.span()) for m in PLUS.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans that might be personal data: the union of generous generators."""
    out = []
    if "@" in text:
        for m in AT_LIKE.finditer(text):
            trimmed = m[0].rstrip(".,;:!?)>]}'\"")
            out.append((EMAIL, m.start(), m.start() + len(trimmed)))
    if "dot" in text:
        out += [(EMAIL, *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        out += [(IP, *m.span()) for m in QUAD.finditer(text)]
        for m in NUMBER.finditer(text):
            n = sum(map(len, GROUP.findall(m[0])))
            if n >= 12:
                out.append((CARD, *m.span()))
            if n <= 15:
                out.append((PHONE, *m.span()))
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 1]
    groups = GROUP.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    word = WORD_BEFORE.search(before)
    return [float(x) for x in (
        kind == EMAIL, kind == IP, kind == CARD, kind == PHONE, len(span), len(digits), sum(map(str.isalpha, span)),
        len(groups), max(sizes), min(sizes), sizes[0], bool(digits) and luhn(digits),
        sum(len(g) <= 3 and int(g) <= 255 for g in groups), span.count("."), len(set(digits)),
        before[-1:].isalnum(), after.isalnum(), bool(word) and word[1].lower() in CUES[kind],
        sum(map(str.isupper, span)), span.count(" "),
    )]


def open_case(kind: int, span: str) -> bool:
    """Whether the base says nothing of a candidate: its form alone kept it out."""
    return (kind == EMAIL and "@" not in span) or (kind == PHONE and "+" not in span and len(GROUP.findall(span)) > 2)


SPAN = "array<struct<k: int, s: int, e: int>>"
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    f"base {SPAN}, found array<struct<k: int, s: int, e: int, label: int, f: array<double>>>"
)


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans and candidates with features of every whole text, in one pass."""

    def row(doc: int | None, text: str | None) -> dict:
        text = text or ""
        base = base_spans(text)
        by_kind = [[b for b in base if b[0] == k] for k in range(4)]
        found = []
        for k, s, e in candidates(text):
            met = {b[0] for b in base if b[1] < e and s < b[2]}
            label = 1 if k in met else 0 if met else -open_case(k, text[s:e])
            found.append({"k": k, "s": s, "e": e, "label": label, "f": features(text, k, s, e)})
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
        return {
            "doc_id": doc, **{f"n_{KINDS[k]}": len(by_kind[k]) for k in range(4)},
            "base_sha256": hashlib.sha256(line.encode()).hexdigest(),
            "base": [{"k": k, "s": s, "e": e} for k, s, e in base], "found": found,
        }

    span = [("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]
    wide = pa.struct([*span, ("label", pa.int32()), ("f", pa.list_(pa.float64()))])
    schema = pa.schema([
        ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct(span))), ("found", pa.list_(wide)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def tree_score(model) -> Callable[[Column], Column]:
    """Probability of a boosted-trees model as an expression over a feature array."""

    def parse(lines: list[str], f: Column) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = parse(lines, f)
        lines.pop(0)
        return F.when(F.element_at(f, int(feature) + 1) <= float(limit), low).otherwise(parse(lines, f))

    def score(f: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in zip(model.treeWeights, model.trees):
            total = total + F.lit(float(weight)) * parse(tree.toDebugString.split("\n")[1:], f)
        return F.round(SCORES / (1 + F.exp(-2 * total))) / SCORES

    return score


def threshold(scored: list[tuple[float, int, int]]) -> float | None:
    """Lowest score, at least a half, above which the share of labels 1 is ``PRECISION``.

    ``scored`` has a score, its rows, and those of them with label 1. The threshold lies in
    the middle of the gap to the next score below; None if there is none.
    """
    sums = Counter()
    for p, n, label in scored:
        sums[p, 0] += n
        sums[p, 1] += label
    own, limit, rows, hits = sorted({p for p, _ in sums}, reverse=True), None, 0, 0
    for k, p in enumerate(own, 1):
        rows, hits = rows + sums[p, 0], hits + sums[p, 1]
        below = own[k] if k < len(own) else 0.0
        if hits >= PRECISION * rows:
            limit = max((p + below) / 2, 0.5)
    return limit


def fit(scan: DataFrame):
    """Trees and a threshold for each kind, or None where all labels are alike.

    Labelled are candidates that overlap a base span of their kind (1), of another kind or
    none (0); those whose form alone kept them out of the base (a phone number without plus
    sign, a spelled-out address) are open: scored, but not learned from. All labelled
    candidates count, those of the same features as one row with their number as its weight;
    one in ``HELD_OUT``, by hash, is kept back from the trees for the thresholds. A kind's
    threshold comes from its own rows kept back, that of a kind without any such cut from all
    kinds together; where these have none either, only scores above all known errors count.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    found = scan.select("doc_id", F.explode("found").alias("c")).select("c.*", F.xxhash64("doc_id", "c.s", "c.e", "c.k").alias("h"))
    back = F.pmod("h", F.lit(HELD_OUT)) == 0
    labelled = found.where("label >= 0").groupBy("k", "label", "f", back.alias("back")).agg(F.count("*").alias("n"))
    rows = stored(labelled, "pii-labelled")
    train = rows.where("NOT back").select(
        F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features"), F.col("n").cast("double").alias("n")
    )
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, weightCol="n").fit(train)
    score = tree_score(model)
    # Sums by rounded score: at most SCORES + 1 rows of each kind, however many are kept back.
    held = rows.where("back").groupBy("k", score(F.col("f")).alias("p")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits")).collect()
    pooled = threshold([(r.p, r.n, r.hits) for r in held])
    if pooled is None:
        pooled = max([0.5, *(r.p for r in held if r.hits < r.n)])
    own = [threshold([(r.p, r.n, r.hits) for r in held if r.k == kind]) for kind in range(4)]
    limits = [pooled if limit is None else limit for limit in own]
    return score, limits


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and hash of the base, all spans.

    The base spans always stay; a candidate that overlaps none of its kind is added where
    the trees score it above its kind's threshold. Null texts are empty and have no
    spans, a null doc_id gives a row with a null doc_id, repeated rows repeat, an empty
    table gives no rows.
    """
    scan = stored(scanned(docs), "pii")
    fitted = fit(scan)
    spans = F.col("base")
    if fitted:
        score, limits = fitted
        limit = F.array(*[F.lit(x) for x in limits])
        good = F.filter("found", lambda c: (c["label"] < 1) & (score(c["f"]) > F.element_at(limit, c["k"] + 1)))
        spans = F.concat(spans, F.transform(good, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))))
    named = F.transform(F.array_sort(F.array_distinct(spans)), lambda c: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), c["k"] + 1), c["s"].cast("string"), c["e"].cast("string")))
    return scan.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(named, ",").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
