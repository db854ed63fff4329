"""Secret scan: base patterns and character Markov models; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.llm.common import documents, packed

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run of these characters can't hold a shorter match, so the least lengths stand here.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# What the models score: runs of 8 or more of these characters.
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = RUN + "{8,}"
TOKEN = RUN + "{4,}"
# Labelled samples: at most so many base values, and documents for ordinary strings.
SAMPLE_VALUES = 20_000
SAMPLE_DOCS = 2_000
# Transitions that the followers' overall shares weigh as much as.
LEAN = 5.0
# A run counts as random where its log-likelihood ratio exceeds what its length asks for
# (nats for each transition) and the odds of a secret: a short run must be far clearer.
EACH = 0.7
ODDS = 12.0
# Symbols of the models: letters in both cases, digits, anything else.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDTH = len(ALPHABET) + 1
CODES = 128
MARK = "[secret]"


def _spans(text: Column, pattern: str, kind: int, guard: Column, value: Column | None = None, least: int = 0) -> Column:
    """Matches as ``(s, k, e, v)``, offsets in code points.

    The pieces between the matches and the matches' own lengths add up to the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else whole
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("w"), values.alias("v"), F.slice(between, 1, F.size(whole)).alias("b"))
    kind_of = "array<struct<s: int, k: int, e: int, v: string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["w"])
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(zipped, start, step)["out"]
    if least:
        found = F.filter(found, lambda x: F.length(x["v"]) >= least)
    return F.when(guard, found).otherwise(F.array().cast(kind_of))


def base(text: Column) -> Column:
    """Base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, text.rlike(ASSIGN), least=8),
        _spans(text, ACCESS, 1, text.contains("AKIA")),
        _spans(text, HEX, 2, text.rlike(HEX)),
    ))


def _pairs(values: DataFrame) -> DataFrame:
    """Counts of neighbouring symbols ``a, b`` in ``values(v)``."""
    code = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(WIDTH)) - 1
    codes = values.where(F.length("v") >= 2).select(F.transform(F.split("v", ""), code).alias("s"))
    both = F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return codes.select(F.explode(both).alias("p")).where("p.b is not null").groupBy("p.a", "p.b").count()


def _forms(v: Column) -> list[Column]:
    """A string as identifiers write it: as it is, in capitals, joined in each usual way."""
    cap, digit = F.initcap(v), (F.length(v) % 10).cast("string")
    return [v, F.upper(v), F.concat(cap, cap), F.concat(v, F.lit("_"), v), F.concat(F.upper(v), F.lit("__"), F.upper(v)),
            F.concat(v, digit, F.lit("-"), digit, digit, v)]


def train(docs: DataFrame, text: Column) -> list[float]:
    """Log-likelihood ratios of the transitions, random against ordinary, by character code.

    Random are the values that the base patterns found, ordinary the strings that several
    texts of a sample hold beside them, and its numbers, each counted once in each form that
    an identifier may give it; one digit counts as another. Half of the random model is even
    over all symbols, since the values that are found may be of one alphabet, such as hex.
    Both samples are bounded, what the driver gets are two tables of pair counts, ``WIDTH``
    squared rows each at most. Without any values the random model is the even half.
    """
    texts = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    values = texts.select(F.explode(base(F.col("text"))["v"]).alias("v"))
    random = values.distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE_VALUES)
    total = max(1, docs.count())
    # Copies count once and the order is by hash, so reruns learn from the same texts.
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(total)) < SAMPLE_DOCS).groupBy("text").agg(F.xxhash64("text").alias("h"))
    chosen = chosen.orderBy("h", "text").limit(2 * SAMPLE_DOCS)
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    strings = chosen.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)))).alias("v")).groupBy("v").count()
    ordinary = strings.where((F.col("count") > 1) | F.col("v").rlike("^[^A-Za-z]+$")).select(F.explode(F.array(*_forms(F.col("v")))).alias("v"))
    tables = []
    for counts, even in ((_pairs(random), 0.5), (_pairs(ordinary), 0.0)):
        n = [[0] * WIDTH for _ in range(WIDTH)]
        for r in counts.collect():
            n[r.a][r.b] = r["count"]
        digits = range(52, 62)
        for row in n:
            row[52:62] = [sum(row[52:62]) / 10] * 10
        n[52:62] = [[sum(n[a][b] for a in digits) / 10 for b in range(WIDTH)]] * 10
        # A symbol seldom seen leans on how often its followers occur at all; in ordinary
        # strings a little on itself, as rulers and padding repeat it.
        alone = [0.5 + sum(row[b] for row in n) for b in range(WIDTH)]
        alone = [x / sum(alone) for x in alone]
        itself = 0.0 if even else 0.1
        tables.append([[
            math.log(even / WIDTH + (1 - even) * (x + LEAN * ((1 - itself) * alone[b] + itself * (a == b))) / (sum(row) + LEAN))
            for b, x in enumerate(row)] for a, row in enumerate(n)])
    at = [max(ALPHABET.find(chr(c)), -1) % WIDTH for c in range(CODES)]
    return [tables[0][a][b] - tables[1][a][b] if i else 0.0 for i, a in enumerate(at) for b in at]


def looks_random(v: Column, table: list[float]) -> Column:
    """Whether the log-likelihood ratio of a run's transitions speaks for a random string."""
    weights = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        total = acc["total"] + F.element_at(weights, acc["code"] * CODES + code + 1)
        return F.struct(code.alias("code"), total.alias("total"))

    # Code 0, which no run holds, stands before the first symbol and weighs nothing.
    start = F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("total"))
    return F.aggregate(F.split(v, ""), start, step)["total"] >= EACH * (F.length(v) - 1) + ODDS


def added(text: Column, known: Column, table: list[float]) -> Column:
    """Runs of a text that look random, as ``known`` spans are; none that meets one of these.

    Only a run that counts is put into the array, so the time grows with the text alone.
    """
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    zipped = F.arrays_zip(runs.alias("w"), F.slice(F.split(text, CANDIDATE, -1), 1, F.size(runs)).alias("b"))
    kind_of = "array<struct<s: int, k: int, e: int, v: string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["w"])
        span = F.struct(s.alias("s"), F.lit(3).alias("k"), e.alias("e"), x["w"].alias("v"))
        hit = looks_random(x["w"], table)
        return F.struct(e.alias("at"), F.when(hit, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, start, step)["out"]
    return F.filter(found, lambda r: ~F.exists(known, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))


def scanned(docs: DataFrame, text: Column, table: list[float]) -> DataFrame:
    """Adds ``_base`` and ``_found``: base spans in order, and these with what the models add."""
    docs = docs.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    docs = docs.withColumn("_base", base(F.col("_text"))).withColumn("_added", added(F.col("_text"), F.col("_base"), table))
    return docs.withColumn("_found", F.array_sort(F.concat("_base", "_added"))).drop("_text", "_added")


def _line(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")
    )), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and hash of the base, all spans.

    Null texts are empty and have no spans, a null doc_id gives a row with a null doc_id,
    repeated rows repeat, an empty table gives no rows. Where nothing is found to learn
    from, random strings are taken as even over all symbols.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scanned(docs, F.col("text"), train(docs, F.col("text"))).drop("text")
    of_kind = lambda k: F.filter("_base", lambda x: x["k"] == k)
    n = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *n, F.sha2(_line(F.col("_base")), 256).alias("base_sha256"), _line(F.col("_found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a secret replaced; ``n_chars`` follows the text.

    Null texts stay null, repeated rows and null ids stay, an empty table gives no rows; all
    columns keep their names and, beside these two, their values.
    """
    rows = packed(docs)
    rows = scanned(rows, F.col("_doc.text"), train(rows, F.col("_doc.text")))
    text = F.col("_doc.text").cast("string")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(MARK))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.when(fresh, gap).otherwise("")).alias("out"))

    done = F.aggregate("_found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    rows = rows.withColumn("_clean", F.when(F.size("_found") > 0, clean).otherwise(text))
    columns = []
    for c in docs.columns:
        own = F.col(f"_doc.`{c}`")
        if c == "text":
            own = F.col("_clean")
        elif c == "n_chars":
            own = F.when(F.size("_found") > 0, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return rows.select(*columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
