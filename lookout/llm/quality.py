"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Built-in functions only. Sums are of fixed-point integers, so results don't depend on
the order in which Spark adds them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lookout.llm.common import SPACES, documents, packed, stored, words
from lookout.operators.joins import lookup

SYMBOLS = "#*$%&|<>"
SIGNS = SYMBOLS + "!?\"'()[]{}@^_~`\\/+=-:;"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Fixed point of the transformed statistics.
SCALE = 256
# Share of a group that the determinant is minimised over, with the factor that makes its
# covariance consistent for normal data: share / P(chi2 of P + 2 <= quantile of chi2 of P).
SHARE = 0.75
FACTOR = 1.415
STEPS = 3
# Least standard deviation of a statistic, in its own units: most texts have no symbol at
# all, and a covariance without spread would reject the first.
FLOOR = (0.08, 0.7, 0.7, 0.7, 0.7)
P = len(FLOOR)
# Squared distance beyond which a text goes: a normal vector is there once in 10^9.
CUT = 53.0
# Groups with fewer texts use the estimate of their language, then that of all texts.
LEAST_GROUP = 100
# Distances are cut at quantiles by bins of their logarithm.
BINS = 64


def statistics(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the base statistics of a whole text, null as empty, under their names."""
    docs = docs.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    docs = docs.withColumn("_words", words(F.col("_text")))
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    w = F.col("_words")
    docs = docs.withColumn("_windows", F.when(F.size(w) >= 3, F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(1))
    )).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Windows in order of their hashes: those that equal a neighbour are repeated.
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_ordered", F.when(F.col("_twice"), ordered))
    o = F.col("_ordered")
    again = F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    long = lambda c: c.cast("long")
    docs = docs.withColumns({
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(F.array_join(w, ""))),
        "n_symbols": long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": long(F.coalesce(F.when(F.col("_twice"), covered), F.lit(0))),
        "n_signs": long(F.length("_text") - F.length(F.translate("_text", SIGNS, ""))),
        "n_lines": long(F.size("_lines")),
    })
    return docs.drop("_text", "_words", "_lines", "_windows", "_twice", "_ordered").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_signs", "n_lines", "base_failed")


def vector() -> list[Column]:
    """The transformed statistics as fixed-point integers: word length and shares.

    Signs tell from one in a thousand on; a repeated line, such as a license, is common in
    good texts, so shares of repetition count from one in ten on.
    """
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda a, b, scale=1000.0: F.log1p(scale * F.col(a) / b)
    raw = [
        F.log(chars / n), share("n_symbols", chars), share("n_signs", chars),
        share("n_dup_lines", F.greatest("n_lines", F.lit(1)), 10.0), share("n_repeat_words", n, 10.0),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def groups(lang: Column, source: Column) -> list[Column]:
    """Keys of the three levels, of which null is a value of its own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return [F.to_json(F.struct(name(lang).alias("l"), name(source).alias("s"))), F.to_json(F.struct(name(lang).alias("l"))), F.lit("{}")]


def _quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """Lowest values that at least these shares of a group's rows don't exceed."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(own)})
    return counts.groupBy(*keys).agg(
        F.max("_all").alias("n"),
        *[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * s), F.col(value))).alias(f"q{k}") for k, s in enumerate(shares)],
    )


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile widths of each statistic: the first centre and scatter."""
    tall = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("i", "x"))
    q = _quantiles(tall, ["g", "i"], "x", (0.25, 0.5, 0.75))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    wide = q.groupBy("g").agg(
        F.max("n").alias("n"),
        *[pick(F.col("q1") / SCALE, i).alias(f"m{i}") for i in range(P)],
        *[pick((F.col("q2") - F.col("q0")) / SCALE / 1.349, i).alias(f"s{i}") for i in range(P)],
    )
    zero = {f"l{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)}
    return wide.withColumns({**zero, **{f"l{i}{i}": F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + FLOOR[i] ** 2) for i in range(P)}})


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2``: squared Mahalanobis distance, by forward substitution in l."""
    for i in range(P):
        z = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))).drop(*[f"z{i}" for i in range(P)])


def _cholesky(sums: DataFrame) -> DataFrame:
    """Mean and triangular factor of the scaled covariance of each group."""
    n = F.col("h")
    df = sums.withColumns({f"m{i}": F.col(f"t{i}") / n / SCALE for i in range(P)})
    for i in range(P):
        for j in range(i + 1):
            c = FACTOR * (F.col(f"t{i}{j}") / n / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOOR[i] ** 2 / 4))) if i == j else c / F.col(f"l{j}{j}"))
    return df


PARAMETERS = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]


def estimates(stats: DataFrame) -> DataFrame:
    """Centre and scatter of each group ``g`` with at least ``LEAST_GROUP`` texts.

    ``stats(g0, g1, g2, x0.., base_failed)`` has narrow rows. From medians and quartile
    widths, each step keeps the share of a group that lies nearest and takes its mean and
    covariance, which lowers the determinant. Nothing but sums and counts by bins is
    gathered, all combined before the shuffle.
    """
    rows = stats.where(~F.col("base_failed")).select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *[f"x{i}" for i in range(P)])
    now = stored(_start(rows).where(F.col("n") >= LEAST_GROUP).select("g", *PARAMETERS), "mcd")
    for _ in range(STEPS):
        near = _distance(lookup(rows, now, ["g"], "inner")).withColumn("bin", F.floor(BINS * F.log1p("d2")))
        cut = _quantiles(near, ["g"], "bin", (SHARE,)).select("g", F.col("q0").alias("cut"))
        x = [F.col(f"x{i}") for i in range(P)]
        sums = lookup(near, cut, ["g"], "inner").where("bin <= cut").groupBy("g").agg(
            F.count("*").alias("h"), *[F.sum(x[i]).alias(f"t{i}") for i in range(P)],
            *[F.sum(x[i] * x[j]).alias(f"t{i}{j}") for i in range(P) for j in range(i + 1)],
        )
        now = stored(_cholesky(sums).select("g", *PARAMETERS), "mcd")
    return now


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``kept`` to rows with base statistics, keys and vector."""
    values = F.struct(*PARAMETERS)
    for k in range(3):
        own = found.select(F.col("g").alias(f"g{k}"), values.alias(f"e{k}"))
        rows = lookup(rows, own, [f"g{k}"], "left")
    rows = rows.withColumn("_e", F.coalesce("e0", "e1", "e2")).drop("e0", "e1", "e2")
    rows = _distance(rows.withColumns({c: F.col(f"_e.{c}") for c in PARAMETERS}))
    rows = rows.withColumn("distance", F.sqrt("d2"))
    # One comparison, not two conditions: a filter on the base rule alone would move below
    # the joins and work out the statistics a second time.
    far = F.greatest(F.coalesce(F.col("d2"), F.lit(0.0)), F.when(F.col("base_failed"), 2 * CUT).otherwise(0.0))
    kept = far <= CUT
    return rows.withColumn("kept", kept).drop("_e", "d2", *PARAMETERS)


def _prepared(docs: DataFrame) -> DataFrame:
    rows = statistics(packed(docs), F.col("_doc.text"))
    lang = F.col("_doc.lang") if "lang" in docs.columns else F.lit(None)
    source = F.col("_doc.source") if "source" in docs.columns else F.lit(None)
    keys = [g.alias(f"g{k}") for k, g in enumerate(groups(lang, source))]
    return rows.select("_doc", *STATISTICS, *keys, *vector())


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base statistics, ``base_failed``, ``kept``, ``distance``.

    Null and empty texts have no words and fail the base rule, null languages and sources
    are groups of their own, repeated rows count as often as they occur, a null doc_id
    gives a row with a null doc_id, an empty table gives no rows. Where even all texts
    are too few for an estimate only the base rule decides.
    """
    rows = _prepared(docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]))
    rows = stored(rows.withColumn("doc_id", F.col("_doc.doc_id")).drop("_doc"), "quality")
    out = judged(rows, estimates(rows))
    return out.select("doc_id", *STATISTICS[:5], "base_failed", "kept", "distance")


def good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, all columns as they were.

    Rows without text go; otherwise as in ``quality``. The statistics are worked out twice:
    written beside the documents they would take as much disk as the documents, for as long
    as the result isn't written.
    """
    rows = _prepared(docs)
    found = estimates(stored(rows.drop("_doc"), "quality"))
    return judged(rows, found).where("kept").select("_doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
