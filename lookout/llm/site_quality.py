"""Quality classifier: document evidence with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.llm.common import documents, stored, words
from lookout.operators.joins import lookup

# Labelled documents that the classifier is fitted on, at most.
SAMPLE_ROWS = 10_000
BUCKETS = 1 << 16
UNIT = 1_000_000
KEEP = 0.5
# Strengths of a prior, in documents, between which an estimate is taken.
WEAKEST, STRONGEST = 2.0, 10_000.0
SIGNS = "#*$%&|<>!?\"'()[]{}@^_~`\\/+=-:;"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ"


def _features(docs: DataFrame) -> DataFrame:
    """Adds ``features``: hashed lower-case words, and shares of signs and capitals."""
    from pyspark.ml.feature import HashingTF, VectorAssembler

    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))) / n
    docs = docs.withColumn("_words", words(F.lower(text)))
    shares = [share(SIGNS), share(UPPER), F.log1p(F.size("_words").cast("double")), n / (F.size("_words") + 1)]
    docs = docs.withColumns({f"_share{i}": x for i, x in enumerate(shares)})
    docs = HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=BUCKETS, binary=True).transform(docs)
    return VectorAssembler(inputCols=[*[f"_share{i}" for i in range(4)], "_hashed"], outputCol="features").transform(docs).drop("_words", *[f"_share{i}" for i in range(4)], "_hashed")


def fit(docs: DataFrame, labels: DataFrame):
    """Logistic regression of good (quality 1, not toxic) on a bounded labelled sample.

    None where the labels have one class only. The sample is broadcast: its size is
    bounded by ``SAMPLE_ROWS``.
    """
    from pyspark.ml.classification import LogisticRegression

    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    train = docs.where("text is not null").join(F.broadcast(own), "doc_id")
    train = stored(_features(train.select("text", "label")).select("label", "features"), "site-sample")
    classes = train.groupBy("label").count().collect()
    if len(classes) < 2:
        return None
    return LogisticRegression(maxIter=25, regParam=0.002).fit(train)


def _strength(groups: DataFrame) -> float:
    """Documents that a prior is worth: by moments, from how much group means differ."""
    mean = F.col("good") / F.col("n") / UNIT
    s = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("good") / UNIT).alias("good"), F.count("*").alias("k"),
        F.sum(F.col("n") * mean * mean).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).first()
    if not s.n or s.k < 2:
        return WEAKEST
    mu = s.good / s.n
    within = mu * (1 - mu)
    spread = s.squares / s.n - mu * mu - within * s.k / s.n
    scale = 1 - s.n2 / (s.n * s.n)
    between = max(spread / scale if scale > 0 else 0.0, 1e-12)
    return min(max(within / between - 1, WEAKEST), STRONGEST)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``doc_id, evidence, prior, score, kept`` for every row of ``docs(doc_id, text, ...)``.

    A site's posterior share of good documents is its documents' classifier probabilities,
    shrunk: a path toward its host, a host toward all documents, the sparser the more.
    A document's own probability is left out of its path's share before both are
    combined in log odds. Probabilities are summed as integers by map-side combining
    aggregates, so a host with a third of all rows is no hot spot.

    Null and empty texts get the evidence that the classifier gives for no words, null
    hosts and paths are sites of their own, repeated rows count each, a null doc_id gives
    a row with a null doc_id; with labels of one class or none all evidence is 0.5 and
    all are kept. An empty table gives no rows.
    """
    from pyspark.ml.functions import vector_to_array

    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        name(host).alias("host"), F.concat_ws("\x1f", name(host), name(path)).alias("path"),
    )
    model = fit(rows, labels)
    if model is None:
        rows = rows.drop("text").withColumn("p", F.lit(UNIT // 2).cast("long"))
    else:
        scored = model.transform(_features(rows))
        rows = scored.select("doc_id", "host", "path", F.round(vector_to_array("probability")[1] * UNIT).cast("long").alias("p"))
    rows = stored(rows, "site-evidence")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = everything.good / everything.n / UNIT if everything.n else 0.5
    k_host, k_path = _strength(hosts), _strength(paths)
    hosts = hosts.select("host", ((F.col("good") / UNIT + k_host * mean) / (F.col("n") + k_host)).alias("host_share"))
    paths = lookup(paths, hosts, ["host"], "inner").select("path", "n", "good", "host_share")
    rows = lookup(rows, paths, ["path"], "inner")
    prior = ((F.col("good") - F.col("p")) / UNIT + k_path * F.col("host_share")) / (F.col("n") - 1 + k_path)
    evidence = F.col("p") / UNIT
    odds = _logit(evidence) - _logit(F.lit(mean)) + _logit(F.col("prior"))
    rows = rows.withColumn("prior", prior).withColumn("score", 1 / (1 + F.exp(-odds)))
    return rows.select("doc_id", evidence.alias("evidence"), "prior", "score", (F.col("score") >= KEEP).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, docs["source"], docs["lang"])
