"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.session import scratch_dir

# The six characters that part words: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


# Shuffle files of a write go when it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path, before = scratch_dir(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the maximal runs without space characters; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``_doc``, so that none clashes with ours."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_doc.*")
