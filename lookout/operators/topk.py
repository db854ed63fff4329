"""Ranking operators: per group, overall, and exact retention of the newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampNTZType

from lookout.session import scratch_dir

# Sets of input tasks within which a group is limited before it is limited as a whole.
SALTS = 32
# Rows that tie at the cut of a retention and are ordered one by one.
TIED_ROWS = 10_000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in the given order.

    The filter sits directly on the window, so Spark keeps one row per key in each
    map task before it shuffles (WindowGroupLimit): a key that holds a third of all
    rows sends at most one row per task.
    """
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every group.

    Spark keeps ``n`` rows of a group in each input task before it shuffles them. So that
    not all tasks' rows of a hot group meet in one place, a group is first limited within
    sets of input tasks: a task belongs to one set, and sends no row twice.
    """
    if n > 1:
        sets = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        df = _limit(sets, [*keys, "_salt"], order, n).drop("_salt")
    return _limit(df, keys, order, n)


def _limit(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def rank_preview(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows overall with their rank; only the kept rows are numbered."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def time_digits(df: DataFrame, column: str) -> list[Column]:
    """Hour, second of the hour and microsecond of the second, free of the session zone."""
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        fraction = F.date_part(F.lit("SECOND"), F.col(column)) * 1_000_000
        return [
            F.unix_date(F.to_date(column)) * 24 + F.hour(column),
            F.minute(column) * 60 + F.second(column),
            F.pmod(fraction.cast("bigint"), F.lit(1_000_000)),
        ]
    us = F.unix_micros(column)
    within, fraction = F.pmod(us, F.lit(3_600_000_000)), F.pmod(us, F.lit(1_000_000))
    return [us - within, within - fraction, fraction]


def retain_newest(df: DataFrame, n: int, time: str = "first_seen", key: str = "key") -> DataFrame:
    """The ``n`` newest rows; rows of one instant are kept in order of md5(key), key.

    No sort of the table: one pass counts rows per hour and shows the hour of the cut. If
    few rows tie there, they are ordered and the last one to stay is the cut; else the hour
    is counted by second, by parts of the second and by the hash, each time only where the
    cut lies. The table itself is then filtered by the cut, without a shuffle. Rows without
    a time are the oldest; rows alike in time and key stay or go together.
    """
    if n <= 0:
        return df.limit(0)
    hour, second, micro = time_digits(df, time)
    hash_ = F.md5(key)
    # Newest first, so the digits of the time count down.
    times = [F.coalesce(-d.cast("bigint"), F.lit(2**62)) for d in (hour, second, F.floor(micro / 1000), micro % 1000)]
    bits = [F.conv(F.substring(hash_, 1 + 4 * k, 4), 16, 10).cast("bigint") for k in range(2)]
    digits, cut, need = [*times, *bits], [], n
    for digit in digits:
        counts = _tied(df, digits, cut).groupBy(digit.alias("digit")).count().collect()
        counts = sorted((r.digit, r["count"]) for r in counts)
        if not cut and sum(c for _, c in counts) <= n:
            return df
        for value, count in counts:
            if count >= need:
                break
            need -= count
        cut.append(value)
        if count <= max(need, TIED_ROWS):
            break
    place = F.struct(*[d.alias(f"d{k}") for k, d in enumerate(digits[: len(cut)])])
    at = F.struct(*[F.lit(v).cast("bigint").alias(f"d{k}") for k, v in enumerate(cut)])
    if count == need:
        return df.filter(place <= at)
    # The rows that tie so far, in the whole order.
    names = [f"t{k}" for k in range(len(times))]
    whole = [*[t.alias(name) for t, name in zip(times, names)], hash_.alias("hash"), F.col(key).alias("key")]
    last = _tied(df, digits, cut).select(*whole).orderBy(*names, "hash", "key").offset(need - 1).first()
    end = F.struct(*[F.lit(last[c]).alias(c) for c in [*names, "hash", "key"]])
    return df.filter((place < at) | ((place == at) & (F.struct(*whole) <= end)))


def _tied(df: DataFrame, digits: list[Column], cut: list[int]) -> DataFrame:
    for digit, value in zip(digits, cut):
        df = df.filter(digit == value)
    return df


def with_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its ``rank`` from 1 in a total order, without a task that sees all rows.

    Rows are dealt by ranges of the order and written as sorted parts; the parts' sizes,
    one row for each, added up say where a part begins. The exchange by all columns in
    front keeps the sampling of the ranges from computing ``df`` a second time.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "ranked")
    simple = [c for c, t in df.dtypes if "map<" not in t]
    placed = df.repartition(*simple).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per written part.
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.join(starts, "_part").withColumn("rank", F.col("_start") + place + 1)
    return ranked.select(*df.columns, "rank")
