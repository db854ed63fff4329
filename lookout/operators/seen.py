"""Seen-record state: what is new, what gets marked, what is kept."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lookout.functions.text import dedup_key
from lookout.operators.joins import lookup
from lookout.operators.topk import first_per_key, retain_newest

SEEN_COLUMNS = ("key", "company", "first_seen", "title", "location", "url", "alerted", "catalog_name")
# Parts of the seen table by hash of the key. The layout on disk depends on it.
BUCKETS = 64


def with_key(postings: DataFrame) -> DataFrame:
    return postings.withColumn("key", dedup_key())


def bucket(key: Column | str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def buckets_of(batch: DataFrame) -> list[int]:
    """The buckets that a batch's keys fall into, at most ``BUCKETS``."""
    return sorted(r[0] for r in batch.select(bucket()).distinct().collect())


def known_keys(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """The seen keys that occur in the batch.

    The seen table outgrows any batch. With the batch's distinct keys on the build
    side, a batch under the broadcast threshold is matched in one scan of the seen
    key column, without moving the table; a larger one falls back to a shuffle join.
    """
    return seen.select("key").join(batch.select("key").distinct(), "key", "left_semi")


def new_postings(batch: DataFrame, seen: DataFrame, dedupe_batch: bool = False,
                 order: list[Column] | None = None, seen_is_large: bool = False) -> DataFrame:
    """Postings whose key is not in ``seen``.

    Repeats inside the batch are all new, unless ``dedupe_batch`` asks for the first
    of each key in the given order. Batch and seen keys are each read once; where seen
    is far larger than the batch, ``seen_is_large`` first selects the seen keys that the
    batch has, for one more scan of the batch's keys.
    """
    known = known_keys(batch, seen) if seen_is_large else seen.select("key")
    fresh = lookup(batch, known, ["key"], "left_anti")
    return first_per_key(fresh, ["key"], order or _arrival(batch)) if dedupe_batch else fresh


def seen_postings(batch: DataFrame, seen: DataFrame) -> DataFrame:
    return lookup(batch, known_keys(batch, seen), ["key"], "left_semi")


def _arrival(batch: DataFrame) -> list[Column]:
    """The order of landing, then all columns that can be ordered, so that it is total."""
    first = [c for c in ("run_ts", "catalog_name", "term_idx", "page_no", "pos") if c in batch.columns]
    simple = [c for c, t in batch.dtypes if c not in first and "map<" not in t and t != "variant"]
    return [F.col(c) for c in [*first, *sorted(simple)]]


def first_marks(new: DataFrame, run_ts: datetime | Column, alerted: Column,
                order: list[Column] | None = None) -> DataFrame:
    """Seen rows of new postings: one per key, taken from its first arrival."""
    at = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    marks = first_per_key(new, ["key"], order or _arrival(new))
    entry = F.col("catalog_name") if "catalog_name" in new.columns else F.lit(None).cast("string")
    return marks.select(
        "key", "company", at.alias("first_seen"), "title", "location", "url",
        alerted.alias("alerted"), entry.alias("catalog_name"),
    )


def mark_seen(seen: DataFrame, batch: DataFrame, run_ts: datetime | Column, alerted: Column,
              order: list[Column] | None = None) -> DataFrame:
    """Seen table after the batch; an existing row is never changed."""
    marks = first_marks(new_postings(batch, seen), run_ts, alerted, order)
    return seen.select(*SEEN_COLUMNS).unionByName(marks)


def seed(seen: DataFrame, batch: DataFrame, run_ts: datetime | Column,
         order: list[Column] | None = None) -> DataFrame:
    """Mark everything as seen without scoring or alerting."""
    return mark_seen(seen, batch, run_ts, F.lit(False), order)


def retain(seen: DataFrame, n: int | None) -> DataFrame:
    """The newest ``n`` keys. An evicted key alerts again if it is still listed; with None all stay."""
    return seen if n is None else retain_newest(seen, n, "first_seen", "key")
