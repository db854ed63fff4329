"""Catalogue and rule profile from one JSON configuration file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lookout import schemas
from lookout.operators.rules import Profile

_RULES = schemas.PROFILES.split(", ", 1)[1]
_ENTRY = schemas.COMPANIES.split(", ", 1)[1]


def _struct(fields: str) -> str:
    return "STRUCT<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">"


def read_config(spark: SparkSession, path: str) -> tuple[Profile, DataFrame]:
    """The profile under ``filter`` and the catalogue under ``companies``, in file order.

    A profile is configuration: one row, read to the driver.
    """
    schema = f"filter {_struct(_RULES)}, companies ARRAY<{_struct(_ENTRY)}>"
    config = spark.read.schema(schema).option("multiLine", True).json(path, mode="FAILFAST")
    rules = config.select("filter.*").first().asDict()
    profile = Profile.from_mapping({k: v for k, v in rules.items() if v is not None})
    entries = config.select(F.posexplode("companies").alias("pos", "c")).select("pos", "c.*")
    return profile, entries
