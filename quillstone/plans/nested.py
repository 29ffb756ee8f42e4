"""Queries over nested register bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure
from ..session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of both kinds of bodies with the places of their parents."""
    return structure.bodies_to_tables(table(spark, sf_dir, "fullmakt_signatur_rf"), table(spark, sf_dir, "at_extract"))


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each child table is fed from each structural variant."""
    t = structure.lookup_nodes(table(spark, sf_dir, "fullmakt_signatur_rf")).unionByName(structure.extract_nodes(table(spark, sf_dir, "at_extract")))
    return t.groupBy("child", "shape").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_variants": p4_variants}


def oracle_sql() -> dict[str, str]:
    return {}
