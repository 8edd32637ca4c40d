"""Registry of the queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import assembly, decomposition, emission, inference, measurement, modelling, residuals, scoring, transfer

FAMILIES = (decomposition, measurement, scoring, assembly, transfer, modelling, residuals, emission, inference)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for family in FAMILIES for name, s in family.SQL.items()}
