"""Explicit schemas of the reference's input files and the NaN → null rule.

Spark keeps NaN and null apart: NaN sorts above every number and is not
skipped by ``avg``. The reference treats NaN as missing, so every source
turns NaN into null and no operator produces NaN afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def measure_schema(entity: str, year: str, value: str) -> T.StructType:
    """Per-hazard measure file: entity name, year, one numeric value."""
    return T.StructType([
        T.StructField(entity, T.StringType()),
        T.StructField(year, T.IntegerType()),
        T.StructField(value, T.DoubleType()),
    ])


def wide_damage_schema(hazard_cols: list[str]) -> T.StructType:
    """Economic damage in % of GDP, one column per hazard."""
    return T.StructType(
        [T.StructField("Entity", T.StringType()),
         T.StructField("Code", T.StringType()),
         T.StructField("Year", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in hazard_cols])


def nan_to_null(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def normalise_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every float / double column."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select([nan_to_null(c).alias(c) if c in floats else F.col(c)
                      for c in df.columns])
