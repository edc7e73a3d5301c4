"""Payloads of any shape: JSON kept as VARIANT, read field by field with the type that is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a VARIANT; null if it is not JSON."""
    return F.try_parse_json(text)


def field(payload: Column, path: str, kind: str) -> Column:
    """The value at a path (``$.a.b[0]``) as a type; null where there is none or it can't be read as that."""
    return F.try_variant_get(payload, path, kind)


def fields(df: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """df with a column for each name of ``wanted``, read from the payload's top level with that type. Names that df has already are an error."""
    if taken := set(wanted) & set(df.columns):
        raise ValueError(f"the input has {sorted(taken)} already")
    return df.withColumns({name: field(F.col(column), f"$['{name}']", kind) for name, kind in wanted.items()})


def schema(df: DataFrame, column: str) -> str:
    """One schema that fits all payloads, gathered over the rows; types that disagree become the wider one, or VARIANT."""
    return df.agg(F.schema_of_variant_agg(F.col(column)).alias("s")).first()["s"]
