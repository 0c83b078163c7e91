"""The semantic kind of a column, which decides the operators it allows."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Kind(StrEnum):
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"
    TEXT = "text"
    BOOLEAN = "boolean"


def kind_of(field: T.StructField) -> Kind:
    """The kind in the field's metadata, or else what its type says; strings count as categorical."""
    if field.metadata and "kind" in field.metadata:
        return Kind(field.metadata["kind"])
    if isinstance(field.dataType, T.BooleanType):
        return Kind.BOOLEAN
    if isinstance(field.dataType, T.NumericType):
        return Kind.NUMERIC
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Kind.DATETIME
    return Kind.CATEGORICAL


def kinds(df: DataFrame) -> dict[str, Kind]:
    return {f.name: kind_of(f) for f in df.schema.fields}


def column_name(name: str) -> str:
    """A name quoted for Spark: names may hold blanks and dots."""
    return "`" + name.replace("`", "``") + "`"
