"""What a caller may know of a dataset: measures, dimensions, metrics; nothing from personal columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalyticsError
from ..functions import pii
from ..functions.parsing import coerce
from ..kinds import Kind, column_name, kinds
from ..operators import profile
from .metrics import available_metrics

NAMED = 8


@dataclass
class Summary:
    rows: int
    columns: dict[str, Kind]
    measures: list[str]
    dimensions: list[str]
    sensitive: list[str]
    metrics: list[str]
    statistics: dict[str, dict[str, Any]] = field(default_factory=dict)
    duplicates: int = 0
    #: why each personal column is one: its name, its values or a person's word
    reasons: dict[str, str] = field(default_factory=dict)

    @property
    def times(self) -> list[str]:
        return [c for c in self.dimensions if self.columns[c] is Kind.DATETIME]


def summarise(df: DataFrame, row: str | None = None, kind_of: dict[str, Kind] | None = None, personal: dict[str, bool] | None = None) -> Summary:
    """Two passes: the columns' statistics and the duplicates. row: a column that numbers the rows, for the sample of values.

    kind_of and personal hold a person's corrections: a column's kind, and whether it is personal whatever it looks like.
    """
    data = df.drop(row) if row else df
    corrected, said = kind_of or {}, personal or {}
    strange = [c for c in (*corrected, *said) if c not in data.columns]
    if strange:
        raise AnalyticsError(f"There is no column {', '.join(strange)}.")
    for c, k in corrected.items():
        data = data.withColumn(c, coerce(F.col(column_name(c)).cast("string"), k)).withMetadata(c, {"kind": k.value})
    of = kinds(data)
    guessed = pii.sensitive_columns(df, row) if row else {c: "name" for c in data.columns if pii.NAME.search(c)}
    sensitive = {c: guessed.get(c, "given") for c in data.columns if said.get(c, c in guessed)}
    stats = {r["column"]: r.asDict() for r in profile.column_stats(data).collect()}  # a row for each column
    hidden = ("low", "high", "mean", "median", "std", "first", "last")
    shown = {c: {k: v for k, v in s.items() if k != "column" and not (c in sensitive and k in hidden)} for c, s in stats.items()}
    return Summary(
        next((s["rows"] for s in stats.values()), 0),
        of,
        [c for c, k in of.items() if k is Kind.NUMERIC and c not in sensitive],
        [c for c, k in of.items() if k in (Kind.CATEGORICAL, Kind.DATETIME, Kind.BOOLEAN) and c not in sensitive],
        list(sensitive),
        available_metrics(of, frozenset(sensitive)),
        shown,
        profile.duplicate_rows(data).first().duplicates,
        sensitive,
    )


def default_description(summary: Summary) -> str:
    """What a table is described as until a person does: its size and its columns by what they serve for, eight of each named."""
    groups = (("Measures", summary.measures), ("Dates", summary.times), ("Categories", [c for c in summary.dimensions if summary.columns[c] is Kind.CATEGORICAL]))
    named = [f"{what}: {', '.join(cs[:NAMED])}{f' and {len(cs) - NAMED} more' if len(cs) > NAMED else ''}." for what, cs in groups if cs]
    return " ".join([f"A table of {summary.rows} rows and {len(summary.columns)} columns.", *named])
