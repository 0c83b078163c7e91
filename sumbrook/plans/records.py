"""What a dataset and its columns are about, as records that a search by words finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.descriptions import synonyms
from ..kinds import Kind
from ..operators import profile, retrieval, text
from .summary import Summary

SCHEMA = "record_id string, dataset_id string, entry_type string, column_name string, column_kind string, aliases array<string>, text string"
ENTRY_TYPES = ("dataset", "column")


def _said(value: object) -> str:
    return f"{value:g}" if isinstance(value, float) else str(value)


#: What is told of a column: the statistics that it needs and the sentence. A fact is left out if one of them is missing.
FACTS = {
    None: (("{kind} column of dataset {title}.", ()), ("{missing_pct:.1f}% of its values are missing.", ("some_missing",))),
    Kind.NUMERIC: (("It goes from {low} to {high}, {mean} on average.", ("low", "high", "mean")),),
    Kind.DATETIME: (("Its dates go from {first} to {last}.", ("first", "last")),),
    Kind.CATEGORICAL: (("It has {distinct} values.", ("distinct",)), ("Values: {values}.", ("values",))),
    Kind.TEXT: (("For example: {values}.", ("values",)),),
    Kind.BOOLEAN: (("Values: {values}.", ("values",)),),
}


def column_text(title: str, name: str, summary: Summary, values: list[str] | None = None) -> str:
    """The column's name and what people call it, then each of FACTS that the statistics allow. Of a personal column nothing but its kind is told."""
    kind = summary.columns[name]
    if name in summary.sensitive:
        return f"{name}: {kind.value} column of dataset {title} that may hold personal data."
    told = {k: _said(v) if k != "missing_pct" else v for k, v in summary.statistics[name].items() if v is not None}
    told |= {"title": title, "kind": kind.value.capitalize()} | ({"values": ", ".join(values)} if values else {}) | ({"some_missing": True} if summary.statistics[name].get("missing") else {})
    about = ", ".join([name, *synonyms(name)]) + "."
    return "\n".join([about, *(sentence.format(**told) for sentence, needs in (*FACTS[kind], *FACTS[None]) if all(n in told for n in needs))])


def shown_values(df: DataFrame, summary: Summary, row: str) -> dict[str, list[str]]:
    """The commonest values of categories and first values of other columns that aren't numbers, dates or personal: what a search by value finds.

    One pass counts the categories' values, one takes the others' first ones; the driver holds 12 or 5 a column.
    """
    own = {c: k for c, k in summary.columns.items() if c not in summary.sensitive and k not in (Kind.NUMERIC, Kind.DATETIME)}
    groups, others = [c for c, k in own.items() if k is Kind.CATEGORICAL], [c for c, k in own.items() if k is not Kind.CATEGORICAL]
    found: dict[str, list[str]] = {}
    for columns, values in ((groups, profile.top_values), (others, profile.sample_values)):
        for r in values(df, columns, row).orderBy("column", "rank").collect() if columns else []:
            found.setdefault(r["column"], []).append(r["value"])
    return found


def dataset_records(spark: SparkSession, summary: Summary, dataset_id: str, title: str, description: str = "", values: dict[str, list[str]] | None = None) -> DataFrame:
    """One record of the dataset and one of each column; they number as the columns do. values: see shown_values."""
    times = [f"{c} from {s['first']} to {s['last']}" for c, k in summary.columns.items() if k is Kind.DATETIME and (s := summary.statistics[c]).get("first") and c not in summary.sensitive]
    lines = [f"Dataset {title}.", description, f"{summary.rows} rows, {len(summary.columns)} columns."]
    lines += [f"{what}: {', '.join(names)}." for what, names in (("Periods", times), ("To group and filter by", summary.dimensions), ("Measures", summary.measures), ("Metrics", summary.metrics)) if names]
    rows = [(f"ds-{dataset_id}", dataset_id, "dataset", None, None, [], "\n".join(x for x in lines if x))]
    for i, (name, kind) in enumerate(summary.columns.items()):
        rows.append((f"col-{dataset_id}-{i:03d}", dataset_id, "column", name, kind.value, synonyms(name), column_text(title, name, summary, (values or {}).get(name))))
    return spark.createDataFrame(rows, SCHEMA)


def search_metadata(records: DataFrame, query: str, k: int = 5, dataset_id: str | None = None, entry_type: str | None = None) -> DataFrame:
    """The k records nearest to the query with score and relevant, in one dataset or of one type if given. No words find nothing."""
    where = F.lit(bool(query.strip()))
    if dataset_id:
        where &= F.col("dataset_id") == dataset_id
    if entry_type:
        where &= F.col("entry_type") == entry_type
    return retrieval.search(records.where(where).withColumn("embedding", text.embed(F.col("text"))), text.hash_vector(query), k, key="record_id").drop("embedding")
