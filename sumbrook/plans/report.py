"""KPIs, rule narratives and the Markdown report of finished results, which hold 200 groups at most."""

from __future__ import annotations

from typing import Any

from .query import MetricResult
from .steps import MAX_STEPS
from .summary import Summary

TABLE_ROWS, FINDINGS = 30, 5
ORDER = ("warning", "info", "positive")


def number_text(value: float | int | None, unit: str = "") -> str:
    """As formatting.format_metric, for one number."""
    if value is None:
        return "—"
    plain = lambda v, d=0: f"{v:,.{d}f}".translate({44: " ", 46: ","})
    if unit == "%":
        return plain(value, 2) + "%"
    if unit == "KZT":
        for size, word in ((1e9, "bn"), (1e6, "m")):
            if abs(value) >= size:
                return f"{plain(value / size, 2)} {word} KZT"
        return plain(value) + " KZT"
    return plain(value)


def basic_kpis(summary: Summary) -> list[tuple[str, str]]:
    cells = summary.rows * len(summary.columns)
    missing = sum(s["missing"] for s in summary.statistics.values())
    return [("Rows", number_text(summary.rows)), ("Columns", number_text(len(summary.columns))), ("Measures", number_text(len(summary.measures))), ("Missing", number_text(missing * 100 / cells if cells else 0, "%"))]


def metric_kpis(results: list[MetricResult]) -> list[tuple[str, str]]:
    return [(r.metric.label, number_text(r.overall.value, r.metric.unit)) for r in results]


def narrative(facts: dict[str, tuple[float, str | None]], label: str, unit: str) -> list[tuple[str, str]]:
    """(level, sentence) by rule from a result's facts; only numbers that are facts are named."""
    out, points = [], "pp" if unit == "%" else unit
    shown = lambda f, u=unit: number_text(abs(facts[f][0]), u)
    if "change" in facts:
        way = "did not change" if facts["change"][0] == 0 else "rose" if facts["change"][0] > 0 else "fell"
        level = {"rose": "positive", "fell": "warning"}.get(way, "info")
        by = "" if way == "did not change" else f" by {shown('change', '%' if unit == '%' else unit)}{' (' + points + ')' if unit == '%' else ''}"
        out.append((level, f"{label} {way}{by}, {facts['change'][1]}."))
    if "drop" in facts:
        out.append(("warning", f"The greatest fall between neighbouring periods was {shown('drop')}, {facts['drop'][1]}."))
    if "cat1_value" in facts:
        share = f", {number_text(facts['cat1_share'][0], '%')} of the total" if "cat1_share" in facts else ""
        out.append(("info", f"{facts['cat1_value'][1]} leads with {shown('cat1_value')}{share}."))
    if "growth_leader" in facts:
        out.append(("info", f"{facts['growth_leader'][1]} grew the most: {number_text(facts['growth_leader'][0], '%')}."))
    return out


def check_result(summary: Summary, table_columns: int, kpis: list[tuple[str, str]], results: list[MetricResult], insights: list[dict[str, Any]], failed_checks: int) -> dict[str, bool]:
    """Seven tests of a finished result's shape. insights: evidence and source of each; failed_checks: violations that were found."""
    return {
        "summary_covers_all_columns": len(summary.columns) == table_columns,
        "has_kpis": bool(kpis),
        "has_insights": bool(insights),
        "charts_carry_their_data": all(r.rows for r in results),
        "at_most_four_charts": len(results) <= MAX_STEPS,
        "every_insight_has_evidence": all(i.get("evidence") and i.get("source") for i in insights),
        "insights_passed_verification": failed_checks == 0,
    }


def findings(found: list[tuple[str, str]]) -> list[str]:
    return [text for _, text in sorted(found, key=lambda x: ORDER.index(x[0]))[:FINDINGS]]


def quality_notes(summary: Summary) -> list[str]:
    out = [f"{summary.duplicates} rows are duplicates."] if summary.duplicates else []
    out += [f"{s['missing']} values of {c} are missing." for c, s in summary.statistics.items() if s["missing"]]
    return out or ["No duplicates and no missing values."]


def markdown(title: str, summary: Summary, results: list[MetricResult], texts: list[tuple[str, str]] | None = None) -> str:
    lines = [f"# {title}", "", f"{number_text(summary.rows)} rows, {len(summary.columns)} columns. {' '.join(quality_notes(summary))}", ""]
    if texts:
        lines += ["## Findings", "", *(f"- {t}" for t in findings(texts)), ""]
    for r in results:
        lines += [f"## {r.metric.label}", "", f"{r.metric.formula}; over all rows {number_text(r.overall.value, r.metric.unit)}.", ""]
        if r.rows:
            head = [*r.group_by, r.metric.label, "Rows"]
            lines += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
            lines += ["| " + " | ".join([*(_cell(g.keys[k]) for k in r.group_by), number_text(g.value, r.metric.unit), number_text(g.rows_used)]) + " |" for g in r.rows[:TABLE_ROWS]]
            if len(r.rows) > TABLE_ROWS:
                lines.append(f"\n{len(r.rows) - TABLE_ROWS} more groups.")
            lines.append("")
        lines += [f"> {w}" for w in r.warnings]
    return "\n".join(lines) + "\n"


def _cell(value: Any) -> str:
    return "—" if value is None else str(value).replace("|", "\\|")
