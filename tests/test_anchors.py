"""The payments fixture, end to end, against its published totals."""

import pytest

from sumbrook.functions import parsing
from sumbrook.operators import facts
from sumbrook.plans.query import MetricQuery, calculate_metric

# fixed values: month, then transactions, successful, failed, amount of each channel
CHANNELS = ("Mobile", "Web", "API")
ROWS = {
    "2026-01": ((177841, 173931, 3910, 1494747476), (98074, 95133, 2941, 1373382401), (41249, 40683, 566, 1317753468)),
    "2026-02": ((186173, 182292, 3881, 1584817850), (99395, 96655, 2740, 1393056031), (42107, 41436, 671, 1347377646)),
    "2026-03": ((188781, 174157, 14624, 1599983794), (98142, 88281, 9861, 1423531581), (43437, 41413, 2024, 1339280157)),
    "2026-04": ((191290, 187137, 4153, 1590134697), (101616, 98962, 2654, 1457663497), (43712, 42996, 716, 1391445113)),
    "2026-05": ((195390, 191015, 4375, 1632968955), (104448, 101523, 2925, 1454718116), (44397, 43831, 566, 1405509582)),
    "2026-06": ((200835, 196835, 4000, 1666655405), (105483, 102754, 2729, 1496300076), (45316, 44574, 742, 1407792596)),
}
# fixed values: published results
TOTALS = {"transaction_count": 2007686, "successful_count": 1943608, "failed_count": 64078, "transaction_volume": 26377118441, "success_rate": 96.8084, "average_transaction_amount": 13138.0696}
RATE_BY_MONTH = {"2026-01": 97.6615, "2026-02": 97.7746, "2026-03": 91.9757, "2026-04": 97.7651, "2026-05": 97.7149, "2026-06": 97.8753}
AVERAGE_BY_CHANNEL = {"API": 31547.2356, "Mobile": 8391.848, "Web": 14162.1319}


@pytest.fixture(scope="module")
def payments(spark):
    """The rows as text, with their kinds detected and parsed, as from a file."""
    raw = [(i, m, *map(str, v), c) for i, (m, c, v) in enumerate((m, c, v) for m, by in ROWS.items() for c, v in zip(CHANNELS, by, strict=True))]
    df = spark.createDataFrame(raw, "_row long, Month string, Transactions string, Successful string, Failed string, Amount_KZT string, Channel string")
    found = parsing.detect(df)
    assert [k.value for k, _ in found.values()] == ["datetime", *["numeric"] * 4, "categorical"]
    return parsing.typed(df, found).select("Month", "Transactions", "Successful", "Failed", "Amount_KZT", "Channel").cache()


@pytest.mark.parametrize("name", TOTALS)
def test_totals(payments, name):
    assert round(calculate_metric(payments, name).overall.value, 4) == TOTALS[name]


def test_groups(payments):
    by_month = calculate_metric(payments, "success_rate", ["Month"])
    assert {g.keys["Month"]: round(g.value, 4) for g in by_month.rows} == RATE_BY_MONTH and round(by_month.overall.value, 4) == TOTALS["success_rate"]
    assert {g.keys["Channel"]: round(g.value, 4) for g in calculate_metric(payments, "average_transaction_amount", ["Channel"]).rows} == AVERAGE_BY_CHANNEL


def test_filters(payments):
    march = calculate_metric(payments, "success_rate", ["Channel"], [{"column": "Month", "op": "eq", "value": "2026-03"}])
    assert {g.keys["Channel"]: round(g.value, 4) for g in march.rows} == {"API": 95.3404, "Mobile": 92.2535, "Web": 89.9523}
    rest = calculate_metric(payments, "success_rate", None, [{"column": "Month", "op": "ne", "value": "2026-03"}])
    assert round(rest.overall.value, 4) == 97.7602
    two = calculate_metric(payments, "transaction_count", None, [{"column": "Month", "op": "in", "value": ["2026-02", "2026-03"]}])
    assert two.overall.value == 658035


def test_facts(payments):
    series = MetricQuery.build(payments, "success_rate", ["Month"]).grouped().withColumnRenamed("Month", "t")
    found = {r.fact: r for r in facts.time_facts(series, percent=True).collect()}
    assert round(found["min"].value, 4) == 91.9757 and found["min"].of.startswith("2026-03") and round(found["drop"].value, 4) == -5.7989 and "change_pct" not in found
