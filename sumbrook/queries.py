"""Queries over the driver's tables, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formatting, parsing, phrases, pii
from .kinds import Kind
from .operators import charts, context, evalstats, facts, profile, redact, retrieval, search_many, text, usage, verify
from .plans import questions, records
from .plans.answers import Source, evidence
from .plans.query import MetricQuery, exact_sum, key_text, month_totals
from .plans.shared import Shared
from .plans.steps import Step
from .plans.summary import summarise
from .session import shared_dir
from .sources.index import ChunkIndex
from .streaming.metrics import windowed_metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- metrics

EXACT = "CAST(sum(CAST({0} AS DECIMAL(28,6))) AS DOUBLE)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the month of their date, the price of open orders and an urgency flag."""
    return table(spark, d, "orders").withColumns(
        {"month": F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"), "open_price": F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0), "urgent": F.col("o_orderpriority") == "1-URGENT"}
    )


ORDERS = "(SELECT *, date_trunc('month', o_orderdate) AS month, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END AS open_price, o_orderpriority = '1-URGENT' AS urgent FROM orders)"


def _payments(spark: SparkSession, d: str) -> DataFrame:
    """Events as payments: an error is a failed transaction; three channels by user."""
    failed = (F.col("event_type") == "error").cast("long")
    return table(spark, d, "events").select(
        F.date_trunc("month", "ts").cast("timestamp_ntz").alias("Month"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("Channel"), F.lit(1).cast("long").alias("Transactions"),
        (1 - failed).alias("Successful"), failed.alias("Failed"), F.col("value").alias("Amount_KZT"),
    )


PAYMENTS = "(SELECT date_trunc('month', ts) AS \"Month\", 'c' || CAST(user_id % 3 AS VARCHAR) AS Channel, 1 AS Transactions, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS Successful, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Failed, value AS Amount_KZT FROM events)"


def _ratio(a: str, b: str, scale: str = "") -> str:
    return f"{EXACT.format(a)} / nullif({EXACT.format(b)}, 0){scale}"


def _metric(name: str, source: Callable, sql_source: str, metric: str, value: str, group_by: list[str], filters=None, where: str = "true", usable: str = "true") -> None:
    keys = ", ".join(f'"{g}"' if g == "Month" else g for g in group_by)
    sql = f"SELECT {keys + ', ' if keys else ''}{value} AS value, count(*) AS rows_used FROM {sql_source} WHERE ({where}) AND ({usable})" + (f" GROUP BY {keys}" if keys else "")
    query(name, sql)(lambda s, d: MetricQuery.build(source(s, d), metric, group_by, filters).grouped() if group_by else MetricQuery.build(source(s, d), metric, None, filters).overall().select("value", "rows_used"))


def _lineitem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


_metric("metric_sum_by_category", _lineitem, "lineitem", "sum:l_extendedprice", EXACT.format("l_extendedprice"), ["l_returnflag"])
_metric("metric_ratio_by_category", _lineitem, "lineitem", "ratio:l_extendedprice/l_quantity", _ratio("l_extendedprice", "l_quantity"), ["l_returnflag"], {"l_linestatus": "O"}, "l_linestatus = 'O'")
_metric("metric_rate_by_month", _orders, ORDERS, "rate:open_price/o_totalprice", _ratio("open_price", "o_totalprice", " * 100"), ["month"])
_metric("metric_two_dims", _orders, ORDERS, "sum:o_totalprice", EXACT.format("o_totalprice"), ["o_orderpriority", "o_orderstatus"])
_metric("metric_three_dims", _orders, ORDERS, "sum:o_totalprice", EXACT.format("o_totalprice"), ["o_orderpriority", "o_orderstatus", "urgent"])
_metric("metric_overall", _orders, ORDERS, "ratio:o_totalprice/o_custkey", _ratio("o_totalprice", "o_custkey"), [])
_metric("metric_integer_sum", _lineitem, "lineitem", "sum:l_orderkey", "CAST(sum(l_orderkey) AS BIGINT)", ["l_linestatus"])
for _name, _sql in {
    "transaction_count": "CAST(sum(Transactions) AS BIGINT)", "successful_count": "CAST(sum(Successful) AS BIGINT)", "failed_count": "CAST(sum(Failed) AS BIGINT)", "transaction_volume": EXACT.format("Amount_KZT"),
    "success_rate": "CAST(sum(Successful) AS DOUBLE) / sum(Transactions) * 100", "average_transaction_amount": EXACT.format("Amount_KZT") + " / sum(Transactions)",
}.items():
    _metric(f"metric_{_name}", _payments, PAYMENTS, _name, _sql, ["Channel"])
_metric("metric_success_rate_by_month", _payments, PAYMENTS, "success_rate", "CAST(sum(Successful) AS DOUBLE) / sum(Transactions) * 100", ["Month", "Channel"])


def _holes(s: SparkSession, d: str) -> DataFrame:
    """Orders without a price where the key leaves 0 modulo 7, and a denominator that is 0 for one priority."""
    return table(s, d, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).cast("long").alias("n"))


HOLES = "(SELECT o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS n FROM orders)"
_metric("metric_null_exclusion", _holes, HOLES, "ratio:price/n", f"{EXACT.format('price')} / nullif(sum(n), 0)", ["o_orderpriority"], usable="price IS NOT NULL")
_metric("metric_empty_selection", _orders, ORDERS, "sum:o_totalprice", f"coalesce({EXACT.format('o_totalprice')}, 0)", [], {"o_orderstatus": "none"}, "o_orderstatus = 'none'")


@query("metric_group_and_overall", f"SELECT o_orderpriority, CAST(grouping(o_orderpriority) AS INTEGER) AS is_total, {EXACT.format('o_totalprice')} AS value, count(*) AS rows_used FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def _group_and_overall(s: SparkSession, d: str) -> DataFrame:
    return MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["o_orderpriority"]).with_total()


@query("metric_rows_matched", f"SELECT {EXACT.format('price')} / nullif(CAST(sum(CASE WHEN price IS NOT NULL THEN n END) AS DOUBLE), 0) AS value, count(price) AS rows_used, count(*) AS rows_matched FROM {HOLES}")
def _rows_matched(s: SparkSession, d: str) -> DataFrame:
    return MetricQuery.build(_holes(s, d), "ratio:price/n").overall()


def _tiny(s: SparkSession, d: str) -> DataFrame:
    """Lines with quantities that are whole multiples of 2 ** -40, far below six decimal places."""
    return table(s, d, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("double") / float(2**40)).alias("tiny"))


_metric("metric_tiny_values", _tiny, "lineitem", "sum:tiny", "CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 1099511627776", ["l_returnflag"])


# --- filters: a count and a sum of what each leaves

_SUM = EXACT.format("o_totalprice")
_DAY = "o_orderdate"
_FILTERS: dict[str, tuple[dict, str]] = {
    "num_eq": ({"column": "o_custkey", "op": "eq", "value": 7}, "o_custkey = 7"),
    "num_ne": ({"column": "o_custkey", "op": "ne", "value": 7}, "o_custkey <> 7"),
    "num_gt": ({"column": "o_totalprice", "op": "gt", "value": 1000.5}, "o_totalprice > 1000.5"),
    "num_gte": ({"column": "o_totalprice", "op": "gte", "value": 1000.5}, "o_totalprice >= 1000.5"),
    "num_lt": ({"column": "o_totalprice", "op": "lt", "value": 250000}, "o_totalprice < 250000"),
    "num_lte": ({"column": "o_totalprice", "op": "lte", "value": 250000}, "o_totalprice <= 250000"),
    "num_between": ({"column": "o_custkey", "op": "between", "value": [10, 50]}, "o_custkey BETWEEN 10 AND 50"),
    "num_in": ({"column": "o_custkey", "op": "in", "value": [1, 2, 3]}, "o_custkey IN (1, 2, 3)"),
    "num_not_in": ({"column": "o_custkey", "op": "not_in", "value": [1, 2, 3]}, "o_custkey NOT IN (1, 2, 3)"),
    "date_eq_month": ({"column": _DAY, "op": "eq", "value": "1995-03"}, f"{_DAY} >= '1995-03-01' AND {_DAY} < '1995-04-01'"),
    "date_eq_day": ({"column": _DAY, "op": "eq", "value": "1995-03-15"}, f"{_DAY} >= '1995-03-15' AND {_DAY} < '1995-03-16'"),
    "date_ne": ({"column": _DAY, "op": "ne", "value": "1995-03"}, f"NOT ({_DAY} >= '1995-03-01' AND {_DAY} < '1995-04-01')"),
    "date_gt": ({"column": _DAY, "op": "gt", "value": "1995-03"}, f"{_DAY} >= '1995-04-01'"),
    "date_gte": ({"column": _DAY, "op": "gte", "value": "1995-03-15"}, f"{_DAY} >= '1995-03-15'"),
    "date_lt": ({"column": _DAY, "op": "lt", "value": "1995-03-15"}, f"{_DAY} < '1995-03-15'"),
    "date_lte": ({"column": _DAY, "op": "lte", "value": "1995-03"}, f"{_DAY} < '1995-04-01'"),
    "date_between": ({"column": _DAY, "op": "between", "value": ["1994-12", "1995-03-15"]}, f"{_DAY} >= '1994-12-01' AND {_DAY} < '1995-03-16'"),
    "date_in": ({"column": _DAY, "op": "in", "value": ["1994-12", "1996-02"]}, f"{_DAY} >= '1994-12-01' AND {_DAY} < '1995-01-01' OR {_DAY} >= '1996-02-01' AND {_DAY} < '1996-03-01'"),
    "date_not_in": ({"column": _DAY, "op": "not_in", "value": ["1994-12", "1996-02"]}, f"NOT ({_DAY} >= '1994-12-01' AND {_DAY} < '1995-01-01' OR {_DAY} >= '1996-02-01' AND {_DAY} < '1996-03-01')"),
    "cat_eq": ({"column": "o_orderstatus", "op": "eq", "value": "F"}, "o_orderstatus = 'F'"),
    "cat_ne": ({"column": "o_orderstatus", "op": "ne", "value": "F"}, "o_orderstatus <> 'F'"),
    "cat_in": ({"column": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "cat_not_in": ({"column": "o_orderpriority", "op": "not_in", "value": ["1-URGENT", "2-HIGH"]}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "bool_eq": ({"column": "urgent", "op": "eq", "value": True}, "urgent"),
    "bool_ne": ({"column": "urgent", "op": "ne", "value": True}, "NOT urgent"),
    "bool_in": ({"column": "urgent", "op": "in", "value": [False]}, "NOT urgent"),
    "bool_not_in": ({"column": "urgent", "op": "not_in", "value": [False]}, "urgent"),
}
for _name, (_filter, _sql) in _FILTERS.items():
    _metric(f"filter_{_name}", _orders, ORDERS, "sum:o_totalprice", _SUM, ["o_orderstatus"], [_filter], _sql)


# --- parsing

_STRANGE = "CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN ' ' || replace(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' ' WHEN 2 THEN 'n/a' ELSE l_returnflag || '1' END"


def _strange(s: SparkSession, d: str) -> DataFrame:
    money, amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("decimal(18,2)").cast("string")
    n = F.col("l_linenumber") % 4
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, F.concat(F.lit("$"), money)).when(n == 1, F.concat(F.lit(" "), F.replace(amount, F.lit("."), F.lit(",")), F.lit(" "))).when(n == 2, "n/a").otherwise(F.concat("l_returnflag", F.lit("1"))).alias("said"))


@query("parse_numeric", f"WITH t AS (SELECT l_orderkey, l_linenumber, {_STRANGE} AS said FROM lineitem) SELECT l_orderkey, l_linenumber, TRY_CAST(replace(replace(trim(said), '$', ''), ',', '.') AS DOUBLE) AS value, trim(said) <> 'n/a' AND TRY_CAST(replace(replace(trim(said), '$', ''), ',', '.') AS DOUBLE) IS NULL AS invalid FROM t")
def _parse_numeric(s: SparkSession, d: str) -> DataFrame:
    v = parsing.parse_numeric(F.col("said"))
    return _strange(s, d).select("l_orderkey", "l_linenumber", v.alias("value"), (parsing.clean(F.col("said")).isNotNull() & v.isNull()).alias("invalid"))


@query("parse_boolean", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM orders")
def _parse_boolean(s: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["ДА", " no ", "1.0", "maybe", "-"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", parsing.parse_boolean(said).alias("flag"))


@query("parse_datetime", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN date_trunc('day', o_orderdate) END AS day FROM orders")
def _parse_datetime(s: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 3 == 2, "31.02.1995").otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return table(s, d, "orders").select("o_orderkey", parsing.parse_datetime(said, "d.M.yyyy").alias("day"))


@query("detect_kinds", "SELECT * FROM (VALUES ('date', 'datetime'), ('flag', 'boolean'), ('key', 'numeric'), ('priority', 'categorical'), ('said', 'text')) v(column_name, kind)")
def _detect_kinds(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "orders").select((F.col("o_orderkey").cast("long")).alias("_row"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "да").otherwise("нет").alias("flag"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("priority"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("said"))
    found = parsing.detect(raw)
    return s.createDataFrame([(c, k.value) for c, (k, _) in found.items()], "column_name string, kind string")


# --- profiles and quality


@query("profile_columns", """
    SELECT 'o_totalprice' AS "column", count(*) AS rows, count(*) - count(o_totalprice) AS missing, count(DISTINCT o_totalprice) AS "distinct", min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, CAST(NULL AS VARCHAR) AS "first" FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL, NULL, NULL FROM orders
    UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate), count(DISTINCT o_orderdate), NULL, NULL, NULL, NULL, NULL, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders""")
def _profile(s: SparkSession, d: str) -> DataFrame:
    found = profile.column_stats(table(s, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderdate"))
    return found.select("column", "rows", "missing", "distinct", "low", "high", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std")), "first")


@query("profile_top_values", "SELECT 'c_mktsegment' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) AS INTEGER) AS rank, c_mktsegment AS value, count(*) AS count FROM customer GROUP BY c_mktsegment QUALIFY rank <= 12")
def _top_values(s: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(s, d, "customer"), ["c_mktsegment"], "c_custkey")


@query("profile_samples", "SELECT 'c_name' AS \"column\", CAST(row_number() OVER (ORDER BY min(c_custkey)) AS INTEGER) AS rank, c_name AS value FROM customer GROUP BY c_name QUALIFY rank <= 5")
def _samples(s: SparkSession, d: str) -> DataFrame:
    return profile.sample_values(table(s, d, "customer"), ["c_name"], "c_custkey")


@query("profile_duplicates", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents")
def _duplicates(s: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows(table(s, d, "documents").select("text", "lang"))


@query("quality_issues", """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, 'x' AS fixed, CAST(NULL AS VARCHAR) AS nothing FROM orders), n AS (SELECT count(*) AS n, count(*) - count(price) AS miss FROM t)
    SELECT 'missing_values' AS issue, 'price' AS "column", CASE WHEN miss * 100.0 / n >= 50 THEN 'error' WHEN miss * 100.0 / n >= 5 THEN 'warning' ELSE 'info' END AS severity, miss AS count FROM n WHERE miss > 0
    UNION ALL SELECT 'constant_column', 'fixed', 'info', 1 UNION ALL SELECT 'empty_column', 'nothing', 'error', n FROM n""")
def _quality(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.lit("x").alias("fixed"), F.lit(None).cast("string").alias("nothing"))
    return profile.quality_issues(profile.column_stats(t), profile.duplicate_rows(t))


# --- personal data

_PII_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'email' WHEN c_custkey % 4 = 1 THEN 'phone' WHEN c_custkey % 4 = 2 THEN 'card' ELSE 'none' END AS kind FROM customer"


@query("pii_values", _PII_SQL)
def _pii(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("user."), k, F.lit("@mail.example.org"))).when(k % 4 == 1, F.concat(F.lit("+7 (701) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 4 == 2, "4111 1111 1111 1111").otherwise(F.concat(F.lit("order "), k))
    kind = F.when(pii.is_email(value), "email").when(pii.is_card(value), "card").when(pii.is_phone(value), "phone").otherwise("none")
    return table(s, d, "customer").select("c_custkey", kind.alias("kind"))


@query("pii_redaction", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[hidden]' ELSE c_name END AS shown FROM customer")
def _redact(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", pii.mask(F.when(F.col("c_custkey") % 2 == 0, F.lit("a@b.org")).otherwise(F.col("c_name"))).alias("shown"))


# --- formats


@query("format_metric_values", "SELECT o_orderkey, replace(replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' '), '.', ',') AS shown FROM orders")
def _format(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", formatting.format_metric(F.floor("o_totalprice"), "").alias("shown"))


@query("format_group_keys", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day FROM orders")
def _format_keys(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", key_text(F.date_trunc("month", "o_orderdate"), True).alias("month"), key_text(F.date_trunc("day", "o_orderdate")).alias("day"))


# --- facts and charts

_SERIES = f"(SELECT strftime(month, '%Y-%m-%d %H:%M:%S') AS t, {EXACT.format('o_totalprice')} AS value FROM {ORDERS} GROUP BY month)"


@query("facts_time", f"""
    WITH p AS {_SERIES}, s AS (SELECT *, value - lag(value) OVER (ORDER BY t) AS step, lag(t) OVER (ORDER BY t) || ' → ' || t AS pair FROM p), n AS (SELECT count(*) AS n FROM p),
    f AS (SELECT * FROM p ORDER BY t LIMIT 1), l AS (SELECT * FROM p ORDER BY t DESC LIMIT 1)
    SELECT 'first' AS fact, value, t AS "of" FROM f UNION ALL SELECT 'last', value, t FROM l
    UNION ALL (SELECT 'min', value, t FROM p ORDER BY value, t LIMIT 1) UNION ALL (SELECT 'max', value, t FROM p ORDER BY value DESC, t LIMIT 1)
    UNION ALL SELECT 'change', l.value - f.value, f.t || ' → ' || l.t FROM f, l UNION ALL SELECT 'change_pct', (l.value - f.value) / f.value * 100, f.t || ' → ' || l.t FROM f, l
    UNION ALL (SELECT 'drop', step, pair FROM s WHERE step < 0 ORDER BY step, t LIMIT 1) UNION ALL (SELECT 'rise', step, pair FROM s WHERE step > 0 ORDER BY step DESC, t LIMIT 1)
    UNION ALL SELECT 'periods', CAST(n AS DOUBLE), NULL FROM n UNION ALL SELECT 'overall', {EXACT.format('o_totalprice')}, NULL FROM orders""")
def _facts_time(s: SparkSession, d: str) -> DataFrame:
    q = MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["month"])
    return facts.time_facts(q.grouped().withColumnRenamed("month", "t"), total=q.overall())


@query("facts_notable", f"""
    WITH p AS {_SERIES}, s AS (SELECT *, value - lag(value) OVER (ORDER BY t) AS step, lag(t) OVER (ORDER BY t) || ' → ' || t AS pair FROM p), top AS (SELECT max(value) AS top FROM p),
    f AS (SELECT * FROM p ORDER BY t LIMIT 1), l AS (SELECT * FROM p ORDER BY t DESC LIMIT 1),
    every AS (SELECT 'change' AS fact, l.value - f.value AS value, f.t || ' → ' || l.t AS "of" FROM f, l
    UNION ALL (SELECT 'drop', step, pair FROM s WHERE step < 0 ORDER BY step, t LIMIT 1) UNION ALL (SELECT 'rise', step, pair FROM s WHERE step > 0 ORDER BY step DESC, t LIMIT 1))
    SELECT fact, value, "of" FROM every, top WHERE value <> 0 AND abs(value) >= 0.1 * abs(top)""")
def _facts_notable(s: SparkSession, d: str) -> DataFrame:
    return facts.notable(facts.time_facts(MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["month"]).grouped().withColumnRenamed("month", "t")))


@query("facts_category", f"""
    WITH g AS (SELECT o_orderpriority AS key, {EXACT.format('o_totalprice')} AS value FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS i FROM g), t AS (SELECT {EXACT.format('o_totalprice')} AS total FROM orders)
    SELECT 'cat' || i || '_value' AS fact, value, key AS "of" FROM r WHERE i <= 12 UNION ALL SELECT 'cat' || i || '_share', value / total * 100, key FROM r, t WHERE i <= 12 UNION ALL SELECT 'categories', CAST(count(*) AS DOUBLE), NULL FROM g UNION ALL SELECT 'overall', total, NULL FROM t""")
def _facts_category(s: SparkSession, d: str) -> DataFrame:
    q = MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["o_orderpriority"])
    return facts.category_facts(q.grouped().withColumnRenamed("o_orderpriority", "key"), q.overall())


@query("facts_series", f"""
    WITH p AS (SELECT strftime(month, '%Y-%m-%d %H:%M:%S') AS t, o_orderstatus AS series, {EXACT.format('o_totalprice')} AS value FROM {ORDERS} GROUP BY 1, 2),
    e AS (SELECT series, min(t) AS t0, arg_min(value, t) AS first, arg_max(value, t) AS last, count(*) AS n FROM p GROUP BY series), i AS (SELECT *, row_number() OVER (ORDER BY t0, series) AS i FROM e)
    SELECT 's' || i || '_first' AS fact, first AS value, series AS "of" FROM i WHERE n > 1 UNION ALL SELECT 's' || i || '_last', last, series FROM i WHERE n > 1 UNION ALL SELECT 's' || i || '_change', last - first, series FROM i WHERE n > 1
    UNION ALL SELECT 's' || i || '_change_pct', (last - first) / first * 100, series FROM i WHERE n > 1 AND first <> 0
    UNION ALL (SELECT 'growth_leader', (last - first) / first * 100, series FROM i WHERE n > 1 AND first <> 0 ORDER BY 2 DESC, series DESC LIMIT 1) UNION ALL SELECT 'series_count', CAST(count(*) AS DOUBLE), NULL FROM i""")
def _facts_series(s: SparkSession, d: str) -> DataFrame:
    q = MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["month", "o_orderstatus"])
    return facts.series_facts(q.grouped().select(F.col("month").alias("t"), F.col("o_orderstatus").alias("series"), "value"))


@query("chart_points", f"SELECT CAST(o_orderpriority AS VARCHAR) AS x, o_orderstatus AS series, {EXACT.format('o_totalprice')} AS value, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS x_rank, CAST(dense_rank() OVER (ORDER BY o_orderstatus) AS INTEGER) AS s_rank FROM orders GROUP BY o_orderpriority, o_orderstatus")
def _chart_points(s: SparkSession, d: str) -> DataFrame:
    return charts.points(MetricQuery.build(_orders(s, d), "sum:o_totalprice", ["o_orderpriority", "o_orderstatus"]).grouped(), "o_orderpriority", "o_orderstatus")


@query("chart_frequency", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _frequency(s: SparkSession, d: str) -> DataFrame:
    return charts.frequency(table(s, d, "part"), "p_brand")


@query("chart_histogram", "WITH e AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT CAST(least(floor((p_size - a) / ((b - a) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS count FROM part, e GROUP BY 1")
def _histogram(s: SparkSession, d: str) -> DataFrame:
    return charts.histogram(table(s, d, "part"), "p_size").select("bin", "count")


# --- documents and vectors

_COS = "round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 4)"


def _first_vector(s: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(s, d, "embeddings").orderBy("vec_id").limit(1).first().embedding]


@query("vector_topk", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, vec_id LIMIT 10")
def _topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search(table(s, d, "embeddings"), _first_vector(s, d), 10, key="vec_id").select("vec_id", "score")


@query("vector_scoped_topk", f"SELECT e.vec_id, {_COS} AS score, {_COS} >= 0.2 AS relevant FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE e.label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def _scoped(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search(table(s, d, "embeddings"), _first_vector(s, d), 5, F.col("label") == 3, key="vec_id").select("vec_id", "score", "relevant")


@query("vector_search_many", """
    WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS scope, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query, e.scope, e.vec_id AS key, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 4) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND (q.vec_id % 40 = 0 OR q.scope = e.scope)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, scope ORDER BY score DESC, key) AS INTEGER) AS rank FROM s)
    SELECT query, scope, rank, key, score, score >= 0.2 AS relevant FROM r WHERE rank <= 3""")
def _search_many(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query: half of them in all scopes, half in that of their own label."""
    e = table(s, d, "embeddings")
    index = search_many.with_norms(e, "vec_id", scope=F.col("label"))
    asked = search_many.with_norms(e.where("vec_id % 20 = 0"), "vec_id", scope=F.when(F.col("vec_id") % 40 != 0, F.col("label")))
    return search_many.search_many(index, asked)


@query("column_resolution", """
    WITH c AS (SELECT n_name AS column_name, (lower(r_name) = 'asia') AS exact, round(CASE WHEN lower(r_name) = 'asia' THEN least(1.0, n_nationkey / 100.0 + 0.15) ELSE n_nationkey / 100.0 END, 4) AS score FROM nation JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT *, exact OR score >= 0.2 AS relevant FROM c), b AS (SELECT *, max(score) FILTER (relevant) OVER () AS best FROM m), k AS (SELECT *, relevant AND best - score < 0.06 AS close FROM b)
    SELECT column_name, CAST(score AS DOUBLE) AS score, exact, relevant, CASE WHEN best IS NULL THEN 'not_found' WHEN count(*) FILTER (close) OVER () > 1 THEN 'ambiguous' ELSE 'confident' END AS status FROM k
    WHERE close OR best IS NULL ORDER BY score DESC, column_name LIMIT 3""")
def _resolution(s: SparkSession, d: str) -> DataFrame:
    """Nations as columns that their region is another name of."""
    regions = table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    columns = table(s, d, "nation").join(regions, "n_regionkey").select(F.col("n_name").alias("column_name"), F.array("r_name").alias("aliases"), (F.col("n_nationkey") / 100.0).alias("score"))
    return retrieval.resolve(columns, " Asia!")


@query("content_ids", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def _content_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.content_id(F.col("text")).alias("content_id"))


@query("sentence_counts", r"SELECT doc_id, CAST(len([x FOR x IN string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) IF x <> '']) AS BIGINT) AS sentences FROM documents")
def _sentence_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("chunk_documents")
def _chunks(s: SparkSession, d: str) -> DataFrame:
    return text.chunk_texts(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))


@query("html_chunks")
def _html_chunks(s: SparkSession, d: str) -> DataFrame:
    return text.chunk_texts(table(s, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), text.html_text(F.col("html")).alias("text")))


@query("hash_embedding_search")
def _hash_search(s: SparkSession, d: str) -> DataFrame:
    embedded = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), text.embed(F.col("text")).alias("embedding"))
    return retrieval.search(embedded, text.hash_vector("the main question and its answer"), 10).select("chunk_id", "score", "relevant")


@query("evidence_quotes", "SELECT CAST(b.item_id AS VARCHAR) AS evidence_id, CAST(b.item_id AS VARCHAR) AS chunk_id, b.item_id % 2 = 0 AS verified FROM benchmark b")
def _quotes(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text", "item_id")
    quote = F.when(F.col("item_id") % 2 == 0, F.substring("text", 3, 20)).otherwise(F.concat(F.substring("text", 1, 20), F.lit(" #")))
    return retrieval.quotes_found(b.select(F.col("chunk_id").alias("evidence_id"), "chunk_id", quote.alias("quote")), b)


@query("hit_at_k", "SELECT l_orderkey AS case_id, bool_or(l_linenumber <= 3 AND l_suppkey % 5 = l_orderkey % 5) AS hit FROM lineitem GROUP BY 1")
def _hits(s: SparkSession, d: str) -> DataFrame:
    return retrieval.hit_at(table(s, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 5).alias("found"), (F.col("l_orderkey") % 5).alias("expected")))


@query("document_rollup", """
    WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag AS VARCHAR) AS section, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS first, l_shipdate FROM lineitem),
    f AS (SELECT DISTINCT l_orderkey, first, section FROM c)
    SELECT CAST(l_orderkey AS VARCHAR) AS document_id, count(*) AS chunks, CAST(max(l_linenumber) AS INTEGER) AS pages, (SELECT string_agg(section, '|' ORDER BY first, section) FROM f WHERE f.l_orderkey = c.l_orderkey) AS sections, max(l_shipdate) AS indexed_at
    FROM c GROUP BY l_orderkey""")
def _rollup(s: SparkSession, d: str) -> DataFrame:
    """Orders as documents, their lines as chunks in sections by return flag."""
    chunks = table(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit("f").alias("filename"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.col("l_linenumber").cast("int").alias("page_end"),
        F.col("l_returnflag").alias("section"), F.col("l_shipdate").alias("indexed_at"),
    )
    return retrieval.rollup_documents(chunks).select("document_id", "chunks", "pages", F.array_join("sections", "|").alias("sections"), "indexed_at")


# --- text checks and questions


@query("verify_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 2 AS VARCHAR) END AS ungrounded FROM orders")
def _verify_numbers(s: SparkSession, d: str) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    said = F.concat(F.lit("The total was "), (whole + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(2)).cast("string"), F.lit("."))
    return table(s, d, "orders").select("o_orderkey", F.array_join(verify.ungrounded(said, F.array(whole.cast("double"))), ",").alias("ungrounded"))


@query("verify_causal", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS claims FROM orders")
def _verify_causal(s: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["Снижение вызвано обновлением. Всё.", "Причина не установлена, рост возможен.", "Выручка снизилась. Данных нет."])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", F.size(verify.causal(said)).alias("claims"))


@query("verify_trend", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'trend-direction-mismatch' WHEN 1 THEN 'trend-needs-comparison' END AS rule FROM orders")
def _verify_trend(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    said = F.when(k == 3, "Итог 5.").otherwise("Отмечен рост выручки.")
    return table(s, d, "orders").select("o_orderkey", verify.trend_violation(said, F.when(k == 0, -1.0).when(k == 2, 1.0)).alias("rule"))


@query("masked_phrases", """
    SELECT doc_id, CAST(len(regexp_extract_all(text, p)) AS BIGINT) AS found, sha256(regexp_replace(text, p, ' ', 'g')) AS masked_sha256
    FROM documents, (SELECT string_agg(phrase, '|' ORDER BY length(phrase) DESC, phrase) AS p FROM (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) AS phrase FROM benchmark WHERE text IS NOT NULL) WHERE phrase <> '')""")
def _masked_phrases(s: SparkSession, d: str) -> DataFrame:
    """The documents without the first two words that stand together in each benchmark text."""
    listed = table(s, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0).alias("phrase"))
    found = phrases.mask_phrases(table(s, d, "documents"), listed, "doc_id")
    return found.select("doc_id", F.when(F.col("masked").isNotNull(), F.col("found")).alias("found"), F.sha2("masked", 256).alias("masked_sha256"))


@query("question_intents", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'cause_question' WHEN 1 THEN 'top_category' WHEN 2 THEN 'metric_definition' WHEN 3 THEN 'metric_change' WHEN 4 THEN 'unsupported' ELSE 'unsupported' END AS intent, CASE o_orderkey % 6 WHEN 2 THEN 'success_rate' WHEN 3 THEN 'transaction_volume' WHEN 4 THEN 'transaction_volume' END AS metric FROM orders")
def _intents(s: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ["Почему упала выручка?", "Какой канал лидирует?", "Что такое Success Rate?", "Как изменился объём?", "Как изменился  ОБОРОТ в марте?", "Привет!"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", questions.intent(asked).alias("intent"), questions.metric_of(asked).alias("metric"))


@query("metadata_records", "SELECT 'dataset' AS entry_type, CAST(NULL AS VARCHAR) AS column_name UNION ALL SELECT 'column', column_name FROM (DESCRIBE orders)")
def _metadata_records(s: SparkSession, d: str) -> DataFrame:
    return records.dataset_records(s, summarise(table(s, d, "orders")), "o", "orders").select("entry_type", "column_name")


@query("metadata_search")
def _metadata_search(s: SparkSession, d: str) -> DataFrame:
    """The column that the orders' records offer for the price."""
    found = records.search_metadata(records.dataset_records(s, summarise(table(s, d, "orders")), "o", "orders"), "totalprice цена стоимость", 1, "o", "column")
    return found.groupBy("column_name").agg(F.count("*").cast("int").alias("hits"))


# --- evaluation: orders as cases, lines as repeats of two arms


def _observations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 1, "A").otherwise("B").alias("arm"), F.ceil(F.col("l_linenumber") / 2).cast("int").alias("repeat"), F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("group"),
        (F.col("l_quantity") > 20).alias("ok"), F.col("l_quantity").alias("latency"), F.col("l_linestatus").alias("signature"),
    )


OBSERVATIONS = "(SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'B' END AS arm, CAST(ceil(l_linenumber / 2.0) AS INTEGER) AS repeat, l_orderkey AS case_id, l_returnflag AS \"group\", l_quantity > 20 AS ok, l_quantity AS latency, l_linestatus AS signature FROM lineitem)"


@query("eval_compare_arms", f"""
    WITH m AS (SELECT arm, case_id, avg(latency) AS m FROM {OBSERVATIONS} GROUP BY 1, 2), p AS (SELECT a.case_id, a.m AS a, b.m AS b FROM m a JOIN m b ON a.case_id = b.case_id AND a.arm = 'A' AND b.arm = 'B')
    SELECT count(*) AS cases, (SELECT round(avg(m), 4) FROM m WHERE arm = 'A') AS mean_a, (SELECT round(avg(m), 4) FROM m WHERE arm = 'B') AS mean_b, round(avg(b - a), 4) AS difference FROM p""")
def _compare_arms(s: SparkSession, d: str) -> DataFrame:
    return evalstats.compare_arms(_observations(s, d), "A", "B", "latency", False).select("cases", "mean_a", "mean_b", "difference")


@query("eval_ratio", f'SELECT "group", CAST(grouping("group") AS INTEGER) AS is_total, count(*) FILTER (ok) AS hits, count(ok) AS total, round(count(*) FILTER (ok) / CAST(count(ok) AS DOUBLE), 4) AS rate FROM {OBSERVATIONS} GROUP BY GROUPING SETS (("group"), ())')
def _eval_ratio(s: SparkSession, d: str) -> DataFrame:
    return evalstats.by_group_and_overall(_observations(s, d), "group", *evalstats.ratio(F.col("ok")))


@query("eval_latency", f"SELECT arm, round(avg(latency), 1) AS mean, round(quantile_cont(latency, 0.5), 1) AS median, round(quantile_cont(latency, 0.95), 1) AS p95, round(max(latency), 1) AS max FROM {OBSERVATIONS} GROUP BY arm")
def _eval_latency(s: SparkSession, d: str) -> DataFrame:
    return _observations(s, d).groupBy("arm").agg(*evalstats.latency(F.col("latency")))


@query("eval_paired", f"WITH p AS (SELECT case_id, repeat, bool_or(ok) FILTER (arm = 'A') AS a, bool_or(ok) FILTER (arm = 'B') AS b FROM {OBSERVATIONS} GROUP BY 1, 2) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def _eval_paired(s: SparkSession, d: str) -> DataFrame:
    return evalstats.paired(_observations(s, d), "A", "B", "ok").drop("p_value")


@query("eval_sign_test", """
    WITH o AS (SELECT l_suppkey AS case_id, count(*) FILTER (l_returnflag = 'A') AS only_a, count(*) FILTER (l_returnflag = 'R') AS only_b FROM lineitem GROUP BY 1)
    SELECT case_id, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, least(only_a, only_b) + 1) t(i))) END, 7) AS p FROM o""")
def _eval_sign(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's returned and accepted lines as discordant pairs."""
    count = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    pairs = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg(count("A").alias("only_a"), count("R").alias("only_b"))
    return pairs.withColumn("p", F.round(evalstats.sign_test(F.col("only_a"), F.col("only_b")), 7))


@query("eval_agreement", f"WITH c AS (SELECT case_id, signature, count(*) AS n FROM {OBSERVATIONS} GROUP BY 1, 2) SELECT case_id, max(n) / CAST(sum(n) AS DOUBLE) AS agreement, count(*) AS structures FROM c GROUP BY 1")
def _eval_agreement(s: SparkSession, d: str) -> DataFrame:
    return evalstats.agreement(_observations(s, d))


@query("eval_bootstrap")
def _eval_bootstrap(s: SparkSession, d: str) -> DataFrame:
    diffs = evalstats.case_differences(_observations(s, d), "A", "B", "latency")
    return evalstats.bootstrap(diffs).withColumn("verdict", evalstats.verdict(F.col("mean"), F.col("low"), F.col("high"), False))


@query("eval_case_differences", f"SELECT case_id, round(avg(latency) FILTER (arm = 'B') - avg(latency) FILTER (arm = 'A'), 6) AS diff FROM {OBSERVATIONS} GROUP BY 1 HAVING diff IS NOT NULL")
def _eval_diffs(s: SparkSession, d: str) -> DataFrame:
    return evalstats.case_differences(_observations(s, d), "A", "B", "latency").withColumn("diff", F.round("diff", 6))


@query("eval_numeric_score", "SELECT true AS same_groups, false AS all_close, 0.5::DOUBLE AS max_abs_error")
def _eval_numeric(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return evalstats.numeric_score(g, g.withColumn("value", F.when(F.col("key") == "5-LOW", F.col("value") + 0.5).otherwise(F.col("value"))))


@query("eval_signature", """
    SELECT signature, count(*) AS plans FROM (
        SELECT '{"metric":"sum:' || l_returnflag || '","columns":["' || array_to_string(list_sort([l_linestatus, l_returnflag, 'q' || CAST(l_linenumber AS VARCHAR)]), '","') || '"],"group_by":["' || l_linestatus || '","' || l_returnflag
            || '"],"filters":["' || array_to_string(list_sort([strftime(l_shipdate, '%Y'), CAST(CAST(l_quantity AS BIGINT) % 4 AS VARCHAR)]), '","') || '"]}' AS signature FROM lineitem) GROUP BY 1""")
def _eval_signature(s: SparkSession, d: str) -> DataFrame:
    """Lines as plans, whose columns and filters come in any order."""
    text_ = lambda c: F.col(c).cast("string")
    columns = F.array(F.concat(F.lit("q"), text_("l_linenumber")), "l_linestatus", "l_returnflag")
    filters = F.array((F.col("l_quantity").cast("long") % 4).cast("string"), F.date_format("l_shipdate", "yyyy"))
    plans = table(s, d, "lineitem").select(evalstats.signature(F.concat(F.lit("sum:"), "l_returnflag"), columns, F.array("l_linestatus", "l_returnflag"), filters).alias("signature"))
    return plans.groupBy("signature").agg(F.count("*").alias("plans"))


@query("usage_between_resets", """
    WITH e AS (SELECT *, event_type = 'error' AS is_error, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM events)
    SELECT user_id, segment, count(*) FILTER (NOT is_error) AS calls, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (NOT is_error), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(length(props)) FILTER (NOT is_error), 0) AS BIGINT) AS output_tokens,
           CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (NOT is_error), 0) + coalesce(sum(length(props)) FILTER (NOT is_error), 0) AS BIGINT) AS total_tokens, bool_or(is_error) AS is_reset
    FROM e GROUP BY user_id, segment""")
def _usage(s: SparkSession, d: str) -> DataFrame:
    """Events as model calls of users, whose counters an error resets."""
    return usage.spent(table(s, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", F.floor("value"), F.length("props"))


# --- context, arms, redaction


@query("context_definition", "SELECT CAST(item_id AS VARCHAR) AS chunk_id, substr(text, 1, 500) AS quote FROM benchmark WHERE item_id % 2 = 0 AND contains(lower(text), 'de') ORDER BY item_id LIMIT 1")
def _definition(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "benchmark").select(F.col("item_id").alias("rank"), F.col("item_id").cast("string").alias("chunk_id"), "text", (F.col("item_id") % 2 == 0).alias("relevant"))
    return context.definition(hits, ["DE"])


@query("context_events", "SELECT CAST(item_id AS VARCHAR) AS chunk_id FROM benchmark WHERE item_id > 3 ORDER BY item_id LIMIT 2")
def _events(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "benchmark").select(F.col("item_id").alias("rank"), F.col("item_id").cast("string").alias("chunk_id"), F.lit(True).alias("relevant"))
    return context.event_context(hits, hits.where("rank <= 3")).select("chunk_id")


@query("context_event_sentences", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sentences FROM orders")
def _event_sentences(s: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 2 == 0, "В марте прошло обновление. Всё тихо.").otherwise("Было обновление. Март.")
    return table(s, d, "orders").select("o_orderkey", F.size(context.event_sentences(said)).alias("sentences"))


@query("context_citations", "SELECT source AS citation, string_agg(DISTINCT lang, ',' ORDER BY lang) AS titles FROM documents GROUP BY source")
def _citations(s: SparkSession, d: str) -> DataFrame:
    found = context.citations(table(s, d, "documents").select(F.col("lang").alias("title"), F.array("source").alias("citations")))
    return found.select("citation", F.array_join("titles", ",").alias("titles"))


@query("index_stats", "SELECT count(DISTINCT lang) AS documents, count(*) AS chunks, count(DISTINCT source) AS datasets FROM documents WHERE lang <> 'de'")
def _index_stats(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "documents").select(F.col("lang").alias("document_id"), F.col("source").alias("dataset_id"))
    return context.index_stats(context.without(chunks, document_id="de"))


@query("evidence_kinds", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'assumption' WHEN 2 THEN 'computed' ELSE 'assumption' END AS kind FROM benchmark")
def _evidence_kinds(s: SparkSession, d: str) -> DataFrame:
    b, k = table(s, d, "benchmark"), F.col("item_id") % 4
    items = b.select("item_id", F.when(k < 2, "document").otherwise("computed").alias("kind"), F.col("item_id").alias("chunk_id"), F.when(k == 0, F.substring("text", 2, 15)).otherwise("#").alias("quote"), F.when(k == 2, "sum").otherwise("").alias("method"))
    return context.evidence_kinds(items, b.select(F.col("item_id").alias("chunk_id"), "text"))


ARMS = f"(SELECT *, ok AS plan_ok, latency * 2 AS tokens FROM {OBSERVATIONS})"


@query("eval_arms", f"WITH c AS (SELECT arm, case_id, signature, count(*) AS n, count(*) FILTER (plan_ok) AS ok, sum(tokens) AS tokens, sum(latency) AS latency FROM {ARMS} GROUP BY 1, 2, 3), k AS (SELECT arm, case_id, sum(n) AS n, sum(ok) AS ok, sum(tokens) AS tokens, sum(latency) AS latency, max(n) AS most, count(*) AS kinds FROM c GROUP BY 1, 2) SELECT arm, count(*) AS cases, CAST(sum(ok) AS BIGINT) AS plan_ok, CAST(sum(n) AS BIGINT) AS total, round(CAST(sum(ok) AS DOUBLE) / sum(n), 4) AS rate, round(sum(tokens) / sum(n), 1) AS tokens, round(sum(latency) / sum(n), 1) AS latency, count(*) FILTER (kinds = 1) AS stable_cases, round(avg(most / CAST(n AS DOUBLE)), 4) AS agreement FROM k GROUP BY arm")
def _arms(s: SparkSession, d: str) -> DataFrame:
    return evalstats.arm_summary(_observations(s, d).withColumns({"plan_ok": F.col("ok"), "tokens": F.col("latency") * 2}))


@query("eval_plan_score", "SELECT o_orderkey AS case_id, true AS metric_ok, true AS columns_ok, o_orderkey % 2 = 0 AS grouping_ok, o_orderkey % 3 <> 0 AS filters_ok, false AS chart_ok, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS plan_ok FROM orders")
def _plan_score(s: SparkSession, d: str) -> DataFrame:
    k, words = F.col("o_orderkey"), lambda *x: F.array(*map(F.lit, x))
    plan = lambda columns, group, filters, chart: F.struct(F.lit("m").alias("metric"), columns.alias("columns"), group.alias("group_by"), filters.alias("filters"), chart.alias("chart"))
    e = plan(words("a", "b"), words("t", "c"), words("x"), F.lit("bar"))
    p = plan(words("b", "a", "a"), F.when(k % 2 == 0, words("t", "c")).otherwise(words("c", "t")), F.when(k % 3 == 0, words("y")).otherwise(words("x")), F.lit(None).cast("string"))
    return evalstats.plan_score(table(s, d, "orders").select(k.alias("case_id"), e.alias("e"), p.alias("p")))


@query("redacted_samples", "WITH v AS (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY min(c_custkey)) AS rank FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS \"column\", string_agg(value, ',' ORDER BY rank) AS \"values\" FROM v WHERE rank <= 3 UNION ALL SELECT 'c_name', '[hidden]'")
def _redacted(s: SparkSession, d: str) -> DataFrame:
    found = profile.sample_values(table(s, d, "customer"), ["c_mktsegment", "c_name"], "c_custkey")
    return redact.redacted_samples(found, {"c_mktsegment": Kind.CATEGORICAL, "c_name": Kind.TEXT}, ["c_name"]).select("column", F.array_join("values", ",").alias("values"))


@query("eval_arm_groups", f'SELECT arm, "group", CAST(grouping("group") AS INTEGER) AS is_total, count(*) FILTER (plan_ok) AS hits, count(plan_ok) AS total, round(count(*) FILTER (plan_ok) / CAST(count(plan_ok) AS DOUBLE), 4) AS rate, round(avg(tokens), 1) AS tokens, round(avg(latency), 1) AS latency FROM {ARMS} GROUP BY GROUPING SETS ((arm, "group"), (arm))')
def _arm_groups(s: SparkSession, d: str) -> DataFrame:
    return evalstats.arm_groups(_observations(s, d).withColumns({"plan_ok": F.col("ok"), "tokens": F.col("latency") * 2}))


@query("eval_case_rates", f"SELECT case_id, count(*) FILTER (coalesce(CASE WHEN repeat > 1 THEN ok END, latency > 30)) AS hits, count(*) AS total FROM {OBSERVATIONS} WHERE arm = 'A' AND \"group\" = 'R' GROUP BY case_id")
def _case_rates(s: SparkSession, d: str) -> DataFrame:
    return evalstats.case_rates(_observations(s, d).withColumns({"plan_ok": F.when(F.col("repeat") > 1, F.col("ok")), "behavior_ok": F.col("latency") > 30}), "A", "R")


@query("eval_history", f"SELECT signature AS run, count(*) FILTER (ok) AS hits, count(ok) AS total, round(count(*) FILTER (ok) / CAST(count(ok) AS DOUBLE), 4) AS rate FROM {OBSERVATIONS} GROUP BY 1")
def _history(s: SparkSession, d: str) -> DataFrame:
    return evalstats.history(_observations(s, d).select(F.col("signature").alias("run"), F.col("ok").alias("plan_ok")))


@query("settled_texts", """
    WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag || l_linestatus AS t, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) > 20 AS bad FROM lineitem WHERE l_linenumber <= 2),
    a AS (SELECT k, n, t FROM l WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY k ORDER BY n, t) = 1)
    SELECT o_orderkey AS insight_id, coalesce(t, o_orderpriority) AS text, n AS attempt FROM orders LEFT JOIN a ON k = o_orderkey""")
def _settled(s: SparkSession, d: str) -> DataFrame:
    """Lines as attempts at an order's text, great quantities as violations."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("insight_id"), F.col("l_linenumber").alias("attempt"), F.concat("l_returnflag", "l_linestatus").alias("text"), "l_quantity").where("attempt <= 2")
    rules = table(s, d, "orders").select(F.col("o_orderkey").alias("insight_id"), F.col("o_orderpriority").alias("text"))
    return verify.settle(lines.drop("l_quantity"), lines.where("l_quantity > 20"), rules)


@query("assembled_drafts", """
    WITH p AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS n FROM lineitem),
    c AS (SELECT k, f, min(n) AS n FROM p GROUP BY 1, 2)
    SELECT k AS insight_id, coalesce(string_agg(f, ',' ORDER BY n) FILTER (f <> 'N'), '') AS evidence, CASE WHEN count(*) FILTER (f = 'N') > 0 THEN 'unknown-evidence' ELSE '' END AS issues FROM c GROUP BY k""")
def _assembled(s: SparkSession, d: str) -> DataFrame:
    """Orders as drafts that cite the flags of their lines; the flag N is no fact."""
    cited = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("insight_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x.l_returnflag).alias("evidence"))
    none = F.lit(None).cast("string")
    drafts = cited.select("insight_id", F.lit("t").alias("title"), F.lit("t").alias("text"), "evidence", none.alias("chunk_id"), none.alias("quote"))
    facts = s.createDataFrame([("A",), ("R",)], "fact string")
    chunks = s.createDataFrame([], "chunk_id string, text string")
    return verify.assemble(drafts, facts, chunks).select("insight_id", F.array_join("evidence", ",").alias("evidence"), F.array_join("issues", ",").alias("issues"))


@query("context_query_hits", "SELECT item_id AS rank, CAST(item_id AS VARCHAR) AS chunk_id, substr(text, 1, 500) AS quote, CAST(item_id AS DOUBLE) AS score FROM benchmark WHERE item_id % 2 = 0")
def _query_hits(s: SparkSession, d: str) -> DataFrame:
    return context.query_hits(table(s, d, "benchmark").select(F.col("item_id").alias("rank"), F.col("item_id").cast("string").alias("chunk_id"), "text", F.col("item_id").cast("double").alias("score"), (F.col("item_id") % 2 == 0).alias("relevant")))


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _head(s: SparkSession, d: str) -> DataFrame:
    return profile.head(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


@query("month_totals", f"SELECT strftime(l_shipdate, '%Y-%m') AS month, {EXACT.format('l_quantity')} AS l_quantity, {EXACT.format('l_extendedprice')} AS l_extendedprice FROM lineitem GROUP BY 1")
def _month_totals(s: SparkSession, d: str) -> DataFrame:
    return month_totals(table(s, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"])


@query("quality_personal_data", "SELECT 'possible_personal_data' AS issue, 'c_name' AS \"column\", 'info' AS severity, count(c_name) AS count FROM customer")
def _personal(s: SparkSession, d: str) -> DataFrame:
    stats = profile.column_stats(table(s, d, "customer"))
    return profile.quality_issues(stats, personal=["c_name"]).where("issue = 'possible_personal_data'")


@query("index_upkeep", """
    SELECT CAST(page_id AS VARCHAR) AS document_id, sha256(html) AS content_hash, CAST(ceil(length(html) / 1000.0) AS BIGINT) AS chunks
    FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN html || '<p>second version</p>' ELSE html END AS html FROM pages WHERE html IS NOT NULL) WHERE page_id % 10 <> 1""")
def _index_upkeep(s: SparkSession, d: str) -> DataFrame:
    """The pages are indexed, then a second version of them in which every tenth has changed; then every tenth is deleted."""
    pages = table(s, d, "pages").where("html is not null").select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("text"))
    every = F.col("document_id").cast("long") % 10
    cut = lambda docs: docs.select("document_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int"))).alias("chunk_index"), "text").withColumn("text", F.expr("substring(text, chunk_index * 1000 + 1, 1000)"))
    index = ChunkIndex(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}", cut)
    index.upsert(pages)
    index.upsert(pages.withColumn("text", F.when(every == 0, F.concat("text", F.lit("<p>second version</p>"))).otherwise(F.col("text"))))
    index.delete(pages.where(every == 1))
    return index.documents().select("document_id", "content_hash").join(index.chunks().groupBy("document_id").agg(F.count("*").alias("chunks")), "document_id")


# --- plans that share a scan, and questions


PLAN = [("sum:o_totalprice", ["month"], None), ("ratio:o_totalprice/o_custkey", ["o_orderpriority", "o_orderstatus"], {"o_orderstatus": ["O", "F", "X"]}), ("rate:open_price/o_totalprice", [], None), ("sum:o_custkey", ["o_orderpriority"], {"o_orderpriority": "1-URGENT"})]


@query("plan_together", f"""
    WITH o AS (SELECT * FROM {ORDERS}), f AS (SELECT * FROM o WHERE o_orderstatus IN ('O', 'F')), u AS (SELECT * FROM o WHERE o_orderpriority = '1-URGENT'),
    rows_ AS (
        SELECT 0 AS step, strftime(month, '%Y-%m-%d %H:%M:%S') AS key, {EXACT.format('o_totalprice')} AS value, count(*) AS rows_used FROM o GROUP BY month
        UNION ALL SELECT 1, o_orderpriority || '|' || o_orderstatus, {_ratio('o_totalprice', 'o_custkey')}, count(*) FROM f GROUP BY o_orderpriority, o_orderstatus
        UNION ALL SELECT 3, o_orderpriority, CAST(sum(o_custkey) AS DOUBLE), count(*) FROM u GROUP BY o_orderpriority)
    SELECT step, 0 AS is_total, key, value, rows_used FROM rows_
    UNION ALL SELECT 0, 1, NULL, {EXACT.format('o_totalprice')}, count(*) FROM o UNION ALL SELECT 1, 1, NULL, {_ratio('o_totalprice', 'o_custkey')}, count(*) FROM f
    UNION ALL SELECT 2, 1, NULL, {_ratio('open_price', 'o_totalprice', ' * 100')}, count(*) FROM o UNION ALL SELECT 3, 1, NULL, CAST(sum(o_custkey) AS DOUBLE), count(*) FROM u""")
def _plan_together(s: SparkSession, d: str) -> DataFrame:
    orders = _orders(s, d)
    return Shared([MetricQuery.build(orders, *step) for step in PLAN], 200).table().withColumn("key", F.array_join("key", "|"))


@query("sum_edges", """
    SELECT l_returnflag, l_linestatus, CASE WHEN isinf(s) THEN CASE WHEN s > 0 THEN 'inf' ELSE '-inf' END WHEN isnan(s) THEN 'nan' ELSE 'finite' END AS kind, CASE WHEN isfinite(s) THEN CAST(f AS DOUBLE) END AS value
    FROM (SELECT l_returnflag, l_linestatus, sum(v) AS s, sum(CAST(CASE WHEN isfinite(v) THEN v END AS DECIMAL(28,6))) AS f FROM (
        SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' AND l_orderkey % 97 = 1 THEN 'inf'::DOUBLE WHEN l_returnflag = 'R' AND l_orderkey % 97 = 2 THEN '-inf'::DOUBLE WHEN l_returnflag = 'R' AND l_orderkey % 97 = 3 THEN 'inf'::DOUBLE ELSE CAST(l_extendedprice AS DOUBLE) END AS v FROM lineitem) GROUP BY 1, 2)""")
def _sum_edges(s: SparkSession, d: str) -> DataFrame:
    """Prices of which some are infinite: sums of one sign stay infinite, of both are no number."""
    k, flag = F.col("l_orderkey") % 97, F.col("l_returnflag")
    v = F.when((flag == "A") & (k == 1) | (flag == "R") & (k == 3), F.lit(float("inf"))).when((flag == "R") & (k == 2), F.lit(float("-inf"))).otherwise(F.col("l_extendedprice").cast("double"))
    marked = table(s, d, "lineitem").withColumn("v", v)
    sums = marked.groupBy("l_returnflag", "l_linestatus").agg(exact_sum(F.col("v"), marked.schema["v"].dataType).alias("s"))
    kind = F.when(F.isnan("s"), "nan").when(F.col("s") == float("inf"), "inf").when(F.col("s") == float("-inf"), "-inf").otherwise("finite")
    return sums.select("l_returnflag", "l_linestatus", kind.alias("kind"), F.when(kind == "finite", F.col("s")).alias("value"))


@query("question_evidence", f"""
    WITH m AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS t, {EXACT.format('o_totalprice')} AS v FROM orders GROUP BY 1),
    p AS (SELECT o_orderpriority AS k, {EXACT.format('o_totalprice')} AS v, row_number() OVER (ORDER BY {EXACT.format('o_totalprice')} DESC) AS i FROM orders GROUP BY 1),
    steps AS (SELECT t, v, v - lag(v) OVER (ORDER BY t) AS step, lag(t) OVER (ORDER BY t) || ' → ' || t AS pair FROM m),
    ends AS (SELECT min(t) AS a, max(t) AS b, arg_min(v, t) AS va, arg_max(v, t) AS vb FROM m),
    facts(intent, fact, value, "of") AS (
        SELECT 'extreme_period', 'max', max(v), arg_max(t, v) FROM m UNION ALL SELECT 'extreme_period', 'min', min(v), arg_min(t, v) FROM m
        UNION ALL SELECT 'metric_change', 'first', va, a FROM ends UNION ALL SELECT 'metric_change', 'last', vb, b FROM ends
        UNION ALL SELECT 'metric_change', 'change', vb - va, a || ' → ' || b FROM ends UNION ALL SELECT 'metric_change', 'change_pct', (vb - va) / va * 100, a || ' → ' || b FROM ends
        UNION ALL SELECT 'metric_change', 'drop', min(step), arg_min(pair, step) FROM steps UNION ALL SELECT 'metric_change', 'rise', max(step), arg_max(pair, step) FROM steps
        UNION ALL SELECT 'top_category', 'cat' || i || '_value', v, k FROM p UNION ALL SELECT 'top_category', 'cat' || i || '_share', v / (SELECT {EXACT.format('o_totalprice')} FROM orders) * 100, k FROM p)
    SELECT c_custkey AS question_id, intent, 'sum:revenue' AS metric, fact, round(value, 4) AS value, "of" FROM customer JOIN facts ON intent = CASE c_custkey % 5 WHEN 0 THEN 'extreme_period' WHEN 1 THEN 'metric_change' WHEN 2 THEN 'top_category' END""")
def _question_evidence(s: SparkSession, d: str) -> DataFrame:
    """Each customer asks one of five questions, of which two need no numbers."""
    said = ["В каком месяце была максимальная выручка?", "Как изменилась выручка?", "Какой канал принёс больше всего выручки?", "Что такое выручка?", "Спасибо!"]
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("question_id"), F.element_at(F.array(*map(F.lit, said)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("question"))
    data = _orders(s, d).select("month", "o_orderpriority", F.col("o_totalprice").alias("revenue"))
    found = evidence(asked, Source(data, summarise(data), (Step("sum:revenue", ("month",)), Step("sum:revenue", ("o_orderpriority",)))))
    return found.withColumn("value", F.round("value", 4))


# --- an addition


@query("windowed_metric", f"SELECT date_trunc('day', ts) AS window_start, event_type, {EXACT.format('value')} AS value, count(*) AS rows_used FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def _windowed(s: SparkSession, d: str) -> DataFrame:
    return windowed_metric(table(s, d, "events"), "sum:value", "ts", group_by=["event_type"])
