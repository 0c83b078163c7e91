"""Personal data by column name and by value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import column_name
from ..operators.firsts import first_values

# fixed values: names of personal columns, shapes of e-mail addresses, phone and card numbers
NAME = re.compile(
    r"e-?mail|почт|phone|телефон|(?<![а-я])тел(?![а-я])|mobile|(?<![a-zа-я])iin(?![a-zа-я])|иин|инн|ssn|passport|паспорт|(?<![a-zа-я])fio(?![a-zа-я])|фио"
    r"|full_?name|first_?name|last_?name|middle_?name|surname|фамили|отчеств|address|адрес|(?<![a-z])card(?![a-z])|номер\s*карт|iban|birth|рожд"
    r"|(?<![a-zа-я])name(?![a-zа-я])|(?<![а-я])имя(?![а-я])",
    re.IGNORECASE,
)
EMAIL = r"(?U)^[\w.+-]+@[\w-]+(\.[\w-]+)+$"
PHONE = r"^\+?[\d\s\-()]{10,20}$"
CARD = r"^\d{4}([ -]?\d{4}){2,3}(\d{0,3})$"
RATIO = 0.6
SAMPLE = 200
HIDDEN = "[hidden]"


def is_email(c: Column) -> Column:
    return F.trim(c).rlike(EMAIL)


def is_phone(c: Column) -> Column:
    """10 to 12 digits, written as a phone number or eleven beginning with 7 or 8."""
    text, digits = F.trim(c), F.regexp_replace(c, r"\D", "")
    n = F.length(digits)
    written = text.startswith("+") | text.contains("(") | text.contains("-")
    return text.rlike(PHONE) & n.between(10, 12) & (written | ((n == 11) & F.substring(digits, 1, 1).isin("7", "8")))


def is_card(c: Column) -> Column:
    text, digits = F.trim(c), F.regexp_replace(c, r"\D", "")
    return text.rlike(CARD) & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_personal(c: Column) -> Column:
    return is_email(c) | is_card(c) | is_phone(c)


def mask(c: Column) -> Column:
    return F.when(is_personal(c), HIDDEN).otherwise(c)


def sensitive_columns(df: DataFrame, row: str) -> dict[str, str]:
    """The personal columns and why: by name, or 0.6 of their first 200 values look personal; null is no value. One pass for all columns."""
    found = {c: "name" for c in df.columns if c != row and NAME.search(c)}
    texts = [c for c, t in df.dtypes if t == "string" and c not in found and c != row]
    if texts:
        firsts = first_values(df, {c: F.col(column_name(c)) for c in texts}, row, SAMPLE)
        judged = firsts.groupBy("column").agg(F.count("*").alias("n"), F.count_if(is_personal(F.col("value"))).alias("personal")).collect()  # a row for each column
        personal = {r["column"] for r in judged if r["personal"] >= RATIO * r["n"]}
        found |= {c: "values" for c in texts if c in personal}
    return found
