"""Column names to phrases that people use for them."""

from __future__ import annotations

import re

# fixed values: what a column's name says, and phrases for it; the first group rules out the count of transactions
SPECIFIC = [
    (r"success|succeed|успеш", ["успешные транзакции", "успешные операции", "количество успешных операций", "успешно завершённые платежи"]),
    (r"fail|error|declin|reject|неуспеш|ошибк|отказ", ["неуспешные транзакции", "неуспешные операции", "количество ошибок", "отказы", "неудачные операции"]),
    (r"amount|sum|volume|revenue|turnover|сумм|объ[её]м|выруч|оборот", ["сумма", "объём транзакций", "объём платежей", "денежный объём", "оборот", "сумма платежей"]),
]
COUNTED = (r"transaction|trx|txn|operation|payment|транзакц|операц|платеж", ["количество транзакций", "количество операций", "число транзакций", "число операций"])
GENERAL = [
    (r"count|number|qty|quantity|количеств|число|кол-во", ["количество", "число"]),
    (r"month|date|day|year|period|week|дата|месяц|период|год|день|недел", ["месяц", "дата", "период", "временная ось"]),
    (r"channel|source|канал|источник", ["канал", "канал платежа", "источник"]),
    (r"region|city|country|регион|город|стран", ["регион", "город", "география"]),
    (r"rate|percent|share|pct|ratio|доля|процент|коэфф", ["доля", "процент", "коэффициент"]),
    (r"avg|average|mean|средн", ["среднее значение", "средняя сумма"]),
    (r"price|cost|цена|стоимост", ["цена", "стоимость"]),
    (r"customer|client|user|клиент|пользоват", ["клиент", "пользователь"]),
    (r"product|sku|item|товар|продукт", ["товар", "продукт"]),
    (r"status|state|статус", ["статус", "состояние"]),
    (r"type|category|тип|категори", ["тип", "категория"]),
    (r"kzt|тенге", ["валюта: тенге"]),
    (r"usd|доллар", ["валюта: доллары США"]),
    (r"eur|евро", ["валюта: евро"]),
    (r"rub|рубл", ["валюта: рубли"]),
]


def plain_name(name: str) -> str:
    """The words of a name, parted at capitals and marks, in small letters."""
    parted = re.sub(r"(?<=[a-zа-я0-9])(?=[A-ZА-Я])", " ", name)
    return " ".join(re.findall(r"[0-9a-zа-яё]+", parted.lower()))


def synonyms(name: str) -> list[str]:
    plain = plain_name(name)
    fit = lambda rules: [p for pattern, phrases in rules if re.search(pattern, plain) for p in phrases]
    return list(dict.fromkeys([*(fit(SPECIFIC) or fit([COUNTED])), *fit(GENERAL)]))
