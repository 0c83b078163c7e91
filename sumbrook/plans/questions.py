"""Questions over finished results: intent and metric by ordered patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns of intents and metrics, the more specific first
INTENTS = [
    ("unsupported", r"прогноз|предскаж|спрогноз|что будет|в будущем|построй|нарисуй|\bкод\b|python|sql|скрипт|корреляц|регресс|медиан|стандартн\w* отклон|с прошл\w* год|удали|измени данные|загрузи|forecast|predict"),
    ("cause_question", r"почему|из-за чего|по какой причине|причин[аыу]\b|что вызвал|чем вызван|\bwhy\b"),
    ("context_events", r"событи|документаци|упоминаются|упоминается|что было|инцидент|обновлен|регламент"),
    ("notable_changes", r"заслужива|вниман|аномал|существенн|важн|что интересн|выделя"),
    ("extreme_period", r"максимальн|минимальн|наибольш\w* значени|наименьш\w* значени|\bпик\b|лучш\w* месяц|худш\w* месяц|какой месяц|в какой месяц|какой период|какой квартал"),
    ("top_category", r"какой (?:канал|регион|город|филиал|магазин|отдел)|какая категор|какой из каналов|по каналам|канал\w*.*(больш|наиболь|лидир|меньш|наименьш)|(больш|наиболь|лидир|меньш|наименьш)\w*.*канал"),
    ("metric_definition", r"что означает|что значит|что такое|определени|как считается|как рассчитывается|формула|что показывает"),
    ("metric_change", r"как изменил|изменени|динамик|\bрос\w*|вырос|снизил|упал|тренд|как менял"),
]
METRICS = [
    ("failed_count", r"неуспешн|отклонен|отказ|ошибок|failed"),
    ("average_transaction_amount", r"средн\w* сумм|средн\w* чек|average"),
    ("transaction_volume", r"объ[её]м|оборот|volume|сумм\w* транзакц"),
    ("successful_count", r"количеств\w* успешн|числ\w* успешн|успешных транзакц|successful"),
    ("success_rate", r"успешност|success|доля успешн|процент успешн"),
    ("transaction_count", r"количеств|числ\w* (операц|транзакц)|операц|транзакц"),
]
# fixed values: words of a question, and parts of a column's name that they stand for
SYNONYMS = [
    (r"выруч|доход|продаж|оборот|revenue|sales", r"revenue|sales|amount|income|turnover|выруч|продаж|доход"),
    (r"заказ|orders?", r"order|заказ"),
    (r"количеств|штук|quantity|qty", r"quantity|qty|units|количеств"),
    (r"затрат|расход|cost|expense", r"cost|expense|затрат|расход"),
    (r"прибыл|profit|margin", r"profit|margin|прибыл"),
]
PERIOD = r"\b(?:в|за|на|для|по)\s+(?:январ|феврал|март|апрел|ма[йяе]\b|июн|июл|август|сентябр|октябр|ноябр|декабр)|\b20\d\d-\d\d\b"
FILTER_SENSITIVE = ("metric_change", "extreme_period", "top_category")


def normal(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(question), "ё", "е"), r"\s+", " "))


def _first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(text.rlike("(?U)" + p), name) for name, p in patterns))


def matched(text: Column) -> Column:
    """The first intent whose pattern the normal text fits, else unsupported."""
    return F.coalesce(_first(text, INTENTS), F.lit("unsupported"))


def settled(found: Column, text: Column) -> Column:
    """A matched intent, but unsupported if the text asks for a period that answers can't be cut to."""
    return F.when(found.isin(*FILTER_SENSITIVE) & text.rlike("(?U)" + PERIOD), "unsupported").otherwise(found)


def intent(question: Column) -> Column:
    """The intent; unsupported if nothing fits, or if the question asks for a period that answers can't be cut to."""
    text = normal(question)
    return settled(matched(text), text)


def metric_of(question: Column, available: list[str] | None = None, normalised: bool = False) -> Column:
    """The metric that a question names, if it is among `available` (any, if not given): a named one, else the sum whose column the
    question names itself or by a synonym; null if there is none."""
    text = question if normalised else normal(question)
    if available is None:
        return _first(text, METRICS)
    named = [(m, p) for m, p in METRICS if m in available]
    sums = []
    for m in (m for m in available if m.startswith("sum:")):
        column = m.removeprefix("sum:").casefold()
        said = text.contains(column) | text.contains(column.replace("_", " "))
        for word, part in SYNONYMS:
            if re.search(part, column):
                said |= text.rlike("(?U)" + word)
        sums.append(F.when(said, m))
    found = ([_first(text, named)] if named else []) + sums
    return F.coalesce(*found) if found else F.lit(None).cast("string")
