"""Checks of written text against computed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import quotes_found

# fixed values: numbers in text with their multiplier words, and the words of causes, disclaimers, trends and months
NUMBER = r"(?<![\p{L}\p{N}_.,])(?:\d{1,3}(?:[   ]\d{3})+|\d+)(?:[.,]\d+)?(?:[  ]?(?:млрд|млн|тыс|bn|m|k)(?![\p{L}]))?"
MULTIPLIERS = {"млрд": 1e9, "млн": 1e6, "тыс": 1e3, "bn": 1e9, "m": 1e6, "k": 1e3}
STRONG_CAUSE = r"(?iu)вызван|вызвал|вызыва|из-за|привел|привёл|приводит|обусловлен|по вине|следстви|в результате|caused|because|due to|led to|result of"
WEAK_CAUSE = r"(?iuU)причин\w*\s*(?:—|-|:|является|являются|был[аио]?|состо\w+|заключа\w+)|(?:основн|главн|вероятн|возможн)\w*\s+причин"
DISCLAIMER = r"(?iuU)не\s+(?:доказыва|доказан|подтвержд|означа|установлен|определен|определён|объясня|позвол|следует)|нельзя\s+утвержд|неизвестн|не\s+известн|без\s+подтвержд|невозможно"
NEGATED_BEFORE = r"(?iuU)\bне\s+\w*\s*$"
NEGATION = r"(?iuU)\bне\b|\bнет\b"
RISE = r"(?iuU)\bрост\w*|\bвыр[оа]с\w*|\bувелич\w*|\bповыс\w*|\bприрост\w*|\brose\b|\bgrew\b|\bincreas\w*"
DECLINE = r"(?iuU)\bсниж\w*|\bснизил\w*|\bупал\w*|\bпадени\w*|\bсократ\w*|\bуменьш\w*|\bпросе[лд]\w*|\bпросадк\w*|\bfell\b|\bdecreas\w*|\bdeclin\w*"
MONTHS = ["январ", "феврал", "март", "апрел", "ма[йяе]\\b", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"]
SENTENCE = r"(?<=[.!?;])\s+"
FACT_IDS = r"\s*\((?:[a-z_]+\.[a-z_0-9]+(?:,\s*)?)+\)"
MAX_TITLE = 120


def masked(text: Column, labels: list[str]) -> Column:
    """The text without labels and formulas, the longest first."""
    for item in sorted({x for x in labels if x}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(item), F.lit(" "))
    return text


def numbers(text: Column) -> Column:
    """The numbers of a text: said (as written), value, tolerance (half a unit of the last digit given)."""

    def one(said: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(said, r"^[\d   ]+(?:[.,]\d+)?", 0), "[   ]", "")
        plain = F.replace(digits, F.lit(","), F.lit("."))
        scale = F.lit(1.0)
        for word, times in MULTIPLIERS.items():
            scale = F.when(F.regexp_extract(said, r"(\p{L}+)$", 1) == word, times).otherwise(scale)
        places = F.when(plain.contains("."), F.length(F.substring_index(plain, ".", -1))).otherwise(0)
        return F.struct(F.trim(said).alias("said"), (plain.cast("double") * scale).alias("value"), ((0.5 * F.pow(F.lit(10.0), -places) + 1e-9) * scale).alias("tolerance"))

    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), one)


def ungrounded(text: Column, allowed: Column) -> Column:
    """The numbers of the text that no allowed value, with either sign, rounds to."""
    known = lambda n: F.exists(allowed, lambda a: (F.abs(n.value - a) <= n.tolerance) | (F.abs(n.value - F.abs(a)) <= n.tolerance))
    return F.transform(F.filter(numbers(text), lambda n: ~known(n)), lambda n: n.said)


def causal(text: Column) -> Column:
    """The sentences that claim a cause without a disclaimer or a negation."""
    strong = lambda s: s.rlike(STRONG_CAUSE)
    # only a negation right before the first word of cause clears the sentence
    before = lambda s: F.element_at(F.split(s, STRONG_CAUSE, 2), 1)
    claims = lambda s: (strong(s) & ~before(s).rlike(NEGATED_BEFORE)) | (~strong(s) & s.rlike(WEAK_CAUSE) & ~s.rlike(NEGATION))
    return F.transform(F.filter(F.split(text, SENTENCE), lambda s: ~s.rlike(DISCLAIMER) & claims(s)), F.trim)


def months_named(text: Column) -> Column:
    """The numbers of the months that the text names."""
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?iuU)\b{m}\w*"), i) for i, m in enumerate(MONTHS, 1))))


def trend_violation(text: Column, change: Column) -> Column:
    """trend-needs-comparison or trend-direction-mismatch, or null. change: the difference that is claimed, null if none."""
    up, down = text.rlike(RISE), text.rlike(DECLINE)
    wrong = (up & ~down & (change < 0)) | (down & ~up & (change > 0))
    return F.when((up | down) & change.isNull(), "trend-needs-comparison").when(wrong, "trend-direction-mismatch")


def check_insights(insights: DataFrame, facts: DataFrame, months: list[int] | None = None, labels: list[str] | None = None) -> DataFrame:
    """insight_id, rule, detail of every violation of (insight_id, text, evidence: array of fact ids) against (fact, value, kind)."""
    cited = insights.select("insight_id", F.explode_outer("evidence").alias("fact")).join(facts, "fact", "left")
    known = cited.groupBy("insight_id").agg(
        F.collect_list("value").alias("allowed"), F.max(F.when(F.col("kind") == "difference", F.col("value"))).alias("change"), F.collect_set(F.when(F.col("fact").isNotNull() & F.col("value").isNull(), F.col("fact"))).alias("unknown")
    )
    joined = insights.join(known, "insight_id", "left").withColumn("_plain", masked(F.col("text"), labels or []))
    rule = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    bad, cause, missing = ungrounded(F.col("_plain"), F.coalesce("allowed", F.array().cast("array<double>"))), causal(F.col("text")), F.array_except(months_named(F.col("text")), F.array(*(F.lit(m) for m in months or [])).cast("array<int>"))
    found = [
        rule("evidence-required", F.size("evidence") == 0, F.lit("")),
        rule("unknown-evidence", F.size("unknown") > 0, F.array_join(F.array_sort("unknown"), ", ")),
        rule("numbers-grounded", F.size(bad) > 0, F.array_join(bad, ", ")),
        rule("no-causal-claim", F.size(cause) > 0, F.array_join(cause, " ")),
        rule("period-not-in-data", F.lit(months is not None) & (F.size(missing) > 0), F.array_join(missing.cast("array<string>"), ", ")),
    ]
    trend = trend_violation(F.col("text"), F.col("change"))
    found.append(F.when(trend.isNotNull(), F.struct(trend.alias("rule"), F.lit("").alias("detail"))))
    return joined.select("insight_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("insight_id", "v.rule", "v.detail")


def for_readers(text: Column) -> Column:
    """The text without the ids of facts in brackets."""
    return F.regexp_replace(text, FACT_IDS, "")


def without_quotes(answers: DataFrame, fragments: DataFrame) -> DataFrame:
    """answers (answer_id, text) with the sentences of their fragments (answer_id, text) blanked out, longer ones first.

    A sentence that stands word for word in a document is that document's; checks of numbers and causes leave it alone.
    """
    said = fragments.select("answer_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s")).where("trim(s) <> ''").distinct()
    quotes = said.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("s")).alias("size"), "s"))).alias("_quotes"))
    blank = F.aggregate(F.coalesce("_quotes", F.array().cast("array<struct<size:int,s:string>>")), F.col("text"), lambda t, q: F.replace(t, q.s, F.lit(" ")))
    return answers.join(quotes, "answer_id", "left").withColumn("text", blank).drop("_quotes")


def assemble(drafts: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """insight_id, title, text, evidence, context, issues of drafts (insight_id, title, text, evidence, chunk_id, quote) that others wrote.

    evidence: the cited facts that exist, each once, in the order cited; context: the chunk whose words the quote is, else
    null. issues: unknown-evidence and evidence-required for the facts, context-not-in-source for the quote.
    """
    cited = drafts.select("insight_id", F.posexplode("evidence").alias("at", "fact")).groupBy("insight_id", "fact").agg(F.min("at").alias("at"))
    met = cited.join(facts.select("fact", F.lit(True).alias("known")), "fact", "left").groupBy("insight_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("at", "fact")))).alias("known"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("fact")))).alias("unknown")
    )
    quotes = quotes_found(drafts.where("chunk_id is not null").select(F.col("insight_id").alias("evidence_id"), "chunk_id", F.coalesce("quote", F.lit("")).alias("quote")), chunks)
    joined = drafts.join(met, "insight_id", "left").join(quotes.select(F.col("evidence_id").alias("insight_id"), "verified"), "insight_id", "left")
    kept = F.coalesce(F.transform("known", lambda k: k.fact), F.array().cast("array<string>"))
    strange = F.coalesce("unknown", F.array().cast("array<string>"))
    issue = lambda when, name: F.when(when, F.lit(name))
    issues = F.array_compact(F.array(issue(F.size(strange) > 0, "unknown-evidence"), issue((F.size(strange) == 0) & (F.size(kept) == 0), "evidence-required"), issue(F.col("chunk_id").isNotNull() & ~F.coalesce("verified", F.lit(False)), "context-not-in-source")))
    return joined.select("insight_id", F.substring(F.trim("title"), 1, MAX_TITLE).alias("title"), F.trim("text").alias("text"), kept.alias("evidence"), F.when(F.col("verified"), F.col("chunk_id")).alias("context"), issues.alias("issues"))


def settle(attempts: DataFrame, violations: DataFrame, by_rule: DataFrame) -> DataFrame:
    """insight_id, text, attempt: the first attempt (insight_id, attempt, text) without a violation, else the rule's text and null."""
    clean = attempts.join(violations.select("insight_id", "attempt"), ["insight_id", "attempt"], "left_anti").groupBy("insight_id").agg(F.min(F.struct("attempt", "text")).alias("best"))
    return by_rule.join(clean, "insight_id", "left").select("insight_id", F.coalesce("best.text", "text").alias("text"), "best.attempt")
