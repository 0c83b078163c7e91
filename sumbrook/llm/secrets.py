"""Secret scans over every version of every path, with an incremental ledger of blobs.

A version's content is addressed by its SHA-256; equal contents are one blob, whatever the paths. The ledger says
which rule-versions have scanned a blob and what they found. A scan looks only at the pairs of blob and rule-version that the ledger
lacks, adds them to it, and joins the findings of the present rule-versions back to all versions. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, join_hot


@dataclass(frozen=True)
class Rule:
    """A pattern, found leftmost and without overlaps; matches whose `group` has fewer than `least` code points are dropped."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a whole run, as [0-9a-f]+ with 16 characters or more
)
#: Credentials that begin with an issuer's mark, and private keys.
ADDED = (
    Rule("forge", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

LEDGER = "blob string, scanned array<string>, spans array<struct<rule:string,start:long,end:long>>"


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger so far; None before the first scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def _matches(text: Column, rule: Rule) -> Column:
    """For each match its rule, number, the code points before it since the last match and its own, and whether it is long enough."""
    found, part = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    pieces = F.split(text, rule.pattern, -1)  # one more than matches
    each = F.transform(
        found,
        lambda m, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("i"), F.length(F.get(pieces, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), (F.length(F.get(part, i)) >= rule.least).alias("fits")),
    )
    return F.when(text.rlike(rule.pattern), each)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (rule, start, end) of the blobs (blob, text, wanted) that have any; only the rules named in `wanted` are tried."""
    found = [F.when(F.array_contains("wanted", r.key), _matches(F.col("text"), r)) for r in rules]
    rows = blobs.select("blob", F.explode(F.array(*found)).alias("of")).select("blob", F.inline("of"))
    before = W.partitionBy("blob", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)  # the matches of one rule in one text
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = rows.withColumn("end", end).where("fits").select("blob", F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end").alias("span"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text, wanted: each blob of versions (blob, text) once, with the rule-versions that have not scanned it."""
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("scanned").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = versions.groupBy("blob").agg(F.count("*").alias("held"))  # hashes alone
        todo = cut(blobs.join(seen, "blob", "left").withColumn("wanted", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen")))).where("size(wanted) > 0").select("blob", "held", "wanted"))
        return join_hot(versions, todo, "blob", "held", versions.count()).dropDuplicates(["blob"])
    return versions.dropDuplicates(["blob"]).withColumn("wanted", every)


def scan(versions: DataFrame, ledger: str, path: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path (a struct of the columns `path`), blob, spans (rule as name@version, start, end; in code points) of every row of versions.

    `ledger` is a folder that all executors see; it is made if missing, and a scan appends to it. A row may be any version of a path, a null
    text is an empty one, and repeated rows each come back. Raising a rule's version has it scan every blob anew; the
    findings of rule-versions that are not among `rules` stay in the ledger and are not told. A blob that two jobs
    scanned at once is told once. Other columns may have any names. No versions give no rows.
    """
    spark = versions.sparkSession
    texts = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(texts, 256).alias("blob"), texts.alias("text"))
    todo = unseen(blobs, _ledger(spark, ledger), rules)
    # texts stay where they were dealt by blob: only matches move to their blob's row
    done = cut(todo.select("blob", "wanted", F.array(*(F.when(F.array_contains("wanted", r.key), F.col("text").rlike(r.pattern)) for r in rules)).alias("hit"), F.col("text")).select("blob", "wanted", F.when(F.exists("hit", lambda h: h), F.col("text")).alias("text")))
    found = find(done.where("text is not null"), rules)
    none = F.array().cast("array<struct<rule:string,start:long,end:long>>")
    done.select("blob", F.col("wanted").alias("scanned")).join(found, "blob", "left").select("blob", "scanned", F.coalesce("spans", none).alias("spans")).write.mode("append").parquet(ledger)
    addressed = cut(versions.select(F.struct(*(F.col(f"`{c}`") for c in path)).alias("path"), F.sha2(texts, 256).alias("blob")))
    present = F.filter("spans", lambda s: s.rule.isin([r.key for r in rules]))
    told = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode(present).alias("span")).groupBy("blob").agg(F.collect_set("span").alias("spans"))
    held = addressed.groupBy("blob").agg(F.count("*").alias("held"))
    joined = join_hot(addressed, held.join(told, "blob", "left"), "blob", "held", addressed.count())  # a hot blob without findings is hot too
    return joined.select("path", "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of `rules`, by start, then by the rules' order, comma-joined."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    placed = F.transform(F.filter(spans, lambda s: F.array_contains(keys, s.rule)), lambda s: F.struct(s.start, F.array_position(keys, s.rule).alias("kind"), s.end))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(r.name) for r in rules)), s.kind.cast("int")), s.start.cast("string"), s.end.cast("string"))), ",")
