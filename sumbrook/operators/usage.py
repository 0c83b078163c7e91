"""Token accounting between resets: what was spent until an account was read and set to zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The counters of an account.
SUMS = ("calls", "input_tokens", "output_tokens")


def _before(df: DataFrame, keys: list[str], order: list[str], amount: str) -> Column:
    return F.coalesce(F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def segments(log: DataFrame, account: str, time: str, number: str, reset: Column, slot: str = "hour") -> DataFrame:
    """log with `segment`: how many resets of its account came before a row, in order of time, then number; `_reset` marks those rows.

    The count runs over slots of time first and then within a slot, so no window holds more than a slot's rows of an account, or an account's slots.
    """
    marked = log.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long")).withColumn("_slot", F.date_trunc(slot, F.col(time)))
    totals = marked.groupBy(account, "_slot").agg(F.sum("_reset").alias("_resets"))
    begun = totals.select(F.col(account).alias("_account"), F.col("_slot").alias("_at"), _before(totals, [account], ["_slot"], "_resets").alias("_begun"))
    within = marked.withColumn("_within", _before(marked, [account, "_slot"], [time, number], "_reset"))
    same = F.col(account).eqNullSafe(F.col("_account")) & F.col("_slot").eqNullSafe(F.col("_at"))
    return within.join(begun, same).withColumn("segment", F.col("_begun") + F.col("_within")).drop("_account", "_at", "_slot", "_begun", "_within")


def spent(log: DataFrame, account: str, time: str, number: str, reset: Column, input_tokens: Column, output_tokens: Column, slot: str = "hour") -> DataFrame:
    """account, segment, calls, input_tokens, output_tokens, total_tokens, is_reset: what each account spent between two resets.

    A reset is no call: it ends a segment, also one without calls. The last segment of an account is open (is_reset false) and told
    only if it has calls. Null tokens count as none; a null account is an account.
    """
    placed = segments(log.withColumns({"_in": input_tokens.cast("long"), "_out": output_tokens.cast("long")}), account, time, number, reset, slot)
    call = F.col("_reset") == 0
    sums = [F.count_if(call).alias("calls"), *(F.coalesce(F.sum(F.when(call, F.col(c))), F.lit(0)).alias(n) for c, n in (("_in", "input_tokens"), ("_out", "output_tokens")))]
    found = placed.groupBy(account, "segment").agg(*sums, (F.max("_reset") == 1).alias("is_reset"))
    return found.select(account, "segment", *SUMS, (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "is_reset")
