"""Evaluation: ratios, percentiles, paired tests, bootstrap, agreement, numeric scores."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SAMPLES, SEED, ALPHA = 10_000, 20260927, 0.05
#: Cases of a block of the bootstrap, about; and distinct values of a block of those that are drawn with their counts.
BLOCK_CASES = 8192
BLOCK_VALUES = 512
#: A difference that so many cases share is drawn once for all of them: a binomial draw costs about as much as so many cases' draws.
REPEATS = 16
#: Tasks that the blocks are dealt over, at most.
BLOCK_TASKS = 1024
REL, ABS = 1e-9, 1e-6


def ratio(flag: Column) -> list[Column]:
    """hits, total, rate of a nullable flag."""
    hits, total = F.count_if(flag), F.count(flag)
    return [hits.alias("hits"), total.alias("total"), F.round(F.try_divide(hits.cast("double"), total), 4).alias("rate")]


def latency(c: Column) -> list[Column]:
    return [F.round(F.avg(c), 1).alias("mean"), F.round(F.percentile(c, 0.5), 1).alias("median"), F.round(F.percentile(c, 0.95), 1).alias("p95"), F.round(F.max(c), 1).alias("max")]


def by_group_and_overall(observations: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """The aggregates by group, and over all (is_total 1), in one shuffle."""
    return observations.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping_id().cast("int").alias("is_total"), *aggregates)


def paired(observations: DataFrame, a: str, b: str, flag: str) -> DataFrame:
    """both, only_a, only_b, neither of the flags of two arms, paired by case and repeat; and the sign test's p."""
    pick = lambda arm: F.bool_or(F.when(F.col("arm") == arm, F.col(flag)))
    pairs = observations.where(F.col("arm").isin(a, b)).groupBy("case_id", "repeat").agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null")
    counts = pairs.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"), F.count_if(F.expr("not a and not b")).alias("neither"))
    return counts.withColumn("p_value", sign_test(F.col("only_a"), F.col("only_b")))


def sign_test(only_a: Column, only_b: Column) -> Column:
    """The exact two-sided p of so many discordant pairs under even odds."""
    n, k = (only_a + only_b).cast("long"), F.least(only_a, only_b).cast("long")
    logs = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (s.log + F.when(i > 0, F.ln((n - i + 1).cast("double") / F.greatest(i, F.lit(1)))).otherwise(0.0)).alias("log"),
            (s.sum + F.exp(s.log + F.when(i > 0, F.ln((n - i + 1).cast("double") / F.greatest(i, F.lit(1)))).otherwise(0.0) - n * F.ln(F.lit(2.0)))).alias("sum"),
        ),
        lambda s: s.sum,
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * logs))


def _case_means(observations: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """case_id, a, b: the case's mean in either arm, null without one."""
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col(value).cast("double")))
    return observations.groupBy("case_id").agg(mean(a).alias("a"), mean(b).alias("b"))


def _differences(means: DataFrame) -> DataFrame:
    return means.select("case_id", (F.col("b") - F.col("a")).alias("diff")).where("diff is not null")


def case_differences(observations: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """case_id, diff: the case's mean in arm b less that in arm a."""
    return _differences(_case_means(observations, a, b, value))


def _draws(ends: list[int], samples: int, block: int, seed: int) -> np.ndarray:
    """How many of each sample's draws fall on a block: the draws part at each node of a binary tree over the blocks, from the root down.

    ends: 0 and the running sums of the blocks' cases.

    A node draws for all samples in their order from a stream of its own, so every block finds the same numbers without asking, and a
    sample's add up to the number of cases.
    """
    low, high, draws = 0, len(ends) - 1, np.full(samples, ends[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = ends[middle] - ends[low], ends[high] - ends[low]
        taken = np.random.default_rng((seed, low, high)).binomial(draws, left / all_) if all_ else np.zeros(samples, np.int64)
        low, high, draws = (low, middle, taken) if block < middle else (middle, high, draws - taken)
    return draws


def _drawn(ends: list[int], sample: int, block: int, seed: int) -> int:
    """How many of one sample's draws fall on a block."""
    return int(_draws(ends, sample + 1, block, seed)[sample])


def _resampled(ends: list[int], samples: int, seed: int):
    """Each sample's sum over the cases of one block: of single cases, or of values with their counts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        draws, sums = _draws(ends, samples, block, seed), np.zeros(samples)
        if table.column("held")[0].as_py() is None:
            diffs = table.sort_by("case_id").column("diff").to_numpy()
            for sample in range(samples):
                sums[sample] = diffs[np.random.default_rng((seed, sample, block)).integers(0, len(diffs), draws[sample])].sum()
        else:
            values = table.sort_by("diff")
            diffs, held = values.column("diff").to_numpy(), values.column("held").to_numpy()
            rng, left = np.random.default_rng((seed, block)), held.sum()
            for value, n in zip(diffs, held, strict=True):  # value by value for all samples: a multinomial draw
                taken = rng.binomial(draws, n / left)
                sums += np.where(taken > 0, taken * value, 0.0)
                draws, left = draws - taken, left - n
        return pa.table({"sample": np.arange(samples), "sum": sums})

    return run


def bootstrap(differences: DataFrame, samples: int = SAMPLES, seed: int = SEED, alpha: float = ALPHA, block_cases: int = BLOCK_CASES) -> DataFrame:
    """mean, low, high, n of the mean difference over cases (case_id, diff): n of the n cases are drawn for each sample.

    A sample's sum needs no more than how often each value is drawn. Values that REPEATS cases or more share are drawn with their counts, by
    a multinomial draw; the other cases one by one. Both are dealt over blocks by a hash. A block finds by itself how many draws of a
    sample fall on it, draws among its own and sends one sum a sample; so samples times blocks rows are made, fewer are shuffled, and cases
    are neither numbered nor multiplied. The driver holds a number for each block. The differences are made once. No cases give no row;
    case_id should be unique.
    """
    cases = cut(differences.select("case_id", F.col("diff").cast("double").alias("diff")))
    total = cut(cases.agg(F.avg("diff").alias("mean"), F.count("*").alias("n")).where("n > 0"))
    often = cut(cases.groupBy("diff").agg(F.count("*").alias("held")).where(F.col("held") >= REPEATS))
    found, shared = total.first(), often.agg(F.count("*").alias("values"), F.coalesce(F.sum("held"), F.lit(0)).alias("cases")).first()
    single = found.n - shared.cases if found else 0
    # single cases come in the first blocks, values in those after them
    blocks = -(-single // block_cases) if single or not found else 0
    more = -(-shared["values"] // BLOCK_VALUES)
    rest = cases.join(often.select(F.col("diff")), cases["diff"].eqNullSafe(often["diff"]), "left_anti") if shared["values"] else cases
    dealt = rest.select("case_id", "diff", F.lit(None).cast("long").alias("held"), F.pmod(F.xxhash64("case_id"), F.lit(max(1, blocks))).cast("int").alias("block"))
    if more:
        none = F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id")
        valued = often.select(none, "diff", "held", (F.lit(blocks) + F.pmod(F.xxhash64("diff"), F.lit(more))).cast("int").alias("block"))
        dealt = dealt.unionByName(valued) if blocks else valued
    held = {r.block: r.n for r in dealt.groupBy("block").agg(F.sum(F.coalesce("held", F.lit(1))).alias("n")).collect()}
    ends = [0, *accumulate(held.get(b, 0) for b in range(max(1, blocks + more)))]
    # few bytes but much work: without a number of its own a block would share its task with all others
    sums = dealt.repartition(min(2 * (blocks + more) or 1, BLOCK_TASKS), "block").groupBy("block").applyInArrow(_resampled(ends, samples, seed), "sample long, sum double")
    means = sums.groupBy("sample").agg((F.sum("sum") / F.lit(max(1, ends[-1]))).alias("m")).agg(F.sort_array(F.collect_list("m")).alias("means"))  # as many numbers as samples
    pick = lambda i: F.element_at("means", i + 1)
    low, high = pick(int(samples * alpha / 2)), pick(min(samples - 1, int(samples * (1 - alpha / 2))))
    return total.crossJoin(F.broadcast(means)).select("mean", low.alias("low"), high.alias("high"), "n")  # one row each


def compare_arms(observations: DataFrame, a: str, b: str, value: str, higher_is_better: bool = True) -> DataFrame:
    """cases, mean_a, mean_b, difference, low, high, verdict of a flag or number: means over cases, b less a, with its interval.

    Cases that only one arm has are left out of the difference; no common case gives no row.
    """
    means = cut(_case_means(observations.where(F.col("arm").isin(a, b)), a, b, value))
    sides = means.agg(F.round(F.avg("a"), 4).alias("mean_a"), F.round(F.avg("b"), 4).alias("mean_b"))
    found = bootstrap(_differences(means)).crossJoin(F.broadcast(sides))  # one row each
    told = verdict(F.col("mean"), F.col("low"), F.col("high"), higher_is_better)
    return found.select(F.col("n").alias("cases"), "mean_a", "mean_b", F.round("mean", 4).alias("difference"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), told.alias("verdict"))


def verdict(mean: Column, low: Column, high: Column, higher_is_better: bool = True) -> Column:
    better, worse = (low > 0, high < 0) if higher_is_better else (high < 0, low > 0)
    return F.when((low == 0) & (high == 0) & (mean == 0), "no_difference").when(better, "confirmed_better").when(worse, "confirmed_worse").otherwise("not_confirmed")


def agreement(observations: DataFrame) -> DataFrame:
    """case_id, agreement, structures of (case_id, signature): the share of the commonest signature, and how many there are."""
    counted = observations.groupBy("case_id", "signature").agg(F.count("*").alias("n"))
    return counted.groupBy("case_id").agg((F.max("n") / F.sum("n")).alias("agreement"), F.count("*").alias("structures"))


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(REL * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS))


def numeric_score(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """One row: same_groups, all_close, max_abs_error of (key, value) against (key, value); equal nulls are close."""
    e, a = expected.select(F.col(key).alias("_k"), F.col("value").alias("_e"), F.lit(1).alias("_in_e")), actual.select(F.col(key).alias("_j"), F.col("value").alias("_a"), F.lit(1).alias("_in_a"))
    both = e.join(a, F.col("_k").eqNullSafe(F.col("_j")), "full")
    close = (F.col("_e").isNull() & F.col("_a").isNull()) | F.coalesce(is_close(F.col("_e"), F.col("_a")), F.lit(False))
    paired_ = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()
    return both.agg(F.coalesce(F.bool_and(paired_), F.lit(True)).alias("same_groups"), F.coalesce(F.bool_and(paired_ & close), F.lit(True)).alias("all_close"), F.max(F.abs(F.col("_e") - F.col("_a"))).alias("max_abs_error"))


def signature(metric: Column, columns: Column, group_by: Column, filters: Column) -> Column:
    """A plan's structure as text: order matters in group_by only."""
    return F.to_json(F.struct(metric.alias("metric"), F.array_sort(columns).alias("columns"), group_by.alias("group_by"), F.array_sort(filters).alias("filters")))


def arm_summary(observations: DataFrame) -> DataFrame:
    """arm, cases, plan_ok, total, rate, tokens, latency, stable_cases, agreement of the observations of each arm.

    A case is stable if all its repeats have one signature. Two shuffles: by arm and case, then by arm.
    """
    of = observations.groupBy("arm", "case_id", "signature").agg(F.count("*").alias("n"), F.count_if("plan_ok").alias("ok"), F.sum("tokens").alias("tokens"), F.sum("latency").alias("latency"))
    case = of.groupBy("arm", "case_id").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("tokens").alias("tokens"), F.sum("latency").alias("latency"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    return case.groupBy("arm").agg(
        F.count("*").alias("cases"), F.sum("ok").alias("plan_ok"), F.sum("n").alias("total"), F.round(F.sum("ok") / F.sum("n"), 4).alias("rate"), F.round(F.sum("tokens") / F.sum("n"), 1).alias("tokens"),
        F.round(F.sum("latency") / F.sum("n"), 1).alias("latency"), F.count_if(F.col("kinds") == 1).alias("stable_cases"), F.round(F.avg(F.col("most") / F.col("n")), 4).alias("agreement"),
    )


def arm_groups(observations: DataFrame) -> DataFrame:
    """arm, group, is_total, hits, total, rate, tokens, latency of each arm by group and over all its groups, in one shuffle."""
    kept = observations.groupingSets([[F.col("arm"), F.col("group")], [F.col("arm")]], "arm", "group")
    means = [F.round(F.avg(c), 1).alias(c) for c in ("tokens", "latency")]
    return kept.agg(F.grouping("group").cast("int").alias("is_total"), *ratio(F.col("plan_ok")), *means)


def decide(comparisons: DataFrame, a: str, b: str) -> DataFrame:
    """arm, rule, caveats from comparisons (measure, mean_a, mean_b, verdict), as compare_arms gives them, of accuracy, agreement, latency, tokens.

    Rule 1: a confirmed difference of accuracy. Rule 2: the greater agreement. Rule 3: the lower latency, then fewer
    tokens; a stays on a tie. Caveats: an agreement whose interval holds zero, and costs that are confirmed to be higher.
    """
    of = lambda measure, c: F.max(F.when(F.col("measure") == measure, F.col(c)))
    gap = lambda measure: F.coalesce(of(measure, "mean_b") - of(measure, "mean_a"), F.lit(0.0))
    row = comparisons.agg(of("accuracy", "verdict").alias("v"), of("agreement", "verdict").alias("steady"), gap("agreement").alias("g"), *(x for m in ("latency", "tokens") for x in (gap(m).alias(m), of(m, "verdict").alias(f"{m}_verdict"))))
    confirmed, differs = F.coalesce(F.col("v").isin("confirmed_better", "confirmed_worse"), F.lit(False)), F.abs("g") > 1e-9
    cheaper = (F.col("latency") < 0) | ((F.col("latency") == 0) & (F.col("tokens") < 0))
    takes_b = F.when(confirmed, F.col("v") == "confirmed_better").when(differs, F.col("g") > 0).otherwise(cheaper)
    chosen = row.withColumn("b", takes_b).withColumn("rule", F.when(confirmed, 1).when(differs, 2).otherwise(3))
    unsure = F.when((F.col("rule") == 2) & ~F.coalesce(F.col("steady").isin("confirmed_better", "confirmed_worse"), F.lit(False)), F.lit("agreement-not-confirmed"))
    dearer = [F.when(F.col(f"{m}_verdict") == F.when(F.col("b"), "confirmed_worse").otherwise("confirmed_better"), F.lit(f"{m}-confirmed-higher")) for m in ("latency", "tokens")]
    return chosen.select(F.when(F.col("b"), b).otherwise(a).alias("arm"), "rule", F.array_compact(F.array(unsure, *dearer)).alias("caveats"))


def conclude(comparison: DataFrame, what: str, little_room: float = 5.0) -> DataFrame:
    """verdict, claim, statements of a compare_arms row of rates: better is claimed only where the interval lies above zero.

    Without that, two more sentences may follow: how little arm a left to gain, and that nothing shown is no proof of nothing.
    """
    points = lambda c: F.format_string("%+.1f", F.round(F.col(c) * 100, 1))
    head = F.when(F.col("verdict") == "confirmed_better", f"{what} is confirmed to be better.").when(F.col("verdict") == "confirmed_worse", f"{what} is confirmed to be worse.").when(F.col("verdict") == "no_difference", f"{what} makes no difference.").otherwise(f"{what} is not confirmed to be better.")
    claim, room = F.col("verdict") == "confirmed_better", F.round((1 - F.col("mean_a")) * 100, 1)
    told = F.concat(F.lit("The difference is "), points("difference"), F.lit(" points, interval "), points("low"), F.lit(" to "), points("high"), F.lit(", over "), F.col("cases").cast("string"), F.lit(" cases."))
    narrow = F.when(~claim & (room <= little_room), F.concat(F.lit("At most "), F.format_string("%.1f", room), F.lit(" points were left to gain.")))
    return comparison.select("verdict", claim.alias("claim"), F.array_compact(F.array(head, told, narrow, F.when(~claim, F.lit("A difference that is not confirmed may still exist.")))).alias("statements"))


def case_rates(observations: DataFrame, arm: str, group: str) -> DataFrame:
    """case_id, hits, total of an arm in a group: of the plan, or of the behaviour where no plan was due."""
    fits = F.coalesce(F.col("plan_ok"), F.col("behavior_ok"), F.lit(False))
    return observations.where((F.col("arm") == arm) & (F.col("group") == group)).groupBy("case_id").agg(F.count_if(fits).alias("hits"), F.count("*").alias("total"))


def history(observations: DataFrame) -> DataFrame:
    """run, hits, total, rate of each run, in their order."""
    return observations.groupBy("run").agg(*ratio(F.col("plan_ok"))).orderBy("run")


def plan_score(cases: DataFrame) -> DataFrame:
    """case_id, metric_ok, columns_ok, grouping_ok, filters_ok, chart_ok, plan_ok of expected and predicted structs (e, p).

    Columns and filters are sets, grouping is in order. A missing prediction fits nothing.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    tests = {"metric_ok": F.col("e.metric") == F.col("p.metric"), "columns_ok": as_set(F.col("e.columns")) == as_set(F.col("p.columns")), "grouping_ok": F.col("e.group_by") == F.col("p.group_by"), "filters_ok": as_set(F.col("e.filters")) == as_set(F.col("p.filters"))}
    scored = cases.select("case_id", *(F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()), F.coalesce(F.col("e.chart") == F.col("p.chart"), F.lit(False)).alias("chart_ok"))
    return scored.withColumn("plan_ok", reduce(lambda a, b: a & b, (F.col(n) for n in tests)))
