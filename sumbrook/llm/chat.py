"""Chat formatting over reply trees.

Every turn has a parent; self-joins that double their reach find each turn's depth and the score of its path to the root
in a number of rounds that grows with the logarithm of the depth. Leaves are ranked by the mean score of their path.
Only the chosen leaves' paths are then enumerated, by joins that halve the jump each time: a turn keeps one pointer
for each power of two of its depth, never its whole path. Each path is formatted as one conversation.

Template of a turn: `### role: text</turn>` and a line end. In role and text the backslash, `<`, `#` and, in roles, `:`
are written `\\b`, `\\l`, `\\h` and `\\c`, so neither can hold a mark, and every backslash begins an escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
# fixed values: what is escaped, and how; the backslash is first when escaping and last when reading back
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, mark in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def chain(rows: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each row answers the one before it. Adds node and parent (null at the root).

    Rows of one conversation with the same turn are ordered by role, then text. A null conv_id is a conversation.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long") - 1)
    return numbered.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def pointers(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, node, depth (turns from the root, itself included), total (the sum of their scores), jumps of each node.

    jumps holds the ancestors 1, 2, 4 and so on steps up. A node whose parent is missing is a root. Conversations may have
    several roots. Null scores count as 0. Replies that go in a circle raise a ValueError.
    """
    known = nodes.select("conv_id", F.col("node").alias("_p")).distinct()
    joined = nodes.select("conv_id", "node", "parent", "score").alias("n").join(known.alias("k"), F.col("n.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("n.parent") == F.col("k._p")), "left")
    reach = cut(joined.select("n.conv_id", "node", F.col("_p").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"), F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.array().cast("array<long>")).alias("jumps")))
    longest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for step in range(most_rounds):
        if reach.where("up is not null").isEmpty():
            return reach.drop("up")
        if 1 << step > longest:
            break
        above = reach.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        met = reach.where("up is not null").join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_n")))
        jumps = F.when(F.col("_up").isNotNull(), F.concat("jumps", F.array("_up"))).otherwise(F.col("jumps"))
        longer = met.select("conv_id", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"), jumps.alias("jumps"))
        reach = cut(longer.unionByName(reach.where("up is null")))
    raise ValueError("the replies go in a circle")


def branches(nodes: DataFrame, most: int | None = 1) -> DataFrame:
    """conv_id, leaf, branch, at, node: the turns of the root-to-leaf paths of each conversation, at counting from the root (0).

    Paths are ranked by their mean score, the best first; ties go to the longer one, then to the smaller leaf. `most` of
    them are given (None: all). An empty table gives no rows.
    """
    parents = nodes.where("parent is not null").select("conv_id", F.col("parent").alias("_p")).distinct()
    every = cut(pointers(nodes))
    leaves = every.join(parents, every.conv_id.eqNullSafe(parents.conv_id) & (every.node == parents._p), "left_anti")
    best = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node"))
    ranked = leaves.withColumn("branch", best)
    chosen = ranked if most is None else ranked.where(F.col("branch") <= most)
    steps = chosen.select("conv_id", F.col("node").alias("leaf"), "branch", (F.col("depth") - 1).alias("at"), "node")
    lifts = every.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "jumps")
    for power in range((every.agg(F.max(F.size("jumps"))).first()[0] or 0) - 1, -1, -1):
        # each turn found so far brings the one 2 ** power above it, so every ancestor is met once
        met = steps.join(lifts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
        both = F.array(F.struct("at", "node"), F.struct((F.col("at") - (1 << power)).alias("at"), F.get("jumps", F.lit(power)).alias("node")))
        steps = met.select("conv_id", "leaf", "branch", F.inline(both)).where("node is not null")
    return steps


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, leaf, branch, formatted, loss (first code point and length of each learned text in formatted) of chosen, as branches gives it.

    Null texts and roles are empty. A conversation is one value in the result, so one task puts it together.
    """
    turns = chosen.alias("s").join(nodes.alias("n"), F.col("s.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("s.node") == F.col("n.node")))
    role = F.coalesce("role", F.lit(""))
    head, body = F.concat(F.lit(OPEN), escape(role, role=True), F.lit(MIDDLE)), escape(F.coalesce("text", F.lit("")))
    turn = F.struct("at", head.alias("head"), body.alias("body"), (role == LEARNED).alias("learned"))
    listed = turns.groupBy("s.conv_id", "leaf", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<begin:int,length:int>>").alias("loss"))

    def add(state: Column, t: Column) -> Column:
        begin = state.end + F.length(t.head)
        span = F.struct(begin.alias("begin"), F.length(t.body).alias("length"))
        loss = F.when(t.learned, F.concat(state.loss, F.array(span))).otherwise(state.loss)
        return F.struct((begin + F.length(t.body) + len(CLOSE)).alias("end"), loss.alias("loss"))

    return listed.select("conv_id", "leaf", "branch", formatted.alias("formatted"), F.aggregate("turns", start, add, lambda s: s.loss).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    cut_at = lambda x: F.instr(x, MIDDLE)
    return F.transform(parts, lambda x: F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), cut_at(x) - (len(OPEN) + 1))).alias("role"), unescape(F.substring(x, cut_at(x) + len(MIDDLE), F.length(x))).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.begin + 1, s.length))), "")
