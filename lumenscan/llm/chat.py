"""Chat formatting of reply trees, with DataFrame functions only.

`paths` enumerates every root-to-leaf path by self-joins whose reach doubles, so a thread of depth d takes log2(d) rounds and the
rows made are the path rows themselves. `formatted` lays each path out as one conversation with a loss mask; `parsed` reads it back.

Defined results: null text, role or score count as empty, empty and 0; a row whose parent is missing is a root; repeated
(conversation, node) keys keep the smallest (role, text); threads that run into a cycle have no root and give no path; a null
conversation id is a conversation of its own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, staged, table

TURN, END = "<|turn|>", "<|end|>"
#: What escaping replaces, in this order; reading back undoes it in the reverse order. No escaped text holds `<` or `[`.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NEWLINE = "&#10;"


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _keyed(nodes: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    nodes = nodes.select(
        key.alias("conv_key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    first = F.min_by(F.struct("conv_id", "parent_id", "role", "text", "score"), F.struct("role", "text", "score", "parent_id")).alias("x")
    return nodes.groupBy("conv_key", "node_id").agg(first).select("conv_key", "node_id", "x.*")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes: conv_id, node_id, parent_id, role, text, score. Returns for each leaf all rows of its path:
    conv_id, leaf_id, place (0 at the root), role, text, path_score, branch_rank (1: the best branch of the conversation)."""
    nodes = staged(_keyed(nodes), "chat-nodes")
    links = nodes.select("conv_key", "node_id", "parent_id")
    known = links.select("conv_key", F.col("node_id").alias("parent_id"))
    links = staged(links.filter("parent_id is not null").join(known, ["conv_key", "parent_id"]).select("conv_key", "node_id", F.col("parent_id").alias("up")), "chat-up")
    largest = nodes.groupBy("conv_key").count().agg(F.max("count")).first()[0] or 0
    jumps = [links]
    while 1 << (len(jumps) - 1) < largest:
        far = jumps[-1].alias("a").join(jumps[-1].alias("b"), (F.col("a.conv_key") == F.col("b.conv_key")) & (F.col("a.up") == F.col("b.node_id")))
        far = staged(far.select("a.conv_key", "a.node_id", "b.up"), "chat-up")
        if far.isEmpty():
            break
        jumps.append(far)
    parents = links.select("conv_key", F.col("up").alias("node_id")).distinct()
    leaves = nodes.join(parents, ["conv_key", "node_id"], "left_anti").select("conv_key", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("above"))
    if 1 << (len(jumps) - 1) >= largest:  # further than any walk without a repeat goes: whoever still has an ancestor there is below a cycle
        endless = jumps.pop().select("conv_key", F.col("node_id").alias("leaf_id"))
        leaves = leaves.join(endless, ["conv_key", "leaf_id"], "left_anti")
    walk = leaves
    for k in range(len(jumps) - 1, -1, -1):
        up = walk.join(jumps[k], ["conv_key", "node_id"]).select("conv_key", "leaf_id", F.col("up").alias("node_id"), (F.col("above") + (1 << k)).alias("above"))
        walk = staged(walk.unionByName(up), "chat-walk")
    walk = walk.join(nodes, ["conv_key", "node_id"])
    scores = walk.groupBy("conv_key", "conv_id", "leaf_id").agg(F.sum("score").alias("path_score"), F.max("above").alias("deepest"))
    scores = scores.withColumn("branch_rank", F.row_number().over(Window.partitionBy("conv_key").orderBy(F.desc("path_score"), "leaf_id")))
    out = walk.drop("conv_id").join(scores, ["conv_key", "leaf_id"]).select("conv_key", "conv_id", "leaf_id", (F.col("deepest") - F.col("above")).alias("place"), "role", "text", "path_score", "branch_rank")
    out = staged(out, "chat-paths")
    for x in [*jumps, nodes]:
        discard(x)
    return out


def formatted(path_rows: DataFrame) -> DataFrame:
    """One row per path: conv_id, leaf_id, branch_rank, path_score, formatted, loss_spans (start and length in code points)."""
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = path_rows.select("*", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("part", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("conv_key", "leaf_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("x", F.struct("place", "part", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))).alias("span")))
    rows = rows.groupBy("conv_key", "conv_id", "leaf_id", "branch_rank", "path_score").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(
        "conv_id", "leaf_id", "branch_rank", "path_score", F.array_join(F.transform("x", lambda t: t["part"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    parts = F.filter(F.split(text, r"<\|turn\|>", -1), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 2 - len(END))
        return F.struct(unescaped(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees without branches: each row answers the one before it, by (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back; see the module's defined results."""
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = formatted(paths(threads(given.unionByName(own)))).filter("branch_rank = 1")
    out = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
