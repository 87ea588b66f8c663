"""Chat formatting of reply trees.

Messages are nodes with parents. Self-joins by doubled distances give every node's depth and the score of its branch, and
then, for the best leaves of each tree, all nodes on the way to the root, in about log2(depth) joins. Each chosen path is
formatted as one conversation: every turn between control strings, control strings inside texts escaped so that
parsing gives the exact texts back, and a loss mask of character spans over the assistant's texts.

A conversation is one value of the output, so the turns of one path are gathered in one task.

Defined results: null text and null role are empty; turns with equal order are ordered by role and text; a null
conversation id is a conversation of its own; a very long text is one turn, never cut; repeated rows are repeated turns; ties
of branches go to the longer one, then to the smaller leaf; extra columns are ignored; a message
whose parent is missing is a root; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.llm.shared import ready, stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
_ESCAPED = re.compile(r"\\([\\|n])")


def escape(text: Column) -> Column:
    """Backslashes doubled, and '<|' broken by one: no control string is left, and unescape() finds the way back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def linear_replies(df: DataFrame, conv_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Turns as a tree without branches: node, parent, conv_id, role, text; kept as a table, for node numbers must not change."""
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(order_col).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = stored(df.sparkSession, turns.withColumn("node", F.monotonically_increasing_id()), "turns")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return nodes.withColumn("parent", F.lag("node").over(order)).drop("turn")


def best_paths(messages: DataFrame, best: int = 1, score_col: str | None = None) -> DataFrame:
    """The best root-to-leaf paths of each tree: conv_id, rank, leaf, position, node.

    messages: conv_id, node (long, unique), parent (null: a root). Branches are ranked by the sum of score_col over their
    messages (0 without one), then by length, then by the smaller leaf.
    """
    spark = messages.sparkSession
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    rows = messages.select("conv_id", "node", "parent", F.coalesce(score, F.lit(0.0)).alias("score"))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, "parent", "left").select("conv_id", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).alias("depth"))
    state, jumps = stored(spark, rows, "jumps"), []
    while not state.where("up is not null").isEmpty():
        jumps.append(state.where("up is not null").select("node", "up"))
        # only branches that go on above take part
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("steps"))
        longer = state.where("up is not null").join(above, "up")
        longer = longer.select("conv_id", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("steps")).alias("depth"))
        state = state.where("up is null").union(longer)
        state = stored(spark, state, "jumps")
        if len(jumps) > 40:
            raise ValueError("the replies form a circle")
    leaves = state.join(rows.select(F.col("up").alias("node")), "node", "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("depth"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    paths = leaves.select("conv_id", "rank", F.col("node").alias("leaf"), "depth", "node", F.lit(0).alias("back"))
    for k in reversed(range(len(jumps))):  # each ancestor is reached once, by the binary digits of its distance
        paths = paths.join(jumps[k], "node", "left").select(
            "conv_id", "rank", "leaf", "depth",
            F.inline(F.filter(F.array(F.struct(F.col("node"), F.col("back")), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))), lambda x: x["node"].isNotNull())),
        )
    return paths.select("conv_id", "rank", "leaf", (F.col("depth") - 1 - F.col("back")).alias("position"), "node")


def formatted(messages: DataFrame, best: int = 1, score_col: str | None = None) -> DataFrame:
    """Each chosen path as one conversation: conv_id, rank, formatted (string), loss_spans (character offsets: start, end)."""
    paths = best_paths(messages, best, score_col)
    turns = paths.join(messages.select("node", "role", "text"), "node")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = turns.select("conv_id", "rank", "leaf", "position", F.col("role") == LEARNT_ROLE, head.alias("head"), escape(F.col("text")).alias("body")).toDF("conv_id", "rank", "leaf", "position", "learnt", "head", "body")
    piece = F.concat("head", "body", F.lit(f"{END}\n"))
    before = Window.partitionBy("leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("head")
    placed = turns.select("conv_id", "rank", "leaf", "position", piece.alias("piece"), F.when(F.col("learnt"), F.struct(at.alias("start"), (at + F.length("body")).alias("end"))).alias("span"))
    whole = placed.groupBy("leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return whole.select("conv_id", "rank", F.array_join("pieces.piece", "").alias("formatted"), "loss_spans")


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in text.split(f"{END}\n")[:-1]:
        head, _, body = part.removeprefix(START).partition("\n")
        turns.append((unescape(head), unescape(body)))
    return turns


def read_back(conversations: DataFrame) -> DataFrame:
    """conversations with turns (array of role and text) and loss_text, both read from formatted and loss_spans alone."""
    ready(conversations.sparkSession)

    @F.arrow_udf("array<struct<role: string, text: string>>")
    def turns(texts: pa.Array) -> pa.Array:
        rows = [[{"role": r, "text": t} for r, t in parse(x.as_py())] for x in texts]
        return pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))

    @F.arrow_udf("string")
    def under_mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(["".join(unescape(t[s["start"] : s["end"]]) for s in x) for t, x in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return conversations.withColumns({"turns": turns("formatted"), "loss_text": under_mask("formatted", "loss_spans")})
