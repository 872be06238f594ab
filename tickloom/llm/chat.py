"""Chat formatting of reply trees, in DataFrame operations only.

Messages answer one message each, so a conversation is a forest. Paths are found by self-joins that
double their reach: after round k a message knows its ancestor 2^k up and the scores on the
way, so even one long conversation takes a logarithm of its length in rounds. Messages that know
their root sit out later rounds. Branches (root to leaf) are ranked by the mean score of their
messages; only chosen branches are then spelled out.

The template marks turns as <|im_start|>role, new line, text, <|im_end|>, new line. In texts and
roles a backslash is doubled and <| becomes <\\|, so no text can hold a control string; roles have \\n
for a new line as well. The loss mask lists start and length (code points) of the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    """Between doubled backslashes, a single one only stands before | or n."""
    pieces = F.split(c, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages (c, id, parent, score, ...) -> the `keep` best branches of each conversation c: c, branch, rank, depth, id.

    branch is the leaf's id, depth counts from the root (0). A parent that is null or unknown makes a root. A
    null score counts as 0. Ties go to the longer branch, then the smaller leaf. (c, id) has to be unique.
    Messages above which replies run in a circle have no root and are on no branch.
    """
    nodes = stored(messages.select("c", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "messages")
    known = nodes.select("c", F.col("id").alias("up"))
    walk = nodes.withColumnRenamed("parent", "up").join(known.withColumn("here", F.lit(True)), ["c", "up"], "left")
    walk = stored(walk.select("c", "id", F.when(F.col("here"), F.col("up")).alias("up"), "total", F.lit(1).cast("long").alias("length")), "walk")
    leaves = nodes.join(walk.select("c", F.col("up").alias("id")).where("id is not null").distinct(), ["c", "id"], "left_anti").select("c", "id")
    jumps, most = [], nodes.count()
    rooted, walk = walk.where("up is null"), walk.where("up is not null")
    while walk.limit(1).count() and (1 << len(jumps)) <= most:
        jumps.append(walk.select("c", F.col("id").alias("node"), "up"))
        ahead = rooted.union(walk).select("c", F.col("id").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("length").alias("longer"))
        moved = stored(walk.join(ahead, ["c", "up"]).select(
            "c", "id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("longer")).alias("length")), "walk")
        rooted, walk = rooted.union(moved.where("up is null")), moved.where("up is not null")
    ends = leaves.join(rooted, ["c", "id"])
    order = Window.partitionBy("c").orderBy((F.col("total") / F.col("length")).desc(), F.col("length").desc(), "id")
    chosen = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    path = stored(chosen.select("c", F.col("id").alias("branch"), "rank", F.col("id").alias("node"), (F.col("length") - 1).alias("depth")), "branches")
    for k, jump in enumerate(jumps):
        above = path.join(jump, ["c", "node"]).select("c", "branch", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = stored(path.union(above), "branches")
    return path.withColumnRenamed("node", "id")


def formatted(turns: DataFrame) -> DataFrame:
    """turns (c, branch, depth, role, text) -> c, branch, formatted, mask: one conversation each.

    Null roles and texts are empty ones.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = turns.select("c", "branch", "depth", role.alias("role"), head.alias("head"), escaped(text).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("c", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    both = rows.groupBy("c", "branch").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("mask"))
    return both.select("c", "branch", F.array_join("pieces.piece", "").alias("formatted"), "mask")


def read_back(chats: DataFrame) -> DataFrame:
    """Turns of formatted conversations: c, branch, pos, role, text, loss (the unescaped text under the mask, or null)."""
    rows = chats.select("c", "branch", F.posexplode(F.split("formatted", r"<\|im_end\|>\n", -1)).alias("pos", "piece")).where(F.col("piece") != "")
    head = F.instr("piece", "\n")
    before = Window.partitionBy("c", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(END)).over(before), F.lit(0)))
    rows = rows.withColumn("start", F.col("at") + head)
    mask = chats.select("c", "branch", F.explode("mask").alias("m")).select("c", "branch", "m.start", F.col("m.length").alias("under"))
    under = F.expr("substring(piece, cast(start - at + 1 as int), cast(under as int))")
    return rows.join(mask, ["c", "branch", "start"], "left").select(
        "c", "branch", "pos", unescaped(F.expr(f"substring(piece, {len(START) + 1}, instr(piece, '\\n') - {len(START) + 1})")).alias("role"),
        unescaped(F.expr("substring(piece, instr(piece, '\\n') + 1)")).alias("text"), F.when(F.col("under").isNotNull(), unescaped(under)).alias("loss"))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What is read back: c, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(chats)
    digests = turns.groupBy("c", "branch").agg(
        F.count("*").alias("n_turns"), F.sum(F.coalesce(F.length("loss"), F.lit(0))).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "loss"))).alias("t"))
    lengths = chats.select("c", "branch", F.length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.array_join(c, "").cast("binary"), 256)
    return digests.join(lengths, ["c", "branch"]).select("c", "n_turns", sha("t.turn").alias("turns_sha256"), "loss_chars", sha("t.loss").alias("loss_sha256"), "formatted_chars")


def chat_formatting(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Formatted conversations of a table of turns (conv, turn, role, text): conv, formatted, mask.

    Each row answers the row before it by (turn, role, text), so a conversation is one branch with all
    its rows; repeated rows and ties are turns of their own, a null turn comes first. Rows with a null
    conversation are one conversation.
    """
    kind = turns.schema[conv_col].dataType
    order = Window.partitionBy("c").orderBy("turn", "role", "text")
    rows = turns.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("c"), "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    rows = stored(rows.select("c", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"), "turns")
    paths = reply_paths(rows)
    chats = formatted(paths.join(rows.select("c", "id", "role", "text"), ["c", "id"]))
    return chats.withColumn(conv_col, F.when(F.col("c") != "", F.col("c")).cast(kind))
