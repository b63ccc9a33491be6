"""Chat formatting by quotation linking, in DataFrame operations only.

1. Lines that begin with `>` marks are quoted at a level of as many marks; runs of one level are passages.
2. Passages, and their single lines, are normalised (lower case, white space collapsed) and hashed, unless empty.
3. Own (unquoted) texts and lines are hashed likewise. The original of a quote is the earliest message (by turn)
   of the same conversation that says it, else the earliest (by conversation and turn) of all, if it precedes the
   quoting message in that order. A message's parent is the original of its outermost quotes: whole passages
   before lines, same conversation before others, then the latest original.
4. Following parents gives each message its root; a thread is the roots' conversation. The reply order of a thread
   is by root turn, then conversation and turn, so that replies stand behind the message that they answer.

One row per message: conv_id, turn, role, text (quotes removed), max_level, n_quotes (quoted passages), n_linked
(of them, with an original), parent_conv, parent_turn, thread_id, depth (links to the root), position (from 0 in
its thread). Originals are aggregated before joins (least turn, least message), so common passages don't multiply
rows, and positions come from a range sort with partition offsets, so that a thread of any size spreads.

Equal rows are one message. Rows that share (conv_id, turn) share links. Null texts are empty; messages with a null
conv_id or turn link with nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._session import table, written

_MARKS = r"^((?:[ \t]*>)+)"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hashed(df: DataFrame, text: Column) -> DataFrame:
    """df with h1, h2 of the normalised text, where that is not empty."""
    df = df.withColumn("_n", _norm(text)).where(F.length("_n") > 0)
    return df.withColumn("h1", F.xxhash64("_n")).withColumn("h2", F.xxhash64(F.lit(1), "_n")).drop("_n")


def own_text(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(_MARKS))
    return F.when(text.rlike(r"(?m)" + _MARKS), F.trim(F.array_join(lines, "\n"), F.lit(" \t\r\n"))).otherwise(text)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """Quoted passages: conv_id, turn, mark (the message), run, level, kind (0 passage, 1 line), h1, h2."""
    key = ["conv_id", "turn", "mark"]
    lines = messages.where(F.col("text").rlike(r"(?m)" + _MARKS)).select(*key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*key, "pos", F.length(F.regexp_replace(F.regexp_extract("line", _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace("line", _MARKS, "").alias("body"))
    order = Window.partitionBy(*key).orderBy("pos")  # one message's lines
    lines = lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(order)).where("level > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ")
    blocks = lines.groupBy(*key, "run", "level").agg(text.alias("body")).withColumn("kind", F.lit(0))
    single = lines.select(*key, "run", "level", "body").withColumn("kind", F.lit(1))
    return blocks.unionByName(single)


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per message with quotes: its counts; and links (conv_id, turn) to (parent_conv, parent_turn)."""
    passages = written(quoted_passages(messages), "quoted")
    refs = written(_hashed(passages.where("conv_id IS NOT NULL AND turn IS NOT NULL"), F.col("body")).drop("body"), "quote-refs")
    wanted = written(refs.select("h1", "h2").distinct(), "wanted")
    own = messages.select("conv_id", "turn", "own").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = own.select("conv_id", "turn", F.explode(F.concat(F.array("own"), F.split("own", "\n", -1))).alias("body"))
    said = written(_hashed(said, F.col("body")).drop("body").join(wanted, ["h1", "h2"], "left_semi").distinct(), "said")
    here = written(said.groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("here")), "said-here")
    there = written(said.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("there")), "said-first")
    found = refs.join(here, ["h1", "h2", "conv_id"], "left").join(there, ["h1", "h2"], "left")
    local = F.when(F.col("here") < F.col("turn"), F.struct(F.col("conv_id"), F.col("here").alias("turn")))
    other = F.when((F.col("there.conv_id") != F.col("conv_id")) & (F.col("there") < F.struct("conv_id", "turn")), F.col("there"))
    found = found.select("conv_id", "turn", "mark", "run", "level", "kind", F.coalesce(local, other).alias("to"), local.isNotNull().alias("same")).where("to IS NOT NULL")
    found = written(found, "found")
    best = F.max(F.struct((-F.col("level")).alias("l"), (-F.col("kind")).alias("k"), "same", "to"))
    parents = written(found.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.to.conv_id").alias("parent_conv"), F.col("b.to.turn").alias("parent_turn")), "parents")
    linked = found.select("conv_id", "turn", "mark", "run").distinct().groupBy("conv_id", "turn", "mark").agg(F.count(F.lit(1)).alias("n_linked"))
    counts = passages.where("kind = 0").groupBy("conv_id", "turn", "mark").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("level").alias("max_level"))
    key = F.expr("c.conv_id <=> l.conv_id AND c.turn <=> l.turn AND c.mark = l.mark")
    counts = counts.alias("c").join(linked.alias("l"), key, "left").select("c.conv_id", "c.turn", "c.mark", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    return written(counts, "quote-counts"), parents


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of every message with a parent, by pointer doubling."""
    at = parents.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    at = written(at, "roots")
    while True:
        up = at.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c2"), F.col("root_turn").alias("t2"), F.col("depth").alias("d2"))
        step = at.join(up, ["root_conv", "root_turn"], "left")
        new = written(step.select("conv_id", "turn", F.coalesce("c2", "root_conv").alias("root_conv"), F.coalesce("t2", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("c2").isNotNull().alias("moved")), "roots")
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def positioned(df: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """df with position: the row's place within its thread by `order`. No thread needs to fit one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [thread, *order]
    at = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    size = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    offset = size.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    at = at.join(F.broadcast(offset), "_p").withColumn("_g", F.col("_o") + F.col("_i")).drop("_m", "_p", "_i", "_o")
    first = written(at.groupBy(F.col(thread).alias("_t")).agg(F.min("_g").alias("_f")), "thread-starts")
    return at.join(first, F.col(thread).eqNullSafe(F.col("_t"))).withColumn("position", F.col("_g") - F.col("_f")).drop("_g", "_t", "_f")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    messages = conversations.select("conv_id", "turn", "role", text.alias("text")).distinct()
    messages = written(messages.withColumn("mark", F.xxhash64("role", "text")).withColumn("own", own_text(F.col("text"))), "messages")
    counts, parents = link(messages)
    root = roots(parents)
    key = F.expr("m.conv_id <=> c.conv_id AND m.turn <=> c.turn AND m.mark = c.mark")
    full = messages.alias("m").join(counts.alias("c"), key, "left").select("m.*", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("max_level", F.lit(0)).alias("max_level"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    full = full.join(parents, ["conv_id", "turn"], "left").join(root, ["conv_id", "turn"], "left")
    full = full.select("conv_id", "turn", "role", F.col("own").alias("text"), "max_level", "n_quotes", "n_linked", "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("thread_id"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("root_turn", "turn").alias("_root"), "mark")
    return positioned(full, "thread_id", ["_root", "conv_id", "turn", "mark"]).drop("_root", "mark")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))
