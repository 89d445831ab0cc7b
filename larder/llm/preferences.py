"""Preference formatting: one prompt and two masked completions for a chosen and a rejected
conversation.

The prompt is the longest common turn prefix: turns of equal role and text, from the first on. It is
rendered once; what follows it on either side is that side's completion. In a completion the words
of the assistant are to be learned; `loss` says where they are.

The two sides are matched turn by turn (an equality join on pair and turn, so that a pair with a
third of all turns spreads), the first difference of a pair is a partial minimum, and rendered
turns are gathered in parts of `PART` places: part p of a pair holds the places p * PART and up, a
place being the number of turns of either side that come before. So no list grows with the length
of a conversation, nor with turns of null or equal number. Usual conversations have one part. The
texts of a pair in the order of its parts are the whole prompt and completions.

Repeated rows count once. Turns of equal number come in the order of role and text. A null turn
number counts as -1. A null role is `unknown`, a null text is empty. Rows without a pair are left out. A pair that has one
side only has no prompt; two equal sides are all prompt and have empty completions. Empty tables
give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import written

PART = 256
START, END = "<|im_start|>", "<|im_end|>"


def turns(df: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair, turn, n, role, text): the distinct turns of each pair; `n` counts turns of equal number."""
    kept = df.filter(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).alias("pair"), F.coalesce("turn", F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("pair", "turn").orderBy("role", "text")))


def _plain(text: Column) -> Column:
    """A text cannot spell the marks of the format."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def common_prefix(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Every turn of either side (`pair, turn, n, c_role, c_text, r_role, r_text`; null where a side
    has none) and `common`, true inside the longest common prefix."""
    left = chosen.select("pair", "turn", "n", F.col("role").alias("c_role"), F.col("text").alias("c_text"))
    right = rejected.select("pair", "turn", "n", F.col("role").alias("r_role"), F.col("text").alias("r_text"))
    both = left.join(right, ["pair", "turn", "n"], "full")
    same = F.coalesce((F.col("c_role") == F.col("r_role")) & (F.col("c_text") == F.col("r_text")), F.lit(False))
    both = both.withColumn("_same", same)
    splits = both.filter("NOT _same").groupBy("pair").agg(F.min(F.struct("turn", "n")).alias("_split"))
    inside = F.col("_split").isNull() | (F.struct("turn", "n") < F.col("_split"))
    return both.join(splits, "pair", "left").withColumn("common", inside).drop("_same", "_split")


def placed(found: DataFrame) -> DataFrame:
    """The matched turns of `common_prefix` with `place`: how many turns of the pair come before.

    Turn numbers are counted first and summed in runs of `PART` numbers, so that windows hold a run or
    the runs of a pair, and no texts."""
    sizes = found.groupBy("pair", "turn").agg(F.max("n").alias("_size")).withColumn("_run", F.floor(F.col("turn") / PART))
    runs = sizes.groupBy("pair", "_run").agg(F.sum("_size").alias("_sum"))

    def before(keys: list[str], order: str, value: str) -> Column:
        rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(rows), F.lit(0))

    bases = runs.select("pair", "_run", before(["pair"], "_run", "_sum").alias("_base"))
    starts = sizes.withColumn("_in", before(["pair", "_run"], "turn", "_size")).join(bases, ["pair", "_run"])
    starts = starts.select("pair", "turn", (F.col("_base") + F.col("_in")).alias("_start"))
    return found.join(starts, ["pair", "turn"]).withColumn("place", F.col("_start") + F.col("n") - 1).drop("_start")


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair and part, for conversations (pair, turn, role, text): `prompt_turns`, `prompt`,
    `chosen`, `rejected`, and `chosen_loss`, `rejected_loss`: the code points [start, end) of the
    part's completion to learn from, with the closing mark."""
    found = common_prefix(turns(chosen, pair_col), turns(rejected, pair_col))

    def rendered(side: str) -> Column:
        head = F.concat(F.lit(START), _plain(F.col(f"{side}_role")), F.lit("\n"))
        body = F.concat(_plain(F.col(f"{side}_text")), F.lit(END))
        learn = F.col(f"{side}_role") == "assistant"
        return F.when(F.col(f"{side}_role").isNotNull(), F.struct("turn", "n", head.alias("head"), body.alias("body"), learn.alias("learn")))

    sides = placed(found).select(
        F.col("pair"), F.floor(F.col("place") / PART).cast("bigint").alias("part"), F.when(F.col("common"), rendered("c")).alias("prompt"),
        F.when(~F.col("common"), rendered("c")).alias("chosen"), F.when(~F.col("common"), rendered("r")).alias("rejected"),
    )
    lists = sides.groupBy("pair", "part").agg(
        *(F.sort_array(F.collect_list(s)).alias(s) for s in ("prompt", "chosen", "rejected"))
    )

    def joined(side: str) -> Column:
        return F.array_join(F.transform(side, lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")

    def loss(side: str) -> Column:
        """Spans, by running over the turns with the length so far."""
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(state: Column, t: Column) -> Column:
            start = state["at"] + F.length(t["head"])
            end = start + F.length(t["body"])
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct((end + 1).alias("at"), F.when(t["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(side, begin, step, lambda s: s["spans"])

    return lists.select(
        F.col("pair").alias(pair_col), "part", F.size("prompt").cast("bigint").alias("prompt_turns"),
        *(joined(s).alias(s) for s in ("prompt", "chosen", "rejected")),
        *(loss(s).alias(f"{s}_loss") for s in ("chosen", "rejected")),
    )


def following(cuts: DataFrame) -> DataFrame:
    """`cuts` (conv_id, cut) with `other` and `other_cut` of the next conversation by id over the whole
    table, the first one after the last.

    The ids are dealt by ranges and written with the number of their range, so that a lost task finds
    the same ranges again. Inside a range the next row follows by a window; the last row of a range takes
    the first of the next one, from a table of one row per range.
    """
    dealt = written(cuts.repartitionByRange("conv_id").withColumn("_range", F.spark_partition_id()), "pref-ranges")
    inside = Window.partitionBy("_range").orderBy("conv_id")
    row = F.struct("conv_id", "cut")
    heads = dealt.groupBy("_range").agg(F.min(row).alias("_head"))
    # as many rows as ranges, whatever the number of conversations
    after = Window.orderBy("_range")
    first = F.min("_head").over(Window.partitionBy())
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(after), first).alias("_head"))
    linked = dealt.withColumn("_next", F.lead(row).over(inside)).join(heads, "_range")
    chosen = F.coalesce("_next", "_head")
    return linked.select("conv_id", "cut", chosen["conv_id"].alias("other"), chosen["cut"].alias("other_cut"))


def rejected_by_neighbour(conversations: DataFrame) -> DataFrame:
    """Rejected conversations (conv_id, turn, role, text) where none are given: each conversation with
    its last assistant turn, and what follows, replaced by that of the next conversation by id. The
    first one comes after the last; a conversation alone in its table is its own neighbour."""
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text")
    cuts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.max("turn") + 1).alias("cut")
    )
    pairs = following(cuts)
    kept = rows.join(pairs.select("conv_id", "cut"), "conv_id").filter("turn < cut").select("conv_id", "turn", "role", "text")
    taken = rows.withColumnRenamed("conv_id", "other").join(pairs, "other").filter("turn >= other_cut").select(
        "conv_id", (F.col("turn") - F.col("other_cut") + F.col("cut")).alias("turn"), "role", "text"
    )
    return kept.unionByName(taken)
