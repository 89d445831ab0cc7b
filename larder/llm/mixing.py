"""Mixing of sources to target weights by a low-discrepancy schedule.

The mix is a schedule of slots of `block` words. Slot j stands at the point frac(j * golden ratio),
and the cumulative shares of the sources say whose slot that is; so every stretch of the schedule
holds the sources in nearly their shares. The slots of a source are ranked. Its documents lie in
shuffled order on a line that is cut into blocks of equal size, and the r-th slot takes block
r mod n of the n blocks, in round r div n. Slots of a source beyond its target are left out, what
the sequence still owes it is appended, and the last slot is cut, so every source ends within one
word of its target.

How it scales: the sizes are kept once (no text goes further). Positions on a line are prefix sums
in two steps: documents fall by hash into buckets of about `bucket` rows of a source, buckets are
summed and accumulated, and a window runs only inside a bucket. Slots are ranked the same way, by
runs of slots. Slots meet sources over cells of equal width, an equality join; documents meet
slots on (source, block), so that a hot source spreads over as many keys as it has blocks. All
steps are DataFrame operations, and nothing but counts reaches the driver.

Null texts have no words and take nothing; a null source is a source of its own, the last. Rows
with equal ids are separate documents; a null id is an id. Sources without words have target 0. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import written

#: 2**32 divided by the golden ratio, odd; a product with less than 2**31 fits 64 bits.
GOLDEN = 2654435769
_TURN = 2**32
_CELLS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds `weight` and `target` to one row (source, source_size) per source.

    The targets share `share` of all words by weight; none exceeds `cap` times its size, and what is
    over goes to the others by weight until none is above. That is a common level times the weight
    for every source below its cap: sources reach it in the order of size over weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("n", F.row_number().over(order)).withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * share
    level = (wanted - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    limit = F.col("source_size") * cap
    # the level that holds at a source if all before it are at their caps; it is the common level at
    # the first source that stays below its cap, and no source before it does
    found = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= limit)
    common = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(limit * 1.0, F.coalesce(common * F.col("weight"), limit * 1.0))
    return found.withColumn("target", target).drop("_level", "_free", "n")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, h): words of every text and the hash that shuffles."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(id_col, text_col).alias("h"),
    )


def _key(source: Column) -> Column:
    """A key that is never null, the same for equal sources only."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows of the same keys that come before, by bucket and then by
    order. Only rows of one bucket meet in a window; buckets are summed and accumulated first."""
    summed = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = summed.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(base, [*keys, bucket]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


def lines(sized: DataFrame, bucket: int = 4096) -> DataFrame:
    """Places the documents with words on the line of their source: adds `start`. Buckets are ranges
    of the hash, so the order on the line is the order of the hash."""
    buckets = max(1, -(-sized.count() // bucket))
    high = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 33)  # 31 bits, in the order of the hash
    dealt = sized.filter("size > 0").withColumn("_b", F.shiftright(high * F.lit(buckets), 31))
    order = [F.col("h"), F.col("id"), F.col("size")]
    return _running(dealt, ["k"], "_b", order, F.col("size"), "start").drop("_b")


def schedule(sources: DataFrame, block: int = 256, run: int = 65_536) -> DataFrame:
    """(slot, k, rank, words) of the whole mix, for sources (k, source_size, target): `rank` counts
    the slots of the source from 0, `words` is what the slot takes, cut at the target."""
    spark = sources.sparkSession
    want = sources.withColumn("words", F.round("target").cast("bigint")).filter("words > 0")
    want = want.withColumn("slots", F.ceil(F.col("words") / block)).select("k", "words", "slots")
    total = want.agg(F.sum("slots")).first()[0] or 0
    ahead = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    scale = float(_TURN) / max(1, total)
    upto = F.coalesce(F.sum("slots").over(ahead), F.lit(0))
    spans = want.select(
        "k", (upto * scale).alias("low"), ((upto + F.col("slots")) * scale).alias("high")
    )
    cell = _TURN // _CELLS
    cells = spans.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.least(F.floor(F.col("high") / cell), F.lit(_CELLS - 1))))
    )
    points = spark.range(total).withColumn("point", (F.col("id") % 2**31) * GOLDEN % _TURN)
    points = points.select(F.col("id").alias("slot"), "point", F.floor(F.col("point") / cell).alias("cell"))
    owned = points.join(cells, "cell").filter("point >= low AND point < high").select("slot", "k")
    ranked = _running(
        owned.withColumn("_run", F.floor(F.col("slot") / run)), ["k"], "_run", [F.col("slot")], F.lit(1), "rank"
    ).select("slot", "k", "rank")
    ranked = written(ranked, "mix-slots")
    got = ranked.groupBy("k").agg(F.count("*").alias("got"))
    owed = (
        want.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("slots > got")
        .select("k", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    )
    # what is owed follows the sequence, one slot of every source in turn
    tail = owed.withColumn("slot", F.lit(total) + F.col("rank"))
    slots = ranked.unionByName(tail).join(want, "k").filter(F.col("rank") < F.col("slots"))
    return slots.select(
        "slot", "k", "rank", F.least(F.lit(block), F.col("words") - F.col("rank") * block).alias("words")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). Documents: id, source, h, size, source_size, target and, where it has
    words, its `start` on the line of its source. Pieces, in the order of `slot` and `place`: which
    words [low, high) of which document (k, start) the mix takes there."""
    sized = written(sizes(docs, id_col, text_col, source_col).withColumn("k", _key(F.col("source"))), "mix-sizes")
    totals = sized.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = written(targets(totals, weights, share, cap), "mix-targets")
    placed = written(lines(sized), "mix-lines")
    slots = schedule(sources.select("k", "source_size", "target"), block)
    # A line of S words is walked from 0 to S and again; slot r covers words [r*block, ...) of the
    # walk, which may run over the end of the line and on from its beginning.
    walk = slots.join(sources.select("k", "source_size"), "k").select(
        "slot", "k", (F.col("rank") * block).alias("from"), (F.col("rank") * block + F.col("words")).alias("to"), "source_size",
    )
    spans = walk.select(
        "slot", "k", "source_size",
        F.explode(F.sequence(F.floor(F.col("from") / F.col("source_size")), F.floor((F.col("to") - 1) / F.col("source_size")))).alias("round"),
        "from", "to",
    ).select(
        "slot", "k", "round",
        (F.greatest("from", F.col("round") * F.col("source_size")) - F.col("round") * F.col("source_size")).alias("a"),
        (F.least("to", (F.col("round") + 1) * F.col("source_size")) - F.col("round") * F.col("source_size")).alias("b"),
    )
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    parts = placed.select("k", "start", "size").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    edge = F.col("cell") * block
    low = F.greatest("a", "start", edge)
    high = F.least("b", F.col("start") + F.col("size"), edge + block)
    pieces = (
        spans.join(parts, ["k", "cell"]).withColumn("_low", low).withColumn("_high", high).filter("_high > _low")
        .select(
            "k", "start", "slot", "round", F.col("_low").alias("place"),
            (F.col("_low") - F.col("start")).alias("low"), (F.col("_high") - F.col("start")).alias("high"),
        )
    )
    empty = sized.filter("size = 0").withColumn("start", F.lit(None).cast("bigint"))
    documents = placed.unionByName(empty).join(sources.select("k", "source_size", "target"), "k")
    return documents, pieces


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents with the number of words the mix takes of each, repeats counted."""
    used = pieces.groupBy("k", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    return documents.join(used, ["k", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
