"""Copies of one text neither gather in one subset nor make the others of their source outliers."""

import random
import re

from pyspark.sql import functions as F

from larder.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string"
VOCABULARY = "the river old fox met twenty other animals near and they all talked about rain for hours until night came down Monday London 17 1999 (see) it's".split()


def clean(rng):
    share = rng.random()
    words = [rng.choice(VOCABULARY[-6:] if rng.random() < 0.25 * share else VOCABULARY[:-6]) for _ in range(rng.randrange(60, 200))]
    return " ".join(words)


#: A legal notice: clean, but of longer words than the other texts.
NOTICE = " ".join(f"{a}{b}" for a in ("provision", "agreement", "liability", "consumer", "warranty", "statute") for b in ("s", "ary", "able", "ness", "hood", "wise"))


def documents(spark):
    """Source a holds 6,000 copies and 4,000 clean texts, source b 1,000 clean texts; ids repeat or are null."""
    rng = random.Random(8)
    rows = [(1, NOTICE, "en", "a")] * 6000
    rows += [(n if n % 7 else None, clean(rng), "en", "aaaab"[n % 5]) for n in range(5000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_clean_texts_stay_beside_sixty_percent_copies(spark):
    docs = documents(spark)
    assert quality.verdicts(docs.limit(1).withColumn("text", F.lit(NOTICE))).filter("base_failed").count() == 0
    kept = quality.keep_good(docs)
    all_clean = docs.filter("doc_id IS NULL OR doc_id <> 1").groupBy("source").count().collect()
    left = {r["source"]: r["count"] for r in kept.filter("doc_id IS NULL OR doc_id <> 1").groupBy("source").count().collect()}
    print("clean rows kept", left, "of", {r["source"]: r["count"] for r in all_clean})
    assert all(left[r["source"]] >= 0.99 * r["count"] for r in all_clean)


def test_stage_and_query_agree_on_equal_rows(spark):
    docs = documents(spark)
    by_row = quality.verdicts(docs.withColumn("row", F.monotonically_increasing_id()).persist(), "row")
    assert by_row.count() == docs.count()
    assert quality.keep_good(docs).count() == by_row.filter("kept").count()


def test_subsets_of_a_group_are_dealt_out(spark):
    """Whether the sizes are joined by broadcast or by a shuffle on the group."""
    rows = spark.range(5000).select(
        F.lit("g").alias("g"), F.array(*(F.rand(i) for i in range(quality.DIMENSIONS))).alias("x"), F.col("id").alias("h")
    )
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = quality.subsets(rows, 1000)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "REPARTITION_BY_NUM" in plan and re.search(r"hashpartitioning\(g(#\d+)?, part#", plan)
    spread = quality.subsets(rows, 1000).select("part", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in spread}) > 1 and len({r.part for r in spread}) == len(spread) == 5


def test_a_column_named_like_the_key_is_kept(spark):
    text = " ".join(VOCABULARY * 3)
    docs = spark.createDataFrame([(i, text + f" {i}", "en", "s", "mine") for i in range(12)], SCHEMA + ", _key string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["_key"] for r in kept.collect()} <= {"mine"}
