"""The stages of the corpus pipeline, each on one operator of this subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the last return
the columns of `docs` in their order. Rows are told apart by a hash of all their columns, so null
and repeated ids do no harm; extra columns are kept, whatever their names; an empty table gives no
rows. Where a stage changes a text, `n_chars` follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import mixing, packing as packer, pii, quality, simhash, similar


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _row_hash(df: DataFrame) -> Column:
    """128 bits over all columns; equal for equal rows only."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(salt), nulls, *columns)), 16, "0") for salt in ("a", "b")))


def _measured(df: DataFrame) -> DataFrame:
    if "n_chars" not in df.columns:
        return df
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, null ids first, and of
    equal ids that with the smallest hash. A group is what pairs connect whose SimHash fingerprints
    differ in at most four bits, met by their Golay keys, or whose shingles of five words have a
    similarity of 0.8 or more; the second takes the near copies that the fingerprints are too far apart for."""
    key = _fresh(docs, "row_key")
    # hexadecimal digits that sort as the ids do
    by_id = F.coalesce(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("-"))
    keyed = docs.withColumn(key, F.concat(by_id, F.lit(":"), _row_hash(docs)))
    texts = keyed.select(key, "text")
    groups = similar.similar_groups(texts, key, linked=simhash.near_groups(texts, key))
    staying = groups.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    return keyed.dropDuplicates([key]).join(staying, key, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them (not at all, once or twice). The one document of
    a source at which its target is reached is cut there, its words joined by spaces."""
    key = _fresh(docs, "row_key")
    keyed = docs.withColumn(key, _row_hash(docs))
    placed, pieces = mixing.mix(keyed.select(key, "text", "source"), key)
    # a walk along a line covers whole documents up to its end, so the pieces of a round adjoin
    rounds = pieces.groupBy("k", "start", "round").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = (
        placed.select("k", "start", "id", "size").join(rounds, ["k", "start"])
        .select(F.col("id").alias(key), F.struct("low", "high", "size").alias(f"{key}_cut"))
    )
    joined = keyed.dropDuplicates([key]).join(wanted, key)
    cut = F.col(f"{key}_cut")
    words = F.regexp_extract_all("text", F.lit(f"({mixing.WORDS})"), F.lit(1))
    part = F.array_join(F.slice(words, (cut["low"] + 1).cast("int"), (cut["high"] - cut["low"]).cast("int")), " ")
    whole = (cut["low"] == 0) & (cut["high"] == cut["size"])
    text = F.when(whole, F.col("text")).otherwise(part)
    return _measured(joined.withColumn("text", text)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences, with its ids."""
    return packer.pack(docs)
