"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's `docs`. All but the last
return the columns of `documents` in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import stages
from larder.session import ship, table, written

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("personal_data", stages.personal_data),
    ("source_mix", stages.source_mix),
    ("packing", stages.packing),
]

#: No SQL. Tests compare the groups of near copies with brute force; the rows of the other stages and
#: of the whole run are not compared with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
