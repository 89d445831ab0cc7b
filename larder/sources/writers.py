"""Writers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import publish
from larder.operators.tables import insertable
from larder.sources.store import Store


def append_rows(
    df: DataFrame, path: str, required: list[str], defaults: dict[str, Column], rejects: str
) -> None:
    """Append rows with defaults filled; rows lacking a required value go to `rejects`."""
    good, bad = insertable(df, required, defaults)
    good.write.mode("append").parquet(path)
    bad.write.mode("append").parquet(rejects)


# --- a single versioned table: a store that holds nothing else ------------------------

_ROWS = "rows"


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version of a table, None before the first."""
    return Store(spark, root).read(_ROWS)


def upsert_table(root: str, new: DataFrame, key: str, buckets: int = 64, **options) -> DataFrame:
    """Upsert rows into a versioned table; only the buckets that they fall into are rewritten."""
    store = Store(new.sparkSession, root)
    return store.read(_ROWS, store.upsert(_ROWS, new, key, buckets=buckets, **options))


def clear_table(spark: SparkSession, root: str) -> tuple[int, int]:
    """Empty a versioned table; the number of rows before and after."""
    store = Store(spark, root)
    base = store.version()
    old = store.read(_ROWS, base)
    if old is None:
        return 0, 0
    after = store.commit(base, {_ROWS: replace(base.tables[_ROWS], folders={})})
    return old.count(), store.read(_ROWS, after).count()


# --- files --------------------------------------------------------------------------


def write_sitemaps(
    lines: DataFrame, folder: str, site: str, per_file: int = fixed.URLS_PER_SITEMAP,
    per_index: int = fixed.URLS_PER_SITEMAP,
) -> DataFrame:
    """Write complete sitemap files of `per_file` urls each and complete index files of `per_index`
    entries each; returns the entries `(shard, index, entry)`.

    Files are numbered without gaps: `maps/shard=0`, `maps/shard=1` and so on hold one file each, and
    so do `index/index=0` and on. All but the last of either are full; where there are several index
    files, each is handed in on its own, since an index may not name another.
    """

    def write(rows: DataFrame, key: str, path: str) -> None:
        rows.repartition(key).sortWithinPartitions(key, "_at").select(key, "value").write.partitionBy(key).text(path)

    shards = publish.in_shards(lines, per_file)
    write(publish.whole_files(shards, "shard", "place", "line", fixed.SITEMAP_HEAD, fixed.SITEMAP_FOOT), "shard", f"{folder}/maps")
    files = lines.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/maps")
    name = F.regexp_extract("path", r"(shard=[0-9]+/[^/]+)$", 1)
    entry = F.format_string(fixed.SITEMAP_ENTRY.format(site=site.replace("%", "%%") + "/maps/%s"), name)
    number = F.regexp_extract("path", r"shard=([0-9]+)/[^/]+$", 1).cast("bigint")
    index = files.select(number.alias("shard"), entry.alias("entry"))
    index = index.withColumn("index", F.floor(F.col("shard") / per_index).cast("bigint"))
    write(publish.whole_files(index, "index", "shard", "entry", fixed.SITEMAP_INDEX_HEAD, fixed.SITEMAP_INDEX_FOOT), "index", f"{folder}/index")
    return index


def write_documents(documents: DataFrame, folder: str) -> None:
    """One JSON document per line."""
    documents.select("document").write.text(folder)


def write_report(report: DataFrame, folder: str) -> None:
    report.write.json(folder)
