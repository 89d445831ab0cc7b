"""Keyed tables whose upserts rewrite only what they touch.

A store is a folder with any number of tables. Every table is hashed by its key into a fixed number of
buckets, and a bucket is one or more folders of Parquet files that never change. A version file says
which folders make up every bucket of every table; it is put in place by one rename that fails when the
version is already there. So

- an upsert reads and rewrites the buckets that its rows fall into, and all others keep their files,
- a job that fails leaves folders that no version names, and the tables as they were,
- a reader works on one version throughout, whatever is committed meanwhile,
- a change of several tables is seen whole or not at all, and can carry the number of the batch that
  made it, so a repeated batch is recognised,
- of two writers that start from one version the second fails and can begin again.

The version file has one line per bucket; choose the buckets so that one holds some hundred megabytes.
Rows without a key are spread by their whole content and never updated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.tables import upsert

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


@dataclass(frozen=True)
class Table:
    """One table of a version: the folders of every bucket that has rows."""

    key: str
    by: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def bucket(self, df: DataFrame) -> Column:
        """The bucket of a row: by the hashed columns, without a key by all that it holds."""
        keyed = F.xxhash64(*self.by)
        if self.key in self.by:
            whole = F.xxhash64(F.to_json(F.struct(*df.columns)))
            keyed = F.when(F.col(self.key).isNull(), whole).otherwise(keyed)
        return F.pmod(keyed, F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        tables = {
            name: {"key": t.key, "by": t.by, "buckets": t.buckets, "schema": t.schema, "folders": t.folders}
            for name, t in self.tables.items()
        }
        return json.dumps({"number": self.number, "tables": tables, "marks": self.marks})

    @staticmethod
    def parsed(text: str) -> Version:
        found = json.loads(text)
        tables = {
            name: Table(
                t["key"], tuple(t["by"]), t["buckets"], t["schema"],
                {int(b): tuple(f) for b, f in t["folders"].items()},
            )
            for name, t in found["tables"].items()
        }
        return Version(found["number"], tables, found["marks"])


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        files = path.getFileSystem(self._conf)
        if not files.exists(path):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(path))

    def _put(self, name: str, text: str) -> None:
        """A file that appears at once and whole, or not at all if it is there already."""
        draft, path = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        files = draft.getFileSystem(self._conf)
        files.mkdirs(path.getParent())
        out = files.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, path, none)
        except Exception as e:
            if files.exists(path):
                raise Conflict(name) from e
            raise

    # --- versions ---------------------------------------------------------------------

    def numbers(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """A version as it was committed; the newest by default, an empty one before the first."""
        found = self.numbers()
        if number is None:
            number = found[-1] if found else 0
        if not number:
            return Version()
        row = self.spark.read.text(f"{self.root}/versions/v{number:010d}.json", wholetext=True).first()
        return Version.parsed(row[0])

    def applied(self, mark: tuple[str, int]) -> bool:
        """Whether a change with this mark, or a later one of the same job, is committed."""
        return self.version().marks.get(mark[0], -1) >= mark[1]

    def commit(self, base: Version, changed: dict[str, Table], mark: tuple[str, int] | None = None) -> Version:
        """Put `base` with the changed tables in place as the next version."""
        marks = base.marks | ({mark[0]: mark[1]} if mark else {})
        after = Version(base.number + 1, base.tables | changed, marks)
        self._put(f"versions/v{after.number:010d}.json", after.text())
        return after

    # --- rows -------------------------------------------------------------------------

    def read(self, name: str, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets; None if there is no such table."""
        version = version or self.version()
        if name not in version.tables:
            return None
        table = version.tables[name]
        schema = StructType.fromJson(json.loads(table.schema))
        wanted = table.folders if buckets is None else {b: table.folders[b] for b in set(buckets) if b in table.folders}
        paths = [f"{self.root}/{name}/{folder}/{_BUCKET}={b}" for b, folders in wanted.items() for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def touched(self, table: Table, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: as many numbers as the table has buckets at most."""
        return [r[0] for r in rows.select(table.bucket(rows).alias(_BUCKET)).distinct().collect()]

    def matching(self, name: str, rows: DataFrame, version: Version | None = None) -> DataFrame | None:
        """The buckets that can hold partners of `rows`, which have the columns the table is hashed by."""
        version = version or self.version()
        table = version.tables.get(name)
        return None if table is None else self.read(name, version, self.touched(table, rows))

    def _written(self, name: str, table: Table, rows: DataFrame) -> dict[int, str]:
        """Rows written to a new folder; the buckets found in it."""
        folder = uuid.uuid4().hex
        keyed = rows.withColumn(_BUCKET, table.bucket(rows))
        # buckets larger than Spark's advisory size are cut, so that no task sorts a whole one
        keyed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(
            f"{self.root}/{name}/{folder}", compression="zstd"
        )
        return {
            int(n.removeprefix(f"{_BUCKET}=")): folder
            for n in self._names(f"{name}/{folder}") if n.startswith(f"{_BUCKET}=")
        }

    def table(self, version: Version, name: str, like: DataFrame, key: str, buckets: int, by: list[str] | None = None) -> Table:
        """The table of a version, or a new empty one with the columns of `like`."""
        return version.tables.get(name) or Table(key, tuple(by or [key]), buckets, like.schema.json())

    def appended(self, name: str, table: Table, rows: DataFrame) -> Table:
        """`table` with rows added; nothing that is there is read."""
        columns = StructType.fromJson(json.loads(table.schema)).names
        new = self._written(name, table, rows.select(*columns))
        folders = dict(table.folders)
        for b, folder in new.items():
            folders[b] = (*folders.get(b, ()), folder)
        return replace(table, folders=folders)

    def replaced(self, name: str, table: Table, rows: DataFrame) -> Table:
        """`table` with these rows instead of its own."""
        return replace(table, folders={b: (f,) for b, f in self._written(name, table, rows).items()})

    def upserted(
        self, name: str, table: Table, rows: DataFrame, *, setting: tuple[DataFrame, list[str]] | None = None, **options
    ) -> Table:
        """`table` after an upsert of rows by its key (options as of `tables.upsert`). Then the rows of
        `setting` set its columns in the rows that have their keys; all is written once. Rows are read
        more than once and must give the same rows each time."""
        key, hit = table.key, set(self.touched(table, rows))
        if setting:
            hit |= set(self.touched(table, setting[0]))
        old = self.read(name, Version(tables={name: table}), hit)
        if not setting:
            state = upsert(old, rows, key, **options)
        else:
            # joined to either side before these meet, so that whole rows are shuffled by the key once
            late = setting[0].select(key, F.struct(*setting[1]).alias("_late"))
            old = old.join(late.join(rows.select(key), key, "left_anti"), key, "left")
            state = upsert(old, rows.join(late, key, "left"), key, **options)
            state = state.select(*[
                F.when(F.col("_late").isNotNull(), F.col(f"_late.{c}")).otherwise(F.col(c)).alias(c)
                if c in setting[1] else F.col(c) for c in state.columns if c != "_late"
            ])
        new = self._written(name, table, state)
        folders = {b: f for b, f in table.folders.items() if b not in hit}
        return replace(table, folders=folders | {b: (f,) for b, f in new.items()})

    def upsert(
        self, name: str, rows: DataFrame, key: str, *, buckets: int = 64,
        mark: tuple[str, int] | None = None, retries: int = 3, **options,
    ) -> Version:
        """Upsert rows into a table and commit; begins again when another writer was first. With a mark
        that is already applied nothing happens."""
        for attempt in range(retries + 1):
            base = self.version()
            if mark and base.marks.get(mark[0], -1) >= mark[1]:
                return base
            table = self.table(base, name, rows, key, buckets)
            try:
                return self.commit(base, {name: self.upserted(name, table, rows, **options)}, mark)
            except Conflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def rebucket(self, name: str, buckets: int) -> Version:
        """Deal a table out anew, for tables that have outgrown their buckets."""
        base = self.version()
        table = replace(base.tables[name], buckets=buckets, folders={})
        return self.commit(base, {name: self.replaced(name, table, self.read(name, base))})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete version files before the newest `keep` and the folders that none of these name. To be
        run while no other writer is at work, as it cannot tell its folders from abandoned ones."""
        found = self.numbers()
        kept = [self.version(n) for n in found[-keep:]]
        gone = [f"versions/v{n:010d}.json" for n in found[:-keep]]
        for name in {t for v in kept for t in v.tables}:
            named = {f for v in kept if name in v.tables for fs in v.tables[name].folders.values() for f in fs}
            gone += [f"{name}/{f}" for f in self._names(name) if f not in named]
        files = self._path("").getFileSystem(self._conf)
        for path in gone:
            files.delete(self._path(path), True)
        return gone
