"""The audit as a loop over stored tables: recipes arrive, those due are audited, and what follows is
written back together.

A store holds `recipes` (hashed by id) and `jobs` (hashed by url). One round

1. upserts the arriving recipes, which makes them pending;
2. chooses the rows that are pending or were never audited, from the key and status columns alone, and
   reads whole only the buckets that hold them;
3. audits them against the jobs of their urls, from the buckets these fall into, and the side tables, with
   the score instead of the long columns;
4. writes the buckets once, with what arrived and the verdicts;
5. commits the recipes with their verdicts and the new re-crawl jobs as one version under the number of
   the round.

So no reader sees a verdict without its job, a repeated round does nothing, and a lost one leaves both
tables as they were. Recipes without an id are not taken; nothing could write their verdict back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import audit as au
from larder.operators.catalog import needs_audit
from larder.operators.tables import upsert
from larder.session import written
from larder.sources.store import Store, Version

_MARK = "audit"
_VERDICT = ["qa_status", "quality_score", "last_audited_at", "audit_log", "nutrition", "image"]

_FACTS = ["id", "url", "name", "image", "nutrition", "quality_score", "no_steps"]

#: The tables that an audit looks things up in: checked image urls and nutrition by name.
Sides = Callable[[], tuple[DataFrame, DataFrame]]


def add_jobs(store: Store, jobs: DataFrame, buckets: int = 64) -> Version:
    """Put crawl jobs into the store."""
    base = store.version()
    table = store.table(base, "jobs", jobs, "id", buckets, ["url"])
    return store.commit(base, {"jobs": store.appended("jobs", table, jobs)})


def due(
    store: Store, base: Version, arriving: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The recipes to audit: the arriving ones as the upsert would leave them, and the stored ones that
    are pending or never audited. `cut` shortens rows of either kind before they are joined."""
    stored = store.read("recipes", base)
    if stored is None:
        return needs_audit(cut(arriving))
    ids = written(needs_audit(stored).filter(F.col("id").isNotNull()).select("id"), "audit-due")
    if arriving is not None:
        ids = ids.union(arriving.select("id")).distinct()
    rows = cut(store.matching("recipes", ids, base)).join(ids, "id", "left_semi")
    if arriving is not None:
        rows = upsert(rows, cut(arriving), "id")
    return needs_audit(rows)


def audit_round(
    store: Store, number: int, now: Column, sides: Sides, arriving: DataFrame | None = None, buckets: int = 64,
) -> bool:
    """One round; whether there was anything to do."""
    base = store.version()
    if base.marks.get(_MARK, -1) >= number:
        return False
    if arriving is not None:
        arriving = written(arriving.filter(F.col("id").isNotNull()), "audit-arriving", "zstd")
        table = store.table(base, "recipes", arriving, "id", buckets)
    elif "recipes" not in base.tables:
        return False
    else:
        table = base.tables["recipes"]
    checks, nutrition = sides()
    todo = written(au.measured(due(store, base, arriving, au.brief)).select(*_FACTS), "audit-todo")
    jobs = store.matching("jobs", todo.select("url"), base)
    if jobs is None:
        kinds = todo.select(F.col("id").cast("string").alias("id"), "url").schema
        jobs = todo.sparkSession.createDataFrame([], kinds).select(
            "*", F.lit("").alias("status"), F.lit(0).alias("retry_count"), now.alias("updated_at")
        )
    audited = au.judged(todo, checks, nutrition, jobs, now)
    audited = written(audited.select("id", "url", *_VERDICT, "schedule", "retries"), "audit-verdicts")
    if arriving is None and audited.isEmpty():
        return False
    verdicts = audited.select("id", *_VERDICT)
    tables = {
        "recipes": store.upserted("recipes", table, verdicts, overwrite=_VERDICT) if arriving is None
        else store.upserted("recipes", table, arriving, setting=(verdicts, _VERDICT))
    }
    again = au.recrawl_jobs(audited, now)
    if "jobs" in base.tables:
        again = again.select(*[F.col(f.name).cast(f.dataType) for f in store.read("jobs", base).schema.fields])
    tables["jobs"] = store.appended("jobs", store.table(base, "jobs", again, "id", buckets, ["url"]), again)
    store.commit(base, tables, (_MARK, number))
    return True


def audit_stream(
    arriving: DataFrame, store: Store, checkpoint: str, now: Callable[[int], Column], sides: Sides, **options
) -> StreamingQuery:
    """A round for every micro-batch of arriving recipes, one row per id and batch."""

    def work(batch: DataFrame, number: int) -> None:
        audit_round(store, number, now(number), sides, batch, **options)

    return (
        arriving.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
